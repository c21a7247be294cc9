"""Traffic helpers: bots, daily visitor pseudonyms, referrer hosts, clean paths, and facts found in pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words in the user agents of crawlers and monitors.
BOTS = "(?i)bot|crawl|spider|slurp|fetch|scan|monitor|preview|headless|lighthouse|curl|wget|python-requests|go-http-client|java/|facebookexternalhit|whatsapp|telegram|discord|skype|embedly|quora|pinterest|semrush|ahrefs"


def is_bot(agent: Column) -> Column:
    return agent.isNull() | (F.length(agent) < 12) | agent.rlike(BOTS)


def visitor_hash(ip: Column, agent: Column, day: Column, secret: str) -> Column:
    """A pseudonym that holds for a day."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(secret), F.date_format(day, "yyyy-MM-dd"), ip, agent), 256), 1, 32)


def url_host(url: Column) -> Column:
    """Lower-case host without www; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", F.substring(F.regexp_replace(host, r"^www\.", ""), 1, 160))


def referrer_host(referrer: Column, own: str) -> Column:
    host = url_host(referrer)
    return F.when(host != own.lower().removeprefix("www."), host)


def clean_path(path: Column) -> Column:
    p = F.regexp_extract(path, r"^[^?#]*", 0)
    return F.substring(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)), 1, 512)


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def html_hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 0)


def is_page(path: str) -> Column:
    """Neither a call of the interface nor a part of the site's code."""
    return ~F.startswith(F.col(path), F.lit("/api/")) & ~F.startswith(F.col(path), F.lit("/_next/"))
