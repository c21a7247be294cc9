"""Finding a business's website: words of its name, likely domains, phones on a page, and how sure a page is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrat.functions.names import GENERIC

#: Words of a name that are no part of a domain, and endings that are tried.
LEGAL = ("inc", "llc", "co", "corp", "corporation", "ltd", "lp", "llp", "the", "and", "of")
ENDINGS = (".com", ".net")
PHONE = r"(?<!\d)\(?(\d{3})\)?[\s.\-]?(\d{3})[\s.\-]?(\d{4})(?!\d)"


def digits(phone: Column) -> Column:
    """The last ten digits; '' with fewer."""
    d = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", "")
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10))).otherwise("")


def pretty_phone(d: Column) -> Column:
    return F.concat(F.lit("("), d.substr(1, 3), F.lit(") "), d.substr(4, 3), F.lit("-"), d.substr(7, 4))


def raw_words(name: Column) -> Column:
    words = F.regexp_extract_all(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), F.lit("[a-z0-9]+"), 0)
    return F.filter(words, lambda w: ~w.isin(*LEGAL))


def distinctive(name: Column) -> Column:
    return F.filter(raw_words(name), lambda w: ~F.upper(w).isin(*GENERIC) & (F.length(w) >= 2))


def candidate_domains(name: Column) -> Column:
    """Likely addresses, best first; never of a single word unless the name is one."""
    words, own = raw_words(name), distinctive(name)
    stem = lambda parts, ok: F.when(ok & (F.length(F.array_join(parts, "")) >= 5), F.array_join(parts, ""))
    two = F.slice(words, 1, 2)
    stems = F.array_distinct(F.array_compact(F.array(stem(words, F.size(words) >= 1), stem(own, F.size(own) >= 2), stem(two, F.size(two) >= 2))))
    return F.flatten(F.transform(stems, lambda s: F.array(*(F.concat(s, F.lit(e)) for e in ENDINGS))))


def phones(html: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(PHONE), 0), lambda p: F.regexp_replace(p, r"\D", "")))


def verdict(html: Column, name: Column, phone: Column) -> Column:
    """'verified' with the business's phone on the page, 'likely' with all of its own words, else 'not_found'."""
    own = distinctive(name)
    text = F.lower(html)
    named = (F.size(own) > 0) & F.forall(own, lambda w: F.contains(text, w))
    return F.when((digits(phone) != "") & F.array_contains(phones(html), digits(phone)), "verified").when(named, "likely").otherwise("not_found")
