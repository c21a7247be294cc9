"""Public-land-survey locations: site ids and MTRS codes as structs of meridian, township, range and section."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOWNSHIPS, RANGES, SECTIONS = 48, 60, 36
#: Letters that a scan takes for digits.
REPAIRS = ("OQDI|", "00011")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def site(meridian: Column, township: Column, tdir: Column, range_: Column, rdir: Column, section: Column, confidence: Column) -> Column:
    """The struct, or null if a number is out of bounds."""
    ok = township.between(1, TOWNSHIPS) & range_.between(1, RANGES) & section.between(1, SECTIONS)
    fields = F.struct(meridian.alias("meridian"), township.alias("township"), tdir.alias("township_dir"), range_.alias("range"), rdir.alias("range_dir"), section.alias("section"), confidence.alias("confidence"))
    return F.when(ok, fields)


#: counties' usual meridian and directions where a location leaves them out, and those where the direction isn't certain.
COUNTIES = {
    "lassen": "MNE", "plumas": "MNE", "shasta": "MNE", "butte": "MNE", "tehama": "MNE", "modoc": "MNE", "sierra": "MNE", "nevada": "MNE", "placer": "MNE", "siskiyou": "MNE",
    "trinity": "HNE", "humboldt": "HNE", "del norte": "HNE", "mendocino": "HNW",
}
UNSURE = ("siskiyou", "trinity", "mendocino")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def county_usual(county: Column) -> Column:
    """struct(meridian, township_dir, range_dir, sure) of a county's name; the commonest ones, not sure, for others."""
    name = F.lower(F.trim(county))
    known = F.create_map(*(F.lit(x) for kv in COUNTIES.items() for x in kv))
    return let(F.coalesce(F.try_element_at(known, name), F.lit("MNE")), lambda u: F.struct(F.substring(u, 1, 1).alias("meridian"), F.substring(u, 2, 1).alias("township_dir"), F.substring(u, 3, 1).alias("range_dir"), F.coalesce(name.isin(*COUNTIES) & ~name.isin(*UNSURE), F.lit(False)).alias("sure")))


def decode_site_id(raw: Column, known_county: Column | None = None) -> Column:
    """A site id of one of three shapes: directions written out; a letter N or S (or R, T, X, for the usual direction) between township and the rest; six digits.

    ``known_county``: true where the county's usual directions are certain.
    Confidence: verified if nothing was taken for granted, else high with a
    known county and medium without. Null if it can't be decoded. Each shape is
    matched once; what it finds is kept as one comma-separated text.
    """
    full = r"^([MHS])?\s*T?\s*(\d{1,2})\s*([NS])\s*R?\s*(\d{1,2})\s*([EW])\s*(?:SECTION|SEC|S)?\s*(\d{1,2})$"
    letter, six = r"^(\d{2})([NSRTX])(\d{2})(\d{2})$", r"^(\d{2})(\d{2})(\d{2})$"
    t = F.trim(F.regexp_replace(F.regexp_replace(F.upper(raw), "[.,_]", ""), r"\s+", " "))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, full, "F,$1,$2,$3,$4,$5,$6"), letter, "L,M,$1,$2,$3,E,$4"), six, "D,M,$1,N,$2,E,$3")
    guessed = F.when(F.coalesce(known_county if known_county is not None else F.lit(False), F.lit(False)), "high").otherwise("medium")

    def made(p: Column) -> Column:
        meridian = F.when(F.get(p, 1) == "", "M").otherwise(p[1])
        return F.when(F.size(p) == 7, site(meridian, _int(p[2]), F.when(p[3] == "S", "S").otherwise("N"), _int(p[4]), p[5], _int(p[6]), F.when(p[0] == "F", "verified").otherwise(guessed)))

    return let(F.split(t, ","), made)


def decode_structured(township: Column, range_: Column, section: Column, township_dir: Column, range_dir: Column, meridian: Column, county: Column) -> Column:
    """A location from separate columns. Letters T, R and S before numbers are dropped; what is missing comes from the county's usual values, which lowers confidence to high, or to medium where the county isn't certain. Null if a number isn't one or is out of bounds."""
    number = lambda c: _int(F.coalesce(F.nullif(F.regexp_replace(F.trim(c.cast("string")), "^[TRS]+", ""), F.lit("")), F.lit("0")))
    letter = lambda c, of: F.when(F.substring(F.upper(F.trim(c)), 1, 1).isin(*of), F.substring(F.upper(F.trim(c)), 1, 1))

    def made(u: Column) -> Column:
        given = [letter(meridian, "MHS"), letter(township_dir, "NS"), letter(range_dir, "EW")]
        whole = given[0].isNotNull() & given[1].isNotNull() & given[2].isNotNull()
        sure = F.when(whole, "verified").when(u["sure"], "high").otherwise("medium")
        m, td, rd = (F.coalesce(g, u[k]) for g, k in zip(given, ("meridian", "township_dir", "range_dir"), strict=True))
        return site(m, number(township), td, number(range_), rd, number(section), sure)

    return let(county_usual(county), made)


def subsection(text: Column) -> Column:
    """Quarter sections as 'NW/4 SE/4'; null if the text names none."""
    parts = F.regexp_extract_all(F.regexp_replace(F.upper(text), "[^NSEW/]", ""), F.lit("([NS][EW]|[NSEW])"), F.lit(1))
    return F.nullif(F.array_join(F.transform(parts, lambda p: F.concat(p, F.lit("/4"))), " "), F.lit(""))


def township_key(s: Column) -> Column:
    """'T30N R10E', or what says that there is no location."""
    return F.when(s.isNull(), "unknown").otherwise(F.format_string("T%d%s R%d%s", s["township"], s["township_dir"], s["range"], s["range_dir"]))


def parse_mtrs(text: Column) -> Column:
    """An MTRS code such as M29N11E23; letters misread for digits are repaired, which lowers confidence to high."""
    t = F.regexp_replace(F.upper(text), r"\s+", "")
    shape = r"^([MHS])([0-9OQDI|]+)([NS])([0-9OQDI|]+)([EW])([0-9OQDI|]+)$"

    def made(p: Column) -> Column:
        number = lambda i: _int(F.translate(p[i], *REPAIRS))
        repaired = F.concat(p[1], p[3], p[5]).rlike("[OQDI|]")
        return F.when(F.size(p) == 6, site(p[0], number(1), p[2], number(3), p[4], number(5), F.when(repaired, "high").otherwise("verified")))

    return let(F.split(F.regexp_replace(F.replace(t, F.lit(","), F.lit("?")), shape, "$1,$2,$3,$4,$5,$6"), ","), made)


def mtrs(s: Column) -> Column:
    """The code of a location; null for none."""
    return let(s, lambda s: F.when(s.isNotNull(), F.format_string("%s%02d%s%02d%s%02d", s["meridian"], s["township"], s["township_dir"], s["range"], s["range_dir"], s["section"])))


def legal_description(s: Column) -> Column:
    return F.format_string("T%d%s R%d%s Section %d", s["township"], s["township_dir"], s["range"], s["range_dir"], s["section"])


def federal_section_id(s: Column) -> Column:
    meridian = F.when(s["meridian"] == "H", "15").when(s["meridian"] == "S", "27").otherwise("21")
    return F.concat(F.lit("CA"), meridian, F.format_string("%03d0%s%03d0%s0SN%02d0", s["township"], s["township_dir"], s["range"], s["range_dir"], s["section"]))


def trs(s: Column) -> Column:
    """A location without its meridian, which a site id doesn't print."""
    return F.struct(*(s[k] for k in ("township", "township_dir", "range", "range_dir", "section")))


def cross_check(a: Column, b: Column) -> Column:
    """'agree', 'conflict', 'site_only', 'mtrs_only' or 'none' of two decoded locations, by township, range and section."""
    return F.when(a.isNull() & b.isNull(), "none").when(b.isNull(), "site_only").when(a.isNull(), "mtrs_only").when(trs(a) == trs(b), "agree").otherwise("conflict")


def reconciled(a: Column, b: Column, both_given: Column) -> Column:
    """The location to use of a decoded site id and MTRS, with its confidence.

    Where both agree it is the MTRS's, verified; in conflict the MTRS's, medium.
    Of one alone it is that, and no better than high if both were given.
    """

    def with_confidence(s: Column, c: Column) -> Column:
        return F.when(s.isNotNull(), F.struct(*(s[k].alias(k) for k in ("meridian", "township", "township_dir", "range", "range_dir", "section")), c.alias("confidence")))

    one = F.coalesce(a, b)
    lowered = F.when(both_given & (one["confidence"] == "verified"), "high").otherwise(one["confidence"])
    return F.when(a.isNull() | b.isNull(), with_confidence(one, lowered)).when(trs(a) == trs(b), with_confidence(b, F.lit("verified"))).otherwise(with_confidence(b, F.lit("medium")))


def grid(s: Column) -> tuple[Column, Column]:
    """Absolute x and y of a section; sections of a township run to and fro from its north-east corner."""
    n = s["section"] - 1
    row, col = F.floor(n / 6).cast("int"), F.pmod(n, F.lit(6))
    col = F.when(row % 2 == 0, 5 - col).otherwise(col)
    x = F.when(s["range_dir"] == "E", s["range"] * 6 + col).otherwise(-s["range"] * 6 + col)
    y = F.when(s["township_dir"] == "N", s["township"] * 6 - row).otherwise(-s["township"] * 6 - row)
    return x, y


def adjacent(a: Column, b: Column) -> Column:
    """Of one meridian and at most one section apart in both directions."""
    (ax, ay), (bx, by) = grid(a), grid(b)
    return (a["meridian"] == b["meridian"]) & (F.abs(ax - bx) <= 1) & (F.abs(ay - by) <= 1)
