"""Quantities: gallons and pounds are never added; what cannot be resolved is reported apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Volume units in US gallons.
GALLONS = {
    "GALLON": 1.0, "GALLONS": 1.0, "GAL": 1.0, "QUART": 0.25, "QT": 0.25, "PINT": 0.125, "PT": 0.125, "FLUID OUNCE": 1 / 128, "FL OZ": 1 / 128, "FLOZ": 1 / 128,
    "LITER": 0.264172, "LITRE": 0.264172, "L": 0.264172, "MILLILITER": 0.000264172, "ML": 0.000264172,
}
#: Mass units in pounds. The forms in brackets never match a normalised unit.
POUNDS = {
    "POUND": 1.0, "POUNDS": 1.0, "LB": 1.0, "LBS": 1.0, "TON": 2000.0, "TONS": 2000.0, "OUNCE (DRY)": 1 / 16, "DRY OUNCE": 1 / 16, "OZ (DRY)": 1 / 16,
    "GRAM": 0.00220462, "G": 0.00220462, "KILOGRAM": 2.20462, "KG": 2.20462,
}
#: Counted units, units of either family, and formulation words.
COUNTED = ("EACH", "UNIT", "UNITS", "CONTAINER", "CONTAINERS", "PIECE")
EITHER = ("OUNCE", "OUNCES", "OZ")
DRY = ("DF", "WDG", "WG", "SG", "WP", "DG", "G", "GR", "DRY", "GRANULE", "GRANULAR", "POWDER", "PELLET", "BAIT")
LIQUID = ("SL", "EC", "SC", "ME", "EW", "SE", "AS", "LC", "L", "LIQUID", "SOLUTION", "CONCENTRATE", "EMULSIFIABLE", "MSO", "OIL", "COC")


def unit_key(unit: Column) -> Column:
    """Upper case, anything but letters and blanks to a blank, outer blanks off; inner blanks stay as they are. Null gives ''."""
    return F.coalesce(F.trim(F.regexp_replace(F.upper(unit), "[^A-Z ]", " ")), F.lit(""))


def _known(key: Column) -> Column:
    """struct(gallons, pounds, counted, either) of a unit's key; null if the unit is unknown. Volumes are asked before masses."""
    rows = []
    for name in (*GALLONS, *POUNDS, *COUNTED, *EITHER):
        gallons, pounds = GALLONS.get(name), POUNDS.get(name) if name not in GALLONS else None
        of = (F.lit(gallons).cast("double").alias("gallons"), F.lit(pounds).cast("double").alias("pounds"), F.lit(name in COUNTED).alias("counted"), F.lit(name in EITHER).alias("either"))
        rows += [F.lit(name), F.struct(*of)]
    return F.try_element_at(F.create_map(*rows), key)


def formulation_state(product: Column, formulation: Column | None = None) -> Column:
    """'dry', 'liquid' or null: the formulation is asked before the name, and dry words before liquid ones."""

    def of(text: Column) -> Column:
        words = F.split(F.upper(text), "[^A-Z0-9]+")
        has = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
        return F.when(has(DRY), "dry").when(has(LIQUID), "liquid")

    return of(product) if formulation is None else F.coalesce(of(formulation), of(product))


def normalize_quantity(amount: Column, unit: Column, state: Column | None = None) -> Column:
    """struct(family, gallons, pounds, count, note). ``state`` ('dry', 'liquid', null) decides an ounce. """
    state = F.lit(None).cast("string") if state is None else state

    def made(x: dict[str, Column]) -> Column:
        ounce = F.coalesce(x["known"]["either"], F.lit(False))
        gallons = F.when(ounce, F.when(state == "liquid", amount / 128)).otherwise(amount * x["known"]["gallons"])
        pounds = F.when(ounce, F.when(state == "dry", amount / 16)).otherwise(amount * x["known"]["pounds"])
        count = F.when(x["known"]["counted"], amount)
        family = F.when(gallons.isNotNull(), "volume").when(pounds.isNotNull(), "mass").when(count.isNotNull(), "count").otherwise("unknown")
        note = (
            F.when(amount.isNull(), "no quantity").when(x["key"] == "", "no unit").when(ounce & (state == "dry"), "weight ounce of a dry product").when(ounce & (state == "liquid"), "fluid ounce of a liquid product")
            .when(ounce, "ounce of an unknown formulation").when(family == "unknown", F.concat(F.lit("unknown unit "), unit))
        )
        return F.struct(family.alias("family"), gallons.alias("gallons"), pounds.alias("pounds"), count.alias("count"), note.alias("note"))

    key = unit_key(unit)
    return made({"key": key, "known": _known(key)})


def active_ingredient_pounds(gallons: Column, pounds: Column, percent: Column, density: Column) -> Column:
    """struct(pounds, gap): pounds of active ingredient, or null and why."""
    part = percent / 100.0
    value = F.when(pounds.isNotNull(), pounds * part).when(gallons.isNotNull(), gallons * density * part)
    gap = F.when(percent.isNull(), "percent unknown").when(pounds.isNull() & gallons.isNull(), "quantity unresolved").when(pounds.isNull() & density.isNull(), "density unknown")
    return F.struct(value.alias("pounds"), gap.alias("gap"))
