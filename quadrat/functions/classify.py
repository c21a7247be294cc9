"""Ordered rules that put sites, tank additives, methods and inspections into classes. The words and their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SITE_CODES = {"30000": "forestry"}
SITE_WORDS = (
    ("forestry", r"\b(FOREST|TIMBER|TMBRLND|TIMBERLAND|SILVICULT|CHRISTMAS TREE)\b"),
    ("rights_of_way", r"\b(RIGHT[S]? OF WAY|RIGHTOFWAY|ROADSIDE|ROADWAY|HIGHWAY|RAILROAD|UTILITY|POWERLINE|PIPELINE)\b"),
    ("aquatic", r"\b(AQUATIC|WATER AREA|WATERWAY|WATER BODY|DITCH|CANAL|RESERVOIR|IRRIGATION SYSTEM|DRAINAGE|RIPARIAN|WETLAND)\b"),
    ("invasive_plant", r"\b(INVASIVE|NOXIOUS WEED|WEED ABATEMENT|VEGETATION MANAGEMENT)\b"),
    ("landscape", r"\b(LANDSCAPE|ORNAMENTAL|TURF|GOLF|NURSERY|GREENHOUSE|PARK)\b"),
    ("structural", r"\b(STRUCTUR|BUILDING|WAREHOUSE|RESIDENTIAL)\b"),
    ("other", r"\b(UNCULTIVATED|NON[- ]?AG|NONCROP|NON[- ]?CROP|FALLOW|RANGELAND|PASTURE)\b"),
)
ADJUVANT_WORDS = (
    ("marker_dye", r"\b(DYE|COLORANT|MARKER|BLAZON|BULLSEYE|HI[- ]?LIGHT|TURF ?MARK|SPRAY ?PATTERN INDICATOR|BLUE INDICATOR)\b"),
    ("crop_oil", r"\b(MSO|METHYLATED SEED OIL|CROP OIL|COC|VEGETABLE OIL|MODIFIED SEED OIL|SEED OIL)\b"),
    ("drift_control", r"\b(DRIFT|DEPOSITION AID|INVERT|POLYACRYLAMIDE)\b"),
    ("defoamer", r"\b(DEFOAM|ANTIFOAM|ANTI[- ]?FOAM)\b"),
    ("water_conditioner", r"\b(WATER CONDITIONER|AMS|AMMONIUM SULFATE|BUFFER|ACIDIFIER|PH ?ADJUST)\b"),
    ("sticker", r"\b(STICKER|EXTENDER|SPREADER[- ]?STICKER)\b"),
    ("surfactant", r"\b(SURFACTANT|NON[- ]?IONIC|NIS|SPREADER|WETTING AGENT|ACTIVATOR|INDUCE|R[- ]?11|SPREAD)\b"),
    ("fertilizer", r"\b(UREA|NITROGEN|FERTILI[SZ]ER|UAN)\b"),
)
#: Spellings of methods, rodenticides, and words of baits.
METHODS = {"ground": "ground", "grnd": "ground", "g": "ground", "aircraft": "aerial", "air": "aerial", "aerial": "aerial", "helicopter": "aerial", "fixed wing": "aerial", "a": "aerial", "other": "other"}
RODENTICIDES = ("brodifacoum", "bromadiolone", "bromethalin", "chlorophacinone", "cholecalciferol", "difenacoum", "difethialone", "diphacinone", "strychnine", "warfarin", "zinc phosphide", "aluminum phosphide", "magnesium phosphide")
BAITS = r"(?i)\b(RODENT|GOPHER|MOLE|VOLE|RAT|MOUSE|SQUIRREL)\b.*\bBAIT|\bBAIT\b.*\b(RODENT|GOPHER|MOLE|VOLE|RAT|MOUSE|SQUIRREL)\b|\b(STRYCHNINE|ZINC PHOSPHIDE|GOPHER GETTER|PROZAP)\b"
CONFIDENCE = ("low", "medium", "high", "verified")
GRADES = (("A", 0.50), ("B", 0.30), ("C", 0.15), ("D", 0.0001))


def _first(text: Column, rules) -> Column:
    out = F.when(F.lit(False), "")
    for label, pattern in rules:
        out = out.when(text.rlike(pattern), label)
    return out


def site_category(code: Column, name: Column) -> Column:
    """struct(category, confidence): by the code's first five digits, else by words of the name."""
    codes = F.create_map(*(F.lit(x) for kv in SITE_CODES.items() for x in kv))
    known = F.try_element_at(codes, F.regexp_extract(code, r"^(\d{5})", 1))
    named = _first(F.upper(name), SITE_WORDS)
    return F.struct(F.coalesce(known, named, F.lit("unknown")).alias("category"), F.when(known.isNotNull(), "verified").when(named.isNotNull(), "high").otherwise("low").alias("confidence"))


def adjuvant_type(name: Column, registered: Column | None = None, has_ingredient: Column | None = None) -> Column:
    """Type of a tank additive, null for a pesticide. A product with an active ingredient never is one; one registered as such is 'other' if no word tells more."""
    kind = _first(F.upper(name), ADJUVANT_WORDS)
    if registered is not None:
        kind = F.coalesce(kind, F.when(registered, "other"))
    return kind if has_ingredient is None else F.when(~F.coalesce(has_ingredient, F.lit(False)), kind)


def method(value: Column) -> Column:
    t = F.trim(F.regexp_replace(F.lower(F.trim(value)), "[/,].*$", ""))
    table = F.create_map(*(F.lit(x) for kv in METHODS.items() for x in kv))
    return F.when(F.coalesce(value, F.lit("")) == "", "unknown").otherwise(F.coalesce(F.try_element_at(table, t), F.when(t == "", "unknown").otherwise("other")))


def is_rodenticide(ingredients: Column, product: Column) -> Column:
    names = F.transform(ingredients, lambda x: F.lower(F.trim(x)))
    return F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, RODENTICIDES))), F.lit(False)) | F.coalesce(product.rlike(BAITS), F.lit(False))


def confidence_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CONFIDENCE)), c)


def outcome(text: Column) -> Column:
    """Of an inspection. 'violation' anywhere tells before 'compliance' does, so "no violations" is a violation and "not in compliance" is in compliance."""
    t = F.lower(F.trim(text))
    return F.when(t.isNull() | (t == ""), "not_stated").when(t.contains("violation"), "violation").when(t.contains("compliance"), "in_compliance").otherwise("not_stated")


def grade(priority: Column, inspected: Column, records: Column) -> Column:
    """Letter of a year's inspection coverage; null where records weren't obtained or nothing was to inspect."""
    share = inspected / priority
    letter = F.when(F.lit(False), "")
    for name, least in GRADES:
        letter = letter.when(share >= least, name)
    return F.when(records.isin("obtained", "county_reports_none") & (priority > 0), letter.otherwise("F"))
