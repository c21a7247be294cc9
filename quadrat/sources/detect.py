"""Which reader a file is for, judged by what is in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Profiles in the order in which ties are broken, with the suffixes they take.
SUFFIXES = {
    "tabular_use_records": (".csv", ".tsv", ".txt", ".xlsx", ".xlsm", ".xls"),
    "restricted_materials_permit": (".docx", ".pdf", ".txt"),
    "investigation_report": (".pdf", ".docx", ".txt"),
    "enforcement_action": (".pdf", ".docx", ".txt"),
    "pur_form": (".pdf", ".docx", ".txt"),
}
#: What a text must reach to be recognised, what of it is looked at, and a table's score that makes texts needless.
LEAST, SAMPLE, SURE = 0.3, 8000, 0.7
#: Points for wordings, in upper case.
PERMIT = (("RESTRICTED MATERIALS PERMIT", 0.6), ("SITES LIST", 0.2), ("CONTACT LIST", 0.1), ("PESTICIDES LIST", 0.1))
INVESTIGATION = (("BASIS FOR DETERMINATION", 0.2), ("COMPLAINT DATE", 0.15), ("LABORATORY RESULTS", 0.1))
ENFORCEMENT = (("NOTICE OF PROPOSED ACTION", 0.7), ("NATURE OF VIOLATION", 0.15), ("CIVIL PENALTY", 0.1), ("RIGHT TO REQUEST HEARING", 0.1), ("DECISION AND ORDER", 0.4))
FORM = ("PESTICIDE USE REPORT", "NOTICE OF INTENT", "SITE IDENTIFICATION NUMBER", "PERMITTEE/PERMIT OPERATOR")


def _points(upper: Column, wordings: tuple) -> Column:
    total = F.lit(0.0)
    for words, points in wordings:
        total = total + F.when(F.contains(upper, F.lit(words)), points).otherwise(0.0)
    return total


def text_scores(text: Column, form: tuple[str, ...] = FORM) -> dict[str, Column]:
    """Score of each profile of texts, from the text's first 8,000 characters."""
    upper = F.upper(F.left(F.coalesce(text, F.lit("")), F.lit(SAMPLE)))
    has = lambda w: F.contains(upper, F.lit(w))
    case = F.when(upper.rlike(r"\bCASE ID:\s*INV-"), 0.6).otherwise(0.0)
    hits = _points(upper, tuple((w, 1.0) for w in form))
    capped = lambda c: F.round(F.least(c, F.lit(1.0)), 6)
    return {
        "restricted_materials_permit": capped(_points(upper, PERMIT)),
        "investigation_report": capped(case + _points(upper, INVESTIGATION)),
        "enforcement_action": capped(_points(upper, ENFORCEMENT)),
        "pur_form": F.when((hits == 0) | (has("RESTRICTED MATERIALS PERMIT") & has("SITES LIST")), 0.0).otherwise(capped(0.35 + 0.2 * hits)),
    }


def table_score(known_labels: Column) -> Column:
    """Of a table whose header has so many known labels; 0 without a header."""
    return F.when(known_labels > 0, F.round(F.least(F.lit(1.0), 0.4 + 0.05 * known_labels), 6)).otherwise(0.0)


def detected(name: Column, text: Column, known_labels: Column) -> Column:
    """struct(profile, score): the best profile that takes the file's suffix, or no profile below the least score. A table that is sure keeps texts from being judged."""
    suffix = F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))
    scores = {"tabular_use_records": table_score(known_labels)} | text_scores(text)
    scores = {p: F.when(suffix.isin(*SUFFIXES[p]), s).otherwise(0.0) for p, s in scores.items()}
    ranked = [F.struct(s.alias("score"), F.lit(-i).alias("i"), F.lit(p).alias("profile")) for i, (p, s) in enumerate(scores.items())]
    best = F.when(scores["tabular_use_records"] >= SURE, ranked[0]).otherwise(F.array_max(F.array(*ranked)))
    return F.struct(F.when(best["score"] >= LEAST, best["profile"]).alias("profile"), best["score"].alias("score"))
