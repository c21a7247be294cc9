"""Company and person names reduced to keys."""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quadrat.functions import likeness
from quadrat.functions.sites import let

#: Legal forms, spellings of one stem, and words too common to tell names apart.
LEGAL = ("INC", "INCORPORATED", "LLC", "LLP", "LP", "LTD", "LIMITED", "CORP", "CORPORATION", "CO", "COMPANY", "PC", "PLLC", "TRUST", "THE")
STEMS = {
    "ASSOCIATES": "ASSOC", "ASSOCIATE": "ASSOC", "ASSOCS": "ASSOC", "ASSOCIATION": "ASSOC", "AND": "&", "SVCS": "SERVICES", "SVC": "SERVICES", "SERVICE": "SERVICES", "BROS": "BROTHERS", "MGMT": "MANAGEMENT",
    "MGT": "MANAGEMENT", "TIMBERLAND": "TIMBER", "TIMBERLANDS": "TIMBER", "PROPERTIES": "PROPERTY", "INVESTMENTS": "INVESTMENT", "ENTERPRISES": "ENTERPRISE", "FORESTRY": "FOREST", "HELICOPTERS": "HELICOPTER", "INTL": "INTERNATIONAL",
}
GENERIC = ("&", "ASSOC", "SERVICES", "GROUP", "HOLDINGS", "PARTNERS", "MANAGEMENT", "PROPERTY", "INVESTMENT", "ENTERPRISE", "FARMS", "RANCH", "RANCHES", "OF", "AT")
TITLES = ("MR", "MRS", "MS", "DR", "PROF")
SUFFIXES = ("JR", "SR", "II", "III", "IV", "V", "ESQ", "PHD", "RPF")
MATCH, REJECT = 0.88, 0.62
_ACCENTS = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


#: Signs up to Z, besides &.
_SIGNS = "".join(chr(i) for i in range(ord("!"), ord("Z")) if chr(i) != "&" and not chr(i).isalnum())


def strip_accents(text: Column) -> Column:
    """Latin letters without their accents; others stay."""
    return F.translate(text, _ACCENTS, _PLAIN)


def _in(values):
    return F.array(*map(F.lit, values))


def _words(name: Column) -> Column:
    """Upper-case words with blanks between: initials joined, & apart, hyphens and slashes as blanks."""
    # a translation costs a fraction of ``upper`` and of a class of many ranges, which are left what it doesn't know
    t = F.translate(F.trim(name), _ACCENTS + ascii_lowercase, _PLAIN.upper() + ascii_uppercase)
    t = F.replace(F.when(t.rlike("[^ -~]"), F.upper(t)).otherwise(t), F.lit("&"), F.lit(" & "))
    # a letter by itself moves up to the next one, over blanks and a dot, or over a dot alone if the next has one too
    t = F.regexp_replace(t, r"\b([A-Z])(?:\.?\s+|\.(?=[A-Z]\.))(?=[A-Z]\b)", "$1")
    return F.regexp_replace(F.translate(t, _SIGNS, " " * len(_SIGNS)), "[^ -Z]+", " ")


def _stemmed(words: Column) -> Column:
    stems = F.create_map(*(F.lit(x) for kv in STEMS.items() for x in kv))
    return F.transform(F.filter(F.split(words, " +"), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(stems, w), w))


def _lawful(words: Column) -> Column:
    """Stems without legal forms, unless nothing else is left, with blanks between."""
    every = _stemmed(words)
    kept = F.filter(every, lambda w: ~F.array_contains(_in(LEGAL), w))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(every), " ")


#: A word that ``company_key`` changes or leaves out; most names hold none, and go without arrays of their words.
_CHANGED = f"(^| )({'|'.join((*LEGAL, *STEMS))})( |$)"


def plain_key(name: Column) -> Column:
    """``company_key`` for columns of many rows: cheaper, but a longer expression, not to be named within others."""
    t = _words(name)
    made = F.when(t.rlike(_CHANGED), _lawful(t)).otherwise(F.trim(F.regexp_replace(t, " {2,}", " ")))
    return F.coalesce(F.regexp_replace(made, "( ?&)+$", ""), F.lit(""))


def tokens(name: Column) -> Column:
    """Upper-case words: initials joined, & apart, hyphens and slashes as blanks, stems."""
    t = F.replace(F.upper(F.trim(strip_accents(name))), F.lit("&"), F.lit(" & "))
    # a letter by itself moves up to the next one, over blanks and a dot, or over a dot alone if the next has one too
    t = F.regexp_replace(t, r"\b([A-Z])(?:\.?\s+|\.(?=[A-Z]\.))(?=[A-Z]\b)", "$1")
    t = F.regexp_replace(F.regexp_replace(t, "[-/]", " "), "[^A-Z0-9& ]", " ")
    stems = F.create_map(*(F.lit(x) for kv in STEMS.items() for x in kv))
    return F.transform(F.filter(F.split(t, " +"), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(stems, w), w))


def company_tokens(name: Column) -> Column:
    """Tokens without legal forms, unless nothing else is left, and without & at the end."""
    every = tokens(name)
    kept = F.filter(every, lambda w: ~F.array_contains(_in(LEGAL), w))
    kept = F.when(F.size(kept) > 0, kept).otherwise(every)
    return F.split(F.regexp_replace(F.array_join(kept, " "), "( ?&)+$", ""), " ")


def company_key(name: Column) -> Column:
    """'' for null and blank names."""
    return F.coalesce(F.array_join(company_tokens(name), " "), F.lit(""))


def core_tokens(key: Column) -> Column:
    """Tokens of a key that tell names apart; all if none does."""
    every = F.filter(F.split(key, " "), lambda w: w != "")
    core = F.filter(every, lambda w: ~F.array_contains(_in(GENERIC), w))
    return F.when(F.size(core) > 0, core).otherwise(every)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which no built-in gives; for pairs that the exact tiers leave."""
    known = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(None, index=a.index, dtype="float64")
    out[known] = likeness.ratios(a[known].tolist(), b[known].tolist())
    return out


# to the planner not deterministic, else a filter on a score computes it twice
sequence_ratio = sequence_ratio.asNondeterministic()


def company_sets(key: Column) -> Column:
    """What ``likeness_of`` takes of a company key: the key, its different words, and those that tell names apart. To be made once a key, not once a pair."""
    return F.struct(key.alias("key"), F.array_distinct(F.split(key, " ")).alias("words"), F.array_distinct(core_tokens(key)).alias("core"))


#: A word of a key that ``core_tokens`` leaves out.
_COMMON = f"(^| )({'|'.join(GENERIC)}|)( |$)"


def _sets(key: Column) -> Column:
    """``company_sets``, made with fewer arrays."""
    words = F.array_distinct(F.split(key, " "))
    return F.struct(key.alias("key"), words.alias("words"), F.when(key.rlike(_COMMON), F.array_distinct(core_tokens(key))).otherwise(words).alias("core"))


def shared_words(x: Column, y: Column) -> Column:
    """What the words of two keys' sets have in common."""
    n = lambda k: F.size(x[k]) + F.size(y[k])
    words, core = F.size(F.array_intersect(x["words"], y["words"])), F.size(F.array_intersect(x["core"], y["core"]))
    return F.struct(words.alias("words"), n("words").alias("of"), core.alias("core"), F.least(F.size(x["core"]), F.size(y["core"])).alias("least"), (F.get(x["core"], 0) == F.get(y["core"], 0)).alias("first"))


def _by_words(a: Column, b: Column, shared: Column, rest) -> Column:
    """Likeness of two keys by the exact tiers, then rest(Jaccard's likeness of their words)."""
    tiers = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(2 * shared["words"] == shared["of"], 0.97).when((shared["core"] == shared["least"]) & shared["first"], 0.93)
    return tiers.otherwise(rest(shared["words"] / (shared["of"] - shared["words"])))


def likeness_of(x: Column, y: Column) -> Column:
    """``company_score`` of two keys by their sets."""
    return _by_words(x["key"], y["key"], shared_words(x, y), lambda jaccard: 0.6 * jaccard + 0.4 * sequence_ratio(x["key"], y["key"]))


def likeness_by_words(a: Column, b: Column, least: float) -> Column:
    """``company_score`` of two keys where their words tell it. Where they tell only that it stays below ``least``, to four places, however alike the letters are, something below that; else null."""
    rest = lambda jaccard: F.when(0.6 * jaccard + 0.4 < least - 1e-4, 0.6 * jaccard)
    # bound by ``let``, sets and sizes are made once, and stay out of generated code, which would grow too long to be compiled
    return let(F.struct(_sets(a).alias("a"), _sets(b).alias("b")), lambda s: let(shared_words(s["a"], s["b"]), lambda m: _by_words(s["a"]["key"], s["b"]["key"], m, rest)))


def company_score(a: Column, b: Column) -> Column:
    """Similarity of two company keys: 1 equal, .97 same words, .93 core words of one within the other's and the first alike; else .6 of Jaccard and .4 of sequence similarity. 0 if either is empty."""
    return likeness_of(company_sets(a), company_sets(b))


def _in_common(x: list[list[str]], y: list[list[str]]) -> np.ndarray:
    """How many words each of x shares with each of y."""
    out, having = np.zeros((len(x), len(y)), np.int32), ({}, {})
    for side, texts in zip(having, (x, y), strict=True):
        for i, words in enumerate(texts):
            for w in words:
                side.setdefault(w, []).append(i)
    for w in having[0].keys() & having[1].keys():
        out[np.ix_(having[0][w], having[1][w])] += 1
    return out


def limits_reached(x: Sequence[str], y: Sequence[str], asked: np.ndarray, limits: tuple[float, ...]) -> np.ndarray:
    """How many of the limits ``company_score`` reaches for each key of x (a row) with each of y, where asked; 0 elsewhere. For two lists of different keys: letters are compared only where words leave it open, and only until it is settled."""
    if not asked.any():
        return np.zeros(asked.shape, np.int8)
    reached = lambda score: sum((score >= t).astype(np.int8) for t in limits)
    words = [[list(dict.fromkeys(k.split(" "))) for k in keys] for keys in (x, y)]
    core = [[[w for w in ws if w and w not in GENERIC] or [w for w in ws if w] for ws in side] for side in words]
    size = lambda of: [np.array([len(ws) for ws in side], np.int32) for side in of]
    ids, firsts = {}, {}
    key = [np.array([ids.setdefault(k, len(ids)) if k else -1 for k in keys]) for keys in (x, y)]
    first = [np.array([firsts.setdefault(ws[0], len(firsts)) if ws else -1 - side for ws in keys]) for side, keys in enumerate(core)]
    (nx, ny), (mx, my) = size(words), size(core)
    shared, of = _in_common(*words), nx[:, None] + ny
    within = (_in_common(*core) == np.minimum(mx[:, None], my)) & (first[0][:, None] == first[1])
    jaccard = 0.6 * (shared / (of - shared))
    blank, same = (key[0] < 0)[:, None] | (key[1] < 0), key[0][:, None] == key[1]
    exact = np.select([blank, same, 2 * shared == of, within], [0.0, 1.0, 0.97, 0.93], np.nan)
    out = np.where(asked, reached(np.where(np.isnan(exact), jaccard, exact)), np.int8(0))
    ia, ib = np.nonzero(asked & np.isnan(exact) & (reached(jaccard + 0.4) > out))
    n = [np.array([len(k) for k in keys], np.int64) for keys in (x, y)]
    short = n[1] <= likeness.SHORT
    lists = likeness.Lists(x, [k if s else "" for k, s in zip(y, short, strict=True)])
    for at in range(0, len(ia), likeness.PAIRS):
        i, j = ia[at : at + likeness.PAIRS], ib[at : at + likeness.PAIRS]
        i, j, long = i[short[j]], j[short[j]], (i[~short[j]], j[~short[j]])
        most, letters = jaccard[i, j], n[0][i] + n[1][j]
        of_matched = lambda m: reached(most + 0.4 * (2.0 * m / letters))  # noqa: B023, E731
        out[i, j] = of_matched(lists.matched(i, j, lambda m, rest: of_matched(m) == of_matched(m + rest)))  # noqa: B023
        out[long] = reached(jaccard[long] + 0.4 * likeness.ratios([x[k] for k in long[0]], [y[k] for k in long[1]]))
    return out


def person_key(name: Column) -> Column:
    """'SURNAME FIRST MIDDLE' of either name order, without titles and suffixes."""
    clean = F.regexp_replace(F.upper(strip_accents(F.trim(name))), "[^A-Z, ]", "")
    drop = _in((*TITLES, *SUFFIXES))
    words = lambda c: F.filter(F.split(c, "[ ,]+"), lambda w: (w != "") & ~F.array_contains(drop, w))
    head, tail = words(F.substring_index(clean, ",", 1)), words(F.regexp_replace(clean, "^[^,]*,?", ""))
    plain = words(clean)
    ordered = F.concat(F.slice(plain, -1, 1), F.slice(plain, 1, F.greatest(F.size(plain) - 1, F.lit(0))))
    comma = F.contains(clean, F.lit(",")) & (F.size(tail) > 0)
    return F.coalesce(F.when(F.size(plain) == 0, "").when(comma, F.array_join(F.concat(head, tail), " ")).otherwise(F.array_join(ordered, " ")), F.lit(""))


def person_parts(name: Column) -> Column:
    """struct(given, middle, family, suffix) of either name order, '' for what there is none of. 'Compton, Jr' is a suffix after a comma; a single name is a family's."""
    text = F.regexp_replace(F.upper(strip_accents(F.trim(F.coalesce(name, F.lit(""))))), "[^A-Z, ]", " ")
    words = lambda c: F.filter(F.split(c, "[ ,]+"), lambda w: w != "")
    head, tail = words(F.substring_index(text, ",", 1)), words(F.regexp_replace(text, "^[^,]*,?", ""))
    after = (F.size(tail) == 1) & F.array_contains(_in(SUFFIXES), F.get(tail, 0))
    ordered = F.when(after, F.concat(head, tail)).otherwise(F.concat(tail, head))

    def made(every: Column) -> Column:
        ends = F.filter(every, lambda w: F.array_contains(_in(SUFFIXES), w))
        suffix = F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(""))
        return let(F.filter(every, lambda w: ~F.array_contains(_in((*TITLES, *SUFFIXES)), w)), lambda t: _named(t, suffix))

    return let(ordered, made)


def _named(t: Column, suffix: Column) -> Column:
    given = F.when(F.size(t) > 1, F.get(t, 0)).otherwise("")
    middle = F.when(F.size(t) > 2, F.array_join(F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0))), " ")).otherwise("")
    return F.struct(given.alias("given"), middle.alias("middle"), F.coalesce(F.get(t, F.size(t) - 1), F.lit("")).alias("family"), suffix.alias("suffix"))


def person_match_key(name: Column) -> Column:
    """'FAMILY|GIVEN', without middle names, which sources give or leave out."""
    return let(person_parts(name), lambda p: F.when(p["given"] == "", p["family"]).otherwise(F.concat(p["family"], F.lit("|"), p["given"])))


def compare_people(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with score and matched of two people's names: a match is a candidate, never a decision.

    Families that are less than .9 alike tell people apart (the score is then
    their likeness), else: .95, a match, for equal given names; .75 if their
    middle names differ; .8 if one given name begins the other; .5 otherwise; 0
    if either can't be parsed. Only different families go to Python.
    """
    x = pairs.withColumns({"_pa": person_parts(F.col(a)), "_pb": person_parts(F.col(b))})
    part = lambda side, k: F.col(f"_p{side}.{k}")
    fa, fb, ga, gb, ma, mb = (part(s, k) for k in ("family", "given", "middle") for s in "ab")
    unlike = x.where((fa != "") & (fb != "") & (fa != fb)).select(fa.alias("_fa"), fb.alias("_fb")).distinct().withColumn("_r", sequence_ratio(F.col("_fa"), F.col("_fb")))
    x = x.join(unlike, (fa == F.col("_fa")) & (fb == F.col("_fb")), "left")
    both, begins = (ga != "") & (gb != ""), ga.startswith(gb) | gb.startswith(ga)
    score = (
        F.when((fa == "") | (fb == ""), 0.0).when((fa != fb) & (F.col("_r") < 0.9), F.round("_r", 4)).when(both & (ga == gb) & (ma != "") & (mb != "") & (ma != mb), 0.75).when(both & (ga == gb), 0.95).when(both & begins, 0.8).otherwise(0.5)
    )
    return x.withColumn("score", score).withColumn("matched", F.col("score") == 0.95).drop("_pa", "_pb", "_fa", "_fb", "_r")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
