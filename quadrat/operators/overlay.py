"""Changes that people decide, kept as tables beside immutable records and joined last; each can be taken back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.names import company_key, company_score


def assigned(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """labels (id, component) with the cluster that a person's latest decision (id, cluster, decided) gives a record, if any: merges and splits alike."""
    last = decisions.groupBy("id").agg(F.max_by("cluster", "decided").alias("manual"))
    return labels.join(last, "id", "left").select("id", F.coalesce("manual", "component").alias("component"))


def published(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """Clusters whose publication was decided: ready ones become published, others stay."""
    chosen = decisions.select("id").distinct().withColumn("_p", F.lit(True))
    return clusters.join(chosen, "id", "left").withColumn("status", F.when(F.col("_p") & (F.col("status") == "ready"), "published").otherwise(F.col("status"))).drop("_p")


def audit(before: DataFrame, after: DataFrame, key: str, field: str) -> DataFrame:
    """(key, old, new) of rows whose field changed, nulls told apart."""
    a, b = before.select(key, F.col(field).alias("old")), after.select(key, F.col(field).alias("new"))
    return a.join(b, key, "full").where(~F.col("old").eqNullSafe(F.col("new")))


def continued(lines: DataFrame, *filing: str) -> DataFrame:
    """Product lines of records that continue one filing, each different line once, in the order of import."""
    key = (*filing, "product", "quantity", "unit")
    rest = [c for c in lines.columns if c not in key]
    first = lines.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("import_seq")).alias("_x"))
    return first.select(*(F.col(c) if c in key else F.col(f"_x.{c}").alias(c) for c in lines.columns))


def select_parcels(candidates: DataFrame, strong: float = 0.9, weak: float = 0.7) -> DataFrame:
    """Per application (id, owner, landowner, parcel_owner, apn; no apn if none): outcome, selected parcels and why it needs a review. The better of both names counts."""
    key = company_key(F.col("parcel_owner"))
    score = F.greatest(company_score(company_key(F.col("owner")), key), company_score(company_key(F.col("landowner")), key))
    per = candidates.withColumn("score", F.coalesce(score, F.lit(0.0))).groupBy("id").agg(
        F.count("apn").alias("candidates"), F.count_if(F.col("score") >= strong).alias("strong"), F.count_if((F.col("score") >= weak) & (F.col("score") < strong)).alias("weak"), F.array_sort(F.collect_set(F.when(F.col("score") >= strong, F.col("apn")))).alias("selected"), F.bool_or(F.coalesce("owner", "landowner").isNotNull()).alias("named")
    )
    outcome = F.when(F.col("candidates") == 0, "no_candidates").when(~F.col("named"), "needs_review").when(F.col("strong") > 0, "matched").otherwise("needs_review")
    reason = F.when(F.col("candidates") == 0, "no_parcel_candidates").when(~F.col("named"), "missing_owner").when(F.col("strong") > 0, None).when(F.col("weak") > 0, "ambiguous_parcel").otherwise("no_parcel_owner_match")
    return per.select("id", outcome.alias("outcome"), F.when(outcome == "matched", F.col("selected")).otherwise(F.array().cast("array<string>")).alias("selected"), reason.alias("review_reason"))


def select_parcels_of_area(applications: DataFrame, parcels: DataFrame, strong: float = 0.9, weak: float = 0.7) -> DataFrame:
    """``select_parcels`` of applications (id, area, owner, landowner) among all parcels (area, parcel_owner, apn) of their areas.

    Names of no common word score .4 at most, so only different keys of an area
    that share a word are compared, each pair once, and areas aren't multiplied
    out. ``weak`` must be above .4.
    """
    assert weak > 0.4
    known = parcels.where("apn is not null").withColumn("key", company_key(F.col("parcel_owner")))
    per_area = known.groupBy("area").agg(F.count("*").alias("n"))
    named = applications.withColumn("name", F.explode(F.array("owner", "landowner"))).withColumn("mine", company_key(F.col("name"))).where("mine <> ''").select("id", "area", "mine").distinct()
    words = lambda rows, key: rows.select("area", F.col(key)).distinct().withColumn("word", F.explode(F.array_distinct(F.split(key, " ")))).where("word <> ''")
    pairs = words(named, "mine").join(words(known, "key"), ["area", "word"]).select("area", "mine", "key").distinct()
    near = pairs.withColumn("score", company_score(F.col("mine"), F.col("key"))).where(F.col("score") >= weak)
    found = named.join(near, ["area", "mine"]).join(known.select("area", "key", "apn"), ["area", "key"]).groupBy("id").agg(F.max("score").alias("best"), F.array_sort(F.collect_set(F.when(F.col("score") >= strong, F.col("apn")))).alias("selected"))
    per = applications.join(per_area, "area", "left").groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.bool_or(F.coalesce("owner", "landowner").isNotNull()).alias("named")).join(found, "id", "left")
    outcome = F.when(F.col("n") == 0, "no_candidates").when(F.col("named") & (F.col("best") >= strong), "matched").otherwise("needs_review")
    reason = F.when(F.col("n") == 0, "no_parcel_candidates").when(~F.col("named"), "missing_owner").when(F.col("best") >= strong, None).when(F.col("best") >= weak, "ambiguous_parcel").otherwise("no_parcel_owner_match")
    return per.select("id", outcome.alias("outcome"), F.when(outcome == "matched", F.col("selected")).otherwise(F.array().cast("array<string>")).alias("selected"), reason.alias("review_reason"))


def project_name(plans: DataFrame) -> DataFrame:
    """Per application (id, owner, plan, name, landowner): the name of the only named plan of its owner, else none and why."""
    mine = F.col("name").isNotNull() & (company_score(company_key(F.col("owner")), company_key(F.col("landowner"))) >= 0.88)
    per = plans.withColumn("_m", F.coalesce(mine, F.lit(False))).groupBy("id").agg(F.count_if("_m").alias("own"), F.count("name").alias("named"), F.max(F.when(F.col("_m"), F.col("name"))).alias("best"))
    reason = F.when(F.col("own") > 1, "multiple_possible_projects").when((F.col("own") == 0) & (F.col("named") > 0), "project_owner_mismatch")
    return per.select("id", F.when(F.col("own") == 1, F.col("best")).alias("project"), F.when(F.col("own") == 1, "high").when(F.col("own") > 1, "medium").otherwise("low").alias("confidence"), reason.alias("review_reason"))
