"""Businesses, permits and enforcement actions: who is behind an application, joined by normalised names and by permit numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.names import company_key
from quadrat.functions.policy import CLEARED, UPHELD, action_review

#: States in which a business's contact details may be shown, and those that aren't looked up again.
CONFIRMED, DECIDED = ("auto_verified", "approved"), ("approved", "rejected")
RECHECK_DAYS = 90


def company_names(*sources: DataFrame) -> DataFrame:
    """(name_key, name, business_type, license) of sources (name, business_type, license, seq), each business once.

    Sources come in order of precedence: the first that names a business gives
    its name; type and licence are the first that aren't null. Blank names are
    no businesses.
    """
    rows = None
    for i, s in enumerate(sources):
        s = s.select(company_key(F.col("name")).alias("name_key"), "name", "business_type", "license", F.struct(F.lit(i).alias("i"), F.col("seq")).alias("at")).where("name_key <> ''")
        rows = s if rows is None else rows.unionByName(s)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return rows.groupBy("name_key").agg(first("name"), first("business_type"), first("license"))


def shown_company(rows: DataFrame, name: str, companies: DataFrame) -> DataFrame:
    """rows with company_name, website, phone and email of the business of that name. Contact details only of confirmed ones; an unknown name stands for itself."""
    known = companies.select("name_key", F.col("name").alias("_name"), *(F.when(F.col("state").isin(*CONFIRMED), F.col(c)).alias(c) for c in ("website", "phone", "email")))
    both = rows.withColumn("name_key", company_key(F.col(name))).join(known, "name_key", "left")
    return both.withColumn("company_name", F.coalesce("_name", name)).drop("_name", "name_key")


def permit_keys(permit_number: Column, operator_id: Column) -> Column:
    """What may stand for a permit: its number, each end of it after a hyphen, and its operator's number."""
    parts = F.split(permit_number, "-")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-"))
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(ends, F.array().cast("array<string>")), F.array(operator_id))))


def matching_permits(applications: DataFrame, permits: DataFrame) -> DataFrame:
    """(id, permit_number, in_force) of applications (id, number, day) and permits (permit_number, operator_id, valid_from, issued_on, expires_on).

    A permit matches by its number, by the end of it after a hyphen, or by its
    operator's number: an equi-join on these keys. Of an application's permits
    those in force on its day stay, or all if none is; a permit without dates is
    always in force.
    """
    keyed = permits.select("*", F.explode(permit_keys(F.col("permit_number"), F.col("operator_id"))).alias("number"))
    found = applications.join(keyed, "number").select("id", "day", "permit_number", "valid_from", "issued_on", "expires_on").distinct()
    since, until = F.coalesce("valid_from", "issued_on", F.lit("0001-01-01").cast("date")), F.coalesce("expires_on", F.lit("9999-12-31").cast("date"))
    found = found.withColumn("in_force", F.coalesce((since <= F.col("day")) & (F.col("day") <= until), F.lit(False)))
    any_ = F.max("in_force").over(Window.partitionBy("id"))
    return found.withColumn("_any", any_).where(F.col("in_force") | ~F.col("_any")).select("id", "permit_number", "in_force")


def due_for_check(companies: DataFrame, today: Column) -> DataFrame:
    """Businesses to look up again: not decided by a person, and never checked or not for ninety days."""
    return companies.where(~F.col("state").isin(*DECIDED) & (F.col("checked_at").isNull() | (F.col("checked_at") < F.date_sub(today, RECHECK_DAYS))))


def enforcement_counts(actions: DataFrame, by: str) -> DataFrame:
    """Per ``by``: published actions, those upheld, not yet decided and cleared. An action is published if nothing speaks against it (basis, agency, day)."""
    shown = actions.where(action_review(F.col("basis"), F.col("agency"), F.col("day")).isNull())
    return shown.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("stage").isin(*UPHELD)).alias("upheld"), F.count_if(F.col("stage").isin("proposed", "contested", "unknown")).alias("pending"), F.count_if(F.col("stage").isin(*CLEARED)).alias("cleared"))
