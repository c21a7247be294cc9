"""Who may see what: dispositions of facts, enforcement wording, relationships, land managers, access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of facts and what becomes of them.
PUBLIC = ("business_name", "business_address", "business_phone", "business_email", "website", "license_number", "job_title", "employer", "parcel_owner_name", "parcel_situs_address")
RESTRICTED = ("personal_address", "personal_phone", "personal_email", "social_media_photo", "date_of_birth")
CONSUMER_MAIL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "me.com", "comcast.net", "msn.com", "live.com", "proton.me")
SOCIAL_HOSTS = ("facebook.com", "fbcdn.net", "instagram.com", "cdninstagram.com", "twitter.com", "x.com", "twimg.com", "tiktok.com", "pinterest.")
GENERAL_MAILBOX = r"(?i)^(info|office|contact|sales|admin|support|hello|enquiries)@"
#: Agency codes, their class and label.
AGENCIES = {
    "USFS": ("national_forest", "National forest"), "FS": ("national_forest", "National forest"), "BLM": ("blm", "Bureau of Land Management"), "NPS": ("federal", "National Park Service"), "FWS": ("federal", "U.S. Fish & Wildlife Service"),
    "BOR": ("federal", "Bureau of Reclamation"), "DOD": ("federal", "Department of Defense"), "BIA": ("tribal", "Tribal land"), "ST": ("state", "State land"), "STATE": ("state", "State land"), "LG": ("local", "Local government"),
    "PVT": ("private", "Private land"), "UND": ("not_public", "Not federal or state land"), "UNK": ("not_public", "Not federal or state land"),
}
#: Relationships, their wording, and what they are from the other side.
RELATIONS = {
    "owned_by": ("owned by", "owns"), "owns": ("owns", "owned_by"), "managed_by": ("managed by", "manages"), "manages": ("manages", "managed_by"), "acquired_by": ("acquired by", "owns"), "dba": ("trading as", "dba"), "affiliate": ("affiliated with", "affiliate"), "branch_of": ("a licensed branch of", "owns"),
}
#: Relationships that give control, and how sure a source is.
CONTROL = ("owned_by", "owns", "acquired_by", "branch_of")
SOURCE_CONFIDENCE = {"business_registry": "verified", "licensing_record": "verified", "company_statement": "high", "published_report": "medium", "manual": "manual"}
#: Kinds and stages of enforcement with their wording, and the stages that clear or uphold.
ACTIONS = {"nopa": "Notice of Proposed Action", "violation": "Violation", "warning": "Warning", "civil_penalty": "Civil penalty", "license_action": "Licence action", "compliance_action": "Compliance action"}
STAGES = {"proposed": "Proposed — not decided", "contested": "Contested by the respondent", "final": "Final", "settled": "Settled", "dismissed": "Dismissed", "withdrawn": "Withdrawn by the agency", "overturned": "Overturned on appeal", "unknown": "Outcome not known"}
CLEARED, UPHELD, STRONG_BASIS = ("dismissed", "withdrawn", "overturned"), ("final", "settled"), ("license_number", "exact_registered_name", "manual")


def _map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def email_disposition(address: Column, of_business: Column) -> Column:
    domain = F.when(address.contains("@"), F.lower(F.trim(F.substring_index(address, "@", -1))))
    return F.when(domain.isin(*CONSUMER_MAIL) | domain.isNull() | (domain == ""), "restricted").when(address.rlike(GENERAL_MAILBOX) | of_business, "public").otherwise("review")


def photo_disposition(url: Column) -> Column:
    low = F.lower(url)
    social = F.lit(False)
    for host in SOCIAL_HOSTS:
        social = social | low.contains(host)
    return F.when(social, "restricted").otherwise("review")


def fact_disposition(kind: Column, value: Column, of_business: Column) -> Column:
    return (
        F.when(kind == "business_email", email_disposition(value, of_business)).when(kind.isin("professional_photo", "social_media_photo"), photo_disposition(value)).when((kind == "owner_mailing_address") & ~of_business, "restricted")
        .when(kind.isin(*PUBLIC), "public").when(kind.isin(*RESTRICTED), "restricted").otherwise("review")
    )


def land_manager(code: Column, unit: Column) -> Column:
    """struct(category, label, unit) of an agency's code; an unknown code is said to be one."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    category = F.when(c == "", "not_public").otherwise(F.coalesce(F.try_element_at(_map({k: v[0] for k, v in AGENCIES.items()}), c), F.lit("other")))
    label = F.when(c == "", AGENCIES["UND"][1]).otherwise(F.coalesce(F.try_element_at(_map({k: v[1] for k, v in AGENCIES.items()}), c), F.concat(F.lit("Managed by "), c)))
    named = F.when((category == "national_forest") & ~F.lower(unit).contains("forest"), F.concat(unit, F.lit(" National Forest"))).otherwise(unit)
    return F.struct(category.alias("category"), label.alias("label"), F.when(category != "not_public", named).alias("unit"))


def action_type(text: Column) -> Column:
    t = F.upper(text)
    has = lambda *ws: t.rlike("|".join(ws))
    return F.when(has("NOTICE OF PROPOSED ACTION", "PROPOSES TO FINE"), "nopa").when(has("SUSPEN", "REVOK"), "license_action").when(has("CIVIL PENALTY"), "civil_penalty").when(has("WARNING"), "warning").when(has("VIOLATION"), "violation").otherwise("compliance_action")


def action_stage(text: Column) -> Column:
    """Cleared wording tells first, then decisions unless a fine is only proposed, then proposals."""
    t = F.upper(text)
    proposes = t.contains("PROPOSES TO FINE")
    return (
        F.when(t.rlike("DISMISSED|WITHDRAWN|NO VIOLATION WAS FOUND|CASE CLOSED WITHOUT"), "dismissed").when(t.rlike("FINAL DECISION|FINAL ORDER|HEARING OFFICER'S DECISION|IS HEREBY ORDERED|PENALTY PAID") & ~proposes, "final")
        .when(proposes | t.rlike("NOTICE OF PROPOSED ACTION|PROPOSED PENALTY|RIGHT TO A HEARING"), "proposed").otherwise("unknown")
    )


def action_headline(kind: Column, stage: Column) -> Column:
    label, how = F.try_element_at(_map(ACTIONS), kind), F.lower(F.try_element_at(_map(STAGES), stage))
    alleged = (kind == "nopa") & ~stage.isin(*UPHELD, *CLEARED)
    return F.concat(label, F.when(alleged, F.lit(" (alleged)")).otherwise(""), F.lit(" — "), how)


def penalty_shown(final: Column, proposed: Column, stage: Column) -> Column:
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    return F.when(final.isNotNull(), money(final)).when(proposed.isNotNull() & ~stage.isin(*CLEARED), F.concat(money(proposed), F.lit(" proposed")))


def action_review(basis: Column, agency: Column, day: Column) -> Column:
    """Why an action may not be published; null if it may."""
    return (
        F.when(basis.isNull(), "enforcement_unmatched_respondent").when(~basis.isin(*STRONG_BASIS), "enforcement_weak_match").when(F.coalesce(agency, F.lit("")) == "", "enforcement_missing_agency").when(day.isNull(), "enforcement_missing_date")
    )


def relation(kind: Column) -> Column:
    """struct(label, inverse, control)."""
    return F.struct(F.try_element_at(_map({k: v[0] for k, v in RELATIONS.items()}), kind).alias("label"), F.try_element_at(_map({k: v[1] for k, v in RELATIONS.items()}), kind).alias("inverse"), kind.isin(*CONTROL).alias("control"))


def relation_confidence(source: Column) -> Column:
    return F.try_element_at(_map(SOURCE_CONFIDENCE), source)


def in_coverage(day: Column, since: str = "2020-01-01") -> Column:
    return F.coalesce(day >= F.lit(since).cast("date"), F.lit(False))
