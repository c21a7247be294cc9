"""Queries of businesses, permits, intake and locations, with the SQL that checks them; registered beside those of ``catalogue.py``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import sites
from quadrat.operators import geo, ingest, parties
from quadrat.plans.catalogue import on
from quadrat.plans.domain import xsum

_NONE = ", x AS (SELECT 1) "


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _pick(number: Column, *values) -> Column:
    """One of the values, by a number that is taken modulo their count."""
    return F.get(F.array(*(F.lit(v) for v in values)), F.pmod(number, F.lit(len(values))).cast("int"))


# businesses


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


@on("company_directory", """, named AS (
  SELECT 'CUSTOMER ' || substr(c_name, 10) AS k, c_name AS name, 'operator' AS kind, NULL AS licence, 0 AS i, c_custkey AS seq FROM customer
  UNION ALL SELECT 'SUPPLIER ' || substr(s_name, 10), s_name, 'applicator', 'L' || s_suppkey, 1, s_suppkey FROM supplier
  UNION ALL SELECT 'CUSTOMER ' || substr(c_name, 10), lower(replace(c_name, '#', ' ')) || ', Inc.', 'landowner', 'C' || c_custkey, 2, c_custkey FROM customer
  UNION ALL SELECT 'SUPPLIER ' || substr(s_name, 10) || ' HELICOPTER', 'The ' || s_name || ' Helicopters LLC', NULL, NULL, 2, s_suppkey FROM supplier)
SELECT k AS name_key, arg_min(name, (i, seq)) AS name, arg_min(kind, (i, seq)) FILTER (kind IS NOT NULL) AS business_type, arg_min(licence, (i, seq)) FILTER (licence IS NOT NULL) AS license FROM named GROUP BY k""")
def _(d):
    c, s = d.table("customer"), d.table("supplier")
    operators = c.select(F.col("c_name").alias("name"), F.lit("operator").alias("business_type"), _null().alias("license"), F.col("c_custkey").alias("seq"))
    applicators = s.select(F.col("s_name").alias("name"), F.lit("applicator").alias("business_type"), _text("L", F.col("s_suppkey").cast("string")).alias("license"), F.col("s_suppkey").alias("seq"))
    owners = c.select(_text(F.lower(F.translate("c_name", "#", " ")), ", Inc.").alias("name"), F.lit("landowner").alias("business_type"), _text("C", F.col("c_custkey").cast("string")).alias("license"), F.col("c_custkey").alias("seq"))
    pilots = s.select(_text("The ", F.col("s_name"), " Helicopters LLC").alias("name"), _null().alias("business_type"), _null().alias("license"), F.col("s_suppkey").alias("seq"))
    return parties.company_names(operators, applicators, owners.unionByName(pilots))


def _companies(d) -> DataFrame:
    k = F.col("c_custkey")
    checked = F.when(k % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 200).cast("int")))
    return d.table("customer").select(_text("CUSTOMER ", F.substring("c_name", 10, 20)).alias("name_key"), F.col("c_name").alias("name"), _pick(k, "auto_verified", "approved", "rejected", "pending", "none").alias("state"), _text("https://c", k.cast("string")).alias("website"), _text("p", k.cast("string")).alias("phone"), _null().alias("email"), checked.alias("checked_at"))


@on("company_contacts", _NONE + """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE 'Nobody ' || o_orderkey % 9 END AS company_name,
  CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 5 IN (0, 1) THEN 'https://c' || o_custkey END AS website, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 5 IN (0, 1) THEN 'p' || o_custkey END AS phone FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(d):
    name = F.when(F.col("id") % 2 == 0, _text(F.lower("operator"), " Co.")).otherwise(_text("Nobody ", (F.col("id") % 9).cast("string")))
    return parties.shown_company(d.apps.select("id", name.alias("who")), "who", _companies(d)).select("id", "company_name", "website", "phone")


@on("companies_due", _NONE + "SELECT c_name AS name FROM customer WHERE c_custkey % 5 NOT IN (1, 2) AND (c_custkey % 3 = 0 OR DATE '2024-01-01' + (c_custkey % 200)::INT < DATE '2024-07-01' - 90)")
def _(d):
    return parties.due_for_check(_companies(d), F.lit("2024-07-01").cast("date")).select("name")


_PERMITS = """permits AS (SELECT c_nationkey || '-' || y || '-' || c_custkey AS permit_number, CASE WHEN c_custkey % 7 = 0 THEN 'op' || c_custkey END AS operator_id, CASE WHEN c_custkey % 4 <> 0 THEN make_date(y, 1, 1) END AS valid_from,
  make_date(y, 6, 1) AS issued_on, CASE WHEN c_custkey % 5 <> 0 THEN make_date(y + 1, 12, 31) END AS expires_on FROM customer, (VALUES (1993), (1995), (1997)) t(y)),
asked AS (SELECT id, start AS day, CASE id % 3 WHEN 0 THEN operator_id::VARCHAR WHEN 1 THEN 'op' || operator_id ELSE '1995-' || operator_id END AS number FROM apps),
met AS (SELECT DISTINCT id, permit_number, coalesce(valid_from, issued_on, DATE '0001-01-01') <= day AND day <= coalesce(expires_on, DATE '9999-12-31') AS in_force FROM asked JOIN permits ON number = permit_number OR ends_with(permit_number, '-' || number) OR number = permits.operator_id)"""


@on("matching_permits", f", {_PERMITS} SELECT * FROM met QUALIFY in_force OR NOT bool_or(in_force) OVER (PARTITION BY id)")
def _(d):
    k, y = F.col("c_custkey"), F.col("y")
    rows = d.table("customer").withColumn("y", F.explode(F.array(*map(F.lit, (1993, 1995, 1997)))))
    permits = rows.select(F.concat_ws("-", "c_nationkey", "y", "c_custkey").alias("permit_number"), F.when(k % 7 == 0, _text("op", k.cast("string"))).alias("operator_id"), F.when(k % 4 != 0, F.make_date(y, F.lit(1), F.lit(1))).alias("valid_from"), F.make_date(y, F.lit(6), F.lit(1)).alias("issued_on"), F.when(k % 5 != 0, F.make_date(y + 1, F.lit(12), F.lit(31))).alias("expires_on"))
    op = F.col("operator_id").cast("string")
    number = F.when(F.col("id") % 3 == 0, op).when(F.col("id") % 3 == 1, _text("op", op)).otherwise(_text("1995-", op))
    return parties.matching_permits(d.apps.select("id", F.col("start").alias("day"), number.alias("number")), permits)


@on("enforcement_counts", _NONE + """SELECT c_nationkey AS nation, count(*) AS total, count(*) FILTER (o_orderkey % 8 IN (2, 3)) AS upheld, count(*) FILTER (o_orderkey % 8 IN (0, 1, 7)) AS pending, count(*) FILTER (o_orderkey % 8 IN (4, 5, 6)) AS cleared
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 IN (0, 1, 4) AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 GROUP BY ALL""")
def _(d):
    k = F.col("o_orderkey")
    stage = _pick(k, "proposed", "contested", "final", "settled", "dismissed", "withdrawn", "overturned", "unknown")
    basis = _pick(k, "license_number", "exact_registered_name", "name_similarity", None, "manual")
    rows = d.table("orders").join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    actions = rows.select(F.col("c_nationkey").alias("nation"), stage.alias("stage"), basis.alias("basis"), F.when(k % 11 != 0, "county").alias("agency"), F.when(k % 13 != 0, F.to_date("o_orderdate")).alias("day"))
    return parties.enforcement_counts(actions, "nation")


@on("person_keys", _NONE + """SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN f ELSE f || '|' || g END AS key FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'COMPTON' WHEN 1 THEN 'PENA' ELSE 'OBRIEN' END AS f, CASE c_custkey % 2 WHEN 0 THEN 'SHANE' ELSE 'ANA' END AS g FROM customer)""")
def _(d):
    from quadrat.functions import names

    k = F.col("c_custkey")
    family, given = _pick(k, "Compton", "Peña", "OBrien"), _pick(k, "Shane", "Ana")
    name = F.when(k % 5 == 0, _text(family, ", ", given, " Q.")).when(k % 5 == 1, _text("Mr. ", given, " ", family, ", Jr")).when(k % 5 == 2, _text(given, " van ", family)).when(k % 5 == 3, _text(F.upper(family), ",", given)).otherwise(family)
    return d.table("customer").select("c_custkey", names.person_match_key(name).alias("key"))


# intake


@on("importable_files", _NONE + "SELECT event_id FROM events WHERE event_id % 7 IN (0, 2, 3, 6) OR user_id % 3 = 1")
def _(d):
    name = _text("scan ", F.col("event_id").cast("string"), _pick(F.col("event_id"), ".PDF", ".png", ".xlsx", ".csv", ".zip", ".pdf.zip", ".docx"))
    return d.table("events").where(ingest.importable(_pick(F.col("user_id"), None, ".TXT", "image"), name)).select("event_id")


@on("publishable_outcomes", """, shifted AS (SELECT (start + INTERVAL 24 YEAR)::DATE AS start, category FROM apps)
  SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN start < DATE '2020-01-01' THEN 'out_of_coverage' WHEN category IN ('BUILDING', 'MACHINERY') THEN 'published' ELSE 'not_forestry' END AS outcome FROM shifted) GROUP BY ALL""")
def _(d):
    rows = d.apps.select(F.add_months("start", 24 * 12).alias("start"), F.col("category").isin("BUILDING", "MACHINERY").alias("site_published"))
    return ingest.publishable(rows).groupBy("outcome").agg(F.count("*").alias("n"))


@on("record_provenance", _NONE + """SELECT o_orderkey AS id, 'acres' AS field, floor(o_totalprice)::BIGINT::VARCHAR AS value, 'file ' || o_custkey % 10 AS source FROM orders UNION ALL SELECT o_orderkey, 'method', o_orderpriority, 'file ' || o_custkey % 10 FROM orders
  UNION ALL SELECT o_orderkey, 'status', o_orderstatus, 'file ' || o_custkey % 10 FROM orders WHERE o_orderstatus <> 'P'""")
def _(d):
    rows = d.table("orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").alias("acres"), F.col("o_orderpriority").alias("method"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), _text("file ", (F.col("o_custkey") % 10).cast("string")).alias("file"))
    return ingest.provenance(rows, "id", "file", "acres", "method", "status")


@on("updated_from_join", _NONE + "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'own' WHEN o_custkey % 3 <> 0 THEN c_mktsegment END AS category FROM orders JOIN customer ON o_custkey = c_custkey")
def _(d):
    rows = d.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"), F.when(F.col("o_orderkey") % 2 == 0, "own").alias("category"))
    other = d.table("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("who"), F.col("c_mktsegment").alias("category"))
    return ingest.updated_from(rows, other, "who", "category").select("id", "category")


@on("batch_summary", """, f AS (SELECT n_name AS batch, count(*) AS files_processed, count(*) FILTER (c_custkey % 6 = 1) AS files_duplicate, count(*) FILTER (c_custkey % 6 = 2) AS files_failed FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT county AS batch, count(*) AS records_extracted, count(*) FILTER (id % 9 = 0) AS records_duplicate, count(*) FILTER (status = 'published') AS published, count(*) FILTER (status = 'planned') AS out_of_coverage, count(*) FILTER (status = 'needs_review') AS not_forestry FROM apps GROUP BY ALL),
q AS (SELECT county AS batch, CASE WHEN flagged THEN 'flagged' ELSE method END AS reason, count(*) AS n FROM apps WHERE status = 'needs_review' GROUP BY ALL)
SELECT batch, f.* EXCLUDE (batch), r.* EXCLUDE (batch), (SELECT sum(n) FROM q WHERE q.batch = f.batch)::BIGINT AS needs_review, (SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) FROM q WHERE q.batch = f.batch) AS review_reasons FROM f JOIN r USING (batch)""")
def _(d):
    nations = d.table("customer").join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    files = nations.select(F.col("n_name").alias("batch"), _pick(F.col("c_custkey"), "imported", "duplicate", "failed", "imported", "imported", "imported").alias("status"))
    outcome = F.when(F.col("status") == "published", "published").when(F.col("status") == "planned", "out_of_coverage").otherwise("not_forestry")
    records = d.apps.select(F.col("county").alias("batch"), outcome.alias("outcome"), (F.col("id") % 9 == 0).alias("duplicate"))
    reasons = d.apps.where("status = 'needs_review'").select(F.col("county").alias("batch"), F.when(F.col("flagged"), "flagged").otherwise(F.col("method")).alias("reason"))
    shown = F.array_join(F.transform(F.map_entries("review_reasons"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return ingest.batch_summary(files, records, reasons).withColumn("review_reasons", shown)


@on("cluster_recompute", f""", m AS (SELECT operator_id AS cluster, start, CASE WHEN id % 3 <> 0 THEN start + (id % 20)::INT END AS ended, CASE WHEN id % 4 <> 0 THEN acres END AS acres, method FROM apps)
  SELECT cluster, min(start) AS first, max(coalesce(ended, start)) AS last, round({xsum('acres')}, 2) AS acres, count(acres) <> count(*) AS partial, count(DISTINCT method) FILTER (method <> 'unknown') > 1 AS mixed,
    CASE WHEN bool_or(method = 'aerial') THEN 'aerial' ELSE min(method) END AS method FROM m GROUP BY cluster""")
def _(d):
    ended = F.when(F.col("id") % 3 != 0, F.date_add("start", (F.col("id") % 20).cast("int")))
    return ingest.recomputed(d.apps.select(F.col("operator_id").alias("cluster"), "start", ended.alias("ended"), F.when(F.col("id") % 4 != 0, F.col("acres")).alias("acres"), "method"))


@on("change_fingerprint", _NONE + "SELECT count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last FROM orders")
def _(d):
    return ingest.fingerprint(d.table("orders"), "o_orderdate")


@on("application_titles", _NONE + """SELECT id, coalesce(CASE WHEN id % 11 = 0 THEN 'Title ' || id END, CASE WHEN id % 5 = 0 THEN 'THP ' || id % 100 END, CASE WHEN id % 3 = 0 THEN county END, CASE WHEN id % 2 = 0 THEN operator END, CASE WHEN id % 7 <> 0 THEN 'Application at M' || id % 36 END, 'Unidentified application') AS title,
  CASE WHEN id % 11 = 0 THEN 'override' WHEN id % 5 = 0 THEN 'project' WHEN id % 3 = 0 OR id % 2 = 0 THEN 'owner' ELSE 'location' END AS basis FROM apps""")
def _(d):
    i = F.col("id")
    when = lambda n, c: F.when(i % n == 0, c).otherwise("")
    t = ingest.title(when(11, _text("Title ", i.cast("string"))), when(5, _text("THP ", (i % 100).cast("string"))), when(3, F.col("county")), F.when(i % 2 == 0, F.col("operator")), F.when(i % 7 != 0, _text("M", (i % 36).cast("string"))))
    return d.apps.select("id", t.alias("t")).select("id", "t.title", "t.basis")


@on("tracked_paths", _NONE + "SELECT event_id FROM events WHERE event_id % 4 IN (0, 3)")
def _(d):
    from quadrat.functions import web

    path = _pick(F.col("event_id"), "/county/x", "/api/track", "/_next/a.js", "/apis")
    return d.table("events").select("event_id", path.alias("path")).where(web.is_page("path")).select("event_id")


@on("detected_formats", _NONE + """SELECT event_id, CASE WHEN score >= 0.3 THEN profile END AS profile, score FROM (
  SELECT event_id, CASE WHEN t >= 0.7 OR t >= greatest(p, v, e) THEN 'tabular_use_records' WHEN p >= greatest(v, e) THEN 'restricted_materials_permit' WHEN v >= e THEN 'investigation_report' ELSE 'enforcement_action' END AS profile, CASE WHEN t >= 0.7 THEN t ELSE greatest(t, p, v, e) END AS score FROM (
    SELECT event_id, CASE WHEN event_id % 5 IN (0, 3) AND user_id % 13 > 0 THEN least(1, round(0.4 + 0.05 * (user_id % 13), 6)) ELSE 0 END::DOUBLE AS t, CASE WHEN event_id % 5 IN (1, 2, 3) THEN [0, 0.6, 0.8, 0, 0.1, 0, 0][event_id % 7 + 1] ELSE 0 END::DOUBLE AS p,
      CASE WHEN event_id % 5 IN (1, 2, 3) THEN [0, 0, 0, 0.75, 0, 0.15, 0][event_id % 7 + 1] ELSE 0 END::DOUBLE AS v, CASE WHEN event_id % 5 IN (1, 2, 3) THEN [0, 0, 0, 0, 0.8, 0.15, 0][event_id % 7 + 1] ELSE 0 END::DOUBLE AS e FROM events))""")
def _(d):
    from quadrat.sources import detect

    k = F.col("event_id")
    text = _pick(k, "", "Restricted Materials Permit", "RESTRICTED MATERIALS PERMIT\nSites list", "Case ID: INV-7 complaint date", "notice of proposed action; civil penalty; contact list", "nature of violation, complaint date", "x" * 9000 + "decision and order")
    rows = d.table("events").select(k, detect.detected(_text("f", _pick(k, ".CSV", ".pdf", ".docx", ".txt", ".png")), text, F.col("user_id") % 13).alias("x"))
    return rows.select("event_id", "x.profile", "x.score")


# locations


@on("quarter_sections", _NONE + "SELECT p_partkey, nullif(array_to_string(list_transform(regexp_extract_all(regexp_replace(upper(p_name), '[^NSEW/]', '', 'g'), '[NS][EW]|[NSEW]'), lambda x: x || '/4'), ' '), '') AS quarters FROM part")
def _(d):
    return d.table("part").select("p_partkey", sites.subsection(F.col("p_name")).alias("quarters"))


@on("structured_sites", _NONE + """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity::INT BETWEEN 1 AND 48 AND l_suppkey % 38 BETWEEN 1 AND 36 THEN m || lpad((l_quantity::INT)::VARCHAR, 2, '0') || 'N' || lpad((l_linenumber + 3)::VARCHAR, 2, '0') || r || lpad((l_suppkey % 38)::VARCHAR, 2, '0') END AS mtrs,
  CASE WHEN l_quantity::INT BETWEEN 1 AND 48 AND l_suppkey % 38 BETWEEN 1 AND 36 THEN CASE WHEN l_partkey % 2 = 0 AND l_partkey % 3 = 0 THEN 'verified' WHEN l_orderkey % 4 IN (0, 2) THEN 'high' ELSE 'medium' END END AS confidence
  FROM (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN 'S' WHEN l_orderkey % 4 IN (1, 2) THEN 'H' ELSE 'M' END AS m, CASE WHEN l_partkey % 2 = 0 THEN 'E' WHEN l_orderkey % 4 = 1 THEN 'W' ELSE 'E' END AS r FROM lineitem)""")
def _(d):
    two = F.col("l_partkey") % 2 == 0
    s = sites.decode_structured(_text("T", F.col("l_quantity").cast("int").cast("string")), F.col("l_linenumber") + 3, F.col("l_suppkey") % 38, F.when(two, "north"), F.when(two, "E"), F.when(F.col("l_partkey") % 3 == 0, "s"), _pick(F.col("l_orderkey"), "Plumas", "Mendocino", "Humboldt", "Nowhere"))
    rows = d.table("lineitem").select("l_orderkey", "l_linenumber", s.alias("s"))
    return rows.select("l_orderkey", "l_linenumber", sites.mtrs(F.col("s")).alias("mtrs"), "s.confidence")


@on("site_reconciled", _NONE + """SELECT o_orderkey, CASE WHEN k = 0 THEN a WHEN k = 3 THEN NULL ELSE b END AS mtrs, CASE k WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'medium' ELSE 'medium' END WHEN 1 THEN 'verified' WHEN 2 THEN CASE WHEN a = b THEN 'verified' ELSE 'medium' END END AS confidence
  FROM (SELECT o_orderkey, o_orderkey % 4 AS k, 'M30N10E' || lpad((o_custkey % 36 + 1)::VARCHAR, 2, '0') AS a, 'M30N10E' || lpad((CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 36 + 1 ELSE (o_custkey + 1) % 36 + 1 END)::VARCHAR, 2, '0') AS b FROM orders)""")
def _(d):
    k, here, there = F.col("o_orderkey") % 4, F.col("o_custkey") % 36 + 1, (F.col("o_custkey") + 1) % 36 + 1
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    site, code = F.when(k.isin(0, 2), _text("3010", two(here))), F.when(k.isin(1, 2), _text("M30N10E", two(F.when(F.col("o_orderkey") % 3 == 0, here).otherwise(there))))
    rows = d.table("orders").select("o_orderkey", sites.decode_site_id(site).alias("a"), sites.parse_mtrs(code).alias("b"), (site.isNotNull() & code.isNotNull()).alias("both"))
    rows = rows.select("o_orderkey", sites.reconciled(F.col("a"), F.col("b"), F.col("both")).alias("s"))
    return rows.select("o_orderkey", sites.mtrs(F.col("s")).alias("mtrs"), "s.confidence")


@on("township_totals", f""", t AS (SELECT CASE WHEN operator_id % 50 BETWEEN 1 AND 48 THEN 'T' || operator_id % 50 || 'N R' || (operator_id % 4 + 1) || 'E' ELSE 'unknown' END AS township, acres FROM apps) SELECT township, count(*) AS applications, {xsum('acres')} AS acres FROM t GROUP BY ALL""")
def _(d):
    from quadrat.plans.domain import exact_sum

    s = sites.site(F.lit("M"), (F.col("operator_id") % 50).cast("int"), F.lit("N"), (F.col("operator_id") % 4 + 1).cast("int"), F.lit("E"), F.lit(7), F.lit("high"))
    return d.apps.withColumn("township", sites.township_key(s)).groupBy("township").agg(F.count("*").alias("applications"), exact_sum(F.col("acres")).alias("acres"))


@on("cluster_left_county", _NONE + "SELECT c_custkey AS id, n_name AS county, CASE WHEN s_suppkey IS NOT NULL THEN s_name END AS project FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey LEFT JOIN supplier ON c_custkey = s_suppkey")
def _(d):
    c, n, s = d.table("customer"), d.table("nation").where("n_regionkey <> 2"), d.table("supplier")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(s, c.c_custkey == s.s_suppkey, "left").select(F.col("c_custkey").alias("id"), F.col("n_name").alias("county"), F.col("s_name").alias("project"))


@on("cluster_parcels", _NONE + "SELECT l_orderkey AS id, count(DISTINCT l_suppkey) AS parcels, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS owners, count(DISTINCT s_nationkey) AS areas FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def _(d):
    met = d.table("lineitem").select(F.col("l_orderkey").alias("id"), "l_suppkey").distinct().join(d.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return met.groupBy("id").agg(F.count("*").alias("parcels"), F.array_join(F.array_sort(F.collect_set("s_name")), ",").alias("owners"), F.count_distinct("s_nationkey").alias("areas"))


@on("cluster_sections", _NONE + """SELECT c_nationkey AS cluster, count(DISTINCT c_custkey % 72) AS sections, min(c_custkey % 72 // 6)::DOUBLE AS west, min(c_custkey % 6)::DOUBLE AS south, max(c_custkey % 72 // 6 + 1)::DOUBLE AS east, max(c_custkey % 6 + 1)::DOUBLE AS north FROM customer GROUP BY ALL""")
def _(d):
    k = F.col("c_custkey") % 72
    x, y = F.floor(k / 6).cast("double"), (k % 6).cast("double")
    rows = d.table("customer").select(F.col("c_nationkey").alias("cluster"), k.alias("section"), geo.box_ring(x, y, x + 1, y + 1).alias("ring"))
    u = geo.union_of_sections(rows, "cluster", "section", "ring")
    return u.select("cluster", F.size("rings").alias("sections").cast("long").alias("sections"), "west", "south", "east", "north")


_BOXES = "b AS (SELECT c_custkey AS id, 32.5 + (c_custkey * 7919 % 9500) / 1000.0::DOUBLE AS s, -124.4 + (c_custkey * 104729 % 10300) / 1000.0::DOUBLE AS w FROM customer)"


@on("radius_nearest_edge", f""", {_BOXES}, m AS (SELECT id, greatest(w - -121.5, 0, -121.5 - (w + 0.25)) * cos(radians(38.5)) AS dx, greatest(s - 38.5, 0, 38.5 - (s + 0.125)) AS dy FROM b)
  SELECT id, round(sqrt(dx * dx + dy * dy) * {geo.DEGREE_MILES}, 3) AS miles FROM m WHERE sqrt(dx * dx + dy * dy) * {geo.DEGREE_MILES} <= 50""")
def _(d):
    k = F.col("c_custkey")
    s, w = 32.5 + (k * 7919 % 9500) / F.lit(1000.0), -124.4 + (k * 104729 % 10300) / F.lit(1000.0)
    rows = d.table("customer").select(k.alias("id"), geo.box_ring(w, s, w + 0.25, s + 0.125).alias("ring"))
    return geo.radius_of_shapes(rows, 38.5, -121.5, 50).select("id", "miles")


@on("clipped_areas", _NONE + "SELECT s_suppkey, round(CASE WHEN s_suppkey % 3 = 2 THEN 0 ELSE (s_suppkey % 10 + 1) * (s_suppkey % 10 + 1) / CASE WHEN s_suppkey % 3 = 0 THEN 2.0 ELSE 1.0 END END, 6)::DOUBLE AS area FROM supplier")
def _(d):
    """Diamonds about the origin, clipped to a quadrant, a half plane, or a box they don't reach."""
    r = (F.col("s_suppkey") % 10 + 1).cast("double")
    ring = geo.ring_of((r, F.lit(0.0)), (F.lit(0.0), r), (-r, F.lit(0.0)), (F.lit(0.0), -r))
    box = [_pick(F.col("s_suppkey"), *c) for c in ((0.0, 0.0, 50.0), (0.0, -20.0, 50.0), (20.0, 20.0, 60.0), (20.0, 20.0, 60.0))]
    return d.table("supplier").select("s_suppkey", F.round(geo.area_and_centroid(geo.clipped(ring, *box))["area"], 6).alias("area"))


# lists


@on("top_groups", _NONE + "SELECT p_name AS product, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL ORDER BY n DESC, product LIMIT 100")
def _(d):
    met = d.table("lineitem").join(d.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return met.groupBy(F.col("p_name").alias("product")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "product").limit(100)


@on("latest_batches", _NONE + "SELECT o_orderkey AS id, o_orderdate::DATE AS started FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def _(d):
    return d.table("orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("started")).orderBy(F.desc("started"), F.desc("id")).limit(25)


# versions and pulls


@on("rebuild_from_sources", """, l AS (SELECT id, min(id) OVER (PARTITION BY operator_id, start) AS component, acres, status FROM apps), c AS (SELECT CASE WHEN id % 10 = 0 THEN id % 100 + 1 ELSE component END AS component, acres FROM l)
SELECT component, count(*) AS records, """ + xsum("acres") + """ AS acres, CASE WHEN component % 7 = 0 THEN 'published' ELSE 'ready' END AS status FROM c GROUP BY component""")
def _(d):
    """Records, clusters and applications rebuilt twice into versions of their own, with people's decisions joined last; the second version is read."""
    from quadrat.operators import overlay, storage, versions
    from quadrat.plans.domain import exact_sum

    records = d.apps_of("id", "operator_id", "start", "acres")
    merges = records.where("id % 10 = 0").select("id", (F.col("id") % 100 + 1).alias("cluster"), F.lit(1).alias("decided"))
    chosen = records.select((F.col("id") * 7).alias("id"))
    steps = {
        "applications": (("clusters", "chosen"), lambda c, chosen: overlay.published(c.groupBy(F.col("component").alias("id")).agg(F.count("*").alias("records"), exact_sum(F.col("acres")).alias("acres")).withColumn("status", F.lit("ready")), chosen)),
        "clusters": (("labels", "merges", "records"), lambda labels, merges, records: overlay.assigned(labels, merges).join(records.select("id", "acres"), "id")),
        "labels": (("records",), lambda r: r.join(r.groupBy("operator_id", "start").agg(F.min("id").alias("component")), ["operator_id", "start"]).select("id", "component")),
        "records": (("sources",), lambda sources: sources.dropDuplicates(["id"])),
    }
    v = versions.Versions(d.spark, storage.scratch(d.spark, "versions"))
    for _ in range(2):
        v.rebuild({"sources": records, "merges": merges, "chosen": chosen}, steps)
    return v.read("applications").withColumnRenamed("id", "component")


@on("pull_by_mark", _NONE + """, f AS (SELECT coalesce(sha256(text), 'n' || doc_id) AS sha, DATE '2024-01-01' + (doc_id % 60)::INT AS received, doc_id % 9 = 0 AS photo FROM documents WHERE doc_id % 9 <> 0)
SELECT pull, count(*) AS files FROM (SELECT sha, CASE WHEN min(received) <= DATE '2024-01-31' THEN 1 ELSE 2 END AS pull FROM f GROUP BY sha) GROUP BY pull""")
def _(d):
    """Documents as files that come in over two months, pulled at the end of each; the second pull looks back a fortnight."""
    import datetime as dt

    from quadrat.operators import storage, versions

    k = F.col("doc_id")
    files = d.table("documents").select(_text("f", k.cast("string"), F.when(k % 9 == 0, ".jpg").otherwise(".txt")).alias("name"), _null().alias("file_type"), F.sha2("text", 256).alias("sha256"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")).alias("received"))
    pull = versions.Pull(d.spark, storage.scratch(d.spark, "pull"))
    load = lambda new: new.withColumn("problem", _null())
    for day in (dt.date(2024, 1, 31), dt.date(2024, 2, 29)):
        pull.run(files.where(F.col("received") <= F.lit(day)), day, load, {"names": lambda good: good.select("name")})
    return pull.read("names").groupBy("pull").agg(F.count("*").alias("files"))
