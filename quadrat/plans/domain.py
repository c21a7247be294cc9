"""The driver's star schema read as the domain: applications, product lines, inspections and page views.

nation: county (region: district); orders: applications; customer: operator;
lineitem: product lines; part: products; supplier: applicator; events: views.
Status F is published, O needs review, P a planned notice; urgent orders are
aerial, low ones of unknown method, the rest ground; the two highest priorities
carry a regulatory flag. Return flag R is gallons, A pounds, N ounces. Types
SMALL and MEDIUM are dry, LARGE and STANDARD liquid, PROMO an adjuvant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import units


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millionths(c: Column) -> tuple[Column, Column]:
    """A number in millionths: the upper bits, and the lower 20."""
    v = F.floor(c.cast("double") * 1e6 + 0.5)
    return F.shiftright(v, 20), v.bitwiseAND(F.lit((1 << 20) - 1))


def of_millionths(high: Column, low: Column) -> Column:
    """The number of summed upper and lower bits."""
    return (high.cast("decimal(28,0)") * F.lit(1 << 20) + low.cast("decimal(28,0)")).cast("double") / 1e6


def exact_sum(c: Column) -> Column:
    """A sum of millionths, which doesn't depend on the order of rows: the upper bits and the lower 20 are summed apart as longs, which no number of rows overflows."""
    return of_millionths(*(F.sum(x) for x in millionths(c)))


#: Columns of an application that need the operator's row, its county's, and its district's.
_OF_OPERATOR, _OF_COUNTY, _OF_DISTRICT = ("operator", "category"), ("county",), ("district",)


def applications(spark: SparkSession, sf_dir: str, *need: str) -> DataFrame:
    """Applications; with ``need`` only these columns, and only the joins that they take. Keys of the schema are whole, so a join left out drops no row."""
    o, p = table(spark, sf_dir, "orders"), F.col("o_orderpriority")
    columns = {
        "id": F.col("o_orderkey"), "start": F.to_date("o_orderdate"), "year": F.year("o_orderdate"), "acres": F.col("o_totalprice"),
        "status": F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("planned"),
        "method": F.when(p.startswith("1"), "aerial").when(p.startswith("5"), "unknown").otherwise("ground"), "flagged": p.substr(1, 1).isin("1", "2"),
        "county": F.col("n_name"), "district": F.col("r_name"), "operator_id": F.col("o_custkey"), "operator": F.col("c_name"), "category": F.col("c_mktsegment"),
    }
    asked = need or tuple(columns)
    if {*asked} & {*_OF_OPERATOR, *_OF_COUNTY, *_OF_DISTRICT}:
        o = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if {*asked} & {*_OF_COUNTY, *_OF_DISTRICT}:
        o = o.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    if {*asked} & {*_OF_DISTRICT}:
        o = o.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.select(*(columns[c].alias(c) for c in asked))


def lines(spark: SparkSession, sf_dir: str, applicator: bool = True) -> DataFrame:
    """Product lines with quantities resolved by unit and formulation; without ``applicator`` its table isn't joined."""
    li, p = (table(spark, sf_dir, x) for x in ("lineitem", "part"))
    first = F.split("p_type", " ")[0]
    state = F.when(first.isin("SMALL", "MEDIUM"), "dry").when(first.isin("LARGE", "STANDARD"), "liquid")
    unit = F.when(F.col("l_returnflag") == "R", "Gallon").when(F.col("l_returnflag") == "A", "Pounds").otherwise("Ounce")
    rows = li.join(p, li.l_partkey == p.p_partkey)
    rows = rows.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")) if applicator else rows.withColumn("s_name", F.lit(None).cast("string"))
    return rows.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product_id"), F.col("p_name").alias("product"), F.col("p_brand").alias("ingredient"), F.col("p_size").alias("percent"),
        (F.col("p_retailprice") / 100).alias("density"), F.when(first == "PROMO", "adjuvant").otherwise("herbicide").alias("kind"), unit.alias("unit"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.to_date("l_shipdate").alias("ended"), F.when(F.col("l_linestatus") == "F", "use_report").otherwise("notice").alias("record_kind"), F.col("s_name").alias("applicator"), units.normalize_quantity(F.col("l_quantity"), unit, state).alias("q"),
    ).select("*", F.col("q.gallons").alias("gallons"), F.col("q.pounds").alias("pounds"), F.col("q.family").alias("family")).drop("q")


def applicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The applicator of each product line; the table of products isn't joined."""
    li, s = (table(spark, sf_dir, x) for x in ("lineitem", "supplier"))
    return li.join(s, li.l_suppkey == s.s_suppkey).select(F.col("l_orderkey").alias("id"), F.col("s_name").alias("applicator"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page views: path, visitor, time, day, and a referrer and country made of the user's number."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.to_date("ts").alias("day"), F.col("event_type").alias("path"), F.col("user_id").alias("visitor"), "value", F.concat(F.lit("c"), F.pmod("user_id", F.lit(7)).cast("string")).alias("country"), F.get_json_object("props", "$.k").alias("k"))


#: The same for DuckDB, as common table expressions.
SQL = """
apps AS (
  SELECT o_orderkey AS id, o_orderdate::DATE AS start, year(o_orderdate)::INT AS year, o_totalprice AS acres,
    CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'needs_review' ELSE 'planned' END AS status,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'aerial' WHEN o_orderpriority LIKE '5%' THEN 'unknown' ELSE 'ground' END AS method, o_orderpriority[1] IN ('1', '2') AS flagged,
    n_name AS county, r_name AS district, o_custkey AS operator_id, c_name AS operator, c_mktsegment AS category
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), raw_lines AS (
  SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS product_id, p_name AS product, p_brand AS ingredient, p_size AS percent, p_retailprice / 100 AS density,
    CASE WHEN p_type LIKE 'PROMO%' THEN 'adjuvant' ELSE 'herbicide' END AS kind, CASE l_returnflag WHEN 'R' THEN 'Gallon' WHEN 'A' THEN 'Pounds' ELSE 'Ounce' END AS unit,
    l_quantity AS quantity, l_extendedprice AS price, l_shipdate::DATE AS ended, CASE l_linestatus WHEN 'F' THEN 'use_report' ELSE 'notice' END AS record_kind, s_name AS applicator,
    CASE WHEN p_type LIKE 'SMALL%' OR p_type LIKE 'MEDIUM%' THEN 'dry' WHEN p_type LIKE 'LARGE%' OR p_type LIKE 'STANDARD%' THEN 'liquid' END AS state
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
), lines AS (
  SELECT *, CASE WHEN unit = 'Gallon' THEN quantity WHEN unit = 'Ounce' AND state = 'liquid' THEN quantity / 128 END AS gallons,
    CASE WHEN unit = 'Pounds' THEN quantity WHEN unit = 'Ounce' AND state = 'dry' THEN quantity / 16 END AS pounds,
    CASE WHEN unit = 'Gallon' OR unit = 'Ounce' AND state = 'liquid' THEN 'volume' WHEN unit = 'Pounds' OR unit = 'Ounce' AND state = 'dry' THEN 'mass' ELSE 'unknown' END AS family
  FROM raw_lines
), views AS (
  SELECT event_id, ts::TIMESTAMP AS ts, ts::DATE AS day, event_type AS path, user_id AS visitor, value, 'c' || (user_id % 7)::VARCHAR AS country, json_extract_string(props, '$.k') AS k FROM events
)
"""


def xsum(expression: str) -> str:
    """exact_sum in DuckDB."""
    return f"(sum(floor(({expression})::DOUBLE * 1e6::DOUBLE + 0.5::DOUBLE)::HUGEINT)::DOUBLE / 1e6::DOUBLE)"
