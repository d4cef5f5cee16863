"""Queries over the driver's tables, one per operator, each with DuckDB SQL of the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrasift.functions import geo
from terrasift.functions import text as T
from terrasift.operators import matching as M
from terrasift.operators import quality as Q
from terrasift.operators import relational as R
from terrasift.operators import spatial as S
from terrasift.plans import storing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query and its SQL under the function's name."""

    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT n_nationkey, n_name, count(o_orderkey) AS orders, count(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'
GROUP BY n_nationkey, n_name
""")
def view_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation stays, with its counts of finished and of urgent finished orders."""
    done = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey", "o_orderpriority")
    joined = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(done, F.col("o_custkey") == F.col("c_custkey"), "left")
    )
    return joined.groupBy("n_nationkey", "n_name").agg(
        F.count("o_orderkey").alias("orders"),
        F.count(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey"))).alias("urgent"),
    )


def _cast(c: Column) -> Column:
    return c.cast("bigint")


# Scans, projections and filters


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS price FROM orders")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "order_id", "o_custkey": "customer_id", "o_totalprice": "price"}).select("order_id", "customer_id", "price")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05")
def filter_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(10, 20) & F.col("l_discount").between(0.02, 0.05))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events WHERE event_id % 3 <> 0")
def filter_notnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return gaps.dropna(subset=["value"])


@query("""
SELECT o_orderkey, CASE WHEN lower(o_orderstatus) = 'o' THEN 'upcoming' ELSE 'existing' END AS status,
       CASE WHEN upper(o_orderstatus) IN ('F', 'P') THEN upper(o_orderstatus) END AS kind FROM orders
""")
def case_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.upper("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.lower("o_orderstatus") == "o", "upcoming").otherwise("existing").alias("status"), F.when(kind.isin("F", "P"), kind).alias("kind"))


@query(r"""
SELECT event_id, TRY_CAST(t AS DOUBLE) AS amount, TRY_CAST(i AS BIGINT) AS whole
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '12.5' WHEN 1 THEN 'x' || event_id WHEN 2 THEN '' ELSE '-' || event_id || '.25' END AS t,
             CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'n/a' END AS i FROM events)
""")
def safe_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    t = F.when(F.col("event_id") % 4 == 0, "12.5").when(F.col("event_id") % 4 == 1, F.concat(F.lit("x"), n)).when(F.col("event_id") % 4 == 2, "").otherwise(F.concat(F.lit("-"), n, F.lit(".25")))
    i = F.when(F.col("event_id") % 3 == 0, n).when(F.col("event_id") % 3 == 1, "n/a")
    return table(spark, sf_dir, "events").select("event_id", T.number(t).alias("amount"), i.try_cast("bigint").alias("whole"))


# Text


@query(r"""
SELECT p_partkey, nullif(trim(regexp_replace(t, '\s+', ' ', 'g')), '') AS squashed,
       nullif(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\s*[\r\n]+\s*', ', ', 'g'), '') AS lined
FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '   ' ELSE '  ' || p_name || chr(10) || '  ' || p_brand || '   ' || p_type || ' ' END AS t FROM part)
""")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("p_partkey") % 5 == 0, "   ").otherwise(F.concat(F.lit("  "), "p_name", F.lit("\n  "), "p_brand", F.lit("   "), "p_type", F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", T.squash(t).alias("squashed"), T.one_line(t).alias("lined"))


@query(r"""
SELECT p_partkey, CASE lower(b) WHEN 'bp pulse' THEN 'BP' WHEN 'tesla motors' THEN 'Tesla' ELSE b END AS name
FROM (SELECT p_partkey, nullif(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ?\([^)]*\)$', ''), '') AS b
      FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' BP   Pulse (AU) ' WHEN 1 THEN p_brand || ' (x) (' || p_partkey || ')'
                                   WHEN 2 THEN '(Unknown Operator)' WHEN 3 THEN 'Tesla  Motors' ELSE p_brand END AS t FROM part))
""")
def canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, " BP   Pulse (AU) ").when(k == 1, F.concat("p_brand", F.lit(" (x) ("), F.col("p_partkey").cast("string"), F.lit(")"))).when(k == 2, "(Unknown Operator)").when(k == 3, "Tesla  Motors").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.canonical_name(t).alias("name"))


@query("SELECT s_suppkey, nullif(regexp_extract('NSW ' || (s_suppkey * 7919) || ' x', '[0-9]{4}'), '') AS code FROM supplier")
def regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.postcode(F.concat(F.lit("NSW "), (F.col("s_suppkey") * 7919).cast("string"), F.lit(" x"))).alias("code"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 2 + 0.5 WHEN 1 THEN p_size WHEN 2 THEN p_size WHEN 3 THEN 5 END::DOUBLE AS kw FROM part
""")
def regex_numeric_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    t = F.when(k == 0, F.concat(F.lit("2 x"), size, F.lit(" kW & 1x"), (F.col("p_size") * 2).cast("string"), F.lit(".5kW"))).when(k == 1, F.concat(size, F.lit(" kW")))
    t = t.when(k == 2, F.concat(F.lit("Max. "), size, F.lit(" kW"))).when(k == 3, "approx .5kW").otherwise("AC")
    return table(spark, sf_dir, "part").select("p_partkey", T.rating_kw(t).alias("kw"))


@query("""
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN p_size / 100 WHEN 2 THEN CAST('0.' || (p_size + 10) AS DOUBLE) WHEN 4 THEN CASE p_size WHEN 40 THEN 0.5 END END::DOUBLE AS price FROM part
""")
def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, more, k = F.col("p_size").cast("string"), (F.col("p_size") + 10).cast("string"), F.col("p_partkey") % 7
    t = F.when(k == 0, "FREE to use").when(k == 1, F.concat(size, F.lit("c/kWh"))).when(k == 2, F.concat(F.lit("$0."), more, F.lit(" per kWh"))).when(k == 3, F.concat(size, F.lit("c-68c/kWh")))
    t = t.when(k == 4, F.concat(F.lit("50c/kWh or $0."), more, F.lit("/kWh"))).when(k == 5, "$5 per session")
    return table(spark, sf_dir, "part").select("p_partkey", T.price_per_kwh(t).alias("price"))


@query("""
WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN NULL ELSE p_size END::BIGINT AS f, CASE p_partkey % 4 WHEN 0 THEN p_partkey % 60 WHEN 1 THEN 12 WHEN 3 THEN p_size END::BIGINT AS g, p_partkey % 40 AS h FROM part)
SELECT p_partkey, CASE WHEN f < g THEN f ELSE g END AS low, CASE WHEN f < g THEN g ELSE f END AS high,
       coalesce(CASE WHEN f < g THEN f ELSE g END - h > 10 OR h - CASE WHEN f < g THEN g ELSE f END > 10, false) AS conflict FROM n
""")
def number_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    a = F.when(k == 0, F.concat(size, F.lit("-"), (F.col("p_partkey") % 60).cast("string"), F.lit(" Oaks Ave"))).when(k == 1, F.concat(size, F.lit("/12 B"))).when(k == 2, "Cnr X").otherwise(F.concat(size, F.lit(" - 33 C")))
    b = F.concat((F.col("p_partkey") % 40).cast("string"), F.lit(" St"))
    r = T.number_range(a)
    return table(spark, sf_dir, "part").select("p_partkey", r["low"].alias("low"), r["high"].alias("high"), T.address_conflict(a, b).alias("conflict"))


@query(r"""
SELECT c_custkey, CASE WHEN regexp_matches(l2, '^\s*[0-9]') THEN l2 WHEN regexp_matches(l1, '^\s*[0-9]') THEN l1 ELSE nullif(concat_ws(', ', nullif(l1, ''), nullif(l2, '')), '') END AS street
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey || ' B St' WHEN 1 THEN 'Shop' END AS l1, CASE c_custkey % 4 WHEN 0 THEN '12 A St' WHEN 1 THEN 'Mall' WHEN 2 THEN '' END AS l2 FROM customer)
""")
def street_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    line1 = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(" B St"))).when(k % 3 == 1, "Shop")
    line2 = F.when(k % 4 == 0, "12 A St").when(k % 4 == 1, "Mall").when(k % 4 == 2, "")
    return table(spark, sf_dir, "customer").select("c_custkey", T.street_address(line1, line2).alias("street"))


@query("SELECT c_custkey, coalesce(nullif(CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_name END, ''), nullif(c_mktsegment, '')) AS label FROM customer")
def coalesce_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.first_filled(a, F.col("c_mktsegment")).alias("label"))


@query("""
SELECT p_partkey, starts_with(p_type, 'S') OR starts_with(p_type, 'P') AS led, suffix(p_type, 'L') AS ends, len(p_type) - len(replace(p_type, ' ', '')) = 1 AS once FROM part
""")
def string_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_type")
    led = F.exists(F.array(F.lit("S"), F.lit("P")), lambda p: t.startswith(p))
    return table(spark, sf_dir, "part").select("p_partkey", led.alias("led"), t.endswith("L").alias("ends"), (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) == 1).alias("once"))


# JSON and arrays


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS part_of FROM part WHERE p_type IS NOT NULL")
def explode_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split_rows(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("part_of")), "part_of", " ")


@query("SELECT vec_id, list_max(embedding) AS top, list_sum(list_transform(embedding, lambda x: CAST(CASE WHEN x > 0 THEN 1 ELSE 2 END AS BIGINT)))::BIGINT AS total FROM embeddings")
def array_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x > 0, 1).otherwise(2))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_max("embedding").alias("top"), total.alias("total"))


@query("""
SELECT p_partkey, nullif(CASE WHEN a = b THEN a ELSE concat_ws(', ', a, b) END, '') AS listed
FROM (SELECT p_partkey, nullif(p_brand, 'Unknown') AS a, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS b FROM part)
""")
def array_distinct_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array("p_brand", F.lit(""), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")), F.lit("Unknown"))
    return table(spark, sf_dir, "part").select("p_partkey", T.joined(values).alias("listed"))


@query("SELECT p_partkey, len(list_intersect(string_split(upper(p_type), ' '), ['STANDARD', 'PROMO', 'BRASS', 'STEEL'])) > 0 AS meets FROM part")
def array_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*map(F.lit, ("STANDARD", "PROMO", "BRASS", "STEEL")))
    return table(spark, sf_dir, "part").select("p_partkey", F.arrays_overlap(F.split(F.upper("p_type"), " "), wanted).alias("meets"))


# Aggregates


@query("""
SELECT 'raw' AS stage, c AS "column", n AS non_null, t AS total, CAST(round_even(CAST(n AS DOUBLE) * 1000 / t, 0) AS DOUBLE) / 10 AS pct_complete FROM (
SELECT 'event_id' AS c, count(event_id) AS n, count(*) AS t FROM events UNION ALL SELECT 'value', count(CASE WHEN event_id % 3 <> 0 THEN value END), count(*) FROM events
UNION ALL SELECT 'event_type', count(CASE WHEN event_id % 7 <> 0 THEN event_type END), count(*) FROM events)
""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"))
    return R.completeness(gaps, "raw")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_rows(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "event_id")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY 1")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus is not null").groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy("o_orderstatus")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders")
def filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("SELECT 'nation' AS \"table\", count(*) AS n FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storing.table_counts({name: table(spark, sf_dir, name) for name in ("nation", "customer", "orders")})


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE AS share FROM orders")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(R.ratio(F.count_if(F.col("o_orderstatus") == "F").cast("double"), F.count("*").cast("double")).alias("share"))


@query("""
SELECT operator, count(c_custkey) AS total, count(c_custkey) FILTER (WHERE c_custkey % 3 = 0) AS matched
FROM (VALUES ('BUILDING'), ('MACHINERY'), ('NOWHERE')) f(operator) LEFT JOIN customer ON c_mktsegment = operator GROUP BY operator
""")
def focus_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("charger_id"), F.col("c_mktsegment").alias("operator"))
    return M.focus_coverage(rows, rows.where("charger_id % 3 = 0"), ["BUILDING", "MACHINERY", "NOWHERE"])


# Windows and ids

_EVENTS = "SELECT user_id, event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS value, CASE WHEN event_id % 4 <> 0 THEN props END AS props, CASE WHEN user_id % 2 = 0 THEN 'n' || (event_id % 2) ELSE CASE WHEN event_id % 2 = 0 THEN 'm' END END AS name, event_id FROM events"


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    name = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("n"), (e % 2).cast("string"))).otherwise(F.when(e % 2 == 0, "m"))
    return table(spark, sf_dir, "events").select("user_id", "event_type", F.when(e % 3 != 0, F.col("value")).alias("value"), F.when(e % 4 != 0, F.col("props")).alias("props"), name.alias("name"), "event_id")


_FILLED = "((user_id IS NOT NULL)::INT + (event_type IS NOT NULL)::INT + (value IS NOT NULL)::INT + (props IS NOT NULL)::INT + (name IS NOT NULL)::INT)"


@query(f"""
WITH e AS (SELECT *, {_FILLED} AS filled FROM ({_EVENTS}))
SELECT event_id, filled, row_number() OVER (PARTITION BY user_id, event_type ORDER BY filled DESC, event_id) AS rank FROM e
""")
def fullest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gappy(spark, sf_dir)
    rows = rows.withColumn("filled", R.filled([c for c in rows.columns if c != "event_id"]))
    w = Window.partitionBy("user_id", "event_type").orderBy(F.col("filled").desc(), "event_id")
    return rows.select("event_id", "filled", _cast(F.row_number().over(w)).alias("rank"))


@query(f"""
WITH e AS (SELECT *, {_FILLED} AS filled FROM ({_EVENTS})),
n AS (SELECT user_id AS u, event_type AS t, count(DISTINCT name) AS names FROM e GROUP BY ALL),
r AS (SELECT e.*, names, row_number() OVER w AS rank,
             first_value(value IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY filled DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v,
             first_value(props IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY filled DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p,
             first_value(name IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY filled DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS m
      FROM e JOIN n ON user_id IS NOT DISTINCT FROM u AND event_type IS NOT DISTINCT FROM t WINDOW w AS (PARTITION BY user_id, event_type ORDER BY filled DESC, event_id))
SELECT user_id, event_type, CASE WHEN names <= 1 THEN v ELSE value END AS value, CASE WHEN names <= 1 THEN p ELSE props END AS props, CASE WHEN names <= 1 THEN m ELSE name END AS name, event_id
FROM r WHERE names > 1 OR rank = 1
""")
def backfill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_duplicates(_gappy(spark, sf_dir), ["user_id", "event_type"], "name", "event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_per_group(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS id FROM orders")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.number_rows(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "id")


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_nationkey, c_mktsegment) AS group_id FROM customer")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.number_groups(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], "group_id").select("c_custkey", "group_id")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) AS brand_id FROM part")
def lookup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    ids = R.lookup(parts, "p_brand", "brand_id", "p_brand")
    return parts.join(ids, "p_brand", "left").select("p_partkey", "brand_id")


# Joins and sets


@query("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey", "left").select("c_custkey", "c_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_semi")


@query("SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL AND l_orderkey IS NOT NULL")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return Q.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", orders, "o_orderkey")


@query("""
SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON r_regionkey = n_regionkey
""")
def view_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    region = table(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    joined = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, "o_custkey").join(table(spark, sf_dir, "nation"), "n_nationkey").join(region, "n_regionkey", "left")
    return joined.select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return customer.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k")))


@query("""
SELECT o_custkey AS id FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ids = lambda rule: orders.where(rule).select(F.col("o_custkey").alias("id"))
    return ids("o_orderstatus = 'P'").union(ids("o_orderpriority = '1-URGENT'")).distinct().join(ids("o_orderstatus = 'F'"), "id", "left_anti")


@query("""
SELECT 'orders.o_custkey not in customer.c_custkey' AS problem, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
UNION ALL SELECT 'orders.o_totalprice: not o_totalprice < 200000', count(*) FROM orders WHERE NOT o_totalprice < 200000
UNION ALL SELECT 'orders(o_custkey) repeats', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
""")
def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"orders": table(spark, sf_dir, "orders"), "customer": table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0")}
    rules = Q.Rules(("o_orderkey",), (("o_custkey",),), ("o_orderstatus",), {"o_totalprice": "o_totalprice < 200000"}, {"o_custkey": ("customer", "c_custkey")})
    return Q.violations("orders", tables, rules)


# Space: places and regions are made from integer keys, alike on both sides.

# The projection's numbers for the SQL, worked out apart from geo: cone constant, C, radius at the origin, e, e squared.
_N, _C, _RHO0, _E1, _E2, _A = -0.44847899716830203, 1.1805242276692356, -15452159.644039396, 0.08181919104281579, 0.006694380022900787, 6378137.0


def _lonlat(key: Column) -> tuple[Column, Column]:
    return 150 + (key * 7919 % 1000) / 1000.0, -34 + (key * 104729 % 1000) / 1000.0


_LONLAT = "150 + ({0} * 7919 % 1000) / 1000.0::DOUBLE AS lon, -34 + ({0} * 104729 % 1000) / 1000.0::DOUBLE AS lat"
_QSQL = f"({1 - _E2!r}::DOUBLE) * (sin(radians(lat)) / (1 - {_E2!r}::DOUBLE * sin(radians(lat)) * sin(radians(lat))) - ln((1 - {_E1!r}::DOUBLE * sin(radians(lat))) / (1 + {_E1!r}::DOUBLE * sin(radians(lat)))) / {2 * _E1!r}::DOUBLE)"
_RHOSQL = f"({_A!r}::DOUBLE * sqrt({_C!r}::DOUBLE - ({_N!r}::DOUBLE) * ({_QSQL})) / ({_N!r}::DOUBLE))"
_XSQL = f"{_RHOSQL} * sin(({_N!r}::DOUBLE) * radians(lon - 132.0::DOUBLE))"
_YSQL = f"({_RHO0!r}::DOUBLE) - {_RHOSQL} * cos(({_N!r}::DOUBLE) * radians(lon - 132.0::DOUBLE))"


@query(f"SELECT k, floor(({_XSQL}) * 1000 + 0.5) / 1000 AS x, floor(({_YSQL}) * 1000 + 0.5) / 1000 AS y FROM (SELECT c_custkey AS k, {_LONLAT.format('c_custkey')} FROM customer)")
def project_albers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.albers(*_lonlat(F.col("c_custkey")))
    third = lambda c: (F.floor(c * 1000 + 0.5) / 1000).cast("double")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), third(x).alias("x"), third(y).alias("y"))


def _chargers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lon, lat = _lonlat(k)
    operator = F.when(k % 9 != 0, F.concat(F.lit("op"), (k % 4).cast("string")))
    address = F.concat((k % 50).cast("string"), F.lit(" St"))
    return table(spark, sf_dir, "customer").select(k.alias("charger_id"), operator.alias("operator"), address.alias("station_address"), F.lpad((k % 3).cast("string"), 4, "2").alias("postcode"), lat.alias("latitude"), lon.alias("longitude"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lon, lat = _lonlat(k * 13 + 1)
    none = lambda t: F.lit(None).cast(t)
    return table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("source_poi_id"), F.concat(F.lit("op"), (k % 4).cast("string")).alias("ext_operator"), F.col("s_name").alias("ext_name"), F.concat((k % 60).cast("string"), F.lit(" St")).alias("ext_address"),
        F.when(k % 2 == 0, F.lpad((k % 3).cast("string"), 4, "2")).alias("ext_postcode"), none("string").alias("usage_cost"), none("double").alias("price_per_kwh"), none("string").alias("plug_types"),
        none("int").alias("num_points"), none("int").alias("num_connectors"), none("double").alias("rate_kw"), lat.alias("lat"), lon.alias("lon"),
    )


_PAIRS = f"""
c AS (SELECT c_custkey AS charger_id, CASE WHEN c_custkey % 9 <> 0 THEN 'op' || (c_custkey % 4) END AS operator, (c_custkey % 50) || ' St' AS station_address, c_custkey % 50 AS num,
      lpad(CAST(c_custkey % 3 AS VARCHAR), 4, '2') AS postcode, {_LONLAT.format("c_custkey")} FROM customer),
s AS (SELECT CAST(s_suppkey AS VARCHAR) AS source_poi_id, 'op' || (s_suppkey % 4) AS ext_operator, (s_suppkey % 60) || ' St' AS ext_address, s_suppkey % 60 AS ext_num,
      CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST(s_suppkey % 3 AS VARCHAR), 4, '2') END AS ext_postcode, {_LONLAT.format("(s_suppkey * 13 + 1)")} FROM supplier),
cp AS (SELECT *, {_XSQL} AS x, {_YSQL} AS y FROM c), sp AS (SELECT *, {_XSQL} AS sx, {_YSQL} AS sy FROM s),
p AS (SELECT cp.* EXCLUDE (lon, lat), sp.* EXCLUDE (lon, lat), sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS d FROM cp, sp WHERE sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) <= 500),
f AS (SELECT *, round_even(d * 10, 0) / 10 AS distance_m, coalesce(operator = ext_operator, false) AS same, coalesce(postcode <> ext_postcode, false) AS pc FROM p),
q AS (SELECT *, greatest(num - ext_num, ext_num - num) > 10 AND distance_m > 50 AS sc, CASE WHEN same THEN 'operator_and_distance' ELSE 'distance_only' END AS match_method FROM f WHERE same OR distance_m <= 50),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY charger_id ORDER BY same DESC, distance_m, source_poi_id) AS r FROM q WHERE NOT (pc OR sc)) WHERE r = 1),
j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY charger_id ORDER BY distance_m, source_poi_id) AS r FROM q WHERE charger_id NOT IN (SELECT charger_id FROM a)) WHERE r = 1)
"""


@query(f"WITH {_PAIRS} SELECT charger_id, source_poi_id, round_even(d * 10, 0) / 10 AS distance_m FROM p")
def distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.albers(F.col("longitude"), F.col("latitude"))
    sx, sy = geo.albers(F.col("lon"), F.col("lat"))
    pairs = S.distance_join(_chargers(spark, sf_dir).withColumns({"x": x, "y": y}), _sites(spark, sf_dir).withColumns({"sx": sx, "sy": sy}), 500.0)
    return pairs.select("charger_id", "source_poi_id", geo.round1(F.col("d")).alias("distance_m"))


@query(f"WITH {_PAIRS} SELECT charger_id, source_poi_id, match_method, distance_m FROM a")
def match_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.accepted(M.verdicts(_chargers(spark, sf_dir), _sites(spark, sf_dir))).select("charger_id", "source_poi_id", "match_method", "distance_m")


@query(f"WITH {_PAIRS} SELECT charger_id, source_poi_id, distance_m, concat_ws('+', CASE WHEN pc THEN 'postcode_conflict' END, CASE WHEN sc THEN 'address_conflict' END) AS reject_reason FROM j")
def match_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rejected(M.verdicts(_chargers(spark, sf_dir), _sites(spark, sf_dir))).select("charger_id", "source_poi_id", "distance_m", "reject_reason")


@query(f"""
WITH {_PAIRS}, u AS (SELECT *, 'accepted' AS decision, NULL AS reject_reason FROM a UNION ALL
SELECT *, 'rejected', concat_ws('+', CASE WHEN pc THEN 'postcode_conflict' END, CASE WHEN sc THEN 'address_conflict' END) FROM j)
SELECT c.charger_id, c.operator, c.station_address, c.postcode, 'feed' AS source, coalesce(decision, 'no_candidate') AS decision, match_method, distance_m,
       ext_operator AS candidate_operator, ext_address AS candidate_address, ext_postcode AS candidate_postcode, reject_reason FROM c LEFT JOIN u USING (charger_id)
""")
def match_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match(_chargers(spark, sf_dir), _sites(spark, sf_dir), "feed")[1]


_REGIONS = "SELECT n_nationkey AS code, (n_nationkey % 5) * 2000.0::DOUBLE - 5 AS x0, (n_nationkey // 5) * 2000.0::DOUBLE - 5 AS y0 FROM nation"
_POINTS = "SELECT c_custkey AS k, c_nationkey, c_mktsegment, (c_custkey * 7919 % 1000) * 10.0::DOUBLE AS x, (c_custkey * 104729 % 1000) * 10.0::DOUBLE AS y FROM customer"


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of 1900 on a grid of 2000, 100 apart; no place is on an edge."""
    x0, y0 = (F.col("n_nationkey") % 5) * 2000.0 - 5, F.floor(F.col("n_nationkey") / 5) * 2000.0 - 5
    corner = lambda i, j: F.struct((x0 + 1900.0 * i).alias("x"), (y0 + 1900.0 * j).alias("y"))
    ring = F.array(*(corner(i, j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.array(ring).alias("rings"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), "c_nationkey", "c_mktsegment", ((k * 7919 % 1000) * 10.0).alias("x"), ((k * 104729 % 1000) * 10.0).alias("y"))


@query(f"SELECT k, code FROM ({_POINTS}) JOIN ({_REGIONS}) ON x > x0 AND x < x0 + 1900 AND y > y0 AND y < y0 + 1900")
def spatial_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.within(_places(spark, sf_dir), _squares(spark, sf_dir), "code", size=2000.0)
    return S.first_region(found, "k", "code").select("k", "code")


@query(f"""
WITH d AS (SELECT k, code, sqrt(power(greatest(x0 - x, 0, x - x0 - 1900), 2) + power(greatest(y0 - y, 0, y - y0 - 1900), 2)) AS d FROM ({_POINTS}), ({_REGIONS}))
SELECT k, code, round_even(d * 10, 0) / 10 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, code) AS r, min(d) OVER (PARTITION BY k) AS least FROM d) WHERE r = 1 AND least > 0 AND d <= 40
""")
def spatial_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, squares = _places(spark, sf_dir), _squares(spark, sf_dir)
    outside = places.join(S.within(places, squares, "code", size=2000.0).select("k"), "k", "left_anti")
    return S.nearest(outside, squares, "k", "code", 40.0)


@query(f"SELECT c_mktsegment, count(*) AS points, count(*) FILTER (WHERE x > x0 AND x < x0 + 1900 AND y > y0 AND y < y0 + 1900) AS inside FROM ({_POINTS}) LEFT JOIN ({_REGIONS}) ON code = c_nationkey GROUP BY c_mktsegment")
def spatial_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _places(spark, sf_dir).withColumnRenamed("c_nationkey", "code")
    return S.agreement(points, _squares(spark, sf_dir), "code", "c_mktsegment")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
