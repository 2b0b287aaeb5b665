"""All queries by name, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeline.functions import scalars as S
from probeline.functions.fixed_point import charged, discounted
from probeline.operators import joins, partitioning
from probeline.operators.lookup import lookup, mismatches
from probeline.operators.positions import exclusive_prefix, with_positions
from probeline.plans import q1, q4, q14
from probeline.schema import relation, scaled
from probeline.session import shared_path
from probeline.sources import delimited, generators
from probeline.streaming.windowed import lookup_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


CENTS = {c: f"CAST(round({c} * 100) AS BIGINT)" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_retailprice")}
SUMMAND = f"{CENTS['l_extendedprice']} * (100 - {CENTS['l_discount']})"
MONTH = "l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01'"

# ------------------------------------------------------------- scans, filters


def _scan_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[scaled(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
        "l_returnflag", "l_linestatus", S.julian_day(F.col("l_shipdate")).alias("ship_day"),
    )


_add("scan_lineitem_fixed", _scan_lineitem, f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {', '.join(f'{CENTS[c]} AS {c}' for c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))},
       l_returnflag, l_linestatus, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + 2440588 AS INTEGER) AS ship_day FROM lineitem""")
_add("scan_part", lambda s, d: relation(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", scaled("p_retailprice").alias("p_retailprice")),
     f"SELECT p_partkey, p_name, p_brand, p_type, p_size, {CENTS['p_retailprice']} AS p_retailprice FROM part")


def _load_database(spark: SparkSession, d: str) -> DataFrame:
    from probeline.schema import register

    register(spark, d)
    return spark.sql("SELECT (SELECT count(*) FROM lineitem) AS n_lineitem, (SELECT count(*) FROM part) AS n_part, (SELECT count(*) FROM orders) AS n_orders")


_add("load_database", _load_database, "SELECT (SELECT count(*) FROM lineitem) AS n_lineitem, (SELECT count(*) FROM part) AS n_part, (SELECT count(*) FROM orders) AS n_orders")
_add("filter_shipdate_range", lambda s, d: q14.in_month(relation(s, d, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey"),
     f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE {MONTH}")
_add("filter_shipdate_le", lambda s, d: q1.shipped_until(relation(s, d, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey"),
     "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02'")
_add("filter_promo_prefix", lambda s, d: relation(s, d, "part").where(F.col("p_type").startswith("PROMO")).select("p_partkey", "p_type"),
     "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PROMO%'")


def _orders_quarter(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1995-07-01' AND o_orderdate < TIMESTAMP_NTZ '1995-10-01'").select("o_orderkey", "o_orderpriority")


_add("filter_orders_quarter", _orders_quarter, "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1995-07-01' AND o_orderdate < TIMESTAMP '1995-10-01'")
_add("filter_late_items", lambda s, d: relation(s, d, "lineitem").join(relation(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("o_orderdate < l_shipdate").groupBy("l_returnflag").agg(F.count("*").alias("n_late")),
     "SELECT l_returnflag, count(*) AS n_late FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < l_shipdate GROUP BY ALL")
_add("project_summand", lambda s, d: relation(s, d, "lineitem").select("l_orderkey", "l_linenumber", discounted(scaled("l_extendedprice"), scaled("l_discount")).alias("summand")),
     f"SELECT l_orderkey, l_linenumber, {SUMMAND} AS summand FROM lineitem")
_add("project_charge", lambda s, d: relation(s, d, "lineitem").select("l_orderkey", "l_linenumber", charged(scaled("l_extendedprice"), scaled("l_discount"), scaled("l_tax")).alias("charge")),
     f"SELECT l_orderkey, l_linenumber, {SUMMAND} * (100 + {CENTS['l_tax']}) AS charge FROM lineitem")
_add("materialize_partkey_summand", q14.summands, f"SELECT l_partkey, {SUMMAND} AS summand FROM lineitem WHERE {MONTH}")
_add("conditional_sum", lambda s, d: relation(s, d, "part").agg(F.sum(F.when(F.col("p_type").startswith("PROMO"), scaled("p_retailprice")).otherwise(0)).alias("promo"), F.sum(scaled("p_retailprice")).alias("total")),
     f"SELECT CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {CENTS['p_retailprice']} ELSE 0 END) AS BIGINT) AS promo, CAST(sum({CENTS['p_retailprice']}) AS BIGINT) AS total FROM part")

# ---------------------------------------------------------------------- Q14

_add("q14_hj", q14.part_build, q14.ORACLE)
_add("q14_lineitem_build", q14.lineitem_build, q14.ORACLE)
for _index in ("btree", "harmonia", "binary_search", "radix_spline"):
    _add(f"q14_ij_{_index}", lambda s, d, i=_index: q14.index_join(s, d, i), q14.ORACLE)
_add("q14_ij_bws", lambda s, d: q14.index_join(s, d, "btree", sort=True), q14.ORACLE)
_add("q14_ij_lookup_first", q14.lookup_first, q14.ORACLE)
_add("q14_ij_partitioning", lambda s, d: q14.index_join(s, d, "harmonia", partitioned=True), q14.ORACLE)
_add("q14_split", q14.split, q14.ORACLE)
_add("q14_ij_no_op", lambda s, d: q14.index_join(s, d, "no_op"), "SELECT CAST(0 AS BIGINT) AS numerator, CAST(0 AS BIGINT) AS denominator, CAST(NULL AS BIGINT) AS ratio")
_add("q14_validation", q14.validate, f"""
SELECT n AS n_lineitem, ratio, known, ratio = known AS valid FROM ({q14.ORACLE}), (SELECT n, CAST(CASE n {' '.join(f'WHEN {n} THEN {r}' for n, r in q14.KNOWN_RATIOS.items())} END AS BIGINT) AS known FROM (SELECT count(*) AS n FROM lineitem))""")
_add("q14_phases", lambda s, d: q14.phases(s, d)[0], q14.ORACLE)
_add("join_entries", lambda s, d: q14.join_entries(s, d).drop("row_id"), f"""
SELECT l_partkey, summand, pos AS part_pos FROM (SELECT l_partkey, {SUMMAND} AS summand FROM lineitem WHERE {MONTH})
JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) ON l_partkey = p_partkey""")

# ------------------------------------------------------------------- Q1, Q4

_Q1 = f"""
SELECT l_returnflag, l_linestatus, CAST(sum(q) AS BIGINT) AS sum_qty, CAST(sum(p) AS BIGINT) AS sum_base_price, CAST(sum(p * (100 - d)) AS BIGINT) AS sum_disc_price,
       CAST(sum(p * (100 - d) * (100 + t)) AS BIGINT) AS sum_charge, CAST(sum(q) // count(*) AS BIGINT) AS avg_qty, CAST(sum(p) // count(*) AS BIGINT) AS avg_price,
       CAST(sum(d) // count(*) AS BIGINT) AS avg_disc, count(*) AS count_order
FROM (SELECT l_returnflag, l_linestatus, {CENTS['l_quantity']} AS q, {CENTS['l_extendedprice']} AS p, {CENTS['l_discount']} AS d, {CENTS['l_tax']} AS t
      FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02') GROUP BY ALL ORDER BY 1, 2"""
_add("q1", q1.q1, _Q1)
_add("q1_counts", q1.q1_counts, "SELECT l_returnflag, l_linestatus, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
_add("q4", q4.q4, """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= TIMESTAMP '1995-07-01' AND o_orderdate < TIMESTAMP '1995-10-01'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY 1""")

# ------------------------------------------------------------------ lookups


def _probes(spark: SparkSession, d: str) -> DataFrame:
    """A probe an order, spread over and beyond the indexed keys: hits, gaps and misses past the end."""
    n = relation(spark, d, "part").count()
    return relation(spark, d, "orders").select(F.col("o_orderkey").alias("probe_id"), F.pmod(F.col("o_custkey") * 7 + F.col("o_orderkey"), F.lit(10 * n + 40)).alias("key"))


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth number, one a part: positions differ from keys and there are gaps."""
    return relation(spark, d, "part").select((F.col("p_partkey") * 10).alias("key"))


_PROBES = "SELECT o_orderkey AS probe_id, (o_custkey * 7 + o_orderkey) % (10 * (SELECT count(*) FROM part) + 40) AS key FROM orders"
_INDEXED = "SELECT p_partkey * 10 AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part"
_EXACT = f"SELECT probe_id, key, pos FROM ({_PROBES}) p LEFT JOIN ({_INDEXED}) i ON p.key = i.k"
_CEILING = f"SELECT probe_id, key, pos FROM ({_PROBES}) p ASOF LEFT JOIN ({_INDEXED}) i ON p.key <= i.k"

for _index in ("btree", "harmonia", "binary_search", "radix_spline"):
    _add(f"lookup_exact_{_index}", lambda s, d, i=_index: lookup(_probes(s, d), _indexed(s, d), i, "plain", "exact"), _EXACT)
    _add(f"lookup_ceiling_{_index}", lambda s, d, i=_index: lookup(_probes(s, d), _indexed(s, d), i, "plain", "ceiling"), _CEILING)
_add("lookup_exact_join", lambda s, d: lookup(_probes(s, d), _indexed(s, d), "btree", "join", "exact"), _EXACT)
_add("lookup_ceiling_join", lambda s, d: lookup(_probes(s, d), _indexed(s, d), "btree", "join", "ceiling"), _CEILING)
for _index, _search in (("btree", "galloping"), ("harmonia", "hinted"), ("binary_search", "galloping"), ("radix_spline", "hinted")):
    _add(f"lookup_ceiling_{_index}_{_search}", lambda s, d, i=_index, x=_search: lookup(_probes(s, d), _indexed(s, d), i, "plain", "ceiling", search=x), _CEILING)
_add("lookup_bws", lambda s, d: lookup(_probes(s, d), _indexed(s, d), "btree", "bws", "exact"), _EXACT)
_add("lookup_partitioning", lambda s, d: lookup(_probes(s, d), _indexed(s, d), "radix_spline", "partitioning", "ceiling"), _CEILING)
_add("lookup_no_op", lambda s, d: lookup(_probes(s, d), _indexed(s, d), "no_op"), f"SELECT probe_id, key, CAST(NULL AS BIGINT) AS pos FROM ({_PROBES})")
_add("lookup_windowed", lambda s, d: partitioning.with_window_id(lookup(_probes(s, d), _indexed(s, d), "btree", "partitioning", "exact", window=1000), 1000),
     f"SELECT probe_id, key, pos, probe_id // 1000 AS window_id FROM ({_EXACT})")
_add("lookup_stream", lambda s, d: lookup_stream(s, f"{d}/orders.parquet", _probes_of_stream(s, d), _indexed(s, d)), _EXACT)
_add("lookup_validation", lambda s, d: mismatches(lookup(_probes(s, d), _indexed(s, d), "harmonia", "plain", "exact"), _indexed(s, d)), "SELECT CAST(0 AS BIGINT) AS n_mismatches")


def _probes_of_stream(spark: SparkSession, d: str) -> Callable[[DataFrame], DataFrame]:
    n = relation(spark, d, "part").count()
    return lambda orders: orders.select(F.col("o_orderkey").alias("probe_id"), F.pmod(F.col("o_custkey") * 7 + F.col("o_orderkey"), F.lit(10 * n + 40)).alias("key"))


def _lookups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = relation(spark, d, "orders").select(F.col("o_orderkey").alias("probe_id"), (F.col("o_custkey") * 3).alias("key"))
    return items, relation(spark, d, "part").select((F.col("p_partkey") * 2).alias("key"))


_LOOKUPS = "(SELECT o_orderkey AS build_tid, o_custkey * 3 AS key FROM orders) r JOIN (SELECT p_partkey * 2 AS key FROM part) s USING (key)"
_add("hj_scatter_keys", lambda s, d: joins.scatter_keys(*_lookups(s, d)), f"SELECT build_tid, key FROM {_LOOKUPS}")
_add("hj_scatter_keys_auto", lambda s, d: joins.scatter_keys(*_lookups(s, d), build="auto"), f"SELECT build_tid, key FROM {_LOOKUPS}")
_add("hj_aggregate_only", lambda s, d: joins.sum_of_matches(*_lookups(s, d)), f"SELECT CAST(coalesce(sum(key), 0) AS BIGINT) AS key_sum, count(*) AS n FROM {_LOOKUPS}")
_add("hash_table_keep_one", lambda s, d: joins.keep_one(relation(s, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("value")), "key"),
     "SELECT l_partkey AS key, min(l_suppkey) AS value FROM lineitem GROUP BY 1")
_add("build_side_choice", lambda s, d: relation(s, d, "orders").agg(F.count("*").alias("r")).crossJoin(relation(s, d, "part").agg(F.count("*").alias("s"))).select(joins.build_side(F.col("r"), F.col("s")).alias("build"), F.greatest("r", "s").alias("probe_rows")),
     "SELECT CASE WHEN r < s THEN 'lookups' ELSE 'indexed' END AS build, greatest(r, s) AS probe_rows FROM (SELECT count(*) AS r FROM orders), (SELECT count(*) AS s FROM part)")

# ------------------------------------------------------------- partitioning


def _partkeys(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, "lineitem").select(F.col("l_partkey").alias("key"))


_HISTOGRAM = "SELECT CAST((l_partkey >> 4) & 127 AS INTEGER) AS pid, count(*) AS n FROM lineitem GROUP BY 1"
_OFFSETS = f'SELECT pid, n, CAST(coalesce(sum(n) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM ({_HISTOGRAM})'
_add("radix_histogram", lambda s, d: partitioning.histogram(_partkeys(s, d), "key", 7, 4), _HISTOGRAM)
_add("radix_offsets", lambda s, d: partitioning.offsets(_partkeys(s, d), "key", 7, 4), _OFFSETS)
_add("radix_partition", lambda s, d: partitioning.distribute(_partkeys(s, d), "key", 7, 4), "SELECT l_partkey AS key, CAST((l_partkey >> 4) & 127 AS INTEGER) AS pid FROM lineitem")
_add("radix_assign", lambda s, d: partitioning.assign_tasks(partitioning.histogram(_partkeys(s, d), "key", 7, 4), 8), f"""
WITH RECURSIVE h AS (SELECT pid, n, row_number() OVER (ORDER BY pid) AS i FROM ({_HISTOGRAM})), least AS (SELECT greatest(CAST(ceil(sum(n) / 8) AS BIGINT), 1) AS x FROM h),
t AS (SELECT i, pid, n, 0 AS task, n AS filled FROM h WHERE i = 1
      UNION ALL SELECT h.i, h.pid, h.n, CASE WHEN filled >= x THEN task + 1 ELSE task END, CASE WHEN filled >= x THEN h.n ELSE filled + h.n END FROM t JOIN h ON h.i = t.i + 1, least)
SELECT pid, n, CAST(least(task, 7) AS INTEGER) AS task FROM t""")
_add("probe_windows", lambda s, d: partitioning.with_window_id(_probes(s, d), 777).groupBy("window_id").agg(F.count("*").alias("n")),
     f"SELECT probe_id // 777 AS window_id, count(*) AS n FROM ({_PROBES}) GROUP BY 1")
_add("dataset_bits", lambda s, d: partitioning.dataset_bits(_partkeys(s, d)), "SELECT CAST(floor(log2(max(l_partkey))) AS INTEGER) AS max_bits FROM lineitem")

# ------------------------------------------------------ sorts, sets, positions

_add("sort_part", lambda s, d: relation(s, d, "part").select("p_partkey", "p_type").orderBy("p_partkey"), "SELECT p_partkey, p_type FROM part ORDER BY p_partkey")
_add("sort_lineitem", lambda s, d: relation(s, d, "lineitem").select("l_orderkey", "l_partkey", scaled("l_quantity").alias("l_quantity")).orderBy("l_orderkey"),
     f"SELECT l_orderkey, l_partkey, {CENTS['l_quantity']} AS l_quantity FROM lineitem ORDER BY l_orderkey")
_add("sort_lookups", lambda s, d: _probes(s, d).orderBy("key"), f"{_PROBES} ORDER BY key")
_add("sort_bit_range", lambda s, d: _probes(s, d).withColumn("bits", F.shiftright("key", 4)).sortWithinPartitions("bits"), f"SELECT probe_id, key, key >> 4 AS bits FROM ({_PROBES})")
_add("sort_first_column", lambda s, d: relation(s, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), "SELECT n_nationkey, n_name FROM nation")
_add("argsort", lambda s, d: with_positions(relation(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey"),
     "SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer")
_add("positions_part", lambda s, d: with_positions(_indexed(s, d), "key"), f"SELECT k AS key, pos FROM ({_INDEXED})")
_add("exclusive_prefix_sum", lambda s, d: exclusive_prefix(relation(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), "c_nationkey", "n"),
     'SELECT c_nationkey, n, CAST(coalesce(sum(n) OVER (ORDER BY c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)')
_add("distinct_partkeys", lambda s, d: relation(s, d, "lineitem").select("l_partkey").distinct(), "SELECT DISTINCT l_partkey FROM lineitem")


def _difference(spark: SparkSession, d: str, *plans: tuple[str, str, str]) -> DataFrame:
    """Two lookups of the same probes, each a row a probe, compared."""
    a, b = (lookup(_probes(spark, d), _indexed(spark, d), *plan) for plan in plans)
    return joins.difference(a, b, 2 * relation(spark, d, "orders").count())


_add("join_result_diff", lambda s, d: _difference(s, d, ("btree", "plain", "exact"), ("radix_spline", "bws", "exact")),
     f"SELECT probe_id, key, pos, 'left' AS side FROM ({_EXACT}) WHERE false")
_add("join_result_diff_semantics", lambda s, d: _difference(s, d, ("btree", "plain", "exact"), ("btree", "plain", "ceiling")),
     f"SELECT *, 'left' AS side FROM (({_EXACT}) EXCEPT ALL ({_CEILING})) UNION ALL SELECT *, 'right' AS side FROM (({_CEILING}) EXCEPT ALL ({_EXACT}))")

# ------------------------------------------------------------------- scalars


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, "orders").select(F.col("o_orderkey").alias("k"))


_M64 = "18446744073709551616"


def _wrapped(h: str, factor: int, bits: int) -> str:
    """The product modulo 2 ** bits, in halves that fit into UHUGEINT."""
    half = 1 << (bits // 2)
    return f"(({h} * {factor % half} + (({h} * {factor // half}) % {half}) * {half}) % {1 << bits})"


def _finaliser(key: str, bits: int, constants: tuple[int, ...]) -> str:
    steps = [f"SELECT k, CAST({key} AS UHUGEINT) AS h FROM (SELECT o_orderkey AS k FROM orders)"]
    for i, c in enumerate(constants):
        now = _wrapped("h", c, bits) if i % 2 else f"xor(h, h >> {c})"
        steps.append(f"SELECT k, CAST({now} AS UHUGEINT) AS h FROM ({steps[-1]})")
    return steps[-1]


_add("julian_day", lambda s, d: relation(s, d, "orders").select("o_orderkey", S.julian_day(F.col("o_orderdate")).alias("day")),
     "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588 AS INTEGER) AS day FROM orders")
_add("from_julian_day", lambda s, d: relation(s, d, "orders").select("o_orderkey", S.from_julian_day(F.lit(2440588) + F.pmod("o_orderkey", F.lit(20000))).alias("date")),
     "SELECT o_orderkey, DATE '1970-01-01' + CAST(o_orderkey % 20000 AS INTEGER) AS date FROM orders")
_add("date_text", lambda s, d: relation(s, d, "orders").select("o_orderkey", S.format_date(F.col("o_orderdate")).alias("text"), S.parse_date(F.concat(S.format_date(F.col("o_orderdate")), F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise(""))).alias("date")),
     "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS text, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders")
_add("murmur3_32", lambda s, d: _keys(s, d).select("k", S.murmur3_32("k").alias("h")), f"SELECT k, CAST(h AS BIGINT) AS h FROM ({_finaliser('k', 32, S._MIX32)})")
_add("murmur3_64", lambda s, d: _keys(s, d).select("k", S.murmur3_64("k").alias("h")),
     f"SELECT k, CAST(CASE WHEN h >= 9223372036854775808 THEN CAST(h AS HUGEINT) - {_M64} ELSE CAST(h AS HUGEINT) END AS BIGINT) AS h FROM ({_finaliser('k', 64, S._MIX64)})")
_add("round_pow2", lambda s, d: _keys(s, d).select("k", S.next_power_of_two(F.col("k")).alias("pow2"), S.table_capacity(F.col("k")).alias("capacity"), S.leading_zeros(F.col("k")).alias("zeros"), S.round_up(F.col("k"), 128).alias("up"), S.fanout(F.col("k") % 12).alias("fanout")), """
SELECT k, p AS pow2, CASE WHEN k = 0 THEN 1 ELSE 2 * p END AS capacity, CAST(64 - CASE WHEN k = 0 THEN 0 ELSE length(bin(k)) END AS INTEGER) AS zeros, (k + 127) // 128 * 128 AS up, CAST(1 AS BIGINT) << (k % 12) AS fanout
FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << length(bin(o_orderkey - 1)) END AS p FROM orders)""")
_add("saturating_ops", lambda s, d: _keys(s, d).select("k", S.saturating_add(F.col("k"), F.lit(500), 9000).alias("up"), S.floored_subtract(F.col("k"), F.lit(500)).alias("down")),
     "SELECT o_orderkey AS k, least(o_orderkey + 500, 9000) AS up, greatest(o_orderkey - 500, 0) AS down FROM orders")


def _numeric_text(spark: SparkSession, d: str) -> DataFrame:
    rows = relation(spark, d, "part").select("p_partkey", S.format_numeric(scaled("p_retailprice")).alias("text"))
    return rows.select("p_partkey", "text", S.parse_numeric(F.concat(F.lit("-"), "text")).alias("negative"), S.parse_numeric(F.concat("text", F.lit("?"))).alias("bad"), S.parse_unsigned(F.col("text").substr(1, 2)).alias("whole"))


_add("numeric_text", _numeric_text, f"""
SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS text, -{CENTS['p_retailprice']} AS negative, CAST(NULL AS BIGINT) AS bad,
       TRY_CAST(substr(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), 1, 2) AS BIGINT) AS whole FROM part""")
_add("string_functions", lambda s, d: relation(s, d, "part").select("p_partkey", S.fixed_width(F.col("p_name"), 5).alias("cut"), S.compare_prefix(F.col("p_type"), F.lit("PROMOTION"), 5).alias("order"), S.joined(F.col("p_brand"), F.col("p_type")).alias("joined")),
     "SELECT p_partkey, substr(p_name, 1, 5) AS cut, CAST(CASE WHEN substr(p_type, 1, 5) < 'PROMO' THEN -1 WHEN substr(p_type, 1, 5) > 'PROMO' THEN 1 ELSE 0 END AS INTEGER) AS \"order\", p_brand || ',' || p_type AS joined FROM part")
_add("interpolate", lambda s, d: _keys(s, d).select("k", F.round(S.interpolate(F.col("k"), F.lit(0), F.lit(10), F.lit(15000), F.lit(7510)) * 1000).cast("long").alias("y")),
     "SELECT o_orderkey AS k, CAST(round((10 + (o_orderkey - 0) * (7510 - 10) / 15000) * 1000) AS BIGINT) AS y FROM orders")


def _gather(spark: SparkSession, d: str) -> DataFrame:
    """Values fetched from positions that a hash of the row says."""
    n = 1 << (max(relation(spark, d, "part").count(), 1).bit_length() - 1)
    values = with_positions(relation(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("pos", "p_size")
    asks = _keys(spark, d).select(F.pmod(S.murmur3_64("k"), F.lit(n)).alias("pos"))
    return joins.hash_join(asks, values, "pos").agg(F.sum("p_size").alias("total"), F.count("*").alias("n"))


_add("gather_hashed", _gather, f"""
SELECT CAST(sum(p_size) AS BIGINT) AS total, count(*) AS n FROM (SELECT CAST(h % (SELECT CAST(CAST(1 AS BIGINT) << (length(bin(count(*))) - 1) AS UHUGEINT) FROM part) AS BIGINT) AS pos FROM ({_finaliser('k', 64, S._MIX64)}))
JOIN (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_size FROM part) USING (pos)""")
_add("gather_by_position", lambda s, d: joins.hash_join(q14.join_entries(s, d).select("part_pos", "summand"), with_positions(relation(s, d, "part").select("p_partkey", "p_type"), "p_partkey", "part_pos"), "part_pos").select("p_type", "summand"),
     f"SELECT p_type, {SUMMAND} AS summand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {MONTH}")
_add("minmax_key", lambda s, d: _indexed(s, d).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n")), "SELECT min(p_partkey * 10) AS min_key, max(p_partkey * 10) AS max_key, count(*) AS n FROM part")
_add("avg_partkey_filtered", lambda s, d: q14.summands(s, d).agg(F.expr("sum(l_partkey) div count(*)").alias("avg_partkey"), F.count("*").alias("n")),
     f"SELECT CAST(sum(l_partkey) // count(*) AS BIGINT) AS avg_partkey, count(*) AS n FROM lineitem WHERE {MONTH}")
_add("match_counter", lambda s, d: q14.in_month(relation(s, d, "lineitem")).agg(F.count("*").alias("n_matches"), F.max("l_partkey").alias("max_key")),
     f"SELECT count(*) AS n_matches, max(l_partkey) AS max_key FROM lineitem WHERE {MONTH}")
_add("partkey_histogram", lambda s, d: q14.summands(s, d).select(F.floor(F.col("l_partkey") / 100).alias("bin")).groupBy("bin").agg(F.count("*").alias("n")),
     f"SELECT l_partkey // 100 AS bin, count(*) AS n FROM lineitem WHERE {MONTH} GROUP BY 1")


def _index_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that each index takes over the part keys, besides the keys."""
    from probeline.operators.indexes import INDEXES, build_index
    from probeline.operators.lookup import sorted_keys

    keys = sorted_keys(_indexed(spark, d))
    return spark.createDataFrame([(name, len(keys), build_index(name, keys).nbytes) for name in INDEXES], "name string, n_keys long, n_bytes long")


_LEVELS = """SELECT '{name}' AS name, (SELECT count(*) FROM part) AS n_keys, CAST(coalesce(sum(8 * n), 0) AS BIGINT) AS n_bytes FROM (
WITH RECURSIVE l AS (SELECT count(*) AS n, 0 AS level FROM part UNION ALL SELECT (n + {fanout} - 1) // {fanout}, level + 1 FROM l WHERE n > {fanout}) SELECT n FROM l WHERE level > 0)"""
# evenly spaced keys are one segment: two knots with their places, and a cell of the radix table for each prefix and two more
_SPLINE = """SELECT 'radix_spline' AS name, n AS n_keys, CAST(32 + 8 * ((span >> greatest(0, length(bin(span)) - 12)) + 3) AS BIGINT) AS n_bytes FROM (SELECT count(*) AS n, max(p_partkey * 10) - min(p_partkey * 10) AS span FROM part)"""
_NOTHING = "SELECT '{name}' AS name, count(*) AS n_keys, CAST(0 AS BIGINT) AS n_bytes FROM part"
_add("index_bytes", _index_bytes, " UNION ALL ".join([
    _LEVELS.format(name="btree", fanout=496), _LEVELS.format(name="harmonia", fanout=32), _NOTHING.format(name="binary_search"), _SPLINE, _NOTHING.format(name="no_op")]))
_add("group_by_packed_chars", lambda s, d: relation(s, d, "lineitem").groupBy(S.packed_chars(F.col("l_returnflag"), F.col("l_linestatus")).alias("k")).agg(F.count("*").alias("n")),
     "SELECT CAST(ascii(l_returnflag) * 256 + ascii(l_linestatus) AS INTEGER) AS k, count(*) AS n FROM lineitem GROUP BY 1")

# ---------------------------------------------------------------- generators


def _hits(spark: SparkSession, dataset: str, pattern: str) -> DataFrame:
    """What a generated data set promises: sizes, different keys, and that every lookup hits."""
    indexed, lookups = generators.datasets(spark, dataset, pattern, 2000, 1500, seed=7)
    found = lookup(lookups, indexed, "btree", "plain", "exact")
    return found.agg(F.count("*").alias("n_lookups"), F.count("pos").alias("n_hits")).crossJoin(indexed.agg(F.count("*").alias("n_keys"), F.count_distinct("key").alias("n_distinct")))


_PROMISE = "SELECT CAST(1500 AS BIGINT) AS n_lookups, CAST(1500 AS BIGINT) AS n_hits, CAST(2000 AS BIGINT) AS n_keys, CAST(2000 AS BIGINT) AS n_distinct"
_add("gen_dense", lambda s, d: generators.dense_keys(s, 10_000), "SELECT CAST(range AS BIGINT) AS key FROM range(10000)")


def _promised(rows: DataFrame, least: int, limit: int) -> DataFrame:
    """What a generator promises of its own rows: how many, how many lie in their range, and whether they differ."""
    return rows.agg(F.count("*").alias("n"), F.count_if((F.col("key") >= least) & (F.col("key") < limit)).alias("n_in_range"), (F.count_distinct("key") == F.count("*")).alias("all_differ"))


_PROMISED = "SELECT CAST({n} AS BIGINT) AS n, CAST({n} AS BIGINT) AS n_in_range, {differ} AS all_differ"
_add("gen_sparse", lambda s, d: _promised(generators.sparse_keys(s, 10_000, max_bits=20, seed=3), 0, 2**19), _PROMISED.format(n=10_000, differ="true"))
_add("gen_uniform", lambda s, d: _promised(generators.uniform(s, 100_000, 5000, seed=3), 0, 5000), _PROMISED.format(n=100_000, differ="false"))
_add("gen_uniform_unique", lambda s, d: _promised(generators.unique_uniform(s, 3000, 5000, seed=3), 0, 5000), _PROMISED.format(n=3000, differ="true"))
_add("gen_zipf", lambda s, d: _promised(generators.zipf(s, 100_000, 5000, 1.25, seed=3), 1, 5000), _PROMISED.format(n=100_000, differ="false"))
for _dataset, _pattern in (("dense", "uniform"), ("dense", "uniform_unique"), ("dense", "zipf"), ("sparse", "uniform"), ("sparse", "uniform_unique"), ("sparse", "zipf")):
    _add(f"gen_lookups_{_dataset}_{_pattern}", lambda s, d, a=_dataset, b=_pattern: _hits(s, a, b), _PROMISE)
_add("sample_distinct", lambda s, d: generators.sample_distinct(relation(s, d, "part").select("p_partkey"), 50).agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("n_distinct")),
     "SELECT CAST(50 AS BIGINT) AS n, CAST(50 AS BIGINT) AS n_distinct")
_add("shuffle", lambda s, d: generators.shuffled(relation(s, d, "nation").select("n_nationkey")).agg(F.count_distinct("place").alias("places"), F.max("place").cast("long").alias("last"), F.sum("n_nationkey").alias("total")),
     "SELECT count(*) AS places, count(*) - 1 AS last, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation")
_add("shuffle_probes", lambda s, d: generators.shuffled(_probes(s, d)).agg(F.count_distinct("place").alias("places"), F.max("place").alias("last"), F.sum("key").alias("total")),
     f"SELECT count(*) AS places, count(*) - 1 AS last, CAST(sum(key) AS BIGINT) AS total FROM ({_PROBES})")

# ------------------------------------------------------------- text sources

_PART_TEXT = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DecimalType(15, 2))])


def _tbl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "probeline-text")
    delimited.write_tbl(relation(spark, d, "part").select("p_partkey", "p_name", "p_size", F.col("p_retailprice").cast("decimal(15,2)").alias("p_retailprice")), path)
    return delimited.read_tbl(spark, path, _PART_TEXT).select("p_partkey", "p_name", "p_size", (F.col("p_retailprice") * 100).cast("long").alias("cents"))


_add("tbl_roundtrip", _tbl_roundtrip, f"SELECT p_partkey, p_name, p_size, {CENTS['p_retailprice']} AS cents FROM part")


def _line_width(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "probeline-text")
    delimited.write_tbl(relation(spark, d, "part").select("p_partkey", "p_size"), path)
    return delimited.line_width(spark, path).select(F.round(F.col("avg_width") * 1000).cast("long").alias("width_x1000"), "n_lines")


_add("line_width", _line_width, "SELECT CAST(round(avg(length(CAST(p_partkey AS VARCHAR)) + length(CAST(p_size AS VARCHAR)) + 2) * 1000) AS BIGINT) AS width_x1000, count(*) AS n_lines FROM part")
_add("events_ceiling", lambda s, d: _events(s, d), """
SELECT event_id, pos FROM (SELECT event_id, user_id * 3 + 1 AS key FROM events) p ASOF LEFT JOIN (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) i ON p.key <= i.k""")


def _events(spark: SparkSession, d: str) -> DataFrame:
    probe = relation(spark, d, "events").select(F.col("event_id").alias("probe_id"), (F.col("user_id") * 3 + 1).alias("key"))
    found = lookup(probe, relation(spark, d, "customer").select(F.col("c_custkey").alias("key")), "radix_spline", "bws", "ceiling")
    return found.select(F.col("probe_id").alias("event_id"), "pos")


_add("running_place", lambda s, d: partitioning.running_offsets(relation(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey"),
     "SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place FROM customer")
