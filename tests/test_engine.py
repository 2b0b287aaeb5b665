"""Queries against DuckDB, plan shapes, lookups with misses, sources and generators."""

import collections
import decimal
import itertools
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from probeline.functions import scalars
from probeline.operators import joins, lookup, partitioning, positions
from probeline.plans import catalog, measure, q4, q14
from probeline.schema import LINEITEM, PART
from probeline.sources import delimited, generators

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(pdf: pd.DataFrame) -> list[tuple]:
    columns = sorted(pdf.columns)

    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) or v is pd.NA:
            return "null"
        if isinstance(v, int | float | np.number | decimal.Decimal):
            return str(int(v)) if float(v) == int(v) else str(v)
        return str(v)[:10] if hasattr(v, "year") else str(v)

    return sorted(tuple(plain(v) for v in r) for r in pdf[columns].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_query_against_sql(spark, small, duck, name):
    got, want = catalog.QUERIES[name](spark, small).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert catalog.QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark, small):
    assert "BroadcastHashJoin" in plan(q14.part_build(spark, small))
    assert "ShuffledHashJoin" in plan(q14.lineitem_build(spark, small))
    assert "MapInArrow" in plan(q14.index_join(spark, small, "btree"))
    partitioned = plan(q14.index_join(spark, small, "harmonia", partitioned=True))
    assert "MapInArrow" in partitioned and "hashpartitioning(pid" in partitioned
    assert "rangepartitioning(l_partkey" in plan(q14.split(spark, small))
    assert "LeftSemi" in plan(q4.q4(spark, small))
    assert "CartesianProduct" not in plan(lookup.lookup_by_join(catalog._probes(spark, small), catalog._indexed(spark, small), "ceiling"))


def test_scan_reads_what_it_needs(spark, small):
    text = q14.summands(spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate,1995-09-01" in text
    assert "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in text


def test_all_approaches_give_one_row(spark, small):
    found = {(name, index): tuple(f(spark, small, index).first()) for name, f in q14.APPROACHES.items() for index in ("btree", "radix_spline")}
    assert len(set(found.values())) == 1


def test_q14_without_rows(spark, tmp_path, small):
    for t in ("lineitem", "part"):
        spark.read.parquet(f"{small}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    for f in (q14.part_build, q14.lineitem_build, q14.lookup_first, q14.split):
        assert tuple(f(spark, str(tmp_path)).first()) == (0, 0, None)
    assert tuple(q14.index_join(spark, str(tmp_path), "harmonia").first()) == (0, 0, None)


EDGES = [0, 5, 10, 10, 30, 2**31, 2**32 + 1, 2**62]
ASKED = [0, 1, 5, 7, 10, 11, 31, 2**31, 2**31 + 1, 2**32, 2**62, 2**62 + 1, 10, None]


@pytest.mark.parametrize("semantics", ["exact", "ceiling"])
def test_every_strategy_on_edges(spark, semantics):
    indexed = spark.createDataFrame([(k,) for k in [*EDGES, None]], "key long").repartition(3)
    probe = spark.createDataFrame(list(enumerate(ASKED)), "probe_id long, key long").repartition(2)
    keys = np.array(EDGES)
    want = []
    for i, k in enumerate(ASKED):
        at = None if k is None else int(np.searchsorted(keys, k))
        want.append((i, k, at if k is not None and at < len(keys) and (semantics == "ceiling" or keys[at] == k) else None))
    for index, strategy in itertools.product(("btree", "harmonia", "binary_search", "radix_spline"), ("plain", "bws", "partitioning")):
        got = lookup.lookup(probe, indexed, index, strategy, semantics, window=3 if strategy == "partitioning" else 0)
        assert sorted(map(tuple, got.collect())) == want, (index, strategy)
    assert sorted(map(tuple, lookup.lookup(probe, indexed, "btree", "join", semantics).collect())) == want
    for few, many in ((probe.limit(0), indexed), (probe, indexed.limit(0))):
        for strategy in ("plain", "join"):
            assert {r.pos for r in lookup.lookup(few, many, "btree", strategy, semantics).collect()} <= {None}


def test_large_side_is_joined(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_KEYS", 3)
    df = lookup.lookup(spark.range(9).selectExpr("id as probe_id", "id * 3 as key"), spark.range(9).selectExpr("id * 2 as key"), "btree", "plain", "ceiling")
    assert "MapInArrow" not in plan(df)
    assert sorted((r.key, r.pos) for r in df.collect()) == [(k, -(-k // 2) if k <= 16 else None) for k in range(0, 27, 3)]


def test_validation_sees_faults(spark):
    indexed = spark.createDataFrame([(0,), (10,)], "key long")
    bad = spark.createDataFrame([(0, 10, 1), (1, 10, 0), (2, 0, None), (3, 4, None)], "probe_id long, key long, pos long")
    assert lookup.mismatches(bad, indexed).first().n_mismatches == 2


def test_positions_with_equal_keys(spark):
    df = spark.createDataFrame([(k,) for k in [5] * 40 + list(range(100))], "key long")
    got = positions.with_positions(df, "key", ranges=7).collect()
    assert sorted(r.pos for r in got) == list(range(140)) and [r.key for r in sorted(got, key=lambda r: r.pos)] == sorted(r.key for r in got)
    assert positions.with_positions(df.limit(0), "key").count() == 0


def test_tasks_and_windows(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([5, 1, 1, 9, 2, 2])], "pid int, n long")
    got = {r.pid: r.task for r in partitioning.assign_tasks(sizes, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 2}
    assert partitioning.assign_tasks(sizes.limit(0), 3).count() == 0
    probe = spark.range(10).selectExpr("id as probe_id")
    assert [partitioning.with_window_id(probe, w).agg(F.count_distinct("window_id")).first()[0] for w in (1, 3, 100)] == [10, 4, 1]
    with pytest.raises(ValueError):
        partitioning.with_window_id(probe, 0)


def test_join_difference(spark):
    a, b = spark.range(5).toDF("x"), spark.range(1, 6).toDF("x")
    assert sorted(map(tuple, joins.difference(a, b).collect())) == [(0, "left"), (5, "right")]


def test_join_difference_in_bounded_tasks(spark, monkeypatch):
    """More rows give more tasks, not larger ones, whatever the session's shuffle partitions; either side is read once."""
    monkeypatch.setattr(joins, "DIFFERENCE_ROWS", 500, raising=False)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    a, b = (spark.range(x, x + 8000, 1, 2).mapInArrow(counted, "id long") for x in (0, 8000))
    left = joins.difference(a, b, 16000)
    tasks = left.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r[1] for r in tasks) == 16000 and max(r[1] for r in tasks) <= 750
    assert read.value == 16000


def test_join_difference_counts_copies(spark, monkeypatch):
    """As EXCEPT ALL both ways: nulls are equal, copies count, and many copies don't need one long array."""
    monkeypatch.setattr(joins, "COPIES", 7, raising=False)
    sides = [[(1, None)] * 30 + [(None, "x")] * 2 + [(2, "y")], [(1, None)] * 9 + [(None, "x")] * 23 + [(2, "y"), (3, "")]]
    a, b = (spark.createDataFrame(rows, "`n` long, `c0.1` string") for rows in sides)
    for rows in (None, 66):
        found = joins.difference(a, b, rows)
        assert found.columns == ["n", "c0.1", "side"]
        assert collections.Counter(map(tuple, found.collect())) == {(1, None, "left"): 21, (None, "x", "right"): 21, (3, "", "right"): 1}
    assert joins.difference(a, a).count() == 0 and joins.difference(a.limit(0), b.limit(0)).count() == 0


# ------------------------------------------------------------------ sources


def test_text_tables(spark, tmp_path):
    part = "1|name|m|b|PROMO X|3|c|17.5|comment|\n2|n2|m|b|SMALL|4|c|-3.00|last|\n3|n3|m|b|LARGE|5|c|17|no newline|"
    (tmp_path / "part.tbl").write_text(part)
    got = delimited.read_tbl(spark, str(tmp_path / "part.tbl"), PART).collect()
    assert [str(r.p_retailprice) for r in got] == ["17.50", "-3.00", "17.00"] and got[2].p_comment == "no newline"
    (tmp_path / "bad.tbl").write_text(part + "\nx|bad|\n4|n4|m|b|T|notanumber|c|1.00|c|\n")
    assert len(delimited.read_tbl(spark, str(tmp_path / "bad.tbl"), PART, "DROPMALFORMED").collect()) == 3
    kept = delimited.read_tbl(spark, str(tmp_path / "bad.tbl"), PART, "PERMISSIVE")
    assert kept.cache().where("_corrupt is not null").count() == 2 and kept.count() == 5
    with pytest.raises(Exception):
        delimited.read_tbl(spark, str(tmp_path / "bad.tbl"), PART).collect()
    item = "1|2|3|4|17.00|100.10|0.04|0.02|N|O|1996-03-13|1996-02-12|1996-03-22|DELIVER|TRUCK|c|\n"
    (tmp_path / "lineitem.tbl").write_text(item)
    tables = delimited.load_database(spark, str(tmp_path))
    assert str(tables["lineitem"].first().l_receiptdate) == "1996-03-22" and tables["lineitem"].schema == LINEITEM
    assert delimited.line_width(spark, str(tmp_path / "lineitem.tbl")).first().n_lines == 1


def test_measurements(spark, tmp_path):
    path = str(tmp_path / "m.json")
    seen = measure.measure(lambda: 7, repetitions=3, warmups=1, validate=lambda x: x == 7)
    assert len(seen.seconds) == 3 and seen.offsets == sorted(seen.offsets) and seen.median >= seen.best
    with pytest.raises(AssertionError):
        measure.measure(lambda: 8, repetitions=1, validate=lambda x: x == 7)
    delimited.append_measurement(spark, path, {"name": "q", **seen.record()})
    delimited.append_measurement(spark, path, {"name": "q", **seen.record()})
    assert spark.read.json(path).count() == 2


def test_command_line(spark, small, capsys):
    from probeline import cli

    assert cli.main(["q14", small, "-a", "hj"]) == 0
    assert cli.main(["lookup", "-e", "2000", "-l", "500", "-i", "harmonia", "-a", "partitioning", "-d", "sparse", "-p", "zipf", "-w", "100"]) == 0
    assert cli.main(["q1", small]) == 0
    assert "ratio" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["lookup", "-i", "nope"])


# --------------------------------------------------------------- generators


def test_generators(spark):
    assert sorted(r.key for r in generators.unique_uniform(spark, 90, 100, 1).collect()) == sorted({r.key for r in generators.unique_uniform(spark, 90, 100, 1).collect()})
    for n, limit in ((90, 100), (100, 10_000), (5, 5)):
        got = [r.key for r in generators.unique_uniform(spark, n, limit, 2).collect()]
        assert len(set(got)) == n and all(0 <= k < limit for k in got)
    sparse = [r.key for r in generators.sparse_keys(spark, 300, seed=4).collect()]
    assert sparse == sorted(set(sparse)) and len(sparse) == 300
    assert all(0 <= r.key < 7 for r in generators.uniform(spark, 500, 7, 1).collect())
    for bad in (lambda: generators.unique_uniform(spark, 6, 5), lambda: generators.sparse_keys(spark, 300, 8), lambda: generators.datasets(spark, "x", "zipf", 1, 1), lambda: generators.datasets(spark, "dense", "uniform_unique", 5, 6)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("exponent", [0.8, 1.0, 1.25, 2.0])
def test_zipf_follows_its_law(exponent):
    got = np.bincount(generators.zipf_ranks(np.random.default_rng(0), 200_000, 50, exponent), minlength=51)[1:]
    law = np.arange(1, 51) ** -exponent
    assert np.abs(got / got.sum() - law / law.sum()).max() < 0.01
    assert got.sum() == 200_000


def test_zipf_never_draws_position_0(spark):
    keys = [r.key for r in generators.zipf(spark, 70_000, 10, 1.25, 3).collect()]
    assert min(keys) == 1 and max(keys) <= 9 and len(keys) == 70_000


# ------------------------------------------------------------------ scalars


def test_scalars(spark):
    df = spark.createDataFrame([("17",), ("17.5",), ("17.50",), ("-3.00",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.parse_numeric(F.col("t"))).collect()] == [1700, 1750, 1750, -300, None, None]
    assert [r[0] for r in df.select(scalars.parse_unsigned(F.col("t"))).collect()] == [17, None, None, None, None, None]
    assert [r[0] for r in spark.createDataFrame([(5,), (-5,), (0,), (123456,)], "c long").select(scalars.format_numeric(F.col("c"))).collect()] == ["0.05", "-0.05", "0.00", "1234.56"]
    day = spark.range(1).select(scalars.julian_day(F.lit("1995-09-01")), scalars.from_julian_day(F.lit(2449962)).cast("string"), scalars.parse_date(F.lit("1995-13-01"))).first()
    assert tuple(day) == (2449962, "1995-09-01", None)
    keys = spark.createDataFrame([(0,), (1,), (2,), (3,)], "k long")
    assert [r[0] for r in keys.select(scalars.murmur3_64("k")).collect()] == [0, -5451962507482445012, 4233148493373801447, 815575690806614222]


def test_shuffled_numbers_rows_without_one_task(spark):
    from probeline.sources import generators

    out = generators.shuffled(spark.range(5000).repartition(7), seed=1)
    places = [r.place for r in out.orderBy("id").collect()]
    assert sorted(places) == list(range(5000)) and places != list(range(5000))
    assert "windowspecdefinition(_range" in out._jdf.queryExecution().analyzed().toString()


def test_no_op_index_finds_nothing_above_the_broadcast_limit(spark, small, monkeypatch):
    from probeline.plans import q14

    monkeypatch.setattr(q14, "BROADCAST_KEYS", 0)
    for plan in (q14.index_join, q14.split):
        assert [tuple(r) for r in plan(spark, small, "no_op").collect()] == [(0, 0, None)]


# ------------------------------------------------- known results, choices, metrics


def test_known_ratios(spark, small):
    sizes = spark.createDataFrame([(n,) for n in (6001215, 59986052, 59986050, 7)], "n long")
    got = {r.n: r.known for r in sizes.select("n", q14.known_ratio(F.col("n")).alias("known")).collect()}
    assert got == {6001215: 16380778, 59986052: 16647594, 59986050: 16647594, 7: None}
    assert q14.validate(spark, small).first().valid is None


def test_build_side_is_obeyed(spark, small):
    few, many = spark.range(10).select(F.col("id").alias("key")), spark.range(1000).select(F.col("id").alias("probe_id"), (F.col("id") % 20).alias("key"))
    results, sides = [], []
    for side in ("lookups", "indexed", "auto"):
        df = joins.scatter_keys(many, few, side)
        results.append(sorted(map(tuple, df.collect())))
        sides.append("BuildLeft" if "BuildLeft" in plan(df) else "BuildRight" if "BuildRight" in plan(df) else "")
    assert results[0] == results[1] == results[2] and len(results[0]) == 500
    assert "ShuffledHashJoin" in plan(joins.scatter_keys(many, few, "auto")) and all(sides)
    assert spark.range(1).select(joins.build_side(3, 4)).first()[0] == "lookups" and spark.range(1).select(joins.build_side(4, 4)).first()[0] == "indexed"
    with pytest.raises(ValueError):
        joins.scatter_keys(many, few, "both")


def test_broadcasts_are_checked_by_bytes(spark):
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    assert joins.small_enough(wide) and not joins.small_enough(wide, size=50_000) and not joins.small_enough(wide, rows=99)
    assert joins.small_enough(spark.range(100).toDF("id"), size=50_000)


def test_phases_are_counted(spark, small):
    result, seen = q14.phases(spark, small)
    assert result.first().asDict() == q14.part_build(spark, small).first().asDict()
    n = q14.summands(spark, small).count()
    assert seen["scan"].get["rows"] == n and seen["lookup"].get["rows"] == n and seen["scan"].get["least"] <= seen["scan"].get["most"]


def test_lookup_first_reads_lineitem_once(spark, small):
    assert plan(q14.join_entries(spark, small)).count("lineitem.parquet") == 1 and "Join" not in plan(q14.join_entries(spark, small))


@pytest.mark.parametrize("semantics", ["exact", "ceiling"])
def test_payload_comes_along(spark, monkeypatch, semantics):
    probe = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 10, None), (4, 99, "d")], "probe_id long, key long, text string")
    indexed = spark.createDataFrame([(0,), (10,), (20,)], "key long")
    got = lookup.lookup(probe, indexed, "btree", "bws", semantics, payload=("text",))
    assert got.columns == ["probe_id", "key", "pos", "text"]
    want = sorted(map(tuple, got.collect()), key=str)
    monkeypatch.setattr(lookup, "BROADCAST_KEYS", 1)
    assert sorted(map(tuple, lookup.lookup(probe, indexed, "btree", "bws", semantics, payload=("text",)).collect()), key=str) == want


def test_a_key_that_fills_ranges_is_dealt_out(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("key"), "id")
    placed = positions.with_positions(df, "key").collect()
    assert sorted(r.pos for r in placed) == list(range(4000))
    assert [r.key for r in sorted(placed, key=lambda r: r.pos)] == sorted(r.key for r in placed)


def test_experiment_description(spark):
    assert [measure.config_text(x) for x in (True, None, 3, "x")] == ["true", "", "3", "x"]
    seen = measure.experiment(spark, index="btree", sort=False)
    assert seen["index"] == "btree" and seen["sort"] == "false" and seen["master"] == spark.sparkContext.master and int(seen["cores"]) > 0


def test_large_samples_have_no_single_task(spark):
    df = generators.sample_distinct(spark.range(5000).toDF("key"), 4000, 3)
    assert df.count() == df.distinct().count() == 4000 and "TakeOrdered" not in plan(df) and "GlobalLimit" not in plan(df)
    assert sorted(df.collect()) == sorted(generators.sample_distinct(spark.range(5000).toDF("key"), 4000, 3).collect())


def test_shared_paths_go_with_the_driver(tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from probeline.session import shared_path
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
spark.range(5).write.parquet(shared_path(spark, "gone"))
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True)
    for _ in range(100):  # the JVM ends a little after its driver
        if not [*tmp_path.glob("probeline-*")]:
            break
        time.sleep(0.2)
    assert not [*tmp_path.glob("probeline-*")]
