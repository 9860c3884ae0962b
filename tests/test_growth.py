"""Work and memory of a query grow no faster than its input: the steps that would."""

import re

import pytest
from pyspark.sql import functions as F

from tidemill import registry
from tidemill.operators import aggregates, relational
from tidemill.versioned import table


def test_functions_over_groups_are_called_by_batches(spark, data, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    f = aggregates.below_top

    def counted(pdf):
        with calls.open("a") as out:
            out.write("x")
        return f(pdf)

    monkeypatch.setattr(aggregates, "below_top", counted)
    n = registry.queries()["grouped_apply_in_pandas"](spark, data).count()
    groups = spark.read.parquet(f"{data}/orders.parquet").select("o_custkey").distinct().count()
    assert n == 1500 and len(calls.read_text()) <= 2 < groups


@pytest.mark.parametrize("rows", [1, 3, 50_000])
def test_batches_hold_whole_groups(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(aggregates, "BATCH_ROWS", rows)
    big = 1 << 60
    orders = spark.createDataFrame(
        [(1, big, 5.0), (2, big, 7.0), (3, big + 1, 1.0), (4, None, 2.0), (5, None, 6.0), (6, -3, None), (None, -3, 4.0), (8, 9, None)],
        "o_orderkey long, o_custkey long, o_totalprice double",
    )
    orders.repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    got = registry.queries()["grouped_apply_in_pandas"](spark, str(tmp_path)).collect()
    assert {(r.o_orderkey, r.v) for r in got} == {(1, 2.0), (2, 0.0), (3, 0.0), (4, 4.0), (5, 0.0), (6, None), (None, 0.0), (8, None)} and len(got) == 8
    got = registry.queries()["grouped_apply_in_arrow"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(big, 2), (big + 1, 1), (None, 2), (-3, 2), (9, 1)], key=repr)
    orders.limit(0).write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    assert registry.queries()["grouped_apply_in_pandas"](spark, str(tmp_path)).count() == 0


def files(spark, t):
    return [r["count"] for r in t.to_df().groupBy(F.input_file_name()).count().collect()]


def test_optimize_bounds_what_a_task_sorts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(table, "FILE_ROWS", 100, raising=False)
    rows = spark.range(1000).selectExpr("id", "if(id < 900, 7, id) AS often", "if(id % 2 = 0, NULL, CAST(id AS STRING)) AS s").repartition(3)
    t = table.VersionedTable.create(rows, str(tmp_path / "t"))
    whole = sorted(map(str, t.to_df().collect()))
    t.optimize().z_order_by("often")
    assert len(files(spark, t)) == 10 and max(files(spark, t)) <= 200
    assert sorted(map(str, t.to_df().collect())) == whole
    t.optimize().execute_compaction()
    assert len(files(spark, t)) == 10 and max(files(spark, t)) <= 200
    assert sorted(map(str, t.to_df().collect())) == whole
    monkeypatch.setattr(table, "FILE_ROWS", 1000)
    t.optimize().execute_compaction()
    assert files(spark, t) == [1000]
    monkeypatch.setattr(table, "FILE_BYTES", 1000)
    t.optimize().z_order_by("id", "s")
    assert len(files(spark, t)) > 2 and sorted(map(str, t.to_df().collect())) == whole


@pytest.mark.parametrize("name", ["approx_count_distinct", "approxCountDistinct"])
def test_no_sketch_for_each_distinct_value(spark, data, name):
    plan = registry.queries()[f"agg_{name}"](spark, data)._jdf.queryExecution().executedPlan().toString()
    sketches = [re.search(r"keys=\[(.*?)\]", x)[1] for x in plan.splitlines() if "approx_count_distinct(" in x and "keys=" in x]
    assert sketches and not any("key#" in keys for keys in sketches)


def test_estimates_beside_nulls(spark, tmp_path):
    rows = [("A", 1, 1), ("A", 1, 2), ("A", None, 1), ("N", None, None), (None, 3, 4)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("agg_approx_count_distinct", "agg_approxCountDistinct"):
        got = registry.queries()[name](spark, str(tmp_path)).collect()
        assert {tuple(r) for r in got} == {("A", True), ("N", True), (None, True)} and len(got) == 3


def test_range_join_deals_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(relational, "CELL_ROWS", 50, raising=False)
    points = spark.range(2000).selectExpr("id AS k", "if(id % 100 = 0, NULL, 900 + id % 10) AS x", "if(id % 7 = 0, NULL, id % 2) AS g")
    spans = spark.range(300).selectExpr("id AS n", "880.0D + id % 40 AS a", "881.0D + id % 45 AS b", "if(id % 5 = 0, NULL, id % 2) AS g")
    got = relational.range_join(points, spans.drop("g"), "x", "a", "b", 50.0).select("k", "n")
    want = points.join(spans, (points.x >= spans.a) & (points.x < spans.b)).select("k", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 1000
    sizes = [n for (n,) in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 20 and max(sizes) < sum(sizes) / 4
    got = relational.range_join(points, spans, "x", "a", "b", 50.0, ["g"]).select("k", "n")
    want = points.join(spans, (points.g == spans.g) & (points.x >= spans.a) & (points.x < spans.b)).select("k", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["last_value", "sum_range_frame"])
def test_frames_are_carried_on(spark, tmp_path, name):
    rows = [(k % 3 or None, k // 2, k % 7 if k % 5 else None, k * k % 11 if k % 4 else None, f"2000-01-{k % 9 + 1:02}" if k % 8 else None) for k in range(90)]
    table = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, d string")
    table.selectExpr("*", "CAST(d AS TIMESTAMP) AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = registry.queries()[f"win_{name}"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().analyzed().toString()
    frames = re.findall(r"specifiedwindowframe\(\w+, (\S+?\$?(?:\(\))?), ", plan)
    assert frames and set(frames) == {"unboundedpreceding$()"}
    found = next(w for w in aggregates.WINDOWS if w[0] == name)
    stated = spark.read.parquet(str(tmp_path / "lineitem.parquet")).selectExpr("l_orderkey", "l_linenumber", f"{found[1]} {found[2]} AS v")
    assert sorted(map(str, df.collect())) == sorted(map(str, stated.collect()))


@pytest.mark.parametrize("kept", [0, 1, 10_000])
def test_exact_quantiles(spark, monkeypatch, kept):
    monkeypatch.setattr(relational, "KEPT_ROWS", kept, raising=False)
    p = [0.0, 0.25, 0.3, 0.5, 0.75, 1.0]
    df = spark.range(4000).selectExpr("CAST(id * 7919 % 4001 AS DOUBLE) AS `a.b`", "CAST(id % 2 AS INT) AS two", "if(id % 3 = 0, NULL, if(id % 3 = 1, double('NaN'), double(id))) AS holed", "5 AS same", "CAST(NULL AS INT) AS none")
    for c in ("a.b", "two", "holed", "same"):
        assert relational.exact_quantiles(df, c, p) == df.approxQuantile(f"`{c}`", p, 0.0)
    assert relational.exact_quantiles(df, "none", p[:2]) == [None, None]


@pytest.mark.parametrize("name", ["frame_approx_quantile", "frame_stat_approx_quantile"])
def test_no_sketch_of_all_values(spark, data, name, monkeypatch):
    asked, f = [], type(spark.range(1)).approxQuantile
    monkeypatch.setattr(type(spark.range(1)), "approxQuantile", lambda df, c, p, error: asked.append(error) or f(df, c, p, error))
    assert None not in registry.queries()[name](spark, data).first() and 0.0 not in asked
