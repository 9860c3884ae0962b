"""The library's own operators on small frames with nulls, duplicates and empty inputs."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemill import testkit
from tidemill.operators.relational import as_of, range_join, salted_join, top_per_group
from tidemill.versioned.sql import Tokens, run
from tidemill.versioned.table import AmbiguousMerge, ConcurrentWrite, VersionedTable


def test_as_of(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), (None, 5)], "g string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 40), ("b", 6, 60), (None, 2, 99)], "g string, t int, v int")
    got = {(r.g, r.t): r.v for r in as_of(left, right, ["g"], "t", "t", ["v"]).collect()}
    assert got[("a", 1)] == 10 and got[("a", 5)] == 40 and got[("b", 5)] is None
    assert as_of(left.limit(0), right, ["g"], "t", "t", ["v"]).count() == 0


def test_range_join(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 9.99), (3, 10.0), (4, None)], "k int, x double")
    spans = spark.createDataFrame([("p", 0.0, 10.0), ("q", 9.0, 30.0), ("empty", 5.0, 5.0)], "n string, a double, b double")
    assert {(r.k, r.n) for r in range_join(points, spans, "x", "a", "b", 4.0).collect()} == {(1, "p"), (2, "p"), (2, "q"), (3, "q")}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    large = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7), (None, 8)], "k int, v int")
    other = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "k int, w string")
    assert sorted(map(str, salted_join(large, other, ["k"], 4, how).collect())) == sorted(map(str, large.join(other, ["k"], how).collect()))


def test_top_per_group(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", None), (None, 4)], "g string, v int")
    assert {tuple(r) for r in top_per_group(df, ["g"], [F.desc("v")], 2).collect()} == {("a", 3), ("a", 2), ("b", None), (None, 4)}


def test_group_limit_is_planned(spark, data):
    from tidemill import registry

    plan = registry.queries()["rel_top_per_group"](spark, data)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_filters_and_columns_reach_the_scan(spark, data):
    from tidemill import registry

    plan = registry.queries()["rel_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_discount:double>" in plan


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n")], "id int, v string")
    return VersionedTable.create(df, str(tmp_path / "t"))


def content(table, **at):
    return sorted((tuple(r) for r in table.to_df(**at).collect()), key=repr)


def test_versions(spark, table):
    assert table.delete("id = 2") == 1
    assert table.update("v IS NULL", {"v": "'filled'"}) == 2
    assert content(table) == sorted([(1, "a"), (3, "filled"), (None, "n")], key=repr)
    assert len(content(table, version=0)) == 4
    table.restore(0)
    assert len(content(table)) == 4
    assert [r.operation for r in table.history().collect()] == ["RESTORE", "UPDATE", "DELETE", "CREATE"]
    with pytest.raises(AnalysisException):
        table.to_df(version=9)
    with pytest.raises(AnalysisException):
        table.update(None, {"nope": "1"})


def test_many_versions(table, spark):
    for i in range(12):
        table.append(spark.createDataFrame([(i + 10, "x")], "id int, v string"))
    assert table.to_df().count() == 16
    assert table.to_df(version=11).count() == 15


def test_merge(spark, table):
    source = spark.createDataFrame([(1, "new"), (5, "five"), (None, "never matches")], "id int, v string")
    table.alias("t").merge(source, "t.id = s.id", "s").when_matched_update_all().when_not_matched_insert_all("s.id IS NOT NULL").when_not_matched_by_source_delete("t.id = 3").execute()
    assert content(table) == sorted([(1, "new"), (2, "b"), (5, "five"), (None, "n")], key=repr)


def test_merge_ambiguous(spark, table):
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "id int, v string")
    with pytest.raises(AmbiguousMerge):
        table.alias("t").merge(twice, "t.id = s.id", "s").when_matched_update_all().execute()
    table.alias("t").merge(twice, "t.id = s.id", "s").when_matched_update_all("s.v = 'z'").execute()
    assert len(content(table)) == 4


def test_untouched_files_stay(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id div 25 AS part")
    t = VersionedTable.create(df.repartitionByRange(4, "id"), str(tmp_path / "many"))
    before = set(t.log.state().files)
    t.delete("id = 3")
    assert len(before - set(t.log.state().files)) == 1


def test_concurrent_writers(spark, table):
    state = table.log.state()
    table.append(spark.createDataFrame([(9, "z")], "id int, v string"))
    with pytest.raises(ConcurrentWrite):
        table._commit(state, "WRITE", {}, [])


def test_vacuum(spark, table):
    table.update("id = 1", {"v": "'q'"})
    gone = table.vacuum(0, dry_run=True)
    assert gone and table.vacuum(0) == gone
    assert len(content(table)) == 4
    with pytest.raises(AnalysisException):
        table.restore(0)


def test_empty_versioned(spark, tmp_path):
    t = VersionedTable.create(spark.createDataFrame([], "id int"), str(tmp_path / "e"))
    assert t.to_df().count() == 0
    t.delete("id = 1")
    t.update(None, {"id": "2"})
    t.alias("t").merge(spark.range(2).selectExpr("CAST(id AS INT) AS id"), "t.id = s.id", "s").when_not_matched_insert_all().execute()
    assert t.to_df().count() == 2


def test_tokens():
    t = Tokens("UPDATE t SET a = CASE WHEN b THEN 'x, WHERE' END, c = f(1, 2) WHERE d = 1")
    t.need("UPDATE")
    t.name()
    t.need("SET")
    assert t.assignments(t.until(("WHERE",))) == {"a": "CASE WHEN b THEN 'x, WHERE' END", "c": "f(1, 2)"}
    assert t.take("WHERE") and t.rest() == "d = 1"


def test_sql_time_travel_with_aliases(spark):
    run(spark, "CREATE TABLE vt USING versioned AS SELECT 1 AS a UNION ALL SELECT 2")
    run(spark, "DELETE FROM vt WHERE a = 1")
    rows = run(spark, "SELECT old.a, now.a AS b FROM vt VERSION AS OF 0 AS old LEFT JOIN vt now ON old.a = now.a ORDER BY 1").collect()
    assert [tuple(r) for r in rows] == [(1, None), (2, 2)]
    run(spark, "DROP TABLE vt")
    assert not VersionedTable.exists(spark, "vt")


def test_testkit(spark):
    df = testkit.generated(spark, "a int, s string, d date, x array<double>", 200, seed=3, null_share=0.2)
    testkit.assert_rows(df, 200)
    testkit.assert_columns(df, "a", "s", "d", "x")
    testkit.assertDataFrameEqual(df, testkit.generated(spark, "a int, s string, d date, x array<double>", 200, seed=3, null_share=0.2))
    assert 0 < df.where("a is null").count() < 100
    assert testkit.corrupted(df, 0.5).where("s is null").count() > 50
    checked = testkit.validated(spark.createDataFrame([(1, "x"), (-1, ""), (None, "y")], "n int, s string"), {"n": ["positive"], "s": ["non_empty", ("one_of", "x", "y")]})
    assert [r.failed for r in checked.collect()] == [[], ["n", "s"], ["n"]]
    assert [r.n for r in testkit.coerced(spark.createDataFrame([("1",), ("z",)], "n string"), "n int").collect()] == [1, None]


def test_faults(spark):
    with testkit.Faults(spark).fail("table", RuntimeError("down"), when=lambda name: name == "t"), pytest.raises(RuntimeError):
        spark.table("t")
    with testkit.timed() as t:
        spark.range(1).count()
    assert t["seconds"] > 0


def test_functions_exist_in_the_api():
    from tidemill.functions import scalar

    known = scalar.names()
    assert len(known) > 280


def test_versioned_counts_conflicts_and_failed_renames(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "50%"), (4, "50%"), (5, None)], "id int, part string").repartition(3)
    t = VersionedTable.create(df, str(tmp_path / "t"), ["part"])
    assert t.detail().first().numRows == 5
    t.update("part = '50%'", {"id": "id + 10"})
    assert sorted(r.id for r in t.to_df().collect()) == [1, 2, 5, 13, 14] and t.detail().first().numRows == 5
    state = t.log.state()
    t.delete("id = 1")
    with pytest.raises(ConcurrentWrite):
        t._commit(state, "WRITE", {}, [])
    t.optimize().z_order_by("id", "part")
    assert sorted(r.id for r in t.to_df().collect()) == [2, 5, 13, 14]
    with pytest.raises(ValueError):
        t.alias("t").merge(df, "t.id = s.id", "s").whenNotMatched().delete()
