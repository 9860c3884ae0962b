"""Sources and sinks: each format written and read again, save modes, partitioned and bucketed tables, the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..registry import query
from ..tables import load, shared_dir, views

NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def place(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


for _format, _write, _read in (
    ("parquet", {}, {}),
    ("orc", {}, {}),
    ("json", {}, {}),
    ("csv", {"header": "true"}, {"header": "true"}),
    ("xml", {"rowTag": "n"}, {"rowTag": "n"}),
):

    @query(f"io_{_format}", NATION)
    def _(spark, d, fmt=_format, write=_write, read=_read):
        """The schema is given, so that nothing is inferred by another pass."""
        nation, path = load(spark, d, "nation"), place(spark, fmt)
        nation.write.format(fmt).options(**write).save(path)
        return spark.read.format(fmt).schema(nation.schema).options(**read).load(path).select("n_nationkey", "n_name", "n_regionkey")


@query("io_text", "SELECT n_name AS value FROM nation")
def _(spark, d):
    path = place(spark, "text")
    load(spark, d, "nation").select("n_name").write.text(path)
    return spark.read.text(path)


@query("io_partitioned", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def _(spark, d):
    path = place(spark, "partitioned")
    load(spark, d, "nation").write.partitionBy("n_regionkey").parquet(path)
    return spark.read.parquet(path).where("n_regionkey = 2").select("n_nationkey", "n_name", F.col("n_regionkey").cast("int"))


@query("io_modes", "SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation")
def _(spark, d):
    nation, path = load(spark, d, "nation").select("n_nationkey"), place(spark, "modes")
    nation.limit(3).write.mode("errorifexists").parquet(path)
    nation.write.mode("overwrite").parquet(path)
    nation.write.mode("append").parquet(path)
    nation.write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


@query("io_bucketed_join", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(spark, d):
    """Both tables are written in buckets of their key: the join needs no shuffle."""
    names = [f"b_{uuid.uuid4().hex[:12]}" for _ in range(2)]
    load(spark, d, "orders").select("o_orderkey").write.bucketBy(8, "o_orderkey").sortBy("o_orderkey").saveAsTable(names[0])
    load(spark, d, "lineitem").select("l_orderkey", "l_linenumber").write.bucketBy(8, "l_orderkey").sortBy("l_orderkey").saveAsTable(names[1])
    a, b = spark.table(names[0]), spark.table(names[1])
    return a.join(b, a.o_orderkey == b.l_orderkey).select("o_orderkey", "l_linenumber")


@query("io_save_as_table", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 9, 'x'")
def _(spark, d):
    name = f"s_{uuid.uuid4().hex[:12]}"
    load(spark, d, "region").write.saveAsTable(name)
    spark.range(1).selectExpr("9 AS r_regionkey", "'x' AS r_name").write.insertInto(name)
    return spark.table(name)


@query("io_write_to", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    name = f"w_{uuid.uuid4().hex[:12]}"
    load(spark, d, "region").writeTo(name).using("parquet").create()
    return spark.read.table(name)


@query("cat_databases", "SELECT true AS there, true AS current")
def _(spark, d):
    name = f"db_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name}")
    try:
        there = name in {x.name for x in spark.catalog.listDatabases()}
        old = spark.catalog.currentDatabase()
        spark.catalog.setCurrentDatabase(name)
        current = spark.catalog.currentDatabase() == name
        spark.catalog.setCurrentDatabase(old)
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")
    return spark.range(1).select(F.lit(there).alias("there"), F.lit(current).alias("current"))


@query("cat_views", "SELECT true AS made, true AS dropped, true AS everywhere")
def _(spark, d):
    name = f"v_{uuid.uuid4().hex[:8]}"
    load(spark, d, "region").createTempView(name)
    made = spark.catalog.tableExists(name)
    dropped = spark.catalog.dropTempView(name) and not spark.catalog.tableExists(name)
    load(spark, d, "region").createOrReplaceGlobalTempView(name)
    everywhere = spark.table(f"global_temp.{name}").count() == 5 and spark.catalog.dropGlobalTempView(name)
    return spark.range(1).select(F.lit(made).alias("made"), F.lit(dropped).alias("dropped"), F.lit(everywhere).alias("everywhere"))


@query("cat_cache", "SELECT true AS cached, false AS after")
def _(spark, d):
    name = f"c_{uuid.uuid4().hex[:8]}"
    load(spark, d, "region").createTempView(name)
    spark.catalog.cacheTable(name)
    cached = spark.catalog.isCached(name)
    spark.catalog.uncacheTable(name)
    return spark.range(1).select(F.lit(cached).alias("cached"), F.lit(spark.catalog.isCached(name)).alias("after"))


@query("cat_tables", "SELECT 'key' AS name, 'int' AS type UNION ALL SELECT 'label', 'string'")
def _(spark, d):
    name = f"l_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE TABLE {name} (key INT, label STRING) USING parquet")
    rows = [(c.name, c.dataType) for c in spark.catalog.listColumns(name)]
    assert name in {t.name for t in spark.catalog.listTables()}
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(rows, "name string, type string")


@query("session_range", "SELECT range AS id FROM range(0, 100, 7)")
def _(spark, d):
    return spark.range(0, 100, 7)


@query("session_sql_args", "SELECT n_nationkey FROM nation WHERE n_regionkey = 3 AND n_name <> 'x'")
def _(spark, d):
    views(spark, d, "nation")
    return spark.sql("SELECT n_nationkey FROM nation WHERE n_regionkey = :r AND n_name <> :n", args={"r": 3, "n": "x"})


@query("session_create_dataframe", "SELECT unnest([1, 2, NULL])::BIGINT AS a, unnest(['x', NULL, 'z']) AS b")
def _(spark, d):
    return spark.createDataFrame([{"a": 1, "b": "x"}, {"a": 2, "b": None}, {"a": None, "b": "z"}], "a long, b string")
