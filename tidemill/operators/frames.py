"""Actions and inspection of frames, storage, statistics by their own methods, RDD actions and the rest of the catalogue.

Actions bring rows to the driver: their entries run on ``region`` and ``nation``, tables of a fixed few rows.
"""

from __future__ import annotations

import contextlib
import io
import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query, register
from ..tables import load, shared_dir
from .relational import exact_quantiles, with_places

NATION = "n_nationkey int, n_name string, n_regionkey int"
_ALL = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _nation(spark, d):
    return load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey")


#: (name, SQL, action on the sorted table that gives rows)
ACTIONS = [
    ("collect", _ALL, lambda x: x.collect()),
    ("take", f"{_ALL} WHERE n_nationkey < 3", lambda x: x.take(3)),
    ("head", f"{_ALL} WHERE n_nationkey < 4", lambda x: x.head(4)),
    ("first", f"{_ALL} WHERE n_nationkey = 0", lambda x: [x.first()]),
    ("tail", f"{_ALL} WHERE n_nationkey >= 22", lambda x: x.tail(3)),
    ("to_local_iterator", _ALL, lambda x: list(x.toLocalIterator())),
    ("to_pandas", _ALL, lambda x: [tuple(r) for r in x.toPandas().itertuples(index=False)]),
    ("to_arrow", _ALL, lambda x: [tuple(r.values()) for r in x.toArrow().to_pylist()]),
    ("to_json", _ALL, lambda x: [tuple(json.loads(r)[c] for c in x.columns) for r in x.toJSON().collect()]),
    ("row_as_dict", _ALL, lambda x: [tuple(r.asDict().values()) for r in x.collect()]),
    ("row_access", _ALL, lambda x: [(r["n_nationkey"], r.n_name, r[2]) for r in x.collect() if "n_name" in r]),
]
for _name, _sql, _act in ACTIONS:
    register(f"frame_{_name}", lambda spark, d, act=_act: spark.createDataFrame(act(_nation(spark, d)), NATION), _sql)


@query("frame_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, d):
    return spark.createDataFrame([(load(spark, d, "lineitem").count(),)], "n long")


@query("frame_columns", "SELECT column_name AS name FROM (DESCRIBE orders)")
def _(spark, d):
    return spark.createDataFrame([(c,) for c in load(spark, d, "orders").columns], "name string")


_TYPES = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END"


@query("frame_dtypes", f"SELECT column_name AS name, {_TYPES} AS type FROM (DESCRIBE orders)")
def _(spark, d):
    return spark.createDataFrame(load(spark, d, "orders").dtypes, "name string, type string")


@query("frame_schema", f"SELECT column_name AS name, {_TYPES} AS type FROM (DESCRIBE lineitem)")
def _(spark, d):
    schema = load(spark, d, "lineitem").schema
    return spark.createDataFrame([(n, schema[n].dataType.simpleString()) for n in schema.fieldNames()], "name string, type string")


def _printed(f) -> list[str]:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        f()
    return out.getvalue().splitlines()


@query("frame_print_schema", "SELECT column_name AS name FROM (DESCRIBE nation)")
def _(spark, d):
    lines = _printed(load(spark, d, "nation").printSchema)
    return spark.createDataFrame([(x.split()[1].rstrip(":"),) for x in lines if x.startswith(" |--")], "name string")


@query("frame_show", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def _(spark, d):
    lines = _printed(lambda: load(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").show(truncate=False))
    return spark.createDataFrame([tuple(c.strip() for c in x.strip("|").split("|")) for x in lines[3:] if x.startswith("|")], "r_regionkey string, r_name string")


@query("frame_explain", "SELECT count(*) AS filters FROM nation WHERE n_nationkey = 0")
def _(spark, d):
    """How many scans of the formatted plan show the pushed filter: the one there is."""
    lines = _printed(lambda: load(spark, d, "nation").where("n_regionkey = 2").explain("formatted"))
    return spark.createDataFrame([(sum("PushedFilters" in x and "EqualTo(n_regionkey,2)" in x for x in lines),)], "filters long")


@query("frame_semantics", "SELECT count(*) = 25 AS same, count(*) = 25 AS hashes, count(*) = 0 AS other FROM nation")
def _(spark, d):
    a, b, c = (load(spark, d, "nation").where(f"n_regionkey = {k}") for k in (1, 1, 2))
    return spark.createDataFrame([(a.sameSemantics(b), a.semanticHash() == b.semanticHash(), a.sameSemantics(c))], "same boolean, hashes boolean, other boolean")


@query("frame_input_files", "SELECT count(*) > 0 AS some, false AS streaming FROM nation")
def _(spark, d):
    x = load(spark, d, "nation")
    return spark.createDataFrame([(all("nation" in f for f in x.inputFiles()) and len(x.inputFiles()) > 0, x.isStreaming)], "some boolean, streaming boolean")


@query("frame_is_local", "SELECT count(*) = 0 AS scanned, count(*) = 25 AS listed FROM nation")
def _(spark, d):
    return spark.createDataFrame([(load(spark, d, "nation").isLocal(), spark.sql("VALUES (1), (2)").isLocal())], "scanned boolean, listed boolean")


@query("frame_cache", "SELECT n_regionkey, count(*) AS n, 'Disk Memory Deserialized 1x Replicated' AS level, 'Serialized 1x Replicated' AS after FROM nation GROUP BY 1")
def _(spark, d):
    x = load(spark, d, "nation").cache()
    rows = [(*r, str(x.storageLevel)) for r in x.groupBy("n_regionkey").count().collect()]
    x.unpersist()
    return spark.createDataFrame([(*r, str(x.storageLevel)) for r in rows], "n_regionkey int, n long, level string, after string")


@query("frame_persist", "SELECT o_orderstatus, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1")
def _(spark, d):
    x = load(spark, d, "orders").select("o_orderstatus", "o_totalprice").persist(StorageLevel.DISK_ONLY)
    counts = x.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    tops = x.groupBy("o_orderstatus").agg(F.round(F.max("o_totalprice"), 2).alias("top"))
    return counts.join(tops, "o_orderstatus")


@query("frame_checkpoint", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    """Lineage is cut by files in the shared folder, which outlive executors."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).checkpoint()


@query("frame_drop_duplicates", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderstatus", "o_orderpriority").drop_duplicates()


@query("frame_drop_duplicates_subset", "SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS both FROM lineitem")
def _(spark, d):
    """The columns beside the key follow from it, so any row of a key is the same."""
    twice = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("both"))
    return twice.union(twice).dropDuplicates(["l_orderkey", "l_linenumber"])


@query("frame_groupby", "SELECT n_regionkey, count(*) AS count FROM nation GROUP BY 1")
def _(spark, d):
    return load(spark, d, "nation").groupby("n_regionkey").count()


@query("frame_approx_quantile", "SELECT quantile_disc(l_quantity, 0.25) AS low, quantile_disc(l_quantity, 0.75) AS high FROM lineitem")
def _(spark, d):
    """Exact ones; ``approxQuantile`` narrows the rows down."""
    return spark.createDataFrame([tuple(exact_quantiles(load(spark, d, "lineitem"), "l_quantity", [0.25, 0.75]))], "low double, high double")


@query("frame_stat_approx_quantile", "SELECT quantile_disc(p_size, 0.5)::DOUBLE AS p_size, quantile_disc(p_retailprice, 0.5) AS p_retailprice FROM part")
def _(spark, d):
    part = load(spark, d, "part")
    return spark.createDataFrame([tuple(exact_quantiles(part, c, [0.5])[0] for c in ("p_size", "p_retailprice"))], "p_size double, p_retailprice double")


@query("frame_corr_cov", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_tax), 6) AS c FROM lineitem")
def _(spark, d):
    x = load(spark, d, "lineitem")
    assert abs(x.stat.corr("l_quantity", "l_extendedprice") - x.corr("l_quantity", "l_extendedprice")) < 1e-9
    return spark.createDataFrame([(round(x.corr("l_quantity", "l_extendedprice"), 6), round(x.stat.cov("l_quantity", "l_tax"), 6))], "r double, c double")


@query("frame_describe", "SELECT count(p_size)::VARCHAR AS n, round(avg(p_size), 6) AS mean, round(stddev_samp(p_size), 6) AS dev, max(p_size)::VARCHAR AS high FROM part")
def _(spark, d):
    x = load(spark, d, "part").describe("p_size")
    pick = lambda s: F.max(F.when(F.col("summary") == s, F.col("p_size")))
    return x.agg(pick("count").alias("n"), F.round(pick("mean").cast("double"), 6).alias("mean"), F.round(pick("stddev").cast("double"), 6).alias("dev"), pick("max").alias("high"))


@query("frame_summary", "SELECT quantile_disc(p_size, 0.75)::VARCHAR AS upper, round(stddev_samp(p_size), 6) AS dev FROM part")
def _(spark, d):
    x = load(spark, d, "part").select("p_size").summary("75%", "stddev")
    pick = lambda s: F.max(F.when(F.col("summary") == s, F.col("p_size")))
    return x.agg(pick("75%").alias("upper"), F.round(pick("stddev").cast("double"), 6).alias("dev"))


@query("frame_observe", "SELECT count(*) AS n, sum(r_regionkey)::BIGINT AS s FROM region")
def _(spark, d):
    from pyspark.sql import Observation

    seen = Observation("seen")
    load(spark, d, "region").observe(seen, F.count("*").alias("n"), F.sum("r_regionkey").alias("s")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"], seen.get["s"])], "n long, s long")


@query("frame_random_split", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, d):
    """The parts of a random split are the whole together."""
    a, b, c = load(spark, d, "orders").select("o_orderkey", "o_custkey").randomSplit([0.2, 0.3, 0.5], seed=11)
    return a.unionAll(b).unionAll(c)


@query("frame_map_partitions", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    pairs = load(spark, d, "nation").rdd.mapPartitions(lambda rows: ((r.n_regionkey, 1) for r in rows))
    return spark.createDataFrame(pairs.reduceByKey(lambda a, b: a + b), "n_regionkey int, n long")


@query("frame_foreach", "SELECT count(*) AS rows, sum(n_nationkey)::BIGINT AS total FROM nation")
def _(spark, d):
    rows, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    load(spark, d, "nation").foreach(lambda r: rows.add(1))
    load(spark, d, "nation").foreachPartition(lambda part: total.add(sum(r.n_nationkey for r in part)))
    return spark.createDataFrame([(rows.value, total.value)], "rows long, total long")


@query("frame_apply_in_arrow", "SELECT n_regionkey, max(n_nationkey) AS top FROM nation GROUP BY 1")
def _(spark, d):
    def top(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        return table.slice(0, 1).select(["n_regionkey"]).append_column("top", pa.array([pc.max(table.column("n_nationkey")).as_py()], pa.int32()))

    return load(spark, d, "nation").groupBy("n_regionkey").applyInArrow(top, "n_regionkey int, top int")


@query("frame_group_transform", "SELECT n_nationkey, n_nationkey - min(n_nationkey) OVER (PARTITION BY n_regionkey) AS rest FROM nation")
def _(spark, d):
    """A group's rows, each transformed by a function of the whole group."""
    moved = lambda pdf: pdf.assign(rest=pdf.n_nationkey - pdf.n_nationkey.min())[["n_nationkey", "rest"]]
    return load(spark, d, "nation").groupBy("n_regionkey").applyInPandas(moved, "n_nationkey int, rest int")


@query("frame_pivot_mean", "SELECT n_regionkey, avg(n_nationkey) FILTER (n_nationkey % 2 = 0) AS even, avg(n_nationkey) FILTER (n_nationkey % 2 = 1) AS odd FROM nation GROUP BY 1")
def _(spark, d):
    kind = F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd")
    return load(spark, d, "nation").withColumn("kind", kind).groupBy("n_regionkey").pivot("kind", ["even", "odd"]).mean("n_nationkey")


@query("frame_pivot_first_last", "SELECT n_regionkey, min(n_nationkey) AS a_first, max(n_nationkey) AS a_last FROM nation GROUP BY 1")
def _(spark, d):
    """``first`` and ``last`` of sorted rows in one partition, where their order is defined."""
    rows = load(spark, d, "nation").withColumn("k", F.lit("a")).coalesce(1).sortWithinPartitions("n_regionkey", "n_nationkey")
    return rows.groupBy("n_regionkey").pivot("k", ["a"]).agg(F.first("n_nationkey").alias("first"), F.last("n_nationkey").alias("last"))


@query("frame_agg_first_last", "SELECT n_regionkey, min(n_nationkey) AS f, max(n_nationkey) AS l FROM nation GROUP BY 1")
def _(spark, d):
    rows = load(spark, d, "nation").coalesce(1).sortWithinPartitions("n_regionkey", "n_nationkey")
    return rows.groupBy("n_regionkey").agg(F.first("n_nationkey").alias("f"), F.last("n_nationkey").alias("l"))


#: Whole lists of a group: (name, Spark, SQL)
for _name, _spark, _twin in (
    ("collect_list", lambda c: F.collect_list(c), "list(l_linenumber)"),
    ("array_agg", lambda c: F.array_agg(c), "list(l_linenumber)"),
    ("collect_set", lambda c: F.collect_set(c), "list(DISTINCT l_linenumber)"),
):
    register(
        f"frame_agg_{_name}",
        lambda spark, d, f=_spark: load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(f("l_linenumber")), ",").alias("v")),
        f"SELECT l_orderkey, array_to_string(list_sort({_twin}), ',') AS v FROM lineitem GROUP BY 1",
    )

#: Window reducers over an order's lines: (name, Spark, SQL)
REDUCERS = [
    ("stddev", F.stddev, "stddev_samp({})"),
    ("stddev_samp", F.stddev_samp, "stddev_samp({})"),
    ("stddev_pop", F.stddev_pop, "stddev_pop({})"),
    ("variance", F.variance, "var_samp({})"),
    ("var_samp", F.var_samp, "var_samp({})"),
    ("var_pop", F.var_pop, "var_pop({})"),
    ("median", F.median, "median({})"),
    ("mean", F.mean, "avg({})"),
    ("max", F.max, "max({})"),
    ("min", F.min, "min({})"),
    ("skewness", F.skewness, None),
    ("kurtosis", F.kurtosis, None),
    ("approx_count_distinct", F.approx_count_distinct, None),
]
for _name, _spark, _twin in REDUCERS:

    def _run(spark, d, f=_spark):
        w = Window.partitionBy("l_orderkey")
        return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(f("l_quantity").over(w), 4).alias("v"))

    register(f"win_of_order_{_name}", _run, f"SELECT l_orderkey, l_linenumber, round({_twin.format('l_quantity')} OVER (PARTITION BY l_orderkey), 4) AS v FROM lineitem" if _twin else None)


@query("win_distinct_is_refused", "SELECT count(*) = 25 AS refused FROM nation")
def _(spark, d):
    from pyspark.errors import AnalysisException

    try:
        load(spark, d, "nation").select(F.count_distinct("n_name").over(Window.partitionBy("n_regionkey"))).columns
        refused = False
    except AnalysisException:
        refused = True
    return spark.createDataFrame([(refused,)], "refused boolean")


# ---------------------------------------------------------------- RDD actions


@query("rdd_actions", "SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS total, 0 AS first, 3 AS took FROM nation")
def _(spark, d):
    x = load(spark, d, "nation").orderBy("n_nationkey").rdd.map(lambda r: r.n_nationkey).cache()
    seen = spark.sparkContext.accumulator(0)
    x.foreach(lambda k: seen.add(1))
    row = (x.count(), x.reduce(lambda a, b: a + b), x.first(), len(x.take(3)))
    assert seen.value == row[0] and sorted(x.collect())[:3] == x.take(3)
    x.unpersist()
    return spark.createDataFrame([row], "n long, total long, first int, took int")


@query("rdd_count_by_key", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    found = load(spark, d, "nation").rdd.map(lambda r: (r.n_regionkey, r.n_name)).persist().countByKey()
    return spark.createDataFrame(list(found.items()), "n_regionkey int, n long")


# ---------------------------------------------------------------- session and catalogue


@query("session_surface", "SELECT count(*) = 25 AS version, count(*) = 25 AS named, count(*) = 25 AS conf, count(*) = 25 AS apart, count(*) = 25 AS active FROM nation")
def _(spark, d):
    import pyspark

    other = spark.newSession()
    spark.range(1).createOrReplaceTempView("only_here")
    apart = spark.catalog.tableExists("only_here") and not other.catalog.tableExists("only_here")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", old)
    row = (spark.version == pyspark.__version__, bool(spark.sparkContext.appName), spark.conf.get("spark.sql.shuffle.partitions") == old, apart, spark.getActiveSession() is not None)
    spark.catalog.dropTempView("only_here")
    return spark.createDataFrame([row], "version boolean, named boolean, conf boolean, apart boolean, active boolean")


@query("cat_get", "SELECT 'spark_catalog' AS catalog, 'default' AS db, count(*) AS rows FROM region")
def _(spark, d):
    """``getDatabase``, ``getTable``, ``createTable`` from a path, ``refreshTable``, ``refreshByPath``, ``setCurrentCatalog``."""
    name, path = f"g_{uuid.uuid4().hex[:8]}", f"{shared_dir(spark)}/cat-{uuid.uuid4().hex}"
    load(spark, d, "region").write.parquet(path)
    spark.catalog.createTable(name, path, "parquet")
    spark.catalog.setCurrentCatalog(spark.catalog.currentCatalog())
    spark.catalog.refreshTable(name)
    spark.catalog.refreshByPath(path)
    table, rows = spark.catalog.getTable(name), spark.table(name).count()
    assert table.name == name
    row = (spark.catalog.currentCatalog(), spark.catalog.getDatabase("default").name, rows)
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame([row], "catalog string, db string, rows long")


@query("cat_recover_partitions", "SELECT n_nationkey, n_regionkey FROM nation")
def _(spark, d):
    name, path = f"r_{uuid.uuid4().hex[:8]}", f"{shared_dir(spark)}/cat-{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (n_nationkey INT, n_regionkey INT) USING parquet PARTITIONED BY (n_regionkey) LOCATION '{path}'")
    load(spark, d, "nation").select("n_nationkey", "n_regionkey").write.mode("append").partitionBy("n_regionkey").parquet(path)
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


@query("cat_views_and_caches", "SELECT unnest(['global', 'local']) AS kind, 5 AS rows, false AS cached")
def _(spark, d):
    name = f"w_{uuid.uuid4().hex[:8]}"
    region = load(spark, d, "region")
    region.createOrReplaceTempView(name)
    region.createGlobalTempView(name)
    spark.catalog.cacheTable(name)
    spark.catalog.clearCache()
    listed = name in {t.name for t in spark.catalog.listTables() if t.isTemporary}
    rows = [("global", spark.table(f"global_temp.{name}").count(), False), ("local", spark.table(name).count() if listed else -1, spark.catalog.isCached(name))]
    spark.catalog.dropTempView(name)
    spark.catalog.dropGlobalTempView(name)
    return spark.createDataFrame(rows, "kind string, rows int, cached boolean")


@query("sort_whole_part", "SELECT p_partkey, row_number() OVER (ORDER BY nullif(p_size, 7) DESC NULLS FIRST, p_partkey) AS place FROM part")
def _(spark, d):
    rows = load(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(7)).alias("s"))
    return with_places(rows, [F.desc_nulls_first("s"), F.asc("p_partkey")]).drop("s")
