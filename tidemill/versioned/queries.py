"""Statements on versioned tables, each on a fresh table made of ``orders`` or ``nation``."""

from __future__ import annotations

import datetime
import time
import uuid

from pyspark.sql import functions as F

from ..registry import query
from ..tables import load
from .sql import run
from .table import VersionedTable


def fresh(spark, folder, table="nation"):
    """(name, table) of a new versioned copy of ``table``."""
    name = f"t_{uuid.uuid4().hex[:12]}"
    return name, VersionedTable.create(load(spark, folder, table), VersionedTable.location(spark, name))


@query("ver_update", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation")
def _(spark, d):
    name, t = fresh(spark, d)
    run(spark, f"UPDATE {name} SET n_name = upper(n_name) || '!' WHERE n_regionkey = 1")
    return t.to_df()


@query("ver_delete", "SELECT * FROM nation WHERE n_regionkey <> 2")
def _(spark, d):
    name, t = fresh(spark, d)
    run(spark, f"DELETE FROM {name} WHERE n_regionkey = 2")
    return t.to_df()


@query("ver_insert", "SELECT * FROM nation UNION ALL SELECT 99, 'Atlantis', 0")
def _(spark, d):
    name, t = fresh(spark, d)
    run(spark, f"INSERT INTO {name} VALUES (99, 'Atlantis', 0)")
    return t.to_df()


MERGED = """
SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'new ' || n_name ELSE n_name END AS n_name, n_regionkey
FROM nation WHERE n_nationkey % 4 <> 2
UNION ALL SELECT n_nationkey + 1000, 'added', n_regionkey FROM nation WHERE n_nationkey < 3
"""


@query("ver_merge", MERGED)
def _(spark, d):
    name, t = fresh(spark, d)
    n = load(spark, d, "nation")
    even = n.where("n_nationkey % 2 = 0").withColumn("n_name", F.concat(F.lit("new "), "n_name"))
    even.unionByName(n.where("n_nationkey < 3").withColumns({"n_nationkey": (F.col("n_nationkey") + 1000).cast("int"), "n_name": F.lit("added")})).createOrReplaceTempView(f"s_{name}")
    run(
        spark,
        f"""MERGE INTO {name} t USING s_{name} s ON t.n_nationkey = s.n_nationkey
        WHEN MATCHED AND t.n_nationkey % 4 = 2 THEN DELETE
        WHEN MATCHED THEN UPDATE SET n_name = s.n_name
        WHEN NOT MATCHED THEN INSERT *""",
    )
    return t.to_df()


@query("ver_merge_by_source", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN n_name ELSE 'gone' END AS n_name, n_regionkey FROM nation WHERE n_nationkey < 20")
def _(spark, d):
    _, t = fresh(spark, d)
    few = load(spark, d, "nation").where("n_nationkey < 5")
    merge = t.alias("t").merge(few, "t.n_nationkey = s.n_nationkey", "s").when_matched_update_all()
    merge.when_not_matched_by_source_delete("t.n_nationkey >= 20").when_not_matched_by_source_update({"n_name": "'gone'"}).execute()
    return t.to_df()


@query("ver_time_travel", "SELECT count(*) AS n FROM nation")
def _(spark, d):
    name, t = fresh(spark, d)
    t.delete("n_regionkey = 1")
    return run(spark, f"SELECT count(*) AS n FROM {name} VERSION AS OF 0")


@query("ver_time_travel_at", "SELECT count(*) AS n FROM nation WHERE n_regionkey <> 1")
def _(spark, d):
    name, t = fresh(spark, d)
    t.delete("n_regionkey = 1")
    t.delete()
    return run(spark, f"SELECT count(*) AS n FROM {name}@v1")


@query("ver_restore", "SELECT * FROM nation")
def _(spark, d):
    name, t = fresh(spark, d)
    t.update("n_regionkey = 3", {"n_name": "'x'"})
    run(spark, f"RESTORE TABLE {name} TO VERSION AS OF 0")
    return t.to_df()


@query("ver_history", "SELECT unnest([0, 1, 2])::BIGINT AS version, unnest(['CREATE', 'DELETE', 'WRITE']) AS operation")
def _(spark, d):
    name, t = fresh(spark, d)
    t.delete("n_regionkey = 1")
    t.append(load(spark, d, "nation").limit(3))
    return run(spark, f"DESCRIBE HISTORY {name}").select("version", "operation")


@query("ver_detail", "SELECT count(*) AS rows FROM nation")
def _(spark, d):
    name, _t = fresh(spark, d)
    return run(spark, f"DESCRIBE DETAIL {name}").select(F.col("numRows").alias("rows"))


@query("ver_vacuum", "SELECT * FROM nation WHERE n_regionkey <> 4")
def _(spark, d):
    name, t = fresh(spark, d)
    t.delete("n_regionkey = 4")
    before = set(t.log.state(0).files)
    run(spark, f"VACUUM {name} RETAIN 0 HOURS")
    if any(t.log.fs.exists(t.log.at("data", f)) for f in before - set(t.log.state().files)):
        raise AssertionError("files that no version needs are still there")
    return t.to_df()


@query("ver_optimize", "SELECT * FROM orders")
def _(spark, d):
    name, t = fresh(spark, d, "orders")
    run(spark, f"OPTIMIZE {name} ZORDER BY (o_orderdate)")
    t.optimize().execute_compaction()
    return t.to_df()


@query("ver_schema_evolution", "SELECT n_nationkey, n_name, n_regionkey, NULL AS extra FROM nation UNION ALL SELECT 100, 'n', 1, 'more'")
def _(spark, d):
    _, t = fresh(spark, d)
    t.append(spark.range(1).selectExpr("100 AS n_nationkey", "'n' AS n_name", "1 AS n_regionkey", "'more' AS extra"), merge_schema=True)
    return t.to_df()


@query("ver_replace_where", "SELECT * FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 200, 'z', 1")
def _(spark, d):
    _, t = fresh(spark, d)
    t.overwrite(spark.range(1).selectExpr("200 AS n_nationkey", "'z' AS n_name", "1 AS n_regionkey"), replace_where="n_regionkey = 1")
    return t.to_df()


@query("ver_alter", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS label, NULL::VARCHAR AS note FROM nation")
def _(spark, d):
    name, t = fresh(spark, d)
    for change in ("ADD COLUMNS (note STRING)", "DROP COLUMN n_regionkey", "RENAME COLUMN n_name TO label", "ALTER COLUMN n_nationkey TYPE BIGINT", "SET TBLPROPERTIES ('a' = 'b')"):
        run(spark, f"ALTER TABLE {name} {change}")
    return t.to_df()


@query("ver_partitioned", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 3")
def _(spark, d):
    name = f"t_{uuid.uuid4().hex[:12]}"
    load(spark, d, "nation").createOrReplaceTempView(f"v_{name}")
    run(spark, f"CREATE TABLE {name} USING versioned PARTITIONED BY (n_regionkey) AS SELECT * FROM v_{name}")
    return run(spark, f"SELECT n_nationkey, n_name, n_regionkey FROM {name} WHERE n_regionkey = 3")


#: Values whose folders' names file systems and URIs spell in different ways.
ODD = "SELECT n_nationkey, n_name, CASE n_regionkey WHEN 0 THEN 'a b' WHEN 1 THEN '100%' WHEN 2 THEN 'x/y=z' WHEN 3 THEN 'é %20' ELSE 'plain' END AS label FROM nation"


def odd_parts(spark, folder):
    """A table of ``nation`` partitioned by labels with blanks, signs and letters beyond ASCII."""
    load(spark, folder, "nation").createOrReplaceTempView("nation")
    return VersionedTable.create(spark.sql(ODD), VersionedTable.location(spark, f"t_{uuid.uuid4().hex[:12]}"), ["label"])


@query("ver_partitioned_update", f"SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) || '!' ELSE n_name END AS n_name, label FROM ({ODD})")
def _(spark, d):
    t = odd_parts(spark, d)
    t.update("n_nationkey % 2 = 0", {"n_name": "upper(n_name) || '!'"})
    return t.to_df()


@query("ver_partitioned_delete", f"SELECT * FROM ({ODD}) WHERE n_nationkey % 3 <> 0 AND label <> '100%'")
def _(spark, d):
    t = odd_parts(spark, d)
    t.delete("n_nationkey % 3 = 0")
    t.delete("label = '100%'")
    return t.to_df()


@query("ver_partitioned_merge", f"SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN 'new' ELSE n_name END AS n_name, CASE WHEN n_nationkey < 10 THEN 'to 5%' ELSE label END AS label FROM ({ODD}) UNION ALL SELECT 77, 'more', 'a b'")
def _(spark, d):
    t = odd_parts(spark, d)
    source = spark.sql("SELECT n_nationkey, 'new' AS n_name, 'to 5%' AS label FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 77, 'more', 'a b'")
    t.alias("t").merge(source, "t.n_nationkey = s.n_nationkey", "s").when_matched_update_all().when_not_matched_insert_all().execute()
    return t.to_df()


@query("ver_partitioned_detail", "SELECT count(*) AS rows FROM nation")
def _(spark, d):
    """Several files of a partition share a name with those of others; rows are counted by path."""
    return odd_parts(spark, d).detail().select(F.col("numRows").alias("rows"))


@query("ver_merge_chained", MERGED)
def _(spark, d):
    _, t = fresh(spark, d)
    n = load(spark, d, "nation")
    even = n.where("n_nationkey % 2 = 0").withColumn("n_name", F.concat(F.lit("new "), "n_name"))
    source = even.unionByName(n.where("n_nationkey < 3").withColumns({"n_nationkey": (F.col("n_nationkey") + 1000).cast("int"), "n_name": F.lit("added")}))
    merge = t.alias("t").merge(source, "t.n_nationkey = s.n_nationkey", "s")
    merge.whenMatched("t.n_nationkey % 4 = 2").delete().whenMatched().update({"n_name": "s.n_name"}).whenNotMatched().insertAll().execute()
    return t.to_df()


@query("ver_merge_chained_by_source", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN n_name ELSE 'gone' END AS n_name, n_regionkey FROM nation WHERE n_nationkey < 20")
def _(spark, d):
    _, t = fresh(spark, d)
    few = load(spark, d, "nation").where("n_nationkey < 5")
    merge = t.alias("t").merge(few, "t.n_nationkey = s.n_nationkey", "s").whenMatched().updateAll()
    merge.whenNotMatchedBySource("t.n_nationkey >= 20").delete().whenNotMatchedBySource().update({"n_name": "'gone'"}).execute()
    return t.to_df()


@query("ver_for_path", "SELECT * FROM nation WHERE n_regionkey <> 0")
def _(spark, d):
    _, t = fresh(spark, d)
    t.delete("n_regionkey = 0")
    return VersionedTable.for_path(spark, t.path).to_df()


@query("ver_time_travel_timestamp", "SELECT count(*) AS n FROM nation")
def _(spark, d):
    """As of a moment between the table's first version and its second."""
    name, t = fresh(spark, d)
    made = t.log.read(0)["timestamp"]
    while time.time() * 1000 < made + 20:
        time.sleep(0.01)
    t.delete("n_regionkey = 1")
    at = datetime.datetime.fromtimestamp((made + 10) / 1000, datetime.UTC).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")
    return run(spark, f"SELECT count(*) AS n FROM {name} TIMESTAMP AS OF '{at}'")


@query("ver_truncate", "SELECT count(*) AS n, 25 AS before FROM nation WHERE false")
def _(spark, d):
    name, t = fresh(spark, d)
    before = t.to_df(0)
    run(spark, f"TRUNCATE TABLE {name}")
    return t.to_df().agg(F.count("*").alias("n")).crossJoin(F.broadcast(before.agg(F.count("*").cast("int").alias("before"))))
