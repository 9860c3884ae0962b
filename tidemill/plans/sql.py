"""SQL statements over the tables; the text is the same for both engines unless a twin is given."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..registry import query, register
from ..tables import load, views

STATEMENTS = {
    "select_case": ("part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind FROM part"),
    "where": ("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 1000 OR o_orderpriority LIKE '1%')"),
    "join": ("nation region", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "left_join": ("customer orders", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 GROUP BY c.c_custkey"),
    "full_join": ("nation region", "SELECT n.n_nationkey, r.r_regionkey FROM nation n FULL OUTER JOIN region r ON n.n_nationkey = r.r_regionkey"),
    "many_joins": ("customer nation region", "SELECT r.r_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"),
    "self_join": ("nation", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "scalar_subquery": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)"),
    "in_subquery": ("customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "exists": ("customer orders", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)"),
    "correlated": ("orders", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)"),
    "group_having": ("orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 8"),
    "group_boolean": ("orders", "SELECT o_totalprice > 100000 AS big, count(*) AS n FROM orders GROUP BY o_totalprice > 100000"),
    "order_limit": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "limit_offset": ("nation", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 3"),
    "no_from": ("", "SELECT 1 AS one, 'x' AS x"),
    "with": ("orders", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT * FROM a WHERE s > 500000) SELECT count(*) AS n FROM b"),
    "with_nested": ("orders", "WITH a AS (WITH z AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders) SELECT k FROM z WHERE s = 'F') SELECT k FROM a"),
    "recursive": ("", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 10) SELECT n FROM r"),
    "union": ("nation", "SELECT n_regionkey AS k FROM nation UNION SELECT n_nationkey FROM nation"),
    "union_all": ("nation", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT n_nationkey FROM nation"),
    "intersect": ("nation", "SELECT n_regionkey AS k FROM nation INTERSECT SELECT n_nationkey FROM nation"),
    "except": ("nation", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT n_regionkey FROM nation"),
    "distinct": ("orders", "SELECT DISTINCT o_orderstatus FROM orders"),
    "window": ("orders", "SELECT o_orderkey, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"),
    "values": ("", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)"),
    "lateral_join": ("nation region", "SELECT r.r_regionkey, x.n FROM region r, LATERAL (SELECT count(*) AS n FROM nation n WHERE n.n_regionkey = r.r_regionkey) x"),
    "pivot": ("orders", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o))"),
}
TWINS = {
    "pivot": "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o FROM orders GROUP BY 1",
    "window": "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS n FROM orders",
}


def _statement(names: str, text: str):
    def run(spark, d):
        views(spark, d, *names.split()) if names else None
        return spark.sql(text)

    return run


for _name, (_tables, _text) in STATEMENTS.items():
    register(f"sql_{_name}", _statement(_tables, _text), TWINS.get(_name, _text))


@query("sql_ddl", "SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, 'y'")
def _(spark, d):
    name = f"ddl_{uuid.uuid4().hex[:10]}"
    spark.sql(f"CREATE TABLE {name} (a INT, b STRING) USING parquet")
    spark.sql(f"INSERT INTO {name} VALUES (1, 'x')")
    spark.sql(f"INSERT INTO {name} SELECT 2, 'y'")
    spark.sql(f"REFRESH TABLE {name}")
    return spark.table(name)


@query("sql_ctas", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    name = f"ctas_{uuid.uuid4().hex[:10]}"
    views(spark, d, "nation")
    spark.sql(f"CREATE TABLE {name} USING parquet AS SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
    return spark.table(name)


@query("sql_describe", "SELECT 'r_regionkey' AS col_name, 'int' AS data_type UNION ALL SELECT 'r_name', 'string'")
def _(spark, d):
    views(spark, d, "region")
    return spark.sql("DESCRIBE region").select("col_name", "data_type")


@query("sql_show_tables", "SELECT 'region' AS name")
def _(spark, d):
    views(spark, d, "region")
    return spark.sql("SHOW TABLES").where("tableName = 'region'").selectExpr("tableName AS name").distinct()


@query("sql_explain", "SELECT true AS planned")
def _(spark, d):
    views(spark, d, "region")
    return spark.sql("EXPLAIN FORMATTED SELECT count(*) FROM region").selectExpr("plan LIKE '%HashAggregate%' AS planned")


# ---------------------------------------------------------------- user functions and RDDs


@query("udf_scalar", "SELECT p_partkey, p_size * 2 + 1 AS v FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", F.udf(lambda x: x * 2 + 1, "int", useArrow=True)("p_size").alias("v"))


def scaled(s: pd.Series) -> pd.Series:
    return s * 1.5


def spread(s: pd.Series) -> float:
    return float(s.max() - s.min())


@query("udf_pandas", "SELECT p_partkey, p_retailprice * 1.5 AS v FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", F.pandas_udf(scaled, "double")("p_retailprice").alias("v"))


@query("udf_aggregate", "SELECT o_orderstatus, round(max(o_totalprice) - min(o_totalprice), 4) AS v FROM orders GROUP BY 1")
def _(spark, d):
    return load(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.pandas_udf(spread, "double")("o_totalprice"), 4).alias("v"))


@query("udf_registered", "SELECT p_partkey, p_size + 5 AS v FROM part")
def _(spark, d):
    spark.udf.register("plus_five", lambda x: x + 5, "int")
    views(spark, d, "part")
    return spark.sql("SELECT p_partkey, plus_five(p_size) AS v FROM part")


@query("udtf", "SELECT n_nationkey, unnest(range(0, n_regionkey))::INTEGER AS i FROM nation")
def _(spark, d):
    class Count:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    spark.udtf.register("count_to", F.udtf(Count, returnType="i int"))
    views(spark, d, "nation")
    return spark.sql("SELECT n_nationkey, t.i FROM nation, LATERAL count_to(n_regionkey) t")


@query("map_in_pandas", "SELECT o_orderkey, o_totalprice * 2 AS v FROM orders")
def _(spark, d):
    def doubled(parts):
        for pdf in parts:
            yield pdf.assign(v=pdf["o_totalprice"] * 2)[["o_orderkey", "v"]]

    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").mapInPandas(doubled, "o_orderkey long, v double")


@query("map_in_arrow", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def _(spark, d):
    def even(batches):
        import pyarrow.compute as pc

        for b in batches:
            yield b.filter(pc.equal(pc.bit_wise_and(b.column("o_orderkey"), 1), 0))

    return load(spark, d, "orders").select("o_orderkey").mapInArrow(even, "o_orderkey long")


@query("rdd_map", "SELECT n_nationkey AS k, n_regionkey * 10 AS v FROM nation")
def _(spark, d):
    return load(spark, d, "nation").rdd.map(lambda r: (r.n_nationkey, r.n_regionkey * 10)).toDF("k int, v int")


@query("rdd_flat_map_filter", "SELECT unnest([n_nationkey, n_nationkey + 100]) AS v FROM nation WHERE n_regionkey > 1")
def _(spark, d):
    return load(spark, d, "nation").rdd.filter(lambda r: r.n_regionkey > 1).flatMap(lambda r: [(r.n_nationkey,), (r.n_nationkey + 100,)]).toDF("v int")


@query("rdd_reduce_by_key", "SELECT n_regionkey AS k, sum(n_nationkey)::BIGINT AS v FROM nation GROUP BY 1")
def _(spark, d):
    return load(spark, d, "nation").rdd.map(lambda r: (r.n_regionkey, r.n_nationkey)).reduceByKey(lambda a, b: a + b).toDF("k int, v long")


@query("rdd_group_by", "SELECT n_regionkey AS k, count(*)::INTEGER AS n FROM nation GROUP BY 1")
def _(spark, d):
    return load(spark, d, "nation").rdd.groupBy(lambda r: r.n_regionkey).mapValues(lambda rows: len(list(rows))).toDF("k int, n int")
