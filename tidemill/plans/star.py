"""More decision-support queries. Dimension tables are joined by key and left to the optimizer: it broadcasts those of
known small size and shuffles the rest, after pruning columns and pushing filters to the scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..tables import load

REVENUE = "l_extendedprice * (1 - l_discount)"


@query(
    "tpch_q3",
    f"""SELECT l_orderkey, round(sum({REVENUE}), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
def _(spark, d):
    at = F.to_timestamp_ntz(F.lit("1998-03-15 00:00:00"))
    c = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = load(spark, d, "orders").where(F.col("o_orderdate") < at).select("o_orderkey", "o_custkey", "o_orderdate")
    li = load(spark, d, "lineitem").where(F.col("l_shipdate") > at).select("l_orderkey", F.expr(REVENUE).alias("r"))
    joined = o.join(c, o.o_custkey == c.c_custkey, "left_semi").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    out = joined.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum("r"), 2).alias("revenue"))
    return out.select("l_orderkey", "revenue", "o_orderdate").orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query(
    "tpch_q5",
    f"""SELECT n_name, round(sum({REVENUE}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' GROUP BY n_name""",
)
def _(spark, d):
    n = load(spark, d, "nation").join(load(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    li = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.expr(REVENUE).alias("r")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return li.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24")
def _(spark, d):
    at = lambda day: F.to_timestamp_ntz(F.lit(f"{day} 00:00:00"))
    rows = load(spark, d, "lineitem").where((F.col("l_shipdate") >= at("1996-01-01")) & (F.col("l_shipdate") < at("1997-01-01")) & F.col("l_discount").between(0.03, 0.07) & (F.col("l_quantity") < 24))
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("tpch_q4", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1")
def _(spark, d):
    li = load(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(li, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
