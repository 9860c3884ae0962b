"""Aggregates, grouping sets, pivots and windows.

Aggregates are partial before the shuffle; distinct ones use Spark's rewrite. Windows shuffle once on their partition
keys; ranking filters are pruned before it.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query, register
from ..tables import load

#: (name, Spark expression, DuckDB expression) over lineitem, by l_returnflag
AGGREGATES = [
    ("count", "count(l_orderkey)", "count(l_orderkey)"),
    ("count_star", "count(*)", "count(*)"),
    ("count_nulls", "count(nullif(l_linenumber, 1))", "count(nullif(l_linenumber, 1))"),
    ("sum", "round(sum(l_quantity), 2)", "round(sum(l_quantity), 2)"),
    ("avg", "round(avg(l_quantity), 6)", "round(avg(l_quantity), 6)"),
    ("mean", "round(mean(l_discount), 6)", "round(avg(l_discount), 6)"),
    ("max", "max(l_extendedprice)", "max(l_extendedprice)"),
    ("min", "min(l_extendedprice)", "min(l_extendedprice)"),
    ("first", "min_by(l_partkey, struct(l_orderkey, l_linenumber, l_partkey))", "arg_min(l_partkey, (l_orderkey, l_linenumber, l_partkey))"),
    ("last", "max_by(l_partkey, struct(l_orderkey, l_linenumber, l_partkey))", "arg_max(l_partkey, (l_orderkey, l_linenumber, l_partkey))"),
    ("first_any", "first(l_returnflag)", "l_returnflag"),
    ("last_any", "last(l_returnflag, true)", "l_returnflag"),
    ("any_value", "any_value(l_returnflag)", "l_returnflag"),
    ("collect_list", "aggregate(collect_list(l_linenumber), 0L, (n, x) -> n + x)", "sum(l_linenumber)::BIGINT"),
    ("collect_set", "array_join(sort_array(collect_set(l_linenumber)), ',')", "array_to_string(list_sort(list(DISTINCT l_linenumber)), ',')"),
    ("array_agg", "aggregate(array_agg(l_linenumber), 0L, (n, x) -> n + x)", "sum(l_linenumber)::BIGINT"),
    ("listagg", "listagg(DISTINCT l_linestatus, ',') WITHIN GROUP (ORDER BY l_linestatus)", "string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus)"),
    ("stddev", "round(stddev(l_quantity), 6)", "round(stddev_samp(l_quantity), 6)"),
    ("std", "round(std(l_quantity), 6)", "round(stddev_samp(l_quantity), 6)"),
    ("stddev_samp", "round(stddev_samp(l_tax), 6)", "round(stddev_samp(l_tax), 6)"),
    ("stddev_pop", "round(stddev_pop(l_quantity), 6)", "round(stddev_pop(l_quantity), 6)"),
    ("variance", "round(variance(l_quantity), 5)", "round(var_samp(l_quantity), 5)"),
    ("var_samp", "round(var_samp(l_quantity), 5)", "round(var_samp(l_quantity), 5)"),
    ("var_pop", "round(var_pop(l_quantity), 5)", "round(var_pop(l_quantity), 5)"),
    ("skewness", "round(skewness(l_quantity), 4)", "round(sum(pow(l_quantity - m, 3)) / count(*) / pow(var_pop(l_quantity), 1.5), 4)"),
    ("kurtosis", "round(kurtosis(l_quantity), 4)", "round(sum(pow(l_quantity - m, 4)) / count(*) / pow(var_pop(l_quantity), 2) - 3, 4)"),
    ("sum_distinct", "sum(DISTINCT l_linenumber)", "sum(DISTINCT l_linenumber)::BIGINT"),
    ("sumDistinct", "sum(DISTINCT l_suppkey)", "sum(DISTINCT l_suppkey)::BIGINT"),
    ("countDistinct", "count(DISTINCT l_suppkey)", "count(DISTINCT l_suppkey)"),
    ("count_distinct", "count(DISTINCT l_suppkey, l_linenumber)", "count(DISTINCT (l_suppkey, l_linenumber))"),
    ("percentile_approx", "percentile_approx(l_quantity, 0.5, 100000)", "quantile_disc(l_quantity, 0.5)"),
    ("approx_percentile", "approx_percentile(l_quantity, 0.25, 100000)", "quantile_disc(l_quantity, 0.25)"),
    ("percentile", "round(percentile(l_extendedprice, 0.3), 4)", "round(quantile_cont(l_extendedprice, 0.3), 4)"),
    ("median", "round(median(l_extendedprice), 4)", "round(median(l_extendedprice), 4)"),
    ("mode", "mode(l_linenumber, true)", None),
    ("corr", "round(corr(l_quantity, l_extendedprice), 6)", "round(corr(l_quantity, l_extendedprice), 6)"),
    ("covar_samp", "round(covar_samp(l_quantity, l_tax), 6)", "round(covar_samp(l_quantity, l_tax), 6)"),
    ("covar_pop", "round(covar_pop(l_quantity, l_tax), 6)", "round(covar_pop(l_quantity, l_tax), 6)"),
    ("bool_and", "bool_and(l_quantity > 0)", "bool_and(l_quantity > 0)"),
    ("bool_or", "bool_or(l_quantity > 49)", "bool_or(l_quantity > 49)"),
    ("every", "every(l_quantity < 50)", "bool_and(l_quantity < 50)"),
    ("some", "some(l_quantity < 2)", "bool_or(l_quantity < 2)"),
    ("max_by", "max_by(l_orderkey, struct(l_extendedprice, l_orderkey))", "max(l_orderkey) FILTER (l_extendedprice = top)"),
    ("min_by", "min_by(l_orderkey, struct(l_extendedprice, l_orderkey))", "min(l_orderkey) FILTER (l_extendedprice = low)"),
    ("count_if", "count_if(l_quantity > 25)", "count_if(l_quantity > 25)::BIGINT"),
    ("filter_clause", "count(*) FILTER (WHERE l_linestatus = 'O')", "count(*) FILTER (WHERE l_linestatus = 'O')"),
    ("regr_avgx", "round(regr_avgx(l_extendedprice, l_quantity), 6)", "round(regr_avgx(l_extendedprice, l_quantity), 6)"),
    ("regr_avgy", "round(regr_avgy(l_extendedprice, l_quantity), 4)", "round(regr_avgy(l_extendedprice, l_quantity), 4)"),
    ("regr_count", "regr_count(l_extendedprice, l_quantity)", "regr_count(l_extendedprice, l_quantity)::BIGINT"),
    ("regr_intercept", "round(regr_intercept(l_extendedprice, l_quantity), 4)", "round(regr_intercept(l_extendedprice, l_quantity), 4)"),
    ("regr_r2", "round(regr_r2(l_extendedprice, l_quantity), 6)", "round(regr_r2(l_extendedprice, l_quantity), 6)"),
    ("regr_slope", "round(regr_slope(l_extendedprice, l_quantity), 4)", "round(regr_slope(l_extendedprice, l_quantity), 4)"),
    ("regr_sxx", "round(regr_sxx(l_tax, l_discount), 6)", "round(regr_sxx(l_tax, l_discount), 6)"),
    ("regr_sxy", "round(regr_sxy(l_tax, l_discount), 6)", "round(regr_sxy(l_tax, l_discount), 6)"),
    ("regr_syy", "round(regr_syy(l_tax, l_discount), 6)", "round(regr_syy(l_tax, l_discount), 6)"),
    ("bit_and", "bit_and(l_linenumber)", "bit_and(l_linenumber)"),
    ("bit_or", "bit_or(l_linenumber)", "bit_or(l_linenumber)"),
    ("bit_xor", "bit_xor(l_orderkey)", "bit_xor(l_orderkey)"),
    ("bitmap_construct_agg", "bitmap_count(bitmap_construct_agg(bitmap_bit_position(l_linenumber)))", "count(DISTINCT l_linenumber)"),
    ("try_sum", "try_sum(l_linenumber)", "sum(l_linenumber)::BIGINT"),
    ("try_avg", "round(try_avg(l_linenumber), 6)", "round(avg(l_linenumber), 6)"),
    ("expression", "round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6)", "round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6)"),
    ("histogram_numeric", "aggregate(histogram_numeric(l_linenumber, 10), 0D, (n, bin) -> n + bin.y)", "count(*)::DOUBLE"),
    ("count_min_sketch", "length(count_min_sketch(l_partkey, 0.1D, 0.9D, 1)) > 0", "true"),
]

_SOURCE = "(SELECT *, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m, max(l_extendedprice) OVER (PARTITION BY l_returnflag) AS top, min(l_extendedprice) OVER (PARTITION BY l_returnflag) AS low FROM lineitem)"


def _grouped(expression):
    return lambda spark, d: load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.expr(expression).alias("v"))


for _name, _spark, _duck in AGGREGATES:
    _from = _SOURCE if _duck and any(w in _duck for w in (" m,", "= top", "= low")) else "lineitem"
    register(f"agg_{_name}", _grouped(_spark), _duck and f"SELECT l_returnflag, {_duck} AS v FROM {_from} GROUP BY l_returnflag")


def _close(name, spark_expression, column):
    """An estimate of distinct values beside their exact number. Both are taken over distinct rows, which leave a sketch as
    it is: in one aggregate with ``count(DISTINCT ...)``, each distinct value would carry a sketch of its own through the shuffle."""

    @query(f"agg_{name}", "SELECT l_returnflag, true AS v FROM lineitem GROUP BY l_returnflag")
    def _(spark, d):
        values = load(spark, d, "lineitem").select("l_returnflag", column).distinct()
        return values.groupBy("l_returnflag").agg(F.expr(spark_expression).alias("v"))


_close("approx_count_distinct", "abs(approx_count_distinct(l_partkey, 0.02) - count(l_partkey)) <= 0.1 * count(l_partkey)", "l_partkey")
_close("approxCountDistinct", "abs(approx_count_distinct(l_suppkey) - count(l_suppkey)) <= 0.2 * count(l_suppkey)", "l_suppkey")


@query("agg_bitmap_or", "SELECT l_returnflag, count(DISTINCT l_linenumber) AS v FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    part = load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.bitmap_construct_agg(F.bitmap_bit_position("l_linenumber")).alias("b"))
    return part.groupBy("l_returnflag").agg(F.bitmap_count(F.bitmap_or_agg("b")).alias("v"))


@query("agg_product", "SELECT l_returnflag, round(sum(log10(1 + l_tax / 1000)), 6) AS v FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.log10(F.product(1 + F.col("l_tax") / 1000)), 6).alias("v"))


@query("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders")
def _(spark, d):
    return load(spark, d, "orders").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))


@query("agg_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE false")
def _(spark, d):
    return load(spark, d, "orders").where("o_orderkey < -1").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))


@query("agg_dict", "SELECT o_orderstatus, count(o_orderkey) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1")
def _(spark, d):
    return load(spark, d, "orders").groupBy("o_orderstatus").agg({"o_orderkey": "count", "o_totalprice": "max"}).select("o_orderstatus", F.col("count(o_orderkey)").alias("n"), F.col("max(o_totalprice)").alias("m"))


@query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 5")
def _(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 5")


for _name in ("sum", "avg", "mean", "max", "min"):

    @query(f"grouped_{_name}", f"SELECT o_orderstatus, round({'avg' if _name == 'mean' else _name}(o_totalprice), 3) AS v FROM orders GROUP BY 1")
    def _(spark, d, name=_name):
        out = getattr(load(spark, d, "orders").groupBy("o_orderstatus"), name)("o_totalprice").toDF("o_orderstatus", "v")
        return out.withColumn("v", F.round("v", 3))


@query("grouped_count", 'SELECT o_orderstatus, count(*) AS "count" FROM orders GROUP BY 1')
def _(spark, d):
    return load(spark, d, "orders").groupBy("o_orderstatus").count()


for _name, _sql in (("cube", "CUBE (o_orderstatus, o_orderpriority)"), ("rollup", "ROLLUP (o_orderstatus, o_orderpriority)")):

    @query(f"agg_{_name}", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY {_sql}")
    def _(spark, d, name=_name):
        g = getattr(load(spark, d, "orders"), name)("o_orderstatus", "o_orderpriority")
        return g.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))


@query("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def _(spark, d):
    o = load(spark, d, "orders")
    return o.groupingSets([[o.o_orderstatus], [o.o_orderpriority], []], o.o_orderstatus, o.o_orderpriority).agg(F.count("*").alias("n"))


@query("agg_grouping", "SELECT o_orderstatus, grouping(o_orderstatus)::TINYINT AS g, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def _(spark, d):
    return load(spark, d, "orders").rollup("o_orderstatus").agg(F.grouping("o_orderstatus").alias("g"), F.count("*").alias("n"))


@query("agg_grouping_id", "SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(spark, d):
    return load(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))


#: Aggregates of pivots; values are given, so no pass looks for them.
for _name, _spark, _duck in (
    ("sum", lambda: F.round(F.sum("o_totalprice"), 2), "round(sum(o_totalprice) FILTER (o_orderstatus = '{}'), 2)"),
    ("avg", lambda: F.round(F.avg("o_totalprice"), 4), "round(avg(o_totalprice) FILTER (o_orderstatus = '{}'), 4)"),
    ("count", lambda: F.count("o_orderkey"), "nullif(count(o_orderkey) FILTER (o_orderstatus = '{}'), 0)"),
    ("max", lambda: F.max("o_totalprice"), "max(o_totalprice) FILTER (o_orderstatus = '{}')"),
    ("min", lambda: F.min("o_totalprice"), "min(o_totalprice) FILTER (o_orderstatus = '{}')"),
    ("count_distinct", lambda: F.count_distinct("o_custkey"), "nullif(count(DISTINCT o_custkey) FILTER (o_orderstatus = '{}'), 0)"),
    ("collect_list", lambda: F.size(F.collect_list("o_orderkey")), "nullif(count(*) FILTER (o_orderstatus = '{}'), 0)::INTEGER"),
    ("collect_set", lambda: F.size(F.collect_set("o_orderkey")), "nullif(count(*) FILTER (o_orderstatus = '{}'), 0)::INTEGER"),
    ("first", lambda: F.min_by("o_custkey", "o_orderkey"), "arg_min(o_custkey, o_orderkey) FILTER (o_orderstatus = '{}')"),
    ("last", lambda: F.max_by("o_custkey", "o_orderkey"), "arg_max(o_custkey, o_orderkey) FILTER (o_orderstatus = '{}')"),
    ("stddev", lambda: F.round(F.stddev("o_totalprice"), 3), "round(stddev_samp(o_totalprice) FILTER (o_orderstatus = '{}'), 3)"),
    ("variance", lambda: F.round(F.log10(F.variance("o_totalprice")), 6), "round(log10(var_samp(o_totalprice) FILTER (o_orderstatus = '{}')), 6)"),
):

    @query(f"pivot_{_name}", "SELECT o_orderpriority, " + ", ".join(_duck.format(s) + f" AS {s}" for s in "FOP") + " FROM orders GROUP BY 1")
    def _(spark, d, agg=_spark):
        return load(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(agg())


# ---------------------------------------------------------------- windows

_KEY = "l_orderkey, l_linenumber"
_OVER = "OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber"
_TIES = "OVER (PARTITION BY l_suppkey ORDER BY l_linenumber"

#: (name, expression of both engines up to OVER, window, DuckDB expression if it differs)
WINDOWS = [
    ("row_number", "row_number()", _OVER + ")", None),
    ("rank", "rank()", _TIES + ")", None),
    ("dense_rank", "dense_rank()", _TIES + ")", None),
    ("percent_rank", "percent_rank()", _TIES + ")", None),
    ("cume_dist", "cume_dist()", _TIES + ")", None),
    ("ntile", "ntile(4)", _OVER + ")", None),
    ("lag", "lag(l_partkey, 1)", _OVER + ")", None),
    ("lag_default", "lag(l_partkey, 2, -1L)", _OVER + ")", "lag(l_partkey, 2, -1)"),
    ("lead", "lead(l_partkey, 1)", _OVER + ")", None),
    ("nth_value", "nth_value(l_partkey, 2)", _OVER + " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", None),
    ("first_value", "first_value(l_partkey)", _OVER + ")", None),
    ("last_value", "last_value(l_partkey)", _OVER + " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", None),
    ("sum_running", "sum(l_linenumber)", _OVER + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "sum(l_linenumber)"),
    ("sum_rows_frame", "sum(l_linenumber)", _OVER + " ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)", "sum(l_linenumber)"),
    ("sum_range_peers", "sum(l_linenumber)", _TIES + ")", "sum(l_linenumber)"),
    ("sum_range_frame", "sum(l_linenumber)", _TIES + " RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)", "sum(l_linenumber)"),
    ("sum_whole", "sum(l_linenumber)", "OVER (PARTITION BY l_suppkey)", "sum(l_linenumber)"),
    ("count", "count(*)", _TIES + ")", None),
    ("count_nulls", "count(nullif(l_linenumber, 2))", _TIES + ")", None),
    ("avg", "round(avg(l_quantity) {w}, 6)", _TIES + ")", "round(avg(l_quantity) {w}, 6)"),
    ("max", "max(l_partkey)", _TIES + ")", None),
    ("min", "min(l_partkey)", _TIES + ")", None),
    ("stddev", "round(stddev(l_quantity) {w}, 6)", "OVER (PARTITION BY l_suppkey)", "round(stddev_samp(l_quantity) {w}, 6)"),
    ("variance", "round(variance(l_quantity) {w}, 5)", "OVER (PARTITION BY l_suppkey)", "round(var_samp(l_quantity) {w}, 5)"),
    ("median", "median(l_quantity)", "OVER (PARTITION BY l_suppkey)", None),
    ("bit_or", "bit_or(l_linenumber)", _TIES + ")", None),
    ("collect_list", "size(collect_list(l_linenumber) {w})", "OVER (PARTITION BY l_suppkey)", "(count(*) {w})::INTEGER"),
    ("count_distinct", "size(collect_set(l_linenumber) {w})", "OVER (PARTITION BY l_suppkey)", "(count(DISTINCT l_linenumber) {w})::INTEGER"),
    ("arithmetic", "l_linenumber - min(l_linenumber) {w} + 1", "OVER (PARTITION BY l_suppkey)", None),
    ("is_null", "lag(l_partkey) {w} IS NULL", _OVER + ")", None),
]


#: The same values by frames that Spark carries on from row to row: frames that end at the last row, and those that slide by
#: values, it would walk anew for each row, which goes by the square of a partition. The last row from here on is the partition's
#: last; a sum over a span of values is the sum up to its end less the sum up to its beginning.
_CARRIED = {
    "last_value": f"last_value(l_partkey) {_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "sum_range_frame": f"sum(l_linenumber) {_TIES} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) - coalesce(sum(l_linenumber) {_TIES} RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0L)",
}


def _windowed(name, expression, window):
    body = expression.format(w=window) if "{w}" in expression else f"{expression} {window}"
    run = _CARRIED.get(name, body)
    return body, lambda spark, d: load(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{run} AS v")


for _name, _spark, _win, _duck in WINDOWS:
    _body, _run = _windowed(_name, _spark, _win)
    _twin = _body if _duck is None else (_duck.format(w=_win) if "{w}" in _duck else f"{_duck} {_win}")
    _cast = "::BIGINT" if _twin.startswith("sum(") else "::INTEGER" if _name in ("row_number", "rank", "dense_rank", "ntile") else ""
    register(f"win_{_name}", _run, f"SELECT {_KEY}, ({_twin}){_cast} AS v FROM lineitem")


@query("win_dataframe_api", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS v FROM orders")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return load(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("v"))


@query("time_window_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return load(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("time_window_sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1")
def _(spark, d):
    return load(spark, d, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("time_window_time", "SELECT time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS at, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    days = load(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return days.select(F.window_time("w").alias("at"), "n")


@query("time_window_session", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def _(spark, d):
    return load(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


# ---------------------------------------------------------------- functions over groups


#: Rows, about, that a function over groups gets at a call.
BATCH_ROWS = 50_000


def in_batches(df, key):
    """``df`` for functions that take many whole groups at a call: the groups of ``key`` are dealt over batches of about
    BATCH_ROWS rows, so that a call's cost is paid for a batch and not for each group. A group of more rows is in one batch.
    NULLs are a batch of their own, so that beside them pandas keeps integer keys as integers."""
    batches = max(1, -(-df.count() // BATCH_ROWS))
    batch = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(batches)))
    return df.groupBy(batch.alias("_batch"))


def below_top(pdf):
    return pdf.assign(v=pdf.groupby("o_custkey", dropna=False)["o_totalprice"].transform("max") - pdf["o_totalprice"])


@query("grouped_apply_in_pandas", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) - o_totalprice AS v FROM orders")
def _(spark, d):
    """For functions that no expression covers; groups are customers, which stay small but become many."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = in_batches(o, "o_custkey").applyInPandas(below_top, "o_orderkey long, o_custkey long, o_totalprice double, v double")
    return out.select("o_orderkey", "v")


def _sizes(table):
    found = table.group_by("o_custkey").aggregate([([], "count_all")])
    return found.select(["o_custkey", "count_all"]).rename_columns(["o_custkey", "n"])


@query("grouped_apply_in_arrow", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return in_batches(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").applyInArrow(_sizes, "o_custkey long, n long")
