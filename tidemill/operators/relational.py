"""Relational operators as declarative plans: projection, selection, joins, set operations, sorting, reshaping, nulls
and statistics.

Joins leave their strategy to the optimizer, which broadcasts a side of known small size and otherwise shuffles on the
keys, splitting skewed partitions at run time. Columns are pruned before every exchange.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..registry import query
from ..tables import load

# ---------------------------------------------------------------- operators of our own


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, values: Sequence[str]) -> DataFrame:
    """Each row of ``left`` with ``values`` of the last row of ``right`` at or before it, within ``by``.

    Both sides are tagged, united and walked once in the order of time within ``by``: one shuffle, no range join. A
    right row at the same time counts as before.
    """
    names = list(left.columns)
    a = left.select(*[F.col(c) for c in by], F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    b = right.select(*[F.col(c) for c in by], F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return met.where("_side = 1").select("_row.*", *[F.col("_v")[v].alias(v) for v in values])


#: Rows of a bucket on either side that a cell of a range join holds, about.
CELL_ROWS = 4096
#: Tasks of a range join, if shuffles have no more partitions.
MOST_TASKS = 2000


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows with ``low <= point < high``, by an equi-join on buckets of ``width``: each span is filed under all buckets
    that it meets, so that only neighbours are compared.

    A bucket of many rows is cut into cells: its points into slices, its spans into slices, one cell for each pair of
    slices, which a point or a span reaches by being repeated for the slices of the other side. Cells are dealt over
    tasks, so a bucket that holds most rows is not one task's work, and a task buffers one cell at once. What is
    broadcast is a row for each cut bucket, at most one for CELL_ROWS rows."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    keys = [*by, "_bucket"]
    placed = points.where(F.col(point).isNotNull()).withColumn("_bucket", bucket(point))
    filed = spans.where(F.col(low) < F.col(high)).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    slices = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(CELL_ROWS)).alias(name))
    cut = slices(placed, "_is").join(slices(filed, "_js"), keys).where("_is > 1 OR _js > 1")
    cells = cut.agg(F.sum(F.col("_is") * F.col("_js"))).first()[0]
    met = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    if cells is None:
        return placed.join(filed, keys).where(met).drop("_bucket")
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(cells, MOST_TASKS))

    def dealt(df: DataFrame, own: str, n: str, other: str, m: str) -> DataFrame:
        whole = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
        counted = df.join(F.broadcast(cut), keys, "left").withColumns({n: F.coalesce(n, F.lit(1)), m: F.coalesce(m, F.lit(1))})
        sliced = counted.withColumn(own, F.pmod(F.xxhash64(*whole), F.col(n)))
        repeated = sliced.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1)))
        return repeated.drop("_is", "_js").repartition(tasks, *keys, "_i", "_j")

    a, b = dealt(placed, "_i", "_is", "_j", "_js"), dealt(filed, "_j", "_js", "_i", "_is")
    return a.join(b.hint("merge"), [*keys, "_i", "_j"]).where(met).drop("_bucket", "_i", "_j")


def salted_join(large: DataFrame, other: DataFrame, on: Sequence[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """A join whose hot keys are dealt over ``salts`` tasks: ``large`` gets a salt from its rows, ``other`` is repeated
    for each. ``how``: inner, left, left_semi or left_anti."""
    salt = F.pmod(F.xxhash64(*large.columns), F.lit(salts))
    repeated = other.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return large.withColumn("_salt", salt).join(repeated, [*on, "_salt"], how).drop("_salt")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark prunes to ``n`` rows before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def with_places(df: DataFrame, order: Sequence[Column], place: str = "place") -> DataFrame:
    """``df``, sorted, with the place of each row in the whole order: rows are dealt by ranges, and a row's place is its
    range's beginning and its place there, so no task sorts all. One row for each range is broadcast."""
    rows = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).persist()
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.join(F.broadcast(before), "_range").withColumn(place, F.col("_before") + within).drop("_range", "_before")


#: Rows that ``exact_quantiles`` takes to the driver at most.
KEPT_ROWS = 10_000


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float | None]:
    """What ``approxQuantile`` gives at error 0: the value of rank ``p * n``, rounded up, NULL and NaN left out; None where
    nothing is left. At error 0 Spark keeps all values in one sketch. Here sketches at error 0.001 give two values around each
    rank, a pass counts the rows on either side, and only rows between them, under one percent, go to the next round;
    the counts decide, so the result is exact whatever a sketch gives."""
    x = df.select(F.col(f"`{column}`").cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    n = x.count()
    if not n:
        return [None] * len(probabilities)
    return _of_ranks(x, n, [min(n, max(1, math.ceil(p * n))) for p in probabilities])


def _of_ranks(x: DataFrame, n: int, ranks: list[int]) -> list[float]:
    if n <= KEPT_ROWS:
        values = sorted(r.x for r in x.collect())
        return [values[r - 1] for r in ranks]
    at = sorted({min(1.0, max(0.0, r / n + e)) for r in ranks for e in (-0.002, 0.002)})
    value = dict(zip(at, x.approxQuantile("x", at, 0.001)))
    bounds = [tuple(value[min(1.0, max(0.0, r / n + e))] for e in (-0.002, 0.002)) for r in ranks]
    count = lambda c: F.count(F.when(c, 1))
    v = F.col("x")
    seen = x.agg(*[count(c) for lo, hi in bounds for c in (v < lo, v <= lo, v < hi, v <= hi)]).first()
    out = []
    for i, (r, (lo, hi)) in enumerate(zip(ranks, bounds)):
        below, to_low, to_high, upto = seen[4 * i : 4 * i + 4]
        if below < r <= to_low:
            out.append(lo)
        elif to_high < r <= upto:
            out.append(hi)
        elif r <= below:
            out += _of_ranks(x.where(v < lo), below, [r])
        elif r > upto:
            out += _of_ranks(x.where(v > hi), n - upto, [r - upto])
        else:
            out += _of_ranks(x.where((v > lo) & (v < hi)), to_high - to_low, [r - to_low])
    return out


# ---------------------------------------------------------------- projection and selection


@query("rel_select", "SELECT p_partkey, p_name FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", "p_name")


@query("rel_select_expr", "SELECT p_partkey, p_size * 2 AS twice, upper(p_brand) AS brand FROM part")
def _(spark, d):
    return load(spark, d, "part").selectExpr("p_partkey", "p_size * 2 AS twice", "upper(p_brand) AS brand")


@query("rel_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05")
def _(spark, d):
    return load(spark, d, "lineitem").filter((F.col("l_quantity") > 30) & (F.col("l_discount") < 0.05)).select("l_orderkey", "l_linenumber")


@query("rel_where_sql", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 100000")
def _(spark, d):
    return load(spark, d, "orders").where("o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 100000").select("o_orderkey")


@query("rel_with_column", "SELECT p_partkey, p_size + 1 AS p_size FROM part")
def _(spark, d):
    return load(spark, d, "part").withColumn("p_size", F.col("p_size") + 1).select("p_partkey", "p_size")


@query("rel_with_columns", "SELECT p_partkey, p_size + 1 AS a, p_size * 2 AS b FROM part")
def _(spark, d):
    return load(spark, d, "part").withColumns({"a": F.col("p_size") + 1, "b": F.col("p_size") * 2}).select("p_partkey", "a", "b")


@query("rel_with_column_renamed", "SELECT r_regionkey AS key, r_name FROM region")
def _(spark, d):
    return load(spark, d, "region").withColumnRenamed("r_regionkey", "key")


@query("rel_with_columns_renamed", "SELECT r_regionkey AS key, r_name AS name FROM region")
def _(spark, d):
    return load(spark, d, "region").withColumnsRenamed({"r_regionkey": "key", "r_name": "name"})


@query("rel_with_metadata", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return load(spark, d, "region").withMetadata("r_name", {"comment": "name of a region"})


@query("rel_drop", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    return load(spark, d, "nation").drop("n_regionkey")


@query("rel_to_df", "SELECT r_regionkey AS a, r_name AS b FROM region")
def _(spark, d):
    return load(spark, d, "region").toDF("a", "b")


@query("rel_col_regex", "SELECT p_partkey, p_size FROM part")
def _(spark, d):
    part = load(spark, d, "part")
    return part.select(part.colRegex("`p_(partkey|size)`"))


@query("rel_getitem", "SELECT p_partkey, p_brand FROM part WHERE p_size = 10")
def _(spark, d):
    part = load(spark, d, "part")
    return part[part["p_size"] == 10][["p_partkey", "p_brand"]]


@query("rel_alias", "SELECT p.p_partkey AS k FROM part p")
def _(spark, d):
    return load(spark, d, "part").alias("p").select(F.col("p.p_partkey").alias("k"))


@query("rel_transform", "SELECT r_regionkey, lower(r_name) AS r_name FROM region")
def _(spark, d):
    return load(spark, d, "region").transform(lambda df: df.withColumn("r_name", F.lower("r_name")))


@query("rel_to_json", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def _(spark, d):
    region = load(spark, d, "region")
    return region.select(F.to_json(F.struct(*region.columns)).alias("value"))


@query("rel_with_field", "SELECT p_partkey, p_size + 1 AS size FROM part")
def _(spark, d):
    s = F.struct("p_size", "p_brand").alias("s")
    return load(spark, d, "part").select("p_partkey", s).withColumn("s", F.col("s").withField("p_size", F.col("s.p_size") + 1)).select("p_partkey", F.col("s.p_size").alias("size"))


# ---------------------------------------------------------------- distinct, sort, limit


@query("rel_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("rel_drop_duplicates", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(spark, d):
    """One row for each key, the newest: an aggregate, so that the choice is defined."""
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))


@query("rel_drop_duplicates_keys", "SELECT DISTINCT o_custkey FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_custkey", "o_orderstatus").dropDuplicates(["o_custkey"]).select("o_custkey")


@query("rel_order_by", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def _(spark, d):
    return load(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), F.asc("c_custkey"))


for _name, _order in (("asc", "ASC NULLS FIRST"), ("asc_nulls_first", "ASC NULLS FIRST"), ("asc_nulls_last", "ASC NULLS LAST"), ("desc", "DESC NULLS LAST"), ("desc_nulls_first", "DESC NULLS FIRST"), ("desc_nulls_last", "DESC NULLS LAST")):

    @query(f"rel_sort_{_name}", f"SELECT p_partkey, nullif(p_size, 7) AS s, row_number() OVER (ORDER BY nullif(p_size, 7) {_order}, p_partkey) AS place FROM part")
    def _(spark, d, name=_name):
        rows = load(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(7)).alias("s"))
        return with_places(rows, [getattr(F, name)("s"), F.asc("p_partkey")])


@query("rel_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("rel_offset", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 5")
def _(spark, d):
    return load(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").offset(5).limit(10)


@query("rel_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def _(spark, d):
    rows = load(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return top_per_group(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3)


@query("rel_repartition", "SELECT o_orderkey FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey").repartition(4, "o_orderkey")


@query("rel_repartition_by_range", "SELECT o_orderkey FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")


@query("rel_coalesce", "SELECT o_orderkey FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey").coalesce(2)


# ---------------------------------------------------------------- joins

_NATION = "n_nationkey, n_name, r_name"

for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("left_outer", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("right_outer", "RIGHT JOIN"), ("full", "FULL JOIN"), ("full_outer", "FULL JOIN"), ("outer", "FULL JOIN")):

    @query(f"join_{_how}", f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) {_sql} (SELECT * FROM orders WHERE o_totalprice > 50000) ON c_custkey = o_custkey")
    def _(spark, d, how=_how):
        c = load(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
        o = load(spark, d, "orders").where("o_totalprice > 50000").select("o_custkey", "o_orderkey")
        return c.join(o, c.c_custkey == o.o_custkey, how).select("c_custkey", "o_orderkey")


for _how, _sql in (("left_semi", "IN"), ("left_anti", "NOT IN")):

    @query(f"join_{_how}", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey {_sql} (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
    def _(spark, d, how=_how):
        c = load(spark, d, "customer").select("c_custkey", "c_name")
        o = load(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
        return c.join(o, "c_custkey", how)


@query("join_cross", "SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation")
def _(spark, d):
    return load(spark, d, "region").select("r_regionkey").crossJoin(load(spark, d, "nation").select("n_nationkey"))


@query("join_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)")
def _(spark, d):
    n = load(spark, d, "nation").select(F.col("n_regionkey").alias("k"), "n_name")
    return n.join(load(spark, d, "region").select(F.col("r_regionkey").alias("k"), "r_name"), "k")


@query("join_using_many", "SELECT o.o_orderstatus, o.o_orderpriority, n, m FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) o JOIN (SELECT o_orderstatus, o_orderpriority, max(o_orderkey) AS m FROM orders GROUP BY ALL) p USING (o_orderstatus, o_orderpriority)")
def _(spark, d):
    o = load(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority")
    return o.agg(F.count("*").alias("n")).join(o.agg(F.max("o_orderkey").alias("m")), ["o_orderstatus", "o_orderpriority"])


@query("join_null_safe", "SELECT a.p_partkey AS x, b.n FROM (SELECT p_partkey, nullif(p_size, 5) AS s FROM part) a JOIN (SELECT nullif(p_size, 5) AS s, count(*) AS n FROM part GROUP BY 1) b ON a.s IS NOT DISTINCT FROM b.s")
def _(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(5)).alias("s"))
    a, b = p.alias("a"), p.groupBy("s").agg(F.count("*").alias("n")).alias("b")
    return a.join(b, F.col("a.s").eqNullSafe(F.col("b.s"))).select(F.col("a.p_partkey").alias("x"), "b.n")


@query("join_null_keys", "SELECT a.p_partkey AS x FROM (SELECT p_partkey, nullif(p_size, 5) AS s FROM part) a LEFT JOIN (SELECT DISTINCT nullif(p_size, 5) AS s FROM part) b ON a.s = b.s WHERE b.s IS NULL")
def _(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(5)).alias("s"))
    return p.join(p.select("s").distinct(), "s", "left_anti").select(F.col("p_partkey").alias("x"))


@query("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(spark, d):
    n = load(spark, d, "nation").select("n_nationkey", "n_regionkey")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("x"), F.col("b.n_nationkey").alias("y"))


@query("join_array_contains", "SELECT n_nationkey, r_regionkey FROM nation, region WHERE list_contains([n_regionkey, 0], r_regionkey)")
def _(spark, d):
    n = load(spark, d, "nation").select("n_nationkey", F.explode(F.array_distinct(F.array("n_regionkey", F.lit(0)))).alias("r_regionkey"))
    return n.join(load(spark, d, "region").select("r_regionkey"), "r_regionkey").select("n_nationkey", "r_regionkey")


@query("join_broadcast", f"SELECT {_NATION} FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    """The hint is for tables of fixed size: the five regions."""
    r = F.broadcast(load(spark, d, "region"))
    return load(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


for _hint in ("merge", "shuffle_hash"):

    @query(f"join_{_hint}", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
    def _(spark, d, hint=_hint):
        o = load(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
        li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
        return o.hint(hint).join(li, o.o_orderkey == li.l_orderkey).select("o_orderkey", "l_linenumber")


@query("join_salted", "SELECT event_id, n FROM events JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) USING (event_type)")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", "event_type")
    return salted_join(e, e.groupBy("event_type").agg(F.count("*").alias("n")), ["event_type"]).select("event_id", "n")


@query("join_as_of", "SELECT e.event_id, p.event_id AS purchase FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase"))
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return as_of(clicks, bought, ["user_id"], "ts", "ts", ["purchase"]).select("event_id", "purchase")


@query("join_range", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 40")
def _(spark, d):
    spans = load(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 40).alias("high"))
    return range_join(load(spark, d, "part").select("p_partkey", "p_retailprice"), spans, "p_retailprice", "low", "high", 50.0).select("p_partkey", "s_suppkey")


# ---------------------------------------------------------------- set operations

_A = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'"
_B = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'"

for _name, _sql, _f in (
    ("union", "UNION ALL", lambda a, b: a.union(b)),
    ("union_all", "UNION ALL", lambda a, b: a.unionAll(b)),
    ("union_distinct", "UNION", lambda a, b: a.union(b).distinct()),
    ("union_by_name", "UNION ALL", lambda a, b: a.unionByName(b)),
    ("intersect", "INTERSECT", lambda a, b: a.intersect(b)),
    ("intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b)),
    ("except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b)),
    ("subtract", "EXCEPT", lambda a, b: a.subtract(b)),
):

    @query(f"set_{_name}", f"{_A} {_sql} {_B}")
    def _(spark, d, f=_f):
        o = load(spark, d, "orders")
        return f(o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")))


@query("set_union_by_name_missing", "SELECT r_regionkey AS k, r_name AS a, NULL AS b FROM region UNION ALL BY NAME SELECT n_name AS b, n_nationkey AS k, NULL AS a FROM nation")
def _(spark, d):
    a = load(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("a"))
    return a.unionByName(load(spark, d, "nation").select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("k")), allowMissingColumns=True)


# ---------------------------------------------------------------- reshaping and nulls


@query("rel_unpivot", "SELECT p_partkey, unnest(['p_size', 'twice']) AS name, unnest([p_size, p_size * 2]) AS v FROM part")
def _(spark, d):
    return load(spark, d, "part").selectExpr("p_partkey", "p_size", "p_size * 2 AS twice").unpivot("p_partkey", ["p_size", "twice"], "name", "v")


@query("rel_melt", "SELECT p_partkey, unnest(['p_size', 'half']) AS variable, unnest([p_size, p_size // 2]) AS value FROM part")
def _(spark, d):
    return load(spark, d, "part").selectExpr("p_partkey", "p_size", "CAST(p_size div 2 AS INT) AS half").melt(["p_partkey"], ["p_size", "half"], "variable", "value")


_HOLED = "SELECT p_partkey, nullif(p_size, 5) AS s, nullif(p_brand, 'Brand#13') AS b FROM part"


def _holed(spark, d):
    return load(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(5)).alias("s"), F.nullif(F.col("p_brand"), F.lit("Brand#13")).alias("b"))


for _name, _sql, _f in (
    ("dropna", f"SELECT * FROM ({_HOLED}) WHERE s IS NOT NULL AND b IS NOT NULL", lambda x: x.dropna()),
    ("dropna_subset", f"SELECT * FROM ({_HOLED}) WHERE s IS NOT NULL", lambda x: x.na.drop(subset=["s"])),
    ("dropna_thresh", f"SELECT * FROM ({_HOLED}) WHERE (s IS NOT NULL)::INT + (b IS NOT NULL)::INT >= 1", lambda x: x.dropna(thresh=2)),
    ("fillna", f"SELECT p_partkey, coalesce(s, 0) AS s, coalesce(b, '?') AS b FROM ({_HOLED})", lambda x: x.fillna({"s": 0, "b": "?"})),
    ("na_fill", f"SELECT p_partkey, coalesce(s, -1) AS s, b FROM ({_HOLED})", lambda x: x.na.fill(-1, ["s"])),
    ("replace", f"SELECT p_partkey, CASE s WHEN 1 THEN 100 WHEN 2 THEN 200 ELSE s END AS s, b FROM ({_HOLED})", lambda x: x.replace([1, 2], [100, 200], ["s"])),
    ("na_replace", f"SELECT p_partkey, s, CASE b WHEN 'Brand#12' THEN 'x' ELSE b END AS b FROM ({_HOLED})", lambda x: x.na.replace({"Brand#12": "x"}, subset=["b"])),
):

    @query(f"null_{_name}", _sql)
    def _(spark, d, f=_f):
        return f(_holed(spark, d))


# ---------------------------------------------------------------- statistics and samples


@query("stat_corr", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS v FROM lineitem")
def _(spark, d):
    return load(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("v"))


@query("stat_cov", "SELECT round(covar_samp(l_quantity, l_discount), 6) AS v FROM lineitem")
def _(spark, d):
    return load(spark, d, "lineitem").agg(F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("v"))


def _summary(x: DataFrame, texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """The row of a frame's summary; ``numbers`` are rounded."""
    pick = lambda s: F.max(F.when(F.col("summary") == s, F.col("p_size")))
    return x.agg(*[pick(s).alias(s) for s in texts], *[F.round(pick(s).cast("double"), 6).alias(s) for s in numbers])


_COUNTED = "count(p_size)::VARCHAR AS count, min(p_size)::VARCHAR AS min, max(p_size)::VARCHAR AS max, round(avg(p_size), 6) AS mean, round(stddev_samp(p_size), 6) AS stddev"


@query("stat_describe", f"SELECT {_COUNTED} FROM part")
def _(spark, d):
    return _summary(load(spark, d, "part").describe("p_size"), ["count", "min", "max"], ["mean", "stddev"])


@query("stat_summary", f'SELECT {_COUNTED}, quantile_disc(p_size, 0.5)::VARCHAR AS "50%", quantile_disc(p_size, 0.75)::VARCHAR AS "75%" FROM part')
def _(spark, d):
    x = load(spark, d, "part").select("p_size").summary("count", "min", "max", "mean", "stddev", "50%", "75%")
    return _summary(x, ["count", "min", "max", "50%", "75%"], ["mean", "stddev"])


@query("stat_crosstab", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    """``df.stat.crosstab``, whose columns the driver names, turned back to a row for each pair that occurs."""
    wide = load(spark, d, "orders").stat.crosstab("o_orderstatus", "o_orderpriority")
    key, *values = wide.columns
    return wide.unpivot(key, values, "o_orderpriority", "n").where("n > 0").withColumnRenamed(key, "o_orderstatus")


@query("stat_crosstab_wide", "SELECT o_orderstatus AS status, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (o_orderpriority NOT LIKE '1%') AS other FROM orders GROUP BY 1")
def _(spark, d):
    wide = load(spark, d, "orders").withColumn("p", F.when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("other")).stat.crosstab("o_orderstatus", "p")
    return wide.withColumnRenamed("o_orderstatus_p", "status")


@query("stat_freq_items")
def _(spark, d):
    return load(spark, d, "orders").stat.freqItems(["o_orderstatus"], 0.2)


@query("stat_approx_quantile", "SELECT true AS close")
def _(spark, d):
    """Within one percent of ranks of the exact median."""
    x = load(spark, d, "lineitem").agg(F.percentile_approx("l_quantity", 0.5, 1000).alias("a"), F.percentile("l_quantity", F.array(F.lit(0.48), F.lit(0.52))).alias("b"))
    return x.select(((F.col("a") >= F.col("b")[0]) & (F.col("a") <= F.col("b")[1])).alias("close"))


@query("stat_sample", "SELECT true AS plausible")
def _(spark, d):
    o = load(spark, d, "lineitem").select("l_orderkey")
    return o.sample(0.5, seed=7).agg(F.count("*").alias("n")).crossJoin(o.agg(F.count("*").alias("m"))).select((F.col("n") / F.col("m")).between(0.4, 0.6).alias("plausible"))


@query("stat_sample_by", "SELECT 'F' AS s")
def _(spark, d):
    return load(spark, d, "orders").sampleBy("o_orderstatus", {"F": 0.5}, seed=7).select(F.col("o_orderstatus").alias("s")).distinct()


@query("stat_random_split", "SELECT count(*) AS n FROM orders")
def _(spark, d):
    a, b = load(spark, d, "orders").select("o_orderkey").randomSplit([0.3, 0.7], seed=7)
    return a.union(b).agg(F.count("*").alias("n"))


@query("rel_observe", "SELECT count(*) AS n, max(o_orderkey) AS top FROM orders")
def _(spark, d):
    """What an observation saw while the rows went by to another use."""
    seen = Observation("seen")
    watched = load(spark, d, "orders").observe(seen, F.count("*").alias("n"), F.max("o_orderkey").alias("top"))
    watched.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"], seen.get["top"])], "n long, top long")


@query("rel_is_empty", "SELECT NOT EXISTS (FROM orders WHERE o_totalprice < 0) AS below, NOT EXISTS (FROM orders) AS whole")
def _(spark, d):
    o = load(spark, d, "orders")
    return spark.createDataFrame([(o.where("o_totalprice < 0").isEmpty(), o.isEmpty())], "below boolean, whole boolean")
