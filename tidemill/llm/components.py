"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step groups by node with a partial minimum and joins that minimum back, so that a node with very many links is
never gathered; adaptive execution may split its partition. Each round's edges are a written table in the shared
folder. The driver sees two numbers a round; they settle nothing: the last two
edge sets are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_003)))).first()
    return row[0], row[1]


def _same(one: DataFrame, other: DataFrame) -> bool:
    """Whether two edge sets of equal size are equal."""
    return one.join(other, ["u", "v"], "left_anti").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(u, v) for each node u of ``edges`` (columns u, v) that isn't the least of its component, with v, the least.

    Self links and repeated links are allowed; an empty table gives no rows. Fails if ``rounds`` don't suffice (the
    number needed grows with the logarithm of the longest path).
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = _state(now)
    for _ in range(rounds):
        if not before[0]:
            return now
        last, now = now, written(_small_star(_large_star(now)), "cc")
        after = _state(now)
        if after == before and _same(last, now):  # the sums only tell when a comparison is worth its while
            return now
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def labelled(nodes: DataFrame, node: str, stars: DataFrame, label: str = "root") -> DataFrame:
    """``nodes`` with ``label``: the least node of the component that column ``node`` is in."""
    roots = small(stars.select(F.col("u").alias(node), F.col("v").alias(label)))
    return nodes.join(roots, node, "left").withColumn(label, F.coalesce(label, node))
