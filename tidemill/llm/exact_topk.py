"""Exact top-k search by inner product with a KD-tree per shard.

Vectors become integers (``floor(64 * x)``). Shards are cells of space: median splits of the widest dimension, fitted on
a sample of ``SAMPLE_ROWS`` rows at most, deal all rows; a cell that holds more than a shard (many equal vectors, or
more rows than the sample tells apart) is dealt further by a hash. Each shard becomes a KD-tree: median splits
down to small leaves, every node with its tight bounding box and its smallest id. A query walks a tree best-first: nodes
wait in a heap by the bound of the inner product over their box, which is taken when their parent is opened, and the
walk ends when no waiting node can beat the k-th result so far. Each query first visits the shard that it lies in; the
k-th score found there goes along as the bound, and the query is sent only to shards whose root's box reaches it. Ties
go to smaller ids; a node or shard whose bound ties with the k-th score is left out only if its ids are all larger.

A task holds one tree and one batch of queries: a shard's tree comes first in its sorted partition and the queries
stream past it. ``QUERIES_PER_TREE`` bounds how many queries one copy of a tree serves. Root boxes go to the executors if
they take ``BOX_BYTES`` or less, else each query is sent to every shard. Where vectors have no structure (boxes of all shards reach every
query's k-th score), an exact search is queries times rows; only structure lets boxes leave shards out.

Defined results: vectors that are null, or hold null or non-finite components (also once scaled), and rows without an
id take no part; an empty vector takes part (its products are 0); vectors of different length are not compared; a
query's own row is not its candidate, other rows with its id are; query rows that share an id ask each for
themselves; with fewer candidates than ``k`` all are returned; repeated rows are candidates each; scores beyond a long
are clipped; an empty table gives no rows; extra columns take no part; there are no texts.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small, written

#: Rows of a shard, about; of a leaf, at most; queries that one copy of a tree serves, about.
SHARD_ROWS = 4096
LEAF_ROWS = 256
QUERIES_PER_TREE = 200_000
#: Rows that the cells are fitted on, at most, about; most bytes of root boxes that are sent to executors.
SAMPLE_ROWS = 50_000
BOX_BYTES = 64 << 20
#: Sums of products below this are exact in double precision.
EXACT = 2.0**53


@dataclass
class Tree:
    """Nodes in preorder: ``lo``, ``hi`` (boxes), ``first``, ``last`` (rows), ``right`` (child; 0 for a leaf, whose
    left child would be the next node) and ``least`` (id). ``rows`` tells rows that share an id apart."""

    x: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray
    right: np.ndarray
    least: np.ndarray

    @staticmethod
    def build(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
        order = np.arange(len(x))
        nodes: list[list] = []

        def split(a: int, b: int) -> int:
            own = order[a:b]
            part = x[own]
            lo, hi = part.min(axis=0), part.max(axis=0)
            me = len(nodes)
            nodes.append([lo, hi, a, b, 0, ids[own].min()])
            if b - a > leaf:
                middle = (b - a) // 2
                if len(lo):
                    axis = int((hi - lo).argmax())
                    order[a:b] = own[np.argpartition(part[:, axis], middle)]
                split(a, a + middle)
                nodes[me][4] = split(a + middle, b)
            return me

        split(0, len(x))
        lo, hi, first, last, right, least = zip(*nodes)
        as_int = lambda v: np.array(v, dtype=np.int64)
        return Tree(x[order], ids[order], rows[order], np.array(lo), np.array(hi), as_int(first), as_int(last), as_int(right), as_int(least))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def loads(data: bytes) -> Tree:
        with np.load(io.BytesIO(data), allow_pickle=False) as held:
            return Tree(**{k: held[k] for k in held.files})

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, bounds: list[tuple[float, int] | None]) -> list[list[tuple[float, int]]]:
        """(score, id) of each query's best rows here, best first, of those that beat its bound: a (score, id) that
        ``k`` rows elsewhere reach. ``own``: the query's own row, which is left out."""
        if len(queries) and np.abs(queries).max(initial=0) * np.abs(self.x).max(initial=0) * self.x.shape[1] >= EXACT:
            return self._search_all(queries, own, k)
        return [self._one(queries[i], int(own[i]), k, bounds[i]) for i in range(len(queries))]

    def _one(self, q: np.ndarray, own: int, k: int, bound: tuple[float, int] | None) -> list[tuple[float, int]]:
        best: list[tuple[float, int]] = []  # a heap of (score, -id), the worst on top
        worst = (bound[0], -bound[1]) if bound else (-np.inf, 0)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        waiting = [(-float(up @ self.hi[0] + down @ self.lo[0]), int(self.least[0]), 0)]
        while waiting:
            top, least, node = heapq.heappop(waiting)
            if -top < worst[0]:
                break
            if -top == worst[0] and -least < worst[1]:
                continue
            if self.right[node]:
                children = [node + 1, int(self.right[node])]
                for child, reach in zip(children, (self.hi[children] @ up + self.lo[children] @ down).tolist()):
                    if reach >= worst[0]:
                        heapq.heappush(waiting, (-reach, int(self.least[child]), child))
                continue
            a, b = self.first[node], self.last[node]
            score = self.x[a:b] @ q
            at = np.flatnonzero(score >= worst[0])
            if len(at) > k + 1:  # of which one may be the query's own
                at = at[np.lexsort((self.ids[a:b][at], -score[at]))[: k + 1]]
            for i in at.tolist():
                found = (float(score[i]), -int(self.ids[a + i]))
                if int(self.rows[a + i]) == own or found <= worst and (len(best) == k or bound):
                    continue
                heapq.heappush(best, found)
                if len(best) > k:
                    heapq.heappop(best)
                if len(best) == k:
                    worst = max(worst, best[0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]

    def _search_all(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """By whole numbers of any size, where double precision would round."""
        rows = [[int(v) for v in r] for r in self.x]
        out = []
        for q, me in zip(queries, own):
            whole = [int(v) for v in q]
            found = [(sum(a * b for a, b in zip(r, whole)), int(i)) for r, i, at in zip(rows, self.ids, self.rows) if at != me]
            out.append(sorted(found, key=lambda f: (-f[0], f[1]))[:k])
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


_KEY = [T.StructField("dim", T.IntegerType()), T.StructField("cell", T.LongType()), T.StructField("salt", T.LongType())]
_TREES = T.StructType([*_KEY, T.StructField("lo", T.ArrayType(T.DoubleType())), T.StructField("hi", T.ArrayType(T.DoubleType())), T.StructField("least", T.LongType()), T.StructField("tree", T.BinaryType())])
_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "query_row", "vec_id", "score")])


def _runs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Slices of a sorted batch with equal ``names``."""
    columns = [batch.column(c).to_numpy() for c in names]
    turn = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
    cuts = [0, *turn.tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of a partition that is sorted by shard."""

    def out(key, parts):
        tree = Tree.build(*(np.concatenate(c) for c in zip(*parts)))
        values = [*key, tree.lo[0].tolist(), tree.hi[0].tolist(), int(tree.least[0]), tree.dumps()]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=_TREES.names)

    key, parts = None, []
    for batch in batches:
        for this, own in _runs(batch, "dim", "cell", "salt"):
            if this != key:
                if parts:
                    yield out(key, parts)
                key, parts = this, []
            parts.append((_matrix(own.column("vector"), this[0]), own.column("vec_id").to_numpy(), own.column("row").to_numpy()))
    if parts:
        yield out(key, parts)


def _searching(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition sorted by (shard, copy, kind): a tree, then the queries that it serves."""
        tree, of = None, None
        for batch in batches:
            for (*key, kind), own in _runs(batch, "dim", "cell", "salt", "copy", "kind"):
                if kind == 0:
                    tree, of = Tree.loads(own.column("tree")[0].as_py()), key
                    continue
                if of != key:  # no row is in the shard
                    continue
                for at in range(0, own.num_rows, 512):
                    part = own.slice(at, 512)
                    me, ids = part.column("query_row").to_numpy(), part.column("query_id").to_numpy()
                    score, other = part.column("bound").to_pylist(), part.column("bound_id").to_pylist()
                    bounds = [None if s is None else (float(s), i) for s, i in zip(score, other)]
                    found = tree.search(_matrix(part.column("vector"), key[0]), me, k, bounds)
                    sizes = [len(f) for f in found]
                    flat = [x for f in found for x in f]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(ids, sizes), pa.int64()),
                            pa.array(np.repeat(me, sizes), pa.int64()),
                            pa.array([i for _, i in flat], pa.int64()),
                            pa.array([max(-(2**63), min(2**63 - 1, int(s))) for s, _ in flat], pa.int64()),
                        ],
                        names=_FOUND.names,
                    )

    return run


def whole_vectors(df: DataFrame, id_col: str, vector: str, scale: int = 64) -> DataFrame:
    """(row, vec_id, dim, vector): scaled components as whole doubles, of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") * F.lit(float(scale)))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    # a double is floored by its remainder: floor() itself gives a long, which large components overflow
    floored = F.transform("v", lambda x: x - F.pmod(x, F.lit(1.0)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), floored.alias("vector"))


#: A node of the cells' tree: (axis, bound, node behind the bound; the one before it comes next) or the number of a cell.
Cells = list[tuple[int, float, int] | int]


def fit_cells(x: np.ndarray, cells: int) -> Cells:
    """Median splits of a sample into ``cells`` cells at most; a cell of equal vectors is not split."""
    out: Cells = []
    made = 0

    def split(part: np.ndarray, want: int) -> None:
        nonlocal made
        width = part.max(axis=0) - part.min(axis=0) if len(part) and part.shape[1] else np.zeros(0)
        axis = int(width.argmax()) if len(width) else 0
        if want > 1 and len(part) > 1 and len(width) and width[axis] > 0:
            bound = float(np.median(part[:, axis]))
            low = part[:, axis] < bound
            if not low.any():  # the median is the least value
                bound = float(part[part[:, axis] > bound, axis].min())
                low = part[:, axis] < bound
            me = len(out)
            out.append(0)
            split(part[low], want // 2)
            out[me] = (axis, bound, len(out))
            split(part[~low], want - want // 2)
        else:
            out.append(made)
            made += 1

    split(x, cells)
    return out


def cell_of(cells: Cells, x: np.ndarray) -> np.ndarray:
    found = np.zeros(len(x), dtype=np.int64)
    waiting = [(0, np.arange(len(x)))]
    while waiting:
        node, at = waiting.pop()
        if isinstance(cells[node], int):
            found[at] = cells[node]
        elif len(at):
            axis, bound, right = cells[node]
            low = x[at, axis] < bound
            waiting += [(node + 1, at[low]), (right, at[~low])]
    return found


def _dealt(rows: DataFrame, n: int, shard_rows: int, sample_rows: int) -> DataFrame:
    """``rows`` with ``cell`` and ``salt``, their shard."""
    every = max(1, -(-n // sample_rows))
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("dim", "vector").toArrow()  # sample_rows or so
    dims, cells = sample.column("dim").to_numpy(), {}
    vectors = sample.column("vector").combine_chunks() if sample.num_rows else None
    for dim in np.unique(dims).tolist():
        own = _matrix(vectors.filter(pa.array(dims == dim)), dim)
        # no more cells than the sample tells apart; hashing deals the rest
        cells[dim] = fit_cells(own, max(1, min(-(-len(own) * every // shard_rows), len(own) // 8)))
    held = rows.sparkSession.sparkContext.broadcast(cells)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            found = np.zeros(batch.num_rows, dtype=np.int64)
            for d in np.unique(dim).tolist():
                if d in held.value:
                    at = np.flatnonzero(dim == d)
                    found[at] = cell_of(held.value[d], _matrix(batch.column("vector").take(pa.array(at)), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=schema.names)

    celled = written(rows.mapInArrow(run, schema), "topk-cells")
    salts = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(shard_rows)).alias("salts"))
    salt = F.pmod(F.xxhash64("row"), F.col("salts")).alias("salt")
    return celled.join(small(written(salts, "topk-salts")), ["dim", "cell"]).select("row", "vec_id", "dim", "vector", "cell", salt)


def _routed(asked: DataFrame, trees: DataFrame) -> DataFrame:
    """``asked`` (with its home shard and its bound) for each other shard whose root's box reaches the bound."""
    boxes = trees.select("dim", "cell", "salt", "least", "lo", "hi")
    there = boxes.agg(F.count("*"), F.sum(F.size("lo"))).first()
    if 16 * (there[1] or 0) + 32 * there[0] > BOX_BYTES:
        home = asked.withColumnsRenamed({"cell": "_c", "salt": "_s"})
        met = home.join(boxes.select("dim", "cell", "salt"), "dim").where("cell <> _c OR salt <> _s")
        return met.select(*asked.columns)
    table = boxes.toArrow()
    by: dict[int, tuple] = {}
    for dim in set(table.column("dim").to_pylist()):
        own = table.filter(pa.array(table.column("dim").to_numpy() == dim)).combine_chunks().to_batches()[0]
        by[dim] = (*(own.column(c).to_numpy() for c in ("cell", "salt", "least")), _matrix(own.column("lo"), dim), _matrix(own.column("hi"), dim))
    held = asked.sparkSession.sparkContext.broadcast(by)
    names = asked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    own = batch.filter(pa.array(dims == dim))
                    cell, salt, least, lo, hi = held.value[dim]
                    q = _matrix(own.column("vector"), dim)
                    reach = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
                    bound = np.array([-np.inf if b is None else float(b) for b in own.column("bound").to_pylist()])[:, None]
                    behind = own.column("bound_id").fill_null(2**63 - 1).to_numpy()[:, None]
                    # sums this large are rounded: those shards are all visited
                    loose = np.abs(reach) >= EXACT
                    go = loose | (reach > bound) | ((reach == bound) & (least[None, :] < behind))
                    go &= (own.column("cell").to_numpy()[:, None] != cell[None, :]) | (own.column("salt").to_numpy()[:, None] != salt[None, :])
                    query, shard = np.nonzero(go)
                    if len(query):
                        out = own.take(pa.array(query))
                        to = {"cell": pa.array(cell[shard], pa.int64()), "salt": pa.array(salt[shard], pa.int64())}
                        yield pa.RecordBatch.from_arrays([to.get(c, out.column(c)) for c in names], names=names)

    return asked.mapInArrow(run, asked.schema)


def _visit(trees: DataFrame, asked: DataFrame, copies: int, k: int) -> DataFrame:
    """Results of ``asked`` (shard, query_id, query_row, vector, bound, bound_id), each in the shard it names."""
    copy = F.pmod(F.xxhash64("query_row"), F.lit(copies)).cast("int")
    left = trees.select("dim", "cell", "salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"), "tree")
    right = asked.select("dim", "cell", "salt", copy.alias("copy"), F.lit(1).alias("kind"), "query_id", "query_row", "vector", "bound", "bound_id")
    dealt = left.unionByName(right, allowMissingColumns=True).repartition("dim", "cell", "salt", "copy").sortWithinPartitions("dim", "cell", "salt", "copy", "kind")
    return dealt.mapInArrow(_searching(k), _FOUND)


def top_k(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of each row whose id is divisible by ``every``."""
    rows = written(whole_vectors(df, id_col, vector), "topk-vectors")
    n = rows.count()
    rows = written(_dealt(rows, n, shard_rows, sample_rows), "topk-dealt")
    trees = rows.repartition("dim", "cell", "salt").sortWithinPartitions("dim", "cell", "salt").mapInArrow(_build, _TREES)
    trees = written(trees, "topk-trees")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("dim", "cell", "salt", F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), "vector")
    copies = max(1, -(-n // every // QUERIES_PER_TREE))
    nothing = {"bound": F.lit(None).cast("long"), "bound_id": F.lit(None).cast("long")}
    first = written(_visit(trees, asked.withColumns(nothing), copies, k), "topk-home")
    worst = F.min(F.struct("score", (-F.col("vec_id")).alias("minus"))).alias("worst")
    kth = first.groupBy("query_row").agg(worst, F.count("*").alias("n")).where(F.col("n") >= k)
    kth = kth.select("query_row", F.col("worst.score").alias("bound"), (-F.col("worst.minus")).alias("bound_id"))
    bounded = asked.join(small(written(kth, "topk-bounds")), "query_row", "left").select(*asked.columns, "bound", "bound_id")
    found = first.union(_visit(trees, _routed(bounded, trees), copies, k))
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from ._common import documents

    return top_k(documents(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
