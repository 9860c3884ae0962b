"""Near-duplicates by similarity: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of
``LEAST`` or more. Nothing is sampled or estimated. It is the near-duplicate operator's mode for a stated similarity, in
two steps. First the operator's own: a set's SimHash fingerprint is filed and searched by pigeonring chains as in
``simhash_dedup``, and the sets of linked fingerprints are held against each other whole. The bits by which majority
fingerprints differ do not bound the similarity of sets, so a second step finds, among sets that these links leave in
different components, the pairs that they can't show. For it a set also has a parity bit for each of ``PARITY`` bins of
shingles. Two sets differ in at least as many shingles as their parities in bits, so with a similarity s of sets of m and
n shingles parities differ in (m + n) * (1 - s) / (1 + s) bits at most.

* Candidates: in any one order of all shingles, two such sets share one of their first n - ceil(s * n) + 1 shingles, so
  only these are filed (Chaudhuri et al., 2006). The order puts the ``FREQUENT`` most frequent shingles last, by how
  often they repeat within chunks of texts, the others first, by hash: common lines are hardly filed. Any order finds
  all pairs; the bound decides only how many candidates there are. Two sets in a bucket are a candidate unless their
  sizes, or the shingles left behind the shared one, rule the similarity out.
* Pigeonring filtering: a candidate's parities, a ring of four segments, must have a chain of segments whose
  differences stay within proportional budgets; then the whole Hamming distance must stay within the pair's own.
* What is left is checked on whole sets.

Texts are read again whenever sets are needed, so these are never stored whole: tables hold the fingerprints of each
document, candidates, and the sets of what is left. Copies are folded first: only distinct sets take part. In a bucket of more
than ``BUCKET_ROWS`` sets, those of like size are held against one of them first; then a search by breadth
over the pairs that parities leave connects most of it; at last, all pairs that the links found so far leave in different
components are held against each other, by parities within the bucket. A dense group costs about its size, and no pair is
lost.

Defined results: as for fingerprints (see ``simhash_dedup``); a text without words is like others without words only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append_columns, blocks, small, written
from .components import components, labelled
from .simhash_dedup import first_rows, majority
from .simhash_dedup import links as print_links
from .word_slices import shingle_hashes

SEED, SHINGLE = 42, 5
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
#: Largest bucket whose pairs are all candidates at once.
BUCKET_ROWS = 2
#: Shingles of a chunk that are counted together, those of a chunk and of all chunks that are told apart by frequency.
CHUNK, CHUNK_FREQUENT, FREQUENT = 1 << 19, 1 << 13, 1 << 18
#: Bits of a set's parity fingerprint, and the segments of its ring.
PARITY, SEGMENTS = 1024, 4
_PAIR_ROWS = 1 << 16
#: Sets of a batch that a Python worker handles at once.
_SET_ROWS = 512


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle."""
    found = [np.unique(hashes) for hashes in shingle_hashes(text, shingle, SEED)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *found]))


def set_key(found: np.ndarray) -> int:
    """The name of a set; zero for that without shingles."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0


def parity(found: np.ndarray) -> np.ndarray:
    """For each bin, whether an odd number of the set's shingles are in it; as whole 64-bit words."""
    odd = np.bincount((found >> np.uint64(54)).astype(np.int64) & (PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def may_be_alike(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether parities (a row for each pair) leave pairs of ``both`` shingles together the least similarity."""
    x, y = LEAST
    most = both * (y - x) // (x + y)
    live = np.arange(len(most))
    parts = np.bitwise_count(a ^ b).reshape(len(most), SEGMENTS, PARITY // 64 // SEGMENTS).sum(axis=2, dtype=np.int64)
    chained = np.zeros(len(most), dtype=bool)
    for start in range(SEGMENTS):
        total, fine = np.zeros(len(live), dtype=np.int64), np.ones(len(live), dtype=bool)
        for length in range(1, SEGMENTS + 1):
            total = total + parts[live, (start + length - 1) % SEGMENTS]
            fine &= total * SEGMENTS <= length * most[live]
        chained[live[fine]] = True
        live = live[~fine]
    return chained & (parts.sum(axis=1) <= most)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.uint64).view(np.int64)))


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([set_key(s) for s in sets], dtype=np.uint64).view(np.int64)


def with_keys(df: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``fp``, the key of the text's set."""
    return append_columns(df, text, [T.StructField("fp", T.LongType())], lambda texts: [pa.array(_keys([shingles(t) for t in texts]))], drop)


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    a, b = LEAST
    return n - -(-a * n // b) + 1


def alike(shared: np.ndarray | int, both: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of ``both`` shingles together that share ``shared`` have the least similarity."""
    a, b = LEAST
    return (a + b) * shared >= a * both


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SET_ROWS):
            yield batch.slice(at, _SET_ROWS)


def _arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum([0, *column.value_lengths().to_pylist()])
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


_POSTS = T.StructType([T.StructField("gram", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("rest", T.IntegerType())])
_PAIRS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), *_POSTS.fields])
_LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
_SETS = T.StructType([T.StructField("fp", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))])


def describe(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row for each row of ``df``: its id, ``fp``, ``n`` (shingles), ``print`` (the set's SimHash) and ``parity``; and, with
    ``gram``, of each chunk its most frequent shingles and in how many sets (``n``) they are."""
    more = (("fp", T.LongType()), ("n", T.LongType()), ("print", T.LongType()), ("parity", T.BinaryType()), ("gram", T.LongType()))
    schema = T.StructType([df.schema[id_col], *(T.StructField(c, t) for c, t in more)])

    def frequent(held: list[np.ndarray], of) -> Iterator[pa.RecordBatch]:
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        at = np.flatnonzero(n > 1)
        if len(at) > CHUNK_FREQUENT:
            at = at[np.argpartition(-n[at], CHUNK_FREQUENT)[:CHUNK_FREQUENT]]
        if len(at):
            none = [pa.nulls(len(at), t) for t in (of, pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none[:2], pa.array(n[at]), *none[2:], pa.array(grams[at].view(np.int64))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have, of = [], 0, None
        for block in blocks(batches, text):
            sets = [shingles(t) for t in block.column(text).to_pylist()]
            of = block.column(id_col).type
            n = pa.array([len(s) for s in sets], pa.int64())
            prints = pa.array(np.array([majority([s]) for s in sets], dtype=np.uint64).view(np.int64))
            parities = pa.array([parity(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([block.column(id_col), pa.array(_keys(sets)), n, prints, parities, pa.nulls(len(sets), pa.int64())], names=schema.names)
            held += sets
            have += sum(map(len, sets))
            if have > CHUNK:
                yield from frequent(held, of)
                held, have = [], 0
        if held:
            yield from frequent(held, of)

    return df.select(id_col, text).mapInArrow(run, schema)


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text: str) -> DataFrame:
    """The texts of the rows of ``docs`` whose id is in ``ids`` (column ``least``); with a null there, all texts without
    an id, too, once each."""
    found = docs.join(small(ids.select(F.col("least").alias(id_col))), id_col, "left_semi").select(text)
    if ids.where("least is null").isEmpty():
        return found
    return found.union(docs.where(F.col(id_col).isNull()).groupBy(F.md5(text)).agg(F.first(text).alias(text)).select(text))


def _often(s: np.ndarray, known: np.ndarray, often: np.ndarray) -> np.ndarray:
    """How often each of the shingles ``s`` is, by the sorted ``known`` ones; others are rare."""
    if not len(known):
        return np.zeros(len(s), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    return np.where(known[at] == s, often[at], 0)


def _post(order, text: str):
    """The shingles that sets are filed under; ``rest``: how many of the set come behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = order.value
        for block in blocks(batches, text):
            own = [shingles(t) for t in block.column(text).to_pylist()]
            grams, sizes, rests = [], [], []
            for s in own:
                k = prefix_length(len(s)) if len(s) else 0
                grams.append(s[np.argsort(_often(s, known, often), kind="stable")[:k]] if k else s)
                sizes.append(k)
                rests.append(len(s) - 1 - np.arange(k))
            if sum(sizes):
                n = np.fromiter(map(len, own), dtype=np.int32, count=len(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.repeat(_keys(own), sizes)), pa.array(np.repeat(n, sizes)), pa.array(np.concatenate(rests), pa.int32())],
                    names=_POSTS.names,
                )

    return run


def _sets(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            own = [shingles(t) for t in block.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(_keys(own)), _lists(own)], names=_SETS.names)

    return run


def _may(n, rest, i: int, others: np.ndarray) -> np.ndarray:
    """Those of ``others`` whose similarity to ``i`` sizes and shingles left do not rule out."""
    a, b = LEAST
    fits = (b * n[others] >= a * n[i]) & (b * n[i] >= a * n[others])
    return others[fits & alike(1 + np.minimum(rest[i], rest[others]), n[i] + n[others])]


def star_pairs(n: np.ndarray, rest: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Of a bucket sorted by size: each set against one of like size."""
    a, b = LEAST
    out, at = [], 0
    while at < len(n):
        upto = int(np.searchsorted(n, b * n[at] // a, side="right"))
        out.append((at, _may(n, rest, at, np.arange(at + 1, upto))))
        at = upto
    return out


def all_pairs(n: np.ndarray, rest: np.ndarray, root: np.ndarray | None = None, parities: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Of a bucket sorted by size: all pairs, or those whose ``root`` differs and that ``parities`` (a row for each set)
    leave."""
    a, b = LEAST
    for i in range(len(n) - 1):
        others = np.arange(i + 1, int(np.searchsorted(n, b * n[i] // a, side="right")))
        if root is not None:
            others = others[root[others] != root[i]]
        if not len(others):
            continue
        others = _may(n, rest, i, others)
        if parities is not None:
            for at in range(0, len(others), _PAIR_ROWS):
                part = others[at : at + _PAIR_ROWS]
                yield i, part[may_be_alike(parities[i], parities[part], n[i] + n[part])]
        else:
            yield i, others


def forest(n: np.ndarray, rest: np.ndarray, root: np.ndarray, parities: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of a bucket: pairs across ``root`` that parities leave, no more than connect all that such pairs connect. A search
    by breadth, so a dense bucket costs about its size."""
    left = np.arange(len(n))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = root[left] == root[x]
            others = np.flatnonzero(~near)
            fits = np.isin(left[others], _may(n, rest, x, left[others]), assume_unique=True)
            others = others[fits]
            others = others[may_be_alike(parities[x], parities[left[others]], n[x] + n[left[others]])]
            if len(others):
                yield x, left[others]
            near[others] = True
            queue.extend(left[near].tolist())
            left = left[~near]


def _pairs(limit: int, rooted: Callable | None = None):
    """Candidates of rows sorted by (gram, n, fp). Buckets of more than ``limit`` rows give stars, and their rows (u is
    null); with ``rooted`` (``forest`` or ``all_pairs``) there are columns ``root`` and ``parity``, and all buckets give its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, large, have = [], [], [], 0

        def out():
            nonlocal us, vs, large, have
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
                none = [pa.nulls(len(pairs), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), *none], names=_PAIRS.names)
            for part in large:
                none = pa.nulls(len(part[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *map(pa.array, part)], names=_PAIRS.names)
            us, vs, large, have = [], [], [], 0

        def settle(held):
            nonlocal have
            gram, fp, n, rest, *more = (np.concatenate(c) for c in zip(*held))
            wide = n.astype(np.int64)
            if rooted:
                found = rooted(wide, rest, *more)
            elif len(fp) > limit:
                found = star_pairs(wide, rest)
                large.append((gram, fp, n, rest))
            else:
                found = all_pairs(wide, rest)
            for i, others in found:
                if len(others):
                    us.append(np.full(len(others), fp[i]))
                    vs.append(fp[others])
                    have += len(others)
                    if have > _PAIR_ROWS:
                        yield from out()

        held: list[list[np.ndarray]] = []
        bucket, behind = None, (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in (*_POSTS.names, *(["root"] if rooted else []))]
            if rooted:
                columns.append(np.frombuffer(b"".join(batch.column("parity").to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1))
            gram, key = columns[:2]
            first = np.r_[(gram[0], key[0]) != behind, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])]
            behind = (gram[-1], key[-1])
            if not first.all():  # rows that share an id and a text
                columns = [c[first] for c in columns]
                gram = columns[0]
                if not len(gram):
                    continue
            cuts = np.r_[0, np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram)]
            ends = len(cuts) - 2
            # single rows within a batch are in no bucket; the first and last may go on elsewhere
            for k in np.flatnonzero((np.diff(cuts) > 1) | (np.arange(ends + 1) == 0) | (np.arange(ends + 1) == ends)).tolist():
                part = [c[cuts[k] : cuts[k + 1]] for c in columns]
                if held and bucket != part[0][0]:
                    if sum(len(h[0]) for h in held) > 1:
                        yield from settle(held)
                    held = []
                bucket = part[0][0]
                held.append(part)
        if held and sum(len(h[0]) for h in held) > 1:
            yield from settle(held)
        yield from out()

    return run


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose whole sets have the least similarity."""
    for batch in _slices(batches):
        near = [bool(alike(len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b))) for a, b in zip(_arrays(batch, "a"), _arrays(batch, "b"))]
        yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that parities leave."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for c in ("a", "b"))
        both = batch.column("m").to_numpy() + batch.column("n").to_numpy()
        yield batch.select(["u", "v"]).filter(pa.array(may_be_alike(a, b, both), pa.bool_()))


def _verified(pairs: DataFrame, described: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    pairs = written(pairs.select("u", "v").distinct(), "similar-pairs")
    side = described.select(F.col("fp").alias("u"), F.col("parity").alias("a"), F.col("n").alias("m"))
    other = described.select(F.col("fp").alias("v"), F.col("parity").alias("b"), "n")
    pairs = written(pairs.join(side, "u").join(other, "v").mapInArrow(_unlike, _LINKS), "similar-near")
    needed = written(pairs.select(F.col("u").alias("fp")).union(pairs.select(F.col("v").alias("fp"))).distinct(), "similar-needed")
    ids = written(described.join(small(needed), "fp", "left_semi").select("least"), "similar-needed-ids")
    sets = _texts(docs, ids, id_col, text).mapInArrow(_sets(text), _SETS).join(small(needed), "fp", "left_semi")
    held = written(sets.dropDuplicates(["fp"]), "similar-needed-sets")
    both = pairs.join(held.select(F.col("fp").alias("u"), F.col("grams").alias("a")), "u").join(held.select(F.col("fp").alias("v"), F.col("grams").alias("b")), "v")
    return written(both.select("u", "v", "a", "b").mapInArrow(_check, _LINKS), "similar-links")


def by_prints(described: DataFrame) -> DataFrame:
    """Pairs (u, v) of the sets ``described`` that connect all those whose fingerprints are linked (see
    ``simhash_dedup.links``): sets that share a fingerprint are paired with the least of them, those with each other."""
    prints = written(described.groupBy("print").agg(F.min("fp").alias("head")), "similar-prints")
    near = print_links(prints.select(F.col("print").alias("fp")))
    heads = small(prints)
    across = near.join(heads.select(F.col("print").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("print").alias("v"), F.col("head").alias("b")), "v")
    within = described.select("fp", "print").join(heads, "print").where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    return across.select("a", "b").union(within).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _apart(pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """The pairs whose sets are in different components."""
    return labelled(labelled(pairs, "u", stars, "a"), "v", stars, "b").where("a <> b").select("u", "v")


def links(described: DataFrame, often: DataFrame, docs: DataFrame, id_col: str, text: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) between the distinct sets ``described`` (``fp``, ``least`` id, ``n``, ``print``, ``parity``) that connect
    all those of the least similarity. ``docs`` has the texts."""
    found = _verified(by_prints(described), described, docs, id_col, text)
    counted = often.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(FREQUENT).toArrow()
    grams = counted.column("gram").to_numpy().view(np.uint64)
    by = np.argsort(grams)
    order = described.sparkSession.sparkContext.broadcast((grams[by], counted.column("n").to_numpy()[by]))
    posts = _texts(docs, described, id_col, text).mapInArrow(_post(order, text), _POSTS)
    dealt = posts.repartition("gram").sortWithinPartitions("gram", "n", "fp")
    out = written(dealt.mapInArrow(_pairs(bucket_rows), _PAIRS), "similar-candidates")
    apart = _apart(out.where("u is not null"), components(found))
    found = found.union(_verified(apart, described, docs, id_col, text))
    large = out.where("u is null").drop("u", "v")
    if large.isEmpty():
        return found
    for rooted in (forest, all_pairs):  # most of what is left is connected before all pairs are held against each other
        rows = labelled(large, "fp", components(found))
        mixed = rows.groupBy("gram").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("gram")
        rows = rows.join(small(written(mixed, "similar-mixed")), "gram", "left_semi")
        rows = rows.join(described.select("fp", "parity"), "fp").select(*_POSTS.names, "root", "parity")
        again = rows.repartition("gram").sortWithinPartitions("gram", "n", "fp").mapInArrow(_pairs(bucket_rows, rooted), _PAIRS)
        found = found.union(_verified(again, described, docs, id_col, text))
    return found


def keep_first(df: DataFrame, id_col: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row of each component of ``df``, that with the smallest id, as ``simhash_dedup.keep_first`` chooses it."""
    docs = df.select(id_col, text)
    rows = written(describe(docs, id_col, text), "similar-rows")
    narrow = rows.where("gram is null").select(id_col, "fp")
    described = rows.where("gram is null").groupBy("fp").agg(F.min(id_col).alias("least"), *(F.max(c).alias(c) for c in ("n", "print", "parity")))
    described = written(described, "similar-distinct")
    found = links(described, rows.where("gram is not null").select("gram", "n"), docs, id_col, text, bucket_rows)
    rooted = labelled(described.select("fp", "least"), "fp", components(found))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(rooted.select("fp", "root").join(small(written(least, "similar-least")), "root").select("fp", "root", "component_id"), "similar-classes")
    return first_rows(df, narrow, classes, with_keys, id_col, text)
