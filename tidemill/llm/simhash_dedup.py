"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints differ in t bits in all, some segment i is
the start of a chain whose first l segments differ in at most l * t / 4 bits together, for every l (Qin and Xiao,
2018): 0, 1, 2 and 3 bits for t = 3. So candidates agree in segment i, differ in one bit at most in segment i + 1, and
hence agree in one of its halves: each fingerprint is filed under (i, half, 24 bits), eight times. Pairs within a
bucket pass the chain's budgets of 1 and 2 bits before the full Hamming check.

Copies are folded first: only distinct fingerprints take part. Within a bucket links are searched breadth-first, so a
dense bucket costs about its size and gives a spanning forest, not all pairs. A bucket of more than ``bucket_rows``
fingerprints is filed again: what is left of the ring's bits is cut into four, of which at least one part agrees, until
buckets are small enough (with 12 bits left they hold 4,096 fingerprints at most, with 3 all of them are linked). No
pair is lost.

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked like any other;
shorter texts than a shingle are one shingle; repeated rows each get a row; a null id gets a row, and takes no part in
minima; an empty table gives no rows; extra columns take no part; of a very long text (a block of its own) the words and
shingles of one slice are held at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append_columns, small, written
from .components import components, labelled
from .word_slices import shingle_hashes

SEED = 42
SEGMENTS, WIDTH, MOST = 4, 16, 3
#: Largest bucket that is searched as one block.
BUCKET_ROWS = 4096
#: Bits of each group of shingles that are counted at once.
_COUNT_ROWS = 1 << 16


def majority(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes, given part by part, unsigned."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashes in parts:
        total += len(hashes)
        for at in range(0, len(hashes), _COUNT_ROWS):
            bits = np.unpackbits(hashes[at : at + _COUNT_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a whole text, unsigned."""
    return majority(shingle_hashes(text, shingle, SEED))


def with_fingerprints(df: DataFrame, text: str = "text", drop: tuple[str, ...] = (), shingle: int = 3) -> DataFrame:
    """``df`` with ``fp``, the fingerprint as a signed long."""

    def compute(texts: list) -> list[pa.Array]:
        prints = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return [pa.array(prints.view(np.int64))]

    return append_columns(df, text, [T.StructField("fp", T.LongType())], compute, drop)


def _ring(fp: np.ndarray, start: int) -> np.ndarray:
    """Fingerprints turned so that segment ``start`` is the lowest."""
    shift = np.uint64(WIDTH * start)
    return fp if not start else (fp >> shift) | (fp << (np.uint64(64) - shift))


def chained(x: np.ndarray) -> np.ndarray:
    """Whether differences (turned to the chain's start) stay within each prefix's budget; the last is the full
    Hamming check, of those that pass the others."""
    near = np.ones(len(x), dtype=bool)
    for length in range(1, SEGMENTS + 1):
        at = np.flatnonzero(near)
        part = x[at] if length == SEGMENTS else x[at] & np.uint64((1 << (WIDTH * length)) - 1)
        near[at] = np.bitwise_count(part) <= length * MOST // SEGMENTS
    return near


def links_in_bucket(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct ``fps`` (unsigned) whose chain begins at segment ``start``."""
    turned = _ring(fps, start)
    left = np.arange(len(fps))
    found: list[tuple[int, int]] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = chained(turned[left] ^ turned[x])
            if near.any():
                new = left[near]
                left = left[~near]
                queue.extend(new)
                found.extend((int(fps[x]), int(fps[y])) for y in new)
    return found


#: A filing: which bits of the turned ring are fixed. ``start`` and the parts chosen so far are the path.
def first_filing(fps: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, mask, key) of each of the eight filings of fingerprints: segment i, and a half of segment i + 1."""
    for start in range(SEGMENTS):
        turned = _ring(fps, start)
        for half in range(2):
            mask = 0xFFFF | (0xFF << (16 + 8 * half))
            yield start, mask, turned & np.uint64(mask)


def finer_masks(mask: int) -> list[int]:
    """The masks that file a bucket of ``mask`` again: its free bits are cut into ``MOST + 1`` parts, one of which two
    linked fingerprints agree in."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k :: MOST + 1]) for k in range(MOST + 1)]


_FILED = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "mask", "key", "fp")])
_LINKS = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "mask", "fp", "other")])


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).astype(np.uint64).view(np.int64))


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for start, mask, key in first_filing(fps):
            n = len(fps)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, start)), _signed(np.full(n, mask, np.uint64)), _signed(key), _signed(fps)], names=_FILED.names)


def _file_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        starts = batch.column("start").to_numpy()
        masks = batch.column("mask").to_numpy().view(np.uint64)
        for start in np.unique(starts).tolist():
            for mask in np.unique(masks[starts == start]).tolist():
                own = fps[(starts == start) & (masks == mask)]
                turned = _ring(own, start)
                for finer in finer_masks(mask):
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, start)), _signed(np.full(n, finer, np.uint64)), _signed(turned & np.uint64(finer)), _signed(own)], names=_FILED.names)


def _search(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by bucket: links of buckets up to ``limit`` rows (other: the fingerprint linked to), and the
        rows of larger ones (other: null)."""

        def out(start, mask, a, b):
            return pa.RecordBatch.from_arrays([pa.array(start, pa.int64()), _signed(mask), _signed(a), b], names=_LINKS.names)

        def settle(start: int, mask: int, fps: np.ndarray) -> None:
            pairs = links_in_bucket(fps, start)
            if pairs:
                links.extend(pairs)

        held: list[np.ndarray] = []
        bucket, rows, large = None, 0, False
        links: list[tuple[int, int]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            start = batch.column("start").to_numpy()
            mask = batch.column("mask").to_numpy().view(np.uint64)
            key = batch.column("key").to_numpy().view(np.uint64)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            turn = np.flatnonzero((start[1:] != start[:-1]) | (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            cuts = [0, *turn.tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                this = (int(start[a]), int(mask[a]), int(key[a]))
                if this != bucket:
                    if rows > 1 and not large:
                        settle(bucket[0], bucket[1], np.concatenate(held))
                    bucket, held, rows, large = this, [], 0, False
                rows += b - a
                held.append(fp[a:b])
                if not large and rows > limit and this[1].bit_count() < 64 - MOST:  # with fewer free bits all are linked
                    large = True
                if large:
                    rest = np.concatenate(held)
                    held = []
                    yield out(np.full(len(rest), this[0]), np.full(len(rest), this[1], np.uint64), rest, pa.nulls(len(rest), pa.int64()))
            if len(links) > 50_000:
                yield from emit(links, out)
                links = []
        if rows > 1 and not large:
            settle(bucket[0], bucket[1], np.concatenate(held))
        yield from emit(links, out)

    def emit(links, out):
        if links:
            pairs = np.array(links, dtype=np.uint64)
            yield out(np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.uint64), pairs[:, 0], _signed(pairs[:, 1]))

    return run


def links(prints: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column ``fp``) that connect all those at ``MOST`` or fewer differing
    bits: each bucket's spanning forest."""
    filed = prints.select("fp").mapInArrow(_file, _FILED)
    found = []
    while True:
        dealt = filed.repartition(F.col("start"), F.col("mask"), F.col("key")).sortWithinPartitions("start", "mask", "key")
        out = written(dealt.mapInArrow(_search(bucket_rows), _LINKS), "simhash-links")
        found.append(out.where("other is not null").select(F.col("fp").alias("u"), F.col("other").alias("v")))
        again = out.where("other is null").drop("other")
        if again.isEmpty():
            break
        filed = again.select("start", "mask", "fp").mapInArrow(_file_again, _FILED)
    total = found[0]
    for more in found[1:]:
        total = total.union(more)
    return total


def classes(narrow: DataFrame, id_col: str = "doc_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each distinct ``fp`` of ``narrow``: ``root``, the least fingerprint of its component, and
    ``component_id``, the least id."""
    prints = written(narrow.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    rooted = labelled(prints, "fp", components(links(prints, bucket_rows)))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "simhash-classes")


def assign(df: DataFrame, id_col: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS, shingle: int = 3) -> DataFrame:
    """A row for each row of ``df``: its id, ``fp``, ``root`` and ``component_id``, the smallest id of its component."""
    narrow = written(with_fingerprints(df.select(id_col, text), text, drop=(text,), shingle=shingle), "simhash-fp")
    return narrow.join(small(classes(narrow, id_col, bucket_rows)), "fp")


def keep_first(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row of each component of ``df``, that with the smallest id, with its columns as they were. Rows without an
    id yield to those with one; of rows that share the smallest id, or of a component without ids, one stays."""
    narrow = written(with_fingerprints(df.select(id_col, text), text, drop=(text,), shingle=shingle), "simhash-fp")
    return first_rows(df, narrow, classes(narrow, id_col), lambda rows, column, drop: with_fingerprints(rows, column, drop, shingle), id_col, text)


def keep_similar(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``keep_first``, of components by a five-word Jaccard similarity of 0.8 or more: links of fingerprints, held
    against whole sets, and then the pairs that majority bits can't show (see ``similar_sets``)."""
    from . import similar_sets

    return similar_sets.keep_first(df, id_col, text)


def first_rows(df: DataFrame, narrow: DataFrame, found: DataFrame, prints: Callable[..., DataFrame], id_col: str, text: str) -> DataFrame:
    """The rows that ``keep_first`` keeps, by ``narrow`` (id and ``fp`` of each row), the classes ``found`` of ``fp``, and
    ``prints``, which adds ``fp`` to rows."""
    gone = narrow.join(small(found), "fp").where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    gone = small(written(gone, "simhash-gone"))
    odd = narrow.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull())
    odd = written(odd.select(F.col(id_col).alias("_odd")), "simhash-odd")
    if odd.isEmpty():
        return df.join(gone, id_col, "left_anti").select(*df.columns)
    # an id that repeats doesn't tell which of its texts goes: its rows are decided by their own fingerprints
    marked = df.join(small(odd), F.col(id_col).eqNullSafe(F.col("_odd")), "left")
    plain = marked.where(F.col("_odd").isNull() & F.col(id_col).isNotNull()).join(gone, id_col, "left_anti").select(*df.columns)
    rest = marked.where(F.col("_odd").isNotNull() | F.col(id_col).isNull())
    rest = prints(rest.select(F.struct(*df.columns).alias("_row"), F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text", drop=("_text",))
    rest = rest.join(small(found), "fp").where(F.col("component_id").isNull() | (F.col("_id") == F.col("component_id")))
    return plain.union(rest.dropDuplicates(["root"]).select("_row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    from ._common import documents

    found = assign(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
