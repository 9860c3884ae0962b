"""Helpers shared by the training-data operators: shared-folder tables, size-checked broadcasts and
byte-bounded Arrow blocks."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import shared_dir

#: Most bytes of text that a Python worker holds as one block (a single longer text is a block of its own).
BLOCK_BYTES = 4 << 20
#: Largest estimated size of a table that is sent to every executor; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession, limit: int = BLOCK_BYTES) -> None:
    """From now on the session hands Python workers batches of about ``limit`` bytes at most, or one row each. By itself
    Spark fills batches of 10,000 rows or 64 MB, which executors hold twice, outside the heap and in the worker."""
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH, "64m"))) > limit:
        spark.conf.set(_BATCH, str(limit))


#: Tables that ``written`` made and nothing has deleted yet.
_made: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and read again after executors are lost. It is
    deleted when the ``scratch`` it was made in ends, or with the driver."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    try:
        _delete(_made)
    except Exception:  # the session has ended before: its owner clears the folder
        pass


def scratch(spark: SparkSession, make: Callable[[], DataFrame], label: str, lazy: bool = False) -> DataFrame:
    """What ``make`` gives, as a written table; the tables that ``make`` wrote on its way are deleted. With ``lazy``, a
    result that needed no such table is returned as it is."""
    mark = len(_made)
    result = make()
    made = _made[mark:]
    if lazy and not made:
        return result
    result = written(result, label)
    del _made[mark : mark + len(made)]
    _delete(made)
    return result


def release(docs: DataFrame) -> None:
    """Deletes the tables of earlier steps that ``docs`` does not read: for chains in which each step's result is a
    table of its own before the next begins. If ``docs`` reads anything but files, nothing is deleted."""
    roots: list[str] = []
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    try:
        for i in range(leaves.size()):
            found = leaves.apply(i).relation().location().rootPaths()
            roots += [found.apply(k).toString() for k in range(found.size())]
    except Exception:  # a leaf without files
        return
    dead = [t for t in _made if t[0] is docs.sparkSession and not any(t[1].rpartition("/")[2] in r for r in roots)]
    _made[:] = [t for t in _made if t not in dead]
    _delete(dead)


def estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the optimizer's size estimate is within ``limit``; unchanged otherwise, so that
    the join shuffles and adaptive execution may split its skewed partitions."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def id_text(column: str | Column) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batches`` whose texts in ``column`` add up to ``limit`` bytes at most, or one row each."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    _tidy()


def _tidy() -> None:
    """Hands memory that a task has freed back to the system: Python workers are used again by tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def append_columns(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    compute: Callable[[list], list[pa.Array]],
    drop: tuple[str, ...] = (),
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """``df`` with ``fields`` appended (columns of those names, and ``drop``, go first). ``compute`` gets the texts of
    a block (of ``limit`` bytes at most, or one text), None for null, and returns one Arrow array for each field."""
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new and f.name not in drop]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *fields])
    all_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, column, limit):
            extra = compute(block.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([block.column(n) for n in names] + extra, names=all_names)

    source = df.select(*dict.fromkeys([*names, column]))
    return source.mapInArrow(run, schema)
