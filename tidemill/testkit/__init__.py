"""Support for tests: seeded frames from a schema, rule-based checks of columns, fault injection, frame comparison.

Generated rows are functions of a row number and a seed, made by Spark: any number of them, in any partitioning, comes
out the same.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.testing import assertDataFrameEqual

__all__ = ["Faults", "assert_columns", "assert_rows", "assertDataFrameEqual", "coerced", "corrupted", "generated", "rule_column", "timed", "validated"]


def _value(kind: T.DataType, h: Column) -> Column:
    n = F.pmod(h, F.lit(1_000_000))
    if isinstance(kind, T.StringType):
        return F.concat(F.lit("s"), F.pmod(h, F.lit(1000)).cast("string"))
    if isinstance(kind, T.BooleanType):
        return F.pmod(h, F.lit(2)) == 0
    if isinstance(kind, T.DateType):
        return F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(h, F.lit(1500)).cast("int"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_seconds(n * 100 + 1_577_836_800).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.transform(F.sequence(F.lit(0), F.pmod(h, F.lit(4)).cast("int")), lambda i: _value(kind.elementType, F.xxhash64(h, i)))
    if isinstance(kind, T.StructType):
        return F.struct(*[_value(f.dataType, F.xxhash64(h, F.lit(f.name))).alias(f.name) for f in kind])
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return (n / 100).cast(kind)
    return F.pmod(h, F.lit(100)).cast(kind)


def generated(spark: SparkSession, schema: T.StructType | str, rows: int, seed: int = 0, null_share: float = 0.0) -> DataFrame:
    """``rows`` rows of ``schema``; ``null_share`` of the values of nullable columns are null."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = []
    for f in schema:
        h = F.xxhash64("id", F.lit(seed), F.lit(f.name))
        value = _value(f.dataType, h)
        if null_share and f.nullable:
            value = F.when(F.pmod(F.xxhash64(h), F.lit(10_000)) >= int(null_share * 10_000), value)
        out.append(value.alias(f.name))
    return spark.range(rows).select(*out)


def corrupted(df: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """``df`` with ``share`` of all values set to null."""
    row = F.xxhash64(*df.columns, F.lit(seed))
    return df.select(*[F.when(F.pmod(F.xxhash64(row, F.lit(c)), F.lit(10_000)) >= int(share * 10_000), F.col(c)).alias(c) for c in df.columns])


#: Rule names and what they ask of a column.
RULES: dict[str, Callable[..., Column]] = {
    "not_null": lambda c: c.isNotNull(),
    "positive": lambda c: c > 0,
    "non_negative": lambda c: c >= 0,
    "non_empty": lambda c: F.length(c) > 0,
    "at_least": lambda c, n: c >= n,
    "at_most": lambda c, n: c <= n,
    "between": lambda c, a, b: c.between(a, b),
    "one_of": lambda c, *values: c.isin(*values),
    "matches": lambda c, pattern: c.rlike(pattern),
}


def rule_column(column: str, rule: str | tuple | Column) -> Column:
    """A boolean column: whether ``column`` satisfies ``rule`` (a name, or a name with arguments); never null."""
    if isinstance(rule, Column):
        return F.coalesce(rule, F.lit(False))
    name, *args = (rule,) if isinstance(rule, str) else rule
    return F.coalesce(RULES[name](F.col(column), *args), F.lit(False))


def validated(df: DataFrame, rules: dict[str, list]) -> DataFrame:
    """``df`` with ``failed``, the names of the columns whose rules a row breaks."""
    checks = [F.when(~rule_column(c, r), F.lit(c)) for c, rs in rules.items() for r in rs]
    return df.withColumn("failed", F.array_distinct(F.array_compact(F.array(*checks))))


def coerced(df: DataFrame, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """``df`` cast to ``schema``: values that don't fit become null, or an error if ``strict``."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*[(F.col(f.name).cast(f.dataType) if strict else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in schema])


def assert_rows(df: DataFrame, n: int) -> None:
    found = df.count()
    assert found == n, f"{found} rows, not {n}"


def assert_columns(df: DataFrame, *names: str) -> None:
    assert df.columns == list(names), f"columns {df.columns}, not {list(names)}"


class Faults:
    """Raises errors from, or delays, methods of an object (a session, a reader) while active."""

    def __init__(self, target):
        self.target = target
        self.rules: dict[str, tuple[Callable[..., bool], BaseException | None, float]] = {}

    def fail(self, method: str, error: BaseException, when: Callable[..., bool] = lambda *a, **k: True) -> Faults:
        self.rules[method] = (when, error, 0.0)
        return self

    def delay(self, method: str, seconds: float) -> Faults:
        self.rules[method] = (lambda *a, **k: True, None, seconds)
        return self

    def __enter__(self) -> Faults:
        for name, (when, error, seconds) in self.rules.items():
            plain = getattr(self.target, name)

            def wrapped(*args, _plain=plain, _when=when, _error=error, _seconds=seconds, **kwargs):
                if _when(*args, **kwargs):
                    time.sleep(_seconds)
                    if _error is not None:
                        raise _error
                return _plain(*args, **kwargs)

            setattr(self.target, name, wrapped)
        return self

    def __exit__(self, *exc) -> None:
        for name in self.rules:
            delattr(self.target, name)


@contextmanager
def timed() -> Iterator[dict[str, float]]:
    out: dict[str, float] = {}
    began = time.perf_counter()
    yield out
    out["seconds"] = time.perf_counter() - began
