"""Versioned tables over Parquet: snapshots, time travel, update, delete, merge, restore, vacuum.

A table is a folder with data files and a log. Each version is one log entry that adds and removes data files; every
tenth entry holds the whole state. A writer claims a version by creating a file (file systems refuse to create one
twice), writes the entry under another name and renames it, so readers see whole entries only; a claim that led to
nothing lapses after ``CLAIM_SECONDS``. On object stores that create files without that refusal, one writer at a time. A statement rewrites just the files that hold rows it changes: they are found by the statement's condition,
and the driver sees file names only. All row work is a distributed plan.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A whole state is logged at every so many versions.
WHOLE_EVERY = 10
CLAIM_SECONDS = 120
#: Bits of each column's place along the Z curve.
Z_BITS = 6
#: What OPTIMIZE writes to a file, and what one of its tasks sorts, at most about.
FILE_ROWS, FILE_BYTES = 2_000_000, 128 << 20


class ConcurrentWrite(RuntimeError):
    """Another writer made the version that this one was about to make."""


class AmbiguousMerge(ValueError):
    """A target row is matched by several source rows that would change it."""


@dataclass
class State:
    version: int
    schema: T.StructType
    files: dict[str, int]  # path within the table: rows
    partitions: list[str] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)


class Log:
    """Entries ``_log/<version>.json``, through Hadoop's file systems, so that any store will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def at(self, *parts: str):
        return self._path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        folder = self.at("_log")
        if not self.fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def read(self, version: int) -> dict:
        stream = self.fs.open(self.at("_log", f"{version:020d}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, entry: dict) -> None:
        name = f"{entry['version']:020d}"
        final, claim, draft = self.at("_log", f"{name}.json"), self.at("_log", f"_{name}.claim"), self.at("_log", f"_{uuid.uuid4().hex}.draft")
        taken = ConcurrentWrite(f"version {entry['version']} of {self.path}")
        if self.fs.exists(final):
            raise taken
        if self.fs.exists(claim) and self.fs.getFileStatus(claim).getModificationTime() < (time.time() - CLAIM_SECONDS) * 1000:
            self.fs.delete(claim, False)
        try:
            self.fs.create(claim, False).close()
        except Exception as e:
            if "already exists" in str(e).lower():
                raise taken from None
            raise
        try:
            if self.fs.exists(final):  # by a writer whose claim lapsed
                raise taken
            stream = self.fs.create(draft, False)
            try:
                stream.write(bytearray(json.dumps(entry).encode()))
            finally:
                stream.close()
            if not self.fs.rename(draft, final):
                raise taken
        finally:
            self.fs.delete(draft, False)
            self.fs.delete(claim, False)

    def state(self, version: int | None = None) -> State:
        have = self.versions()
        if not have:
            raise AnalysisException(f"{self.path} is not a versioned table")
        last = have[-1] if version is None else version
        if last not in have:
            raise AnalysisException(f"{self.path} has no version {version}")
        chain: list[dict] = []
        for v in reversed([v for v in have if v <= last]):
            chain.append(self.read(v))
            if "files" in chain[-1]:
                break
        files: dict[str, int] = {}
        for e in reversed(chain):
            files = dict(e["files"]) if "files" in e else {k: n for k, n in files.items() if k not in set(e["remove"])} | e["add"]
        e = chain[0]
        return State(last, T.StructType.fromJson(e["schema"]), files, e["partitions"], e["properties"])


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, alias: str | None = None):
        self.spark, self.path, self.name = spark, path.rstrip("/"), alias
        self.log = Log(spark, self.path)

    # ------------------------------------------------------------ where tables are

    @staticmethod
    def location(spark: SparkSession, name: str) -> str:
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/versioned/{name.replace('`', '').lower()}"

    @classmethod
    def for_name(cls, spark: SparkSession, name: str) -> VersionedTable:
        table = cls(spark, cls.location(spark, name))
        table.log.state()
        return table

    @classmethod
    def for_path(cls, spark: SparkSession, path: str) -> VersionedTable:
        table = cls(spark, path)
        table.log.state()
        return table

    @classmethod
    def exists(cls, spark: SparkSession, name: str) -> bool:
        return bool(Log(spark, cls.location(spark, name)).versions())

    @classmethod
    def create(cls, df: DataFrame, path: str, partition_by: list[str] | None = None, properties: dict[str, str] | None = None) -> VersionedTable:
        table = cls(df.sparkSession, path)
        if table.log.versions():
            raise AnalysisException(f"{path} exists")
        state = State(-1, _nullable(df.schema), {}, list(partition_by or []), dict(properties or {}))
        table._commit(state, "CREATE", table._written(df, state), [])
        return table

    def alias(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, self.path, name)

    # ------------------------------------------------------------ reading

    def version_at(self, timestamp) -> int:
        """The last version made at ``timestamp`` (a string, datetime or date, in the session's zone) or before."""
        ms = self.spark.sql("SELECT unix_millis(CAST(:t AS TIMESTAMP)) AS t", args={"t": str(timestamp)}).first()["t"]
        found = [v for v in self.log.versions() if self.log.read(v)["timestamp"] <= ms]
        if not found:
            raise AnalysisException(f"{self.path} has no version at {timestamp}")
        return found[-1]

    def to_df(self, version: int | None = None, timestamp=None) -> DataFrame:
        if timestamp is not None:
            version = self.version_at(timestamp)
        state = self.log.state(version)
        df = self._read(state, list(state.files))
        return df.alias(self.name) if self.name else df

    toDF = to_df

    def _read(self, state: State, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], state.schema)
        reader = self.spark.read.schema(state.schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*[f"{self.path}/data/{f}" for f in files])

    def history(self, limit: int | None = None) -> DataFrame:
        versions = self.log.versions()[::-1][:limit]
        rows = []
        for v in versions:
            e = self.log.read(v)
            rows.append((v, e["timestamp"] / 1000, e["operation"], {k: str(x) for k, x in e["parameters"].items()}, {k: str(x) for k, x in e["metrics"].items()}))
        schema = "version long, t double, operation string, operationParameters map<string,string>, operationMetrics map<string,string>"
        return self.spark.createDataFrame(rows, schema).withColumn("t", F.col("t").cast("timestamp")).withColumnRenamed("t", "timestamp")

    def detail(self) -> DataFrame:
        s = self.log.state()
        first, last = self.log.read(self.log.versions()[0]), self.log.read(s.version)
        row = ("versioned-parquet", self.path, first["timestamp"] / 1000, last["timestamp"] / 1000, s.partitions, len(s.files), sum(s.files.values()), s.properties)
        out = self.spark.createDataFrame([row], "format string, location string, c double, m double, partitionColumns array<string>, numFiles long, numRows long, properties map<string,string>")
        return out.withColumns({"createdAt": F.col("c").cast("timestamp"), "lastModified": F.col("m").cast("timestamp")}).drop("c", "m")

    # ------------------------------------------------------------ writing

    def _written(self, df: DataFrame, state: State) -> dict[str, int]:
        """Writes ``df`` as new data files and returns them with their rows."""
        batch = uuid.uuid4().hex
        target = f"{self.path}/data"
        shaped = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in state.schema])
        writer = shaped.write.mode("append").option("compression", "snappy")
        if state.partitions:
            writer = writer.partitionBy(*state.partitions)
        staged = f"{self.path}/_staged-{batch}"
        writer.parquet(staged)
        fs, found = self.log.fs, {}
        files = fs.listFiles(self.log._path(staged), True)
        moves = []
        while files.hasNext():
            p = files.next().getPath()
            if p.getName().endswith(".parquet"):
                inner = str(p.getParent().toString()).partition(f"_staged-{batch}")[2].strip("/")
                moves.append((p, f"{inner}/{batch}-{p.getName()}".strip("/")))
        counts = {}
        if moves:
            rows = self.spark.read.parquet(*[m[0].toString() for m in moves]).groupBy(F.col("_metadata.file_path").alias("f")).count().collect()
            counts = {_inner(r["f"], f"_staged-{batch}/"): r["count"] for r in rows}
        for p, name in moves:
            n = counts.get(p.toString().partition(f"_staged-{batch}/")[2], 0)
            if not n:
                continue
            to = self.log._path(f"{target}/{name}")
            fs.mkdirs(to.getParent())
            if not fs.rename(p, to):
                raise OSError(f"{p} could not be renamed to {to}; version {state.version} stays")
            found[name] = n
        fs.delete(self.log._path(staged), True)
        return found

    def _commit(self, state: State, operation: str, add: dict[str, int], remove: list[str], **parameters) -> int:
        files = {k: n for k, n in state.files.items() if k not in set(remove)} | add
        entry = {
            "version": state.version + 1,
            "timestamp": int(time.time() * 1000),
            "operation": operation,
            "parameters": parameters,
            "metrics": {"filesAdded": len(add), "filesRemoved": len(remove), "rows": sum(files.values())},
            "schema": state.schema.jsonValue(),
            "partitions": state.partitions,
            "properties": state.properties,
        }
        entry |= {"files": files} if entry["version"] % WHOLE_EVERY == 0 else {"add": add, "remove": remove}
        self.log.write(entry)
        return entry["version"]

    def append(self, df: DataFrame, merge_schema: bool = False) -> int:
        state = self._evolved(self.log.state(), df, merge_schema)
        return self._commit(state, "WRITE", self._written(_filled(df, state.schema), state), [], mode="append")

    def overwrite(self, df: DataFrame, replace_where: str | None = None, overwrite_schema: bool = False) -> int:
        """Replaces all rows, or those that satisfy ``replace_where``, which all rows of ``df`` must, too."""
        state = self.log.state()
        if replace_where:
            if not df.where(~F.coalesce(F.expr(replace_where), F.lit(False))).isEmpty():
                raise AnalysisException(f"rows to write do not satisfy {replace_where}")
            touched, kept = self._split(state, F.expr(replace_where))
            add = self._written(kept.unionByName(_filled(df, state.schema)), state)
            return self._commit(state, "WRITE", add, touched, mode="overwrite", predicate=replace_where)
        state = State(state.version, _nullable(df.schema), state.files, state.partitions, state.properties) if overwrite_schema else self._evolved(state, df, False)
        return self._commit(state, "WRITE", self._written(_filled(df, state.schema), state), list(state.files), mode="overwrite")

    def _evolved(self, state: State, df: DataFrame, merge: bool) -> State:
        known = {f.name.lower() for f in state.schema}
        new = [f for f in df.schema if f.name.lower() not in known]
        if new and not merge:
            raise AnalysisException(f"columns {[f.name for f in new]} are not in the table; merge_schema adds them")
        return State(state.version, _nullable(T.StructType([*state.schema, *new])), state.files, state.partitions, state.properties)

    def _names(self, rows: DataFrame) -> list[str]:
        found = rows.select(F.col("_metadata.file_path").alias("f")).distinct().collect()
        return [self._name(r["f"]) for r in found]

    def _name(self, file_path: str) -> str:
        """A data file's name in the log, from Spark's encoded path."""
        return _inner(file_path, f"{self.path.rpartition('/')[2]}/data/")

    def _split(self, state: State, condition: Column) -> tuple[list[str], DataFrame]:
        """The files with rows that satisfy ``condition``, and their other rows."""
        if not state.files:
            return [], self._read(state, [])
        touched = self._names(self._read(state, list(state.files)).where(condition))
        return touched, self._read(state, touched).where(~F.coalesce(condition, F.lit(False)))

    def delete(self, condition: str | Column | None = None) -> int:
        state = self.log.state()
        if condition is None:
            return self._commit(state, "DELETE", {}, list(state.files))
        touched, kept = self._split(state, _expr(condition))
        return self._commit(state, "DELETE", self._written(kept, state) if touched else {}, touched, predicate=str(condition))

    def update(self, condition: str | Column | None = None, set: dict[str, str | Column] | None = None) -> int:  # noqa: A002
        state = self.log.state()
        where = F.lit(True) if condition is None else _expr(condition)
        _check_columns(state.schema, set or {})
        if not state.files:
            return self._commit(state, "UPDATE", {}, [])
        touched = self._names(self._read(state, list(state.files)).where(where))
        rows = self._read(state, touched)
        to = {k.lower(): _expr(v) for k, v in (set or {}).items()}
        out = rows.select(*[F.when(where, to[f.name.lower()].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name.lower() in to else F.col(f.name) for f in state.schema])
        return self._commit(state, "UPDATE", self._written(out, state) if touched else {}, touched, predicate=str(condition))

    def merge(self, source: DataFrame, condition: str | Column, source_alias: str | None = None) -> Merge:
        return Merge(self, source, condition, source_alias)

    # ------------------------------------------------------------ upkeep

    def restore(self, version: int | None = None, timestamp=None) -> int:
        now, then = self.log.state(), self.log.state(self.version_at(timestamp) if timestamp is not None else version)
        gone = [f for f in then.files if not self.log.fs.exists(self.log.at("data", f))]
        if gone:
            raise AnalysisException(f"{len(gone)} files of version {then.version} were vacuumed")
        add = {f: n for f, n in then.files.items() if f not in now.files}
        state = State(now.version, then.schema, now.files, then.partitions, then.properties)
        return self._commit(state, "RESTORE", add, [f for f in now.files if f not in then.files], version=then.version)

    def vacuum(self, retention_hours: float = 168.0, dry_run: bool = False) -> list[str]:
        """Deletes data files that no version younger than the retention needs, and returns them."""
        since = time.time() * 1000 - retention_hours * 3_600_000
        versions = self.log.versions()
        young = [v for v in versions if self.log.read(v)["timestamp"] >= since] or versions[-1:]
        needed = set().union(*[self.log.state(v).files for v in {*young, versions[-1]}])
        files, gone = self.log.fs.listFiles(self.log.at("data"), True), []
        while files.hasNext():
            s = files.next()
            name = s.getPath().toString().partition(f"{self.path.rpartition('/')[2]}/data/")[2]
            if name.endswith(".parquet") and name not in needed and s.getModificationTime() < since:
                gone.append(name)
        if not dry_run:
            for name in gone:
                self.log.fs.delete(self.log.at("data", name), False)
        return sorted(gone)

    def optimize(self) -> Optimizer:
        return Optimizer(self)

    def alter(self, add: T.StructType | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None, cast: dict[str, T.DataType] | None = None, properties: dict[str, str] | None = None) -> int:
        """Changes columns or properties. Adding columns and properties touches no data; the rest rewrites it."""
        state = self.log.state()
        _check_columns(state.schema, [*(drop or []), *(rename or {}), *(cast or {})])
        fields = [T.StructField((rename or {}).get(f.name, f.name), (cast or {}).get(f.name, f.dataType), True) for f in state.schema if f.name not in (drop or [])]
        new = State(state.version, T.StructType([*fields, *(_nullable(add) if add else [])]), state.files, state.partitions, state.properties | (properties or {}))
        if not (drop or rename or cast):
            return self._commit(new, "ALTER", {}, [])
        rows = self._read(state, list(state.files)).drop(*(drop or []))
        for a, b in (rename or {}).items():
            rows = rows.withColumnRenamed(a, b)
        return self._commit(new, "ALTER", self._written(_filled(rows, new.schema), new), list(state.files))


class Optimizer:
    def __init__(self, table: VersionedTable, condition: str | None = None):
        self.table, self.condition = table, condition

    def where(self, condition: str) -> Optimizer:
        return Optimizer(self.table, condition)

    def _rewritten(self, shape, operation: str) -> int:
        t = self.table
        state = t.log.state()
        files = list(state.files) if self.condition is None else t._names(t._read(state, list(state.files)).where(self.condition))
        if not files:
            return state.version
        df = t._read(state, files)
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files
        parts = max(1, -(-sum(state.files[f] for f in files) // FILE_ROWS), -(-size // FILE_BYTES))
        return t._commit(state, operation, t._written(shape(df, parts), state), files)

    def execute_compaction(self) -> int:
        return self._rewritten(lambda df, n: df.repartition(n, F.xxhash64(*df.columns)), "OPTIMIZE")

    def z_order_by(self, *columns: str) -> int:
        """Rows along a Z curve of ``columns``: each column's place among its quantiles, bits interleaved, so that files
        hold narrow ranges of all of them. Nulls come first. Rows of one place are dealt over files in the order they
        are read, so that a value that many rows have doesn't make a large task."""

        def along(df: DataFrame, parts: int) -> DataFrame:
            numbers = {f"_n{i}": _number(c, df.schema[c].dataType) for i, c in enumerate(columns)}
            wide = df.withColumns(numbers)
            bounds = wide.approxQuantile(list(numbers), [k / (1 << Z_BITS) for k in range(1, 1 << Z_BITS)], 0.005)
            z = F.lit(0).cast("long")
            for i, (name, at) in enumerate(zip(numbers, bounds)):
                known = sorted(set(at))
                place = _below(known, F.col(name)) if known else F.lit(0)
                place = F.when(F.col(name).isNull(), 0).otherwise(place).cast("long")
                for bit in range(Z_BITS):
                    z = z.bitwiseOR(F.shiftleft(F.shiftright(place, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(columns) + i))
            dealt = wide.select(*df.columns, z.alias("_z"), F.monotonically_increasing_id().alias("_at")).repartitionByRange(parts, "_z", "_at")
            return dealt.drop("_at").sortWithinPartitions("_z").select(*df.columns)

        return self._rewritten(along, "OPTIMIZE")

    executeCompaction = execute_compaction
    zOrderBy = z_order_by


@dataclass
class Clause:
    kind: str  # matched, not_matched, not_matched_by_source
    action: str  # update, delete, insert
    condition: Column | None = None
    values: dict[str, Column] | None = None  # None: all columns, from the source


class Merge:
    """``table.merge(source, "t.id = s.id")`` with clauses, the first that applies to a row wins."""

    def __init__(self, table: VersionedTable, source: DataFrame, condition, source_alias: str | None = None):
        self.table, self.condition = table, _expr(condition)
        self.source = source.alias(source_alias) if source_alias else source
        self.source_alias = source_alias
        self.clauses: list[Clause] = []

    def _add(self, kind, action, condition, values) -> Merge:
        if values is not None:
            _check_columns(self.table.log.state().schema, values)
            values = {k.lower(): _expr(v) for k, v in values.items()}
        self.clauses.append(Clause(kind, action, None if condition is None else _expr(condition), values))
        return self

    def when_matched_update(self, set, condition=None):  # noqa: A002
        return self._add("matched", "update", condition, set)

    def when_matched_update_all(self, condition=None):
        return self._add("matched", "update", condition, None)

    def when_matched_delete(self, condition=None):
        return self._add("matched", "delete", condition, None)

    def when_not_matched_insert(self, values, condition=None):
        return self._add("not_matched", "insert", condition, values)

    def when_not_matched_insert_all(self, condition=None):
        return self._add("not_matched", "insert", condition, None)

    def when_not_matched_by_source_update(self, set, condition=None):  # noqa: A002
        return self._add("not_matched_by_source", "update", condition, set)

    def when_not_matched_by_source_delete(self, condition=None):
        return self._add("not_matched_by_source", "delete", condition, None)

    whenMatchedUpdate, whenMatchedUpdateAll, whenMatchedDelete = when_matched_update, when_matched_update_all, when_matched_delete
    whenNotMatchedInsert, whenNotMatchedInsertAll = when_not_matched_insert, when_not_matched_insert_all
    whenNotMatchedBySourceUpdate, whenNotMatchedBySourceDelete = when_not_matched_by_source_update, when_not_matched_by_source_delete

    def when_matched(self, condition=None) -> MergeAction:
        return MergeAction(self, "matched", condition)

    def when_not_matched(self, condition=None) -> MergeAction:
        return MergeAction(self, "not_matched", condition)

    def when_not_matched_by_source(self, condition=None) -> MergeAction:
        return MergeAction(self, "not_matched_by_source", condition)

    whenMatched, whenNotMatched, whenNotMatchedBySource = when_matched, when_not_matched, when_not_matched_by_source

    def _of_source(self, name: str) -> Column:
        return F.col(f"{self.source_alias}.{name}") if self.source_alias else self.source[name]

    def execute(self) -> int:
        t = self.table
        state = t.log.state()
        alias = t.name or "_target"
        source = self.source.withColumn("_from_source", F.lit(True))
        if self.source_alias:
            source = source.alias(self.source_alias)
        by_source = any(c.kind == "not_matched_by_source" for c in self.clauses)
        changes = by_source or any(c.kind == "matched" for c in self.clauses)
        touched: list[str] = []
        out = held = None
        every = list(state.files)
        if changes and every:
            whole = t._read(state, every)
            if by_source:
                touched = every
            else:
                hit = whole.select("*", F.col("_metadata.file_path").alias("_file")).alias(alias).join(source, self.condition, "left_semi")
                touched = [t._name(r[0]) for r in hit.select("_file").distinct().collect()]
        if touched:
            rows = t._read(state, touched).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_row")).alias(alias)
            met = rows.join(source, self.condition, "left")
            matched = F.col("_from_source").isNotNull()
            place = F.lit(None).cast("int")
            for i, c in reversed(list(enumerate(self.clauses))):
                if c.kind != "not_matched":
                    applies = (matched if c.kind == "matched" else ~matched) & (F.coalesce(c.condition, F.lit(False)) if c.condition is not None else F.lit(True))
                    place = F.when(applies, i).otherwise(place)
            met = met.withColumn("_clause", place).persist()  # one join for the checks and the rows
            held = met
            if by_source:  # files without a row that a clause applies to stay as they are
                changed = [r[0] for r in met.where("_clause is not null").select("_row.file_path").distinct().collect()]
                touched = [t._name(f) for f in changed]
                met = met.where(F.col("_row.file_path").isin(changed))
            rows_of = met.where(matched).groupBy("_row").agg(F.count("*").alias("n"), F.count("_clause").alias("m"))
            most = rows_of.agg(F.max("n"), F.max(F.when(F.col("n") > 1, F.col("m")))).first()
            if most[1]:
                held.unpersist()
                raise AmbiguousMerge("a target row is matched by several source rows")
            kept = met.where(~F.coalesce(F.col("_clause").isin(*[i for i, c in enumerate(self.clauses) if c.action == "delete"]), F.lit(False)))
            columns = []
            for f in state.schema:
                value = F.col(f"{alias}.{f.name}")
                for i, c in enumerate(self.clauses):
                    if c.action == "update" and (c.values is None or f.name.lower() in c.values):
                        new = self._of_source(f.name) if c.values is None else c.values[f.name.lower()]
                        value = F.when(F.col("_clause") == i, new.cast(f.dataType)).otherwise(value)
                columns.append(value.alias(f.name))
            many = (most[0] or 0) > 1
            # a row that several source rows match without a change stays single
            out = kept.select("_row", *columns).dropDuplicates(["_row"]).drop("_row") if many else kept.select(*columns)
        inserts = [c for c in self.clauses if c.kind == "not_matched"]
        if inserts:
            target = t._read(state, every).alias(alias)
            new = source.join(target, self.condition, "left_anti") if every else source
            place = F.lit(None).cast("int")
            for i, c in reversed(list(enumerate(inserts))):
                place = F.when(F.coalesce(c.condition, F.lit(False)) if c.condition is not None else F.lit(True), i).otherwise(place)
            new = new.withColumn("_clause", place).where("_clause is not null")
            columns = []
            for f in state.schema:
                value = F.lit(None).cast(f.dataType)
                for i, c in enumerate(inserts):
                    if c.values is None:
                        given = self._of_source(f.name) if f.name in self.source.columns else None
                    else:
                        given = c.values.get(f.name.lower())
                    if given is not None:
                        value = F.when(F.col("_clause") == i, given.cast(f.dataType)).otherwise(value)
                columns.append(value.alias(f.name))
            added = new.select(*columns)
            out = added if out is None else out.unionByName(added)
        try:
            add = t._written(out, state) if out is not None else {}
        finally:
            if held is not None:
                held.unpersist()
        return t._commit(state, "MERGE", add, touched)


class MergeAction:
    """``merge.whenMatched(condition)`` and its kin, before the action is said."""

    def __init__(self, merge: Merge, kind: str, condition):
        self._merge, self._kind, self._condition = merge, kind, condition

    def _said(self, action: str, values, *kinds: str) -> Merge:
        if self._kind not in kinds:
            raise ValueError(f"{action} does not go with {self._kind}")
        return self._merge._add(self._kind, action, self._condition, values)

    def update(self, set) -> Merge:  # noqa: A002
        return self._said("update", set, "matched", "not_matched_by_source")

    def update_all(self) -> Merge:
        return self._said("update", None, "matched")

    def delete(self) -> Merge:
        return self._said("delete", None, "matched", "not_matched_by_source")

    def insert(self, values) -> Merge:
        return self._said("insert", values, "not_matched")

    def insert_all(self) -> Merge:
        return self._said("insert", None, "not_matched")

    updateAll, insertAll = update_all, insert_all


def _inner(file_path: str, behind: str) -> str:
    return unquote(file_path).partition(behind)[2]


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def _filled(df: DataFrame, schema: T.StructType) -> DataFrame:
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _below(bounds: list[float], value: Column) -> Column:
    """How many of ``bounds`` a value is above."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < value))


def _number(column: str, kind: T.DataType) -> Column:
    """A number in a column's order, for texts by their first six characters' codes."""
    c = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        return F.conv(F.hex(F.rpad(F.substring(c, 1, 6).cast("binary"), 6, F.lit(b"\0"))), 16, 10).cast("double")
    if isinstance(kind, T.DateType | T.TimestampNTZType | T.TimestampType):
        return c.cast("timestamp").cast("double")
    return c.cast("double")


def _expr(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.expr(str(c))


def _check_columns(schema: T.StructType, names) -> None:
    known = {f.name.lower() for f in schema}
    bad = [n for n in names if n.lower() not in known]
    if bad:
        raise AnalysisException(f"no such columns: {bad}")
