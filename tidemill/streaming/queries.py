"""Streams over ``events``: windows, watermarks, deduplication, joins and state, each run to the end of its input.

A file stream reads the table in micro-batches; ``availableNow`` ends it. Results go to Parquet files in the shared
folder, never to the driver, and the registered query reads them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..tables import load, shared_dir


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The table as a stream, its time a timestamp with zone, as watermarks need it."""
    static = load(spark, folder, "events")
    stream = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 64).option("pathGlobFilter", "*.parquet")
    path = f"{folder}/events.parquet"
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = stream.parquet(path) if fs.getFileStatus(found).isDirectory() else stream.option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def checkpoint(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs ``stream`` until its input is used up and returns what it wrote, exactly once: append results go to a file
    sink; of complete and update ones each batch has a folder, which a batch that is run again writes anew. A complete
    result is the last batch's, an update result all batches'."""
    spark = stream.sparkSession
    at = checkpoint(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/rows/batch=-1")
    writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{at}/rows/batch={i}")).start().awaitTermination()
    rows = spark.read.option("basePath", f"{at}/rows").parquet(f"{at}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def batches(stream: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    """Hands every micro-batch of ``stream`` to ``each``."""
    at = checkpoint(stream.sparkSession)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


@query("stream_filter", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def _(spark, d):
    return finished(events(spark, d).where("event_type = 'purchase'").select("event_id", "user_id"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    counts = events(spark, d).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return finished(counts, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1")
def _(spark, d):
    counts = events(spark, d).groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return finished(counts, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_watermark_append", """SELECT start, n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY 1)
WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(spark, d):
    """Only windows that the watermark has passed are written."""
    counts = events(spark, d).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return finished(counts).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_session", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def _(spark, d):
    counts = events(spark, d).withWatermark("ts", "60 days").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return finished(counts, "complete").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return finished(events(spark, d).select("user_id", "event_type").dropDuplicates())


@query("stream_dedup_watermark", "SELECT event_id FROM events")
def _(spark, d):
    twice = events(spark, d).withColumn("i", F.explode(F.array(F.lit(1), F.lit(2))))
    return finished(twice.withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id"))


@query("stream_static_join", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def _(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return finished(events(spark, d).select("event_id", "user_id").join(c, "user_id").select("event_id", "c_name"))


@query("stream_stream_join", "SELECT v.event_id AS view, p.event_id AS purchase FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 2 HOUR")
def _(spark, d):
    v = events(spark, d).where("event_type = 'view'").selectExpr("event_id AS view", "user_id", "ts AS seen").withWatermark("seen", "60 days")
    p = events(spark, d).where("event_type = 'purchase'").selectExpr("event_id AS purchase", "user_id AS buyer", "ts AS bought").withWatermark("bought", "60 days")
    return finished(v.join(p, F.expr("user_id = buyer AND bought BETWEEN seen AND seen + INTERVAL 2 HOURS")).select("view", "purchase"))


def running_totals(key: tuple, batches: Iterator, state) -> Iterator:
    import pandas as pd

    n, total = state.get if state.exists else (0, 0.0)
    for pdf in batches:
        n, total = n + len(pdf), total + float(pdf["value"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


@query("stream_state", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def _(spark, d):
    """Custom state: the last update of each user holds its totals."""
    updates = events(spark, d).select("user_id", "value").groupBy("user_id").applyInPandasWithState(running_totals, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")
    return finished(updates, "update").groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 2).alias("total"))


@query("stream_foreach_batch", "SELECT count(*) AS n FROM events")
def _(spark, d):
    out = checkpoint(spark)
    batches(events(spark, d).select("event_id"), lambda df, i: df.write.mode("append").parquet(out))
    return spark.read.parquet(out).agg(F.count("*").alias("n"))


def dropped_off(spark: SparkSession, folder: str, late: str) -> DataFrame:
    """``events`` as a stream of three files in the order of time, one a batch; rows that meet ``late`` come with the last."""
    at = checkpoint(spark)
    rows = load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = F.expr(f"ts >= TIMESTAMP '2024-01-20' OR ({late})")
    first = F.expr("ts < TIMESTAMP '2024-01-10'") & ~last
    for part in (first, ~first & ~last, last):
        rows.where(part).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)


#: Rows of the first days that arrive with the last file, when the watermark has passed them.
_LATE = "ts < TIMESTAMP '2024-01-05' AND event_id % 3 = 0"
_ON_TIME = f"SELECT * FROM events WHERE NOT ({_LATE})"


@query("stream_late_rows", f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM ({_ON_TIME}) GROUP BY 1
HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def _(spark, d):
    """Three batches: windows close as the watermark passes, and rows behind it are dropped."""
    counts = dropped_off(spark, d, _LATE).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return finished(counts).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_dedup_evicts", f"SELECT event_id FROM ({_ON_TIME})")
def _(spark, d):
    """Each row twice, in three batches: copies go, state behind the watermark is evicted, late rows are dropped."""
    twice = dropped_off(spark, d, _LATE).withColumn("i", F.explode(F.array(F.lit(1), F.lit(2))))
    return finished(twice.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"]).select("event_id"))


@query("stream_update_batches", "SELECT event_type, count(*) AS n, 3 AS batches FROM events GROUP BY 1")
def _(spark, d):
    """Update mode over three batches: each writes the groups that it changed; the largest count is the last."""
    counts = dropped_off(spark, d, "false").groupBy("event_type").agg(F.count("*").alias("n"))
    return finished(counts, "update").groupBy("event_type").agg(F.max("n").alias("n"), F.count("*").cast("int").alias("batches"))
