"""Streams over the message and sales feed: de-duplication, running figures, request rates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.operators.client_ops import not_seen
from tillwork.operators.kpis import exact_sum
from tillwork.staging import released, stage
from tillwork.streaming.seen import BUCKETS, SeenIds

REQUEST_LIMIT = 20
COMPACT_EVERY = 20


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time as a zoned timestamp (the session zone is UTC) with a watermark on streams."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay) if df.isStreaming else timed


def dedup_events(messages: DataFrame, delay: str = "1 day", ts: str = "event_ts") -> DataFrame:
    """Each message id once. Repeats are expected within ``delay``, which bounds the state kept;
    ``dedup_in_batches`` remembers for good.

    A stream has no map-side combine, so copies are first reduced per id and input partition: an
    id with very many copies then sends one row per partition to its task. Messages without an id
    cannot be told apart and all pass.
    """
    timed = with_event_time(messages, ts, delay)
    with_id = timed.filter("message_id <> ''")
    if messages.isStreaming:
        here = with_id.withColumn("_part", F.spark_partition_id())
        unique = here.dropDuplicatesWithinWatermark(["message_id", "_part"]).drop("_part").dropDuplicatesWithinWatermark(["message_id"])
    else:
        unique = with_id.dropDuplicates(["message_id"])
    return unique.unionByName(timed.filter("message_id is null or message_id = ''"))


def running_kpis(sales: DataFrame, keys: Sequence[str] = ("client_id",), ts: str = "sale_ts", delay: str = "2 days") -> DataFrame:
    """Revenue and rows per client and day so far; run it in update mode."""
    timed = with_event_time(sales, ts, delay)
    day = F.window(F.col(ts), "1 day")
    totals = timed.groupBy(*keys, day.alias("w")).agg(
        exact_sum("amount").alias("total"), F.count("*").alias("transactions")
    )
    return totals.select(*keys, F.to_date("w.start").alias("day"), "total", "transactions")


def rate_windows(
    requests: DataFrame,
    width: str = "1 minute",
    limit: int = REQUEST_LIMIT,
    keys: Sequence[str] = ("client_id",),
    ts: str = "event_ts",
    delay: str = "10 minutes",
) -> DataFrame:
    """Requests per key and fixed window, with the ones over the limit marked."""
    timed = with_event_time(requests, ts, delay)
    counts = timed.groupBy(*keys, F.window(F.col(ts), width).alias("w")).agg(F.count("*").alias("requests"))
    return counts.select(*keys, F.col("w.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("over_limit"))


def write_updates(changes: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ()):
    """Write each batch of changed rows to its own folder; a repeated batch replaces itself.

    With ``keys`` the log is compacted now and then, so that reading it does not grow with its length.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if keys:
            compact(batch.sparkSession, path, keys, batch_id)

    return changes.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Batch numbers of the complete ``kind=number`` folders under ``path``; file contents are not read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{path}/{kind}=*/_SUCCESS")
    done = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in done)


def batch_numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are written whole, in order."""
    return _numbers(spark, path, "batch")


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str], before: int | None = None) -> DataFrame:
    """Newest row per key out of what was written by batch, optionally up to a batch.

    Reads the newest snapshot that ``compact`` has left and the batches after it.
    """
    usable = lambda kind: [n for n in _numbers(spark, path, kind) if before is None or n < before]
    base = max(usable("base"), default=-1)
    tail = [f"{path}/batch={n}" for n in usable("batch") if n > base]
    parts = [spark.read.option("basePath", path).parquet(*tail)] if tail else []
    if base >= 0:
        parts.append(spark.read.parquet(f"{path}/base={base}").withColumn("batch", F.lit(base)))
    written = reduce(DataFrame.unionByName, parts)
    values = [c for c in written.columns if c not in (*keys, "batch")]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, *[F.col("v")[c].alias(c) for c in values])


def compact(spark: SparkSession, path: str, keys: Sequence[str], batch_id: int, every: int = COMPACT_EVERY) -> None:
    """After each ``every`` batches leave the newest row per key as a snapshot, so that later reads stay short.

    The batches stay as they are; a snapshot that a lost job left half written is not read.
    """
    if batch_id % every == every - 1:
        newest = latest_updates(spark, path, keys, before=batch_id + 1)
        newest.write.mode("overwrite").parquet(f"{path}/base={batch_id}")


def dedup_in_batches(messages: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """De-duplication that never forgets, as one job per micro-batch.

    ``path/fresh`` gets the messages whose id was in no earlier batch, by batch, so that a repeated batch
    replaces itself; their ids go to the store ``path/seen`` (``SeenIds``), in which a batch looks only at the
    ids of earlier ones. Messages without an id all pass.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        store = SeenIds(batch.sparkSession, f"{path}/seen", buckets)
        with released(batch.sparkSession):
            batch = stage(batch, "arrived")
            ids = stage(batch.select("message_id").filter("message_id <> ''").distinct(), "ids")
            fresh = stage(not_seen(batch, store.seen_of(ids, batch_id)), "fresh")
            fresh.write.mode("overwrite").parquet(f"{path}/fresh/batch={batch_id}")
            store.add(fresh.filter("message_id <> ''").select("message_id", F.col("event_ts").alias("created_at")), batch_id)

    return messages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
