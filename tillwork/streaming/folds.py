"""Registration and chat mode over the message stream, as one batch job per micro-batch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.operators.folds import chat_fold
from tillwork.sources.text_sales import text_sales
from tillwork.staging import released, stage
from tillwork.streaming.windows import batch_numbers, compact, latest_updates

MESSAGE = ["client_id", "message_id", "event_ts", "text"]
_PROFILE_COLUMNS = "onboarding_step int, name string, business_type string, cadence string, mode string"

def fold_in_batches(messages: DataFrame, path: str, checkpoint: str):
    """Each message on top of the profiles that the batches before left; ``messages`` has the ``MESSAGE`` columns.

    ``path/actions`` gets each message with its effect, ``path/profiles`` the profiles that changed;
    both by batch, so a repeated batch replaces itself and reads only the profiles before it. Messages are
    in order inside a batch; ``fold_in_order`` also puts those of different batches in order.
    """
    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with released(spark):
            profiles = _profiles(spark, path, batch_id)
            narrow = stage(batch.select(*MESSAGE), "messages")
            actions, changed = chat_fold(narrow, profiles)
            actions.write.mode("overwrite").parquet(f"{path}/actions/batch={batch_id}")
            changed.write.mode("overwrite").parquet(f"{path}/profiles/batch={batch_id}")
        compact(spark, f"{path}/profiles", ["client_id"], batch_id)

    return messages.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def fold_in_order(messages: DataFrame, path: str, checkpoint: str, delay: dt.timedelta):
    """Like ``fold_in_batches``, in the order of event time whatever order messages arrive in.

    Messages wait in ``path/pending`` until the newest event time seen is ``delay`` past theirs, and are
    folded in order then; so only the last ``delay`` of the feed is kept and read again. A message that comes later
    than that is not lost: it is folded at once, behind newer ones, and marked ``late``. Messages without a
    time do not wait. All of it is written by batch, so a repeated batch replaces itself. ``waiting_effects``
    shows what the messages that still wait would do.
    """
    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with released(spark):
            held, newest = _pending(spark, path, batch_id)
            passed = newest and newest - delay
            late = F.lit(False) if passed is None else F.coalesce(F.col("event_ts") <= F.lit(passed), F.lit(False))
            arrived = stage(batch.select(*MESSAGE).withColumn("late", late), "messages")
            seen = arrived.agg(F.max("event_ts")).first()[0]
            newest = max((t for t in (newest, seen) if t is not None), default=None)
            due = F.lit(True) if newest is None else F.col("event_ts").isNull() | (F.col("event_ts") <= F.lit(newest - delay))
            waiting = stage(held.unionByName(arrived).withColumn("due", due), "waiting")
            ready = waiting.filter("due").drop("due")
            actions, changed = chat_fold(ready, _profiles(spark, path, batch_id))
            actions.write.mode("overwrite").parquet(f"{path}/actions/batch={batch_id}")
            changed.write.mode("overwrite").parquet(f"{path}/profiles/batch={batch_id}")
            rest = waiting.filter("not due").drop("due").withColumn("newest", F.lit(newest).cast("timestamp"))
            clock = spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in rest.drop("newest").dtypes], F.lit(newest).cast("timestamp").alias("newest"))
            rest.unionByName(clock).write.mode("overwrite").parquet(f"{path}/pending/batch={batch_id}")
        compact(spark, f"{path}/profiles", ["client_id"], batch_id)

    return messages.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def waiting_effects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(effects of the messages that ``fold_in_order`` still holds back, the profiles they would leave); nothing is written."""
    held, _ = _pending(spark, path, None)
    return chat_fold(held, _profiles(spark, path, None))


def _profiles(spark: SparkSession, path: str, before: int | None) -> DataFrame:
    if not [n for n in batch_numbers(spark, f"{path}/profiles") if before is None or n < before]:
        return spark.createDataFrame([], f"client_id string, {_PROFILE_COLUMNS}")
    return latest_updates(spark, f"{path}/profiles", ["client_id"], before=before)


def _pending(spark: SparkSession, path: str, before: int | None) -> tuple[DataFrame, dt.datetime | None]:
    """Messages held back by the batches before, and the newest event time they have seen."""
    done = [n for n in batch_numbers(spark, f"{path}/pending") if before is None or n < before]
    if not done:
        return spark.createDataFrame([], "client_id string, message_id string, event_ts timestamp, text string, late boolean"), None
    kept = spark.read.parquet(f"{path}/pending/batch={done[-1]}")
    # Every file set has one row that only tells the time.
    return kept.filter("late is not null").drop("newest"), kept.agg(F.max("newest")).first()[0]


def sales_from_chat(folded: DataFrame) -> DataFrame:
    """Sales rows out of the messages that were read in sales mode."""
    texts = folded.filter("action = 'sales_text'").select(
        "client_id", F.col("message_id").alias("source_id"), "business_type", "text", F.col("event_ts").alias("received_at")
    )
    return text_sales(texts)
