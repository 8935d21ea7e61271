"""The outlier fence over a stream: counted bins per source as state, added to by every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.operators.quantiles import bin_of, bins_of, quartiles_of_bins
from tillwork.operators.silver import DATASET, limits_of
from tillwork.sources.buckets import BucketTable
from tillwork.sources.commits import CommitLog
from tillwork.staging import released, stage
from tillwork.streaming.windows import latest_updates

BUCKETS = 16
PARTS = 8
BINS = "client_id string, source_id string, bin int, n bigint, low double, high double"
VALUES = "client_id string, source_id string, bin int, v double, n bigint"


class FenceState:
    """Bins and counted values of all amounts so far, in buckets by client under a commit log.

    A batch adds its counts: only the buckets of its clients are rewritten (bins) or added to (values). The
    quartiles of those clients' sources then come from their bins, and from values only where a wanted rank lies
    inside a bin of several values. They are the exact quartiles of all rows, however the rows were split into batches.
    """

    def __init__(self, spark: SparkSession, path: str, count: int = BUCKETS):
        self.spark, self.path, self.count = spark, path.rstrip("/"), count
        self.log = CommitLog(spark, path)

    def _before(self, batch: int) -> tuple[BucketTable, BucketTable]:
        """The state that the batches before have left, so that a repeated batch is not counted twice."""
        found = self.log.latest_before(batch)
        if found is not None:
            return BucketTable(**found[1]["bins"]), BucketTable(**found[1]["values"])
        empty = lambda name, columns: BucketTable(f"{self.path}/{name}", "client_id", columns, self.count, {})
        return empty("bins", BINS), empty("values", VALUES)

    def add(self, sales: DataFrame, batch: int) -> DataFrame:
        """Count the amounts of ``sales`` and return the new limit of every source they belong to; NULL: none."""
        bins, values = self._before(batch)
        amount = F.col("amount")
        good = sales.filter(amount.isNotNull() & ~F.isnan(amount) & F.col("client_id").isNotNull())
        keyed = good.select(F.col("client_id").cast("string").alias("client_id"), "source_id", bin_of(amount).alias("bin"), amount.alias("v"))
        counted = stage(keyed.groupBy(*DATASET, "bin", "v").agg(F.count("*").alias("n")), "counted")
        sources = stage(counted.select(*DATASET).distinct(), "sources")
        touched = bins.touched(sources)
        bins = bins.merged(bins_of(counted, DATASET), _united, touched)
        values = values.appended(counted).compacted(self.spark, PARTS)
        self.log.commit({"batch": batch, "bins": bins.entry(), "values": values.entry()}, self.log.latest()[0])
        base = self.log.latest_before(batch)
        self.log.forget(base[0] if base else 0)
        here = bins.read(self.spark, touched).join(sources, DATASET, "left_semi")
        limits = limits_of(quartiles_of_bins(here, values.read(self.spark, touched), DATASET), DATASET)
        return sources.join(limits, DATASET, "left")


def _united(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy(*DATASET, "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def fence_in_batches(sales: DataFrame, path: str, checkpoint: str, count: int = BUCKETS):
    """Keep the limit of every source up to date, as one job per micro-batch.

    ``path/rows`` gets the sales and ``path/limits`` the limits that a batch has changed, both by batch, so
    that a repeated batch replaces itself. ``within_fence`` reads them.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with released(spark):
            arrived = stage(batch, "arrived")
            limits = FenceState(spark, f"{path}/state", count).add(arrived, batch_id)
            limits.write.mode("overwrite").parquet(f"{path}/limits/batch={batch_id}")
            arrived.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    return sales.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def within_fence(spark: SparkSession, path: str) -> DataFrame:
    """All sales so far that the newest limits let pass, as ``iqr_fence`` gives them for the same rows at once."""
    rows = spark.read.parquet(f"{path}/rows").drop("batch")
    limits = latest_updates(spark, f"{path}/limits", DATASET).filter("fence is not null")
    keyed = rows.withColumn("_client", F.col("client_id").cast("string"))
    joined = keyed.join(limits.withColumnRenamed("client_id", "_client"), ["_client", "source_id"], "left")
    return joined.filter(F.col("fence").isNull() | (F.col("amount") <= F.col("fence")) | F.col("amount").isNull()).drop("fence", "_client")
