"""Seen message ids as a store: hash buckets, Bloom filters, and merges, for feeds that never end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.sources import buckets
from tillwork.sources.buckets import BucketTable
from tillwork.sources.commits import CommitLog
from tillwork.staging import stage

BUCKETS = 16
# Ids a bucket may hold on average before the number of buckets is doubled.
ROWS = 50_000
# Folders of a bucket before they are merged.
PARTS = 8
# A filter page is a bitmap of 4 KB; at ten bits an id, so many pages serve a full bucket.
PAGE_BITS = 32768
PAGES = 16
HASHES = 4
IDS = "message_id string, created_at timestamp"
FILTERS = "home int, page int, bits binary"


class SeenIds:
    """Every id that was ever added, and of which batch the newest were.

    An id lies in a bucket by its hash; a bucket has some folders of ids and ``PAGES`` bitmaps, a Bloom
    filter that is cut by another hash. To look ids up, only the filters of the buckets they lie in are
    read, and ids only of those buckets in which a filter says yes, which for new ids is rare. Both kinds
    of bucket have a bounded size: when they fill, their number is doubled. So what a batch reads depends on
    its own ids, not on the number of batches before it. One writer at a time; a second one gets ``Conflict``.
    """

    def __init__(self, spark: SparkSession, path: str, count: int = BUCKETS, rows: int = ROWS):
        self.spark, self.path, self.count, self.rows = spark, path.rstrip("/"), count, rows
        self.log = CommitLog(spark, path)

    def _before(self, batch: int | None) -> dict:
        """The newest entry of an earlier batch."""
        found = self.log.latest_before(batch)
        if found is not None:
            return found[1]
        return {"batch": -1, "rows": 0, "ids": self._empty("ids", "message_id", IDS).entry(), "filters": self._empty("filters", "home", FILTERS).entry()}

    def _empty(self, name: str, key: str, columns: str) -> BucketTable:
        return BucketTable(f"{self.path}/{name}", key, columns, self.count, {})

    def ids(self) -> DataFrame:
        """All ids with the time at which they were first seen."""
        return BucketTable(**self._before(None)["ids"]).read(self.spark)

    def seen_of(self, ids: DataFrame, before: int | None = None) -> DataFrame:
        """Those of ``ids`` (a stored table of distinct ids) that a batch before ``before`` has added."""
        entry = self._before(before)
        table, filters = BucketTable(**entry["ids"]), BucketTable(**entry["filters"])
        if not entry["rows"]:
            return ids.select("message_id").limit(0)
        placed = ids.select("message_id", *_places(table))
        pages = filters.read(self.spark, _held(placed, filters))
        maybe = placed.join(pages, ["home", "page"]).filter(F.forall("at", lambda p: _bit(F.col("bits"), p) == 1))
        maybe = stage(maybe.select("message_id", "home"), "maybe")
        hit = [r[0] for r in maybe.select("home").distinct().collect()]
        return maybe.select("message_id").join(table.read(self.spark, hit).select("message_id"), "message_id", "left_semi")

    def add(self, fresh: DataFrame, batch: int) -> None:
        """Commit the ids of ``fresh`` (a stored table of new ids with ``created_at``) as those of ``batch``."""
        entry = self._before(batch)
        table, filters = BucketTable(**entry["ids"]), BucketTable(**entry["filters"])
        total = entry["rows"] + fresh.count()
        table = table.appended(fresh.select("message_id", F.col("created_at").cast("timestamp").alias("created_at"))).compacted(self.spark, PARTS)
        if total > table.count * self.rows:
            table = table.dealt_anew(self.spark, table.count * 2)
            filters = buckets.create(_bitmaps(table.read(self.spark), table), filters.path, "home", table.count)
        else:
            filters = filters.merged(_bitmaps(fresh, table), _united, _held(fresh.select(table.bucket().alias("home")), filters))
        version, _ = self.log.latest()
        self.log.commit({"batch": batch, "rows": total, "ids": table.entry(), "filters": filters.entry()}, version)
        self._tidy(batch)

    def _tidy(self, batch: int) -> None:
        """Drop entries, and folders that none names, but for what a repetition of ``batch`` starts from."""
        base = self.log.latest_before(batch)
        kept = self.log.forget(base[0] if base else 0)
        used = {f for entry in kept for name in ("ids", "filters") for folders in entry[name]["folders"].values() for f in folders}
        runs = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in used}
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for name in ("ids", "filters"):
            top = hadoop.Path(f"{self.path}/{name}/data")
            fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for run in fs.listStatus(top) if fs.exists(top) else []:
                if run.getPath().getName() not in runs:
                    fs.delete(run.getPath(), True)


def _places(table: BucketTable) -> list[Column]:
    """Where an id is looked for: its bucket, its filter page, and its bits there."""
    at = [F.pmod(F.xxhash64("message_id", F.lit(i)), F.lit(PAGE_BITS)) for i in range(HASHES)]
    page = F.pmod(F.xxhash64("message_id", F.lit("page")), F.lit(PAGES)).cast("int")
    return [table.bucket().alias("home"), page.alias("page"), F.array(*at).alias("at")]


def _held(placed: DataFrame, filters: BucketTable) -> list[int]:
    """The buckets of ``filters`` in which the homes of ``placed`` are."""
    return [r[0] for r in placed.select(filters.bucket().alias("held")).distinct().collect()]


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1))


def _bitmaps(ids: DataFrame, table: BucketTable) -> DataFrame:
    bits = ids.select(*_places(table)).select("home", "page", F.explode("at").alias("at"))
    return bits.groupBy("home", "page").agg(F.bitmap_construct_agg("at").alias("bits"))


def _united(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("home", "page").agg(F.bitmap_or_agg("bits").alias("bits"))
