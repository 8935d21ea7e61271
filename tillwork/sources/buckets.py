"""Tables in hash buckets of a key: only touched buckets are rewritten, and joins on the key do not shuffle them.

A bucket is a folder of its own. A version of a table is the list of its buckets' folders, so that versions
share the folders of buckets that did not change; the list belongs into an entry of a ``CommitLog``.
Files carry Spark's own bucket numbers. Reading registers the folders as partitions of a bucketed table in
the session's catalogue, which tells Spark how rows are dealt: filters on ``bucket`` leave other folders
unlisted, and in a join on the key only the other side is shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET, PART = "bucket", "part"


@dataclass(frozen=True)
class BucketTable:
    """One version: ``folders[str(bucket)]`` lists the folders with the bucket's rows."""

    path: str
    key: str
    columns: str
    count: int
    folders: dict[str, list[str]]

    def entry(self) -> dict:
        return asdict(self)

    def bucket(self) -> Column:
        """The bucket of a row with this key, the way Spark deals rows."""
        return F.pmod(F.hash(self.key), F.lit(self.count))

    def read(self, spark: SparkSession, only: Iterable[int] | None = None) -> DataFrame:
        """The rows, of some buckets only if they are named; nothing of the others is listed or opened."""
        chosen = {b: f for b, f in self.folders.items() if only is None or int(b) in set(only)}
        places = [(int(b), i, folder) for b, folders in sorted(chosen.items()) for i, folder in enumerate(folders)]
        # The same buckets are the same table of the catalogue.
        name = "tillwork_" + hashlib.md5(repr((self.path, self.columns, self.count, places)).encode()).hexdigest()
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} ({self.columns}, {BUCKET} INT, {PART} INT) USING parquet PARTITIONED BY ({BUCKET}, {PART}) "
                f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.count} BUCKETS LOCATION '{self.path}/none'"
            )
            for i in range(0, len(places), 500):
                parts = " ".join(f"PARTITION ({BUCKET}={b}, {PART}={n}) LOCATION '{folder}'" for b, n, folder in places[i : i + 500])
                spark.sql(f"ALTER TABLE {name} ADD {parts}")
        return spark.table(name).drop(BUCKET, PART)

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets that the keys of ``changes`` lie in; at most ``count`` numbers."""
        return sorted(r[0] for r in changes.filter(F.col(self.key).isNotNull()).select(self.bucket().alias(BUCKET)).distinct().collect())

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows into new folders, one per bucket that has any: {bucket: folder}."""
        spark, folder = rows.sparkSession, f"{self.path}/data/{uuid.uuid4().hex}"
        name = f"tillwork_{uuid.uuid4().hex}"
        # Dealt by bucket; a large bucket is cut into several files by as many tasks.
        dealt = rows.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET)
        writer = dealt.write.partitionBy(BUCKET).bucketBy(self.count, self.key).sortBy(self.key).format("parquet")
        writer.option("path", folder).saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the files stay
        top = spark._jvm.org.apache.hadoop.fs.Path(folder)
        listed = top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top)
        names = [f.getPath().getName() for f in listed if f.isDirectory()]
        return {n.removeprefix(f"{BUCKET}="): f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    def merged(
        self, changes: DataFrame, work: Callable[[DataFrame, DataFrame], DataFrame], buckets: list[int] | None = None
    ) -> BucketTable:
        """The version after ``changes``: ``work`` gets the rows of the touched buckets and the changes.

        Only those buckets are read and written. Unless the caller knows ``buckets``, ``changes`` are read
        twice and should be a stored table.
        """
        buckets = self.touched(changes) if buckets is None else buckets
        if not buckets:
            return self
        made = self._write(work(self.read(changes.sparkSession, buckets), changes).select(*self._names(changes.sparkSession)))
        left = {b: f for b, f in self.folders.items() if int(b) not in set(buckets)}
        return replace(self, folders=left | {b: [f] for b, f in made.items()})

    def appended(self, rows: DataFrame) -> BucketTable:
        """The version with ``rows`` added as files of their own, without a look at what is there."""
        made = self._write(rows.select(*self._names(rows.sparkSession)))
        return replace(self, folders=self.folders | {b: [*self.folders.get(b, []), f] for b, f in made.items()})

    def compacted(self, spark: SparkSession, most: int) -> BucketTable:
        """The version in which buckets of more than ``most`` folders have one again."""
        crowded = [int(b) for b, f in self.folders.items() if len(f) > most]
        if not crowded:
            return self
        made = self._write(self.read(spark, crowded))
        return replace(self, folders=self.folders | {b: [f] for b, f in made.items()})

    def dealt_anew(self, spark: SparkSession, count: int) -> BucketTable:
        """All rows in another number of buckets."""
        return create(self.read(spark), self.path, self.key, count)

    def _names(self, spark: SparkSession) -> list[str]:
        return spark.createDataFrame([], self.columns).columns


def create(rows: DataFrame, path: str, key: str, count: int) -> BucketTable:
    """A new table of ``count`` buckets; rows need a key."""
    made = BucketTable(path.rstrip("/"), key, columns_of(rows), count, {})
    return made.appended(rows)



def columns_of(rows: DataFrame) -> str:
    """Names and types, as a table definition has them."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
