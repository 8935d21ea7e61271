"""The client table as a bucketed table under a commit log: look-ups without a shuffle of clients, merges that
rewrite touched buckets only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.functions.text import normalise_phone
from tillwork.operators import client_ops
from tillwork.sources import buckets, client_table
from tillwork.sources.buckets import BucketTable
from tillwork.sources.commits import CommitLog
from tillwork.staging import stage

BUCKETS = 64


class ClientStore:
    """Clients by phone number. Every change is a commit; a store object always reads the newest version.

    ``buckets`` should grow with the table: a bucket is what a small change rewrites.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)

    @classmethod
    def create(cls, clients: DataFrame, path: str, count: int = BUCKETS) -> ClientStore:
        store = cls(clients.sparkSession, path)
        store.log.commit({"clients": buckets.create(clients, store.path, "client_id", count).entry()}, -1)
        return store

    def current(self) -> tuple[int, dict, BucketTable]:
        """(version, entry, clients)."""
        version, entry = self.log.latest()
        if version < 0:
            raise FileNotFoundError(f"no client table under {self.path}")
        return version, entry, BucketTable(**entry["clients"])

    def clients(self) -> DataFrame:
        return self.current()[2].read(self.spark)

    def _merge(self, changes: DataFrame, work: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        version, entry, table = self.current()
        merged = table.merged(stage(changes, "changes"), work)
        return self.log.commit(entry | {"clients": merged.entry()}, version)

    def insert_new(self, phones: DataFrame, now: Column) -> int:
        """Unknown numbers become fresh clients."""
        numbers = phones.select(normalise_phone(F.col("phone")).alias("client_id")).distinct()
        return self._merge(numbers, lambda clients, new: client_ops.insert_new(clients, new.withColumnRenamed("client_id", "phone"), now))

    def update(self, updates: DataFrame, columns: Sequence[str], order: Sequence[str]) -> int:
        """The latest value of each changed column; see ``client_ops.update_fields``."""
        return self._merge(updates, lambda clients, changes: client_ops.update_fields(clients, changes, columns, order))

    def lookup(self, phone: str) -> DataFrame:
        """One client, out of one bucket."""
        table = self.current()[2]
        wanted = self.spark.range(1).select(normalise_phone(F.lit(phone)).alias("client_id"))
        return client_table.lookup(table.read(self.spark, table.touched(wanted)), phone)

    def lookup_many(self, phones: DataFrame) -> DataFrame:
        """Clients for a table with a ``phone`` column; only that table is shuffled."""
        return client_table.lookup_many(self.clients().hint("merge"), phones)

    def refused_documents(self, messages: DataFrame) -> DataFrame:
        return client_ops.refused_documents(messages, self.clients().hint("merge"))
