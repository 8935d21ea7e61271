"""A log of commits: the newest entry names what counts, so that a run shows whole or not at all."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another run has committed since this one looked."""


class CommitLog:
    """Entries ``<path>/_log/<version>.json``, each written whole under a name of its own and then renamed.

    The rename fails if the version exists, so of two runs that started from the same version one commits
    and the other gets ``Conflict``. Nothing is ever written over; readers take the highest version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, f"{path.rstrip('/')}/_log"
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(name)

    def _file(self, version: int):
        return self._path(f"{self.folder}/{version:012d}.json")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._file(version))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """(version, entry); (-1, {}) before the first commit."""
        versions = self.versions()
        return (versions[-1], self.read(versions[-1])) if versions else (-1, {})

    def commit(self, entry: dict, after: int) -> int:
        """Make ``entry`` the version that follows ``after``."""
        held = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        stream = self._fs.create(held, False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(held), self._fs.makeQualified(self._file(after + 1)), plain)
        except Py4JJavaError as e:
            self._fs.delete(held, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {after + 1} of {self.folder} exists") from e
            raise
        return after + 1

    def latest_before(self, batch: int | None) -> tuple[int, dict] | None:
        """The newest (version, entry) whose ``batch`` is an earlier one; None if there is none."""
        for version in reversed(self.versions()):
            entry = self.read(version)
            if batch is None or entry["batch"] < batch:
                return version, entry
        return None

    def forget(self, before: int) -> list[dict]:
        """Drop the entries of versions before ``before``; returns those that are left."""
        versions = self.versions()
        for version in (v for v in versions if v < before):
            self._fs.delete(self._file(version), False)
        return [self.read(v) for v in versions if v >= before]
