"""Committed report runs: uploads to reports, reminders and client pointers, visible all at once or not at all."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.operators import client_ops, report
from tillwork.plans.reporting import ingest, report_tables
from tillwork.sources import buckets
from tillwork.sources.buckets import BucketTable
from tillwork.sources.client_table import with_defaults
from tillwork.sources.commits import CommitLog
from tillwork.sources.sinks import write_report
from tillwork.staging import stage

CADENCES = (report.DAILY, report.WEEKLY, report.MONTHLY)


class ReportRuns:
    """Client table and reports under one commit log.

    A run writes all its tables to a folder of its own and ends with one commit, which names the new
    version of the client table and, for every cadence that fired, the run's folder. Until then readers see
    the reports and pointers of the runs before it, also if the run is stopped half way; what it leaves
    behind is named by no entry. Two runs at once cannot both commit.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)

    @classmethod
    def create(cls, clients: DataFrame, path: str, count: int = 64) -> ReportRuns:
        runs = cls(clients.sparkSession, path)
        table = buckets.create(clients, f"{runs.path}/clients", "client_id", count)
        runs.log.commit({"run": None, "clients": table.entry(), "reports": {}, "status": None}, -1)
        return runs

    def clients(self) -> DataFrame:
        return BucketTable(**self.log.latest()[1]["clients"]).read(self.spark)

    def read(self, name: str) -> DataFrame | None:
        """A report table as the newest run of each cadence left it; None before there is any."""
        reports = self.log.latest()[1]["reports"]
        parts = [
            self.spark.read.schema(f"{kept['tables'][name]}, as_of date, run_cadence string").parquet(f"{kept['folder']}/{name}")
            .filter(F.col("run_cadence") == cadence)
            for cadence, kept in reports.items() if name in kept["tables"]
        ]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def status(self) -> DataFrame:
        """One row per source that the newest run read."""
        return self.spark.read.parquet(self.log.latest()[1]["status"])

    def run(self, sources: DataFrame, raw_cells: DataFrame, run_ts: dt.datetime) -> int:
        """Note the newest upload of every client, and report to those whose cadence fires at ``run_ts``.

        ``sources`` has ``uploaded_at``. Only cells of newest uploads of clients that are due are parsed;
        clients that are due and never sent a file get a reminder.
        """
        version, entry = self.log.latest()
        folder = f"{self.path}/runs/{uuid.uuid4().hex}"
        sources, table = stage(sources, "listed"), BucketTable(**entry["clients"])
        newest = client_ops.latest_sources(sources.select("client_id", "source_id", "uploaded_at"))
        newest = stage(newest.withColumnRenamed("source_id", "last_file"), "newest")
        # Uploads of unknown clients are no one's; they stay unread.
        clients = table.read(self.spark).join(newest.withColumnRenamed("last_file", "_sent"), "client_id", "left")
        clients = clients.withColumn("last_file", F.coalesce("_sent", "last_file")).drop("_sent")
        due = stage(client_ops.due(with_defaults(clients), run_ts), "due")
        filed = client_ops.with_file(due)
        chosen = filed.select("client_id", F.col("last_file").alias("source_id"))
        read = stage(sources.join(chosen, ["client_id", "source_id"], "left_semi"), "sources")
        cells = stage(raw_cells.join(read.select("source_id"), "source_id", "left_semi"), "cells")
        sales, status = ingest(read, cells, due)
        status.write.parquet(f"{folder}/status")
        reports = dict(entry["reports"])
        sales, reported = stage(sales, "sales"), []
        for cadence in CADENCES:
            theirs = client_ops.of_cadence(filed, cadence)
            waiting = client_ops.of_cadence(due, cadence)
            if waiting.isEmpty():
                continue
            tables = report_tables(sales, theirs, cadence, run_ts.date())
            tables["reminders"] = client_ops.reminders(waiting, theirs)
            written = write_report(tables, folder, run_ts.date(), cadence)
            # With their columns, since a table without rows leaves no file.
            reports[cadence] = {"folder": folder, "tables": {name: buckets.columns_of(t) for name, t in tables.items()}}
            place = f"{written['kpis']}/as_of={run_ts.date()}/run_cadence={cadence}"
            reported.append(_change(tables["kpis"].select("client_id", F.lit(place).alias("last_report")), "last_report"))
        changes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reported, _change(newest, "last_file"))
        columns = ["last_file", "last_report"] if reported else ["last_file"]
        table = table.merged(stage(changes, "changes"), lambda rows, new: client_ops.update_fields(rows, new, columns, ["at"]))
        return self.log.commit({"run": folder, "clients": table.entry(), "reports": reports, "status": f"{folder}/status"}, version)


def _change(values: DataFrame, column: str) -> DataFrame:
    """Values of a column by client, as updates of the client table."""
    return values.select("client_id", column, F.array(F.lit(column)).alias("changed"), F.lit(0).alias("at"))
