"""Client table changes and the choice of clients for a run."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.text import normalise_phone
from tillwork.staging import attach
from tillwork.vocabulary import DEFAULT_CADENCE, REMINDER, UNNAMED

GRACE_SECONDS = 3600
# Hour of the day at which each cadence fires.
FIRE_HOUR = {"diario": 20, "semanal": 8, "mensal": 8}


def insert_new(clients: DataFrame, phones: DataFrame, now: Column) -> DataFrame:
    """Add unknown phone numbers as fresh clients; known ones stay as they are."""
    numbers = phones.select(normalise_phone(F.col("phone")).alias("client_id")).distinct()
    fresh = numbers.join(clients, "client_id", "left_anti").select(
        "client_id",
        F.lit(DEFAULT_CADENCE).alias("cadence"),
        F.lit(1).alias("onboarding_step"),
        F.lit("[]").alias("history"),
        now.cast("timestamp_ntz").alias("created_at"),
    )
    return clients.unionByName(fresh, allowMissingColumns=True)


def update_fields(clients: DataFrame, updates: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Apply the latest update of each column; NULL is a value like any other.

    ``updates`` has ``client_id``, ``changed`` (names of the columns it sets), the columns
    themselves, and the ``order`` columns that say which update is later. A client's updates are
    reduced map-side to one value per column.
    """
    def latest(name: str) -> Column:
        sets = F.array_contains("changed", name)
        return F.max_by(F.when(sets, F.struct(F.col(name).alias("v"))), F.when(sets, F.struct(*order))).alias(f"_{name}")

    newest = updates.groupBy("client_id").agg(*[latest(c) for c in columns])
    joined = clients.join(newest, "client_id", "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}")["v"]).otherwise(F.col(c)))
    return joined.drop(*[f"_{c}" for c in columns])


def mark_seen(seen: DataFrame, message_ids: DataFrame, now: Column) -> DataFrame:
    """Add message ids; those already present are left alone."""
    fresh = message_ids.select("message_id").filter("message_id <> ''").distinct().join(seen, "message_id", "left_anti")
    return seen.unionByName(fresh.withColumn("created_at", now.cast("timestamp_ntz")))


def not_seen(messages: DataFrame, seen: DataFrame, order: Sequence[str] = ("event_ts",)) -> DataFrame:
    """First copy of each message that is not in the seen table; messages without id always pass.

    Copies are reduced map-side before the shuffle, so an id with very many copies is harmless.
    """
    others = [c for c in messages.columns if c != "message_id"]
    first = F.struct(*order, *[c for c in others if c not in order])
    with_id = messages.filter("message_id <> ''").groupBy("message_id").agg(F.min(first).alias("_first"))
    unique = with_id.select("message_id", *[F.col("_first")[c].alias(c) for c in others])
    fresh = unique.join(seen.select("message_id"), "message_id", "left_anti")
    return fresh.unionByName(messages.filter("message_id is null or message_id = ''"))


def latest_sources(uploads: DataFrame) -> DataFrame:
    """The newest source per client: (``client_id``, ``source_id``)."""
    return uploads.groupBy("client_id").agg(F.max_by("source_id", F.struct("uploaded_at", "source_id")).alias("source_id"))


def sales_of_latest_sources(sales: DataFrame, uploads: DataFrame) -> DataFrame:
    """Sales of each client's newest source only."""
    return attach(sales, latest_sources(uploads), ["client_id", "source_id"], "left_semi")


def is_due(cadence: Column, run_ts: Column) -> Column:
    """Whether the cadence fired at, or at most an hour before, ``run_ts``."""
    now = run_ts.cast("timestamp_ntz")

    def fired(day: Column, hour: int) -> Column:
        at = day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour))
        return now.between(at, at + F.make_dt_interval(secs=F.lit(GRACE_SECONDS)))

    today = F.to_date(now)
    return (
        F.when(cadence == "diario", fired(today, FIRE_HOUR["diario"]))
        .when(cadence == "semanal", fired(F.trunc(today, "week"), FIRE_HOUR["semanal"]))
        .when(cadence == "mensal", fired(F.trunc(today, "month"), FIRE_HOUR["mensal"]))
        .otherwise(F.lit(False))
    )


def onboarded(clients: DataFrame) -> DataFrame:
    return clients.filter("onboarding_step = 0")


def of_cadence(clients: DataFrame, cadence: str) -> DataFrame:
    return clients.filter(F.coalesce("cadence", F.lit(DEFAULT_CADENCE)) == cadence)


def due(clients: DataFrame, run_ts: dt.datetime | Column) -> DataFrame:
    """Onboarded clients whose cadence fires at ``run_ts``."""
    when = run_ts if isinstance(run_ts, Column) else F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz")
    return onboarded(clients).filter(is_due(F.coalesce("cadence", F.lit(DEFAULT_CADENCE)), when))


def with_file(clients: DataFrame) -> DataFrame:
    return clients.filter(F.coalesce("last_file", F.lit("")) != "")


def reminders(clients: DataFrame, files: DataFrame) -> DataFrame:
    """Clients that have no file yet, with the text that asks for one."""
    name = F.coalesce(F.nullif("name", F.lit("")), F.lit(UNNAMED))
    text = F.format_string(REMINDER, name)
    return clients.join(files.select("client_id"), "client_id", "left_anti").select("client_id", text.alias("reminder"))


def refused_documents(messages: DataFrame, clients: DataFrame) -> DataFrame:
    """Documents from unknown clients or clients still being registered."""
    steps = clients.select("client_id", "onboarding_step")
    documents = messages.filter("type = 'document'")
    return documents.join(steps, "client_id", "left").filter("onboarding_step is null or onboarding_step > 0")


def accepted_documents(messages: DataFrame, clients: DataFrame) -> DataFrame:
    steps = clients.select("client_id", "onboarding_step").filter("onboarding_step = 0")
    return messages.filter("type = 'document' and document_id is not null").join(steps, "client_id", "left_semi")
