"""Nested message events, for batch tables and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.text import normalise_phone
from tillwork.schemas import EVENT


def extract_messages(events: DataFrame, body: str = "body", event_ts: str = "event_ts", first_only: bool = False) -> DataFrame:
    """One row per message; malformed events and events without messages give none.

    ``first_only`` reads just the first message of the first change of the first entry.
    """
    parsed = events.withColumn("_event", F.from_json(body, EVENT))

    def items(c: Column) -> Column:
        return F.explode(F.slice(c, 1, 1) if first_only else c)

    entries = parsed.withColumn("_entry", items(F.col("_event.entry")))
    changes = entries.withColumn("_change", items(F.col("_entry.changes")))
    messages = changes.withColumn("_message", items(F.col("_change.value.messages")))
    m = F.col("_message")
    return messages.filter(m.isNotNull()).select(
        F.coalesce(m["id"], F.lit("")).alias("message_id"),
        normalise_phone(m["from"]).alias("client_id"),
        F.col(event_ts).alias("event_ts"),
        m["type"].alias("type"),
        F.when(m["type"] == "text", F.coalesce(m["text"]["body"], F.lit(""))).alias("text"),
        m["document"]["id"].alias("document_id"),
        F.when(m["type"] == "document", F.coalesce(m["document"]["filename"], _default_name(F.col(event_ts)))).alias("filename"),
    )


def _default_name(event_ts: Column) -> Column:
    return F.concat(F.lit("vendas_"), F.unix_timestamp(event_ts.cast("timestamp")).cast("string"), F.lit(".xlsx"))


def text_messages(messages: DataFrame) -> DataFrame:
    return messages.filter("type = 'text'")


def document_messages(messages: DataFrame) -> DataFrame:
    return messages.filter("type = 'document' and document_id is not null")
