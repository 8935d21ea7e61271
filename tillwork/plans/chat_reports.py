"""Figures of the sales that clients type in a chat, one report for each message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions.text import is_service
from tillwork.operators import kpis, silver
from tillwork.staging import stage
from tillwork.streaming.folds import sales_from_chat
from tillwork.vocabulary import UNREAD_SALES, UNREAD_SERVICES

MESSAGE = ["client_id", "source_id"]
UNREADABLE = "unreadable"


def chat_figures(folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per sales message, ranked items) for the messages that were read in sales mode.

    ``folded`` has messages with their ``action`` and the client's ``business_type``. A message is a source of
    its own (``source_id`` is its id), dated with the day it came: its lines are cleaned and fenced by themselves, and all
    messages are worked out as groups of one job. A message without a usable line has the status ``unreadable`` and
    a ``reply`` that shows the form; one whose lines were all rejected has ``no_valid_rows``.
    """
    told = folded.filter("action = 'sales_text'")
    day = F.to_date("event_ts").alias("day")
    messages = stage(told.select("client_id", F.col("message_id").alias("source_id"), "business_type", day), "told")
    classified = stage(silver.fill_fallbacks(silver.classify(sales_from_chat(told)), F.lit(None)), "typed")
    valid = classified.filter("reason is null")
    rows = kpis.kpis(valid, keys=MESSAGE)
    top = stage(kpis.top_items(valid, keys=MESSAGE), "top")
    leading = top.filter("rank = 1").select(*MESSAGE, F.struct("item", "quantity", "amount").alias("item_of_day"))
    rows = rows.drop("item_of_day").join(leading, MESSAGE, "left")
    facts = kpis.source_facts(classified, F.lit(True), MESSAGE)
    figures = kpis.complete(rows, facts, messages, F.col("day"), MESSAGE)
    read = figures.join(facts.select(*MESSAGE, F.lit(True).alias("_read")), MESSAGE, "left")
    unread = F.col("_read").isNull()
    reply = F.when(unread, F.when(is_service(F.col("business_type")), UNREAD_SERVICES).otherwise(UNREAD_SALES))
    return read.withColumns({"status": F.when(unread, UNREADABLE).otherwise(F.col("status")), "reply": reply}).drop("_read"), top
