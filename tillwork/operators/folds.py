"""Ordered message histories as batch results: registration profile and chat mode.

They give what the stateful stream in ``tillwork.streaming.folds`` gives message by message, without
gathering a client's history in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.messages import (
    business_type_answer,
    cadence_answer,
    cadence_code,
    command,
    is_cancel,
    is_first_contact_greeting,
)
from tillwork.functions.text import strip
from tillwork.staging import attach, stage, stage_measured
from tillwork.vocabulary import DEFAULT_CADENCE, MODE_CADENCE, MODE_SALES

ORDER = ("event_ts", "message_id")


def profile_fold(messages: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Registration result per client: the first usable name, then the two answers that follow.

    The first name is a map-side minimum; the two answers are a ranking cut to two rows per client
    before the shuffle. No client's history is gathered.
    """
    position = F.struct(*order)
    usable = ~is_first_contact_greeting(F.col("text"))
    named = messages.groupBy("client_id").agg(
        F.min(F.when(usable, F.struct(position.alias("at"), F.col("text")))).alias("first")
    )
    named = named.select("client_id", F.col("first.at").alias("start"), strip(F.col("first.text")).alias("name"))
    named, size = stage_measured(named, "named")
    later = attach(messages, named.filter("start is not null").select("client_id", "start"), ["client_id"], "inner", size=size)
    later = later.filter(position > F.col("start"))
    in_order = Window.partitionBy("client_id").orderBy(*order)
    answers = later.withColumn("n", F.row_number().over(in_order)).filter("n <= 2").groupBy("client_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("text"))).alias("second"),
        F.max(F.when(F.col("n") == 2, F.col("text"))).alias("third"),
    )
    step = (
        F.when(F.col("name").isNull(), 1).when(F.col("second").isNull(), 2)
        .when(F.col("third").isNull(), 3).otherwise(0)
    )
    return named.join(answers, "client_id", "left").select(
        "client_id", "name",
        F.when(F.col("second").isNotNull(), business_type_answer(F.col("second"))).alias("business_type"),
        F.when(F.col("third").isNotNull(), cadence_answer(F.col("third"))).alias("cadence"),
        step.alias("onboarding_step"),
    )


def mode_fold(
    messages: DataFrame, order: Sequence[str] = ORDER, block: Column | None = None, initial: DataFrame | None = None
) -> DataFrame:
    """Mode in which each message of a registered client is read, and what it does there.

    A message in sales mode is sales text whatever it says, and ends the mode; cadence mode lasts
    until ``cancelar`` or a valid code. Histories are cut into blocks: each is worked out for the
    three modes it may start in, and the rows pick the case that applies. By default messages are dealt by
    range of client and order, and a client's messages in one range are a block: so a burst, or many messages
    without a time, are cut wherever they are dense. ``block`` gives other blocks, as a column that rises with the order.
    Only a client's blocks are put in order behind each other, in a window; of ranges it has at most as many as there are tasks.
    ``initial`` (``client_id``, ``mode``) says in which mode clients begin, if not in none.
    Messages without a time come first.
    """
    if block is None:
        ranges = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = messages.repartitionByRange(ranges, "client_id", *order)
        # Written, so that a message never changes its block.
        messages = stage(dealt.withColumn("block", F.spark_partition_id()), "blocks")
        block = F.col("block")
    columns = [c for c in messages.columns if c != "block"]
    text = F.col("text")
    ends_cadence = is_cancel(text) | cadence_code(text).isNotNull()
    kind = (
        F.when(ends_cadence, "exit").when(command(text) == "sales", "sales")
        .when(command(text) == "cadence", "cadence").otherwise("other")
    )
    rows = messages.withColumns({"block": block, "kind": kind})
    in_order = Window.partitionBy("client_id", "block").orderBy(*order)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.row_number().over(in_order))
    last_exit = F.coalesce(F.max(F.when(F.col("kind") == "exit", F.col("n"))).over(before), F.lit(0))
    rows = rows.withColumn("last_exit", last_exit)

    # Starting in sales mode, the first message is used up as sales text.
    rows = rows.withColumns({
        "kind_idle": F.col("kind"),
        "kind_sales": F.when((F.col("n") == 1) & (F.col("kind") != "exit"), "other").otherwise(F.col("kind")),
    })
    for start in ("idle", "sales"):
        k = F.col(f"kind_{start}")
        last_other = F.max(F.when(k != "sales", F.col("n"))).over(before)
        # Sales commands in a row alternate: one opens the mode, the next is its text.
        rows = rows.withColumn(f"odd_{start}", (F.col("n") - 1 - F.coalesce(last_other, F.lit(0))) % 2 == 1)
        opens = (k == "cadence") & ~F.col(f"odd_{start}")
        last_open = F.coalesce(F.max(F.when(opens, F.col("n"))).over(before), F.lit(0))
        state = (
            F.when(last_open > F.col("last_exit"), MODE_CADENCE)
            .when(F.col(f"odd_{start}"), MODE_SALES).otherwise("")
        )
        if start == "sales":
            state = F.when(F.col("n") == 1, MODE_SALES).otherwise(state)
        rows = rows.withColumn(f"in_{start}", state)
    rows = rows.withColumn("in_cadence", F.when(F.col("last_exit") == 0, MODE_CADENCE).otherwise(F.col("in_idle")))
    rows = stage(rows.select(*columns, "block", "kind", "n", "in_idle", "in_sales", "in_cadence"), "modes")

    ends = rows.groupBy("client_id", "block").agg(*[
        F.max_by(_next_mode(F.col(f"in_{s}"), F.col("kind")), "n").alias(f"end_{s}") for s in ("idle", "sales", "cadence")
    ])
    starts = rows.join(_start_modes(ends, initial), ["client_id", "block"])
    mode = _pick(F.col("start"), F.col("in_idle"), F.col("in_sales"), F.col("in_cadence"))
    result = starts.withColumn("mode", mode)
    return result.select(
        *columns, "mode", _action(F.col("mode"), text).alias("action"),
        F.when(F.col("mode") == MODE_CADENCE, cadence_code(text)).alias("new_cadence"),
        _next_mode(F.col("mode"), F.col("kind")).alias("mode_after"),
    )


def _pick(start: Column, idle: Column, sales: Column, cadence: Column) -> Column:
    return F.when(start == MODE_SALES, sales).when(start == MODE_CADENCE, cadence).otherwise(idle)


def _next_mode(mode: Column, kind: Column) -> Column:
    return (
        F.when(mode == MODE_SALES, "")
        .when(mode == MODE_CADENCE, F.when(kind == "exit", "").otherwise(MODE_CADENCE))
        .otherwise(F.when(kind == "sales", MODE_SALES).when(kind == "cadence", MODE_CADENCE).otherwise(""))
    )


def _start_modes(ends: DataFrame, initial: DataFrame | None) -> DataFrame:
    """Mode at the start of each block, by three running windows over a client's blocks.

    Cadence mode holds until a block in which it ends; such a block ends the same way from any start.
    Between those, a block either settles whether sales mode is on, whatever it was before, or flips
    it, or leaves it. So the mode before a block follows from the last block that settled it, the
    flips since then, and whether a block has opened cadence mode since it last ended.
    """
    idle, sales, cadence = F.col("end_idle"), F.col("end_sales"), F.col("end_cadence")
    first = F.lit("")
    if initial is not None:
        ends = ends.join(initial.select("client_id", F.col("mode").alias("first_mode")), "client_id", "left")
        first = F.coalesce("first_mode", F.lit(""))
    in_order = Window.partitionBy("client_id").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    settles = (idle == sales) | (idle == MODE_CADENCE) | (sales == MODE_CADENCE)
    settled = F.when(idle != MODE_CADENCE, idle).when(sales != MODE_CADENCE, sales).otherwise("")
    flips = (~settles & (idle == MODE_SALES)).cast("long")
    rows = ends.withColumns({"i": F.row_number().over(in_order), "flips": F.coalesce(F.sum(flips).over(before), F.lit(0))})
    at = F.struct("i", settled.alias("mode"), "flips")
    rows = rows.withColumn("last", F.max(F.when(settles, at)).over(before))
    base = F.coalesce(F.col("last.mode"), F.when(first == MODE_SALES, first).otherwise("")) == MODE_SALES
    odd = (F.col("flips") - F.coalesce("last.flips", F.lit(0))) % 2 == 1
    rows = rows.withColumn("in_sales", base != odd)
    opens = F.when(F.col("in_sales"), sales).otherwise(idle) == MODE_CADENCE
    opened = F.coalesce(F.max(F.when(opens, F.col("i"))).over(before), F.lit(0))
    ended = F.max(F.when(cadence != MODE_CADENCE, F.col("i"))).over(before)
    ended = F.coalesce(ended, F.when(first == MODE_CADENCE, -1).otherwise(0))
    start = F.when(opened > ended, MODE_CADENCE).when(F.col("in_sales"), MODE_SALES).otherwise("")
    return rows.select("client_id", "block", start.alias("start"))


def _action(mode: Column, text: Column) -> Column:
    in_sales = F.when(is_cancel(text), "cancel").otherwise("sales_text")
    in_cadence = F.when(is_cancel(text), "cancel").when(cadence_code(text).isNotNull(), "set_cadence").otherwise("invalid_option")
    return F.when(mode == MODE_SALES, in_sales).when(mode == MODE_CADENCE, in_cadence).otherwise(command(text))


PROFILE = ["onboarding_step", "name", "business_type", "cadence", "mode"]


def chat_fold(
    messages: DataFrame, profiles: DataFrame, order: Sequence[str] = ORDER, block: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """A batch of messages on top of stored profiles: (messages with ``action``, changed profiles).

    ``profiles`` has ``client_id`` and the ``PROFILE`` columns; unknown clients start fresh. A client
    still registering uses up its next messages one step each, at most three, which a ranking cut
    before the shuffle finds; everything after that goes through ``mode_fold``.
    """
    position = F.struct(*order)
    usable = ~is_first_contact_greeting(F.col("text"))
    seen = messages.groupBy("client_id").agg(F.min(F.when(usable, position)).alias("first_usable"), F.min(position).alias("first"))
    step = F.coalesce("onboarding_step", F.lit(1))
    heads = seen.join(profiles, "client_id", "left").withColumn("onboarding_step", step).withColumn(
        "start", F.when(F.col("onboarding_step") == 1, F.col("first_usable")).when(F.col("onboarding_step") > 1, F.col("first"))
    )
    heads, size = stage_measured(heads.select("client_id", *PROFILE, "start"), "heads")

    begins = heads.select("client_id", F.col("onboarding_step").alias("step"), "start")
    placed = attach(messages, begins, ["client_id"], "inner", size=size)
    registering = placed.filter((F.col("step") > 0) & (position >= F.col("start")))
    in_order = Window.partitionBy("client_id").orderBy(*order)
    answers = registering.withColumn("n", F.row_number().over(in_order)).filter("n <= 3").filter("step + n <= 4")
    answers, size = stage_measured(answers.withColumn("step", F.col("step") + F.col("n") - 1).drop("n", "start"), "answers")
    names = F.when(F.col("step") == 1, "set_name").when(F.col("step") == 2, "set_business_type").otherwise("set_cadence")
    registered = answers.groupBy("client_id").agg(
        F.max("step").alias("reached"),
        F.max(F.when(F.col("step") == 1, strip(F.col("text")))).alias("new_name"),
        F.max(F.when(F.col("step") == 2, business_type_answer(F.col("text")))).alias("new_type"),
        F.max(F.when(F.col("step") == 3, cadence_answer(F.col("text")))).alias("first_cadence"),
        F.max(F.when(F.col("step") == 3, position)).alias("done_at"),
    )

    waiting = placed.filter((F.col("step") == 1) & (F.col("start").isNull() | (position < F.col("start"))))
    done = registered.filter("done_at is not null").select("client_id", "done_at")
    after = attach(placed.drop("start"), done, ["client_id"], "left", size=size)
    chatting = after.filter((F.col("step") == 0) | (position > F.col("done_at"))).select(*messages.columns)
    initial = heads.filter("onboarding_step = 0 and mode is not null").select("client_id", "mode")
    modes = stage(mode_fold(chatting, order, block, initial), "chat")

    actions = (
        waiting.select(*messages.columns, F.lit("ask_name").alias("action"))
        .unionByName(answers.select(*messages.columns, names.alias("action")))
        .unionByName(modes.select(*messages.columns, "action"))
    )
    changed = modes.groupBy("client_id").agg(
        F.max_by("mode_after", position).alias("last_mode"),
        F.max_by("new_cadence", F.when(F.col("new_cadence").isNotNull(), position)).alias("last_cadence"),
    )
    joined = heads.join(registered, "client_id", "left").join(changed, "client_id", "left")
    new_step = F.coalesce(F.when(F.col("reached") == 3, 0).otherwise(F.col("reached") + 1), F.col("onboarding_step"))
    return actions, joined.select(
        "client_id", new_step.cast("int").alias("onboarding_step"),
        F.coalesce("new_name", "name").alias("name"),
        F.coalesce("new_type", "business_type").alias("business_type"),
        F.coalesce("last_cadence", "first_cadence", "cadence", F.lit(DEFAULT_CADENCE)).alias("cadence"),
        F.when(F.col("last_mode").isNotNull(), F.nullif("last_mode", F.lit(""))).otherwise(F.col("mode")).alias("mode"),
    )
