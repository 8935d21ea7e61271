"""Mixing sources to target weights: budgets down a domain-language-source tree, then token prefixes.

All steps are built-in functions. The token budget goes down the tree level by level. A node's
children share its budget by weight; a child whose documents cannot supply its share (``max_epochs``
passes over them) gives the rest to its siblings, and only what the whole family cannot supply goes
to the parent's siblings, because a parent's own share is limited by what lies below it. For
children in order of supply over weight, the share per unit of weight is the largest value of
(budget - supply of the earlier ones) / (weight of the others): a window over the few children.

A leaf with a budget of several passes takes whole epochs, then a prefix of one more. Every epoch has
its own seeded order, by md5 of seed, epoch and document id. The order is cut into ``BUCKETS`` by its
first digits: tokens are summed per leaf and bucket, and only the documents of the bucket in which the
prefix ends are ranked, so a leaf with a third of all rows is never sorted in one task.

NULL languages and sources are leaves named ``''``; NULL texts have no tokens. Nodes of weight 0 or
less get nothing. Rows that repeat count as often as they occur, in any order among themselves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.llm.common import free_name
from tillwork.staging import attach, stage

BUCKET_DIGITS = 3
BUCKETS = 16**BUCKET_DIGITS
DOMAINS = ["web", "books", "code", "talk"]
LEVELS = ["domain", "lang", "source"]


@dataclass
class Mix:
    """Weights of nodes by path (``web``, ``web/en``, ``web/en/src0``, or ``*/en`` for a language anywhere); 1 if not named."""

    weights: dict[str, float] = field(default_factory=dict)
    budget_share: float = 0.6  # budget as a part of all tokens
    max_epochs: int = 2
    seed: int = 7


PRODUCTION = Mix({"web": 0.4, "books": 0.3, "code": 0.2, "talk": 0.1, "*/en": 0.5, "*/de": 0.2, "*/fr": 0.2, "*/es": 0.1})


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def domain_of(source: Column) -> Column:
    """Domain by the first hex digit of the source's md5."""
    digit = F.conv(F.substring(F.md5(source.cast("binary")), 1, 1), 16, 10).cast("int")
    return F.get(F.array(*[F.lit(d) for d in DOMAINS]), digit % len(DOMAINS))


def leaf_columns(lang: str = "lang", source: str = "source") -> dict[str, Column]:
    name = F.coalesce(F.col(source), F.lit(""))
    return {"domain": domain_of(name), "lang": F.coalesce(F.col(lang), F.lit("")), "source": name}


def _weight(mix: Mix, level: int) -> Column:
    """Weight of a node of the tree; a path that names all parents goes before ``*/name``."""
    path = F.concat_ws("/", *LEVELS[: level + 1])
    anywhere = F.concat(F.lit("*/"), F.col(LEVELS[level]))
    if not mix.weights:
        return F.lit(1.0)
    named = F.create_map(*[F.lit(x) for item in mix.weights.items() for x in (item[0], float(item[1]))])
    return F.coalesce(F.try_element_at(named, path), F.try_element_at(named, anywhere), F.lit(1.0))


def budgets(supply: DataFrame, mix: Mix) -> DataFrame:
    """``budget`` in tokens per leaf, from a table of ``domain``, ``lang``, ``source``, ``tokens``."""
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    nodes = supply.groupBy(LEVELS).agg(F.sum("tokens").alias("tokens"))
    nodes = nodes.withColumn("share", F.floor(total * F.lit(mix.budget_share)).cast("double"))
    for level, name in enumerate(LEVELS):
        parents = [F.lit(0), *[F.col(c) for c in LEVELS[:level]]]
        here = nodes.groupBy(*LEVELS[: level + 1]).agg(
            (F.sum("tokens") * mix.max_epochs).cast("double").alias("cap"), F.first("share").alias("of_parent")
        )
        here = here.withColumn("w", _weight(mix, level)).filter("w > 0").withColumn("ratio", F.col("cap") / F.col("w"))
        family = Window.partitionBy(*parents)
        before = family.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("of_parent") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
        others = F.sum("w").over(family) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
        here = here.withColumn("unit", left / others)
        here = here.withColumn("share", F.greatest(F.lit(0.0), F.least(F.col("cap"), F.col("w") * F.max("unit").over(family))))
        nodes = nodes.drop("share").join(here.select(*LEVELS[: level + 1], "share"), LEVELS[: level + 1])
    return nodes.select(*LEVELS, "tokens", F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))


def epoch_order(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def _leaf_plan(rows: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """Rows with their leaf's ``full`` epochs, ``rest`` and order; and per leaf the bucket in which the prefix ends."""
    supply = stage(rows.groupBy(LEVELS).agg(F.sum("tokens").alias("tokens")), "supply")
    shares = budgets(supply, mix)
    one = F.greatest(F.col("tokens"), F.lit(1))
    shares = shares.select(*LEVELS, F.floor(F.col("budget") / one).alias("full"), (F.col("budget") % one).alias("rest"))
    ordered = attach(rows, shares, LEVELS, "inner").withColumn("order_key", epoch_order(mix.seed, F.col("full"), F.col("key")))
    ordered = stage(ordered.withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS)), "mix")
    up_to = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("n"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    placed = sums.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    # The last bucket that begins before the prefix ends; buckets before it are whole.
    cuts = placed.filter(F.col("before") < F.col("rest")).groupBy(*LEVELS).agg(F.max(F.struct("bucket", "before")).alias("cut"))
    leaves = sums.groupBy(*LEVELS).agg(F.first("full").alias("full"), F.first("rest").alias("rest"))
    cuts = leaves.join(cuts, LEVELS, "left").select(*LEVELS, "full", "rest", F.col("cut.bucket").alias("cut_bucket"), F.col("cut.before").alias("cut_before"))
    return ordered, stage(cuts, "cuts")


def mix_tokens(
    docs: DataFrame, mix: Mix = PRODUCTION, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", name: Column | None = None
) -> DataFrame:
    """``key``, ``domain``, ``lang``, ``source``, ``n_tokens``, ``epochs`` and ``tokens_used`` of each chosen document.

    ``epochs`` counts the passes that hold the document, ``tokens_used`` the tokens they take from it:
    the last document of a prefix is cut, so that the sum is the leaf's budget. ``name`` tells apart rows
    that share an id; if given, it is returned as ``name``.
    """
    named = [] if name is None else ["name"]
    rows = docs.select(F.col(key).alias("key"), *[name.alias(n) for n in named], *[c.alias(n) for n, c in leaf_columns(lang, source).items()], token_count(F.col(text)).alias("tokens"))
    ordered, cuts = _leaf_plan(stage(rows, "tokens"), mix)  # texts are read once
    marked = attach(ordered.drop("full", "rest"), cuts, LEVELS, "inner")
    whole = marked.filter("full > 0 or bucket < cut_bucket").filter("cut_bucket is null or bucket <> cut_bucket")
    whole = whole.withColumn("prefix", F.when(F.col("bucket") < F.col("cut_bucket"), F.col("tokens")).otherwise(F.lit(0)))
    whole = whole.withColumn("in_prefix", F.coalesce(F.col("bucket") < F.col("cut_bucket"), F.lit(False)))
    so_far = Window.partitionBy(*LEVELS).orderBy("order_key", "key", "tokens", *named).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("cut_before") + F.coalesce(F.sum("tokens").over(so_far), F.lit(0))
    edge = marked.filter("bucket = cut_bucket").withColumn("before", before).withColumn("in_prefix", F.col("before") < F.col("rest"))
    edge = edge.withColumn("prefix", F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - F.col("before")))).drop("before")
    chosen = whole.unionByName(edge).withColumn("epochs", (F.col("full") + F.col("in_prefix").cast("long")).cast("int")).filter("epochs > 0")
    used = F.col("full") * F.col("tokens") + F.col("prefix")
    return chosen.select(F.col("key").alias(key), *LEVELS, F.col("tokens").alias("n_tokens"), "epochs", used.cast("long").alias("tokens_used"), *named)


def keep_mixed(docs: DataFrame, mix: Mix, key: str = "doc_id", **columns: str) -> DataFrame:
    """Documents in at least one epoch, once each, with their own columns. ``key`` (which may be NULL) and text must name one row."""
    row_name = F.concat_ws(":", F.coalesce(F.concat(F.lit("id "), F.col(key).cast("string")), F.lit("null")), F.md5(F.col(columns.get("text", "text")).cast("binary")))
    name = free_name(docs, "_chosen")
    chosen = mix_tokens(docs, mix, key, **columns, name=row_name).select(F.col("name").alias(name)).distinct()
    return attach(docs.withColumn(name, row_name), chosen, [name], "left_semi").select(*docs.columns)
