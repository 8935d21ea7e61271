"""Language identification by fusing text, declared language, address and host.

- Text: counts of hashed letter triples per language, learnt from ``PER_LANGUAGE`` labelled texts of
  each language (those whose ids have the smallest hashes), give the likelihood of the whole text. Every label is
  a language. Triples
  of one text depend on each other, so its weight is that of ``WEIGHT`` triples at most. One more class,
  ``und``, holds all triples equally likely: what no language explains.
- Declared language: how often each declaration comes with each language of the text, counted over
  all rows.
- Address: prior of the host, smoothed by its domain, that by its suffix, and that by all rows; each
  is a grouped count, and a row's own vote is taken out before it is used.

The posterior is the normalised product. A row is rejected if its best language is ``und`` or has a
posterior below ``ACCEPT``. Rows without letters have no text evidence; their ``text_language`` is NULL and they
are rejected. NULL texts are empty; NULL declarations, hosts and addresses are values of their own.
Counts of hosts are joined by a join whose size is measured; nothing of a host's rows meets in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.llm.common import free_name, map_columns
from tillwork.staging import attach, stage

BITS = 16
PER_LANGUAGE = 400
WEIGHT = 60.0
PRIOR_ROWS = 20.0  # weight of the wider group, in rows
UNKNOWN = "und"
UNKNOWN_PRIOR = 0.01
ACCEPT = 0.5


def triples(text: str | None) -> np.ndarray:
    """Hashed letter triples of a text; what lies between letters is one space."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = (points >= 0xAA) & (points != 0xD7) & (points != 0xF7) & ~((points >= 0x2000) & (points < 0x2C00)) | (points >= 97) & (points <= 122)
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, 32)
    keep = letter | np.r_[True, letter[:-1]]
    p = np.r_[32, points[keep], 32].astype(np.uint64)
    mixed = (p[:-2] * np.uint64(0x9E3779B1) + p[1:-1]) * np.uint64(0x85EBCA6B) + p[2:]
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]  # UNKNOWN comes last
    logs: np.ndarray  # triple, language

    def likelihoods(self, text: str | None) -> list[float] | None:
        """Weighted log likelihood of each language; None without letters."""
        found = triples(text)
        if not len(found):
            return None
        return (self.logs[found].sum(axis=0) * min(1.0, WEIGHT / len(found))).tolist()


def learn_text(docs: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text") -> TextModel:
    """Triples per language from a sample of each label's rows."""
    rows = docs.select(F.col(text).alias("t"), F.col(label).alias("s"), F.xxhash64(key).alias("h")).filter(F.col("s") != UNKNOWN)
    order = F.row_number().over(Window.partitionBy("s").orderBy("h"))
    lasts = stage(rows.select("s", "h").withColumn("order", order).filter(F.col("order") <= PER_LANGUAGE).groupBy("s").agg(F.max("h").alias("last")), "languages")
    languages = sorted(r.s for r in lasts.select("s").collect())
    if not languages:
        return TextModel([UNKNOWN], np.full((1 << BITS, 1), -BITS * np.log(2.0)))
    chosen = attach(rows, lasts, ["s"], "inner").filter("h <= last")
    place = {s: i for i, s in enumerate(languages)}

    def count(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for texts, labels in batches:
            rows = []
            for t, s in zip(texts, labels, strict=True):
                gram, n = np.unique(triples(t), return_counts=True)
                rows.append([(place[s] << BITS | int(g)) << 32 | int(c) for g, c in zip(gram, n, strict=True)])
            yield [rows]

    listed = map_columns(chosen.select("t", "s"), ["t", "s"], [("grams", T.ArrayType(T.LongType()))], count, [])
    one = F.explode("grams").alias("g")
    sums = listed.select(one).groupBy(F.shiftright("g", 32).alias("cell")).agg(F.sum(F.col("g").bitwiseAND(F.lit(0xFFFFFFFF))).alias("n"))
    counts = np.zeros((1 << BITS) * len(languages))
    for r in sums.toLocalIterator():  # at most triples times languages
        counts[r.cell] = r.n
    counts = counts.reshape(len(languages), -1).T
    logs = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * (1 << BITS)))
    return TextModel([*languages, UNKNOWN], np.c_[logs, np.full(1 << BITS, -BITS * np.log(2.0))])


def with_text_evidence(rows: DataFrame, model: TextModel, text: str, name: str, keep: list[str], prepare: Callable[[str | None], str | None] | None = None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for (texts,) in batches:
            yield [[shared.value.likelihoods(prepare(t) if prepare else t) for t in texts]]

    return map_columns(rows, [text], [(name, T.ArrayType(T.DoubleType()))], work, keep)


def host_parts(url: Column) -> dict[str, Column]:
    """Host, domain (its last two names) and suffix (its last name) of an address; empty without one."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return {"host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), "suffix": F.regexp_extract(host, r"([^.]+)$", 1)}


def fuse(evidence: DataFrame, languages: list[str], keep: list[str]) -> DataFrame:
    """``keep``, ``language``, ``confidence``, ``text_language`` and ``accepted`` from staged evidence.

    ``evidence`` has ``likelihoods``, ``declared``, ``host``, ``domain`` and ``suffix``.
    """
    n = len(languages)
    places = F.sequence(F.lit(0), F.lit(n - 1))
    vote = F.when(F.col("likelihoods").isNotNull(), (F.array_position("likelihoods", F.array_max("likelihoods")) - 1).cast("int"))
    voted = evidence.withColumn("vote", vote)
    counts = stage(voted.groupBy("suffix", "domain", "host", "vote").agg(F.count("*").cast("double").alias("n")), "votes")
    sums = {r.vote: r.n for r in counts.filter("vote is not null").groupBy("vote").agg(F.sum("n").alias("n")).collect()}  # a row per language
    overall = [sums.get(i, 0.0) for i in range(n)]

    def by(counted: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Votes of each group: an array ``name``, a place per language, and their number ``name_n``."""
        voices = counted.groupBy(*keys, "vote").agg(F.sum("n").alias("n"))
        of = F.map_from_entries(F.collect_list(F.when(F.col("vote").isNotNull(), F.struct("vote", "n"))))
        size = F.coalesce(F.sum(F.when(F.col("vote").isNotNull(), F.col("n"))), F.lit(0.0)).alias(f"{name}_n")
        made = voices.groupBy(*keys).agg(of.alias("of"), size)
        return made.select(*keys, F.transform(places, lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0.0))).alias(name), f"{name}_n")

    hosts = by(counts, ["suffix", "domain", "host"], "by_host")
    table = hosts.join(by(counts, ["suffix", "domain"], "by_domain"), ["suffix", "domain"]).join(by(counts, ["suffix"], "by_suffix"), "suffix")
    declared = stage(voted.groupBy("declared", "vote").agg(F.count("*").cast("double").alias("n")), "declared")
    kinds = declared.select("declared").distinct().count()
    rows = attach(voted.fillna("", ["declared"]), table, ["suffix", "domain", "host"], "inner")
    rows = attach(rows, by(declared.fillna("", ["declared"]), ["declared"], "by_declared"), ["declared"], "inner")
    own = lambda i: F.when(F.col("vote") == i, 1.0).otherwise(0.0)
    start = F.array(*[F.lit((0.0 if s == UNKNOWN else x) + 1.0) for s, x in zip(languages, overall, strict=True)])

    def prior(i: Column) -> Column:
        """From all rows down to the host; the row's own vote is out at each level."""
        value = F.get(start, i) / (sum(overall) + n)
        for level in ("by_suffix", "by_domain", "by_host"):
            size = F.col(f"{level}_n") - F.when(F.col("vote").isNotNull(), 1.0).otherwise(0.0)
            value = (F.get(level, i) - own(i) + PRIOR_ROWS * value) / (size + PRIOR_ROWS)
        return value

    smooth = F.lit(1.0 / max(1, kinds))
    of_language = F.array(*[F.lit(x) for x in overall])
    says = lambda i: (F.get("by_declared", i) - own(i) + smooth) / (F.get(of_language, i) - own(i) + 1.0)
    is_known = [0.0 if s != UNKNOWN else 1.0 for s in languages]
    limit = lambda i: F.when(F.get(F.array(*[F.lit(x) for x in is_known]), i) == 1.0, F.lit(float(np.log(UNKNOWN_PRIOR)))).otherwise(F.log(prior(i)) + F.log(says(i)))
    rows = rows.withColumn("logs", F.transform(places, lambda i: F.coalesce(F.get("likelihoods", i), F.lit(0.0)) + limit(i)))
    rows = rows.withColumn("top", F.array_max("logs"))
    total = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(s) for s in languages])
    rows = rows.withColumn("confidence", F.lit(1.0) / total)
    best = F.get(names, (F.array_position("logs", F.col("top")) - 1).cast("int"))
    rows = rows.withColumn("language", best).withColumn("text_language", F.get(names, F.col("vote")))
    accepted = F.col("vote").isNotNull() & (F.col("language") != UNKNOWN) & (F.col("confidence") >= ACCEPT)
    return rows.select(*keep, "language", "confidence", "text_language", accepted.alias("accepted"))


def identify_pages(pages: DataFrame, model: TextModel, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, ``declared``, ``host`` and the result of ``fuse`` for each page."""
    from tillwork.llm.html_text import main_text

    declared = F.lower(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), declared.alias("declared"), *[c.alias(k) for k, c in host_parts(F.col(url)).items()], F.col(html).alias("html"))
    keep = ["key", "url", "declared", "host", "domain", "suffix"]
    evidence = stage(with_text_evidence(rows, model, "html", "likelihoods", keep, main_text), "evidence")
    return fuse(evidence, model.languages, ["key", "url", "declared", "host"]).withColumnsRenamed({"key": key, "url": url})


def identify_documents(docs: DataFrame, model: TextModel, key: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """``key`` and the result of ``fuse``; the declared language is a column and the host a source."""
    rows = docs.select(
        F.col(key).alias("key"), F.lower(F.coalesce(F.col(declared), F.lit(""))).alias("declared"), F.coalesce(F.col(host), F.lit("")).alias("host"),
        F.lit("").alias("domain"), F.lit("").alias("suffix"), F.col(text).alias("text"),
    )
    evidence = stage(with_text_evidence(rows, model, "text", "likelihoods", ["key", "declared", "host", "domain", "suffix"]), "evidence")
    return fuse(evidence, model.languages, ["key"]).withColumnRenamed("key", key)


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """Documents whose language is accepted, with their own columns.

    Rows that share an id stay if one of them is accepted; rows without an id, if one of these is.
    """
    found = identify_documents(docs, learn_text(docs, declared, key, text), key, text, declared, host)
    name, refused = free_name(docs, "_id"), free_name(docs, "_refused")
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    rejected = found.groupBy(named(key).alias(name)).agg(F.bool_or("accepted").alias(refused)).filter(~F.col(refused)).select(name)
    return attach(docs.withColumn(name, named(key)), rejected, [name], "left_anti").select(*docs.columns)
