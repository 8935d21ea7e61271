"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (lower-cased) and the first four, five and six letters of longer words,
hashed to ``BUCKETS`` numbers. A beginning that several different words of the text share gives one
term more for each number in ``SHARED_BY`` that they reach: many compounds of one stem say more than
a single one. A term counts once however often it occurs, and every word of the text counts. The
score is the logistic value of w0 + sum w_i + sum over pairs of <v_i, v_j>: the pair part tells an
insult together with a mention of a group from either alone.

Learning: at most ``SAMPLE`` labelled training rows, taken by the hash of their id. Terms are counted by
label over that sample in tasks; the ``TERMS`` terms whose counts differ most from chance are
kept, all others have no weight. The kept terms of the sample go to the driver (bounded by the two
parameters), which fits the machine with adaptive steps. Scoring reads nothing but the text.

NULL and empty texts have no terms and get the score of w0 alone. Labels that repeat an id count as
their largest; NULL labels are left out. Rows without an id are held out. With labels of one kind
only, or none, scores are constant.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.llm.common import free_name, map_columns, text_remainder
from tillwork.staging import stage

BUCKETS = 1 << 20
SAMPLE = 20_000
TERMS = 4096
FACTORS = 8
EPOCHS = 12
BATCH = 256
PREFIXES = (4, 5, 6)
SHARED_BY = (2, 4)
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000


class _Terms(dict):
    """Term numbers of a word and of its beginnings, remembered; forgets all when full."""

    def __missing__(self, word: str) -> tuple[int, tuple[int, ...]]:
        if len(self) >= _CACHE:
            self.clear()
        number, *begins = (xxhash.xxh64_intdigest(f) % BUCKETS for f in ("=" + word, *("^" + word[:n] for n in PREFIXES if len(word) > n)))
        made = self[word] = number, tuple(begins)
        return made


def terms_of(text: str | None, cache: _Terms) -> np.ndarray:
    """Distinct term numbers of a text."""
    words = [cache[word] for word in set(_WORD.findall(text.lower()))] if text else []
    found = {number for number, _ in words}
    shared = Counter(chain.from_iterable(begins for _, begins in words))
    found.update(shared)
    several = [(begin, n) for begin, n in shared.items() if n >= SHARED_BY[0]]
    for least in SHARED_BY:
        found.update((begin + least * 0x9E3779B1) % BUCKETS for begin, n in several if n >= least)
    return np.fromiter(found, np.int64, len(found))


@dataclass
class Machine:
    """Weights of kept terms; ``place`` gives a term's row, 0 for terms without weight."""

    place: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, terms: np.ndarray) -> float:
        rows = self.place[terms]
        rows = rows[rows > 0]
        v = self.factors[rows]
        total = v.sum(axis=0)
        raw = self.bias + self.linear[rows].sum() + 0.5 * float((total * total).sum() - (v * v).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))))


def _fit(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, seed: int = 11) -> tuple[float, np.ndarray, np.ndarray]:
    """Adaptive gradient steps on the logistic loss; ``rows`` hold term rows from 1 on."""
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(n_terms + 1), rng.normal(0, 0.02, (n_terms + 1, FACTORS))
    seen_l, seen_f, seen_b = np.full(n_terms + 1, 1e-2), np.full((n_terms + 1, FACTORS), 1e-2), 1e-2
    rate = labels.mean()
    bias = float(np.log(max(rate, 1e-4) / max(1 - rate, 1e-4)))
    if rate in (0.0, 1.0):
        return bias, linear, np.zeros_like(factors)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            sizes = np.array([len(rows[i]) for i in batch])
            flat = np.concatenate([rows[i] for i in batch]) if sizes.sum() else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(batch)), sizes)
            v = factors[flat]
            total = np.zeros((len(batch), FACTORS))
            np.add.at(total, of, v)
            squares = np.bincount(of, weights=(v * v).sum(axis=1), minlength=len(batch))
            raw = bias + np.bincount(of, weights=linear[flat], minlength=len(batch)) + 0.5 * ((total * total).sum(axis=1) - squares)
            error = (1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]) / len(batch)
            step_l = np.bincount(flat, weights=error[of], minlength=n_terms + 1) + 1e-6 * linear
            step_f = np.zeros_like(factors)
            np.add.at(step_f, flat, error[of][:, None] * (total[of] - v))
            step_f += 1e-6 * factors
            step_b = error.sum()
            seen_l += step_l**2
            seen_f += step_f**2
            seen_b += step_b**2
            linear -= 0.3 * step_l / np.sqrt(seen_l)
            factors -= 0.05 * step_f / np.sqrt(seen_f)
            bias -= 0.1 * step_b / np.sqrt(seen_b)
    return bias, linear, factors


def is_held_out(key: Column, modulus: int = 5) -> Column:
    return F.coalesce(text_remainder(key, modulus), F.lit(0)) == 0


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """A machine learnt from labelled rows that are not held out."""
    marked = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).dropna().filter(~is_held_out(F.col("id")))
    marked = marked.groupBy("id").agg(F.max("y").alias("y"))
    n = marked.count()
    wide = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, 2 * SAMPLE / max(1, n)) * (1 << 20))
    sample = marked.filter(wide).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    # At most SAMPLE small rows: a proven bound.
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")

    def count(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        cache = _Terms()
        for texts, ys in batches:
            yield [[[int(y), *terms_of(t, cache).tolist()] for t, y in zip(texts, ys, strict=True)]]

    listed = map_columns(rows, ["text", "y"], [("terms", T.ArrayType(T.IntegerType()))], count, ["id"])
    listed = listed.select("id", F.get("terms", F.lit(0)).alias("y"), F.expr("slice(terms, 2, greatest(size(terms) - 1, 0))").alias("terms")).dropDuplicates(["id"])
    listed = stage(listed, "terms")
    totals = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    pos, neg = totals.pos, totals.n - totals.pos
    each = listed.select("id", "y", F.explode("terms").alias("term"))
    # Deviation from the count expected by chance, in its standard deviations.
    rate = pos / max(1, totals.n)
    expected = F.col("c") * rate
    z = F.abs(F.col("a") - expected) / F.sqrt(expected * (1 - rate) + 1.0)
    counts = each.groupBy("term").agg(F.sum("y").alias("a"), F.count("*").alias("c")).filter("c >= 3")
    kept = np.array(sorted(r.term for r in counts.orderBy(z.desc(), "term").limit(TERMS).collect()), np.int64)
    place = np.zeros(BUCKETS, np.int32)
    place[kept] = np.arange(1, len(kept) + 1)
    best = docs.sparkSession.createDataFrame([(int(t),) for t in kept], "term int")
    held = each.join(F.broadcast(best), "term", "left_semi").groupBy("id", "y").agg(F.collect_list("term").alias("terms")).collect()
    # Documents without any kept term count by their number only.
    data = [place[np.array(r.terms, np.int64)].astype(np.int64) for r in held]
    ys = [r.y for r in held]
    empty = [pos - sum(ys), neg - (len(ys) - sum(ys))]
    data += [np.zeros(0, np.int64)] * sum(empty)
    labels_all = np.array([*ys, *[1] * empty[0], *[0] * empty[1]], np.float64)
    if not len(labels_all):
        return Machine(place, 0.0, np.zeros(1), np.zeros((1, FACTORS)))
    return Machine(place, *_fit(data, labels_all, len(kept)))


def score_texts(docs: DataFrame, machine: Machine, text: str = "text", keep: list[str] | None = None, result: str = "score") -> DataFrame:
    """Adds ``result``, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        cache, m = _Terms(), shared.value
        for (texts,) in batches:
            yield [[m.score(terms_of(t, cache)) for t in texts]]

    return map_columns(docs, [text], [(result, T.DoubleType())], work, keep)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every document."""
    name = free_name(docs, "score")
    scored = score_texts(docs, learn(docs, labels, key, text, label), text, [key], name)
    return scored.select(F.col(key), is_held_out(F.col(key)).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))
