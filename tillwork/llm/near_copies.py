"""SimHash near-duplicates found by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most three bits agree, but for one bit, in one of two
segments of 32 bits. Every fingerprint is indexed under 64 keys: for either segment and each of its
bits, the segment with that bit left out. Fingerprints that share a key are verified.

Texts with one fingerprint are one row of the index. Keys are dealt out by hash and sorted, and each
task walks its keys in order. Fingerprints of one key are compared in blocks of numpy arrays, and a
link is given out only if it joins two that are not yet joined under that key, so the links of a key
are fewer than its members and never all pairs. A key with more than ``LARGE`` members (variants of
one text) is indexed again by the segment that is not yet fixed, cut into two, down to single bits,
so that work stays far below the square of its members.

Links become components by alternating star contraction; every step is a written table.

Texts: A to Z lower-cased, words between ASCII white space, shingles of three words with repeats, one
shingle for fewer words. No words: fingerprint 0. NULL ids take part; a component's id is the
smallest id that is not NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.llm.common import free_name, lower_words, map_columns
from tillwork.staging import attach, stage

SHINGLE = 3
DISTANCE = 3
SEED = 42
LARGE = 2048
EDGES = "a long, b long"


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash as a signed number; a bit is set if over half of the shingle hashes have it."""
    words = lower_words(text)
    if not words:
        return 0
    normal = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = max(0, len(words) - shingle)
    tails = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(normal[a:b], SEED) for a, b in zip(starts[: last + 1].tolist(), tails, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text: str, keep: list[str], name: str) -> DataFrame:
    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for (texts,) in batches:
            yield [[fingerprint(t) for t in texts]]

    return map_columns(docs, [text], [(name, T.LongType())], work, keep)


def variant_keys(fp: Column) -> Column:
    """The 64 keys of a fingerprint: segment, bit left out, and the segment without that bit."""
    number = F.sequence(F.lit(0), F.lit(63))

    def key(n: Column) -> Column:
        segment = F.call_function("shiftrightunsigned", fp, F.when(n < 32, 0).otherwise(32)).bitwiseAND(F.lit(0xFFFFFFFF))
        rest = segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), n % 32)))
        return F.call_function("shiftleft", n.cast("long"), F.lit(32)).bitwiseOR(rest)

    return F.transform(number, key)


class _Joined:
    """Which members are joined already, over arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.parent[at]
        while True:
            above = self.parent[found]
            if (above == found).all():
                self.parent[at] = found
                return found
            found = above

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins pairs that are apart; returns those that were needed."""
        apart = self.roots(a) != self.roots(b)
        used = []
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                used.append((i, j))
        pairs = np.array(used, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def group_links(group: np.ndarray, fp: np.ndarray, low: int, width: int, joined: _Joined, own: np.ndarray, distance: int, large: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is apart, within runs of equal ``group``.

    ``own`` are the members' numbers. Bits ``low`` to ``low + width`` of a group's members are not
    yet fixed; larger groups are indexed again by them.
    """
    links = []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    big = (sizes > large) & (width > 1)
    if big.any():
        half, rest = width // 2, width - width // 2
        of_group = np.repeat(np.arange(len(sizes)), sizes)
        held = np.flatnonzero(np.repeat(big, sizes))
        for at, bits, next_low, next_width in ((low, half, low + half, rest), (low + half, rest, low, half)):
            segment = (fp[held] >> np.uint64(at)) & np.uint64((1 << bits) - 1)
            for bit in range(bits):
                rest_of = segment & ~np.uint64(1 << bit)
                order = np.lexsort((rest_of, of_group[held]))
                member = held[order]
                change = (np.diff(rest_of[order].astype(np.int64)) != 0) | (np.diff(of_group[member]) != 0)
                links += group_links(np.r_[0, np.cumsum(change)], fp[member], next_low, next_width, joined, own[member], distance, large)
    limit = np.repeat(np.where(big, 0, sizes), sizes)
    place = np.arange(len(group)) - np.repeat(starts, sizes)
    step, first = 1, np.flatnonzero(limit > 1)
    while len(first):
        first = first[place[first] + step < limit[first]]
        near = first[np.bitwise_count(fp[first] ^ fp[first + step]) <= distance]
        if len(near):
            links.append(joined.join(own[near], own[near + step]))
        step += 1
    return links


def _linked(keys: np.ndarray, fps: np.ndarray, distance: int, large: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; every row is a member of its own key only."""
    values = fps.view(np.uint64)
    first = np.zeros(0, np.int64)
    links = [(first, first)]
    in_first_segment = (keys >> 32) < 32
    for held, free_from in ((in_first_segment, 32), (~in_first_segment, 0)):
        at = np.flatnonzero(held)
        if len(at):
            found = group_links(keys[at], values[at], free_from, 32, _Joined(len(at)), np.arange(len(at)), distance, large)
            links += [(at[a], at[b]) for a, b in found]
    return fps[np.concatenate([a for a, _ in links])], fps[np.concatenate([b for _, b in links])]


def near_links(prints: DataFrame, distance: int = DISTANCE, large: int = LARGE) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) that join all that differ in ``distance`` bits or fewer."""
    if distance > 3:
        raise ValueError("two segments with one bit left out find up to three differing bits")
    variants = prints.select("fp", F.explode(variant_keys(F.col("fp"))).alias("key"))
    dealt = variants.repartition("key").sortWithinPartitions("key", "fp")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = _linked(keys, fps, distance, large)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            keys = np.r_[keys, batch.column("key").to_numpy()]
            fps = np.r_[fps, batch.column("fp").to_numpy()]
            # The last key may go on in the next batch.
            end = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if end:
                yield out(keys[:end], fps[:end])
                keys, fps = keys[end:], fps[end:]
        if len(keys):
            yield out(keys, fps)

    return dealt.select("key", "fp").mapInArrow(walk, EDGES).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node that has a link.

    Large stars and small stars in turn, until the links no longer change.
    """
    edges = stage(links.filter("a <> b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        edges = stage(small.filter("a <> b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        before = now
    raise RuntimeError(f"components still change after {most_rounds} rounds")


def _row_name(key: str, text: str) -> Column:
    """Text of the id and md5 of the text: rows of one name are equal in both."""
    row_id = F.coalesce(F.concat(F.lit("id "), F.col(key).cast("string")), F.lit("null"))
    return F.concat_ws(":", row_id, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _classed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``name``, ``fp`` and ``stays`` (is_null, id, name of the row that stays) of each row."""
    rows = docs.select(F.col(key).alias("id"), _row_name(key, text).alias("name"), F.col(text).alias("text"))
    prints = stage(with_fingerprints(rows, "text", ["id", "name"], "fp"), "prints")
    least = F.min(F.struct(F.isnull("id").alias("is_null"), "id", "name")).alias("stays")
    distinct = stage(prints.groupBy("fp").agg(least), "distinct")
    roots = components(near_links(distinct))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = rooted.join(rooted.groupBy("root").agg(F.min("stays").alias("first")), "root").select("fp", F.col("first").alias("stays"))
    return attach(prints, classes, ["fp"], "inner")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row."""
    fingerprint_text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _classed(docs, key, text).select(F.col("id").alias(key), fingerprint_text.alias("fingerprint"), F.col("stays.id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with its own columns: the smallest id; without any id, one of the texts.

    Rows that repeat both id and text are copies of one row; equal ids with texts of different components all stay.
    """
    name, rows = free_name(docs, "_name"), free_name(docs, "_rows")
    stays = _classed(docs, key, text).filter("name = stays.name").groupBy("name").agg(F.count("*").alias(rows))
    stays = stage(stays.withColumnRenamed("name", name), "stays")
    kept = attach(docs.withColumn(name, _row_name(key, text)), stays.select(name), [name], "left_semi")
    if not stays.filter(F.col(rows) > 1).isEmpty():
        kept = kept.dropDuplicates([name])
    return kept.select(*docs.columns)
