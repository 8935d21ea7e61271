"""Benchmark decontamination with one Aho-Corasick automaton over the normalised items.

Texts are lower-cased (A to Z) and cut into words of ASCII digits, ASCII letters and characters
beyond ASCII. Every window of ``window`` consecutive item words is one pattern; an item of fewer
words is one pattern. A document is normalised to its words with one space between them, scanned
once, and matches are mapped back to word numbers and to character offsets of the original text.

The items are the stated query set: they travel to the tasks in blocks of at most ``block_bytes``
bytes of item text, one automaton per block (the usual benchmark fits one). Documents are never
shuffled; what a task holds is one batch of documents and one automaton.

NULL and empty texts have no words. Items with a NULL id or without words are left out; an id that
occurs with several texts counts once. Other columns of the documents pass through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.llm.common import free_name, map_columns

WINDOW = 10
BLOCK_BYTES = 2 * 1024 * 1024
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # on the original text, so A-Z are word characters
# Bytes of a word stay (upper case lowered); every other ASCII byte becomes a space.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("words", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
])


def patterns_of(items: list[tuple[str, str]], window: int) -> dict[str, set[str]]:
    """Item ids by the words of each window, a space between them."""
    found: dict[str, set[str]] = {}
    for item, text in items:
        words = text.encode().translate(_FOLD).split()
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(b" ".join(words[i : i + window]).decode(), set()).add(item)
    return found


def automaton_of(items: list[tuple[str, str]], window: int) -> ahocorasick.Automaton | None:
    """Automaton whose patterns stand between spaces, so that a match begins and ends at word bounds."""
    automaton = ahocorasick.Automaton()
    for words, ids in patterns_of(items, window).items():
        automaton.add_word(f" {words} ", (words.count(" ") + 1, ids))
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def merge(ranges: list[list[int]]) -> list[list[int]]:
    """Ranges (ends exclusive) as disjoint ranges in order; touching ranges become one."""
    merged: list[list[int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def scan(text: str | None, automaton: ahocorasick.Automaton | None, before: dict | None = None) -> dict:
    """Word ranges and items that match in one text, added to what earlier blocks found."""
    words = text.encode().translate(_FOLD).split() if text else []
    ranges = list(before["words"]) if before else []
    items = set(before["items"]) if before else set()
    if words and automaton is not None:
        normal = (b" " + b" ".join(words) + b" ").decode()
        matches = [(end, n, ids) for end, (n, ids) in automaton.iter(normal)]
        if matches:
            spaces = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), np.uint32) == 32)
            ends = np.searchsorted(spaces, [m[0] for m in matches])
            ranges += [[int(e) - n, int(e)] for e, (_, n, _) in zip(ends, matches, strict=True)]
            for _, _, ids in matches:
                items |= ids
    ranges = merge(ranges)
    spans = []
    if ranges:
        at = [m.span() for m in _WORD.finditer(text)]
        spans = [[at[a][0], at[b - 1][1]] for a, b in ranges]
    return {"n_words": len(words), "n_hit": sum(b - a for a, b in ranges), "items": sorted(items), "words": ranges, "spans": spans}


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    result: str = "contamination",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds one struct column ``result`` to the documents.

    Fields: ``n_words``; ``n_hit`` words inside a match; ``items`` ids with a match, sorted;
    ``words`` and ``spans``, the matched ranges as word numbers and as character offsets of the
    original text (end exclusive).
    """
    spark = docs.sparkSession
    chosen = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).dropna().distinct()
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    keep = list(docs.columns) if keep is None else keep
    found, earlier = docs, None
    for block in range(blocks):
        part = chosen.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([(r.id, r.text) for r in part.toLocalIterator()])

        def work(batches: Iterator[list[list]], shared=shared, chained=earlier is not None) -> Iterator[list[list]]:
            automaton = automaton_of(shared.value, window)
            for columns in batches:
                before = columns[1] if chained else [None] * len(columns[0])
                yield [[scan(t, automaton, b) for t, b in zip(columns[0], before, strict=True)]]

        last = block == blocks - 1
        name = result if last else free_name(found, "_hits")
        inputs = [text] if earlier is None else [text, earlier]
        kept = keep if last else [*dict.fromkeys([*keep, text])]
        found, earlier = map_columns(found, inputs, [(name, RESULT)], work, kept), name
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any matching window, with their own columns."""
    name = free_name(docs, "contamination")
    return find_contamination(docs, items, result=name, **options).filter(F.col(name)["n_hit"] == 0).select(*docs.columns)
