"""Language model scoring with an Elias-Fano trie of words, pairs and triples.

1. Tasks cut texts into words (A to Z lower-cased, between ASCII white space) and one end, and send every
   word and pair once per chunk with its count, packed as arrays, to the shard of its context.
2. Each shard becomes one level file of the trie (``ngram_trie``) in the shared folder.
3. Triples are sent the same way; the last word travels as its place among the children of the middle word.
4. Scoring tasks map the level files and look up each word, pair and triple of a chunk once.

All pairs and triples are in the trie, also those that occur once. Probabilities are p1 (the base score's), p2 = m2 share2 + (1 - m2) p1 and p3 = m3 share3 +
(1 - m3) p2, where the shares of a context's children add up to one, so all add up to one. The
weights depend on how often a context was seen: a weight is the part of all training occurrences after such contexts
that are seen again when they are left out themselves, counted while the level files are built.

Counts and weights cover all training texts. A task holds a chunk of ``CHUNK`` bytes, or a shard of some
``SHARD_TOKENS`` tokens: the number of shards grows with the table. Words are known by 60-bit
hashes, contexts by 40 bits beside those that choose their shard. The shared folder must be mounted where tasks run, since files are mapped; a folder that is
not raises an error.

NULL texts are empty: one token, the end. A NULL id counts as the empty text for the held-out rule.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.llm.common import free_name, map_columns, text_remainder
from tillwork.llm.ngram_trie import BUCKETS, MISSING, ContextLevel, U, WordLevel, context_level, map_parts, word_level, write_parts
from tillwork.llm.ngram_trie import bucket_of as _bucket
from tillwork.staging import shared_folder, shuffles_dropped

CHUNK = 5 * 1024 * 1024  # bytes of text
_WORDS_AT_ONCE = 200_000
SHARD_TOKENS = 1_500_000
MERGE = 2_000_000  # entries of a shard that are held before they are merged
DEV_TOKENS = 200_000
# Level files that a worker keeps mapped.
MOST_OPEN = 8192
OTHER = 0xFFFFFFFF
END, BEGIN = U(1 << 40 | 1), U(2 << 40 | 2)  # as unlikely to be a word's hash as any two numbers
WORDS, PAIRS, TRIPLES = 0, 1, 2
_CHILD = U((1 << 40) - 1)
_WIDTH = {WORDS: 1, PAIRS: 5, TRIPLES: 4}  # bytes of a child
_CONTEXT_WIDTH = {WORDS: 8, PAIRS: 5, TRIPLES: 5}
_MOST_SHARD_BITS = 20
PACKED = "level int, shard int, context binary, sizes binary, child binary, count binary"
MADE = "level int, shard int, tokens long, types long, bytes long, left array<long>, again array<long>"


@dataclass
class Chunk:
    """Texts as begin, words, end, begin, ...; a token is a place in ``words``, the sorted hashes.

    ``first`` has the place of each begin.
    """

    words: np.ndarray
    tokens: np.ndarray
    first: np.ndarray

    @property
    def targets(self) -> np.ndarray:
        """Places of words and ends."""
        keep = np.ones(len(self.tokens), bool)
        keep[self.first] = False
        return np.flatnonzero(keep)


# Letters to lower case, white space to one kind.
_FOLD = np.frombuffer(bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 9 <= b <= 13 else b for b in range(256)), np.uint8)
_SPAN = 32
_TABLE = np.random.default_rng(60).integers(0, 1 << 64, (_SPAN, 256), np.uint64)  # one number per place and byte


def _word_hashes(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """60-bit tabulation hash of each word: the sum of its bytes' numbers, mixed. ``data`` has the words without what is between them."""
    out, byte = np.zeros(len(sizes), U), 0
    for i in range(0, len(sizes), _WORDS_AT_ONCE):
        size = sizes[i : i + _WORDS_AT_ONCE].astype(np.int32)
        end = np.cumsum(size)
        first = end - size
        place = np.arange(end[-1], dtype=np.int32)
        place -= np.repeat(first, size)
        number = _TABLE.ravel().take((place & (_SPAN - 1)) << 8 | data[byte : byte + end[-1]])
        if size.max() > _SPAN:
            number *= (2 * (place // _SPAN) + 1).astype(U)
        out[i : i + _WORDS_AT_ONCE] = np.add.reduceat(number, first)
        byte += int(end[-1])
    out = (out ^ (out >> U(31))) * U(0x9E3779B97F4A7C15)
    return (out ^ (out >> U(28))) >> U(4)


def _order(hashes: np.ndarray) -> np.ndarray:
    """Places of hashes of 60 bits in their order."""
    # Each place stands in the lowest bits of its hash: sorting numbers is faster than sorting places by them.
    low = U((1 << len(hashes).bit_length()) - 1)
    order = (np.sort(hashes << U(4) & ~low | np.arange(len(hashes), dtype=U)) & low).view(np.int64)
    ordered = hashes.take(order)
    return np.argsort(hashes) if (ordered[1:] < ordered[:-1]).any() else order


def _chunk(data: np.ndarray, offsets: np.ndarray) -> Chunk:
    """One chunk of the texts that ``offsets`` cut out of ``data``."""
    data = _FOLD[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    n = len(offsets) - 1
    space = data == 32
    edge = np.zeros(len(data) + 1, bool)  # a text ends its last word
    edge[offsets] = True
    starts = np.flatnonzero(~space & (np.r_[True, space[:-1]] | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~space & (np.r_[space[1:], True] | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, starts, side="right") - 1
    words_of = np.bincount(text, minlength=n)
    first = np.r_[0, np.cumsum(words_of + 2)[:-1]]
    tokens = np.empty(len(starts) + 2 * n, U)
    tokens[first], tokens[first + words_of + 1] = BEGIN, END
    tokens[np.arange(len(starts)) + 2 * text + 1] = _word_hashes(data[~space], ends - starts)
    order = _order(tokens)
    tokens = tokens[order]
    new = np.r_[True, tokens[1:] != tokens[:-1]]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return Chunk(tokens[new], number, first)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Whole texts in chunks that end with the text in which ``size`` bytes are reached; NULL is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size)))
        end = min(end, len(texts))
        yield _chunk(data, offsets[at : end + 1])
        at = end


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """60-bit hash of two hashes."""
    x = (a * U(0x9E3779B97F4A7C15)) ^ (b + U(0xD6E8FEB86659FD93))
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return (x ^ (x >> U(29))) >> U(4)


def _shard_bits(shards: int) -> int:
    return min(shards.bit_length() - 1, _MOST_SHARD_BITS)


def _contexts(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Hashes of 60 bits as contexts: the 40 highest bits and those that tell the shard, so that sorted hashes stay sorted."""
    return hashes >> U(20 - _shard_bits(shards))


def _starts(level: int, shards: int) -> np.ndarray:
    """The first context of each shard, and one above all: a shard is a range of contexts, and holds them less its first."""
    bits = 60 if level == WORDS else 40 + _shard_bits(shards)
    return -(-(np.arange(shards + 1, dtype=np.int64) << 40) // shards).astype(U) << U(bits - 40)


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of small numbers in order, their counts, and the pair of each row."""
    if not len(a):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    # The row's place stands below the pair, if there is room: sorting numbers is faster than sorting places by them.
    a, b = a.astype(np.int64), b.astype(np.int64)
    last = int(b.max(initial=-1, where=b != OTHER)) + 1
    place_bits, b_bits = len(a).bit_length(), last.bit_length()
    if place_bits + b_bits + int(a.max()).bit_length() > 63:
        pair = a << 32 | b
        order = np.argsort(pair)
        pair, b_bits, last = pair[order], 32, OTHER
    else:
        pair = np.sort((a << b_bits | np.minimum(b, last)) << place_bits | np.arange(len(a)))
        order = pair & ((1 << place_bits) - 1)
        pair >>= place_bits
    new = np.r_[True, pair[1:] != pair[:-1]]
    starts = np.flatnonzero(new)
    inverse = np.empty(len(pair), np.int64)
    inverse[order] = np.cumsum(new) - 1
    first, second = pair[starts] >> b_bits, pair[starts] & ((1 << b_bits) - 1)
    second[second == last] = OTHER
    return first, second, np.diff(np.r_[starts, len(pair)]), inverse


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of whole numbers, first bytes first, second bytes next: what is alike stands together."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    whole = np.zeros((len(data) // width, 8), np.uint8)
    whole[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return whole.view("<u8").ravel()


def _packed(level: int, shards: int, context: np.ndarray, child: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
    """One row per shard; arrays must be in order of (context, child)."""
    starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(context)])
    first_of, contexts = _starts(level, shards), context[starts]
    ends = np.searchsorted(contexts, first_of)
    row_ends = np.r_[starts, len(context)][ends]
    for s in np.flatnonzero(np.diff(ends)):
        c, r = slice(ends[s], ends[s + 1]), slice(row_ends[s], row_ends[s + 1])
        width = _WIDTH[level]
        yield level, int(s), _planes(contexts[c] - first_of[s], _CONTEXT_WIDTH[level]), _planes(sizes[c], 4), _planes(child[r], width), _planes(count[r], 4)


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # context, child, count


def _unpacked(level: int, batches: Iterator[pa.RecordBatch]) -> Entries:
    """Rows of one shard, merged, in order of (context, child).

    Rows are merged as they come, so that no more than twice the distinct entries and ``MERGE`` more are held.
    """
    held: list[Entries] = []
    n, limit = 0, MERGE
    for batch in batches:
        columns = [batch.column(c) for c in ("context", "sizes", "child", "count")]
        for i in range(batch.num_rows):
            context, sizes, child, count = (c[i].as_py() for c in columns)
            contexts = np.repeat(_from_planes(context, _CONTEXT_WIDTH[level]), _from_planes(sizes, 4).astype(np.int64))
            held.append((contexts, _from_planes(child, _WIDTH[level]), _from_planes(count, 4).astype(np.int64)))
            n += len(contexts)
            if n > limit:
                held = [_merged(held)]
                n = len(held[0][0])
                limit = 2 * n + MERGE
    return _merged(held)


def _merged(held: list[Entries]) -> Entries:
    context, child, count = (np.concatenate(x) for x in zip(*held, strict=True))
    # Number the contexts in order, so that one sort of whole numbers orders both.
    order = np.argsort(context)
    new = np.r_[True, context[order][1:] != context[order][:-1]]
    number = np.empty(len(order), U)
    number[order] = (np.cumsum(new) - 1).astype(U)
    order = np.argsort(number << U(40) | child)
    context, child, count = context[order], child[order], count[order]
    new = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (child[1:] != child[:-1])])
    return context[new], child[new], np.add.reduceat(count, new)


def _file(folder: str, level: int, shard: int) -> str:
    return os.path.join(folder, f"level{level}-{shard:05d}.trie")


def _build(folder: str, level: int, shard: int, batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
    """Writes the level file of one shard; running again writes the same file."""
    context, child, count = _unpacked(level, batches)
    left, again = _left_out(context, child, count)
    if level == WORDS:
        tokens, types = int(count.sum()), len(context)
        size = write_parts(_file(folder, level, shard), word_level(context, count))
    else:
        made = context_level(context, child, count, OTHER if level == TRIPLES else int(_CHILD) + 1, spread=level == TRIPLES)
        tokens, types = int(count.sum()), len(made["code"])
        size = write_parts(_file(folder, level, shard), made)
    return pa.RecordBatch.from_pydict({"level": pa.array([level], pa.int32()), "shard": pa.array([shard], pa.int32()), "tokens": [tokens], "types": [types], "bytes": [size], "left": [left.tolist()], "again": [again.tolist()]})


class Trie:
    """The level files of a model, mapped when first asked for.

    ``files`` has the bytes of every file that was built. A file that is missing or short raises an error:
    it is not an empty shard, which has no file. At most ``MOST_OPEN`` files stay mapped, since a process may
    map only so many.
    """

    def __init__(self, folder: str, shards: int, files: dict[tuple[int, int], int]):
        self.folder, self.shards, self.files = folder, shards, files
        self.open: dict[tuple[int, int], WordLevel | ContextLevel] = {}

    def level(self, level: int, shard: int) -> WordLevel | ContextLevel | None:
        key = (level, shard)
        if key not in self.files:
            return None
        if key not in self.open:
            path = _file(self.folder, level, shard)
            size = os.path.getsize(path) if os.path.exists(path) else None
            if size != self.files[key]:
                raise FileNotFoundError(f"{path} has {size} of {self.files[key]} bytes: is the shared folder mounted here?")
            if len(self.open) >= MOST_OPEN:
                self.open.pop(next(iter(self.open)))
            self.open[key] = (WordLevel if level == WORDS else ContextLevel)(map_parts(path))
        return self.open[key]

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Occurrences of sorted words."""
        out, first_of = np.zeros(len(words), np.int64), _starts(WORDS, self.shards)
        ends = np.searchsorted(words, first_of)
        for s in np.flatnonzero(np.diff(ends)):
            if (level := self.level(WORDS, int(s))) is not None:
                at = slice(ends[s], ends[s + 1])
                out[at] = level.counts(words[at] - first_of[s])
        return out

    def find(self, level: int, contexts: np.ndarray, number: np.ndarray, child: np.ndarray, wanted: tuple[str, ...] = tuple(MISSING)) -> dict[str, np.ndarray]:
        """See ``ContextLevel.find``; ``contexts`` are sorted and ``number`` rises, so that each shard has a piece of both."""
        out, first_of = {name: np.full(len(number), MISSING[name]) for name in wanted}, _starts(level, self.shards)
        ends = np.searchsorted(contexts, first_of)
        row_ends = np.searchsorted(number, ends)
        for s in np.flatnonzero(np.diff(row_ends)):
            held = self.level(level, int(s))
            if held is None:
                continue
            own, at = slice(ends[s], ends[s + 1]), slice(row_ends[s], row_ends[s + 1])
            for name, values in held.find(contexts[own] - first_of[s], number[at] - ends[s], child[at], wanted).items():
                out[name][at] = values
        return out


def _read_pairs(chunk: Chunk, trie: Trie | None, wanted: tuple[str, ...] = tuple(MISSING)) -> dict:
    """Distinct words and pairs of a chunk; with a trie, what is wanted of the pairs."""
    words, word, target = chunk.words, chunk.tokens, chunk.targets
    first, second, count, pair = _counted(word[target - 1], word[target])
    read = {"words": words, "word": word, "target": target, "first": first, "second": second, "count": count, "pair": pair}
    if trie is not None:
        read["found"] = trie.find(PAIRS, _contexts(words, trie.shards), first, words[second] & _CHILD, wanted)
    return read


def _read_triples(chunk: Chunk, read: dict, shards: int) -> dict:
    """Distinct (context, place of the last word) of triples whose first pair is in the trie."""
    target, pair, place = read["target"], read["pair"], read["found"]["place"]
    # The pair before a target ends at the word before it; begins end no pair.
    pair_at = np.full(len(chunk.tokens), -1)
    pair_at[target] = pair
    before = pair_at[target - 1]
    held = np.flatnonzero((before >= 0) & (place[np.maximum(before, 0)] >= 0))
    used = np.zeros(len(read["first"]), bool)
    used[before[held]] = True
    pairs = np.flatnonzero(used)
    number = (np.cumsum(used) - 1)[before[held]]
    contexts = _mix(read["words"][read["first"][pairs]], read["words"][read["second"][pairs]])
    order = _order(contexts)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    last = place[pair[held]]
    context, child, count, triple = _counted(rank[number] if len(held) else number, np.where(last >= 0, last, OTHER))
    return {"contexts": _contexts(contexts[order], shards), "context": context, "child": child, "count": count, "triple": triple, "held": held}


def _count_words_and_pairs(shards: int, batches: Iterator[pa.Array]) -> Iterator[tuple]:
    for chunk in (c for texts in batches for c in chunks(texts)):
        read = _read_pairs(chunk, None)
        counted = np.bincount(read["word"][read["target"]], minlength=len(read["words"]))
        used = np.flatnonzero(counted)
        yield from _packed(WORDS, shards, read["words"][used], np.zeros(len(used), U), counted[used])
        words, first = read["words"], read["first"]
        child = words[read["second"]] & _CHILD
        yield from _packed(PAIRS, shards, _contexts(words, shards)[first], child, read["count"])


def _count_triples(folder: str, shards: int, files: dict[tuple[int, int], int], batches: Iterator[pa.Array]) -> Iterator[tuple]:
    trie = Trie(folder, shards, files)
    for chunk in (c for texts in batches for c in chunks(texts)):
        triples = _read_triples(chunk, _read_pairs(chunk, trie, ("place",)), shards)
        yield from _packed(TRIPLES, shards, triples["contexts"][triples["context"]], triples["child"].astype(U), triples["count"])


def _gather(docs: DataFrame, text: str, count, folder: str) -> list:
    """Runs a counting function over the texts and builds the level files of what it sends; a row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        rows: list[tuple] = []
        for row in count(batch.column(0) for batch in batches):
            rows.append(row)
            if len(rows) >= 64:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["level", "shard", "context", "sizes", "child", "count"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["level", "shard", "context", "sizes", "child", "count"])

    packed = docs.select(F.col(text)).mapInArrow(run, PACKED)

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _build(folder, key[0].as_py(), key[1].as_py(), batches)

    with shuffles_dropped(docs.sparkSession):  # the level files hold all that was shuffled
        return packed.groupBy("level", "shard").applyInArrow(build, MADE).collect()  # a row per file


@dataclass
class Model:
    folder: str
    shards: int
    files: dict[tuple[int, int], int]  # bytes of each (level, shard)
    tokens: int  # N of the base score
    types: int  # V of the base score
    pair_weights: np.ndarray
    triple_weights: np.ndarray

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.tokens + 0.1 * (self.types + 1))


def _parts(found: dict, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each (context, child) adds to a probability, and its factor for that of the shorter context."""
    weight = np.r_[weights, 0.0].take(found["bucket"])
    return weight * found["share"], 1 - weight


def _mixed(shorter: np.ndarray, share: np.ndarray, kept: np.ndarray, total: np.ndarray, weights: np.ndarray) -> np.ndarray:
    own, rest = _parts({"share": share, "bucket": np.where(kept > 0, _bucket(kept, total), MISSING["bucket"])}, weights)
    return own + rest * shorter


def _left_out(context: np.ndarray, child: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By bucket: occurrences whose context is still seen when they are left out, and those of them whose child is too.

    Rows are in order of (context, child).
    """
    starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    total = np.add.reduceat(count, starts)
    rest = np.repeat(total, np.diff(np.r_[starts, len(context)])) - 1
    bucket, held = _bucket(rest, rest), rest > 0
    found = held & (count > 1) & (child != OTHER)
    return tuple(np.bincount(bucket[at], weights=count[at], minlength=BUCKETS).astype(np.int64) for at in (held, found))


def _whole_weights(made: list, level: int) -> np.ndarray:
    """Weight of each bucket out of all training occurrences; few of them pull it to a small prior."""
    left, again = (sum((np.array(r[name]) for r in made if r.level == level), np.zeros(BUCKETS)) for name in ("left", "again"))
    return np.minimum((again + 0.2) / (left + 4.0), 0.98)


def _without_own(found: dict, context: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``share``, ``kept`` and ``total`` after taking a text's own ``count`` of each (context, child) out; rows in order of context."""
    seen = np.rint(found["share"] * found["kept"]).astype(np.int64)
    left = np.maximum(seen - count, 0)
    lost = np.bincount(context, weights=seen - left)[context].astype(np.int64)
    own = np.bincount(context, weights=count)[context].astype(np.int64)
    kept, total = np.maximum(found["kept"] - lost, 0), np.maximum(found["total"] - own, 0)
    return np.where(kept > 0, left / np.maximum(kept, 1), 0.0), kept, total


def _weights(share: np.ndarray, kept: np.ndarray, total: np.ndarray, shorter: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weight of each bucket by expectation maximisation; few occurrences pull it to a small prior."""
    weights = np.full(BUCKETS, 0.2)
    held = kept > 0
    bucket, share, shorter = _bucket(kept[held], total[held]), share[held], shorter[held]
    n = np.bincount(bucket, minlength=BUCKETS)
    for _ in range(rounds):
        own = weights[bucket] * share
        part = own / np.maximum(own + (1 - weights[bucket]) * shorter, 1e-300)
        weights = (np.bincount(bucket, weights=part, minlength=BUCKETS) + 0.2) / (n + 4.0)
    return np.minimum(weights, 0.98)


def fit_to(model: Model, texts: list[str | None]) -> None:
    """Other weights, for a use known beforehand: fitted to some training texts, each read with its own counts taken out.

    ``train`` does not use it; its weights come from all texts.
    """
    trie = Trie(model.folder, model.shards, model.files)
    pairs, triples = [], []
    for text in texts:
        for chunk in chunks(pa.array([text], pa.string())):
            read = _read_pairs(chunk, trie)
            found, number, pair = read["found"], read["first"], read["pair"]
            share, kept, total = _without_own(found, number, read["count"])
            words, target = read["words"], read["target"]
            own = np.bincount(read["word"][target], minlength=len(words))
            p1 = model.word_probability(np.maximum(trie.counts(words) - own, 0))[read["word"][target]]
            pairs.append((share[pair], kept[pair], total[pair], p1))
            t = _read_triples(chunk, read, trie.shards)
            got = trie.find(TRIPLES, t["contexts"], t["context"], t["child"].astype(U))
            share3, kept3, total3 = _without_own(got, t["context"], t["count"])
            full = [np.zeros(len(target)), np.zeros(len(target), np.int64), np.zeros(len(target), np.int64)]
            for values, out in zip((share3, kept3, total3), full, strict=True):
                out[t["held"]] = values[t["triple"]]
            triples.append(full)
    if not pairs:
        return
    share, kept, total, p1 = (np.concatenate(x) for x in zip(*pairs, strict=True))
    model.pair_weights = _weights(share, kept, total, p1)
    p2 = _mixed(p1, share, kept, total, model.pair_weights)
    share, kept, total = (np.concatenate(x) for x in zip(*triples, strict=True))
    model.triple_weights = _weights(share, kept, total, p2)


def mounted_folder(spark: SparkSession) -> str:
    """A new folder for level files in the session's shared folder, which tasks must see as files."""
    shared = shared_folder(spark)
    scheme, _, path = shared.partition(":") if ":" in shared else ("file", "", shared)
    if scheme != "file":
        raise ValueError(f"level files are mapped: the shared folder must be mounted, not {shared}")
    folder = os.path.join("/" + path.lstrip("/"), spark.sparkContext.applicationId, f"trie-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return folder


def train(docs: DataFrame, text: str = "text") -> Model:
    """A model of all texts of ``docs``."""
    spark = docs.sparkSession
    sizes = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    shards = max(2, int((sizes.n + 6 * sizes.rows) / 6 // SHARD_TOKENS) + 1)
    folder = mounted_folder(spark)
    made = _gather(docs, text, partial(_count_words_and_pairs, shards), folder)
    files = {(r.level, r.shard): r.bytes for r in made}
    made += _gather(docs, text, partial(_count_triples, folder, shards, files), folder)
    files = {(r.level, r.shard): r.bytes for r in made}
    words = [r for r in made if r.level == WORDS]
    weights = [_whole_weights(made, level) for level in (PAIRS, TRIPLES)]
    return Model(folder, shards, files, sum(r.tokens for r in words), sum(r.types for r in words), *weights)


def _dev_texts(docs: DataFrame, text: str, tokens: int) -> list[str | None]:
    """Texts of the smallest hashes, until they hold some ``DEV_TOKENS`` tokens; one at least."""
    rows = docs.select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    part = min(1.0, 2 * DEV_TOKENS / max(1, tokens))
    while True:  # the part of hashes is widened until its texts hold enough
        below = rows.filter(F.col("h") <= F.lit(min((1 << 63) - 1, -(1 << 63) + int(part * (1 << 64)))).cast("long"))
        # A text has one token at least, so no more rows are needed.
        sizes = below.select("h", F.coalesce(F.octet_length("t"), F.lit(0)).alias("n")).orderBy("h", "n").limit(DEV_TOKENS).toArrow()
        hashes, sums = sizes["h"].to_numpy(), np.cumsum(sizes["n"].to_numpy().astype(np.int64) // 6 + 1)
        if part >= 1 or len(sums) and sums[-1] >= DEV_TOKENS:
            break
        part = min(1.0, 8 * part)
    if not len(hashes):
        raise RuntimeError("no texts to learn the mixing weights from")
    taken = min(int(np.searchsorted(sums, DEV_TOKENS)) + 1, len(hashes))
    found = rows.filter(F.col("h") <= int(hashes[taken - 1])).orderBy("h", F.octet_length("t")).limit(taken)
    return [r.t for r in found.select("t").collect()]


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, result: str = "lm") -> DataFrame:
    """Adds the struct ``result``: ``n_tokens``, ``n_known``, ``base_score`` and ``score`` (log10)."""
    kind = T.StructType([
        T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        trie = Trie(model.folder, model.shards, model.files)
        for (texts,) in batches:
            parts = [_scores(chunk, trie, model) for chunk in chunks(texts)]
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * 4
            yield [pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=kind.names)]

    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return map_columns(docs, [text], [(result, kind)], work, keep, as_lists=False, rows_at_once=4096)


def _scores(chunk: Chunk, trie: Trie, model: Model) -> tuple[np.ndarray, ...]:
    read = _read_pairs(chunk, trie, ("place", "share", "bucket"))
    target, pair = read["target"], read["pair"]
    # Worked out once a word, pair and triple, then dealt to the tokens.
    word, counts = read["word"][target], trie.counts(read["words"])
    p1 = model.word_probability(counts)
    own, rest = _parts(read["found"], model.pair_weights)
    p = own[pair] + rest[pair] * p1[word]
    t = _read_triples(chunk, read, trie.shards)
    own, rest = _parts(trie.find(TRIPLES, t["contexts"], t["context"], t["child"], ("share", "bucket")), model.triple_weights)
    three, held = t["triple"], t["held"]
    p[held] = own[three] + rest[three] * p[held]
    first = np.searchsorted(target, chunk.first)
    sizes = np.diff(np.r_[first, len(target)])
    known, base, whole = (np.add.reduceat(x, first) for x in ((counts > 0).astype(np.int64)[word], np.log10(p1)[word], np.log10(p)))
    return sizes, known, base, whole


def held_out(key: Column, modulus: int = 10) -> Column:
    return F.coalesce(text_remainder(key, modulus), F.lit(0)) == 0


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's scores by a model of those not held out."""
    rows = docs.select(F.col(key), held_out(F.col(key)).alias(free_name(docs, "held_out")), F.col(text))
    model = train(rows.filter(~F.col(rows.columns[1])), text)
    scored = score(rows, model, text, rows.columns[:2])
    return scored.select(
        F.col(key), F.col(rows.columns[1]).alias("held_out"), "lm.n_tokens", "lm.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "lm.base_score", "lm.score",
    )
