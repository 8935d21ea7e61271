"""Elias-Fano sequences, and the n-gram trie levels built of them, over numpy arrays that map files.

A level of the trie is cut into shards by the hash of the context. A shard holds its contexts as a
monotone sequence of hashes, a monotone sequence of pointers to their children, and the children. A
child is known relative to its context: for pairs, by 40 bits of the word's hash; for triples, by the
position of the last word among the children of the middle word, which is a small number. Children are
made monotone over the whole shard by the pointer of their context, which stands above them, and multiplied by the
number of the context's children, so that they are spread evenly however many a context has: the bucket of a
successor search holds one child on average. The pointers tell a child's place among its context's.
Probabilities are kept as 16-bit codes of their logarithm, occurrences of contexts as monotone running sums, and
beside them the bucket of each context's mixing weight as one byte, which is all that scoring asks for.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

CODE_STEP = 16384  # codes per root of a power of ten, so closest near one; 16 bits reach below 1e-15
_BIT = np.uint8([[([i for i in range(8) if b >> i & 1] + [8] * 8)[r] for r in range(8)] for b in range(256)])
U = np.uint64
_STEPS = 3  # elements of a bucket that are looked at one by one
_EVERY = 8  # buckets, or elements, from one whose place in the high parts is stored to the next
# Buckets of contexts for the weights: how often kept children were seen, and their part of all occurrences.
_SEEN, _SURE = 10, 10
BUCKETS = _SEEN * _SURE


def bucket_of(kept: np.ndarray, total: np.ndarray) -> np.ndarray:
    seen = np.minimum(np.log2(np.maximum(kept, 1)).astype(np.int64), _SEEN - 1)
    sure = np.minimum(kept * _SURE // np.maximum(total, 1), _SURE - 1)
    return seen * _SURE + sure


def _behind() -> np.ndarray:
    """Place behind the set bit of rank 1 to 7 in each 16 bits: 0 for rank 0, 255 if there are not so many."""
    bits, out = np.arange(1 << 16, dtype=np.uint32), np.zeros((_EVERY, 1 << 16), np.uint8)
    for rank in range(1, _EVERY):
        out[rank] = np.where(bits, np.bitwise_count((bits & -bits) - np.uint32(1)) + 1, 255)
        bits &= np.maximum(bits, 1) - np.uint32(1)
    return out.ravel()


_BEHIND = _behind()


def encode(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.sqrt(np.maximum(-np.log10(p), 0)) * CODE_STEP), 0, 65535).astype(np.uint16)


def decode(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** -((codes / np.float64(CODE_STEP)) ** 2)


_DECODED = decode(np.arange(1 << 16))


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit with the given rank in each 64-bit word."""
    words, rank, place = words.astype(U), rank.astype(np.int64), np.zeros(len(words), np.int64)
    for half in (32, 16, 8):
        low = np.bitwise_count(words & U((1 << half) - 1)).astype(np.int64)
        up = rank >= low
        rank -= low * up
        words >>= up * U(half)
        place += up * half
    return place + _BIT[(words & U(255)).astype(np.int64), np.clip(rank, 0, 7)]


class EliasFano:
    """A sequence that never falls, in about two bits an element plus the low bits."""

    def __init__(self, arrays: dict[str, np.ndarray], size: int, low_bits: int):
        self.high, self.ones, self.low = arrays["high"], arrays["ones"], arrays["low"]
        self.starts, self.places = arrays["starts"], arrays["places"]
        self.size, self.low_bits, self.mask = size, low_bits, U((1 << low_bits) - 1)
        self.buckets = (len(self.starts) - 1) * _EVERY  # behind the last that has elements
        # The word behind each; both parts end in a spare word.
        self.high_behind, self.low_behind = self.high[1:], self.low[1:]

    @classmethod
    def build(cls, values: np.ndarray, low_bits: int | None = None) -> EliasFano:
        values = values.astype(U)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(1, n)).bit_length() - 1) if low_bits is None else low_bits
        at = (values >> U(low_bits)).astype(np.int64) + np.arange(n)
        buckets = int(at[-1]) + 2 - n if n else 1
        high = np.zeros((n + buckets + 2 * _EVERY) // 64 + 2, U)
        np.bitwise_or.at(high, at >> 6, U(1) << (at & 63).astype(U))
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]]
        low = np.zeros(n * low_bits // 64 + 2, U)
        if low_bits:
            bit = np.arange(n, dtype=np.int64) * low_bits
            part = values & U((1 << low_bits) - 1)
            word, shift = bit >> 6, (bit & 63).astype(U)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + U(low_bits) > U(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - shift[over]))
        # Where every eighth bucket starts in the high parts, and where every eighth element stands.
        starts = np.arange(0, buckets + _EVERY, _EVERY)
        starts += np.searchsorted(at - np.arange(n), starts)
        kind = np.uint32 if len(high) < 2**26 else np.int64
        return cls({"high": high, "ones": ones.astype(kind), "low": low, "starts": starts.astype(kind), "places": at[::_EVERY].astype(kind)}, n, low_bits)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).view(U)
        return (self.low.take(word) >> shift | self.low_behind.take(word) << U(1) << (shift ^ U(63))) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), side="right") - 1
        at = (word << 6) + _select_in_word(self.high[word], i - self.ones[word].astype(np.int64))
        return ((at - i).astype(U) << U(self.low_bits)) | self._low(i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places ``i`` and at the places behind them."""
        if not len(self.places):
            return self.access(i), self.access(i + 1)
        start = self.places.take(i >> 3).astype(np.int64)
        word, shift = start >> 6, (start & 63).view(U)
        bits = self.high.take(word) >> shift | self.high_behind.take(word) << U(1) << (shift ^ U(63))
        behind = _BEHIND.take((i & (_EVERY - 1)) << 16 | (bits & U(0xFFFF)).view(np.int64))
        bits >>= behind
        first = bits & (~bits + U(1))
        bits ^= first
        start += behind
        start -= i
        second = np.bitwise_count((bits & (~bits + U(1))) - U(1))
        values = (start + np.bitwise_count(first - U(1))).view(U) << U(self.low_bits) | self._low(i)
        upper = (start + second - 1).view(U) << U(self.low_bits) | self._low(i + 1)
        if len(far := np.flatnonzero(second == 64)):  # not within these bits
            values[far], upper[far] = self.access(i[far]), self.access(i[far] + 1)
        return values, upper

    def _from(self, h: np.ndarray) -> np.ndarray:
        """Number of elements whose high part is below ``h``, by halving the words between two stored starts."""
        rank, j = np.maximum(h - 1, 0), h // _EVERY
        begin, end = (self.starts[j] >> 6).astype(np.int64), (self.starts[np.minimum(j + 1, len(self.starts) - 1)] >> 6).astype(np.int64)
        # The word of the zero of that rank: the last with no more zeros before it.
        begin = np.where(begin * 64 - self.ones[begin] > rank, begin - 1, begin)
        while (begin < end).any():
            middle = (begin + end + 1) >> 1
            before = middle * 64 - self.ones[middle] <= rank
            begin, end = np.where(before, middle, begin), np.where(before, end, middle - 1)
        at = (begin << 6) + _select_in_word(~self.high[begin], rank - (begin * 64 - self.ones[begin]))
        return np.where(h > 0, np.minimum(at - rank, self.size), 0)

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First element of each bucket, and the one behind its last."""
        start = self.starts.take(h >> 3).astype(np.int64)
        word, shift = start >> 6, (start & 63).view(U)
        # Zeros of the 64 bits from the stored start on; a bucket's ones stand between two zeros.
        zeros = ~(self.high.take(word) >> shift | self.high_behind.take(word) << U(1) << (shift ^ U(63)))
        behind = _BEHIND.take((h & (_EVERY - 1)) << 16 | (zeros & U(0xFFFF)).view(np.int64))
        if len(far := np.flatnonzero(behind == 255)):  # not within 16 bits
            bits = zeros[far]
            more = _BEHIND.take((h[far] & (_EVERY - 1)) - np.bitwise_count(bits & U(0xFFFF)) << 16 | (bits >> U(16) & U(0xFFFF)).view(np.int64))
            behind[far] = np.where(more == 255, 255, more + 16)
        zeros >>= behind
        begin = start + behind
        begin -= h
        size = np.bitwise_count((zeros & (~zeros + U(1))) - U(1))
        end = begin + size
        if len(far := np.flatnonzero(size == 64)):  # not within these bits
            begin[far], end[far] = self._from(h[far]), self._from(h[far] + 1)
        return begin, end

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether ``x`` is an element, and the place of the first such; elsewhere a place that says nothing."""
        same = np.zeros(len(x), bool)
        if not self.size:
            return np.zeros(len(x), np.int64), same
        # Behind the last bucket stands an empty one.
        h = np.minimum((x >> U(self.low_bits)).view(np.int64), self.buckets)
        at, end = self._bucket(h)
        want, open_ = x & self.mask, np.flatnonzero(at < end)
        place, end, want = at[open_], end[open_], want[open_]
        for _ in range(_STEPS):
            low = self._low(place)
            hit = np.flatnonzero(low == want)
            same[open_[hit]] = True
            at[open_[hit]] = place[hit]
            on = np.flatnonzero((low < want) & (place + 1 < end))
            if not len(on):
                return at, same
            open_, place, end, want = open_[on], place[on] + 1, end[on], want[on]
        # The rest are in large buckets, where low bits rise: halve them.
        begin, stop = place, end.copy()
        while (apart := begin < end).any():
            middle = (begin + end) >> 1
            below = np.zeros(len(middle), bool)
            below[apart] = self._low(middle[apart]) < want[apart]
            begin, end = np.where(below & apart, middle + 1, begin), np.where(below | ~apart, end, middle)
        at[open_] = begin
        inside = begin < stop
        same[open_[inside]] = self._low(begin[inside]) == want[inside]
        return at, same

    def parts(self, name: str, *without: str) -> dict:
        """Arrays for a file, ``without`` those of a use that is rarely made of the sequence: "starts" for searches, "places" for look-ups."""
        arrays = {"high": self.high, "ones": self.ones, "low": self.low, "starts": self.starts, "places": self.places, "shape": np.int64([self.size, self.low_bits])}
        return {f"{name}.{k}": v for k, v in arrays.items() if k not in without}

    @classmethod
    def of(cls, parts: dict, name: str) -> EliasFano:
        size, low_bits = (int(x) for x in parts[f"{name}.shape"])
        return cls({k: parts.get(f"{name}.{k}", np.zeros(0, np.int64)) for k in ("high", "ones", "low", "starts", "places")}, size, low_bits)


def write_parts(path: str, parts: dict[str, np.ndarray]) -> int:
    """Arrays into one file that can be mapped; the file appears whole, also when a task is run again."""
    at, index = 0, {}
    for name, array in parts.items():
        index[name] = [array.dtype.str, at, len(array)]
        at += -(-array.nbytes // 64) * 64
    head = json.dumps(index).encode()
    head += b" " * (-(len(head) + 8) % 64)
    made = f"{path}.{uuid.uuid4().hex}"
    with open(made, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for array in parts.values():
            f.write(array.tobytes() + b"\0" * (-array.nbytes % 64))
    os.replace(made, path)
    return at + len(head) + 8


def map_parts(path: str) -> dict[str, np.ndarray]:
    whole = np.asarray(np.memmap(path, np.uint8, "r"))
    size = int.from_bytes(whole[:8].tobytes(), "little")
    index = json.loads(whole[8 : 8 + size].tobytes())
    return {k: whole[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, at, n) in index.items()}


def word_level(words: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """First level: sorted word hashes and their counts."""
    return EliasFano.build(words).parts("word", "places") | {"count": counts.astype(np.int64)}


def _spread(child: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits in another order, in which small ones are spread evenly."""
    return child * U(int(0.6180339887498949 * (1 << width)) | 1) & U((1 << width) - 1)


def context_level(context: np.ndarray, child: np.ndarray, count: np.ndarray, other: int, least: int = 1, spread: bool = False) -> dict[str, np.ndarray]:
    """A level of children sorted by (context, child). ``other`` as a child means words that no child stands for.

    Children below ``least`` occurrences are left to the shorter context; their occurrences stay in ``total``.
    ``spread`` is for children that are not hashes: they are kept in another order.
    """
    starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
    total = np.add.reduceat(count, starts) if len(starts) else np.zeros(0, np.int64)
    keep = (count >= least) & (child != U(other))
    number = np.cumsum(np.r_[False, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
    kept_of = np.bincount(number[keep], weights=count[keep], minlength=len(starts)).astype(np.int64)
    children_of = np.bincount(number[keep], minlength=len(starts))
    used = children_of > 0
    pointers = np.r_[0, np.cumsum(children_of[used])]
    child, count = child[keep], count[keep]
    first, size = pointers[:-1], np.diff(pointers)
    width = int(child.max()).bit_length() if len(child) else 0
    child = child.astype(U)
    if spread:
        child = _spread(child, width)
        order = np.argsort(np.repeat(np.arange(len(first), dtype=U) << U(width), size) | child)
        child, count = child[order], count[order]
    # Spread evenly as long as the last fits into 64 bits.
    even = len(child).bit_length() + width <= 64
    relative = np.repeat((first if even else np.arange(len(first))).astype(U) << U(width), size)
    relative += child * np.repeat(size.astype(U), size) if even else child
    kept = kept_of[used]
    left = total[used] - kept
    share = count / np.repeat(kept, size) if len(first) else np.zeros(0)
    return (
        EliasFano.build(context[starts][used]).parts("context", "places")
        | EliasFano.build(pointers.astype(U)).parts("pointer", "starts")
        | EliasFano.build(relative, width if even else None).parts("child", "places")
        | EliasFano.build(np.cumsum(np.r_[0, kept])).parts("kept", "starts", "places")
        | EliasFano.build(np.cumsum(np.r_[0, left]) if left.any() else left[:0]).parts("left", "starts", "places")
        | {"code": encode(share), "child.key": np.int64([width, even, spread]), "bucket": bucket_of(kept, total[used]).astype(np.uint8)}
    )


class WordLevel:
    def __init__(self, parts: dict):
        self.words, self.count = EliasFano.of(parts, "word"), parts["count"]

    def counts(self, words: np.ndarray) -> np.ndarray:
        at, found = self.words.successor(words)
        return np.where(found, self.count[np.minimum(at, max(0, len(self.count) - 1))], 0) if len(self.count) else np.zeros(len(words), np.int64)


MISSING = {"place": -1, "share": 0.0, "kept": 0, "total": 0, "bucket": BUCKETS}


class ContextLevel:
    def __init__(self, parts: dict):
        self.contexts, self.pointers, self.children = (EliasFano.of(parts, n) for n in ("context", "pointer", "child"))
        self.kept, self.left = (EliasFano.of(parts, n) for n in ("kept", "left"))
        self.code, self.bucket = parts["code"], parts["bucket"]
        self.width, self.even, self.spread = (int(x) for x in parts["child.key"])

    def find(self, contexts: np.ndarray, number: np.ndarray, child: np.ndarray, wanted: tuple[str, ...] = tuple(MISSING)) -> dict[str, np.ndarray]:
        """Pairs of a context (``number`` in the array ``contexts``) and a child.

        For each pair what is ``wanted``: ``place`` of the child among its context's, its ``share``, and ``kept``, ``total`` and
        weight ``bucket`` of the context; values of ``MISSING`` if there is none.
        """
        at, found = self.contexts.successor(contexts)
        if not found.any():
            return {name: np.full(len(number), MISSING[name]) for name in wanted}
        at *= found
        out, here = {}, found.take(number)
        if "bucket" in wanted:
            out["bucket"] = np.where(found, self.bucket.take(at), np.uint8(MISSING["bucket"])).take(number)
        if "kept" in wanted or "total" in wanted:
            before, until = self.kept.pair(at)
            kept = (until - before).astype(np.int64) * found
            before, until = self.left.pair(at) if self.left.size else (U(0), U(0))
            left = np.asarray(until - before).astype(np.int64) * found
            out["kept"], out["total"] = kept.take(number), (kept + left).take(number)
        child, width = child.astype(U, copy=False), U(self.width)
        here &= (child >> width) == 0
        if self.spread:
            child = _spread(child, self.width)
        begin, until = self.pointers.pair(at)
        if self.even:
            key = (begin << width).take(number) + child * (until - begin).take(number)
        else:
            key = at.take(number).view(U) << width | child
        place, same = self.children.successor(key)
        same &= here
        if "share" in wanted:
            out["share"] = _DECODED.take(self.code.take(place, mode="clip")) * same
        if "place" in wanted:
            out["place"] = np.where(same, place - begin.view(np.int64).take(number), MISSING["place"])
        return {name: out[name] for name in wanted}
