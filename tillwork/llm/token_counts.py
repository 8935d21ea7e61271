"""Token counts by a tokenizer compiled to deterministic transducers.

Two transducers in a row give the counts that the tokenizer's library gives, without calling its model:

* The *scanner* cuts normalised text into pieces (contractions, runs of letters, single digits, runs of
  other signs). It is a table of ``SCANNER_STATES`` x ``CLASSES``; a transition is annotated with the
  pieces it begins. A block of text is cut into equal chunks, every chunk is run for every entry state
  at once (its *state map*), the maps are composed by a parallel prefix scan, and each chunk is then
  run from the state in which the scan says it is entered.
* The *piece transducer* reads the bytes of a piece, the last one as a symbol of its own (word end). Its
  transitions are annotated with the change in the number of tokens of what has been read. It is
  determinised on demand: a state holds, for each place at which a token that is still possible could
  begin, the last token before it and the count there. That is enough because a sequence of tokens is
  the byte pair encoding of its text exactly if every two neighbours are the encoding of theirs.

Results in special cases: NULL and empty texts have no bytes and no tokens. Strings of special tokens
inside a text count as one token each, as the library takes them by default. Very long texts are read
in blocks; what a block leaves unfinished is read again with the next one. Rows are never compared, so
ties and repeated rows need no rule. An empty table gives an empty result with the same columns. New
columns get the names asked for, lengthened by ``_`` where the input has them already.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillwork.llm.common import free_name, map_columns

SPACE, DIGIT, APOSTROPHE, SIGN, LETTER, ENDING, LETTER_R, LETTER_V, LETTER_L, LETTER_E = range(10)
CLASSES = 10
UNKNOWN = 255
# Between pieces, in letters, in signs, after an apostrophe that begins a piece, after that and r, v or l.
BETWEEN, LETTERS, SIGNS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
SCANNER_STATES = 7
# What a transition is annotated with: a piece begins at this character, or one did at the one before.
BEGINS, BEGAN_BEFORE = 1, 2

CHUNK = 512
BLOCK = 1 << 21
MOST_STATES = 300_000
MOST_PIECES = 500_000
LONGEST_KEPT = 64
END = "</w>"
# The layouts that the scanner is written for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]


# Signs and letters that contractions are made of.
NAMED = {ord("'"): APOSTROPHE, **{ord(c): ENDING for c in "stmd"}, ord("r"): LETTER_R, ord("v"): LETTER_V, ord("l"): LETTER_L, ord("e"): LETTER_E}


def _scanner() -> tuple[np.ndarray, np.ndarray]:
    """(next state, annotation) of every state and class, both flat."""
    to = np.zeros((SCANNER_STATES, CLASSES), np.uint8)
    out = np.zeros((SCANNER_STATES, CLASSES), np.uint8)
    letters = [LETTER, ENDING, LETTER_R, LETTER_V, LETTER_L, LETTER_E]
    for state in range(SCANNER_STATES):
        to[state, SPACE] = BETWEEN
        to[state, DIGIT], out[state, DIGIT] = BETWEEN, BEGINS
        for sign, new in ((APOSTROPHE, QUOTE), (SIGN, SIGNS)):
            goes_on = state in (SIGNS, QUOTE)
            to[state, sign], out[state, sign] = (SIGNS, 0) if goes_on else (new, BEGINS)
        for c in letters:
            to[state, c], out[state, c] = LETTERS, 0 if state in (LETTERS, QUOTE_R, QUOTE_V, QUOTE_L) else BEGINS
    for c, new in ((ENDING, BETWEEN), (LETTER_R, QUOTE_R), (LETTER_V, QUOTE_V), (LETTER_L, QUOTE_L)):
        to[QUOTE, c], out[QUOTE, c] = new, 0
    # What follows r, v or l shows whether they belong to the apostrophe or began a run of letters.
    for state, last in ((QUOTE_R, LETTER_E), (QUOTE_V, LETTER_E), (QUOTE_L, LETTER_L)):
        out[state] |= BEGAN_BEFORE
        to[state, last], out[state, last] = BETWEEN, 0
    return to.ravel(), out.ravel()


NEXT, NOTES = _scanner()


def state_maps(chunks: np.ndarray) -> np.ndarray:
    """For each column of ``chunks`` (a chunk's classes, downwards) the state it ends in by entry state."""
    state = np.repeat(np.arange(SCANNER_STATES, dtype=np.intp)[:, None], chunks.shape[1], axis=1)
    for classes in chunks:
        state = NEXT[state * CLASSES + classes].astype(np.intp)
    return state


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Compositions of the first 1, 2, ... maps, by doubling."""
    maps, step = maps.copy(), 1
    while step < maps.shape[1]:
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step], axis=0)
        step *= 2
    return maps


def scan(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The state before each character of a block that begins between pieces."""
    n = len(classes)
    lanes = max(1, -(-n // chunk))
    padded = np.full(lanes * chunk, SPACE, np.uint8)
    padded[:n] = classes
    chunks = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
    state = np.full(lanes, BETWEEN, np.intp)
    if lanes > 1:
        state[1:] = prefix_scan(state_maps(chunks))[BETWEEN, :-1]
    before = np.empty(chunks.shape, np.uint8)
    for row, now in zip(before, chunks, strict=True):
        row[:] = state
        state = NEXT[state * CLASSES + now].astype(np.intp)
    return before.T.reshape(-1)[:n]


def pieces(classes: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of every piece of a block whose last character is white space."""
    notes = NOTES[scan(classes, chunk).astype(np.intp) * CLASSES + classes]
    begins = (notes & BEGINS) > 0
    begins[:-1] |= (notes[1:] & BEGAN_BEFORE) > 0
    first = np.flatnonzero(begins)
    breaks = np.flatnonzero(begins | (classes == SPACE))
    return first, breaks[np.searchsorted(breaks, first, side="right")]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    own = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    others = iter(range(256, 512))
    return [chr(b if own[b] else next(others)) for b in range(256)]


class _State:
    __slots__ = ("after", "last", "open", "starts")

    def __init__(self, open_: str, starts: tuple):
        # Text that may still become a token, and for each place in it the (token before, tokens less than now).
        self.open, self.starts = open_, starts
        self.after: dict[str, tuple[_State, int]] = {}
        self.last: dict[str, int] = {}


class PieceTransducer:
    """Counts tokens of one piece; states and transitions are made when first needed, and dropped together
    when there are ``most_states`` of them."""

    def __init__(self, merges: list[tuple[str, str]], most_states: int = MOST_STATES):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.made_of = {a + b: (a, b) for a, b in merges}
        self.tokens = self.made_of.keys()
        self.edges: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.prefixes = {t[:i] for t in (t.removesuffix(END) for t in self.tokens) for i in range(1, len(t) + 1)}
        self.letters = dict(enumerate(byte_letters()))
        self.agree: dict[tuple[str | None, str], bool] = {}
        self.most_states = most_states
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.agree.clear()
        self.start = self._state("", ((None, 0),))

    def _state(self, open_: str, starts: tuple) -> _State:
        found = self.states.get((open_, starts))
        if found is None:
            found = self.states[open_, starts] = _State(open_, starts)
        return found

    def merged(self, symbols: list[str]) -> list[str]:
        """Byte pair encoding by its definition: always the pair that was learnt first, leftmost first."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(symbols, symbols[1:], strict=False)]
            best = min(ranks)
            if best == len(self.rank):
                break
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at one end of a token while it is put together, with the merge that takes it in."""
        found, taken = [], len(self.rank)
        while True:
            found.append((token, taken))
            pair = self.made_of.get(token)
            if pair is None:
                return found
            token, taken = pair[side], self.rank[pair]

    def _fits(self, before: str | None, token: str) -> bool:
        """Whether the two stay as they are when their text is encoded; None stands for the beginning.

        Both are put together apart from each other until a merge across the border is due: one whose two
        parts stand there and which was learnt before the merges that take them in.
        """
        key = (before, token)
        fits = self.agree.get(key)
        if fits is None:
            if before is None:
                body = token.removesuffix(END)
                fits = self.merged([*body[:-1], body[-1] + token[len(body) :]]) == [token]
            else:
                left, right = self.edges.get((before, 1)), self.edges.get((token, 0))
                if left is None:
                    left = self.edges[before, 1] = self._edge(before, 1)
                if right is None:
                    right = self.edges[token, 0] = self._edge(token, 0)
                fits, rank, never = True, self.rank.get, len(self.rank)
                for x, x_taken in left:
                    for y, y_taken in right:
                        across = rank((x, y), never)
                        if across < x_taken and across <= y_taken:
                            fits = False
            self.agree[key] = fits
        return fits

    def _choose(self, state: _State, letter: str, end: str) -> tuple[str, int]:
        """The last token once ``letter`` is read, and the change in the number of tokens."""
        for at, (before, less) in enumerate(state.starts):
            token = state.open[at:] + letter + end
            last_place = at == len(state.open)
            if (last_place or token in self.tokens) and self._fits(before, token):
                return token, less + 1
        raise ValueError(f"no token ends with {letter!r}")

    def _follow(self, state: _State, letter: str) -> tuple[_State, int]:
        token, change = self._choose(state, letter, "")
        text = state.open + letter
        starts = (*((before, less - change) for before, less in state.starts), (token, 0))
        at = 0
        while at < len(text) and text[at:] not in self.prefixes:
            at += 1
        if len(self.states) >= self.most_states:
            self.clear()
        made = state.after[letter] = (self._state(text[at:], starts[at:]), change)
        return made

    def count(self, piece: str) -> int:
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        state, total = self.start, 0
        for letter in text[:-1]:
            state, change = state.after.get(letter) or self._follow(state, letter)
            total += change
        change = state.last.get(text[-1])
        if change is None:
            change = state.last[text[-1]] = self._choose(state, text[-1], END)[1]
        return total + change


@dataclass(frozen=True)
class Compiled:
    """What tasks need of a tokenizer; about 5 MB, whatever the data.

    ``classes`` by code point of normalised text, ``UNKNOWN`` for code points that Python's tables do not
    have; ``odd`` marks those, and code points that Python normalises in another way than the library,
    whose normaliser is then used for the whole text.
    """

    merges: list[tuple[str, str]]
    special: list[str]
    classes: bytes
    odd: bytes
    definition: str


def _fold(text: str) -> str:
    """Canonical composition, then each character in lower case by itself (a final sigma is no exception)."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def classes_of(points: list[int]) -> list[int]:
    """Scanner classes of code points, read off the library's own cutting rule."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    # "a", the character twice, a space: one piece of three is a letter, of one is white space, three pieces a digit.
    sizes: list[list[int]] = [[] for _ in points]
    cutter = Split(Regex(PATTERN), "removed", invert=True)
    for _, (first, end) in cutter.pre_tokenize_str("".join(f"a{chr(p)}{chr(p)} " for p in points)):
        sizes[first // 4].append(end - first)
    kinds = [DIGIT if len(s) > 2 else SIGN if len(s) == 2 else LETTER if s == [3] else SPACE for s in sizes]
    return [NAMED.get(p, kind) for p, kind in zip(points, kinds, strict=True)]


@lru_cache(maxsize=4)
def compile_tokenizer(definition: str) -> Compiled:
    """Compile the text of a tokenizer file; character classes are read off the library's own cutting rule.

    Raises ValueError for a file of another layout than byte pairs with word ends.
    """
    from tokenizers import Tokenizer

    spec = json.loads(definition)
    model, rule = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
    steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
    fits = model["type"] == "BPE" and model["end_of_word_suffix"] == END and rule["pattern"]["Regex"] == PATTERN and steps == NORMALIZERS
    if not fits or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("not a tokenizer of byte pairs with word ends")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = {a + b: i for i, (a, b) in enumerate(pairs)}
    if len(made) != len(pairs) or any(made.get(part, -1) > i for i, pair in enumerate(pairs) for part in pair):
        raise ValueError("each token needs one merge, of parts learnt before it")

    own = Tokenizer.from_str(definition).normalizer
    classes, odd = np.full(0x110000, UNKNOWN, np.uint8), np.ones(0x110000, bool)
    assigned = [p for p in range(0x110000) if unicodedata.category(chr(p)) not in ("Cn", "Cs", "Co")]
    for low in range(0, len(assigned), 0x4000):
        points = assigned[low : low + 0x4000]
        classes[points] = classes_of(points)
        # Signs that only separate; nothing composes with them.
        theirs = own.normalize_str("|".join(map(chr, points))).split("|")
        ours = _fold("|".join(map(chr, points))).split("|")
        if len(theirs) != len(ours):
            raise ValueError("the normaliser changes separators")
        at = [p for p in points for _ in range(1 + (p == ord("|")))]
        odd[at] = [a != b and classes[p] != SPACE for p, a, b in zip(at, theirs, ours, strict=True)]
    special = [t["content"] for t in spec["added_tokens"]]
    return Compiled(pairs, special, classes.tobytes(), odd.tobytes(), definition)


class Counter:
    """Counts the tokens of texts in one task."""

    def __init__(self, compiled: Compiled, block: int = BLOCK, chunk: int = CHUNK, most_states: int = MOST_STATES):
        self.classes = np.frombuffer(compiled.classes, np.uint8).copy()
        self.odd = np.frombuffer(compiled.odd, bool)
        self.transducer = PieceTransducer(compiled.merges, most_states)
        longest_first = sorted(compiled.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.definition, self.own = compiled.definition, None
        self.block, self.chunk = block, chunk
        self.known: dict[str, int] = {}

    def _normal(self, text: str) -> str:
        if not text.isascii() and self.odd[_points(text)].any():
            if self.own is None:
                from tokenizers import Tokenizer

                self.own = Tokenizer.from_str(self.definition).normalizer
            return self.own.normalize_str(text)
        return _fold(text)

    def _count(self, piece: str) -> int:
        n = self.transducer.count(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self.known) >= MOST_PIECES:
                self.known.clear()
            self.known[piece] = n
        return n

    def _block(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(end, tokens) of every piece of a text that ends with white space."""
        points = _points(text)
        classes = self.classes[points]
        if not text.isascii() and (new := np.unique(points[classes == UNKNOWN])).size:
            self.classes[new] = classes_of(new.tolist())
            classes = self.classes[points]
        first, end = pieces(classes, self.chunk)
        words = [text[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
        known = self.known.get
        counts = list(map(known, words))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    counts[i] = self.known.get(words[i]) or self._count(words[i])
        return end, np.array(counts, np.int64)

    def long_text(self, text: str) -> int:
        """Tokens of one normalised text, block by block; the last piece of a block waits for the next one."""
        total, rest = 0, ""
        for at in range(0, len(text), self.block):
            part, final = rest + text[at : at + self.block], at + self.block >= len(text)
            end, counts = self._block(part + " ")
            total += int(counts.sum())
            rest = ""
            if not final and len(end) and end[-1] == len(part):
                # The last pieces may go on: a run may grow, and what follows may join them to an apostrophe.
                keep = np.searchsorted(end, len(part) - 3, side="right")
                total -= int(counts[keep:].sum())
                rest = part[end[keep - 1] if keep else 0 :]
        return total

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; short texts are read together."""
        found, parts, owners = [0] * len(texts), [], []
        size = 0

        def read() -> None:
            nonlocal size
            if parts:
                end, counts = self._block(" ".join(parts) + " ")
                stops = np.cumsum([len(p) + 1 for p in parts])
                sums = np.concatenate([[0], np.cumsum(counts)])
                upto = sums[np.searchsorted(end, stops, side="left")]
                for owner, n in zip(owners, np.diff(upto, prepend=0).tolist(), strict=True):
                    found[owner] += n
            parts.clear()
            owners.clear()
            size = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            segments = [text]
            if self.special is not None and "<" in text:
                segments = self.special.split(text)
                found[i] += len(segments) - 1
            for segment in segments:
                normal = self._normal(segment)
                if len(normal) > self.block:
                    found[i] += self.long_text(normal)
                elif normal:
                    parts.append(normal)
                    owners.append(i)
                    size += len(normal)
                    if size > self.block:
                        read()
        read()
        return found


_kept: dict[str, Counter] = {}


def _counter(compiled: Compiled) -> Counter:
    """The counter of a Python worker, kept for its next tasks with the states it has made."""
    if compiled.definition not in _kept:
        _kept.clear()
        _kept[compiled.definition] = Counter(compiled)
    return _kept[compiled.definition]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def count_tokens(docs: DataFrame, definition: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds ``n_bytes`` (UTF-8) and ``n_tokens`` to the rows; ``definition`` is the text of a tokenizer file.

    One pass over the texts, without a shuffle; the compiled tokenizer is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compile_tokenizer(definition))
    names = []
    for wanted in ("n_bytes", "n_tokens"):
        names.append(free_name(docs.select(*(docs.columns if keep is None else keep)), wanted))

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        counter = _counter(shared.value)
        for (texts,) in batches:
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield [sizes, counter.counts(texts)]

    return map_columns(docs, [text], [(n, T.LongType()) for n in names], work, keep)
