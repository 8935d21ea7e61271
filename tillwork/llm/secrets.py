"""Secret scan with a trigram inverted index, all in built-in functions.

Every rule is a regular expression. ``trigram_query`` derives from it the trigrams that any match must
hold, as alternatives of sets (Python's own expression parser reads the rule). The index maps each
trigram that some rule asks for to the documents holding it, without regard to case; a document is a
candidate of a rule if the postings of all trigrams of one alternative meet in it. Only candidates
are verified with the expression. Rules without mandatory trigrams (runs of hex digits) read every text.

Positions come from the expression too: the lengths of the matches and of the pieces between them
alternate, so their running sum gives each start, in code points.

NULL texts are empty. Rows that share an id are candidates together and verified apart. The index is a
table of (trigram, document) rows; it is grouped by document, never by trigram, so that no posting
list is held by a task. Candidates travel to the texts by a join whose size is measured first.
"""

from __future__ import annotations

import re._constants as code
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import free_name
from tillwork.staging import attach


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates; a match counts if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A match of 20 and more, or 24 and more, is the same as a longest run that is checked for its length.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
]
RULES = [*BASE, *MORE]
_MOST = 32  # strings followed at once; beyond that a part of the expression counts as unknown


def _texts(item: tuple) -> set[str] | None:
    """All texts an element can stand for, if they are few; None if unknown."""
    op, arg = item
    if op is code.LITERAL:
        return {chr(arg).lower()}
    if op is code.IN and all(k is code.LITERAL for k, _ in arg) and len(arg) <= _MOST:
        return {chr(v).lower() for _, v in arg}
    if op is code.SUBPATTERN:
        return _joined(list(arg[3]))
    if op is code.BRANCH:
        parts = [_joined(list(p)) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is code.MAX_REPEAT and arg[1] <= 2:
        once = _joined(list(arg[2]))
        return None if once is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(once, repeat=n)}
    return None


def _joined(items: list) -> set[str] | None:
    """All texts of a sequence, if they are few and known."""
    texts = {""}
    for item in items:
        more = _texts(item)
        if more is None or len(texts) * len(more) > _MOST:
            return None
        texts = {a + b for a in texts for b in more}
    return texts


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigram sets, one of which every match holds whole; empty if nothing is mandatory."""
    known: list[set[str]] = [{""}]
    for item in parser.parse(pattern):
        texts = _texts(item)
        if texts is None or len(known[-1]) * len(texts) > _MOST:
            known.append({""})
            texts = texts if texts is not None else {""}
        known[-1] = {a + b for a in known[-1] for b in texts}
    grams = lambda s: frozenset(s[i : i + 3] for i in range(len(s) - 2))
    # A part helps if each of its texts has a trigram; all such parts are mandatory together.
    parts = [{grams(s) for s in texts} for texts in known if min(map(len, texts)) >= 3]
    if not parts:
        return []
    return sorted({frozenset().union(*p) for p in product(*parts)}, key=sorted)


def _folded(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trigram_index(docs: DataFrame, grams: list[str], key: str, text: str) -> DataFrame:
    """Postings: a row of ``gram`` (its place in ``grams``) and ``doc`` for each listed trigram that a text holds."""
    held = docs.select(F.col(key).alias("doc"), _folded(F.col(text)).alias("folded"))
    present = [F.when(F.contains("folded", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]
    return held.select("doc", F.explode(F.array_compact(F.array(*present))).alias("gram"))


def candidates(postings: DataFrame, queries: dict[int, list[frozenset[str]]], grams: list[str]) -> DataFrame:
    """``doc`` and ``rules``, a bit for each rule (by number) of which one alternative has all its postings there."""
    place = {g: i for i, g in enumerate(grams)}
    meets: dict[int, Column] = {}
    for rule, alternatives in queries.items():
        needs = [reduce(lambda a, b: a & b, [F.coalesce(F.bool_or(F.col("gram") == place[g]), F.lit(False)) for g in sorted(a)]) for a in alternatives]
        meets[rule] = reduce(lambda a, b: a | b, needs)
    bits = [F.when(met, F.lit(1 << rule)).otherwise(F.lit(0)) for rule, met in meets.items()]
    found = postings.groupBy("doc").agg(reduce(lambda a, b: a + b, bits).alias("rules"))
    return found.filter("rules > 0")


def _matches(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number of the rule, end) of a rule's matches."""
    pattern = F.lit(rule.pattern)
    whole, checked = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(whole.alias("m"), checked.alias("g"), F.slice(between, 1, F.size(whole)).alias("b"))
    empty = F.array().cast("array<struct<start:int,rule:int,end:int>>")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("rule"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add)
    return F.when(F.regexp(text, pattern), walked["spans"]).otherwise(empty)


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES, key: str = "doc_id", text: str = "text", result: str = "secrets") -> DataFrame:
    """The documents with ``result``: an array of (start, rule, end) in order of start, then rule number."""
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    asked = {i: q for i, q in queries.items() if q}
    grams = sorted(set().union(*[g for q in asked.values() for g in q]))
    doc, mask, body = free_name(docs, "_doc"), free_name(docs, "_rules"), free_name(docs, "_body")
    found = candidates(trigram_index(docs, grams, key, text), asked, grams)
    # Join on the text of the id, so that NULL ids meet as well.
    named = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    found = found.select(F.coalesce(F.col("doc").cast("string"), F.lit("null")).alias(doc), F.col("rules").alias(mask))
    marked = attach(docs.withColumn(doc, named), found, [doc], "left").withColumn(body, F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    spans = [
        F.when(F.col(mask).bitwiseAND(1 << i) > 0, _matches(F.col(body), r, i)).otherwise(none) if i in asked else _matches(F.col(body), r, i)
        for i, r in enumerate(rules)
    ]
    return marked.withColumn(result, F.array_sort(F.concat(*spans))).drop(doc, mask, body)


def span_text(spans: Column, rules: list[Rule] = RULES) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))))
