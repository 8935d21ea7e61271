"""Registered queries of the text operators, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import decontaminate, html_text, language, lm_score, manifest, mixing, near_copies, nearest, prefix_trie, secrets, sharding, token_counts, toxicity
from tillwork.llm.common import table, text_remainder
from tillwork.staging import attach, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DECONTAMINATE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
size AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM size)),
lens AS (SELECT DISTINCT n FROM size),
win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, win.n, i, item FROM win JOIN pat ON win.n = pat.n AND win.p = pat.p),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN its ON d.doc_id = its.doc_id"""


@_query("op1_decontaminate", _DECONTAMINATE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c["items"]), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"),
    )


@_query("op2_lm_score")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


@_query("op3_nearest")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


@_query("op4_near_copies")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"))


@_query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.learn_text(table(spark, sf_dir, "documents"))
    return language.identify_pages(table(spark, sf_dir, "pages"), model)


def _secrets_sql() -> str:
    parts = []
    for i, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {i} AS rule, '{rule.kind}' AS kind, m, b, g, unnest(range(1, len(m) + 1)) AS i, {rule.least} AS least FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS b FROM d) WHERE len(m) > 0""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (SELECT doc_id, rule, kind, length(array_to_string(b[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS first, length(m[i]) AS n
      FROM m WHERE length(g[i]) >= least),
x AS (SELECT doc_id, rule, first, kind || ':' || first || ':' || (first + n) AS span FROM s),
a AS (SELECT doc_id, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
        string_agg(span, ',' ORDER BY first, rule) FILTER (rule <= 2) AS base, string_agg(span, ',' ORDER BY first, rule) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


@_query("op7_secrets", _secrets_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    n = lambda i: F.size(F.filter("secrets", lambda s: s["rule"] == i)).cast("long")
    base = F.filter("secrets", lambda s: s["rule"] < len(secrets.BASE))
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("secrets")).alias("spans"),
    )


def _level_sql(level: int, before: str) -> str:
    """Budget of the nodes of one level, from the ``share`` of their parents."""
    path, parents = ", ".join(mixing.LEVELS[: level + 1]), ", ".join(["0", *mixing.LEVELS[:level]])
    weights = mixing.PRODUCTION.weights
    named = " || '/' || ".join(mixing.LEVELS[: level + 1])
    cases = " ".join(f"WHEN {named} = '{k}' THEN {v}" for k, v in weights.items() if not k.startswith("*/"))
    cases += " ".join([""] + [f"WHEN {mixing.LEVELS[level]} = '{k[2:]}' THEN {v}" for k, v in weights.items() if k.startswith("*/")])
    name = mixing.LEVELS[level]
    return f"""
g{level} AS (SELECT {path}, CAST(sum(tokens) * {mixing.PRODUCTION.max_epochs} AS DOUBLE) AS cap, min(share) AS of_parent, CAST(CASE {cases} ELSE 1.0 END AS DOUBLE) AS w
  FROM {before} GROUP BY {path}),
u{level} AS (SELECT *, (of_parent - coalesce(sum(cap) OVER (PARTITION BY {parents} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER (PARTITION BY {parents}) - coalesce(sum(w) OVER (PARTITION BY {parents} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS unit FROM g{level}),
s{level} AS (SELECT {path}, greatest(0, least(cap, w * max(unit) OVER (PARTITION BY {parents}))) AS node_share FROM u{level}),
n{level} AS (SELECT {", ".join(f"l.{c}" for c in mixing.LEVELS)}, tokens, node_share AS share FROM {before} l JOIN s{level} USING ({path}))"""


_MIX_SQL = rf"""
WITH t AS (SELECT doc_id, list_extract([{", ".join(f"'{d}'" for d in mixing.DOMAINS)}], 1 + CAST('0x' || substr(md5(coalesce(source, '')), 1, 1) AS INT) % {len(mixing.DOMAINS)}) AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
l0 AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM t GROUP BY ALL),
l AS (SELECT *, CAST(floor((sum(tokens) OVER ()) * CAST({mixing.PRODUCTION.budget_share} AS DOUBLE)) AS DOUBLE) AS share FROM l0),
{",".join(_level_sql(i, "l" if i == 0 else f"n{i - 1}") for i in range(len(mixing.LEVELS)))},
p AS (SELECT domain, lang, source, budget // greatest(tokens, 1) AS epochs_full, budget % greatest(tokens, 1) AS rest FROM (
    SELECT domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(floor(share + 1e-6) AS BIGINT) AS budget FROM n{len(mixing.LEVELS) - 1})),
o AS (SELECT t.*, epochs_full, rest, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{mixing.PRODUCTION.seed}:' || epochs_full || ':' || doc_id), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM t JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens AS n_tokens, CAST(epochs_full + CAST(before < rest AS INT) AS INT) AS epochs,
       CAST(epochs_full * tokens + greatest(0, least(tokens, rest - before)) AS BIGINT) AS tokens_used
FROM o WHERE epochs_full + CAST(before < rest AS INT) > 0"""


@_query("op8_mix", _MIX_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_tokens(table(spark, sf_dir, "documents"))


@_query("op9_shard")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])


@_query("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


LIMIT_TOKENS = 2048


@_query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), definition, keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT_TOKENS)


# Unsigned CRC-32 of a decimal text, by the usual table of 256 entries worked out from the polynomial.
_CRC = """list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""


def _crc32_sql(text: str) -> str:
    digits = f"list_transform(string_split({text}, ''), lambda d: CAST(ascii(d) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {digits}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c // 256)), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    values = [n_chars if c == "n_chars" else c for c in manifest.COLUMNS]
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || {v}, '-')" for v in values) + ")"


def _tree_sql(name: str, leaves: str, group: str, order: str) -> str:
    """Nodes of one tree per group: (g, lvl, i, h, c: nodes on that level)."""
    return f"""{name} AS (SELECT {group} AS g, 0 AS lvl, row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1 AS i, h, count(*) OVER (PARTITION BY {group}) AS c FROM {leaves}
  UNION ALL SELECT g, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(c) + 1) // 2 FROM {name} WHERE c > 1 GROUP BY g, lvl, i // 2)"""


def _fold_sql(name: str, tree: str, start: str) -> str:
    """Folds of the nodes of ``start`` (id, g, i, h) up a tree, with the siblings met: (id, g, i, lvl, h, sib)."""
    return f"""{name} AS (SELECT id, g, i, 0 AS lvl, h, '' AS sib FROM {start}
  UNION ALL SELECT f.id, f.g, f.i // 2, f.lvl + 1, sha256(CASE WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.sib || coalesce(s.h, '')
  FROM {name} f JOIN {tree} o ON o.g IS NOT DISTINCT FROM f.g AND o.lvl = f.lvl AND o.i = f.i AND o.c > 1
  LEFT JOIN {tree} s ON s.g IS NOT DISTINCT FROM f.g AND s.lvl = f.lvl AND s.i = f.i + 1 - 2 * (f.i % 2))"""


_MANIFEST_SQL = f"""
WITH RECURSIVE crc AS (SELECT {_CRC} AS t),
d AS (SELECT row_number() OVER () AS id, doc_id, lang, {_leaf_sql("n_chars")} AS h,
        CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(CAST(n_chars AS HUGEINT) + 1)")} ELSE {_leaf_sql("n_chars")} END AS seen FROM documents, crc),
{_tree_sql("n", "d", "lang", "doc_id NULLS FIRST, h, id")},
place AS (SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h, id) - 1 AS i FROM d),
subs AS (SELECT g AS lang, h FROM n WHERE c = 1),
{_tree_sql("u", "subs", "0", "lang NULLS FIRST")},
top AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM subs),
seen0 AS (SELECT d.id, d.lang AS g, i, seen AS h FROM d JOIN place ON place.id = d.id),
{_fold_sql("f", "n", "seen0")},
sub1 AS (SELECT f.id, f.g, f.h, f.sib FROM (SELECT id, max(lvl) AS lvl FROM f GROUP BY id) m JOIN f ON f.id = m.id AND f.lvl = m.lvl),
seen1 AS (SELECT sub1.id, 0 AS g, top.i, sub1.h FROM sub1 JOIN top ON top.lang IS NOT DISTINCT FROM sub1.g),
{_fold_sql("v", "u", "seen1")},
top1 AS (SELECT v.id, v.h, v.sib FROM (SELECT id, max(lvl) AS lvl FROM v GROUP BY id) m JOIN v ON v.id = m.id AND v.lvl = m.lvl)
SELECT d.doc_id, d.h AS leaf, subs.h AS subroot, (SELECT h FROM u WHERE c = 1) AS root, sha256(sub1.sib || top1.sib) AS proof_sha256,
       top1.h AS folded_root, top1.h = (SELECT h FROM u WHERE c = 1) AS verified
FROM d JOIN sub1 ON sub1.id = d.id JOIN top1 ON top1.id = d.id JOIN subs ON subs.lang IS NOT DISTINCT FROM d.lang"""


@_query("op12_manifest", _MANIFEST_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = text_remainder(F.col("doc_id"), 7) == 0
    found = manifest.merkle_manifest(table(spark, sf_dir, "documents"), tampered=tampered)
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    folded = found.withColumn("folded_root", manifest.fold_proof(F.col("seen_leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_TRIE_SQL = f"""
WITH crc AS (SELECT {_CRC} AS t),
o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o), crc),
parts AS (SELECT c.conv_id, 0 AS part, i, r, x FROM c JOIN o ON o.conv_id = base WHERE i <= h
  UNION ALL SELECT c.conv_id, 1, i, r, x FROM c JOIN o ON o.conv_id = c.conv_id WHERE i > h),
l AS (SELECT c.conv_id, coalesce(list(strlen(r) || ':' || r || x ORDER BY part, i) FILTER (r IS NOT NULL), []) AS path,
        coalesce(list(length(x) ORDER BY part, i) FILTER (r IS NOT NULL), []) AS lens FROM c LEFT JOIN parts ON parts.conv_id = c.conv_id GROUP BY c.conv_id),
pre AS (SELECT conv_id, len(path) AS size, d, path[1:d] AS k, coalesce(lens[d], 0) AS n FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM l)),
node AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, max(size) > d AS has_children,
        string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d) AS ends FROM pre GROUP BY d, k),
below AS (SELECT a AS d, k[1:a] AS k, count(*) FILTER (NOT has_children) AS n_leaves, count(*) FILTER (d = a + 1) AS n_children, sum((n_convs - 1) * n) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM node) GROUP BY a, k[1:a])
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN below ON below.d = node.d AND below.k = node.k LEFT JOIN node up ON up.d = node.d - 1 AND up.k = node.k[1:node.d - 1]"""


@_query("op13_prefix_trie", _TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stage(prefix_trie.turn_paths(table(spark, sf_dir, "conversations")), "places")
    trie = prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns))
    nodes = trie.nodes.withColumnRenamed("saved", "saved_tokens")
    values = [c for c in nodes.columns if c != "ends"]
    whole = nodes.filter("ends is not null").select(*values, F.sha2(prefix_trie.ends_text("ends"), 256).alias("ends_sha256"))
    cut = attach(nodes.filter("ends is null").select(*values), prefix_trie.joined_digest(trie.pieces), ["conv_id", "depth"], "left")
    return whole.unionByName(cut.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))
