"""Mixing, sharding and the pipeline: against plain versions, and odd inputs."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tillwork.llm import decontaminate, language, mixing, near_copies, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


# Mixing

def plain_share(children, budget):
    """Shares by weight; who cannot take all leaves the rest to the others."""
    shares, open_ = {}, dict(children)
    while open_:
        unit = budget / sum(w for w, _ in open_.values())
        short = {n: cap for n, (w, cap) in open_.items() if cap <= w * unit}
        if not short:
            shares |= {n: w * unit for n, (w, _) in open_.items()}
            break
        for n, cap in short.items():
            shares[n] = cap
            budget -= cap
            del open_[n]
        budget = max(0.0, budget)
    return shares


def weight_of(mix, path):
    return mix.weights.get("/".join(path), mix.weights.get(f"*/{path[-1]}", 1.0))


def plain_mix(rows, mix):
    """``rows``: (id, text, lang, source). Epochs and tokens used by id."""
    leaf = lambda r: (mixing.DOMAINS[int(md5(r[3] or "")[0], 16) % len(mixing.DOMAINS)], r[2] or "", r[3] or "")
    tokens = lambda r: len((r[1] or "").encode().split())
    members = defaultdict(list)
    for r in rows:
        members[leaf(r)].append(r)
    supply = {k: sum(map(tokens, v)) for k, v in members.items()}
    budgets = {(): float(int(sum(supply.values()) * mix.budget_share + 1e-9))}
    for level in range(3):
        for parent in [p for p in budgets if len(p) == level]:
            paths = {k[: level + 1] for k in supply if k[:level] == parent}
            children = {p: (weight_of(mix, p), float(mix.max_epochs * sum(n for k, n in supply.items() if k[: level + 1] == p))) for p in paths}
            budgets |= plain_share({p: c for p, c in children.items() if c[0] > 0}, budgets[parent])
    out = {}
    for k, docs in members.items():
        budget = int(budgets.get(k, 0) + 1e-6)
        full, rest = divmod(budget, max(1, supply[k]))
        before = 0
        for r in sorted(docs, key=lambda r: (md5(f"{mix.seed}:{full}:{r[0]}"), r[0])):
            epochs = full + (before < rest)
            if epochs:
                out[r[0]] = (epochs, full * tokens(r) + max(0, min(tokens(r), rest - before)))
            before += tokens(r)
    return out


@pytest.mark.parametrize("mix", [
    mixing.PRODUCTION, mixing.Mix(), mixing.Mix({"web": 0.0, "books": 5.0, "*/en": 3.0}, 0.3, 1, 3), mixing.Mix({"web/en/src0": 9.0}, 2.5, 3, 1), mixing.Mix(budget_share=0.0),
])
def test_mix_against_plain_version(spark, mix):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    rows += [(10_001, None, None, None), (10_002, "", "en", "src0"), (10_003, "one two " * 20_000, "en", "big"), (10_004, " \t a\x0bb\n", None, "x")]
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS).withColumn("tokens", F.lit(5)).withColumn("key", F.lit("x"))
    found = {r.doc_id: (r.epochs, r.tokens_used) for r in mixing.mix_tokens(df, mix).collect()}
    assert found == plain_mix(rows, mix)


def test_shortage_goes_to_siblings_before_others(spark):
    supply = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("b", "x", "3", 1000)], "domain string, lang string, source string, tokens long")
    found = {r.source: r.budget for r in mixing.budgets(supply, mixing.Mix(budget_share=0.5, max_epochs=1)).collect()}
    assert found == {"1": 10, "2": 492, "3": 502}


def test_mix_of_odd_tables(spark):
    same = [(1, "a b c", "en", "s", 0)] * 4 + [(None, "a b", None, None, 0)] * 2
    df = spark.createDataFrame(same, DOCS)
    found = mixing.mix_tokens(df, mixing.Mix(budget_share=1.0, max_epochs=1))
    assert found.agg(F.sum("tokens_used")).first()[0] == 16
    assert mixing.mix_tokens(df.limit(0)).count() == 0
    kept = mixing.keep_mixed(df.withColumn("_chosen", F.lit(1)), mixing.Mix(budget_share=1.0, max_epochs=1))
    assert kept.columns[-1] == "_chosen" and kept.filter("doc_id = 1").count() == 4


def test_mix_keeps_chosen_rows_without_an_id(spark):
    rows = [(1, "a b c", "en", "s", 0), (None, "a b", None, None, 0), (None, None, None, None, 0), (2, "d e", "en", "s", 0), (2, "f g", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    whole = mixing.Mix(budget_share=1.0, max_epochs=1)
    kept = mixing.keep_mixed(df, whole).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept if r.text) == [(0, "a b"), (1, "a b c"), (2, "d e"), (2, "f g")]
    half = mixing.Mix(budget_share=0.5, max_epochs=1)
    many = spark.createDataFrame([(None, f"word{i} b", "en", "s", 0) for i in range(40)] + [(7, f"c{i} d", "en", "s", 0) for i in range(40)], DOCS)
    assert mixing.keep_mixed(many, half).count() == mixing.mix_tokens(many, half).count() == 40


# Sharding

def plain_shards(rows, shards, nodes):
    """Documents in ring order take the next virtual node with room, homes first."""
    ring = sharding.node_cells(shards, nodes)
    cell = lambda r: int(md5("" if r[0] is None else str(r[0]))[:12], 16) % sharding.CELLS
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    home = {c: next((i for i, (at, _) in enumerate(ring) if at >= c), 0) for c in map(cell, rows)}
    placed, waiting = Counter(), []
    for r in sorted(rows, key=cell):
        s = ring[home[cell(r)]][1]
        if room[s]:
            room[s] -= 1
            placed[cell(r), s] += 1
        else:
            waiting.append(r)
    for r in waiting:
        at = home[cell(r)]
        while not room[ring[at % len(ring)][1]]:
            at += 1
        s = ring[at % len(ring)][1]
        room[s] -= 1
        placed[cell(r), s] += 1
    return placed


@pytest.mark.parametrize(("n", "shards"), [(0, 16), (1, 16), (17, 16), (3000, 16), (3000, 7)])
def test_shards_against_plain_version(spark, n, shards):
    rows = [(i, f"text {i % 50}", "en", "s", 0) for i in range(n)]
    df = spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit("clash")).withColumn("_cell", F.lit(1))
    found = sharding.shard_documents(df, shards=shards).withColumn("cell", sharding.cell_of(F.col("doc_id"))).collect()
    assert len(found) == n
    counts = Counter(r.shard for r in found)
    assert not n or max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(counts[s]))
    assert Counter((r.cell, r.shard) for r in found) == plain_shards(rows, shards, sharding.NODES)


def test_shards_of_odd_rows(spark):
    rows = [(None, None, None, None, 0), (None, "é", None, None, 0), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x" * 100_000, "en", "s", 0)]
    found = sharding.shard_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["size"] for r in found) == [1, 1, 1, 3, 100_001]
    assert {r.text_crc32 for r in found if r.text in (None, "")} == {0}


def test_few_documents_move_to_another_shard(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    one, two = (sharding.shard_documents(df, shards=n).select("doc_id", "shard").collect() for n in (16, 17))
    before = {r.doc_id: r.shard for r in one}
    moved = sum(before[r.doc_id] != r.shard for r in two)
    assert moved < 0.5 * 20_000  # by remainder of a hash, 94 % would move


# Pipeline

def test_pipeline_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = corpus_pipeline.run(spark, SF)
    accepted = {r.doc_id for r in language.identify_documents(docs, language.learn_text(docs)).filter("accepted").collect()}
    rows = [r for r in docs.collect() if r.doc_id in accepted]
    prints = {r.doc_id: near_copies.fingerprint(r.text) & ((1 << 64) - 1) for r in rows}
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if group[b] < group[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    group[a], changed = group[b], True
    rows = [r for r in rows if group[r.doc_id] == r.doc_id]
    automaton = decontaminate.automaton_of(items, 10)
    rows = [r for r in rows if not decontaminate.scan(r.text, automaton)["n_hit"]]
    chosen = plain_mix([(r.doc_id, r.text, r.lang, r.source) for r in rows], corpus_pipeline.MIX)
    got = found.collect()
    assert sorted(r.doc_id for r in got) == sorted(chosen)
    assert Counter(Counter(r.shard for r in got).values()).keys() <= {len(got) // 16, len(got) // 16 + 1}
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_with_odd_rows_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", None, 0), (900_002, "12 34", None, "src0", 5), (900_003, "the and of with " * 20_000, "en", "src1", 1)], DOCS)
    mixed = docs.unionByName(odd).unionByName(docs.limit(5))
    for frame in (mixed, docs.limit(0)):
        frame = frame.withColumn("_rows", F.lit(1)).withColumn("shard_", F.lit(2))
        for _, work in corpus_pipeline.STAGES[:-1]:
            kept = work(spark, frame, SF)
            assert kept.columns == frame.columns
            assert kept.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == frame.count()
