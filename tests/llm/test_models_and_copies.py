"""Trie, LM scores, neighbours, near copies and toxicity: against plain versions, and odd inputs."""

import os
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tillwork.llm import lm_score, near_copies, nearest, toxicity
from tillwork.llm.ngram_trie import ContextLevel, EliasFano, context_level, map_parts, write_parts
from tillwork.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


# Elias-Fano and the trie

@pytest.mark.parametrize(("n", "top"), [(0, 10), (1, 1), (5, 3), (1000, 2000), (50_000, 2**60), (50_000, 50_001), (4000, 40)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n + top)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    made = EliasFano.build(values)
    if n:
        assert (made.access(np.arange(n)) == values).all()
    asked = np.r_[values[:3000], rng.integers(0, top, 3000, dtype=np.uint64)]
    at, same = made.successor(asked)
    assert (same == np.isin(asked, values)).all()
    if n:
        assert (at[same] == np.searchsorted(values, asked[same])).all()


def test_level_survives_its_file(tmp_path):
    rng = np.random.default_rng(3)
    pairs = sorted({(int(c), int(w)) for c, w in zip(rng.integers(1, 60, 3000), rng.integers(0, 4000, 3000), strict=True)})
    context, child = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
    count = rng.integers(1, 6, len(pairs))
    path = str(tmp_path / "a.trie")
    write_parts(path, context_level(context, child, count, 5000, 2))
    level = ContextLevel(map_parts(path))
    held = {}
    for (c, w), n in zip(pairs, count.tolist(), strict=True):
        if n >= 2:
            held.setdefault(c, []).append((w, n))
    contexts = np.arange(0, 62, dtype=np.uint64)
    number, asked = np.repeat(np.arange(62), 50), np.tile(rng.integers(0, 4000, 50), 62).astype(np.uint64)
    known = [(c, w) for c in held for w, _ in held[c][:20]]
    number, asked = np.r_[number, [c for c, _ in known]], np.r_[asked, np.array([w for _, w in known], np.uint64)]
    found = level.find(contexts, number, asked)
    for i, (c, w) in enumerate(zip(number.tolist(), asked.tolist(), strict=True)):
        children = [x for x, _ in held.get(c, [])]
        assert found["place"][i] == (children.index(w) if w in children else -1)
        if w in children:
            assert found["share"][i] == pytest.approx(dict(held[c])[w] / sum(n for _, n in held[c]), rel=1e-3)
            assert found["kept"][i] == sum(n for _, n in held[c])


# LM scores

def plain_tokens(text):
    return (text or "").encode().lower().split() + [b"</s>"]


def plain_model(texts):
    """Counts of words, pairs and triples."""
    words, pairs, triples = Counter(), Counter(), Counter()
    for t in texts:
        seq = [b"<s>", *plain_tokens(t)]
        words.update(seq[1:])
        pairs.update(zip(seq, seq[1:], strict=False))
        triples.update(zip(seq, seq[1:], seq[2:], strict=False))
    return words, pairs, triples


def plain_score(text, counted, model):
    words, pairs, triples = counted
    n, v = sum(words.values()), len(words)
    seq = [b"<s>", *plain_tokens(text)]
    base = score = 0.0

    def mixed(shorter, table, context, word, weights, total):
        kept = sum(c for g, c in table.items() if g[:-1] == context)
        if not kept:
            return shorter
        c = table.get((*context, word), 0)
        weight = weights[lm_score._bucket(np.array([kept]), np.array([total]))[0]]
        return weight * c / kept + (1 - weight) * shorter

    for i in range(1, len(seq)):
        p = (words[seq[i]] + 0.1) / (n + 0.1 * (v + 1))
        base += math.log10(p)
        total = sum(c for g, c in pairs.items() if g[0] == seq[i - 1])
        p = mixed(p, pairs, (seq[i - 1],), seq[i], model.pair_weights, total)
        if i >= 2 and pairs[seq[i - 2], seq[i - 1]]:
            p = mixed(p, triples, (seq[i - 2], seq[i - 1]), seq[i], model.triple_weights, pairs[seq[i - 2], seq[i - 1]])
        score += math.log10(p)
    return len(seq) - 1, sum(words[w] > 0 for w in seq[1:]), base, score


def test_scores_against_plain_version(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["the", "cat", "Dog", "sat", "on", "mat", "é", "a b", "w" * 80, "x"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(60)]
    texts += ["the cat sat on the mat\tand\x0bmore"] * 5 + [None, "", "   \n", "unseen words only here", "the " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = lm_score.train(docs)
    counted = plain_model(texts)
    assert (model.tokens, model.types) == (sum(counted[0].values()), len(counted[0]))
    for row in lm_score.score(docs.unionByName(spark.createDataFrame([(99, "the zebra sat on the cat")], docs.schema)), model).collect():
        want = plain_score(row.text, counted, model)
        assert (row.lm.n_tokens, row.lm.n_known) == want[:2]
        assert row.lm.base_score == pytest.approx(want[2], rel=1e-9)
        assert row.lm.score == pytest.approx(want[3], rel=2e-3)


def test_scores_of_held_out_texts_beat_the_base(spark):
    found = QUERIES["op2_lm_score"](spark, SF)
    r = found.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s / r.n > r.b / r.n + 0.1
    assert found.count() == 1000


def test_scores_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, 1), (3, "a b", 2), (3, "a b", 2)], "doc_id long, text string, held_out int")
    found = lm_score.score_documents(docs).collect()
    assert sorted((r.doc_id is None, r.held_out, r.n_tokens) for r in found) == [(False, False, 3), (False, False, 3), (True, True, 1)]
    assert lm_score.score_documents(docs.limit(0)).count() == 0


def test_weights_are_learnt_from_a_few_long_texts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "DEV_TOKENS", 50)  # far fewer than a text has
    rng = np.random.default_rng(7)
    texts = [" ".join(["the cat sat on", "a dog ran by"][i] for i in rng.integers(0, 2, 4000)) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = lm_score.train(docs)
    assert model.pair_weights.max() > 0.5 and model.triple_weights.max() > 0
    assert all(r.lm.score > r.lm.base_score + 1 for r in lm_score.score(docs, model).collect())
    chosen = lm_score._dev_texts(docs, "text", model.tokens)
    assert len(chosen) == 1 and chosen == lm_score._dev_texts(docs.repartition(5), "text", model.tokens)


def test_weights_come_from_all_training_texts(spark):
    """against a plain count of occurrences whose child is seen again when they are left out."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 12))) for _ in range(200)] + ["q r s t", None]
    model = lm_score.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    for n, weights in ((2, model.pair_weights), (3, model.triple_weights)):
        grams = Counter()
        for words in (["<"] + (t or "").split() + [">"] for t in texts):
            grams.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        totals, left, again = Counter(), Counter(), Counter()
        for gram, count in grams.items():
            totals[gram[:-1]] += count
        for gram, count in grams.items():
            rest = totals[gram[:-1]] - 1
            if rest:
                bucket = lm_score._bucket(np.array([rest]), np.array([rest]))[0]
                left[bucket] += count
                again[bucket] += count if count > 1 else 0
        assert len(left) > 1
        assert weights == pytest.approx([min((again[b] + 0.2) / (left[b] + 4.0), 0.98) for b in range(lm_score.BUCKETS)])


def test_a_lost_level_file_is_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the cat sat on the mat {i % 3}") for i in range(30)], "doc_id long, text string")
    model = lm_score.train(docs)
    assert {level for level, _ in model.files} == {lm_score.WORDS, lm_score.PAIRS, lm_score.TRIPLES}
    trie = lm_score.Trie(model.folder, model.shards, model.files)
    monkeypatch.setattr(lm_score, "MOST_OPEN", 1)
    assert all(trie.level(*key) is not None for key in model.files) and len(trie.open) == 1
    for (level, shard), spoil in zip(sorted(model.files), [os.remove, lambda path: os.truncate(path, 100)], strict=False):
        spoil(lm_score._file(model.folder, level, shard))
        with pytest.raises(FileNotFoundError):
            lm_score.Trie(model.folder, model.shards, model.files).level(level, shard)
    assert lm_score.Trie(model.folder, model.shards, {}).level(lm_score.WORDS, 0) is None


def test_chunks_of_one_context_are_merged_as_they_come(monkeypatch):
    monkeypatch.setattr(lm_score, "MERGE", 500)
    largest = []
    merged = lm_score._merged
    monkeypatch.setattr(lm_score, "_merged", lambda held: largest.append(sum(len(h[0]) for h in held)) or merged(held))
    rng = np.random.default_rng(9)
    want, rows = Counter(), []
    for _ in range(200):
        child = np.unique(rng.integers(0, 300, 100)).astype(np.uint64)
        count = rng.integers(1, 5, len(child))
        want.update(dict(zip(child.tolist(), count.tolist(), strict=True)))
        rows += list(lm_score._packed(lm_score.PAIRS, 1, np.full(len(child), 77, np.uint64), child, count))
    names = ["level", "shard", "context", "sizes", "child", "count"]
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows[i : i + 7], strict=True), strict=True))) for i in range(0, len(rows), 7)]
    context, child, count = lm_score._unpacked(lm_score.PAIRS, iter(batches))
    assert (context == 77).all() and dict(zip(child.tolist(), count.tolist(), strict=True)) == want
    assert max(largest) <= 2 * 300 + 500 + 100  # of some 17,000 entries


# Nearest neighbours

def plain_nearest(rows, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q, x in good.items():
        if q % 10 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good.items() if i != q and len(y) == len(x))[:k]
            out[q] = [(r + 1, i, d) for r, (d, i) in enumerate(near)]
    return out


def test_nearest_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)] + [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(200, 260)]
    rows += [(300, None), (301, [0.0] * 6), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (310, [float("nan")] * 6), (320, [float("inf")] * 6), (330, [1.0, 2.0]), (340, [1.5, 2.0]), (None, [1.0] * 6), (350, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(7))
    found = nearest.nearest(df, df.filter("vec_id % 10 = 0"), k=5).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = plain_nearest(rows, 5)
    # Few rows are one or two buckets a table: all is found.
    assert set(got) == {q for q in want if want[q]}
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in got)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert [x[1] for x in sorted(got[200])] == [201, 202, 203, 204, 205]
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_recall_and_exact_distances(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = nearest.nearest(vectors, vectors.filter("vec_id % 25 = 0")).collect()
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    ids, all_ = np.array(sorted(rows)), np.stack([rows[i] for i in sorted(rows)])
    got = {}
    for r in found:
        assert r.score == pytest.approx(float(np.sqrt(((rows[r.query_id] - rows[r.vec_id]) ** 2).sum())), rel=1e-12)
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in got:
        d = ((all_ - rows[q]) ** 2).sum(axis=1)
        order = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        recall.append(len(got[q] & set(order)) / 10)
    assert np.mean(recall) >= 0.9


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SLICE", 30)
    rng = np.random.default_rng(8)
    rows = [(i, (np.ones(4) + rng.normal(size=4) * 1e-3).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain_nearest(rows, 10)
    found = nearest.nearest(df, df.filter("vec_id % 10 = 0")).collect()
    hits = sum(any(r.vec_id == i for _, i, _ in want[r.query_id]) for r in found)
    assert hits >= 0.9 * 10 * len(want)


def recall_of(found, want):
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(got.get(q, ())) == len(w) for q, w in want.items())
    return np.mean([len(got[q] & {i for _, i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("probe_rows", [100, 0.1])
def test_recall_of_sparse_rows_beside_a_tight_cluster(spark, monkeypatch, probe_rows):
    monkeypatch.setattr(nearest, "BUCKET", 16)  # 8 projections
    monkeypatch.setattr(nearest, "PROBE_ROWS", probe_rows)  # a probe is cheap: buckets are visited again before a scan
    rng = np.random.default_rng(11)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 1e-3).tolist()) for i in range(3700)]
    rows += [(i, (np.ones(8) + rng.normal(size=8) * 10 ** rng.uniform(-3, 0)).tolist()) for i in range(3700, 4100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {q: w for q, w in plain_nearest(rows, 10).items() if q >= 3700}
    assert recall_of(nearest.nearest(df, df.filter("vec_id % 10 = 0 and vec_id >= 3700")).collect(), want) >= 0.95


def test_queries_that_the_probes_do_not_cover_are_scanned(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BUCKET", 16)
    monkeypatch.setattr(nearest, "MOST_PROBES", 3)
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall_of(nearest.nearest(df, df.filter("vec_id % 10 = 0")).collect(), plain_nearest(rows, 10)) == 1.0


def test_probes_fall_in_likelihood():
    rng = np.random.default_rng(0)
    cells = nearest.probes(rng.normal(size=3) * 3, 2.0, 1.0, 0.9)
    assert len({tuple(c) for c in cells.tolist()}) == len(cells)


# Near copies

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest member reachable, for distinct fingerprints."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    prints = sorted(prints)
    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("large", [4, 2048])
def test_components_against_all_pairs(spark, large):
    rng = np.random.default_rng(5)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        centre = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        for _ in range(40):
            p = centre
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                p ^= 1 << int(b)
            prints.add(p)
    prints |= {int(x) for x in rng.integers(0, 1 << 64, 100, dtype=np.uint64)}
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(3)
    links = near_copies.near_links(df, large=large)
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 3 for r in links.collect())
    group = {}
    for r in near_copies.components(links).collect():
        group[r.node & ((1 << 64) - 1)] = r.root & ((1 << 64) - 1)
    want = plain_components(prints)
    got_sets, want_sets = {}, {}
    for p in prints:
        got_sets.setdefault(group.get(p, p), set()).add(p)
        want_sets.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, got_sets.values())) == sorted(map(sorted, want_sets.values()))


def test_fingerprints_are_those_of_the_engine(spark):
    text = "Une ÉTÉ The cat\tSAT on\x0cthe mat"
    want = spark.range(1).select(F.xxhash64(F.lit("une ÉtÉ the".replace("Ét", "ÉT").replace("TÉ", "tÉ")))).first()[0]
    assert want == xxhash.xxh64_intdigest("une ÉtÉ the".encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest("une ÉtÉ the".encode(), 42) >> 63)
    for t in (text, None, "", "one", "one two", "a b c", "x " * 5000):
        assert near_copies.fingerprint(t) & ((1 << 64) - 1) == plain_fingerprint(t)


def test_near_copies_and_the_one_that_stays(spark):
    long_text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, long_text), (3, long_text + " end"), (9, long_text.replace("word7 ", "other ")), (7, None), (8, ""), (4, "quite another text"), (4, "quite another text"), (None, long_text), (None, "lone words"), (None, "lone words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("_name", F.lit("x"))
    found = near_copies.near_copies(docs).collect()
    assert len(found) == len(rows)
    prints = {t: plain_fingerprint(t) for _, t in rows}
    roots = plain_components(set(prints.values()))
    for r in found:
        assert len(r.fingerprint) == 16
        p = int(r.fingerprint, 16)
        ids = [i for i, t in rows if roots[prints[t]] == roots[p] and i is not None]
        assert r.component_id == min(ids, default=None)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == [
        (False, 3, long_text + " end"), (False, 4, "quite another text"), (False, 7, ""), (True, 0, "lone words"),
    ]
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_but_not_a_component_all_stay(spark):
    first, second = (" ".join(f"{w}{i}" for i in range(300)) for w in ("one", "two"))
    rows = [(1, first), (1, second), (2, second), (5, "short text here"), (5, "short text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_copies.keep_one(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, first), (1, second), (5, "short text here")]


# Toxicity

def test_pairs_of_terms_are_learnt(spark):
    """An insult alone and a group alone are harmless: no sum of word weights tells them from both."""
    rng = np.random.default_rng(6)
    filler = [f"filler{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    rows, labels = [], []
    for i in range(3000):
        insult, group = bool(rng.integers(0, 2)), bool(rng.integers(0, 2))
        words = [*rng.choice(filler, 12), *["rascal"] * insult, *["islanders"] * group]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group), 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(0)).withColumn("score", F.lit(0))
    found = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")).filter("held_out").collect()
    truth = {i: t for i, t, _ in labels}
    assert np.mean([r.predicted == truth[r.doc_id] for r in found]) > 0.97


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "some words"), (2, "some words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert toxicity.toxicity(docs, labels.limit(0)).count() == 4
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_held_out_toxicity(spark):
    found = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    r = found.filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("a")).first()
    assert r.a > 0.95


def test_terms_of_shared_beginnings():
    cache = toxicity._Terms()
    one, two, four = (set(toxicity.terms_of(t, cache).tolist()) for t in ("stemma", "stemma stembo", "stemma stembo stemca stemdu"))
    assert len(one) == 3  # the word, four and five letters
    assert len(two) == 6 and one < two  # two words, one shared beginning and two own, and its term for two
    assert len(four) == 11 and two < four  # terms for two and for four
    assert two == set(toxicity.terms_of("Stembo stemma STEMMA stembo", cache).tolist())
    assert len(toxicity.terms_of(None, cache)) == len(toxicity.terms_of("", cache)) == 0


def test_low_parts_and_neighbours_of_a_sequence():
    """Low parts are read from any byte, and a value with the one behind it, also across words and at both widths."""
    rng = np.random.default_rng(3)
    for top, n in ((1 << 12, 5000), (1 << 40, 3000), (1 << 60, 3), (1 << 60, 1)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        held = EliasFano.build(values)
        assert (held.access(np.arange(n)) == values).all()
        first, behind = held.pair(np.arange(n - 1))
        assert (first == values[:-1]).all() and (behind == values[1:]).all()


@pytest.mark.parametrize("high", [50, 1 << 31])
def test_pairs_are_counted_with_and_without_room_for_places(high):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, high, 999) // 7, np.where(rng.random(999) < 0.1, lm_score.OTHER, rng.integers(0, 40, 999))
    first, second, count, inverse = lm_score._counted(a, b)
    want = sorted(Counter(zip(a.tolist(), b.tolist(), strict=True)).items())
    assert list(zip(zip(first.tolist(), second.tolist(), strict=True), count.tolist(), strict=True)) == want
    assert (first[inverse] == a).all() and (second[inverse] == b).all()


def test_children_of_a_large_context_are_found_in_few_looks(monkeypatch):
    """op2's time: a context with many children among many with one; before, its children stood in a few large buckets."""
    rng = np.random.default_rng(6)
    child = np.sort(rng.choice(1 << 40, 20_000, replace=False))
    context = np.r_[np.arange(2000), np.full(len(child), 2000), np.arange(2001, 4000)].astype(np.uint64)
    level = ContextLevel(context_level(context, np.r_[rng.integers(0, 1 << 40, 2000), child, rng.integers(0, 1 << 40, 1999)].astype(np.uint64), np.ones(len(context), np.int64), 1 << 40))
    looks, low = [], EliasFano._low
    monkeypatch.setattr(EliasFano, "_low", lambda self, i: looks.append(self is level.children) or low(self, i))
    found = level.find(np.uint64([2000]), np.zeros(len(child), np.int64), child.astype(np.uint64))
    assert (found["place"] == np.arange(len(child))).all() and (found["kept"] == len(child)).all()
    assert sum(looks) <= 9
    assert (level.find(np.uint64([2000]), np.zeros(99, np.int64), child[:99].astype(np.uint64) + np.uint64(1))["place"] == -1).all()


@pytest.mark.parametrize(("top", "spread"), [(1 << 62, False), (5000, True), (3, True)])
def test_children_that_are_large_or_in_another_order(top, spread):
    rng = np.random.default_rng(top % 97)
    child = [np.sort(rng.choice(min(top, 2000), 3, replace=False)) * (top // min(top, 2000)) for _ in range(2)]
    context, count = np.repeat(np.uint64([4, 9]), 3), np.arange(1, 7)
    level = ContextLevel(context_level(context, np.concatenate(child).astype(np.uint64), count, 1 << 63, spread=spread))
    assert level.even == (top < 1 << 62)
    asked = np.r_[child[0], child[1], top + 1, child[1][0] + 1 if top > 3 else top].astype(np.uint64)
    found = level.find(np.uint64([4, 9, 11]), np.int64([0] * 3 + [1] * 5), asked)
    assert found["share"] == pytest.approx([1 / 6, 2 / 6, 3 / 6, 4 / 15, 5 / 15, 6 / 15, 0, 0], rel=1e-3)
    assert sorted(found["place"][:3]) == sorted(found["place"][3:6]) == [0, 1, 2] and (found["place"][6:] == -1).all()
    assert (found["bucket"] == lm_score._bucket(found["kept"], found["total"])).all() and (found["kept"] == [6] * 3 + [15] * 5).all()
    assert (level.find(np.uint64([11]), np.zeros(1, np.int64), asked[:1], ("bucket",))["bucket"] == lm_score.BUCKETS).all()


@pytest.mark.parametrize("shards", [1, 2, 5, 64, 1000])
def test_shards_are_ranges_of_contexts(shards):
    hashes = np.unique(np.random.default_rng(shards).integers(0, 1 << 60, 5000, dtype=np.uint64))
    for level, contexts in ((lm_score.WORDS, hashes), (lm_score.PAIRS, lm_score._contexts(hashes, shards))):
        starts, seen = lm_score._starts(level, shards), []
        for _, shard, context, sizes, child, _ in lm_score._packed(level, shards, contexts, np.arange(len(hashes)) & 255, np.ones(len(hashes), np.int64)):
            own = lm_score._from_planes(context, lm_score._CONTEXT_WIDTH[level]) + starts[shard]
            assert (own >= starts[shard]).all() and (own < starts[shard + 1]).all() and len(child) == len(own) * lm_score._WIDTH[level]
            seen.append(own)
        assert (np.concatenate(seen) == contexts).all()


def test_order_of_hashes_that_differ_in_low_bits_only():
    for hashes in ([7, 5, 5, 6, 1 << 59], [], np.random.default_rng(2).integers(0, 1 << 60, 3000)):
        hashes = np.array(hashes, np.uint64)
        assert (hashes[lm_score._order(hashes)] == np.sort(hashes)).all()
