"""Token counts, dataset manifest and prefix trie: against plain versions, and odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillwork.llm import manifest, prefix_trie, token_counts
from tillwork.llm.queries import QUERIES

# Token counts

with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as _file:
    DEFINITION = _file.read()
PARTS = [
    "'s", "'r", "e", "'", "v", "'ve", "l", "'ll", " ", "\n", "a", "th", "ing", "1", "23", "!", "...", "é", "é", "Σ", "ΟΔΟΣ", "İ",
    "<|endoftext|>", "<|startoftext|>", "<|", "|>", "漢字", "ー", "̸", ">", "😀", "　", "​", "ß", "'S", "_", "==", "\u0000",
    "한국", "ﬁ", "Ⅷ", "²", "Ɤ", "\U00016d68\U00016d67",
]


@pytest.fixture(scope="module")
def compiled():
    return token_counts.compile_tokenizer(DEFINITION)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_str(DEFINITION)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def mixed_texts(n, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    spans = [(32, 127), (128, 0x2000), (0x2000, 0xD800), (0xE000, 0x110000)]
    return texts + ["".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(20)) for _ in range(n // 2)]


@pytest.mark.parametrize("block, chunk, most_states", [(1 << 21, 512, 300_000), (300, 16, 50)])
def test_counts_are_the_library_s(compiled, library, block, chunk, most_states):
    texts = mixed_texts(2000)
    counter = token_counts.Counter(compiled, block, chunk, most_states)
    assert counter.counts(texts) == library(texts)
    # One text over many blocks, one run of letters without a break, and runs that end at every place of a block.
    rng = random.Random(2)
    run = "".join(rng.choice("abcdefgh'") for _ in range(5000))
    long = ["".join(texts[:500]), run, run.replace("'", "")] + ["x" * (block - 2 + i) + "'ll've" for i in range(4) if block < 1000]
    assert counter.counts(long) == library(long)


def test_every_character_counts_like_the_library_s(compiled, library):
    points = [p for p in range(0, 0x30000, 7) if not 0xD800 <= p < 0xE000]
    texts = ["|" + chr(p) + "a" + chr(p) * 2 for p in points]
    assert token_counts.Counter(compiled).counts(texts) == library(texts)


def test_pairs_of_tokens_agree_with_the_definition(compiled):
    transducer = token_counts.PieceTransducer(compiled.merges)
    rng = random.Random(5)
    tokens = [a + b for a, b in compiled.merges]
    middle = [t for t in tokens if not t.endswith(token_counts.END)]
    for _ in range(3000):
        a, b = rng.choice(middle), rng.choice(tokens)
        body = b.removesuffix(token_counts.END)
        symbols = [*a, *body[:-1], body[-1] + b[len(body):]]
        if transducer._fits(None, a) and transducer._fits(None, b):
            assert transducer._fits(a, b) == (transducer.merged(symbols) == [a, b])


def test_chunk_maps_compose(compiled):
    classes = np.random.default_rng(3).integers(0, token_counts.CLASSES, 1000).astype(np.uint8)
    state, want = token_counts.BETWEEN, []
    for c in classes:
        want.append(state)
        state = token_counts.NEXT[state * token_counts.CLASSES + c]
    for chunk in (1, 7, 64, 5000):
        assert token_counts.scan(classes, chunk).tolist() == want


def test_counts_of_odd_tables(spark, library):
    texts = ["Hello, it's a test", None, "", "a <|endoftext|> b", "word " * 100_000, "x" * 50_000, "same", "same"]
    rows = [(i, t, -1, "n") for i, t in enumerate(texts)] + [(None, "no id", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, N_BYTES string")
    found = token_counts.count_tokens(docs, DEFINITION)
    assert found.columns == ["doc_id", "text", "n_tokens", "N_BYTES", "n_bytes_", "n_tokens_"]
    got = {(r["doc_id"], r["text"]): (r["n_bytes_"], r["n_tokens_"]) for r in found.collect()}
    plain = library([t or "" for _, t, _, _ in rows])
    assert got == {(i, t): (len((t or "").encode()), n) for (i, t, _, _), n in zip(rows, plain, strict=True)}
    assert token_counts.count_tokens(docs.limit(0), DEFINITION).count() == 0
    with pytest.raises(ValueError):
        token_counts.compile_tokenizer(DEFINITION.replace("</w>", "</v>"))


def test_op11_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r["doc_id"]: n for r, n in zip(docs, library([r["text"] or "" for r in docs]), strict=True)}
    got = QUERIES["op11_token_counts"](spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


# Manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves, fanout):
    """(root, siblings per leaf and level) by the definition."""
    proofs, nodes = [[] for _ in leaves], [(h, [i]) for i, h in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for i in range(0, len(nodes), fanout):
            run = nodes[i : i + fanout]
            for k, (_, members) in enumerate(run):
                for m in members:
                    proofs[m].append(("".join(x[0] for x in run[:k]), "".join(x[0] for x in run[k + 1 :])))
            above.append((digest("".join(x[0] for x in run)), [m for x in run for m in x[1]]))
        nodes = above
    return nodes[0][0], proofs


def plain_manifest(rows, fanout):
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, digest("".join(map(framed, r))), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names]
    root, above = plain_tree([t[0] for t in trees], fanout)
    return [
        (x[3][0], x[2], subroot, root, proof + up)
        for g, (subroot, proofs), up in zip(names, trees, above, strict=True)
        for x, proof in zip(sorted(groups[g], key=lambda x: x[:3]), proofs, strict=True)
    ]


def manifest_rows():
    rng = random.Random(3)
    langs = ["en", "en", "en", "de", None, "zh", "é", ""]
    rows = [(i, rng.choice(["s", "é", None]), rng.choice(langs), rng.choice([None, 5, 2**63 - 1]), "t" * rng.randint(0, 5)) for i in range(120)]
    return rows + [(None,) * 5] * 3 + [(7, "s", "en", 1, "x")] * 2 + [(900, None, "only", 1, "x" * 300_000)]


@pytest.mark.parametrize("fanout, block", [(2, 4), (3, 3), (4, 1)])
def test_manifest_against_plain_version(spark, fanout, block):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string")
    tampered = F.col("doc_id") % 5 == 0
    got = manifest.merkle_manifest(docs.repartition(5), fanout, block, tampered)
    got = got.withColumn("folded", manifest.fold_proof(F.col("seen_leaf"), F.col("proof"))).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], str(r[4]))
    plain = sorted(plain_manifest(rows, fanout), key=order)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got), key=order) == plain
    counted = {r[0] for r in rows if r[3] is not None and r[0] is not None and r[0] % 5 == 0}
    assert all((r.folded == r.root) == (r.doc_id not in counted) for r in got)


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    empty = manifest.merkle_manifest(spark.createDataFrame([], schema))
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof", "seen_leaf"] and empty.count() == 0
    one = manifest.merkle_manifest(spark.createDataFrame([(1, "s", "en", 2, None)], schema)).first()
    assert one.leaf == one.subroot == one.root == digest("1:11:s2:en1:2-") and one.proof == []
    with pytest.raises(ValueError):
        manifest.merkle_manifest(spark.createDataFrame([], schema), fanout=3, block=4)


# Prefix trie


def crc(n):
    return zlib.crc32(str(n).encode())


def plain_trie(rows, rebuild=True):
    """{(conversation, depth): (parent, members, children, leaves, saved, ends)} by the definition."""
    told = {}
    for c, turn, role, text in rows:
        if c is not None:
            told.setdefault(c, []).append((turn is not None, turn or 0, role or "", prefix_key(role, text), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in told.items()}
    paths = own
    if rebuild:
        paths = {c: own.get(c - c % 100, [])[: crc(c) % 6] + turns[crc(c) % 6 :] for c, turns in own.items()}
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    found = {}
    for node, inside in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if all(len(paths[c]) == len(m) for c in members[m])]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = sorted(c for c in inside if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        found[min(inside), len(node)] = (parent, len(inside), len(children), len(leaves), saved, ends)
    return found


def prefix_key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def got_trie(trie):
    ends = {}
    for r in sorted(trie.pieces.collect(), key=lambda r: r.part):
        ends.setdefault((r.conv_id, r.depth), []).extend(r.ends)
    rows = trie.nodes.collect()
    found = {
        (r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, ends.get((r.conv_id, r.depth), []) if r.ends is None else r.ends)
        for r in rows
    }
    assert len(found) == len(rows)
    return found


def trie_rows():
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 206]:
        # Some conversations start in few ways, one group is the same throughout, some are long and partly alike.
        n = rng.randint(1, 7)
        texts = [rng.choice(["a", "bb", "ccc", ""]) for _ in range(n)] if c % 3 else ["same", "copy"] * 2
        if c in (1, 101, 102):
            texts = ["long"] * 30 + [f"{c if i > 10 else 'x'}-{i}" for i in range(40)]
        rows += [(c, i if i else None, "user" if i % 2 else None, t or None) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, 0, "user", "no conversation")] + [(5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "a", "é😀")]


@pytest.mark.parametrize("shard, alone", [(20_000, 256), (20, 4), (3, 1)])
def test_trie_against_plain_version(spark, shard, alone):
    rows = trie_rows()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string").repartition(4)
    trie = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turn_paths(table)), shard_nodes=shard, alone=alone)
    assert got_trie(trie) == plain_trie(rows)


def test_copies_of_one_conversation_are_dealt(spark):
    path = (b"a" * 16, b"b" * 16)
    sample = [(path, c) for c in range(100)] + [((b"c" * 16,), 200)]
    skeleton = prefix_trie.Skeleton(sample, 10)
    shards = {skeleton.shard(path, c) for c in range(100)}
    assert len(shards) >= 9 and skeleton.children == {(0, b"a" * 16): 1, (1, b"b" * 16): 2, (0, b"c" * 16): 3}
    pieces = spark.createDataFrame([(1, 2, p, list(range(10 * p, 10 * p + 10))) for p in (2, 0, 1)] + [(3, 0, 0, [3])], "conv_id long, depth long, part long, ends array<long>")
    got = {(r.conv_id, r.depth): r.ends_sha256 for r in prefix_trie.joined_digest(pieces).collect()}
    assert got == {(1, 2): digest(",".join(map(str, range(30)))), (3, 0): digest("3")}


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    build = lambda rows: got_trie(prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turn_paths(spark.createDataFrame(rows, schema)))))
    assert build([]) == {} and build([(None, 1, "user", "x")]) == {}
    # 101 has no first conversation of its family, so turns are cut off and some are left without any.
    rows = [(c, 0, "user", "x" * 100_000) for c in (101, 103, 200)]
    assert build(rows) == plain_trie(rows)
