"""Prefix trie of conversations: every distinct beginning is a node, with totals over its subtree.

Method: a splitter skeleton. A conversation is the path of its turns' digests. Paths are dealt by ranges,
between splitters taken from a bounded sample. All conversations below a node stand together in that
order, so a node whose conversations lie in two shards is a beginning of the splitter between them.
The trie of the splitters' paths, the skeleton, is broadcast. Each shard sorts its paths and finishes
every node that is not in the skeleton by itself, in one walk; for skeleton nodes it gives what it has
seen of them, and these partial aggregates are combined by reduction and summed up the skeleton.

Splitters are cut to the first turn in which they differ from the sample before, and paths that are equal
are told apart by their id, so that very many copies of one conversation are dealt over many shards.

A conversation that is alone from some turn on needs no trie there. Commutative hashes of the beginnings
of ``ALONE`` turns and its doublings, summed before the shuffle, find the first beginning that no other
conversation shares; the turns after it become nodes directly. So a path in a task is short unless others share
it (20 bytes a turn), and one conversation may hold a large part of all turns. A false meeting of hashes
only makes a path longer.

Results in special cases: turns without a conversation id take no part. A NULL role or text is empty, a
NULL turn comes first; turns with the same number go by role, then by digest. Conversations without turns
are members of the root only. Repeated rows are turns of their own. Very long texts enter as digests, made in the
scan. An empty table has no nodes, not even a root. Columns that are not named are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillwork.llm.common import text_remainder
from tillwork.llm.places import numbered
from tillwork.staging import attach, stage

# Nodes that a shard should have, and the most shards, which bounds the skeleton and the sample.
SHARD = 20_000
MOST_SHARDS = 4096
SAMPLES = 32
ALONE = 256
# Ids in one piece of a skeleton node's list.
PIECE = 1000
BEFORE_ALL = -(2**63) - 1
NODE = (
    "sid long, part long, conv_id long, depth long, parent_conv_id long, parent_sid long, n_convs long, "
    "n_children long, n_leaves long, saved long, chars long, ends array<long>"
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]


@dataclass(frozen=True)
class Trie:
    """``nodes`` has a row per node: its smallest member, its depth, the same of its parent, the totals, and
    ``ends``: the members that end there, ascending. ``ends`` is NULL for nodes that many tasks have a part
    of; theirs are in ``pieces`` (``conv_id``, ``depth``, ``part``, ``ends``), to be joined by ``part``.
    """

    nodes: DataFrame
    pieces: DataFrame


def turn_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, size, digest, chars) of every turn, in the order of its conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(framed, 256), 1, 32))
    narrow = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")
    )
    return numbered(narrow, ["conv_id"], ["turn", "role", "digest"]).drop("turn", "role")


def rebuilt(turns: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: (turns, conversations with their length).

    The first h turns, h = CRC-32 of the id modulo ``most``, are those of conversation id - id % ``family``
    (all if it has fewer, none if it does not exist); the conversation's own turns after its first h follow.
    """
    taken_of = lambda c: text_remainder(c, most)
    sizes = turns.filter("place = 0").select("conv_id", "size")
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    known = sizes.withColumns({"base": base, "h": taken_of(F.col("conv_id"))}).join(heads, "base", "left")
    taken = F.least("h", F.coalesce("base_size", F.lit(0)))
    convs = stage(known.select(
        "conv_id", "base", taken.alias("taken"), (taken + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")
    ), "conversations")
    own = attach(turns.filter(F.col("place") >= taken_of(F.col("conv_id"))), convs.select("conv_id", "taken"), ["conv_id"], "inner")
    own = own.select("conv_id", (F.col("taken") + F.col("place") - taken_of(F.col("conv_id")) + 1).alias("depth"), "digest", "chars")
    first = turns.filter(F.col("place") < most - 1).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    copied = convs.filter("taken > 0").select("conv_id", "base", "taken").join(first, "base").filter("place < taken")
    copied = copied.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "chars")
    return stage(own.unionByName(copied), "turns"), convs.select("conv_id", "length")


def lonely(turns: DataFrame, convs: DataFrame, alone: int = ALONE) -> DataFrame:
    """(conv_id, cut, length): conversations longer than ``cut``, the shortest tried beginning that is theirs only."""
    units = F.expr(f"(depth - 1) div {alone}")
    doubling = F.when(units == 0, F.lit(0)).otherwise(F.length(F.bin(units)))
    hashes = [F.bit_xor(F.xxhash64("depth", "digest")).alias("a"), F.bit_xor(F.xxhash64("digest", "depth", F.lit("b"))).alias("b")]
    parts = turns.groupBy("conv_id", doubling.alias("k")).agg(*hashes, F.count("*").alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    begun = parts.select("conv_id", "k", F.sum("n").over(upto).alias("n"), F.bit_xor("a").over(upto).alias("a"), F.bit_xor("b").over(upto).alias("b"))
    whole = begun.filter(F.col("n") == F.lit(alone) * F.expr("shiftleft(1L, k)"))
    single = whole.groupBy("n", "a", "b").agg(F.count("*").alias("sharing"), F.min("conv_id").alias("conv_id")).filter("sharing = 1")
    cuts = single.groupBy("conv_id").agg(F.min("n").alias("cut"))
    return convs.join(cuts, "conv_id").filter("length > cut").select("conv_id", "cut", "length")


class Skeleton:
    """The splitters and the trie of their paths; node 0 is the root."""

    def __init__(self, sample: list[tuple[tuple[bytes, ...], int]], shards: int):
        sample = sorted(sample)
        sizes = [len(path) + 1 for path, _ in sample]
        total, passed, self.splitters = sum(sizes), 0, []
        for i, ((path, conv), size) in enumerate(zip(sample, sizes, strict=True)):
            here = passed * shards // max(1, total)
            passed += size
            if i and passed * shards // total > here and sample[i - 1] != sample[i]:
                shared = _shared(sample[i - 1][0], path)
                # Cut after the first turn that differs; equal paths are told apart by the id.
                same = shared == len(path)
                self.splitters.append((path if same else path[: shared + 1], conv if same else BEFORE_ALL))
        self.children: dict[tuple[int, bytes], int] = {}
        self.parents, self.depths = [-1], [0]
        for path, _ in self.splitters:
            node = 0
            for depth, digest in enumerate(path, 1):
                if (node, digest) not in self.children:
                    self.children[node, digest] = len(self.parents)
                    self.parents.append(node)
                    self.depths.append(depth)
                node = self.children[node, digest]

    def shard(self, path: tuple[bytes, ...], conv: int) -> int:
        return bisect_right(self.splitters, (path, conv))

    def totals(self, found: dict[int, tuple]) -> list[tuple]:
        """Rows of the skeleton nodes, from the reduced (n, conv, children, leaves, saved, chars) of each.

        Nodes come after their parents, so one pass backwards sums the subtrees.
        """
        rows = [list(found[i]) if i in found else [0, None, 0, 0, 0, 0] for i in range(len(self.parents))]
        for i in reversed(range(len(rows))):
            row = rows[i]
            if row[1] is None:
                continue
            row[3] = row[3] if row[2] else 1
            row[4] += (row[0] - 1) * row[5]
            if i:
                above = rows[self.parents[i]]
                above[0] += row[0]
                above[1] = row[1] if above[1] is None else min(above[1], row[1])
                above[2] += 1
                above[3] += row[3]
                above[4] += row[4]
        at = lambda i: rows[self.parents[i]][1] if i else None
        return [(i, r[1], self.depths[i], at(i), r[0], r[2], r[3], r[4]) for i, r in enumerate(rows) if r[1] is not None]


def _shared(a: tuple[bytes, ...], b: tuple[bytes, ...]) -> int:
    """Turns at the beginning that two paths share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class _Open:
    """A node on the path that is being walked."""

    __slots__ = ("sid", "conv", "n", "children", "leaves", "saved", "chars", "ends", "below")

    def __init__(self, sid: int, chars: int):
        self.sid, self.chars = sid, chars
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.below: list[list] = []

    def add(self, conv: int, n: int, children: int, leaves: int, saved: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved


def walk(rows: list[tuple[tuple[bytes, ...], int, list[int], bool]], skeleton: Skeleton, shard: int) -> list[list]:
    """Rows of ``NODE`` for the nodes of one shard; ``rows`` are (path, conversation, lengths, goes on alone)."""
    out: list[list] = []
    if not rows:
        return out
    stack, before = [_Open(0, 0)], ()

    def close() -> None:
        node, depth = stack.pop(), len(stack)
        if node.sid >= 0:
            numbers = [node.n, node.children, node.leaves, node.saved, node.chars]
            for part in range(0, max(1, len(node.ends)), PIECE):
                piece = node.ends[part : part + PIECE]
                out.append([node.sid, (shard << 32) + part, node.conv, depth, None, None, *(numbers if not part else [0] * 4 + [node.chars]), piece])
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.chars
        row = [None, None, node.conv, depth, None, None, node.n, node.children, leaves, saved, node.chars, node.ends]
        out.append(row)
        for child in node.below:
            child[4] = node.conv
        above = stack[-1]
        above.add(node.conv, node.n, 1, leaves, saved)
        if above.sid >= 0:
            row[5] = above.sid
        else:
            above.below.append(row)

    for path, conv, lengths, goes_on in sorted(rows):
        shared = _shared(before, path)
        while len(stack) > shared + 1:
            close()
        for digest, chars in zip(path[shared:], lengths[shared:], strict=True):
            above = stack[-1].sid
            stack.append(_Open(skeleton.children.get((above, digest), -1) if above >= 0 else -1, chars))
        end = stack[-1]
        # What goes on alone is one child with one leaf below.
        end.add(conv, 1, int(goes_on), int(goes_on), 0)
        if not goes_on:
            end.ends.append(conv)
        before = path
    while stack:
        close()
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame, shard_nodes: int = SHARD, alone: int = ALONE) -> Trie:
    """The trie of conversations: ``turns`` (conv_id, depth from 1, digest, chars), ``convs`` (conv_id, length)."""
    spark = turns.sparkSession
    cuts = stage(lonely(turns, convs, alone), "cuts")
    cut_at = attach(turns, cuts, ["conv_id"], "left")
    kept = cut_at.filter("cut is null or depth <= cut").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("depth", "digest", "chars"))).alias("path")
    )
    told = convs.select("conv_id").join(kept, "conv_id", "left").join(cuts.select("conv_id", "cut"), "conv_id", "left")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    paths = stage(told.select(
        "conv_id", F.coalesce(F.col("path.digest"), empty("binary")).alias("path"),
        F.coalesce(F.col("path.chars"), empty("bigint")).alias("chars"), F.col("cut").isNotNull().alias("goes_on"),
    ), "paths")

    weight = paths.agg(F.sum(F.size("path") + 1).alias("nodes"), F.count("*").alias("convs")).first()
    shards = max(1, min(MOST_SHARDS, -(-(weight["nodes"] or 0) // shard_nodes)))
    chosen = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 52)) < F.lit(min(1.0, SAMPLES * shards / max(1, weight["convs"])) * (1 << 52))
    sample = paths.filter(chosen).select("path", "conv_id").collect() if shards > 1 else []
    skeleton = Skeleton([(tuple(map(bytes, r["path"])), r["conv_id"]) for r in sample], shards)
    shared = spark.sparkContext.broadcast(skeleton)

    found = stage(_dealt(paths, shared).groupBy("shard").applyInArrow(_walk_shard(shared), NODE), "nodes")
    partial = found.filter("sid is not null")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    reduced = partial.groupBy("sid").agg(*sums, F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"))
    # As many rows as the skeleton has nodes, which is broadcast already.
    by_node = {r["sid"]: (r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved"], r["chars"]) for r in reduced.collect()}
    top = spark.createDataFrame(
        skeleton.totals(by_node), "sid long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long"
    )
    above = top.select(F.col("sid").alias("parent_sid"), F.col("conv_id").alias("above"))
    local = found.filter("sid is null").join(F.broadcast(above), "parent_sid", "left")
    local = local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*COLUMNS, "ends")
    tails = attach(turns, cuts, ["conv_id"], "inner").filter("depth > cut").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved"), F.when(F.col("depth") == F.col("length"), F.array("conv_id")).otherwise(empty("bigint")).alias("ends"),
    )
    nodes = local.unionByName(tails).unionByName(top.select(*COLUMNS, F.lit(None).cast("array<bigint>").alias("ends")))
    pieces = partial.filter(F.size("ends") > 0).select("sid", "part", "ends").join(F.broadcast(top.select("sid", "conv_id", "depth")), "sid").drop("sid")
    return Trie(nodes, pieces)


def _dealt(paths: DataFrame, shared) -> DataFrame:
    """Paths with the shard between whose splitters they lie."""
    schema = "shard long, conv_id long, path array<binary>, chars array<bigint>, goes_on boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
            keys = zip(get("path").to_pylist(), get("conv_id").to_pylist(), strict=True)
            shards = pa.array([shared.value.shard(tuple(path), conv) for path, conv in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([shards, *map(get, names[1:])], names=names)

    names = ["shard", "conv_id", "path", "chars", "goes_on"]
    return paths.mapInArrow(run, schema)


def _walk_shard(shared):
    arrow = to_arrow_schema(T.StructType.fromDDL(NODE))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = zip(map(tuple, table["path"].to_pylist()), table["conv_id"].to_pylist(), table["chars"].to_pylist(), table["goes_on"].to_pylist(), strict=True)
        made = walk(list(rows), shared.value, key[0].as_py())
        columns = zip(*made, strict=True) if made else [[] for _ in arrow]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return run


def joined_digest(pieces: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of each node's ids, comma-joined over its pieces in order.

    Pieces stream through a hash in sorted order, so a node's list is never held whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                text = ",".join(map(str, row["ends"])).encode()
                if node != (row["conv_id"], row["depth"]):
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (row["conv_id"], row["depth"]), hashlib.sha256(text)
                else:
                    digest.update(b"," + text)
            if done:
                yield _records(done)
        if node is not None:
            yield _records([(*node, digest.hexdigest())])

    def _records(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "ends_sha256"])

    ordered = pieces.select("conv_id", "depth", "part", "ends").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part")
    return ordered.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def ends_text(ends: Column | str) -> Column:
    return F.array_join(F.transform(ends, lambda c: c.cast("string")), ",")
