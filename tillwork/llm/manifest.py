"""Merkle manifest of a dataset: a tree per group of rows, a tree over the groups, a proof for every row.

A row's leaf is the SHA-256 of its named columns, each with its length. Leaves of a group (a language)
ascend by id; while there are several nodes, every ``fanout`` consecutive ones become the SHA-256 of
their hex texts, the last run also when it is shorter. The tops of the groups make the upper tree alike.

Method: a butterfly exchange. The leaves are dealt into aligned blocks of ``block`` leaves (a power of the
fanout), each hashed to its subtree's root by itself. Then, round by round, the blocks of ``fanout``
neighbouring subtrees send their roots to each other: every block sends to the blocks at its own place in
the sibling subtrees, receives one root from each, and hashes the common parent itself. So all blocks
below a node work out the same hash, and each has gathered the siblings on its way up: after the last
round it owns its upper proof, and nothing has to be passed down again. A block in a short last subtree sends to
several blocks of a longer sibling. A round shuffles ``fanout`` rows a block and is written to the shared folder.

Results in special cases: NULL is a value of its own in every hashed column, a NULL id comes first and a
NULL group is a group. Rows with equal ids are ordered by their leaves; equal rows are neighbours with a
proof each. Columns that are not named are ignored, whatever their names. Empty and very long texts are
hashed like others, in the engine. An empty table has no rows in its manifest and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillwork.llm.places import numbered
from tillwork.staging import attach, stage

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK = 4096
PROOF = "array<struct<left: string, right: string>>"


def leaf_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 of the values in order: ``-`` for NULL, else length in UTF-8 bytes, a colon, the text."""
    def framed(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def _parents(nodes: list[bytes], fanout: int) -> list[bytes]:
    return [hashlib.sha256(b"".join(nodes[i : i + fanout])).hexdigest().encode() for i in range(0, len(nodes), fanout)]


def _levels(leaves: list[bytes], fanout: int, height: int) -> list[list[bytes]]:
    """The nodes of a block on each level, leaves first."""
    levels = [leaves]
    for _ in range(height):
        levels.append(_parents(levels[-1], fanout))
    return levels


def _height(nodes: int, fanout: int) -> int:
    """Levels above that many nodes until one is left."""
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // fanout), height + 1
    return height


def _blocks(leaves: DataFrame, fanout: int, block: int) -> DataFrame:
    """One row per block: its leaves in order (64 bytes each), their rows' values, and the root of its subtree."""
    most = _height(block, fanout)

    def hash_block(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        found = [h.encode() for h in rows.column("leaf").to_pylist()]
        height = min(most, _height(rows.column("size")[0].as_py(), fanout))
        root = _levels(found, fanout, height)[-1][0].decode()
        out = {
            "tree": [rows.column("tree")[0].as_py()], "block": [key[1].as_py()], "size": [rows.column("size")[0].as_py()],
            "leaves": [b"".join(found)], "rows": [rows.column("row").to_pylist()], "node": [root],
        }
        return pa.Table.from_pydict(out, schema=arrow)

    schema = f"tree long, block long, size long, leaves binary, rows array<{leaves.schema['row'].dataType.simpleString()}>, node string"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    cut = leaves.withColumn("block", F.expr(f"place div {block}"))
    return cut.groupBy("tree", "block").applyInArrow(hash_block, schema)


def _siblings(first: Column, end: Column, step: int) -> Column:
    """The (first, end) of the subtrees of ``step`` blocks in the range."""
    return F.transform(F.sequence(first, end - 1, F.lit(step)), lambda lo: F.struct(lo.alias("first"), F.least(lo + step, end).alias("end")))


def _exchange(blocks: DataFrame) -> DataFrame:
    """One round: roots go to the blocks of the sibling subtrees, which hash the parent.

    ``blocks`` has ``at`` (the block's number), ``node``, ``proof``, ``first`` and ``end`` (the blocks below
    its node) and ``group`` (those of the node's siblings and itself, in order; NULL: nothing to do).
    A block's row reaches itself with all it carries, so a round is one shuffle.
    """
    own, blocks_below = F.col("at") - F.col("first"), F.col("end") - F.col("first")

    def receivers(sibling: Column) -> Column:
        n = sibling["end"] - sibling["first"]
        places = F.sequence(F.least(own, n - 1), n - 1, blocks_below)
        return F.transform(F.filter(places, lambda p: p % blocks_below == own), lambda p: sibling["first"] + p)

    targets = F.when(F.col("group").isNull(), F.array("at")).otherwise(F.flatten(F.transform("group", receivers)))
    carried = [c for c in blocks.columns if c not in ("at", "node")]
    sent = blocks.withColumn("to", F.explode(targets)).select(
        "to", F.struct("first", "node").alias("part"), F.when(F.col("to") == F.col("at"), F.struct(*carried)).alias("own")
    )
    met = sent.groupBy("to").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.max("own").alias("own"))

    def text(keep) -> Column:
        return F.array_join(F.transform(F.filter("parts", keep), lambda p: p["node"]), "")

    active = F.col("own.group").isNotNull()
    step = F.struct(text(lambda p: p["first"] < F.col("own.first")).alias("left"), text(lambda p: p["first"] > F.col("own.first")).alias("right"))
    values = {
        "proof": F.when(active, F.concat("own.proof", F.array(step))).otherwise(F.col("own.proof")),
        "first": F.when(active, F.get("own.group", F.lit(0))["first"]).otherwise(F.col("own.first")),
        "end": F.when(active, F.element_at("own.group", -1)["end"]).otherwise(F.col("own.end")),
    }
    node = F.when(active, F.sha2(text(lambda p: F.lit(True)), 256)).otherwise(F.get("parts", F.lit(0))["node"])
    return met.select(F.col("to").alias("at"), node.alias("node"), *[values.get(c, F.col(f"own.{c}")).alias(c) for c in carried])


def _upper(blocks: DataFrame, trees: DataFrame, fanout: int) -> DataFrame:
    """(tree, block, subroot, root, proof) of every block, by rounds of the exchange.

    ``trees`` has ``tree`` (numbered in order), ``blocks`` and ``start``, the number of its first block.
    """
    bounds = trees.agg(F.max("blocks").alias("blocks"), F.count("*").alias("trees")).first()
    state = attach(blocks.select("tree", "block", "node"), trees, ["tree"], "inner")
    at = F.col("start") + F.col("block")
    state = stage(state.select(
        at.alias("at"), "node", "tree", "block", "start", (F.col("start") + F.col("blocks")).alias("stop"),
        F.array().cast(PROOF).alias("proof"), at.alias("first"), (at + 1).alias("end"),
    ), "butterfly")
    width = 1
    for _ in range(_height(bounds["blocks"] or 0, fanout)):
        low = F.col("start") + F.expr(f"block div {width * fanout}") * (width * fanout)
        group = F.when(F.col("stop") - F.col("start") > width, _siblings(low, F.least(low + width * fanout, F.col("stop")), width))
        state = stage(_exchange(state.withColumn("group", group)).drop("group"), "butterfly")
        width *= fanout
    state = state.withColumn("subroot", F.col("node"))
    width, n = 1, bounds["trees"]
    while width < n:
        # Where the subtrees of ``width`` trees begin: the block number of their first trees.
        edges = trees.filter(F.col("tree") % width == 0).select(F.expr(f"tree div {width * fanout}").alias("run"), F.col("start").alias("edge"))
        stops = trees.groupBy(F.expr(f"tree div {width * fanout}").alias("run")).agg(F.max(F.col("start") + F.col("blocks")).alias("last"))
        runs = edges.groupBy("run").agg(F.array_sort(F.collect_list("edge")).alias("edges")).join(stops, "run")
        pairs = F.arrays_zip(F.col("edges").alias("first"), F.concat(F.slice("edges", 2, fanout), F.array("last")).alias("end"))
        runs = runs.select("run", F.transform(pairs, lambda p: F.struct(p["first"].alias("first"), p["end"].alias("end"))).alias("group"))
        grouped = attach(state.withColumn("run", F.expr(f"tree div {width * fanout}")), runs, ["run"], "inner").drop("run")
        state = stage(_exchange(grouped).drop("group"), "butterfly")
        width *= fanout
    return state.select("tree", "block", "subroot", F.col("node").alias("root"), "proof")


def build_manifest(leaves: DataFrame, fanout: int = 2, block: int = BLOCK, group: str = "group", order: str = "id") -> DataFrame:
    """Proofs for rows that have a ``leaf``, a ``group``, an ``order`` column and a ``row`` struct to be kept.

    Returns ``row``, ``leaf``, ``subroot``, ``root`` and ``proof``: per level from the leaf up, the hex
    texts of the siblings on the left and on the right, each joined.
    """
    if fanout < 2 or fanout ** _height(block, fanout) != block:
        raise ValueError("a block must be a power of the fanout")
    placed = numbered(leaves.select(group, order, "leaf", "row"), [group], [order, "leaf"])
    sizes = placed.filter("place = 0").select(F.col(group).alias("name"), "size")
    sizes = numbered(sizes, [], ["name"], place="tree", size="trees").drop("trees")
    blocks_of = F.expr(f"(size + {block - 1}) div {block}")
    # Starts of the trees: sums over the trees before, cut into runs so that no task holds all of them.
    parts = sizes.select("tree", "name", blocks_of.alias("blocks"), F.expr("tree div 1024").alias("run"))
    totals = parts.groupBy("run").agg(F.sum("blocks").alias("in_run"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("run", F.coalesce(F.sum("in_run").over(earlier), F.lit(0)).alias("offset"))
    here = Window.partitionBy("run").orderBy("tree").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("blocks").over(here), F.lit(0))
    trees = stage(parts.join(totals, "run").select("tree", "name", "blocks", start.alias("start")), "trees")

    key = lambda c: F.to_json(F.struct(F.col(c).alias("g")), {"ignoreNullFields": "false"})
    names = trees.select(key("name").alias("_key"), "tree")
    rows = attach(placed.withColumn("_key", key(group)), names, ["_key"], "inner").select("tree", "place", "size", "leaf", "row")
    blocks = stage(_blocks(rows, fanout, block), "blocks")
    upper = stage(_upper(blocks, trees.drop("name"), fanout), "upper")
    known = attach(blocks.drop("node"), upper, ["tree", "block"], "inner")
    return _with_proofs(known, fanout, block)


def _with_proofs(blocks: DataFrame, fanout: int, block: int) -> DataFrame:
    """The rows of each block with their proofs: inside the block, then the block's own."""
    most, at_once = _height(block, fanout), 256
    kind = blocks.schema["rows"].dataType.elementType.simpleString()
    schema = f"row {kind}, leaf string, subroot string, root string, proof {PROOF}"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            get = lambda c, one=one: one.column(one.schema.get_field_index(c))[0]
            packed, rows = get("leaves").as_py(), get("rows").values
            leaves = [packed[i : i + 64] for i in range(0, len(packed), 64)]
            levels = _levels(leaves, fanout, min(most, _height(get("size").as_py(), fanout)))
            steps: list[list[dict]] = []
            for level in levels[:-1]:
                texts = [n.decode() for n in level]
                steps.append([
                    {"left": "".join(texts[i - i % fanout : i]), "right": "".join(texts[i + 1 : i - i % fanout + fanout])}
                    for i in range(len(texts))
                ])
            above, subroot, root = get("proof").as_py(), get("subroot").as_py(), get("root").as_py()
            for low in range(0, len(leaves), at_once):
                these = range(low, min(low + at_once, len(leaves)))
                proofs = [[level[i // fanout**h] for h, level in enumerate(steps)] + above for i in these]
                n = len(these)
                yield pa.RecordBatch.from_arrays([
                    rows.slice(low, n).cast(arrow.field("row").type), pa.array([leaves[i].decode() for i in these]),
                    pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs, type=arrow.field("proof").type),
                ], schema=arrow)

    return blocks.mapInArrow(run, schema)


def merkle_manifest(docs: DataFrame, fanout: int = 2, block: int = BLOCK, tampered: Column | None = None) -> DataFrame:
    """Per document: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof`` and ``seen_leaf``.

    ``seen_leaf`` is the leaf of the row as it would be seen by a reader: of ``n_chars`` plus 1 where
    ``tampered`` holds, else of the row itself. Texts are hashed in their scan and never shuffled.
    """
    columns = [F.col(c) for c in COLUMNS]
    changed = [F.col(c).cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]
    leaf = leaf_hash(columns)
    seen = F.when(tampered, leaf_hash(changed)).otherwise(leaf) if tampered is not None else leaf
    narrow = docs.select(
        F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf.alias("leaf"),
        F.struct(F.col("doc_id"), seen.alias("seen_leaf")).alias("row"),
    )
    made = build_manifest(narrow, fanout, block)
    return made.select("row.doc_id", "leaf", "subroot", "root", "proof", "row.seen_leaf")
