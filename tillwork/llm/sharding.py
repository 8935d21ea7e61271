"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells. Every shard owns ``nodes`` virtual nodes, placed by the hash of their
name; a document's cell is the hash of its id, and its home is the next virtual node clockwise. A
shard takes at most its capacity: the number of documents over the number of shards, one more in the
first shards while there is a remainder. Documents that find their home full continue clockwise to
the next virtual node with room. Since capacities add up to the number of documents, all shards are
filled and counts differ by one at most (law ``rows``).

Who overflows is decided by counts per cell alone: the driver gets ``CELLS`` numbers, whatever the
size of the table, and works out which run of places in a cell goes to which shard. Documents are
then numbered within their cell, so no task ranks a whole shard. A change of shards moves the
documents of the arcs it takes and those that overflow.

NULL texts have size 1. A NULL id is hashed like an empty text. Equal rows are interchangeable.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.llm.common import free_name

SHARDS = 16
NODES = 128
CELLS = 8192
RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def node_cells(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise."""
    place = lambda s, v: int.from_bytes(hashlib.md5(f"{s}:{v}".encode()).digest()[:6]) % CELLS
    return sorted((place(s, v), s) for s in range(shards) for v in range(nodes))


def cell_of(key: Column) -> Column:
    """Ring cell of a key: the first 12 hex digits of the md5 of its text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % CELLS).cast("int")


def plan(counts: dict[int, int], shards: int, nodes: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first place, end place, shard, first slot): where the documents of each cell go.

    First every shard takes from its own arcs, cell by cell; what is left then walks clockwise.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    ring = node_cells(shards, nodes)
    cells = [c for c, _ in ring]
    filled = [0] * shards
    runs: list[tuple[int, int, int, int, int]] = []
    waiting = []

    def put(cell: int, first: int, end: int, shard: int) -> int:
        taken = min(end - first, room[shard] - filled[shard])
        if taken > 0:
            runs.append((cell, first, first + taken, shard, filled[shard]))
            filled[shard] += taken
        return first + max(0, taken)

    for cell in sorted(counts):
        home = bisect_left(cells, cell) % len(ring)
        first = put(cell, 0, counts[cell], ring[home][1])
        if first < counts[cell]:
            waiting.append((cell, first, home))
    for cell, first, home in waiting:
        step = 1
        while first < counts[cell]:
            first = put(cell, first, counts[cell], ring[(home + step) % len(ring)][1])
            step += 1
    return runs


def shard_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, nodes: int = NODES, keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all if None) plus ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    Columns of the documents that have one of these names are left out.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULT]
    cell, place = free_name(docs, "_cell"), free_name(docs, "_place")
    placed = docs.withColumn(cell, cell_of(F.col(key)))
    counts = {r[cell]: r["count"] for r in placed.groupBy(cell).count().collect()}  # at most CELLS rows
    runs = spark.createDataFrame(plan(counts, shards, nodes), "run_cell int, run_first long, run_end long, shard int, first_slot long")
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sized = placed.select(
        *[F.col(c) for c in keep], F.col(cell), F.col(key).alias(free_name(docs, "_key")),
        (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"),
    )
    order = Window.partitionBy(cell).orderBy(F.md5(F.coalesce(F.col(free_name(docs, "_key")).cast("string"), F.lit("")).cast("binary")), "text_crc32", "size")
    numbered = sized.withColumn(place, F.row_number().over(order).cast("long") - 1)
    # Runs: at most CELLS plus one per shard and cell that overflows, bounded by the ring and not by the data.
    here = (F.col(cell) == F.col("run_cell")) & (F.col(place) >= F.col("run_first")) & (F.col(place) < F.col("run_end"))
    return numbered.join(F.broadcast(runs), here).select(
        *keep, "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("first_slot") + F.col(place) - F.col("run_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
