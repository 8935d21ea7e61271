"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector to the cells of some random projections (normal components, so
distances are Euclidean). A neighbour at distance r falls into a cell next to the query's with a
probability that follows from the query's place between the cell's walls; buckets are
visited from the likeliest down, best first over the cells of all projections, until the visited ones
hold the neighbour with the probability that brings all tables together to ``RECALL``. The first distance r
and the number of projections (about ``BUCKET`` rows a bucket, were they even) follow from the data. A query
whose k-th found row lies beyond r is visited again with that distance as its own r. A query that
would need more probes than a scan costs, or has found fewer than k rows, is compared with every row.

Every row is indexed. A slice holds some ``SLICE`` rows: small buckets share one by the hash of their
bucket, larger ones are cut by the hash of the row, so no task holds an unbounded bucket. Each
slice gives out the nearest rows of each of its queries by exact distance, so candidates
are never listed; tables are merged and ranked by query.

Of equal vectors only the rows with the smallest ids can be among the nearest (ties go to the smaller
id, and a query leaves out only itself), so the index keeps the first ``k + 1`` of them: the result
is the same. Vectors that are NULL, zero, or hold a NULL, NaN or infinite component take no part, nor do
rows without an id. Vectors of different lengths are searched apart.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwork.llm.common import free_name
from tillwork.staging import attach, stage

TABLES = 4
RECALL = 0.96
BUCKET = 1024
SLICE = 20_000
SAMPLE = 20_000
SAMPLE_QUERIES = 200
MOST_PROJECTIONS = 14  # the probability at r is reached within some 30,000 probes
MOST_PROBES = 1 << 16  # beyond them a query is compared with every row
PROBE_ROWS = 100  # a probe costs about as much as the distances to so many rows
_CELLS = 6  # cells to either side; beyond them a neighbour is unlikely
_BLOCK = 1 << 22  # components compared at once


@dataclass
class Hashing:
    """Projections of all tables: ``directions`` (table, dimension, projection), ``shifts`` (table, projection)."""

    directions: np.ndarray
    shifts: np.ndarray
    width: float
    radius: float

    def places(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return vectors @ self.directions[table] + self.shifts[table]

    def codes(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return code_of(np.floor(self.places(vectors, table) / self.width).astype(np.int64))


def code_of(cells: np.ndarray) -> np.ndarray:
    """One number for the cells of all projections."""
    code = np.zeros(len(cells), np.uint64)
    for j in range(cells.shape[1]):
        code = (code ^ cells[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code.view(np.int64)


def probes(place: np.ndarray, width: float, radius: float, enough: float, most: int = MOST_PROBES) -> np.ndarray | None:
    """Cells to visit, likeliest first, until they hold a neighbour at ``radius`` with probability ``enough``.

    None if ``most`` cells do not hold it.
    """
    if not math.isfinite(radius):
        return None
    home = np.floor(place / width).astype(np.int64)
    cells = home[:, None] + np.arange(-_CELLS, _CELLS + 1)
    wall = lambda edge: np.array([[0.5 * (1 + math.erf(x / math.sqrt(2))) for x in row] for row in ((edge * width - place[:, None]) / radius).tolist()])
    chance = np.maximum(wall(cells + 1) - wall(cells), 1e-300)
    order = np.argsort(-chance, axis=1, kind="stable")
    cells, chance = np.take_along_axis(cells, order, 1), np.take_along_axis(chance, order, 1)
    if chance.sum(axis=1).prod() < enough:
        return None
    logs = np.log(chance).tolist()
    n, found, mass = len(logs), [], 0.0
    # Each state is reached once: a step raises the last raised projection or one after it.
    heap = [(-sum(row[0] for row in logs), 0, (0,) * n)]
    while heap and mass < enough and len(found) < most:
        cost, last, state = heapq.heappop(heap)
        found.append(state)
        mass += math.exp(-cost)
        for j in range(last, n):
            if state[j] < 2 * _CELLS:
                step = logs[j][state[j]] - logs[j][state[j] + 1]
                heapq.heappush(heap, (cost + step, j, (*state[:j], state[j] + 1, *state[j + 1 :])))
    if mass < enough:
        return None
    picked = np.array(found)
    return np.take_along_axis(cells.T, picked, 0)


def _fit(rows: DataFrame, n: int, dim: int, k: int, seed: int) -> Hashing:
    """Radius from the distances of a bounded sample, number of projections from the number of rows."""
    sampled = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / n) * (1 << 20)))
    sample = np.array([r.v for r in sampled.limit(2 * SAMPLE).collect()], np.float64).reshape(-1, dim)
    if not len(sample):
        sample = np.array([r.v for r in rows.limit(1).collect()], np.float64).reshape(-1, dim)
    rank = max(1, round(k * len(sample) / n))
    near = []
    for q in sample[:: max(1, len(sample) // SAMPLE_QUERIES)]:
        d = np.sqrt(((sample - q) ** 2).sum(axis=1))
        near.append(np.partition(d, min(rank, len(d) - 1))[min(rank, len(d) - 1)])
    near = [x for x in near if x > 0]
    radius = float(np.median(near)) if near else 1.0
    count = min(MOST_PROJECTIONS, max(1, round(math.log2(max(2.0, n / BUCKET)))))
    rng = np.random.default_rng(seed)
    width = 2.0 * radius
    return Hashing(rng.normal(size=(TABLES, dim, count)), rng.uniform(0, width, (TABLES, count)), width, radius)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _index(rows: DataFrame, hashing: Hashing, dim: int) -> DataFrame:
    """A row per vector and table: ``t``, ``code``, ``id``, ``v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column("v"), dim)
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(hashing.codes(v, t)), batch.column("id"), batch.column("v")], names=["t", "code", "id", "v"])

    return rows.mapInArrow(run, "t int, code long, id long, v array<double>")


def _visits(queries: DataFrame, hashing: Hashing, dim: int, enough: float, most: int) -> DataFrame:
    """A row per query, table and visited bucket: ``t``, ``code``, ``id``; queries have their ``radius``.

    A query that ``most`` buckets of a table do not cover has one row, with ``t`` -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, ids, radii = _vectors(batch.column("v"), dim), batch.column("id").to_numpy(), batch.column("radius").to_numpy()
            places = [hashing.places(v, t) for t in range(TABLES)]
            for i, radius in enumerate(radii.tolist()):
                cells: list[np.ndarray] = []
                for t in range(TABLES):
                    if (found := probes(places[t][i], hashing.width, radius, enough, most)) is None:
                        break
                    cells.append(found)
                codes = [np.unique(code_of(c)) for c in cells] if len(cells) == TABLES else [np.zeros(1, np.int64)]
                tables = np.arange(TABLES, dtype=np.int32) if len(cells) == TABLES else np.full(1, -1, np.int32)
                flat = np.concatenate(codes)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(tables, [len(c) for c in codes])), pa.array(flat), pa.array(np.full(len(flat), ids[i]))], names=["t", "code", "id"])

    return queries.mapInArrow(run, "t int, code long, id long")


def _nearest_here(k: int, dim: int, visits: pa.Table, rows: pa.Table) -> pa.Table:
    """The nearest rows of each query within one slice, by exact distance."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if visits.num_rows and rows.num_rows:
        v, ids = _vectors(rows.column("v").combine_chunks(), dim), rows.column("id").to_numpy()
        buckets, bucket = np.unique(rows.column("code").to_numpy(), return_inverse=True)
        q, q_ids = _vectors(visits.column("v").combine_chunks(), dim), visits.column("id").to_numpy()
        for i, codes in enumerate(visits.column("codes").to_pylist()):
            seen = np.isin(buckets, codes)[bucket] & (ids != q_ids[i])
            at = np.flatnonzero(seen)
            if not len(at):
                continue
            step = max(1, _BLOCK // dim)
            d = np.concatenate([np.sqrt(((v[at[j : j + step]] - q[i]) ** 2).sum(axis=1)) for j in range(0, len(at), step)])
            if len(d) > k:
                near = d <= np.partition(d, k - 1)[k - 1]
                at, d = at[near], d[near]
            order = np.lexsort((ids[at], d))[:k]
            found.append((np.full(len(order), q_ids[i]), ids[at][order], d[order]))
    query, near, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"query_id": query, "vec_id": near, "score": score})


def _search(rows: DataFrame, queries: DataFrame, n: int, dim: int, k: int, recall: float, seed: int) -> DataFrame:
    """Rows and queries have ``id`` and ``v``; all vectors have ``dim`` components."""
    hashing = _fit(rows, n, dim, k, seed)
    enough = 1 - (1 - recall) ** (1 / TABLES)
    same = Window.partitionBy("v").orderBy("id")
    first = rows.withColumn("copy", F.dense_rank().over(same)).filter(F.col("copy") <= k + 1).select("id", "v")
    index = stage(_index(first, hashing, dim), "index")
    most = max(1, min(MOST_PROBES, n // (TABLES * PROBE_ROWS)))
    queries = stage(queries, "queries")
    # Buckets of more than a slice are cut; there are fewer of them than rows over SLICE.
    large = index.groupBy("t", "code").count().filter(F.col("count") > SLICE).select("t", "code", F.ceil(F.col("count") / SLICE).alias("cuts"))
    large = stage(large, "large")
    shared = max(1, math.ceil(n / SLICE))
    unit = lambda cut: F.when(F.col("cuts").isNull(), F.pmod(F.xxhash64("code"), F.lit(shared))).otherwise(F.xxhash64("code", cut))
    cut_rows = attach(index, large, ["t", "code"], "left").withColumn("unit", unit(F.pmod(F.xxhash64("id"), F.col("cuts"))))
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("cuts"), F.lit(1)) - 1))
    result = "query_id long, vec_id long, score double"

    def by_buckets(visits: DataFrame) -> DataFrame:
        cut_visits = attach(visits.filter("t >= 0"), large, ["t", "code"], "left").withColumn("cut", cuts).withColumn("unit", unit(F.col("cut")))
        listed = cut_visits.groupBy("t", "unit", "id").agg(F.collect_set("code").alias("codes")).join(queries, "id")
        near = (
            listed.groupBy("t", "unit").cogroup(cut_rows.select("t", "unit", "code", "id", "v").groupBy("t", "unit"))
            .applyInArrow(lambda a, b: _nearest_here(k, dim, a, b), result)
        )
        return near.dropDuplicates(["query_id", "vec_id"])

    def by_scan(asked: DataFrame) -> DataFrame:
        """Every row against every query, in squares of a slice of rows and a slice of queries."""
        blocks = max(1, math.ceil(asked.count() / SLICE))
        numbers = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
        of = lambda size: F.pmod(F.xxhash64("id"), F.lit(size)).cast("int")
        q = asked.join(queries, "id").select("id", "v", F.array(F.lit(0).cast("long")).alias("codes"), of(blocks).alias("block"), numbers(shared).alias("cut"))
        r = index.filter("t = 0").select("id", "v", F.lit(0).cast("long").alias("code"), numbers(blocks).alias("block"), of(shared).alias("cut"))
        return q.groupBy("cut", "block").cogroup(r.groupBy("cut", "block")).applyInArrow(lambda a, b: _nearest_here(k, dim, a, b), result)

    visits = stage(_visits(queries.withColumn("radius", F.lit(hashing.radius)), hashing, dim, enough, most), "visits")
    near = stage(by_buckets(visits), "near")
    # The k-th distance found bounds the true one: what it does not exceed is covered already.
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score"))
    reached = near.withColumn("order", order).filter(F.col("order") == k).select(F.col("query_id").alias("id"), F.col("score").alias("radius"))
    scanned = visits.filter("t < 0").select("id")
    wider = queries.join(scanned, "id", "left_anti").join(reached, "id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
    further = stage(_visits(wider.filter(F.col("radius") > hashing.radius), hashing, dim, enough, most), "visits")
    scanned = stage(scanned.union(further.filter("t < 0").select("id")), "scanned")
    return near.unionByName(by_buckets(further)).unionByName(by_scan(scanned)).dropDuplicates(["query_id", "vec_id"])


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL, seed: int = 5
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (Euclidean distance) of each query's ``k`` nearest found."""
    def usable(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector), lambda x: x.cast("double"))
        good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        # Adding zero makes -0.0 and 0.0 one value.
        return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & good)

    rows, asked = usable(vectors), usable(queries)
    sizes = {r[0]: r[1] for r in rows.groupBy(F.size("v")).count().collect()}  # a row per vector length
    found = None
    for dim, n in sorted(sizes.items()):
        of = lambda df, dim=dim: df.filter(F.size("v") == dim)
        part = _search(of(rows), of(asked).dropDuplicates(["id"]), n, dim, k, recall, seed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn(free_name(found, "rank"), rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
