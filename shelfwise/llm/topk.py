"""Exact search of the k largest inner products, by ball trees over shards."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.runtime import staged

K = 10
SCALE = 1024
QUERY_STEP = 100
# Rows of a shard, and vectors in a leaf of its tree.
SHARD_ROWS = 4096
LEAF = 64
# Centres of cells are fitted on so many vectors at most, picked by a hash; every vector is then assigned.
SAMPLE = 4096
MOST_CELLS = 256
# Bounds are floats: they are raised by this share, so that rounding never hides a row.
SLACK = 1e-9
LONG = np.iinfo(np.int64)

ROW = "cell int, part int, asks boolean, query_id long, twin string, v array<long>, ids array<struct<id:long>>, bound long"
HIT = "query_id long, twin string, vec_id long, score long"
HIT_SCHEMA = pa.schema([("query_id", pa.int64()), ("twin", pa.string()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(lists: pa.ListArray, width: int = 0) -> np.ndarray:
    """Rows of numbers; shorter vectors are filled with zeros."""
    lengths = np.asarray(lists.value_lengths())
    width = max(width, int(lengths.max(initial=0)))
    made = np.zeros((len(lists), width), dtype=np.int64)
    made[np.arange(width) < lengths[:, None]] = np.asarray(lists.flatten())
    return made


def _widen(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1]))) if vectors.shape[1] < width else vectors


def _products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products; what no long can hold becomes the nearest long."""
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (vectors, query)]
    bound = most[0] * most[1] * max(1, vectors.shape[1])
    if bound < 1 << 53:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if bound <= LONG.max:
        return vectors @ query
    exact = vectors.astype(object) @ query.astype(object)
    return np.array([min(max(x, LONG.min), LONG.max) for x in exact], dtype=np.int64)


class BallTree:
    """A ball tree over different integer vectors; each has the ids of the rows that hold it."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int | None]]) -> None:
        points = vectors.astype(np.float64)
        order = np.arange(len(points))
        # Slices of `order` are halved until they fit a leaf; children come after their parents.
        self.slices, self.children, centres, radii = [(0, len(points))], [], [], []
        for low, high in self.slices:
            inside = points[order[low:high]]
            centre = inside.mean(axis=0)
            away = np.linalg.norm(inside - centre, axis=1)
            centres.append(centre)
            radii.append(away.max(initial=0.0))
            if high - low <= LEAF:
                self.children.append(())
                continue
            one = inside[away.argmax()]
            other = inside[np.linalg.norm(inside - one, axis=1).argmax()]
            middle = (high - low) // 2
            order[low:high] = order[low:high][np.argpartition(inside @ (other - one), middle)]
            self.children.append((len(self.slices), len(self.slices) + 1))
            self.slices += [(low, low + middle), (low + middle, high)]
        self.vectors, self.ids = vectors[order], [ids[i] for i in order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, query: np.ndarray, own: int, k: int, bound: int) -> list[tuple[int, int | None]]:
        """(score, id) of the k best rows whose score is at least `bound`, without rows of id `own`.

        Nodes are visited by their upper bound q.centre + |q| * radius, until that is below the kth score
        found so far, here or (bound) in other shards.
        """
        best: list[tuple] = []
        limits = upper_bounds(self.centres, self.radii, query)
        heap = [(-limits[0], 0)]
        while heap and -heap[0][0] >= bound:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    if limits[child] >= bound:
                        heapq.heappush(heap, (-limits[child], child))
                continue
            low, high = self.slices[node]
            scores = _products(self.vectors[low:high], query)
            for at in np.flatnonzero(scores >= bound):
                score = -int(scores[at])
                best += [(score, i is None, i or 0) for i in self.ids[low + at] if i is None or i != own]
            if len(best) >= k:
                best = heapq.nsmallest(k, best)
                bound = max(bound, -best[-1][0])
        return [(-score, None if empty else i) for score, empty, i in heapq.nsmallest(k, best)]


def upper_bounds(centres: np.ndarray, radii: np.ndarray, query: np.ndarray) -> np.ndarray:
    """For balls: at least the largest inner product with a point inside."""
    point = query.astype(np.float64)
    length = np.linalg.norm(point)
    reach = length * (np.linalg.norm(centres, axis=1) + radii)
    return centres @ point + length * radii + SLACK * reach + 1


def _search_shards(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, part, asks): the vectors of a shard, then the queries that ask it."""
    shard, vectors, ids, tree = None, [], [], None
    for batch in batches:
        keys = list(zip(batch["cell"].to_pylist(), batch["part"].to_pylist(), batch["asks"].to_pylist(), strict=True))
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        found: list[tuple] = []
        for low, high in zip(starts, starts[1:]):
            if low == high:
                continue
            *now, asks = keys[low]
            some = batch.slice(low, high - low)
            if now != shard:
                shard, vectors, ids, tree = now, [], [], None
            if not asks:
                vectors.append(_matrix(some["v"]))
                ids += [[x["id"] for x in row] for row in some["ids"].to_pylist()]
                continue
            if not vectors:
                continue
            queries = _matrix(some["v"])
            if tree is None or tree.vectors.shape[1] < queries.shape[1]:
                width = max(queries.shape[1], *(x.shape[1] for x in vectors))
                tree = BallTree(np.concatenate([_widen(x, width) for x in vectors]), ids)
            queries = _widen(queries, tree.vectors.shape[1])
            names = zip(*(some[c].to_pylist() for c in ("query_id", "twin", "bound")), strict=True)
            for query, (query_id, twin, bound) in zip(queries, names, strict=True):
                hits = tree.search(query, query_id, k, LONG.min if bound is None else bound)
                found += [(query_id, twin, vec_id, score) for score, vec_id in hits]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*found), HIT_SCHEMA)], schema=HIT_SCHEMA
            )


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x as double, for vectors of finite numbers only."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x")
    ).where(F.forall("x", finite)).select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def _centres(rows: DataFrame, cells: int) -> np.ndarray:
    """Centres by a few rounds of k-means on a bounded sample. They decide where a row lies, never what is found."""
    taken = rows.orderBy(F.xxhash64("v")).select("v").limit(SAMPLE).collect()
    width = max((len(row.v) for row in taken), default=0)
    points = np.array([row.v + [0] * (width - len(row.v)) for row in taken], dtype=np.float64).reshape(len(taken), width)
    centres = points[:cells]
    for _ in range(5 if taken else 0):
        near = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        centres = np.array([points[near == c].mean(axis=0) if (near == c).any() else x for c, x in enumerate(centres)])
    return centres


def _aligned(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(v.shape[1], centres.shape[1])
    return _widen(v, width), _widen(centres, width)


def _assign(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v, at = _aligned(_matrix(batch["v"]), centres)
        points = v.astype(np.float64)
        near = ((at**2).sum(axis=1) - 2 * points @ at.T).argmin(axis=1)
        away = np.linalg.norm(points - at[near], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(near.astype(np.int32)), pa.array(away), batch["v"], batch["ids"]], ["cell", "away", "v", "ids"]
        )


def _route(batches: Iterator[pa.RecordBatch], centres: np.ndarray, radii: np.ndarray, home: bool) -> Iterator[pa.RecordBatch]:
    """Queries with the cells to ask: the one of the highest bound, or all others whose bound reaches the kth score."""
    for batch in batches:
        v, at = _aligned(_matrix(batch["v"]), centres)
        cells = []
        for query, bound in zip(v, batch["bound"].to_pylist(), strict=True):
            limits = upper_bounds(at, radii, query)
            first = int(limits.argmax())
            if home:
                cells.append([first])
            else:
                reached = range(len(limits)) if bound is None else np.flatnonzero(limits >= bound).tolist()
                cells.append([c for c in reached if c != first])
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in ("query_id", "twin", "v", "bound")), pa.array(cells, pa.list_(pa.int32()))],
            ["query_id", "twin", "v", "bound", "cells"],
        )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` with the largest inner product, for each query.

    Both have (vec_id, v) with integer v, see `quantised`; a query does not meet rows of its own vec_id. Ties go to
    the smaller vec_id, nulls last. Equal rows count once; a vec_id with different vectors is as many rows, and as many
    queries with a list each. Shorter vectors are filled with zeros. Fewer rows than k give fewer ranks, empty
    tables none.

    Rows of equal vectors become one with its k + 1 smallest ids, more can never be asked for: a vector that very
    many rows share is one row. Cells around a bounded number of centres are cut into shards of bounded size by a
    hash; each shard gets a ball tree. A query first asks the cell of the highest bound. The kth score found there
    goes along to all other cells whose bound reaches it, so what is pruned is pruned exactly.
    """
    last = F.asc_nulls_last("vec_id")
    of_vector = Window.partitionBy("v").orderBy(last)
    rows = staged(
        vectors.distinct()
        .withColumn("place", F.row_number().over(of_vector))
        .where(F.col("place") <= k + 1)
        .groupBy("v")
        .agg(F.collect_list(F.struct(F.col("vec_id").alias("id"))).alias("ids")),
        "vectors",
    )
    asked = queries.where("vec_id IS NOT NULL").distinct().select(
        F.col("vec_id").alias("query_id"), F.md5(F.col("v").cast("string")).alias("twin"), "v",
        F.lit(None).cast("long").alias("bound"),
    )
    centres = _centres(rows, min(MOST_CELLS, 1 + rows.count() // SHARD_ROWS))
    if not len(centres):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ids = "array<struct<id:long>>"
    placed = staged(
        rows.mapInArrow(lambda batches: _assign(batches, centres), f"cell int, away double, v array<long>, ids {ids}"),
        "cells",
    )
    # One row per cell: at most MOST_CELLS.
    sizes = {row.cell: row for row in placed.groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect()}
    radii = np.array([sizes[c].r * (1 + SLACK) if c in sizes else 0.0 for c in range(len(centres))])
    parts = F.array(*[F.lit(1 + sizes[c].n // SHARD_ROWS if c in sizes else 1) for c in range(len(centres))])
    parts_of_cell = F.element_at(parts, F.col("cell") + 1)
    shards = placed.withColumn("part", F.pmod(F.xxhash64("v"), parts_of_cell).cast("int")).withColumn("asks", F.lit(False))

    def search(asking: DataFrame, home: bool) -> DataFrame:
        routed = asking.mapInArrow(
            lambda batches: _route(batches, centres, radii, home),
            "query_id long, twin string, v array<long>, bound long, cells array<int>",
        )
        each = (
            routed.withColumn("cell", F.explode("cells"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), parts_of_cell.cast("int") - 1)))
            .withColumn("asks", F.lit(True))
        )
        names = [column.split()[0] for column in ROW.split(", ")]
        return (
            shards.unionByName(each, allowMissingColumns=True)
            .select(*names)
            .repartition("cell", "part")
            .sortWithinPartitions("cell", "part", "asks")
            .mapInArrow(lambda batches: _search_shards(batches, k), HIT)
        )

    first = staged(search(asked, True), "first")
    best = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), last)
    kth = (
        first.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") == k)
        .select("query_id", "twin", F.col("score").alias("bound"))
    )
    bounded = asked.drop("bound").join(kth, ["query_id", "twin"], "left").select("query_id", "twin", "v", "bound")
    return (
        first.unionByName(search(bounded, False))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of `embeddings` for every row whose vec_id is divisible by 100."""
    vectors = staged(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "quantised")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
