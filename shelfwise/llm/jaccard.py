"""Joins near-copies on word n-grams: MinHash with Bayesian pruning, then exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import rolling
from shelfwise.llm.graph import components
from shelfwise.llm.names import spare
from shelfwise.runtime import staged

NGRAM = 5
THRESHOLD = 0.8
# 40 bands of 6 values: a pair at the threshold shares no band with probability (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
# A pair is dropped once the posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-6
STEP = 24
# Size of the parts of a large group that are compared pair by pair in one task.
PART_TEXTS, PART_WORDS = 512, 2_000_000

_random = np.random.default_rng(7)
MULTIPLIERS = _random.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SALTS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def min_matches(threshold: float, tolerance: float, step: int, total: int) -> list[tuple[int, int]]:
    """(values compared, fewest equal values to go on). With a uniform prior, P(S >= t | m of n equal) is
    the probability that a binomial of n + 1 trials with chance t has at most m successes."""
    out = []
    for n in range(step, total + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def signatures(grams: rolling.Grams, n_rows: int) -> np.ndarray:
    """MinHash values (rows x functions); all ones for a text without words."""
    out = np.full((n_rows, BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    if len(grams.hash):
        edges = np.flatnonzero(np.diff(grams.row, prepend=-1))
        rows = grams.row[edges]
        half = (grams.hash >> np.uint64(32)).astype(np.uint32)
        for k in range(BANDS * ROWS):
            out[rows, k] = np.minimum.reduceat((half ^ SALTS[k]) * MULTIPLIERS[k], edges)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    parts = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
    for k in range(ROWS):
        key = rolling.mix(key * rolling.BASE + parts[:, :, k])
    return key


def _shingles(batch: pa.RecordBatch, n: int) -> rolling.Grams:
    return rolling.grams(rolling.spaced_words(batch.column("text")), n, short=True)


def _keys(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rolling.pieces(batch, "text"):
                grams = _shingles(part, n)
                sizes = np.bincount(grams.row, minlength=part.num_rows)
                keep = np.flatnonzero(sizes)
                keys = band_keys(signatures(grams, part.num_rows)[keep])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node").take(pa.array(keep)),
                        pa.array(sizes[keep], pa.int64()),
                        rolling.lists(keys.ravel().view(np.int64), np.full(len(keep), BANDS), pa.int64()),
                    ],
                    ["node", "n_grams", "keys"],
                )

    return run


def _payload(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rolling.pieces(batch, "text"):
                grams = _shingles(part, n)
                values = signatures(grams, part.num_rows)
                edges = np.searchsorted(grams.row, np.arange(part.num_rows + 1))
                sets = [np.unique(grams.hash[i:j]).tobytes() for i, j in zip(edges, edges[1:], strict=False)]
                columns = {c: part.column(c) for c in ("node", "parts", "root", "copies")}
                yield pa.RecordBatch.from_pydict(
                    columns
                    | {
                        "values": pa.array([v.tobytes() for v in values], pa.binary()),
                        "grams": pa.array(sets, pa.binary()),
                    }
                )

    return run


def _compare(threshold: float, tolerance: float):
    schedule = min_matches(threshold, tolerance, STEP, BANDS * ROWS)

    def survivors(i: int, later: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Texts of `later` that stay likely enough to be similar to text i."""
        equal, start = np.zeros(len(later), np.int32), 0
        for n, least in schedule:
            equal += (values[later, start:n] == values[i, start:n]).sum(axis=1, dtype=np.int32)
            stay = equal >= least
            later, equal, start = later[stay], equal[stay], n
            if not len(later):
                break
        return later

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        count = table.num_rows
        nodes = table.column("node").to_pylist()
        values = np.frombuffer(b"".join(table.column("values").to_pylist()), np.uint32).reshape(count, -1)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        copies = table.column("copies").to_numpy()
        part = table.column("part").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        sizes = np.array([len(s) for s in sets])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        present = np.zeros(len(names), bool)
        links = np.zeros(count, np.int64)
        parent = np.arange(count)

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i in range(count):
            later = np.arange(i + 1, count)
            if low != high:  # pairs inside a part belong to the task of that part
                later = later[part[later] != part[i]]
            # Jaccard >= t needs sizes within a factor t.
            a, b = sizes[i], sizes[later]
            later = survivors(i, later[np.minimum(a, b) >= threshold * np.maximum(a, b)], values)
            if not len(later):
                continue
            mine = ids[offsets[i] : offsets[i + 1]]
            present[mine] = True
            if 2 * sizes[later].sum() > len(ids):
                common = np.add.reduceat(present[ids].astype(np.int32), offsets[:-1])[later]
            else:
                common = np.array([present[ids[offsets[j] : offsets[j + 1]]].sum() for j in later])
            present[mine] = False
            linked = later[common >= threshold * (a + sizes[later] - common) - 1e-9]
            links[i] += copies[linked].sum()
            links[linked] += copies[i]
            for j in linked:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
        return pa.table(
            {
                "node": pa.array(nodes, pa.binary()),
                "root": pa.array([nodes[find(i)] for i in range(count)], pa.binary()),
                "links": pa.array(links, pa.int64()),
            }
        )

    return run


def text_key(column: str = "text"):
    """128 bits that stand for a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit(""))))


def text_classes(
    docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """(node, copies, first_id, class_id, chosen, links): each different text of (doc_id, text) that has a word.

    1. Equal texts become one node. Texts that share a band of MinHash values are joined to the first one
       of their bucket, and these stars make coarse groups: no pairs are written down.
    2. Inside a group all pairs are compared, values in steps; a pair is dropped when its posterior
       probability of similarity >= threshold falls below tolerance. What stays is verified on the
       whole n-gram sets. Large groups are split in parts, and each pair of parts is a task of its own.
    3. A task returns a number of links and a spanning edge per text, from which classes are joined.
    """
    texts = docs.select(F.col("doc_id").alias("doc_id"), text_key().alias("node"), F.col("text").alias("text"))
    keyed = staged(
        texts.select("node", "text")
        .mapInArrow(_keys(n), "node binary, n_grams long, keys array<long>")
        .dropDuplicates(["node"]),
        "bands",
    )
    once = texts.groupBy("node").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    members = keyed.select("node", F.explode("keys").alias("key"))
    leaders = members.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n"))
    stars = members.join(leaders.where("n > 1").select("key", "b"), "key").select(F.col("node").alias("a"), "b")
    groups = components(stars)
    size = (
        groups.join(keyed.select("node", "n_grams"), "node")
        .groupBy("root")
        .agg(
            F.greatest(
                F.ceil(F.count("*") / PART_TEXTS), F.ceil(F.sum("n_grams") / PART_WORDS)
            ).alias("parts")
        )
    )
    grouped = groups.join(size, "root")
    payload = once.join(grouped, "node").select("node", "text", "copies", "root", "parts").mapInArrow(
        _payload(n), "node binary, parts long, root binary, copies long, values binary, grams binary"
    )
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    tasks = (
        payload.withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("low", F.least("part", "other"))
        .withColumn("high", F.greatest("part", "other"))
        .select("root", "low", "high", "part", "node", "copies", "values", "grams")
    )
    found = staged(
        tasks.groupBy("root", "low", "high").applyInArrow(
            _compare(threshold, tolerance), "node binary, root binary, links long"
        ),
        "links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = (
        texts.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
        .join(keyed.select("node"), "node")
        .join(classes, "node", "left")
        .join(links, "node", "left")
        .select(
            "node", "copies", "first_id", F.coalesce("root", "node").alias("root"),
            F.coalesce("links", F.lit(0)).alias("links"),
        )
    )
    nodes = staged(nodes, "classes")
    order = F.struct(F.col("first_id").isNull(), "first_id", "node")
    firsts = nodes.groupBy("root").agg(F.min(order).alias("first"))
    return nodes.join(firsts, "root").select(
        "node", "copies", "first_id", F.col("first.first_id").alias("class_id"),
        (F.col("first.node") == F.col("node")).alias("chosen"), "links",
    )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored).

    class_id: smallest doc_id of the connected group of texts with Jaccard similarity >= threshold on
    lower-case word n-grams. n_links: documents linked directly, copies included. n_copies: documents of
    equal text, itself included. A text without words (null, empty) has no links and its own doc_id as
    class; a text of fewer than n words is one n-gram. A null doc_id is kept and is never a class_id
    unless all ids of the group are null. Repeated rows count as copies. An empty table gives no rows.
    """
    classes = text_classes(docs, **options)
    rows = docs.select(F.col("doc_id").alias("doc_id"), text_key().alias("node"))
    return rows.join(classes, "node", "left").select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with one row of each class of near-copies: the one with the smallest doc_id.

    Texts without words all stay. Of rows that repeat the kept doc_id and text, one stays.
    """
    node, first, chosen = spare(docs, "copy_node", "copy_first", "copy_chosen")
    # Only texts with copies or in a class of several are looked up: mostly a small table, which then is sent to
    # the documents instead of the other way round.
    classes = text_classes(docs, **options)
    affected = staged(
        classes.where(~F.col("chosen") | (F.col("copies") > 1)).select(
            F.col("node").alias(node), F.col("first_id").alias(first), F.col("chosen").alias(chosen)
        ),
        "affected",
    )
    joined = docs.withColumn(node, text_key()).join(affected, node, "left")
    rest = joined.where(F.col(chosen).isNull())
    kept = joined.where(F.col(chosen) & F.col("doc_id").eqNullSafe(F.col(first)))
    return kept.dropDuplicates([node]).unionByName(rest).select(docs.columns)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
