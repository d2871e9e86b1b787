"""Finds benchmark items inside documents by greedy string tiling, so that reordered passages count too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import rolling
from shelfwise.llm.jaccard import text_key
from shelfwise.llm.names import spare
from shelfwise.runtime import staged

# Shortest tile in words, and the share of an item's words that tiles must cover.
MIN_TILE = 5
COVERAGE = 0.6
# Bits of the filter of seed hashes that every task gets: its size is fixed, whatever the benchmark.
FILTER_BITS = 1 << 23


class Windows:
    """Rolling hashes of a sequence of word hashes, over windows without marked words."""

    def __init__(self, words: np.ndarray):
        self.words, self.marked = words, np.zeros(len(words), bool)
        size = len(words) + 1
        self.powers = np.ones(size, np.uint64)
        np.multiply.accumulate(np.full(size - 1, rolling.BASE, np.uint64), out=self.powers[1:])
        # Sum of words * BASE ** place: two windows are equal if these agree after a shift to one place.
        self.sums = np.zeros(size, np.uint64)
        np.cumsum(rolling.mix(words) * self.powers[:-1], out=self.sums[1:])

    def free(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the windows of n unmarked words, by start."""
        m = len(self.words) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hidden = np.concatenate([[0], np.cumsum(self.marked)])
        start = np.flatnonzero(hidden[n:] == hidden[:m])
        top = len(self.powers) - 1
        return start, (self.sums[start + n] - self.sums[start]) * self.powers[top - start]


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in text, start in item, length).

    The longest match of unmarked words is marked again and again, ties by position. Its length is found by
    Karp-Rabin hashes: if no window of n words is common, none of more words is, so the length is searched by
    halving; then all matches of that length are marked in one pass. Memory is linear in both sequences, also where a
    word is repeated throughout.
    """
    size = max(len(text), len(item))
    left, right = Windows(text), Windows(item)
    # One base of places for both, so that their hashes can be compared.
    powers = left.powers if len(text) == size else right.powers
    left.powers = right.powers = powers
    tiles: list[tuple[int, int, int]] = []

    def common(n: int) -> bool:
        (_, a), (_, b) = left.free(n), right.free(n)
        return bool(len(a) and len(b) and np.isin(b, a).any())

    most = min(len(text), len(item))
    while most >= least and common(least):
        low, high = least, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        (starts, a), (places, b) = left.free(low), right.free(low)
        order = np.argsort(b, kind="stable")
        known, first = np.unique(b[order], return_index=True)
        ends = np.append(first[1:], len(order))
        at = np.searchsorted(known, a)
        hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == a)
        pointer = first.copy()
        last = -1
        for i, group in zip(starts[hit].tolist(), at[hit].tolist(), strict=True):
            if i <= last:
                continue
            # Marks only grow: a place that has been passed stays passed.
            for p in range(pointer[group], ends[group]):
                j = int(places[order[p]])
                if not right.marked[j : j + low].any() and (text[i : i + low] == item[j : j + low]).all():
                    left.marked[i : i + low] = right.marked[j : j + low] = True
                    tiles.append((i, j, low))
                    last = i + low - 1
                    break
                pointer[group] = p + 1
        most = low - 1
    return tiles


def _item_words(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = rolling.plain_words(batch.column("text"))
            sizes = np.bincount(words.row, minlength=batch.num_rows)
            # An item shorter than the shortest tile is sought whole.
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id"),
                    rolling.lists(words.hash.view(np.int64), sizes, pa.int64()),
                    pa.array(np.minimum(sizes, least), pa.int32()),
                ],
                ["item_id", "words", "least"],
            )

    return run


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, seed, times): hashes of the runs of `least` words of each item."""
    for batch in batches:
        for row in batch.to_pylist():
            words = np.array(row["words"], np.int64).view(np.uint64)
            n = row["least"]
            if n:
                found, times = np.unique(_run_hashes(words, n), return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "item_id": pa.array([row["item_id"]] * len(found), pa.int64()),
                        "seed": pa.array(found.view(np.int64)),
                        "times": pa.array(times, pa.int64()),
                    }
                )


def _run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    row = np.zeros(len(words), np.int64)
    return rolling.grams(rolling.Words(row, row, row, words), n, short=False).hash ^ np.uint64(n)


def _regions(sizes: list[int], bits: np.ndarray):
    """Per document with a possible seed: the words of all stretches that seeds cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rolling.pieces(batch, "text"):
                words = rolling.plain_words(part.column("text"))
                delta = np.zeros(len(words.hash) + 1, np.int32)
                seeds, rows = [], []
                for n in sizes:
                    grams = rolling.grams(words, n, short=False)
                    value = grams.hash ^ np.uint64(n)
                    slot = (value % np.uint64(FILTER_BITS)).astype(np.int64)
                    hit = (bits[slot >> 3] >> (slot & 7)) & 1 == 1
                    np.add.at(delta, grams.at[hit], 1)
                    np.add.at(delta, grams.at[hit] + n, -1)
                    seeds.append(value[hit])
                    rows.append(grams.row[hit])
                inside = np.cumsum(delta[:-1]) > 0
                at = np.flatnonzero(inside)
                if not len(at):
                    continue
                seed, row = np.concatenate(seeds), np.concatenate(rows)
                for r in np.unique(row):
                    mine = at[(at >= np.searchsorted(words.row, r)) & (at < np.searchsorted(words.row, r, "right"))]
                    # A zero stands between stretches: it is no word's hash.
                    gaps = np.flatnonzero(np.diff(mine) != 1) + 1
                    stretch = np.insert(words.hash[mine], gaps, np.uint64(0))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "text_key": part.column("text_key").slice(int(r), 1),
                            "stretches": pa.array([stretch.view(np.int64).tolist()], pa.list_(pa.int64())),
                            "seeds": pa.array([np.unique(seed[row == r]).view(np.int64).tolist()], pa.list_(pa.int64())),
                        }
                    )

    return run


def _tiles(coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = np.array(row["stretches"], np.int64).view(np.uint64)
                item = np.array(row["words"], np.int64).view(np.uint64)
                tiles = tile(text, item, row["least"])
                covered = sum(n for _, _, n in tiles)
                if covered >= coverage * len(item):
                    out.append((row["text_key"], row["item_id"], covered / len(item), len(tiles), covered))
            keys, items, shares, counts, words = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.binary()),
                    pa.array(items, pa.int64()),
                    pa.array(shares, pa.float64()),
                    pa.array(counts, pa.int64()),
                    pa.array(words, pa.int64()),
                ],
                ["text_key", "item_id", "coverage", "n_tiles", "n_words"],
            )

    return run


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Bit set of seed hashes: at most FILTER_BITS / 32 rows come to the driver."""
    slot = F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = (
        seeds.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))
        .collect()
    )
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    for row in words:
        bits[row["word"]] = row["bits"]
    return bits.view(np.uint8)


def leaks(
    docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, coverage: float = COVERAGE
) -> DataFrame:
    """(text_key, item_id, coverage, n_tiles, n_words): texts of `docs` (text) that hold an item of `benchmark`
    (item_id, text).

    Words are runs of letters and digits in lower case. Documents are scanned once; a filter of fixed size
    lets through the few stretches of words that may match, and joins from there on are on seeds and on
    texts that have some. Equal texts are tiled once. Items without words match nothing; items shorter than
    `least` words are sought whole. Null texts are empty. Items that repeat an item_id count one by one; the
    best coverage is returned. Empty tables give no rows.
    """
    items = staged(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
        .distinct()
        .mapInArrow(_item_words(least), "item_id long, words array<long>, least int"),
        "items",
    ).where("least > 0")
    items = items.withColumn("item_key", F.xxhash64("item_id", "words"))
    seeds = items.select(F.col("item_key").alias("item_id"), "words", "least").mapInArrow(
        _seeds, "item_id long, seed long, times long"
    )
    sizes = sorted(r[0] for r in items.select("least").distinct().collect())  # at most `least` rows
    texts = docs.select(text_key().alias("text_key"), F.col("text").alias("text"))
    found = staged(
        texts.mapInArrow(
            _regions(sizes, seed_filter(seeds)), "text_key binary, stretches array<long>, seeds array<long>"
        ).dropDuplicates(["text_key"]),
        "stretches",
    )
    shared = (
        found.select("text_key", F.explode("seeds").alias("seed"))
        .join(seeds.withColumnRenamed("item_id", "item_key"), "seed")
        .groupBy("text_key", "item_key")
        .agg(F.sum("times").alias("n"))
    )
    pairs = (
        shared.join(items, "item_key")
        # n places of seeds in the item cover at most n * least of its words.
        .where(F.col("n") * F.col("least") >= coverage * F.size("words"))
        .join(found.select("text_key", "stretches"), "text_key")
        .select("text_key", "item_id", "stretches", "words", "least")
    )
    return (
        pairs.mapInArrow(
            _tiles(coverage), "text_key binary, item_id long, coverage double, n_tiles long, n_words long"
        )
        .groupBy("text_key", "item_id")
        .agg(F.max(F.struct("coverage", "n_tiles", "n_words")).alias("best"))
        .select("text_key", "item_id", "best.*")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, coverage, n_tiles, n_words.

    `docs` (doc_id, text): null ids are kept; each repeated row gives its own rows.
    """
    found = leaks(docs, benchmark, **options)
    rows = docs.select(F.col("doc_id").alias("doc_id"), text_key().alias("text_key"))
    return rows.join(found, "text_key").drop("text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose text holds no benchmark item, with all their columns."""
    (key,) = spare(docs, "leak_key")
    found = leaks(docs, benchmark, **options).select(F.col("text_key").alias(key)).distinct()
    return docs.withColumn(key, text_key()).join(found, key, "left_anti").select(docs.columns)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of `documents` against all items of `benchmark`."""
    return contaminated(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
