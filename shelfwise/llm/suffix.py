"""Removes repeated passages with a logarithmic family of sampled suffix arrays."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import rolling
from shelfwise.runtime import staged

LENGTH = 100  # bytes of the shortest passage
GRAM = 32  # bytes of an anchor
SPAN = LENGTH - GRAM + 1  # anchors that lie inside one passage
SLICE = 1 << 20
PLACE_BITS = 24
BUCKET_BYTES = 32_000_000  # text per bucket of an index
MOST_BUCKETS = 20_000
BATCHES = 3

ENTRY = ["anchor", "content", "batch", "doc_id", "tie", "start", "n", "lead"]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchored(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All windows of LENGTH bytes inside the texts, as runs that share an anchor.

    The anchor of a window is the GRAM with the smallest hash in it, the leftmost of equal ones: a function of
    its content alone, so equal windows have equal anchors at equal distances. Per run: row, start (in the
    text), n (windows), lead (bytes from start to the anchor), anchor (hash of it), content (hash of the
    n + LENGTH - 1 bytes and lead).
    """
    names = ("row", "start", "n", "lead", "anchor", "content")
    out: dict[str, list[np.ndarray]] = {name: [] for name in names}
    for low in range(0, max(0, len(data) - LENGTH + 1), SLICE):
        part = data[low : low + SLICE + LENGTH - 1]
        prefix = rolling.Prefix(part)
        at = np.arange(len(part) - GRAM + 1)
        gram = prefix.windows(at, at + GRAM)
        keep = np.uint64((1 << 64) - (1 << PLACE_BITS))
        packed = (gram & keep) | at.astype(np.uint64)
        best = (_sliding_min(packed, SPAN) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        p = np.arange(len(best))
        row = np.searchsorted(offsets, p + low, side="right") - 1
        good = p + low + LENGTH <= offsets[row + 1]
        p, best, row = p[good], best[good], row[good]
        if not len(p):
            continue
        new = np.ones(len(p), bool)
        new[1:] = (np.diff(best) != 0) | (np.diff(row) != 0)
        first = np.flatnonzero(new)
        n = np.diff(first, append=len(p))
        start, anchor = p[first], best[first]
        content = prefix.windows(start, start + n + LENGTH - 1)
        lead = anchor - start
        for name, value in zip(
            names,
            (row[first], start + low - offsets[row[first]], n, lead, gram[anchor],
             rolling.mix(content + lead.astype(np.uint64))),
            strict=True,
        ):
            out[name].append(value)
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return {k: np.concatenate(v) if v else np.zeros(0, t) for (k, v), t in zip(out.items(), kinds, strict=True)}


def _as_rows(part: pa.RecordBatch, found: dict[str, np.ndarray], chosen: np.ndarray) -> dict[str, pa.Array]:
    rows = pa.array(found["row"][chosen])
    return {
        "anchor": pa.array(found["anchor"][chosen].view(np.int64)),
        "content": pa.array(found["content"][chosen].view(np.int64)),
        "doc_id": part.column("doc_id").take(rows),
        "tie": part.column("tie").take(rows),
        "start": pa.array(found["start"][chosen], pa.int32()),
        "n": pa.array(found["n"][chosen], pa.int32()),
        "lead": pa.array(found["lead"][chosen], pa.int8()),
    }


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled suffixes of whole texts. A suffix whose run repeats an earlier one of the same piece is settled
    here (lead -1): a passage that every text has does not send a row per text to one place."""
    for batch in batches:
        for part in rolling.pieces(batch, "text"):
            # In document order, so that the first of equal runs is the earliest.
            part = part.take(pc.sort_indices(part, sort_keys=[("doc_id", "ascending"), ("tie", "ascending")]))
            text = rolling.flat(part.column("text"))
            found = anchored(text.data, text.offsets)
            count = len(found["anchor"])
            order = np.lexsort((np.arange(count), found["content"], found["anchor"]))
            again = np.zeros(count, bool)
            again[order[1:]] = (found["content"][order][1:] == found["content"][order][:-1]) & (
                found["anchor"][order][1:] == found["anchor"][order][:-1]
            )
            yield pa.RecordBatch.from_pydict(_as_rows(part, found, np.flatnonzero(~again)))
            # Settled neighbours become one row.
            settled = np.flatnonzero(again)
            if len(settled):
                row, start, end = (x[settled] for x in (found["row"], found["start"], found["start"] + found["n"]))
                new = np.ones(len(settled), bool)
                new[1:] = (np.diff(row) != 0) | (start[1:] != end[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(settled)) - 1
                columns = _as_rows(part, found, settled[first])
                columns["n"] = pa.array(end[last] - start[first], pa.int32())
                columns["lead"] = pa.array(np.full(len(first), -1), pa.int8())
                yield pa.RecordBatch.from_pydict(columns)


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by anchor, as tables that hold whole groups of an anchor."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]) if kept is not None else table
        anchors = table.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchors, anchors[-1]))
        if cut:
            yield table.slice(0, cut)
        kept = table.slice(cut)
    if kept is not None and kept.num_rows:
        yield kept


def _merge_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels and the new batch come merged in anchor order. Out: runs of the batch that repeat an earlier run
    as a whole (what 0), and the different runs of each anchor where a new one may repeat a part of an earlier
    one (what 1 if new, 2 if from a level), to be compared byte by byte."""
    for table in _sorted_groups(batches):
        table = table.sort_by([("anchor", "ascending"), ("content", "ascending"), ("batch", "ascending"),
                               ("doc_id", "ascending"), ("tie", "ascending"), ("start", "ascending")])
        anchor, content = table.column("anchor").to_numpy(), table.column("content").to_numpy()
        fresh = table.column("fresh").to_numpy(zero_copy_only=False).astype(bool)
        settled = table.column("lead").to_numpy() < 0
        first = np.ones(len(anchor), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        whole = settled | ~first
        group = np.cumsum(np.diff(anchor, prepend=anchor[0] - 1) != 0) - 1
        heads = np.bincount(group, weights=~whole)
        open_heads = np.bincount(group, weights=~whole & fresh)
        member = ~whole & (heads > 1)[group] & (open_heads > 0)[group]
        what = np.where(whole & fresh, 0, np.where(member & fresh, 1, np.where(member, 2, -1)))
        keep = np.flatnonzero(what >= 0)
        out = table.select(["anchor", *ENTRY[2:]]).take(pa.array(keep)).append_column(
            "what", pa.array(what[keep], pa.int8())
        )
        yield from out.combine_chunks().to_batches()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted run of a text."""
    for batch in batches:
        for part in rolling.pieces(batch, "text"):
            text = rolling.flat(part.column("text"))
            raw = text.data.tobytes()
            wanted = part.column("wanted")
            rows = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy())
            run = pa.RecordBatch.from_struct_array(wanted.flatten())
            low = text.offsets[rows] + run.column("start").to_numpy()
            high = low + run.column("n").to_numpy() + LENGTH - 1
            take = pa.array(rows)
            yield pa.RecordBatch.from_pydict(
                {name: run.column(name) for name in ("anchor", "batch", "start", "n", "lead", "what")}
                | {"doc_id": part.column("doc_id").take(take), "tie": part.column("tie").take(take)}
                | {"context": pa.array([raw[a:b] for a, b in zip(low, high, strict=True)], pa.binary())}
            )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of new runs that stand in an earlier run of the same anchor."""
    for table in _sorted_groups(batches):
        table = table.sort_by([("anchor", "ascending"), ("batch", "ascending"), ("doc_id", "ascending"),
                               ("tie", "ascending"), ("start", "ascending")])
        anchor = table.column("anchor").to_numpy().view(np.uint64)
        n, lead = table.column("n").to_numpy(), table.column("lead").to_numpy()
        contexts = table.column("context").to_pylist()
        data = np.frombuffer(b"".join(contexts), np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])[:-1]
        of = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        low = begins[of] + within
        window = rolling.word_hashes(data, low, low + LENGTH)
        key = rolling.mix(window ^ anchor[of]) + (lead[of] - within).astype(np.uint64)
        # Rows are in document order, so the first of equal windows is the earliest.
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order][1:] == key[order][:-1]
        again &= (table.column("what").to_numpy() == 1)[of]
        at = np.flatnonzero(again)
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(of[at]) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        rows = pa.array(of[at[first]])
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": table.column("doc_id").take(rows).combine_chunks(),
                "tie": table.column("tie").take(rows).combine_chunks(),
                "start": pa.array(table.column("start").to_numpy()[of[at[first]]] + within[at[first]], pa.int32()),
                "n": pa.array(at[last] - at[first] + 1, pa.int32()),
            }
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the repeated bytes."""
    for batch in batches:
        texts, runs = batch.column("text").to_pylist(), batch.column("runs").to_pylist()
        out = []
        for text, found in zip(texts, runs, strict=True):
            raw = (text or "").encode()
            kept, end, spans, removed = [], 0, 0, 0
            for start, stop in sorted((r["start"], r["start"] + r["n"] + LENGTH - 1) for r in found or ()):
                if start > end or not spans:
                    kept.append(raw[end:start])
                    spans, removed, end = spans + 1, removed + stop - start, stop
                elif stop > end:
                    removed, end = removed + stop - end, stop
            kept.append(raw[end:])
            out.append((len(raw), removed, spans, b"".join(kept)))
        sizes, removed, spans, kept = zip(*out, strict=True) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


@contextmanager
def _bucketed(spark: SparkSession):
    """Bucketed tables are read by bucket even where the planner sees no need: the merge-scan wants their
    distribution for tasks in Python, which the planner does not look into."""
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class IndexFamily:
    """Sampled suffix arrays of all batches so far, as levels: level i holds 2**i batches.

    A level is a table bucketed and sorted by anchor, so that scans and merges need no shuffle. A new batch
    is merge-scanned against all levels, and becomes a level; two levels of equal size merge to one of the
    next size before the next batch comes. A merge keeps the first of equal runs.
    """

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.levels: list[tuple[int, str]] = []
        self.batches = 0

    def _write(self, df: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        (
            df.repartition(self.buckets, "anchor")
            .sortWithinPartitions("anchor")
            .write.bucketBy(self.buckets, "anchor").sortBy("anchor").saveAsTable(name)
        )
        return name

    def _merge(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, b), (_, a) = self.levels.pop(), self.levels.pop()
            both = self.spark.table(a).union(self.spark.table(b)).where("lead >= 0")
            place = F.struct("batch", F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "start", "n", "lead")
            firsts = both.groupBy("anchor", "content").agg(F.min(place).alias("p"))
            merged = self._write(firsts.select("anchor", "content", *[F.col(f"p.{c}").alias(c) for c in ENTRY[2:]]))
            for name in (a, b):
                self.spark.sql(f"DROP TABLE {name} PURGE")
            self.levels.append((size + 1, merged))

    def add(self, docs: DataFrame) -> DataFrame:
        """Index (doc_id, tie, text) and scan it against everything before: rows of `_merge_scan`, written."""
        self._merge()
        id_type = docs.schema["doc_id"].dataType.simpleString()
        entries = docs.select("doc_id", "tie", "text").mapInArrow(
            _entries, f"anchor long, content long, doc_id {id_type}, tie long, start int, n int, lead byte"
        )
        name = self._write(entries.withColumn("batch", F.lit(self.batches)).select(ENTRY))
        merged = self.spark.table(name).withColumn("fresh", F.lit(True))
        for _, level in self.levels:
            merged = merged.union(self.spark.table(level).where("lead >= 0").withColumn("fresh", F.lit(False)))
        with _bucketed(self.spark):
            found = staged(
                merged.repartition(self.buckets, "anchor").sortWithinPartitions("anchor").mapInArrow(
                    _merge_scan,
                    f"anchor long, batch int, doc_id {id_type}, tie long, start int, n int, lead byte, what byte",
                ),
                "scan",
            )
        self.levels.append((0, name))
        self.batches += 1
        return found

    def drop(self) -> None:
        for _, name in self.levels:
            self.spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")
        self.levels = []


def _by_document(df: DataFrame, docs: DataFrame, how: str = "inner") -> DataFrame:
    """Join lists per document to the texts; ids may be null."""
    same = docs["doc_id"].eqNullSafe(df["doc_id"]) & (docs["tie"] == df["tie"])
    return docs.join(df, same, how).select(docs["doc_id"], docs["tie"], docs["text"], *[
        df[c] for c in df.columns if c not in ("doc_id", "tie")
    ])


def batches_of(docs: DataFrame, count: int) -> list[DataFrame]:
    """Cut by ranges of a numeric doc_id; other ids make one batch. Null ids come last."""
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long") or count < 2:
        return [docs]
    cuts = docs.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)])).first()[0]
    cuts = sorted(set(cuts or []))
    place = sum([F.coalesce(F.col("doc_id") > c, F.lit(True)).cast("int") for c in cuts], F.lit(0))
    return [docs.where(place == i) for i in range(len(cuts) + 1)]


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    A byte goes if it lies in LENGTH equal bytes that also start earlier, in a smaller doc_id or before in the
    same text. kept: the other bytes, which may cut a character. Null texts are empty; a null doc_id comes
    last. Rows that repeat doc_id and text are one document; texts of one doc_id come in the order of a 64-bit
    hash, and are told apart by it. Runs and windows are compared by 64-bit hashes beside that of their anchor. Empty tables give no rows.
    """
    spark = docs.sparkSession
    tie = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).withColumn("tie", tie)
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    family = IndexFamily(spark, min(MOST_BUCKETS, max(8, int(volume // BUCKET_BYTES))))
    again = rows.groupBy("doc_id", "tie").count().where("count > 1")
    once = rows if again.isEmpty() else rows.dropDuplicates(["doc_id", "text"])
    found = [family.add(batch) for batch in batches_of(once, batches)]
    family.drop()
    scanned = found[0]
    for df in found[1:]:
        scanned = scanned.union(df)
    wanted = (
        # A run can be new in one scan and known in later ones.
        scanned.where("what > 0")
        .groupBy("anchor", *ENTRY[2:]).agg(F.min("what").alias("what"))
        .groupBy("doc_id", "tie")
        .agg(F.collect_list(F.struct("anchor", "batch", "start", "n", "lead", "what")).alias("wanted"))
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    contexts = _by_document(wanted, rows).mapInArrow(
        _contexts,
        "anchor long, batch int, start int, n int, lead byte, what byte, "
        f"doc_id {id_type}, tie long, context binary",
    )
    parts = staged(
        contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
            _compare, f"doc_id {id_type}, tie long, start int, n int"
        ),
        "parts",
    )
    whole = scanned.where("what = 0").select("doc_id", "tie", "start", "n")
    runs = whole.union(parts).distinct().groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return _by_document(runs, rows, "left").mapInArrow(
        _cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of `documents` without repeated passages."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
