"""Audits how the word use of sources differs, by counting whitespace chunks instead of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.runtime import staged

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000
# A term is kept in a language from this many of its documents on.
LEAST_DOCS = 10
TOP = 10

# Documents are numbered inside blocks of at most so many bytes of text (one longer text is a block alone).
BLOCK_BYTES = 16 << 20
DOC_BITS = 16
# Blocks of 2 ** 6 tasks meet where the documents of a term are counted: that bounds the rows of a frequent term.
NEAR = 32 + 6
# So many groups are small enough to be sent to every executor; more are joined by a shuffle.
SENT_GROUPS = 100_000
# Slots in which groups are numbered.
SLOTS = 64
# Rows of one language that one task compares, and cells of the matrix it holds for them.
ROWS = 200_000
CELLS = 1 << 22
# Counts below this stay in longs when they are scaled.
SMALL = 9 * 10**9


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of consecutive runs of these lengths."""
    return np.arange(lengths.sum()) - np.repeat(_starts(lengths), lengths)


def _to_varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the numbers, seven bits each, and where each number starts."""
    size = np.ones(len(numbers), dtype=np.int64)
    for bits in range(7, 64, 7):
        size += numbers >= (1 << bits)
    starts = _starts(size)
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for b in range(int(size.max(initial=0))):
        more = size > b
        out[starts[more] + b] = (numbers[more] >> 7 * b) & 127 | (size[more] > b + 1) << 7
    return out, starts


def _from_varints(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size = ends - starts + 1
    numbers = np.zeros(len(ends), dtype=np.int64)
    for b in range(int(size.max(initial=0))):
        more = size > b
        numbers[more] |= (raw[starts[more] + b] & 127).astype(np.int64) << 7 * b
    return numbers, starts


def _postings(row: np.ndarray, group: np.ndarray, doc: np.ndarray, n: np.ndarray, rows: int) -> pa.BinaryArray:
    """One value per row from entries in the order (row, group, doc).

    A value holds numbers: how many groups, the groups, the documents of each, the distances between
    documents, and, unless all are 1, the times of each.
    """
    entries = np.bincount(row, minlength=rows)
    first = np.concatenate([[True], row[1:] != row[:-1]])
    opens = first | np.concatenate([[True], group[1:] != group[:-1]])
    groups = np.bincount(row[opens], minlength=rows)
    many = np.zeros(rows, dtype=bool)
    many[row[n > 1]] = True
    base = _starts(1 + 2 * groups + entries + np.where(many, entries, 0))
    numbers = np.zeros(int((1 + 2 * groups + entries + np.where(many, entries, 0)).sum()), dtype=np.int64)
    numbers[base] = groups << 1 | many
    at = np.repeat(base + 1, groups) + _within(groups)
    numbers[at] = group[opens]
    numbers[at + np.repeat(groups, groups)] = np.diff(np.append(np.flatnonzero(opens), len(row)))
    at = np.repeat(base + 1 + 2 * groups, entries) + _within(entries)
    numbers[at] = np.where(first, doc, np.diff(doc, prepend=0))
    some = many[row]
    numbers[(at + np.repeat(entries, entries))[some]] = n[some]
    raw, starts = _to_varints(numbers)
    offsets = np.append(starts[base], len(raw)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _entries(payload: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, group, doc, n) of all entries of these values."""
    offsets = np.frombuffer(payload.buffers()[1], dtype=np.int32)[payload.offset : payload.offset + len(payload) + 1]
    raw = np.frombuffer(payload.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    numbers, starts = _from_varints(raw)
    base = np.searchsorted(starts, offsets[:-1] - offsets[0])
    groups, many = numbers[base] >> 1, numbers[base] & 1 == 1
    at = np.repeat(base + 1, groups) + _within(groups)
    group, run = numbers[at], numbers[at + np.repeat(groups, groups)]
    rows = np.arange(len(base))
    entries = np.bincount(np.repeat(rows, groups), weights=run, minlength=len(base)).astype(np.int64)
    at = np.repeat(base + 1 + 2 * groups, entries) + _within(entries)
    steps = numbers[at].cumsum()
    before = np.concatenate([[0], steps])[_starts(entries)]
    n = np.ones(len(at), dtype=np.int64)
    some = np.repeat(many, entries)
    n[some] = numbers[(at + np.repeat(entries, entries))[some]]
    return np.repeat(rows, entries), np.repeat(group, run), steps - np.repeat(before, entries), n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.StringArray, np.ndarray]]:
    """(number, texts, groups) of the blocks of a task; documents are in the order of their groups."""
    number, held, size, docs = TaskContext.get().partitionId() << 32, [], 0, 0

    def block() -> tuple[int, pa.StringArray, np.ndarray]:
        table = pa.Table.from_batches(held)
        held.clear()
        texts, groups = table["text"].combine_chunks(), table["group_no"].to_numpy()
        order = np.argsort(groups, kind="stable")
        return number, texts.take(pa.array(order)), groups[order]

    for batch in batches:
        lengths = np.concatenate([[0], np.cumsum(pc.binary_length(batch["text"]).to_numpy())])
        low = 0
        while low < batch.num_rows:
            # As many rows as still fit, or one row that is too long for any block.
            fit = int(np.searchsorted(lengths, lengths[low] + BLOCK_BYTES - size, side="right")) - 1
            high = min(fit, low + (1 << DOC_BITS) - docs, batch.num_rows)
            if high <= low and held:
                yield block()
                number, size, docs = number + 1, 0, 0
                continue
            high = max(high, low + 1)
            held.append(batch.slice(low, high - low))
            size, docs, low = size + int(lengths[high] - lengths[low]), docs + high - low, high
    if held:
        yield block()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct chunks of each block."""
    for _, texts, _ in _blocks(batches):
        yield pa.RecordBatch.from_arrays([pc.unique(pc.ascii_split_whitespace(texts).flatten())], ["chunk"])


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block and chunk with the documents that have it."""
    for number, texts, groups in _blocks(batches):
        words = pc.ascii_split_whitespace(texts)
        lengths = words.value_lengths().to_numpy()
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            continue
        # Neighbouring chunks share their beginnings, which shuffles compress.
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty_like(order)
        place[order] = np.arange(len(order), dtype=order.dtype)
        keys = place[coded.indices.to_numpy()].astype(np.int64) << DOC_BITS
        keys |= np.repeat(np.arange(len(lengths)), lengths)
        chunks = coded.dictionary.take(pa.array(order))
        del texts, words, coded
        keys, n = np.unique(keys, return_counts=True)
        row, doc = keys >> DOC_BITS, keys & (1 << DOC_BITS) - 1
        payload = _postings(row, groups[doc], doc, n, len(order))
        del keys, row, doc, n
        whole = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(order), number)), chunks, payload], ["block", "chunk", "payload"]
        )
        for low in range(0, len(order), 50_000):
            yield whole.slice(low, 50_000)


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before, in any column."""
    changed = np.zeros(len(columns[0]), dtype=bool)
    changed[:1] = True
    for column in columns:
        changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, max(len(column) - 1, 0))).to_numpy(zero_copy_only=False)
    return changed


def _count_some(batch: pa.RecordBatch) -> pa.RecordBatch:
    new_term = _changes(batch["term"])
    pair = np.cumsum(new_term | _changes(batch["block"])) - 1
    term = np.cumsum(new_term) - 1
    row, group, doc, n = _entries(batch["payload"])
    keys = pair[row] << DOC_BITS | doc
    if pair[-1] + 1 < batch.num_rows:
        # Documents that have the term in several chunks.
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=-1))
        n, row, group = np.add.reduceat(n[order], first), row[order][first], group[order][first]
    names, group = np.unique(group, return_inverse=True)
    keys, at = np.unique(term[row] * len(names) + group, return_inverse=True)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names[keys % len(names)]),
            batch["term"].take(pa.array(np.flatnonzero(new_term)[keys // len(names)])),
            pa.array(np.diff(np.append(first, len(at)))),
            pa.array(np.add.reduceat(n[order], first)),
        ],
        ["group_no", "term", "docs", "n"],
    )


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (term, block) to (group_no, term, docs, n); a term may come in several rows of a group."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        # What belongs to the last block of the last term waits: more rows of it may follow.
        starts = np.flatnonzero(_changes(batch["term"], batch["block"]))
        if len(starts) > 1:
            whole = joined()
            kept = batch.num_rows - int(starts[-1])
            yield _count_some(whole.slice(0, whole.num_rows - kept))
            held = [whole.slice(whole.num_rows - kept)]
    if held:
        yield _count_some(joined())


def terms_of(chunk: Column) -> Column:
    """The terms of a chunk, in order: only A-Z are lower-cased."""
    return F.transform(F.regexp_extract_all(chunk, F.lit(TERM), F.lit(0)), lambda t: F.translate(t, UPPER, LOWER))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact for any count; 0 without terms."""

    def divided(kind: str) -> Column:
        over, under = (x.cast(kind) for x in (count + 2, total + 2 * terms))
        return F.call_function("div", over * F.lit(SCALE), under)

    exact = F.when(count < SMALL, divided("long")).otherwise(divided("decimal(24,0)"))
    return F.when(terms > 0, exact + 1).otherwise(0).cast("long")


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _groups(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(lang, source) groups with small numbers, and whether they are few enough to be sent to all executors."""
    slot = F.pmod(F.xxhash64("lang", "source"), F.lit(SLOTS))
    in_slot = F.row_number().over(Window.partitionBy("slot").orderBy("lang", "source"))
    number = ((in_slot - 1) * SLOTS + F.col("slot")).cast("long").alias("group_no")
    groups = docs.select("lang", "source").distinct().withColumn("slot", slot).select("lang", "source", number)
    groups = staged(groups, "groups")
    return groups, groups.count() <= SENT_GROUPS


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame, bool]:
    """(lang, term, n, by_source) of the kept terms, (lang, source) of all groups, and whether those are few.

    1. Each task turns blocks of documents into one row per chunk, with the documents that have it.
    2. The distinct chunks of all documents are tokenized, each once.
    3. Their terms are joined back to the rows of (1). A chunk has one row per block, of some two bytes a document,
       however often it occurs. The rows are shuffled once, for (2) and for (3).
    4. Rows of a term meet by (neighbouring blocks, term): documents that have it in several chunks count once, and
       what leaves is one row per group. Sums of these are the result.
    by_source holds (source, n) of every source that has the term.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    whole = docs.select(text, F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    groups, few = _groups(whole)
    sent = F.broadcast(groups) if few else groups
    numbered = whole.join(sent, ["lang", "source"]).select("group_no", "text")
    if not few:
        # Behind a shuffle a repeated task could number its documents differently.
        numbered = staged(numbered, "numbered")
    counts = numbered.mapInArrow(_count_chunks, "block long, chunk string, payload binary").repartition("chunk")
    # All columns are read here too, so that Spark finds the same shuffle on both sides of the join.
    chunks = counts.groupBy("chunk").agg(F.max("block").alias("block"), F.max(F.octet_length("payload")).alias("size"))
    chunks = chunks.where("size > 0 and block >= 0")
    dictionary = chunks.select("chunk", F.explode(terms_of(F.col("chunk"))).alias("term"))
    by_term = (
        counts.join(dictionary, "chunk")
        .select("block", "term", "payload")
        .repartition(F.shiftright("block", NEAR), "term")
        .sortWithinPartitions("term", "block")
        .mapInArrow(_count_documents, "group_no long, term string, docs long, n long")
    )
    kept = (
        by_term.join(sent, "group_no")
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by_source"))
        .where(F.col("docs") >= least_docs)
        .select("lang", "term", "n", "by_source")
    )
    return staged(kept, "kept"), groups.select("lang", "source"), few


class _Sums:
    """Sums of the divergence over terms, for each pair of sources of one language."""

    def __init__(self, sources: list[tuple[str, int]], terms: int) -> None:
        self.names = [name for name, _ in sources]
        self.place = {name: at for at, name in enumerate(self.names)}
        self.under = [total + 2 * terms for _, total in sources]
        self.absent = np.array([1 + SCALE * 2 // under if under else 0 for under in self.under], dtype=np.int64)
        self.total = np.zeros((len(sources), len(sources)), dtype=np.int64)

    def add(self, line: np.ndarray, source: list[str], n: np.ndarray) -> None:
        """Counts n of (line, source), where lines 0, 1, ... are terms, in order."""
        at = np.fromiter(map(self.place.__getitem__, source), dtype=np.int64, count=len(source))
        over = n + 2 if n.max(initial=0) < SMALL else n.astype(object) + 2
        under = np.array(self.under, dtype=np.int64)[at]
        p = (1 + over * SCALE // under).astype(np.int64)
        height = max(1, CELLS // len(self.names))
        for low in range(0, int(line[-1]) + 1 if len(line) else 0, height):
            some = slice(*np.searchsorted(line, [low, low + height]))
            matrix = np.tile(self.absent, (line[some][-1] - low + 1, 1))
            matrix[line[some] - low, at[some]] = p[some]
            for a in range(len(self.names) - 1):
                left, right = matrix[:, a : a + 1], matrix[:, a + 1 :]
                self.total[a, a + 1 :] += ((left - right) ** 2 // (left + right)).sum(axis=0)

    def rows(self, lang: str) -> list[tuple]:
        pairs = zip(*(x.tolist() for x in np.triu_indices(len(self.names), 1)), strict=True)
        return [(lang, self.names[a], self.names[b], int(self.total[a, b])) for a, b in pairs]


PAIR = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])
PAIR_ROW = "lang string, a string, b string, value long"


def _pair_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(PAIR)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PAIR, strict=True)], schema=PAIR)


def _sum_pairs(batches: Iterator[pa.RecordBatch], sizes: dict[str, tuple[list, int]]) -> Iterator[pa.RecordBatch]:
    """Sums over the terms of a task, one row per pair of sources."""
    sums: dict[str, _Sums] = {}
    for batch in batches:
        lists = batch["by_source"]
        lang, length = batch["lang"], lists.value_lengths().to_numpy()
        source, n = (lists.flatten().field(i) for i in (0, 1))
        row = np.repeat(np.arange(len(lang)), length)
        for one in pc.unique(lang).to_pylist():
            mine = pc.equal(lang, one).to_numpy(zero_copy_only=False)
            here = mine[row]
            line = np.cumsum(mine)[row[here]] - 1
            where = pa.array(np.flatnonzero(here))
            sums.setdefault(one, _Sums(*sizes[one])).add(line, source.take(where).to_pylist(), n.take(where).to_numpy())
    yield _pair_batch([row for lang, one in sums.items() for row in one.rows(lang)])


def _sum_slice(rows: pa.Table, sources: pa.Table) -> pa.Table:
    """The same for one slice of the terms of a language."""
    if not sources.num_rows or not rows.num_rows:
        return pa.Table.from_batches([], PAIR)
    found = _Sums(
        list(zip(sources["source"].to_pylist(), sources["total"].to_pylist(), strict=True)), sources["terms"][0].as_py()
    )
    numbers = pc.rank(rows["term"], tiebreaker="dense").to_numpy() - 1
    order = np.argsort(numbers, kind="stable")
    found.add(numbers[order].astype(np.int64), rows["source"].take(pa.array(order)).to_pylist(), rows["n"].to_numpy()[order])
    return pa.Table.from_batches([_pair_batch(found.rows(sources["lang"][0].as_py()))])


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets the sources of a language apart.

    `pair`: every other source of the language, by the divergence of their smoothed term shares summed over all kept
    terms. `term`: the `top` terms that the source uses more than its language. Ranks go by value, then by item.
    Needs text, lang and source; null counts as ''. Rows are documents, also repeated ones; other columns
    are not read. A language without kept terms has pairs of value 0. An empty table gives no rows.
    """
    kept, groups, few = term_counts(docs, least_docs)
    each = kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("by_source"))
    of_source = each.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    sizes = staged(
        groups.join(of_source, ["lang", "source"], "left")
        .join(of_lang, "lang", "left")
        .na.fill(0, ["total", "rows", "lang_total", "terms"])
        .withColumn("parts", (F.floor(F.sum("rows").over(Window.partitionBy("lang")) / ROWS) + 1).cast("int")),
        "sizes",
    )
    if few:
        sent: dict[str, tuple[list, int]] = {}
        for row in sizes.select("lang", "source", "total", "terms").collect():
            sent.setdefault(row.lang, ([], row.terms))[0].append((row.source, row.total))
        sums = kept.select("lang", "by_source").mapInArrow(lambda batches: _sum_pairs(batches, sent), PAIR_ROW)
    else:
        parts = sizes.select("lang", "parts").distinct()
        sliced = each.join(parts, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
        every = sizes.select(
            *[F.col(c).alias(c) for c in ("lang", "source", "total", "terms")],
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"),
        )
        sums = (
            sliced.select("lang", "slice", "source", "term", "n")
            .groupBy("lang", "slice")
            .cogroup(every.groupBy("lang", "slice"))
            .applyInArrow(_sum_slice, PAIR_ROW)
        )
    # Languages without kept terms have pairs too.
    other = groups.select(F.col("lang").alias("lang"), F.col("source").alias("item"))
    summed = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    two = [F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")]
    both = summed.select("lang", "value", F.inline(F.array(*two)))
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (
        groups.join(other, "lang")
        .where("source <> item")
        .join(both, ["lang", "source", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
        .withColumn("rank", F.row_number().over(ordered))
    )
    terms = (
        each.join(sizes, ["lang", "source"])
        .select(
            "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
            _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
            _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
        )
        .where("p > q")
        .select("lang", "source", "part", "item", _divergence(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(ordered))
        .where(F.col("rank") <= top)
    )
    return pairs.unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all whole texts of `documents`."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents
), occurrences AS (
  SELECT id, lang, source,
    translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT o.lang, o.source, o.term, count(*) AS n FROM occurrences o JOIN kept k ON o.lang = k.lang AND o.term = k.term
  GROUP BY o.lang, o.source, o.term
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS lang_n
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT c.lang, c.source, c.term, c.n,
    1 + 1000000000 * (c.n + 2) // (sum(c.n) OVER (PARTITION BY c.lang, c.source)::HUGEINT + 2 * l.v) AS p,
    1 + 1000000000 * (c.lang_n + 2) // (l.total + 2 * l.v) AS q
  FROM cells c JOIN langs l ON c.lang = l.lang
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 10
"""
