"""Job and request streams with state per key, in the order of events.

Rows of a key wait in a buffer until the watermark has passed them, and until then each new row can change
the answers of later ones: a batch puts out every answer that is new or has changed, and the newest one counts. So
answers come at once and end up as if all rows had come in order. The event time is hidden from Spark
behind the operator, which would drop rows behind the watermark; here they go to a side table instead.

Keys are dealt to a fixed number of buckets by hash, and Spark groups by bucket. What a call of the processor costs is paid
once per bucket and batch instead of once per key; inside a bucket rows are columns of numbers, a slice per key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from shelfwise import schemas
from shelfwise.operators import jobs, requests, stateful
from shelfwise.operators.requests import MICROS
from shelfwise.schemas import TERMINAL_STATUSES
from shelfwise.streaming.runner import drained_table, stored_table

# How far out of order rows may come, and how long a key without new rows is remembered.
LATENESS = "10 minutes"
RETENTION_SECONDS = 30 * 86_400
# Rows of one piece of a buffer, or of the answers, and new rows that are sorted in memory.
PIECE = 10_000
RUN = 500_000
# Buckets of keys. Checkpoints hold state by bucket, so the number is fixed.
BUCKETS = 256
BUCKET = "_bucket"
ARROW_TYPES = {
    "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "boolean": pa.bool_(),
    "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "date": pa.date32(),
}


def event_stream(spark: SparkSession, path: str, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schemas.EVENTS)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def live_jobs(events: DataFrame, out: str | None = None) -> DataFrame:
    """Job table kept up to date: each batch puts out the jobs it has changed."""
    last = F.max_by(
        F.struct("status", "progress", "keyword", "error", "ts"), F.struct("ts", "event_id")
    )
    changed = drained_table(events.groupBy("job_id").agg(last.alias("last")), "update", "jobs", out)
    newest = changed.groupBy("job_id").agg(F.max_by("last", "batch_id").alias("last"))
    return newest.select(
        "job_id",
        "last.status",
        "last.progress",
        "last.keyword",
        "last.error",
        F.col("last.ts").alias("updated_at"),
    )


class Sequence(Protocol):
    """A rule over the rows of a key in order: columns it reads and keeps, and its answers, numbers from 0."""

    reads: str
    state: str

    def columns(self, rows: pa.Table) -> dict[str, np.ndarray]:
        """What the rule needs of the rows of a bucket, without nulls."""
        ...

    def answers(self, rows: dict[str, np.ndarray], state: tuple | None) -> tuple[np.ndarray, tuple]:
        """The answers to rows of one key, and the state after them."""
        ...

    def forgotten(self, state: tuple, last: int) -> int:
        """Time from which on the state says nothing any more; `last` is that of the last row."""
        ...


@dataclass(frozen=True)
class Walk:
    """A sequential rule of requests; answers are its flags."""

    rule: stateful.Rule
    reads: str = "ok boolean"
    state: str = "state bigint"

    def columns(self, rows: pa.Table) -> dict[str, np.ndarray]:
        return {"at": rows["at"].to_numpy(), "ok": pc.fill_null(rows["ok"], False).to_numpy()}

    def answers(self, rows: dict[str, np.ndarray], state: tuple | None) -> tuple[np.ndarray, tuple]:
        flags, end = np.zeros(len(rows["at"]), dtype=bool), state[0] if state else None
        for low in range(0, len(flags), PIECE):
            piece = slice(low, low + PIECE)
            flags[piece], end = self.rule.walk(rows["at"][piece], end, ok=rows["ok"][piece])
        return flags, (int(end),)

    def forgotten(self, state: tuple, last: int) -> int:
        return state[0]


@dataclass(frozen=True)
class ProgressChanges:
    """Answers 1 where the progress of a job has changed, and for its terminal event; a closed job answers 0.

    A null progress is a value like any other.
    """

    retention: int
    reads: str = "status string, progress int"
    state: str = "known boolean, progress int, closed boolean"
    # Stands for null among the numbers; no int has it.
    nothing: int = 2**40

    def columns(self, rows: pa.Table) -> dict[str, np.ndarray]:
        terminal = pc.is_in(rows["status"], value_set=pa.array(TERMINAL_STATUSES, pa.string()))
        progress = pc.fill_null(rows["progress"].cast(pa.int64()), self.nothing)
        return {"terminal": terminal.to_numpy(), "progress": progress.to_numpy()}

    def answers(self, rows: dict[str, np.ndarray], state: tuple | None) -> tuple[np.ndarray, tuple]:
        known, before, closed = state or (False, None, False)
        terminal, progress = rows["terminal"], rows["progress"]
        changed = np.ones(len(progress), dtype=bool)
        changed[1:] = progress[1:] != progress[:-1]
        if known:
            changed[0] = progress[0] != (self.nothing if before is None else before)
        over = np.logical_or.accumulate(terminal) | closed
        found = changed | terminal
        found[0] &= not closed
        found[1:] &= ~over[:-1]
        end = int(progress[-1])
        return found, (True, None if end == self.nothing else end, bool(over[-1]))

    def forgotten(self, state: tuple, last: int) -> int:
        return last + self.retention


@dataclass(frozen=True)
class Attempts:
    """Answers the number of each failure within its job."""

    retention: int
    reads: str = ""
    state: str = "attempts bigint"

    def columns(self, rows: pa.Table) -> dict[str, np.ndarray]:
        return {"at": rows["at"].to_numpy()}

    def answers(self, rows: dict[str, np.ndarray], state: tuple | None) -> tuple[np.ndarray, tuple]:
        before, n = state[0] if state else 0, len(rows["at"])
        return np.arange(before + 1, before + n + 1), (before + n,)

    def forgotten(self, state: tuple, last: int) -> int:
        return last + self.retention


def _pieces(rows: pa.Table) -> Iterator[pa.Table]:
    for low in range(0, rows.num_rows, PIECE):
        yield rows.slice(low, PIECE)


def _packed(rows: pa.Table) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows.combine_chunks())
    return (sink.getvalue().to_pybytes(),)


def _sorted(rows: pa.Table, by: list[str]) -> pa.Table:
    """Nulls come last."""
    return rows.take(pc.sort_indices(rows, [(c, "ascending") for c in by])).combine_chunks()


def _merged(runs: list[Iterator[pa.Table]], by: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted runs in order, a block at a time; about a piece of each run is held."""
    if len(runs) == 1:
        yield from runs[0]
        return
    held: list[pa.Table] = []

    def load(run: int) -> None:
        piece = next(runs[run], None)
        if piece is not None:
            # The run whose piece ends with this row; what comes after it can be up to the next piece.
            ends = np.full(piece.num_rows, -1)
            ends[-1] = run
            held.append(piece.append_column("ends", pa.array(ends)))

    for run in range(len(runs)):
        load(run)
    while held:
        rows = _sorted(pa.concat_tables(held), by)
        ends = rows["ends"].to_numpy()
        cut = int(np.argmax(ends >= 0))
        yield rows.slice(0, cut + 1).drop_columns("ends")
        held = [rows.slice(cut + 1)] if cut + 1 < rows.num_rows else []
        load(int(ends[cut]))


@dataclass
class _Key:
    """Where a key stands while its rows are walked."""

    of: object
    known: bool
    settled: tuple | None
    last: int | None
    now: tuple | None
    changed: bool = False
    waits: int | None = None


class InOrder(StatefulProcessor):
    """Applies a rule to the rows of each key of a bucket in order of (at, event_id), whatever order they come in.

    Holds the rule's state of each key after all rows behind the watermark, and a buffer of the others, in order, with
    their answers. A timer wakes the bucket when the watermark has passed the first row of its buffer, and when the state
    of a key says nothing any more: then the key leaves nothing behind.

    The buffer is read and written piece by piece. Many new rows are sorted in runs, which wait beside the buffer and are
    merged with it, so memory does not grow with the rows of a key.
    """

    def __init__(self, rule: Sequence, key: str, kind: str, delays: tuple[int, ...] = (), most: int = 0):
        self.rule, self.key, self.kind, self.delays, self.most = rule, key, kind, delays, most
        reads = [tuple(c.split()) for c in rule.reads.split(", ") if c]
        self.names = ["at", "event_id", *(name for name, _ in reads)]
        typed = [(key, kind), ("at", "bigint"), ("event_id", "bigint"), *reads]
        self.schema = pa.schema([(name, ARROW_TYPES[of]) for name, of in typed])
        self.order = [key, "at", "event_id"]

    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getMapState("settled", f"{self.key} {self.kind}", f"{self.rule.state}, last bigint")
        self.buffer = handle.getMapState("buffer", "number bigint", "piece binary")
        self.numbers = handle.getValueState("numbers", "low bigint, high bigint")
        self.wake = handle.getValueState("wake", "ms bigint")
        if self.delays:
            self.due = handle.getListState("due", f"{self.key} {self.kind}, at bigint, event_id bigint, attempt bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        low, high = self.numbers.get() if self.numbers.exists() else (0, 0)
        runs, new, size = [(low, high)], [], 0
        for piece in rows:
            some = pa.Table.from_pandas(piece[self.schema.names], self.schema, preserve_index=False)
            in_time = pc.fill_null(pc.greater_equal(some["at"], passed), False)
            yield from self._out(some.filter(pc.invert(in_time)), None, late=True)
            some = some.filter(in_time)
            new.append(some.append_column("answer", pa.nulls(some.num_rows, pa.int64())))
            size += some.num_rows
            if size >= RUN:
                first, high = high, self._store(_pieces(_sorted(pa.concat_tables(new), self.order)), high)
                runs.append((first, high))
                new, size = [], 0
        sources = [self._stored(*run) for run in runs if run[0] < run[1]]
        if size:
            sources.append(_pieces(_sorted(pa.concat_tables(new), self.order)))
        del new
        if sources:
            yield from self._settle(passed, sources, high, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.wake.exists() and self.wake.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.wake.clear()
            low, high = self.numbers.get() if self.numbers.exists() else (0, 0)
            yield from self._settle(timerValues.getCurrentWatermarkInMs() * 1000, [self._stored(low, high)], high, True)

    def _settle(self, passed: int, runs: list[Iterator[pa.Table]], free: int, woken: bool) -> Iterator[pd.DataFrame]:
        """Answers what waits, and settles what the watermark has passed; when woken, looks at all states that are held.

        What still waits is stored again, under numbers from `free` on.
        """
        held = self.settled.exists()
        states = {tuple(of)[0]: tuple(state) for of, state in self.settled.iterator()} if held and woken else {}
        times, certain, waiting, size, high = [], [], [], 0, free
        one = None
        for rows in _merged(runs, self.order):
            at, numbers = rows["at"].to_numpy(), self.rule.columns(rows)
            answers = np.zeros(rows.num_rows, dtype="int64")
            done = np.zeros(rows.num_rows, dtype=bool)
            for of, low, top in self._keys(rows):
                if one is None or of != one.of:
                    if one is not None:
                        times += self._finish(one, passed)
                    found = states.pop(of, None) if woken else self.settled.getValue((of,)) if held else None
                    *state, last = found or (None,)
                    state = tuple(state) if found else None
                    one = _Key(of, found is not None, state, last, state)
                end = low + int(np.searchsorted(at[low:top], passed, side="left"))
                for first, after in ((low, end), (end, top)):
                    if first < after:
                        part = {c: v[first:after] for c, v in numbers.items()}
                        answers[first:after], one.now = self.rule.answers(part, one.now)
                        if after == end:
                            one.settled, one.last, one.changed = one.now, int(at[end - 1]), True
                if end < top and one.waits is None:
                    one.waits = int(at[end])
                done[low:end] = True
            before = pc.fill_null(rows["answer"], -1).to_numpy()
            yield from self._out(rows.filter(pa.array(before != answers)), answers[before != answers])
            rows = rows.set_column(rows.num_columns - 1, "answer", pa.array(answers))
            if self.delays:
                certain.append(rows.filter(pa.array(done & (answers <= self.most))))
            waiting.append(rows.filter(pa.array(~done)))
            size += waiting[-1].num_rows
            if size >= PIECE:
                high = self._store(_pieces(pa.concat_tables(waiting)), high)
                waiting, size = [], 0
        if size:
            high = self._store(_pieces(pa.concat_tables(waiting)), high)
        self.numbers.update((free, high)) if free < high else self.numbers.clear()
        if one is not None:
            times += self._finish(one, passed)
        for of, (*state, last) in states.items():
            times += self._finish(_Key(of, True, tuple(state), last, None), passed)
        if self.delays:
            come, times = self._due(passed, certain, woken, times)
            yield from self._out(come, come["answer"].to_numpy(), due=True)
        if times:
            self._wake_at(min(times) // 1000 + 1)

    def _finish(self, one: _Key, passed: int) -> list[int]:
        """Stores the state of a key, or forgets it; when to look at the key again."""
        over = self.rule.forgotten(one.settled, one.last) if one.waits is None else one.waits
        if over <= passed:
            if one.known:
                self.settled.removeKey((one.of,))
            return []
        if one.changed:
            self.settled.updateValue((one.of,), (*one.settled, one.last))
        return [over]

    def _store(self, pieces: Iterator[pa.Table], number: int) -> int:
        """The next number that is free."""
        for piece in pieces:
            self.buffer.updateValue((number,), _packed(piece))
            number += 1
        return number

    def _stored(self, low: int, high: int) -> Iterator[pa.Table]:
        """Takes pieces out of the buffer."""
        for number in range(low, high):
            (piece,) = self.buffer.getValue((number,))
            self.buffer.removeKey((number,))
            yield pa.ipc.open_stream(piece).read_all()

    def _keys(self, rows: pa.Table) -> Iterator[tuple[object, int, int]]:
        """Each key of sorted rows, and where its rows begin and end."""
        if not rows.num_rows:
            return
        coded = pc.dictionary_encode(rows[self.key], null_encoding="encode").combine_chunks()
        codes = coded.indices.to_numpy()
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        names = coded.dictionary.to_pylist()
        for low, high in zip(edges, edges[1:]):
            yield names[codes[low]], low, high

    def _due(self, passed: int, certain: list[pa.Table], woken: bool, times: list[int]) -> tuple[pa.Table, list[int]]:
        """Retries that have come due; the others of failures that are certain are noted, with the time of the first."""
        schema = self.schema.append(pa.field("answer", pa.int64()))
        done = pa.concat_tables([schema.empty_table(), *certain])
        waits = np.array(self.delays, dtype="int64")[np.minimum(done["answer"].to_numpy(), len(self.delays)) - 1] * MICROS
        planned = done.set_column(1, "at", pa.array(done["at"].to_numpy() + waits))
        names = [self.key, "at", "event_id", "answer"]
        old = woken and self.due.exists()
        if old:
            noted = dict(zip(names, zip(*self.due.get())))
            columns = [pa.array(noted.get(f.name, [None] * len(noted["at"])), f.type) for f in schema]
            planned = pa.concat_tables([pa.table(columns, schema=schema), planned])
            self.due.clear()
        come = pc.less_equal(planned["at"], passed)
        rest = planned.filter(pc.invert(come))
        listed = list(zip(*(rest[n].to_pylist() for n in names)))
        for low in range(0, len(listed), PIECE):
            self.due.appendList(listed[low : low + PIECE])
        return planned.filter(come), times + ([pc.min(rest["at"]).as_py()] if listed else [])

    def _wake_at(self, ms: int) -> None:
        """The one timer of the bucket: what can happen next is never before it."""
        before = self.wake.get()[0] if self.wake.exists() else None
        if before is not None and before <= ms:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.wake.update((ms,))
        self.handle.registerTimer(ms)

    def _out(self, rows: pa.Table, answers: np.ndarray | None, late: bool = False, due: bool = False) -> Iterator[pd.DataFrame]:
        for low in range(0, rows.num_rows, PIECE):
            out = rows.select(self.schema.names).slice(low, PIECE).to_pandas(integer_object_nulls=True)
            some = [None] * len(out) if answers is None else answers[low : low + PIECE]
            yield out.assign(answer=pd.array(some, dtype="Int64"), late=late, due=due)

    def close(self) -> None:
        pass


def in_order(
    stream: DataFrame,
    key: str,
    rule: Sequence,
    purpose: str,
    lateness: str = LATENESS,
    out: str | None = None,
    **planned: object,
) -> DataFrame:
    """Newest answer of each row of the stream that came in time: (key, at, event_id, columns read, answer, due).

    Rows without a time, or behind the watermark, are in `late_rows(spark, out)`. With `out` the stream goes on from
    where the last call for this folder has stopped.
    """
    rows = stream.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    kind = dict(stream.dtypes)[key]
    processor = InOrder(rule, key, kind, **planned)
    reads = f"{rule.reads}, " if rule.reads else ""
    answered = (
        rows.select(F.pmod(F.hash(key), F.lit(BUCKETS)).alias(BUCKET), key, *processor.names)
        .groupBy(BUCKET)
        .transformWithStateInPandas(
            processor,
            f"{key} {kind}, at bigint, event_id bigint, {reads}answer bigint, late boolean, due boolean",
            "append",
            "eventTime",
        )
    )
    stored = drained_table(answered, "append", purpose, out, ["late"])
    return newest_answers(stored, key)


def newest_answers(stored: DataFrame, key: str) -> DataFrame:
    values = [c for c in stored.columns if c not in (key, "event_id", "due", "batch_id", "late")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("newest")
    return stored.where("not late").groupBy(key, "event_id", "due").agg(newest).select(key, "event_id", "due", "newest.*")


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The side table of a stream with a folder of its own."""
    return stored_table(spark, out).where(F.col("late").cast("boolean")).drop("late", "due", "answer")


def progress(events: DataFrame, lateness: str = LATENESS, retention: int = RETENTION_SECONDS, out: str | None = None) -> DataFrame:
    """Events that changed the progress of their job, and terminal ones, up to the first terminal one."""
    rows = events.select("job_id", "event_id", "ts", "status", "progress")
    answered = in_order(rows, "job_id", ProgressChanges(retention * MICROS), "progress", lateness, out)
    return answered.where("answer = 1").select("job_id", "event_id", "status", "progress")


def retries(
    events: DataFrame,
    max_retries: int = jobs.MAX_RETRIES,
    delays: tuple[int, ...] = jobs.RETRY_DELAYS,
    lateness: str = LATENESS,
    retention: int = RETENTION_SECONDS,
    out: str | None = None,
) -> DataFrame:
    """Each failure with its number and what becomes of it; a row of status `due` says that a retry has come due."""
    failed = events.where(F.col("status") == "failed").select("job_id", "event_id", "ts")
    answered = in_order(
        failed, "job_id", Attempts(retention * MICROS), "retries", lateness, out, delays=delays, most=max_retries
    )
    dead = F.col("answer") > max_retries
    at = F.timestamp_micros("at")
    then = F.timestamp_add("SECOND", jobs.retry_delay(F.col("answer"), delays), at)
    return answered.select(
        "job_id",
        "event_id",
        F.col("answer").cast("int").alias("attempt"),
        F.when(F.col("due"), at).when(~dead, then).alias("next_retry_at"),
        F.when(F.col("due"), "due").when(dead, "dead_letter").otherwise("retrying").alias("status"),
    )


def cache_hits(
    log: DataFrame, ttl_seconds: int = requests.TTL_SECONDS, lateness: str = LATENESS, out: str | None = None
) -> DataFrame:
    """Hit or miss per request; hits do not refresh an entry. Only runs that are `ok` (a column, if there is one) are stored."""
    ok = F.coalesce("ok", F.lit(False)) if "ok" in log.columns else F.lit(True)
    rows = requests.keyed(log).select("event_id", "key", "ts", ok.alias("ok"))
    answered = in_order(rows, "key", Walk(requests.cache_rule(ttl_seconds)), "cache", lateness, out)
    return answered.select("event_id", "key", (F.col("answer") == 0).alias("hit"))


def pacing_deny(log: DataFrame, rate: float, capacity: int, lateness: str = LATENESS, out: str | None = None) -> DataFrame:
    """Allowed or dropped per request, one bucket per endpoint."""
    rows = log.select("event_id", "endpoint", "ts", F.lit(True).alias("ok"))
    answered = in_order(rows, "endpoint", Walk(requests.bucket_rule(rate, capacity)), "pacing", lateness, out)
    return answered.select("event_id", "endpoint", (F.col("answer") == 1).alias("allowed"))
