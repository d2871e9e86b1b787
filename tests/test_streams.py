"""Streams in several runs and batches, out of order, against their batch twins."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import requests
from shelfwise.plans import derived, pipeline
from shelfwise.sources import landing
from shelfwise.streaming import pages as stream_pages
from shelfwise.streaming import runner, state

LONG = "20000 days"


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").coalesce(1).cache()


def landed(events, path, order):
    """Three files, each a third of the events, in this order of arrival."""
    cuts = events.approxQuantile("event_id", [1 / 3, 2 / 3], 0)
    part = sum((F.col("event_id") > c).cast("int") for c in cuts)
    for place, number in enumerate(order):
        events.where(part == number).write.parquet(f"{path}/part={place}")
    stream = events.sparkSession.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    return stream.option("recursiveFileLookup", "true").parquet(path)


def pairs(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("order", [(2, 0, 1), (2, 1, 0)])
def test_files_out_of_order_give_the_batch_result(spark, events, tmp_path, order):
    stream = landed(events, str(tmp_path / "in"), order)
    log, stored = derived.request_log_of(events), derived.request_log_of(stream)
    assert pairs(state.pacing_deny(stored, 0.01, 3, LONG), "event_id", "allowed") == pairs(
        requests.pacing_deny(log, 0.01, 3), "event_id", "allowed"
    )
    ok = F.col("status_code") == 200
    assert pairs(state.cache_hits(stored.withColumn("ok", ok), 3600, LONG), "event_id", "hit") == pairs(
        requests.cache_hits(log, 3600, ok=ok), "event_id", "hit"
    )


def test_rows_behind_the_watermark_are_listed_and_change_nothing(spark, events, tmp_path):
    stream = derived.job_events_of(landed(events, str(tmp_path / "in"), (2, 0, 1)))
    failed = derived.job_events_of(events).where("status = 'failed'")
    out = str(tmp_path / "out")
    routed = state.retries(stream, out=out).where("status <> 'due'")
    late = state.late_rows(spark, out)
    assert late.count() > 0
    both = pairs(routed, "job_id", "event_id") + pairs(late, "job_id", "event_id")
    assert sorted(both, key=repr) == pairs(failed, "job_id", "event_id")
    in_time = failed.join(routed.select("event_id"), "event_id", "left_semi")
    from shelfwise.operators import jobs

    assert pairs(routed, "event_id", "attempt") == pairs(jobs.number_failures(in_time), "event_id", "attempt")


def _log(spark, path, rows):
    table = spark.createDataFrame(rows, "job_id bigint, event_id bigint, s bigint, status string, progress int")
    table.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(path)
    schema = "job_id bigint, event_id bigint, status string, progress int, ts timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_null_progress_and_times_do_not_end_the_stream(spark, tmp_path):
    rows = [
        (1, 1, 10, "running", None), (1, 2, 20, "running", None), (1, 3, 30, "running", 5), (1, 4, 40, "running", None),
        (1, 5, 50, "completed", None), (1, 6, 60, "running", 7), (2, 7, None, "running", 1),
    ]
    out = str(tmp_path / "out")
    found = state.progress(_log(spark, str(tmp_path / "in"), rows), out=out)
    assert pairs(found, "event_id", "progress") == [(1, None), (3, 5), (4, None), (5, None)]
    assert pairs(state.late_rows(spark, out), "event_id") == [(7,)]


def _held(spark, out, name):
    with runner.rocksdb_state(spark):
        return spark.read.format("statestore").option("stateVarName", name).load(runner.checkpoint_of(out)).count()


def test_closed_jobs_and_expired_keys_hold_no_state_and_retries_come_due(spark, tmp_path):
    """A later row moves the watermark: the keys of the earlier ones are woken and leave nothing behind."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    many = [(job, job, 100 + job, "failed", 1) for job in range(50)]
    state.retries(_log(spark, source, many), lateness="1 second", retention=1000, out=out)
    assert _held(spark, out, "settled") + _held(spark, out, "buffer") >= 50
    routed = state.retries(_log(spark, source, [(99, 99, 10_000, "failed", 1)]), lateness="1 second", retention=1000, out=out)
    assert _held(spark, out, "settled") == 0 and _held(spark, out, "buffer") == 1
    assert sorted(r.event_id for r in routed.where("status = 'due'").collect()) == list(range(50))
    due = routed.where("status = 'due' AND event_id = 7").first().next_retry_at
    assert due == routed.where("status = 'retrying' AND event_id = 7").first().next_retry_at


CARD = '<a href="/p/tea/-/A-{0}"><h3>Green Tea {0}</h3></a>'


def _page(*numbers):
    return "".join(CARD.format(10_000_000 + n) for n in numbers)


def _land(spark, path, rows, fmt="parquet"):
    pages = spark.createDataFrame(rows, "keyword string, page_no int, html string")
    pages.coalesce(1).write.format(fmt).mode("append").save(path)


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_a_second_run_adds_to_the_first_and_artefacts_are_replaced(spark, tmp_path, fmt):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _land(spark, source, [("tea", 2, _page(1, 2)), ("pot", 1, _page(5) + CARD.format(77)), ("tea", None, "lost")], fmt)
    stream_pages.run(stream_pages.page_stream(spark, source, 1, fmt), out)
    _land(spark, source, [("tea", 1, _page(2, 3)), ("cup", 1, None)], fmt)
    stream_pages.run(stream_pages.page_stream(spark, source, 1, fmt), out)
    stream_pages.run(stream_pages.page_stream(spark, source, 1, fmt), out)  # nothing new

    products = pairs(stream_pages.read_products(spark, out), "keyword", "page_no", "item_number")
    assert products == [("pot", 1, "10000005"), ("tea", 1, "10000002"), ("tea", 1, "10000003"), ("tea", 2, "10000001")]
    for stored in (landing.read_products_json(spark, f"{out}/json"), landing.read_products_csv(spark, f"{out}/csv")):
        assert sorted(r.item_number for r in stored.collect()) == ["10000001", "10000002", "10000003", "10000005"]
    assert pairs(stream_pages.read_rejected(spark, out), "item_number") == [("77",)]
    commits = pairs(stream_pages.read_commits(spark, out), "batch_id", "pages", "products", "rejected", "unreadable")
    assert commits == [(0, 3, 3, 1, 1), (1, 2, 2, 0, 1)]
    letters = [json.loads(x) for f in Path(out).glob("dead_letters/*/part-*") for x in f.read_text().splitlines()]
    assert sorted((x.get("keyword"), x["error"]) for x in letters) == [
        ("cup", stream_pages.UNREADABLE), ("tea", stream_pages.UNREADABLE),
    ]


def test_an_aborted_batch_leaves_no_double_rows(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _land(spark, source, [("tea", 1, _page(1, 2))])

    def stop(*_, **__):
        raise RuntimeError("lost")

    for broken in ("write_dead_letters", "write_products_json"):  # before and after the commit row
        with monkeypatch.context() as patch:
            patch.setattr(stream_pages.sinks, broken, stop)
            with pytest.raises(Exception, match="lost"):
                stream_pages.run(stream_pages.page_stream(spark, source), out)
        if broken == "write_dead_letters":
            assert stream_pages.read_products(spark, out).count() == 0
    stream_pages.run(stream_pages.page_stream(spark, source), out)
    assert stream_pages.read_products(spark, out).count() == 2
    assert landing.read_products_json(spark, f"{out}/json").count() == 2
    assert stream_pages.read_commits(spark, out).count() == 1


def test_streamed_products_equal_a_run_over_all_pages(spark, sf_dir, tmp_path):
    pages = derived.listing_pages(spark, sf_dir)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    pages.repartition(3).write.parquet(source)
    stream_pages.run(stream_pages.page_stream(spark, source, 1), out)
    batch = pipeline.run(pages, max_pages=None).products
    columns = ("keyword", "page_no", "pos", "item_number", "title", "price")
    assert pairs(stream_pages.read_products(spark, out), *columns) == pairs(batch, *columns)


class _Held:
    """State of one bucket, in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return bool(self.value)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.value = {**(self.value or {}), key: value}

    def getValue(self, key):
        return (self.value or {}).get(key)

    def removeKey(self, key):
        del self.value[key]

    def iterator(self):
        return iter(self.value.items())

    def appendList(self, values):
        self.value = [*(self.value or []), *values]

    def clear(self):
        self.value = None


class _Bucket:
    """A handle whose timers are a list, and its own clock."""

    def __init__(self, passed=0):
        self.held, self.timers, self.ms = {}, [], passed

    def _state(self, name, *_):
        return self.held.setdefault(name, _Held())

    getValueState = getListState = getMapState = _state

    def registerTimer(self, ms):
        self.timers.append(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.timers.pop(0)


def test_a_hot_key_is_answered_and_held_piece_by_piece(monkeypatch):
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(state, "PIECE", 1000)
    monkeypatch.setattr(state, "RUN", 20_000, raising=False)
    n = 200_000
    at = np.random.default_rng(1).permutation(n) * 1_000_000 + 1_000_000_000
    bucket = _Bucket()
    processor = state.InOrder(state.Walk(requests.bucket_rule(0.25, 3)), "endpoint", "string")
    processor.init(bucket)
    pieces = (
        pd.DataFrame({"endpoint": "click", "at": at[low : low + 5000], "event_id": at[low : low + 5000], "ok": True})
        for low in range(0, n, 5000)
    )
    found, most, before = [], 0, pa.total_allocated_bytes()
    for answered in processor.handleInputRows((0,), pieces, bucket):
        most = max(most, pa.total_allocated_bytes() - before)
        found.append((len(answered), answered["at"].to_numpy(), answered["answer"].to_numpy(dtype=int)))
    assert max(rows for rows, _, _ in found) <= state.PIECE
    # A row takes some 37 bytes; a part of the rows is held at a time.
    assert most < 37 * n / 2
    flags, _ = requests.walk_bucket(np.sort(at), None, 4_000_000, 12_000_000)
    assert np.concatenate([times for _, times, _ in found]).tolist() == np.sort(at).tolist()
    assert np.concatenate([answers for _, _, answers in found]).tolist() == flags.astype(int).tolist()

    bucket.ms = 10**9  # The watermark passes all rows, and the bucket is full again: nothing stays, nothing is said twice.
    assert list(processor.handleExpiredTimer((0,), bucket, bucket)) == []
    assert not any(held.exists() for held in bucket.held.values()) and not bucket.timers


def test_many_keys_share_buckets_and_keep_their_own_states(spark, tmp_path):
    """Null is a key too; rows of a second run go on from the states of the first."""
    source = str(tmp_path / "in")
    keys = [None, *range(2000)]
    first = [(job, 4 * i + e, 100 + e, status, p) for i, job in enumerate(keys) for e, (status, p) in enumerate([("failed", 1), ("running", 1)])]
    later = [(job, 4 * i + 2 + e, 5000 + e, status, 2) for i, job in enumerate(keys) for e, status in enumerate(["failed", "running"])]
    retried, changed = str(tmp_path / "retried"), str(tmp_path / "changed")
    held = {}
    for rows in (first, later):
        stream = _log(spark, source, rows)
        routed = state.retries(stream, lateness="1 second", out=retried)
        seen = state.progress(stream, lateness="1 second", out=changed)
        held = {out: max(held.get(out, 0), _held(spark, out, "buffer")) for out in (retried, changed)}
    # Rows wait by bucket, not by key.
    assert 0 < held[retried] <= state.BUCKETS and 0 < held[changed] <= state.BUCKETS
    decided = routed.where("status = 'retrying'")
    assert pairs(decided, "event_id", "attempt") == sorted(((4 * i + 2 * k, 1 + k) for i in range(2001) for k in (0, 1)), key=repr)
    # The terminal event of each job closes it.
    assert pairs(seen, "event_id") == sorted(((4 * i,) for i in range(2001)), key=repr)
