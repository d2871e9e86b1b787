"""Operators against brute force on small, skewed fixtures."""

import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.operators import (
    dedup,
    details,
    jobs,
    links,
    paging,
    requests,
    scan,
    stateful,
    summary,
    validate,
)
from shelfwise.plans import pipeline
from shelfwise.schemas import PRODUCT_COLUMNS
from shelfwise.streaming import state


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows; values repeat and some are missing."""
    rng = random.Random(7)
    rows = [
        ("hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}", t, rng.choice([None, 1, 2, 3]))
        for t in range(3000)
    ]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "key string, t bigint, v bigint").repartition(8).cache()


@pytest.mark.parametrize("width", [None, 1, 50, 10_000])
def test_chunked_scans_equal_plain_windows(skewed, width):
    earlier = Window.partitionBy("key").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    values = {"s": (F.col("v"), scan.SUM), "m": (F.col("v"), scan.MAX), "l": (F.col("v"), scan.LAST)}
    plain = skewed.select(
        "key", "t", "v",
        F.coalesce(F.sum("v").over(earlier), F.lit(0)).alias("s"),
        F.max("v").over(earlier).alias("m"),
        F.last("v", True).over(earlier).alias("l"),
    )
    chunk = None if width is None else F.floor(F.col("t") / width)
    chunked = scan.before(skewed, ["key"], ["t"], values, chunk)
    assert sorted(chunked.select(*plain.columns).collect(), key=repr) == sorted(plain.collect(), key=repr)


def test_row_index(skewed):
    plain = skewed.select("key", "t", (F.row_number().over(Window.partitionBy("key").orderBy("t")) - 1).alias("n"))
    indexed = scan.with_row_index(skewed, ["key"], ["t"], F.floor(F.col("t") / 100), "n")
    assert sorted(indexed.select("key", "t", "n").collect()) == sorted(plain.collect())


def test_rows_of_one_key_and_one_time_fill_many_parts(spark):
    """Neither the clock nor the key keeps rows together."""
    rows = spark.range(4000).select(F.lit("hot").alias("key"), F.lit(7).alias("second"), F.col("id").alias("tie"))
    parts = scan.parted(rows, ["key"], ["second", "tie"], 500).groupBy(scan.PART).count().collect()
    assert len(parts) >= 7 and max(r["count"] for r in parts) < 1200
    counted = scan.with_row_index(rows, ["key"], ["second", "tie"])
    assert [r.row_index for r in counted.orderBy("tie").collect()] == list(range(4000))


def test_carries_are_fewer_than_parts(spark):
    """Only keys that cross a border are sent to all tasks."""
    rows = spark.range(3000).select((F.col("id") % 700).alias("key"), "id")
    parts = scan.parted(rows, ["key"], ["id"], 300)
    totals = parts.groupBy("key", scan.PART).agg(F.count("*").alias("n"))
    carries = scan.carried(totals, ["key"], {"before": (F.col("n"), scan.SUM)})
    assert carries.count() < parts.select(scan.PART).distinct().count()


def cache_by_hand(times, ttl, ok=None):
    expires, misses = None, []
    for i, t in enumerate(times):
        misses.append(expires is None or t >= expires)
        if misses[-1] and (ok is None or ok[i]):
            expires = t + ttl
    return misses


def bucket_by_hand(times, rate, capacity):
    tokens, last, allowed = capacity, times[0], []
    for t in times:
        tokens, last = min(capacity, tokens + (t - last) * rate), t
        allowed.append(tokens >= 1 - 1e-9)
        tokens -= allowed[-1]
    return allowed


@pytest.mark.parametrize("seed", range(5))
def test_walks_equal_step_by_step_rules(seed):
    rng = np.random.default_rng(seed)
    times = np.sort(rng.integers(0, 4000, 800))
    assert requests.walk_cache(times, None, 97)[0].tolist() == cache_by_hand(times, 97)
    ok = rng.random(800) < 0.2
    assert requests.walk_cache(times, None, 97, ok)[0].tolist() == cache_by_hand(times, 97, ok)
    assert requests.walk_bucket(times, None, 8, 40)[0].tolist() == bucket_by_hand(times.tolist(), 1 / 8, 5)


@pytest.mark.parametrize("seed", range(6))
def test_state_maps_give_the_end_of_every_walk(seed):
    rng = np.random.default_rng(seed)
    times = np.sort(rng.integers(0, [30, 300, 3000][seed % 3], 60)) + 1000
    some, none = rng.random(60) < 0.3, np.zeros(60, dtype=bool)
    for walk, state_map, reach in (
        (partial(requests.walk_cache, ttl=97), partial(requests.cache_map, ttl=97), 97),
        (partial(requests.walk_cache, ttl=97, ok=some), partial(requests.cache_map, ttl=97, ok=some), 97),
        (partial(requests.walk_cache, ttl=97, ok=none), partial(requests.cache_map, ttl=97, ok=none), 97),
        (partial(requests.walk_bucket, spacing=8, burst=40), partial(requests.bucket_map, spacing=8, burst=40), 40),
    ):
        found = state_map(times)
        for start in (None, 0, *range(int(times[0]) - 3, int(times[0]) + reach + 1)):
            assert found(start) == walk(times, start)[1], start
        assert len(found.edges) <= 61


def test_overloaded_bucket_has_few_pieces():
    """Blocks of a key that never gets a rest: functions stay small, however many requests there are."""
    times = np.arange(0, 20_000)
    assert len(requests.bucket_map(times, 1_000, 5_000).edges) < 20


def test_hot_overloaded_key_is_settled_in_one_pass(spark, monkeypatch):
    """What is written does not depend on the number of blocks."""
    from shelfwise.operators import stateful as module

    rows = [("hot", t, t) for t in range(0, 6000, 2)] + [(None, t, t) for t in range(0, 3000, 40)]
    table = spark.createDataFrame(rows, "key string, at bigint, id bigint").repartition(5)
    rule = stateful.Rule(
        partial(requests.walk_bucket, spacing=50, burst=250), partial(requests.bucket_map, spacing=50, burst=250)
    )
    written = []
    plain = module.staged
    monkeypatch.setattr(module, "staged", lambda df, purpose: (written.append(purpose), plain(df, purpose))[1])
    monkeypatch.setattr(scan, "staged", lambda df, purpose: (written.append(purpose), plain(df, purpose))[1])
    for per_block in (2000, 50):
        walked = stateful.walk(table, "key", "at", "id", rule, per_block).toPandas()
        for _, group in walked.sort_values("at").groupby("key", dropna=False):
            expected = requests.walk_bucket(group["at"].to_numpy(), None, 50, 250)[0]
            assert group["flag"].tolist() == expected.tolist()
        assert len(walked) == len(rows)
    assert written[: len(written) // 2] == written[len(written) // 2 :] == ["parts", "crossing", "maps", "starts"]


@pytest.mark.parametrize("rows_per_block", [40, 1_000_000])
def test_walk_over_blocks_equals_one_walk(spark, skewed, rows_per_block):
    """Block size changes who computes what, never the result; 40 rows cut the hot key."""
    rows = skewed.select("key", F.col("t").alias("at"), F.col("t").alias("id"))

    rule = stateful.Rule(partial(requests.walk_cache, ttl=97), partial(requests.cache_map, ttl=97))
    walked = stateful.walk(rows, "key", "at", "id", rule, rows_per_block).toPandas()
    for _, group in walked.sort_values("at").groupby("key"):
        assert group["flag"].tolist() == cache_by_hand(group["at"].tolist(), 97)
    assert len(walked) == 3000


def test_pacing_wait_never_goes_early_or_beyond_the_burst(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aab"), rng.randrange(0, 200_000_000)) for i in range(600)]
    log = spark.createDataFrame(rows, "event_id bigint, endpoint string, us bigint").withColumn(
        "ts", F.timestamp_micros("us")
    )
    limits = {"a": (0.5, 3.0), "b": (2.0, 5.0)}
    done = requests.pacing_wait(log, limits).select(
        "event_id", "endpoint", F.unix_micros("admitted_at").alias("out"), "waited_micros"
    ).toPandas()
    assert (done["waited_micros"] >= 0).all()
    for endpoint, group in done.groupby("endpoint"):
        rate, capacity = limits[endpoint]
        arrivals = sorted((us, i) for i, e, us in rows if e == endpoint)
        tokens, now, expected = capacity, arrivals[0][0], {}
        for us, i in arrivals:
            start = max(us, now)
            tokens = min(capacity, tokens + (start - now) * rate / 1e6)
            wait = max(0.0, (1 - tokens) / rate * 1e6)
            now, tokens = start + wait, max(tokens, 1) - 1
            expected[i] = now
        assert np.allclose(group.set_index("event_id")["out"].sort_index(), [expected[i] for i in sorted(expected)], atol=2)


def test_attempt_outcomes(spark):
    tries = {
        1: [(429, True), (500, False), (200, False)],
        2: [(404, True)],
        3: [(404, False)],
        4: [(500, True)] * 4,
        5: [(501, True), (501, False)],
        6: [(503, False)] * 2,
        7: [(500, False)] * 4 + [(200, False)],
    }
    rows = [(r, a + 1, c, x) for r, ts in tries.items() for a, (c, x) in enumerate(ts)]
    log = spark.createDataFrame(rows, "request_id bigint, attempt int, status_code int, raised boolean")
    found = {r.request_id: (r.outcome, r.attempts_used) for r in requests.attempt_outcome(log).collect()}
    assert found == {
        1: ("success", 3), 2: ("non_retryable", 1), 3: ("success", 1), 4: ("exhausted", 4),
        5: ("success", 2), 6: ("pending", 2), 7: ("exhausted", 4),
    }


def test_progress_pct(spark):
    cases = [("starting", 1, 5, 5), ("batch_starting", 1, 5, 20), ("page", 1, 5, 28), ("page", 3, 7, 48),
             ("page", 5, 5, 100), ("retrying", 1, 5, 50), ("completed", 1, 5, 100), ("failed", 1, 5, 0)]
    df = spark.createDataFrame(cases, "phase string, page int, total int, expected int")
    bad = df.where(jobs.progress_pct(F.col("phase"), F.col("page"), F.col("total")) != F.col("expected"))
    assert bad.isEmpty()


def test_job_files_equal_a_nested_loop(spark):
    rng = random.Random(5)
    words = ["a", "ab", "abc", "b", "ca", "PRODUCTS", "x"]
    files = [(f"{''.join(rng.choices(words, k=3))}_{i}_PRODUCTS.csv", i) for i in range(40)]
    asked = [(i, rng.choice(words) + rng.choice(["", "b", "A"])) for i in range(30)] + [(99, None)]
    found = jobs.job_files(
        spark.createDataFrame(asked, "job_id int, keyword string"),
        spark.createDataFrame(files, "filename string, modified int"),
    ).collect()
    expected = {}
    for job, word in asked:
        hits = [(m, f) for f, m in files if (word or "unknown").lower() in f.lower()]
        if hits:
            expected[job] = max(hits)
    assert {r.job_id: (r.modified, r.filename) for r in found} == expected


def products(spark, rows):
    base = spark.createDataFrame(rows, "keyword string, page_no int, pos int, title string, url string, item_number string")
    return base.select(
        *base.columns, *[F.lit("").alias(c) for c in PRODUCT_COLUMNS if c not in base.columns]
    )


U = "https://www.target.com/p/x"


@pytest.mark.parametrize(
    "title, url, item, errors",
    [
        ("Tea", U, "12345678", []),
        ("", "", "", ["Missing required field: Listing Title*", "Missing required field: Listings URL*", "Missing required field: Item Number"]),
        (" ", U, "  ", ["Missing required field: Listing Title*", "Missing required field: Item Number", "Invalid TCIN format:   ", "Title too short:  "]),
        ("Tea", "http://target.com/", "1234567", ["Invalid TCIN format: 1234567"]),
        ("Te", "ftp://target.com/", "12345678x", ["Invalid URL format: ftp://target.com/", "Invalid TCIN format: 12345678x", "Title too short: Te"]),
        ("x" * 501, U, "12345678", ["Title too long: " + "x" * 501]),
    ],
)
def test_validation_errors(spark, title, url, item, errors):
    row = validate.with_errors(products(spark, [("k", 1, 0, title, url, item)])).first()
    assert row.errors == errors


def test_score_of_nothing_is_zero_and_never_above_one(spark):
    none = products(spark, [("k", 1, 0, "", "", "")])
    assert validate.quality_score(none).first()[0] == 0.0
    assert validate.quality_score(none.where("false")).first()[0] == 0.0
    one = products(spark, [("k", 1, 0, "Tea", U, "12345678")])
    assert validate.quality_score(one).first()[0] == round(0.7 + 0.3 * 3 / 18, 3)
    split = validate.validation_summary(none.union(one)).first()
    assert (split.total, split.valid, split.invalid, split.valid_rate) == (2, 1, 1, 0.5)


def test_dedup_keeps_the_first_and_rows_without_identifier(spark):
    rows = [("k", 2, 0, "b", U, "1"), ("k", 1, 9, "a", U, "1"), ("k", 1, 3, "c", U, ""), ("k", 1, 4, "d", U, ""),
            ("k", 1, 5, "e", "", ""), ("k", 1, 6, "f", "", ""), ("l", 1, 0, "g", U, "1")]
    kept = dedup.first_per_identifier(products(spark, rows))
    assert sorted(r.title for r in kept.collect()) == ["a", "c", "e", "f", "g"]
    again = dedup.first_per_identifier(kept)
    assert sorted(r.title for r in again.collect()) == ["a", "c", "e", "f", "g"]


def test_hot_identifier_is_reduced_before_the_shuffle(spark):
    plan = dedup.first_per_identifier(products(spark, [("k", 1, 0, "a", U, "1")]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text.split("Exchange")[-1]


@pytest.mark.parametrize(
    "landed, max_pages, last",
    [
        ({1: True, 2: True, 3: False, 4: True}, 5, 3),
        ({1: True, 2: True, 4: False}, 5, 2),
        ({2: True, 3: False}, 5, 0),
        ({1: True, 2: True, 3: True}, 2, 2),
        ({1: False}, 20, 1),
        ({n: True for n in range(1, 30)}, 20, 20),
        ({n: True for n in range(1, 300)}, None, 299),
        ({n: n != 250 for n in range(1, 300)}, None, 250),
        ({n: True for n in range(1, 300) if n != 211}, 260, 210),
        ({}, None, 0),
    ],
)
def test_page_prefix(spark, landed, max_pages, last):
    rows = [(k, n, m) for n, m in landed.items() for k in ("k", None)] * 3 + [("other", 0, True), ("other", 2, True)]
    both = spark.createDataFrame(rows, "keyword string, page_no int, has_more boolean")
    ends = {r.keyword: r.last_page for r in paging.last_pages(both, max_pages).collect()}
    assert ends == {"other": 0} | ({"k": last, None: last} if landed else {})
    pages = both.where("keyword = 'k'")
    kept = paging.page_prefix(pages, max_pages).collect()
    assert sorted({r.page_no for r in kept}) == list(range(1, last + 1))
    assert len(kept) == 3 * last


def test_page_prefix_bounds(spark):
    with pytest.raises(ValueError):
        paging.last_pages(spark.createDataFrame([], "keyword string, page_no int, has_more boolean"), 0)


def test_run_results_of_keywords_without_products(spark):
    """Pages without cards, a keyword whose first page is missing, and rows that break rules."""
    card = '<a href="/p/tea/-/A-{0}"><h3>Green Tea</h3></a>'
    pages = [
        ("tea", 1, card.format("12345678") + card.format("12345")), ("none", 1, "<p>nothing</p>"), ("late", 2, card.format("87654321")),
    ]
    run = pipeline.run(spark.createDataFrame(pages, "keyword string, page_no int, html string"), max_pages=None)
    found = {r.keyword: r for r in run.summary().collect()}
    assert {k: (r.success, r.pages_scraped, r.total_found, r.valid_products, r.invalid_products, r.valid_rate, r.error) for k, r in found.items()} == {
        "tea": (True, 1, 2, 1, 1, 0.5, None),
        "none": (False, 1, 0, 0, 0, 0.0, summary.NO_PRODUCTS),
        "late": (False, 0, 0, 0, 0, 0.0, summary.NO_PRODUCTS),
    }
    assert [(r["index"], r.errors) for r in run.invalid_products().collect()] == [(1, ["Invalid TCIN format: 12345"])]
    assert [r.error for r in run.errors().collect()] == ["Invalid TCIN format: 12345"]


def test_details_come_from_the_newest_page_that_a_product_asks_for(spark):
    filler = "filler " * 30
    rows = [("u", "UPC: 99999999", 1), ("u", "UPC: 11111111", 2), ("u", "short", 3), ("x", "UPC: 22222222", 1)]
    pages = spark.createDataFrame(
        [(u, h if h == "short" else filler + h, n) for u, h, n in rows], "clean_url string, html string, landed_at int"
    )
    found = details.newest_per_url(details.extract_details(pages)).select("clean_url", "upc").collect()
    assert sorted(map(tuple, found)) == [("u", "11111111"), ("x", "22222222")]


def test_requests_and_batch_results(spark):
    asked = spark.createDataFrame(
        [(" tea ", 5), ("", 5), ("   ", 5), ("x" * 101, 5), ("x", 0), ("x", 21), ("y", 20)], "keyword string, max_pages int"
    )
    assert sorted((r.keyword, r.max_pages) for r in summary.valid_requests(asked).collect()) == [("tea", 5), ("y", 20)]
    done = spark.createDataFrame([("tea", True, 3, None)], "keyword string, success boolean, valid_products bigint, error string")
    batch = spark.createDataFrame([("tea",), ("tea",), (" ",), ("z",)], "keyword string")
    results = summary.batch_results(batch, done)
    assert {r.keyword: (r.success, r.error) for r in results.collect()} == {
        "tea": (True, None), " ": (False, "Invalid keyword"), "z": (False, "No valid products found"),
    }
    assert tuple(summary.batch_success(results, batch).first()) == (1, 3, 4)


def test_distinct_links_keep_the_first_place(spark):
    html = "".join(f'<a href="/p/{n}">x</a>' for n in "abacbd")
    pages = spark.createDataFrame([(1, html), (2, html)], "id int, html string")
    found = links.distinct_links(pages).collect()
    assert sorted((r.id, r.pos, r.href) for r in found) == [
        (i, pos, href) for i in (1, 2) for pos, href in ((0, "/p/a"), (1, "/p/b"), (3, "/p/c"), (5, "/p/d"))
    ]


def test_scans_keep_rows_with_null_keys_and_times(spark):
    rows = [("a", 1, 5), ("a", 2, 6), (None, 1, 7), (None, 90, 8), ("a", None, 9), (None, None, 1)]
    df = spark.createDataFrame(rows, "key string, t bigint, v bigint")
    earlier = Window.partitionBy("key").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("key", "t", F.coalesce(F.sum("v").over(earlier), F.lit(0)).alias("s"))
    chunked = scan.before(df, ["key"], ["t"], {"s": (F.col("v"), scan.SUM)}, F.floor(F.col("t") / 10))
    assert sorted(chunked.select("key", "t", "s").collect(), key=repr) == sorted(plain.collect(), key=repr)


def test_pacing_wait_keeps_requests_without_a_time(spark):
    log = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "a", 6)], "event_id bigint, endpoint string, s bigint")
    log = log.withColumn("ts", F.timestamp_seconds("s"))
    done = {r.event_id: r.admitted_at for r in requests.pacing_wait(log, {"a": (1.0, 2.0)}).collect()}
    assert set(done) == {1, 2, 3} and done[2] is None and done[1] and done[3]
