"""Request log: retry outcomes, reuse of results, and pacing."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import scan, stateful
from shelfwise.operators.stateful import Rule, StateMap

# What is retried, how often, and how long results live.
RETRYABLE_CODES = [429, 500, 502, 503, 504]
MAX_RETRIES = 3
TTL_SECONDS = 3600
MICROS = 1_000_000

# Tokens per second and burst per endpoint.
RATE_LIMITS = {
    "api_request": (5.0, 10.0),
    "keyword_search": (2.0, 5.0),
    "batch_search": (1.0, 3.0),
}
DEFAULT_RATE_LIMIT = (2.0, 5.0)


def attempt_class(status: Column, raised: Column) -> Column:
    """What the retry loop makes of one attempt.

    A returned response is retried for a few codes and is a result otherwise; a raised error is
    retried unless it is a client error other than 429.
    """
    client_error = status.between(400, 499) & (status != 429)
    return (
        F.when(raised & client_error, "fatal")
        .when(raised & (status >= 400), "retry")
        .when(~raised & status.isin(RETRYABLE_CODES), "retry")
        .otherwise("success")
    )


def backoff_delay(
    attempt: Column, initial: float = 1.0, base: float = 2.0, maximum: float = 60.0
) -> Column:
    return F.least(initial * F.pow(F.lit(base), attempt - 1), F.lit(maximum))


def number_attempts(log: DataFrame) -> DataFrame:
    """Attempt number within the request, for logs that do not carry it."""
    return scan.with_row_index(log, ["request_id"], ["ts", "event_id"], name="attempt").withColumn("attempt", (F.col("attempt") + 1).cast("int"))


def attempt_outcome(log: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Final outcome per request: the first attempt that is not retried decides."""
    numbered = log if "attempt" in log.columns else number_attempts(log)
    kind = attempt_class(F.col("status_code"), F.col("raised"))
    tried = numbered.where(F.col("attempt") <= max_retries + 1).select(
        "request_id",
        "attempt",
        F.when(kind == "success", F.col("attempt")).alias("succeeded"),
        F.when(kind == "fatal", F.col("attempt")).alias("refused"),
    )
    ends = tried.groupBy("request_id").agg(
        F.min("succeeded").alias("succeeded"),
        F.min("refused").alias("refused"),
        F.max("attempt").alias("last"),
    )
    decided = F.least("succeeded", "refused")
    return ends.select(
        "request_id",
        F.when(decided.isNull() & (F.col("last") > max_retries), "exhausted")
        .when(decided.isNull(), "pending")
        .when(decided == F.col("refused"), "non_retryable")
        .otherwise("success")
        .alias("outcome"),
        F.coalesce(decided, F.col("last")).alias("attempts_used"),
    )


def keyed(log: DataFrame) -> DataFrame:
    """The log with its cache key and its time in microseconds."""
    return log.withColumn("key", text.cache_key(F.col("keyword"), F.col("max_pages"))).withColumn(
        "at", F.unix_micros("ts")
    )


def cache_asof(log: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Each request with the newest stored result of its key that is younger than the TTL.

    A result is stored at each successful attempt. The as-of lookup is an ordered scan, so a key
    with very many requests is spread over parts instead of being paired with all its entries.
    """
    stored = F.when(F.col("status_code") == 200, F.col("at"))
    seen = scan.before(
        keyed(log),
        ["key"],
        ["at", "event_id"],
        {"stored_at": (stored, scan.LAST)},
    )
    alive = F.col("at") < F.col("stored_at") + ttl_seconds * MICROS
    return seen.select(
        "event_id",
        "key",
        F.coalesce(alive, F.lit(False)).alias("hit"),
        F.when(alive, F.timestamp_micros("stored_at")).alias("stored_at"),
    )


def walk_cache(
    times: np.ndarray, expires: int | None, ttl: int, ok: np.ndarray | None = None
) -> tuple[np.ndarray, int]:
    """Misses among sorted times when an entry lives for the TTL and is never refreshed.

    A miss stores an entry if it is `ok`; after another one the next request misses too.
    """
    n = len(times)
    stores = _next_ok(n, ok)
    miss = np.zeros(n, dtype=bool)
    at = 0 if expires is None else int(np.searchsorted(times, expires, side="left"))
    expires = int(times[0]) if expires is None else expires
    while at < n:
        stored = int(stores[at])
        miss[at : stored + 1] = True
        if stored == n:
            break
        expires = int(times[stored]) + ttl
        at = int(np.searchsorted(times, expires, side="left"))
    return miss, expires


def _next_ok(n: int, ok: np.ndarray | None) -> np.ndarray:
    """For each row the first row from there on that is ok; n if there is none."""
    place = np.arange(n)
    if ok is None:
        return place
    return np.minimum.accumulate(np.where(ok, place, n)[::-1])[::-1]


def walk_bucket(
    times: np.ndarray, full_at: int | None, spacing: int, burst: int, ok: np.ndarray | None = None
) -> tuple[np.ndarray, int]:
    """Requests a token bucket lets through when one without a token is dropped.

    `full_at` is the time at which the bucket would be full again; one token takes `spacing`. `ok` plays no part.
    """
    allowed = np.zeros(len(times), dtype=bool)
    full_at = int(times[0]) if full_at is None else full_at
    for i, now in enumerate(times.tolist()):
        if full_at - now <= burst - spacing:
            allowed[i] = True
            full_at = max(full_at, now) + spacing
    return allowed, full_at


def cache_map(times: np.ndarray, ttl: int, ok: np.ndarray | None = None) -> StateMap:
    """All end states of `walk_cache` for starts up to the TTL after the first time.

    A start that expires between two requests is renewed by the next one that is ok, and each renewal leads to the first
    request at or after its end. The chains are followed for all requests at once by doubling the steps. Where nothing is
    stored, the start stays: it is over by then.
    """
    n = len(times)
    place = np.arange(n)
    stores = _next_ok(n, ok)
    stored = np.minimum(stores, n - 1)
    after = np.searchsorted(times, times[stored] + ttl, side="left")
    # The last request from which a chain still stores; a chain ends there, or goes on from `after`.
    goes_on = (stores < n) & (after < n)
    goes_on &= np.append(stores, n)[np.minimum(after, n)] < n
    last = np.where(goes_on, np.minimum(after, n - 1), place)
    while (last[last] != last).any():
        last = last[last]
    nothing = stores[last] == n
    ends = times[stored[last]] + ttl
    top = int(times[0]) + ttl
    inside = int(np.searchsorted(times, top, side="right"))
    edges = np.append(times[:inside], top)
    values = np.where(nothing, 0, ends)[:inside]
    moves = nothing[:inside]
    if inside < n:
        values, moves = np.append(values, 0 if nothing[inside] else ends[inside]), np.append(moves, nothing[inside])
    else:
        values, moves = np.append(values, 0), np.append(moves, True)
    kept = np.append((np.diff(values) != 0) | (moves[1:] != moves[:-1]), True)
    kept[0] = True
    return StateMap(edges[kept], moves[kept], values[kept])


def bucket_map(times: np.ndarray, spacing: int, burst: int, ok: np.ndarray | None = None) -> StateMap:
    """All end states of `walk_bucket` for starts up to `burst` after the first time.

    All starts are walked at once, as pieces: a request moves the starts that it lets through by `spacing`, and gives all
    that have found the bucket full one state. Pieces that have been moved equally far are one piece again, so
    there stay about as many as tokens fit into the bucket, however many requests there are.
    """
    first, room = int(times[0]), burst - spacing
    pieces = [(first, False, first), (first + burst, True, 0)]
    for now in times.tolist():
        walked: list[tuple[int, bool, int]] = []

        def add(edge: int, moves: bool, value: int) -> None:
            if walked and walked[-1][1] == moves and walked[-1][2] == value:
                walked.pop()
            walked.append((edge, moves, value))

        low = first - 1
        for edge, moves, value in pieces:
            if not moves:
                add(edge, False, max(value, now) + spacing if value - now <= room else value)
            else:
                full, through = now - value, now + room - value
                if full > low:
                    add(min(edge, full), False, now + spacing)
                if min(edge, through) > max(low, full):
                    add(min(edge, through), True, value + spacing)
                if edge > max(low, through):
                    add(edge, True, value)
            low = edge
        pieces = walked
    return StateMap(*(np.array(column) for column in zip(*pieces, strict=True)))


def cache_rule(ttl_seconds: int) -> Rule:
    ttl = ttl_seconds * MICROS
    return Rule(partial(walk_cache, ttl=ttl), partial(cache_map, ttl=ttl))


def bucket_rule(rate: float, capacity: int) -> Rule:
    spacing = round(MICROS / rate)
    sizes = {"spacing": spacing, "burst": spacing * capacity}
    return Rule(partial(walk_bucket, **sizes), partial(bucket_map, **sizes))


def cache_hits(
    log: DataFrame,
    ttl_seconds: int = TTL_SECONDS,
    rows_per_block: int = stateful.ROWS_PER_BLOCK,
    ok: Column | None = None,
) -> DataFrame:
    """Hit or miss per request when a request that finds nothing runs, and a run that is `ok` is stored for the TTL.

    Without `ok` every run is stored. A request without a time has no answer.
    """
    rows = keyed(log)
    walked = stateful.walk(rows, "key", "at", "event_id", cache_rule(ttl_seconds), rows_per_block, ok)
    return walked.select("event_id", "key", (~F.col("flag")).alias("hit"))


def pacing_deny(
    log: DataFrame, rate: float, capacity: int, rows_per_block: int = stateful.ROWS_PER_BLOCK
) -> DataFrame:
    """Allowed or dropped per request, one bucket per endpoint."""
    rows = log.select("event_id", "endpoint", F.unix_micros("ts").alias("at"))
    walked = stateful.walk(rows, "endpoint", "at", "event_id", bucket_rule(rate, capacity), rows_per_block)
    return walked.select("event_id", "endpoint", F.col("flag").alias("allowed"))


def _limit_columns(limits: dict[str, tuple[float, float]]) -> tuple[Column, Column]:
    """Microseconds per token and burst of the row's endpoint."""
    rate, burst = DEFAULT_RATE_LIMIT
    spacing, capacity = F.lit(round(MICROS / rate)), F.lit(int(burst))
    for endpoint, (rate, burst) in limits.items():
        here = F.col("endpoint") == endpoint
        spacing = F.when(here, round(MICROS / rate)).otherwise(spacing)
        capacity = F.when(here, int(burst)).otherwise(capacity)
    return spacing.cast("bigint"), capacity.cast("bigint")


def pacing_wait(log: DataFrame, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Earliest time at which each request may go, first come first served per endpoint.

    With one token per `spacing`, the bucket is full again after request n at
    `max over k <= n of (t_k - k * spacing) + (n + 1) * spacing`, so the wait is one running
    maximum. It is computed inside parts of about equal size, and the count and the maximum of earlier
    parts are scanned over one summary row per part, because an endpoint is a hot key by nature.

    `limits` maps endpoints to (rate, capacity); other endpoints get the default limit. It is a
    handful of constants and becomes part of the expression, so the log is not joined to anything.
    """
    spacing, capacity = _limit_columns(RATE_LIMITS if limits is None else limits)
    rows = log.select("event_id", "endpoint", "ts", F.unix_micros("ts").alias("at"))
    inside = Window.partitionBy("endpoint", scan.PART).orderBy("at", "event_id")
    local = (
        scan.parted(rows, ["endpoint"], ["at", "event_id"])
        .withColumns({"spacing": spacing, "capacity": capacity})
        .withColumn("n", F.row_number().over(inside).cast("bigint"))
        .withColumn("lead", F.col("at") - F.col("n") * F.col("spacing"))
        .withColumn("top", F.max("lead").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    )
    ahead = Window.partitionBy("endpoint").orderBy(scan.PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        local.groupBy("endpoint", scan.PART)
        .agg(F.count("*").alias("rows"), F.max("lead").alias("lead"), F.max("spacing").alias("space"))
        .withColumn("shifted", F.col("lead") - F.coalesce(F.sum("rows").over(ahead), F.lit(0)) * F.col("space"))
    )
    carries = scan.carried(
        totals, ["endpoint"], {"offset": (F.col("rows"), scan.SUM), "earlier_top": (F.col("shifted"), scan.MAX)}
    )
    joined = scan.join_null_safe(local, carries, ["endpoint", scan.PART], "left")
    offset = F.coalesce("offset", F.lit(0))
    full_at = (
        F.greatest("earlier_top", F.col("top") - offset * F.col("spacing"))
        + (offset + F.col("n")) * F.col("spacing")
    )
    admitted = F.greatest(F.col("at"), full_at - (F.col("capacity") - 1) * F.col("spacing"))
    return joined.select(
        "event_id",
        "endpoint",
        "ts",
        F.timestamp_micros(admitted).alias("admitted_at"),
        (admitted - F.col("at")).alias("waited_micros"),
    )
