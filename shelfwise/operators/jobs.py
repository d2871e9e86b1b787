"""Job state, progress, recovery and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import scan
from shelfwise.runtime import staged
from shelfwise.schemas import TERMINAL_STATUSES

# Recovery delays in seconds, attempts, and the text of a dead letter.
RETRY_DELAYS = (60, 300, 900)
MAX_RETRIES = 3
DEAD_LETTER_ERROR = "Max retries exceeded"

# A cell of jobs and their products makes about so many rows, for about so many jobs at most: their list comes once for each
# product, and a file is small where such a list soon comes again.
CELL_ROWS = 1 << 22
CELL_JOBS = 1 << 10

# Progress in percent.
PROGRESS = {"starting": 5, "batch_starting": 20, "retrying": 50, "completed": 100, "failed": 0}


def progress_pct(phase: Column, page: Column, total: Column) -> Column:
    """Percent of a job: fixed per phase; while pages are read it grows from 10 to 100."""
    known = None
    for name, value in PROGRESS.items():
        at = phase == name
        known = F.when(at, value) if known is None else known.when(at, value)
    return known.otherwise((F.floor(page / total * 90) + 10).cast("int"))


def jobs_latest(events: DataFrame) -> DataFrame:
    """Current state per job: the last write wins. Combined before the shuffle."""
    last = F.max_by(
        F.struct("status", "progress", "keyword", "error", "ts"), F.struct("ts", "event_id")
    )
    return (
        events.groupBy("job_id")
        .agg(last.alias("last"), F.min("ts").alias("created_at"))
        .select(
            "job_id",
            "last.status",
            "last.progress",
            "last.keyword",
            "last.error",
            "created_at",
            F.col("last.ts").alias("updated_at"),
        )
    )


def completed_jobs(latest: DataFrame) -> DataFrame:
    return latest.where(F.col("status") == "completed")


def terminal_jobs(latest: DataFrame) -> DataFrame:
    return latest.where(F.col("status").isin(TERMINAL_STATUSES))


def progress_changes(events: DataFrame) -> DataFrame:
    """Events whose progress differs from the one before in the same job."""
    seen = scan.before(
        events,
        ["job_id"],
        ["ts", "event_id"],
        {"previous": (F.col("progress"), scan.LAST)},
    )
    return seen.where(~F.col("progress").eqNullSafe(F.col("previous")))


def retry_delay(attempt: Column, delays: tuple[int, ...] = RETRY_DELAYS) -> Column:
    """Seconds to wait before an attempt; the last delay repeats."""
    return F.element_at(
        F.array(*[F.lit(d) for d in delays]), F.least(attempt, F.lit(len(delays))).cast("int")
    )


def number_failures(events: DataFrame) -> DataFrame:
    """Failures with their attempt number within the job."""
    failed = events.where(F.col("status") == "failed")
    return scan.with_row_index(failed, ["job_id"], ["ts", "event_id"], name="attempt").withColumn("attempt", F.col("attempt") + 1)


def retry_routing(
    events: DataFrame, max_retries: int = MAX_RETRIES, delays: tuple[int, ...] = RETRY_DELAYS
) -> DataFrame:
    """Each failure goes to a retry at a known time, or to the dead letters."""
    dead = F.col("attempt") > max_retries
    due = F.timestamp_add("SECOND", retry_delay(F.col("attempt"), delays), F.col("ts"))
    return number_failures(events).select(
        "job_id",
        "event_id",
        "keyword",
        "attempt",
        F.least("attempt", F.lit(max_retries + 1)).alias("attempt_count"),
        F.col("ts").alias("last_attempt"),
        F.when(~dead, due).alias("next_retry_at"),
        F.when(dead, "failed").otherwise("retrying").alias("status"),
        dead.alias("dead_lettered"),
        F.when(dead, DEAD_LETTER_ERROR).otherwise(F.col("error")).alias("error"),
    )


def dead_letters(events: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """One entry per job whose retries are used up, made at its first failure beyond them."""
    beyond = retry_routing(events, max_retries).where(F.col("attempt") == max_retries + 1)
    return beyond.select(
        F.col("job_id").cast("string").alias("job_id"),
        "keyword",
        "error",
        F.col("attempt_count").cast("int").alias("attempt_count"),
        "last_attempt",
        F.col("last_attempt").alias("created_at"),
        "next_retry_at",
    )


def remove_dead_letters(letters: DataFrame, job_ids: DataFrame) -> DataFrame:
    return letters.join(job_ids, "job_id", "left_anti")


def job_files(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Newest artefact whose name holds the job's keyword or category, in any case.

    'Contains' as an equi join: substrings of a file name, of the lengths that occur among the search terms, are
    joined to the distinct terms by value. Only true matches leave the join, and the newest file is kept per
    term before it goes back to the jobs. An empty term is in every name.
    """
    category = F.col("category") if "category" in jobs.columns else F.lit("unknown")
    searched = jobs.select(
        "job_id",
        F.explode(
            F.array_distinct(
                F.array(
                    F.lower(F.coalesce("keyword", F.lit("unknown"))),
                    F.lower(F.coalesce(category, F.lit("unknown"))),
                )
            )
        ).alias("term"),
    )
    terms = searched.select("term").distinct()
    # One row: the lengths of terms that can be found at all, at most as many as the longest name has characters.
    longest = files.agg(F.max(F.length("filename")).alias("longest"))
    lengths = (
        terms.select(F.length("term").alias("length")).distinct().join(F.broadcast(longest))
        .where(F.col("length") <= F.col("longest"))
        .agg(F.collect_set("length").alias("lengths"))
    )
    names = files.select("filename", "modified", F.lower("filename").alias("lowered")).join(F.broadcast(lengths))
    size = F.length("lowered")
    cut = names.select("filename", "modified", "lowered", F.explode("lengths").alias("length")).where(
        F.col("length") <= size
    )
    starts = F.sequence(F.lit(1), F.when(F.col("length") == 0, 1).otherwise(size - F.col("length") + 1))
    parts = cut.select("filename", "modified", "lowered", "length", F.explode(starts).alias("start"))
    newest = (
        parts.select("filename", "modified", F.substring("lowered", F.col("start"), F.col("length")).alias("term"))
        .join(terms, "term")
        .groupBy("term")
        .agg(F.max(F.struct("modified", "filename")).alias("newest"))
    )
    return (
        searched.join(newest, "term")
        .groupBy("job_id")
        .agg(F.max("newest").alias("newest"))
        .select("job_id", "newest.filename", "newest.modified")
    )


def _numbered(rows: DataFrame, purpose: str) -> DataFrame:
    """Rows with a number each, written with it, since a repeated task could give others."""
    return staged(rows.withColumn("_nth", F.monotonically_increasing_id()), purpose)


def _all_parts(parts: str) -> Column:
    """A row for each part of the other side."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1))


def job_products(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """What is stored for each completed job, by the artefact's `output_name`.

    `stored` has the products themselves (`landing.read_products_json`), and every job gets all products of its artefact;
    or it has one row per artefact (`landing.read_catalogue`), and every job gets that.

    The result has a row for each job and product, so it is made in cells: a part of an artefact's rows meets a part of
    its jobs. Cells have about as many rows, whatever the names do. Within a cell the jobs of one stored row follow each
    other, and a task has few stored rows, so files of the result hold each text about once instead of once a job. The
    merge join keeps that order: it goes through the stored rows and holds the jobs of the cell.
    """
    kept = [c for c in stored.columns if c != "output_name"]
    wanted = completed_jobs(jobs).select(
        "job_id", text.output_name(F.col("keyword"), "json").alias("output_name")
    )
    wanted, stored = _numbered(wanted, "wanted-jobs"), _numbered(stored, "stored")
    counted = wanted.groupBy("output_name").agg(F.count("*").alias("jobs")).join(
        stored.groupBy("output_name").agg(F.count("*").alias("rows")), "output_name"
    )
    in_cell = F.least("jobs", F.lit(CELL_JOBS))
    sizes = staged(
        counted.select(
            "output_name",
            (F.col("jobs") * F.col("rows")).alias("made"),
            F.ceil(F.col("jobs") / CELL_JOBS).alias("job_parts"),
            F.ceil(F.col("rows") * in_cell / CELL_ROWS).alias("row_parts"),
        ),
        "artefact-sizes",
    )
    tasks = 1 + (sizes.agg(F.sum("made")).first()[0] or 0) // CELL_ROWS
    parts, cell = sizes.drop("made"), ["output_name", "_job_part", "_row_part"]
    rows = stored.join(parts, "output_name").select(
        "output_name", *kept, (F.col("_nth") % F.col("row_parts")).alias("_row_part"), _all_parts("job_parts").alias("_job_part")
    )
    asked = wanted.join(parts, "output_name").select(
        "output_name", "job_id", (F.col("_nth") % F.col("job_parts")).alias("_job_part"), _all_parts("row_parts").alias("_row_part")
    )
    met = rows.repartition(tasks, *cell).join(asked.repartition(tasks, *cell).hint("merge"), cell)
    return met.select("output_name", "job_id", *kept)
