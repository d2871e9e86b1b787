"""Pages to products and their artefacts as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise import schemas
from shelfwise.operators import cards, dedup, jobs, validate
from shelfwise.operators.paging import DEFAULT_MAX_PAGES
from shelfwise.runtime import staged
from shelfwise.schemas import ORIGIN_COLUMNS, PRODUCT_COLUMNS
from shelfwise.sources import sinks
from shelfwise.streaming.runner import batch_path, batches, drain

UNREADABLE = "Page without keyword, number or content"
COMMIT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("pages", "products", "rejected", "unreadable")]
    + [T.StructField("committed_at", T.TimestampType())]
)


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 1000, fmt: str = "parquet") -> DataFrame:
    """Landed pages as a stream; `fmt` is any file format that Spark streams (parquet, json, csv, orc)."""
    return (
        spark.readStream.schema(schemas.LISTING_PAGES)
        .format(fmt)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def run(pages: DataFrame, out: str, max_pages: int = DEFAULT_MAX_PAGES) -> None:
    """Process the pages that have landed since the last run for `out`.

    Tables: `products` (valid rows), `rejected` (rows with their errors), `dead_letters` (JSON, pages that cannot be read),
    `commits` (one row per batch with its counts), `job_events` (one row per page that was read, with the percentage of
    `max_pages`), `progress` (what Spark reports of each batch). Artefacts: `csv` and `json`, one folder per keyword, replaced
    when a batch brings products of the keyword.

    A bad row or page never stops the stream. Each micro-batch writes its own folders, and its commit row last:
    readers take committed batches only, and a batch that is run again after a loss replaces what it
    had written. The checkpoint belongs to `out`, so a later run adds to an earlier one.
    """
    spark = pages.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        readable = F.col("keyword").isNotNull() & F.col("page_no").isNotNull() & F.col("html").isNotNull()
        landed = staged(batch.select("keyword", "page_no", "html", readable.alias("readable")), "landed")
        found = staged(
            cards.extract_products(landed.where("readable").drop("readable")).select(*ORIGIN_COLUMNS, *PRODUCT_COLUMNS),
            "batch",
        )
        checked = validate.with_errors(found)
        valid = checked.where(F.size("errors") == 0).drop("errors")
        products = batch_path(f"{out}/products", batch_id)
        dedup.first_per_identifier(valid).write.mode("overwrite").parquet(products)
        checked.where(F.size("errors") > 0).write.mode("overwrite").parquet(batch_path(f"{out}/rejected", batch_id))
        letters = landed.where("not readable").select(
            F.concat_ws(":", "keyword", F.col("page_no").cast("string")).alias("job_id"),
            "keyword",
            F.lit(UNREADABLE).alias("error"),
            F.lit(1).alias("attempt_count"),
            *[F.current_timestamp().alias(c) for c in ("last_attempt", "created_at")],
            F.lit(None).cast("timestamp").alias("next_retry_at"),
        )
        sinks.write_dead_letters(letters, batch_path(f"{out}/dead_letters", batch_id), mode="overwrite")
        events = landed.where("readable").select(
            F.current_timestamp().alias("ts"),
            F.col("page_no").cast("bigint").alias("event_id"),
            F.lit("running").alias("status"),
            jobs.progress_pct(F.lit("page"), F.least("page_no", F.lit(max_pages)), F.lit(max_pages)).alias("progress"),
            "keyword",
        )
        events.write.mode("overwrite").parquet(batch_path(f"{out}/job_events", batch_id))
        counts = landed.agg(F.count("*").alias("pages"), F.count_if(~F.col("readable")).alias("unreadable"))
        kept = spark.read.schema(found.schema).parquet(products).agg(F.count("*").alias("products"))
        dropped = found.agg(F.count_if(F.size(validate.validation_errors()) > 0).alias("rejected"))
        one = counts.crossJoin(kept).crossJoin(dropped)  # one row each
        commit = one.withColumn("committed_at", F.current_timestamp()).select(*COMMIT.names)
        commit.coalesce(1).write.mode("overwrite").parquet(batch_path(f"{out}/commits", batch_id))
        _publish(spark, out, spark.read.schema(found.schema).parquet(products).select("keyword").distinct())

    drain(pages, write, "append", "products", out)


def _publish(spark: SparkSession, out: str, keywords: DataFrame) -> None:
    """Write the artefacts of these keywords anew, from all that has been committed."""
    now = staged(read_products(spark, out).join(keywords, "keyword", "left_semi"), "published")
    sinks.write_products_csv(now, f"{out}/csv")
    sinks.write_products_json(now, f"{out}/json")


def _committed(spark: SparkSession, out: str, table: str, schema: T.StructType) -> DataFrame:
    """Rows of the batches that have a commit row."""
    return batches(spark, f"{out}/{table}", schema).join(read_commits(spark, out).select("batch_id"), "batch_id", "left_semi")


def read_commits(spark: SparkSession, out: str) -> DataFrame:
    return batches(spark, f"{out}/commits", COMMIT)


def read_products(spark: SparkSession, out: str) -> DataFrame:
    """Streamed products, the first of each identifier over all batches."""
    names = [*ORIGIN_COLUMNS, *PRODUCT_COLUMNS]
    stored = _committed(spark, out, "products", schemas.FOUND)
    return dedup.first_per_identifier(stored.select(*names))


def read_job_events(spark: SparkSession, out: str) -> DataFrame:
    """Progress of the keywords, a row per page: (ts, event_id, status, progress, keyword)."""
    names = ("ts", "event_id", "status", "progress", "keyword")
    return _committed(spark, out, "job_events", T.StructType([schemas.JOB_EVENTS[n] for n in names]))


def read_rejected(spark: SparkSession, out: str) -> DataFrame:
    errors = T.StructField("errors", T.ArrayType(T.StringType()))
    return _committed(spark, out, "rejected", T.StructType([*schemas.FOUND.fields, errors]))
