"""Run and batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import markup, text
from shelfwise.operators import scan, validate
from shelfwise.operators.paging import DEFAULT_MAX_PAGES, MAX_PAGES_LIMIT

# Messages and the longest keyword.
NO_PRODUCTS = "No valid products found"
BAD_KEYWORD = "Invalid keyword"
MAX_KEYWORD_LENGTH = 100


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests with a non-blank keyword of 1..100 characters and 1..20 pages; keyword trimmed."""
    asked = requests
    if "max_pages" not in requests.columns:
        asked = requests.withColumn("max_pages", F.lit(DEFAULT_MAX_PAGES))
    return asked.where(
        F.length("keyword").between(1, MAX_KEYWORD_LENGTH)
        & F.col("max_pages").between(1, MAX_PAGES_LIMIT)
        & ~markup.is_blank(F.col("keyword"))
    ).withColumn("keyword", markup.strip(F.col("keyword")))


def run_summary(
    found: DataFrame, final: DataFrame, ends: DataFrame, rules: validate.Rules = validate.DEFAULT_RULES
) -> DataFrame:
    """One row per keyword of `ends` (keyword, last_page) from all rows of its pages and its final rows.

    A keyword whose pages hold no product, or that has no page that counts, is a result too. Every
    aggregate combines before the shuffle, so a keyword with very many rows is no hot spot.
    """
    ok = F.size(validate.validation_errors(rules)) == 0
    raw = found.select("keyword", ok.alias("ok")).groupBy("keyword").agg(
        F.count("*").alias("total_found"),
        F.count_if("ok").alias("raw_valid"),
    )
    kept = final.groupBy("keyword").agg(
        F.count("*").alias("valid_products"),
        F.sum(validate.filled_fields()).alias("filled"),
    )
    summary = ends.select("keyword", F.col("last_page").alias("pages_scraped"))
    for counted in (raw, kept):
        summary = scan.join_null_safe(summary, counted, ["keyword"], "left")
    summary = summary.na.fill(0, ["total_found", "raw_valid", "valid_products"])
    success = F.col("valid_products") > 0
    return summary.select(
        "keyword",
        success.alias("success"),
        "pages_scraped",
        "total_found",
        "valid_products",
        validate.score(F.col("valid_products"), F.col("valid_products"), F.col("filled")).alias(
            "quality_score"
        ),
        (F.col("total_found") - F.col("raw_valid")).alias("invalid_products"),
        F.coalesce(F.col("raw_valid") / F.nullif("total_found", F.lit(0)), F.lit(0.0)).alias("valid_rate"),
        F.when(success, text.output_name(F.col("keyword"), "csv")).alias("filename"),
        F.when(success, text.output_name(F.col("keyword"), "json")).alias("json_filename"),
        F.when(~success, NO_PRODUCTS).alias("error"),
    )


def batch_results(requests: DataFrame, summary: DataFrame) -> DataFrame:
    """Each distinct keyword asked for with its result; one without a result has failed."""
    asked = requests.select("keyword").dropDuplicates(["keyword"])
    joined = asked.join(summary, "keyword", "left")
    missing = F.col("success").isNull()
    error = F.when(
        missing, F.when(markup.is_blank(F.col("keyword")), BAD_KEYWORD).otherwise(NO_PRODUCTS)
    ).otherwise(F.col("error"))
    return joined.withColumn("error", error).withColumns(
        {
            "success": F.coalesce("success", F.lit(False)),
            "valid_products": F.coalesce("valid_products", F.lit(0)),
        }
    )


def batch_success(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Successful keywords out of the distinct and out of the submitted ones."""
    counted = results.select(
        F.col("success").cast("int").alias("succeeded"),
        F.lit(1).alias("distinct_keywords"),
        F.lit(0).alias("submitted"),
    ).unionByName(
        requests.select(
            F.lit(0).alias("succeeded"), F.lit(0).alias("distinct_keywords"), F.lit(1).alias("submitted")
        )
    )
    return counted.agg(*[F.sum(c).alias(c) for c in counted.columns])


def products_per_job(products: DataFrame, jobs: DataFrame) -> DataFrame:
    """Number of products of each completed job; products are counted per keyword first."""
    per_keyword = products.groupBy("keyword").agg(F.count("*").alias("products_count"))
    return (
        jobs.where(F.col("status") == "completed")
        .join(per_keyword, "keyword", "left")
        .select("job_id", "keyword", F.coalesce("products_count", F.lit(0)).alias("products_count"))
    )
