"""Readers: landed pages, fetch envelopes, dead letters, artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise import schemas


def scan_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.LISTING_PAGES).format(fmt).load(path)


def scan_details(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.DETAIL_PAGES).format(fmt).load(path)


UNREADABLE, NO_RESULTS, NO_ENTRY = "unreadable", "no results", "no entry"


def _envelope(body: Column) -> Column:
    return F.from_json(body, schemas.ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"})


def first_content(body: Column) -> Column:
    """Page of the first result of a fetch envelope; null when there is none."""
    return F.get(_envelope(body)["results"], F.lit(0))["content"]


def decode_envelopes(fetched: DataFrame, body: str = "body") -> DataFrame:
    """Fetched bodies to pages; a body without a page is among `rejected_envelopes`."""
    others = [c for c in fetched.columns if c != body]
    return fetched.select(*others, first_content(F.col(body)).alias("html")).where(
        F.col("html").isNotNull()
    )


def rejected_envelopes(fetched: DataFrame, body: str = "body") -> DataFrame:
    """Bodies that give no page, with the reason: unreadable, or an envelope without results."""
    others = [c for c in fetched.columns if c != body]
    read = fetched.select(*others, F.col(body).alias("raw"), _envelope(F.col(body)).alias("envelope"))
    unreadable = F.col("envelope").isNull() | F.col("envelope.unreadable").isNotNull()
    return read.where(F.get("envelope.results", F.lit(0))["content"].isNull()).select(
        *others, "raw", F.when(unreadable, UNREADABLE).otherwise(NO_RESULTS).alias("reason")
    )


def _letters(spark: SparkSession, path: str) -> DataFrame:
    """Stored lines with what could be read of them."""
    with_bad = T.StructType([*schemas.DEAD_LETTERS.fields, T.StructField("unreadable", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"}
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))
    return lines.withColumn("letter", F.from_json("line", with_bad, options)).where(F.trim("line") != "")


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Stored dead letters with instants parsed; other lines are among `rejected_dead_letters`."""
    stored = _letters(spark, path).select("letter.*").drop("unreadable")
    instants = ["last_attempt", "created_at", "next_retry_at"]
    return stored.where(F.col("job_id").isNotNull()).withColumns(
        {c: F.try_to_timestamp(c) for c in instants}
    )


def rejected_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Stored lines that are no dead letter: (file, line, reason)."""
    bad = _letters(spark, path).where(F.col("letter.job_id").isNull())
    reason = F.when(F.col("letter.unreadable").isNotNull() | F.col("letter").isNull(), UNREADABLE).otherwise(NO_ENTRY)
    return bad.select("file", "line", reason.alias("reason"))


def rejected_counts(rejected: DataFrame) -> DataFrame:
    """How many rows were rejected for each reason."""
    return rejected.groupBy("reason").agg(F.count("*").alias("rows"))


def _stored_schema() -> T.StructType:
    return T.StructType([*schemas.ARTEFACT.fields, T.StructField("output_name", T.StringType())])


def _internal(stored: DataFrame) -> DataFrame:
    """Header names to internal names; an empty CSV field comes back as null and is the empty text."""
    return stored.select(
        "output_name",
        *[
            F.coalesce(F.col(f"`{header}`"), F.lit("")).alias(name)
            for name, header in schemas.PRODUCT_FIELDS.items()
        ],
    )


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    return _internal(
        spark.read.schema(_stored_schema())
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("enforceSchema", False)
        .csv(path)
    )


def read_products_json(spark: SparkSession, path: str) -> DataFrame:
    return _internal(spark.read.schema(_stored_schema()).json(path))


def artefact_files(spark: SparkSession, path: str) -> DataFrame:
    """Stored artefacts: output name, file path and modification time; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select(
            F.regexp_extract("path", "output_name=([^/]+)", 1).alias("output_name"),
            F.col("path").alias("file_path"),
            F.col("modificationTime").alias("modified"),
            F.col("length").alias("bytes"),
        )
    )


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """All commits of a run's artefacts (`sinks.write_run`): (output_name, format, products, run_id, committed_at)."""
    folder = f"{path}/{schemas.CATALOGUE_FOLDER}"
    return spark.read.schema(schemas.CATALOGUE).option("basePath", folder).parquet(folder)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """What is stored now: the newest commit of each artefact."""
    newest = F.max_by(F.struct("products", "run_id", "committed_at"), F.struct("committed_at", "run_id"))
    stored = read_commits(spark, path).groupBy("output_name", "format").agg(newest.alias("newest"))
    return stored.select("output_name", "format", "newest.*")


def read_artefact(spark: SparkSession, path: str, output_name: str) -> DataFrame:
    """The products of one artefact; other folders are not read."""
    kind = output_name.rpartition(".")[2]
    read = read_products_csv if kind == "csv" else read_products_json
    return read(spark, f"{path}/{kind}").where(F.col("output_name") == output_name)
