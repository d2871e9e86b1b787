"""Every operator as a named query over the given tables or tables derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import markup, text
from shelfwise.operators import (
    cards,
    dedup,
    details,
    jobs,
    links,
    paging,
    requests,
    scan,
    summary,
    validate,
)
from shelfwise.plans import derived, pipeline
from shelfwise.runtime import spread, staged, work_dir
from shelfwise.schemas import ORIGIN_COLUMNS, PRODUCT_COLUMNS
from shelfwise.site import DEFAULT_SITE
from shelfwise.sources import landing, sinks
from shelfwise.streaming import pages as stream_pages
from shelfwise.streaming import state as stream_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Pacing used by the queries: one request per 1,200 s, bursts of 5, for every endpoint.
PACING = (1 / 1200, 5)


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(derived.table(spark, sf_dir, "pages"))


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages as a crawl leaves them: a table of files."""
    path = work_dir(spark, "landed")
    derived.listing_pages(spark, sf_dir).write.parquet(path)
    return spread(landing.scan_pages(spark, path))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.jobs_latest(derived.job_events(spark, sf_dir))


def _plain_times(df: DataFrame) -> DataFrame:
    """Instants as wall-clock times of the session zone, as the given tables have them."""
    instants = [n for n, t in df.dtypes if t == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in instants})


# Scans, sources, sinks


@query
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query
def envelope_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.struct(F.col("html").alias("content"))
    results = F.when(F.col("page_id") % 5 == 0, F.array().cast("array<struct<content:string>>"))
    results = results.otherwise(F.array(result, F.struct(F.lit("second").alias("content"))))
    fetched = _pages(spark, sf_dir).select("page_id", F.to_json(F.struct(results.alias("results"))).alias("body"))
    return landing.decode_envelopes(fetched)


@query
def scan_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "details")
    derived.detail_pages(spark, sf_dir).write.parquet(path)
    usable = F.length("html") >= details.MIN_PAGE_LENGTH
    return landing.scan_details(spark, path).select("clean_url", usable.alias("usable"))


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "csv")
    sinks.write_products_csv(derived.products(spark, sf_dir), path)
    return landing.read_products_csv(spark, path)


@query
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "json")
    sinks.write_products_json(derived.products(spark, sf_dir), path)
    return landing.read_products_json(spark, path)


@query
def partitioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all keywords, then some again: only those are replaced."""
    path = work_dir(spark, "partitioned")
    products = derived.products(spark, sf_dir)
    sinks.write_products_json(products, path)
    again = products.where(F.col("keyword").endswith("1") & (F.col("pos") % 2 == 0))
    sinks.write_products_json(again, path)
    stored = landing.read_products_json(spark, path)
    return stored.groupBy("output_name").agg(F.count("*").alias("products"))


def _dead_letter_file(spark: SparkSession, sf_dir: str) -> str:
    path = work_dir(spark, "letters")
    letters = jobs.dead_letters(derived.job_events(spark, sf_dir))
    odd = F.col("job_id").cast("bigint") % 2 == 1
    sinks.write_dead_letters(letters.where(odd), path)
    sinks.write_dead_letters(letters.where(~odd), path)
    return path


@query
def dead_letter_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwise.schemas import DEAD_LETTERS

    return spark.read.schema(DEAD_LETTERS).json(_dead_letter_file(spark, sf_dir))


@query
def dead_letter_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(landing.read_dead_letters(spark, _dead_letter_file(spark, sf_dir)))


def _brand_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest job states whose keywords are brands, so that they meet the product rows."""
    brand = F.concat(F.lit("Brand#"), (F.col("job_id") % 30).cast("string"))
    return _jobs(spark, sf_dir).withColumn("keyword", brand)


def _stored_run(spark: SparkSession, sf_dir: str) -> str:
    """Artefacts of two runs: the second one has only some keywords, and fewer products of them."""
    path = work_dir(spark, "artefacts")
    products = derived.products(spark, sf_dir)
    sinks.write_run(products, path, "run-1")
    sinks.write_run(products.where(F.col("keyword").endswith("1") & (F.col("pos") % 2 == 0)), path, "run-2")
    return path


@query
def job_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of completed jobs, read back from their artefacts: a row for each job and product."""
    path = work_dir(spark, "job-products")
    sinks.write_products_json(derived.products(spark, sf_dir), path, compression="gzip")
    stored = landing.read_products_json(spark, path).select("output_name", "title", "url", "item_number", "price")
    found = jobs.job_products(_brand_jobs(spark, sf_dir), stored)
    return found.select("job_id", "output_name", "title", "url", "item_number", "price")


@query
def job_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed jobs with the artefact that holds their products."""
    catalogue = landing.read_catalogue(spark, _stored_run(spark, sf_dir))
    found = jobs.job_products(_brand_jobs(spark, sf_dir), catalogue)
    return found.select("job_id", "output_name", "products", "run_id")


@query
def artifact_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored artefacts by the catalogue, each with what its files hold."""
    path = _stored_run(spark, sf_dir)
    files = landing.artefact_files(spark, path).groupBy("output_name").agg(
        (F.count("*") > 0).alias("has_files"), (F.min("bytes") > 0).alias("has_bytes")
    )
    held = landing.read_products_csv(spark, f"{path}/csv").unionByName(landing.read_products_json(spark, f"{path}/json"))
    counts = held.groupBy("output_name").agg(F.count("*").alias("held"))
    listed = landing.read_catalogue(spark, path).drop("committed_at")
    return listed.join(files, "output_name").join(counts, "output_name")


@query
def envelope_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched bodies that give no page: cut off, empty, without results, or null."""
    k = F.col("page_id")
    whole = F.to_json(F.struct(F.array(F.struct(F.col("html").alias("content"))).alias("results")))
    body = (
        F.when(k % 5 == 0, '{"results":[]}').when(k % 5 == 1, F.substring(whole, 1, 20)).when(k % 5 == 2, "")
        .when(k % 35 == 3, F.lit(None).cast("string")).otherwise(whole)
    )
    rejected = landing.rejected_envelopes(_pages(spark, sf_dir).select("page_id", body.alias("body")))
    return rejected.select("page_id", "reason")


@query
def dead_letter_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a dead-letter store that are no entry, counted by reason."""
    path = _dead_letter_file(spark, sf_dir)
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.concat(F.lit('{"job_id": "'), "p_name")).when(k % 3 == 1, '{"keyword": "x"}').otherwise("  ")
    derived.table(spark, sf_dir, "part").select(line.alias("value")).write.mode("append").text(path)
    return landing.rejected_counts(landing.rejected_dead_letters(spark, path))


# Filters


@query
def candidate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.candidate_links(derived.listing_pages(spark, sf_dir))
    return found.select("keyword", "page_no", "pos", "href")


@query
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).select("page_id", "html")
    return links.candidate_links(pages, prefix="/").select("page_id", "pos", "href")


@query
def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    asked = derived.table(spark, sf_dir, "part").select(
        k.alias("request_id"),
        F.when(k % 7 == 0, "   ")
        .when(k % 11 == 0, F.repeat(F.col("p_name"), F.lit(20)))
        .when(k % 13 == 0, "")
        .otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
        .alias("keyword"),
        (k % 23).cast("int").alias("max_pages"),
    )
    return summary.valid_requests(asked)


@query
def valid_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = validate.valid_products(derived.products(spark, sf_dir))
    return valid.select("keyword", "pos", "title", "url", "item_number")


@query
def invalid_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.invalid_products(derived.products(spark, sf_dir), ["pos"])
    return found.select(
        "keyword", "index", "title", "url", "item_number", F.array_join("errors", "|").alias("errors")
    )


@query
def usable_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details.usable_details(derived.detail_pages(spark, sf_dir)).select("clean_url")


@query
def completed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.completed_jobs(_jobs(spark, sf_dir)).select("job_id", "status", "progress")


@query
def terminal_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.terminal_jobs(_jobs(spark, sf_dir)).select("job_id", "status", "progress")


@query
def attempt_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = requests.attempt_class(F.col("status_code"), F.col("raised"))
    return derived.request_log(spark, sf_dir).select("event_id", kind.alias("attempt_class"))


# Projections


@query
def anchor_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.explode_anchors(_pages(spark, sf_dir).select("page_id", "html"))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.extract_products(_landed(spark, sf_dir))


@query
def extract_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select(*ORIGIN_COLUMNS, *PRODUCT_COLUMNS)


@query
def title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select(*ORIGIN_COLUMNS, "title", "title_method")


@query
def price_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select(*ORIGIN_COLUMNS, "price", "price_method")


@query
def image_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select(*ORIGIN_COLUMNS, "image_url")


@query
def item_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.candidate_links(derived.listing_pages(spark, sf_dir))
    return found.select(*ORIGIN_COLUMNS, text.item_number(F.col("href")).alias("item_number"))


@query
def title_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.candidate_links(derived.listing_pages(spark, sf_dir))
    return found.select(*ORIGIN_COLUMNS, text.title_from_url(F.col("href")).alias("title"))


@query
def clean_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", text.clean_url(F.col("url")).alias("clean_url"))


@query
def clean_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("k"), F.col("name")

    def around(before: str, after: str):
        return F.concat(F.lit(before), name, F.lit(after))

    noisy = (
        F.when(k % 8 == 0, around("Highly rated ", "$8.49($0.71/ounce)4.7 out of 5 stars"))
        .when(k % 8 == 1, around("", " with 262 ratings262 reviews"))
        .when(k % 8 == 2, around("", " Add to  cart"))
        .when(k % 8 == 3, around("  ", " .;!"))
        .when(k % 8 == 4, around("", " $8.49"))
        .when(k % 8 == 5, "")
        .when(k % 8 == 6, "12 reviews")
        .otherwise(around("\t", "\n BUY NOW shop now: "))
    )
    return derived.parts(spark, sf_dir).select("k", text.clean_title(noisy).alias("title"))


@query
def upc_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = details.extract_details(derived.detail_pages(spark, sf_dir))
    return found.select("clean_url", "upc", "upc_method")


@query
def detail_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = details.extract_details(derived.detail_pages(spark, sf_dir))
    return found.select("clean_url", "detail_price", "detail_price_method")


@query
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = (
        _pages(spark, sf_dir)
        .select("page_id", markup.normalise(F.col("html")).alias("markup"))
        .select("page_id", markup.text_nodes(F.col("markup")).alias("nodes"))
    )
    return nodes.select(
        "page_id",
        markup.tight(F.col("nodes")).alias("tight"),
        markup.spaced(F.col("nodes")).alias("spaced"),
    )


@query
def page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the pages get a footer that says which page they are."""
    footer = F.format_string("<span>Page&nbsp;list</span> <p>PAGE %d of 9</p>", F.col("page_id") % 7 + 1)
    html = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.concat("html", footer))
    numbered = _pages(spark, sf_dir).select("page_id", html.alias("html"))
    number = F.coalesce(paging.page_number(F.col("html")), F.lit(0))
    return numbered.select("page_id", number.alias("page_number"))


@query
def next_page_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.with_next_page(derived.listing_pages(spark, sf_dir)).select(
        "keyword", "page_no", "next_url"
    )


@query
def has_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.with_next_page(derived.listing_pages(spark, sf_dir)).select(
        "keyword", "page_no", "has_more"
    )


@query
def resolve_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.explode_anchors(_pages(spark, sf_dir).select("page_id", "html"))
    href = (
        F.when(F.col("pos") % 3 == 1, F.substring("href", F.lit(2), F.length("href")))
        .when(F.col("pos") % 3 == 2, F.concat(F.lit("http://other.example"), "href"))
        .otherwise(F.col("href"))
    )
    return found.select("page_id", "pos", text.resolve_href(href, DEFAULT_SITE.base_url).alias("url"))


@query
def output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = derived.table(spark, sf_dir, "part").select(
        F.lit("part").alias("source"),
        F.col("p_partkey").alias("id"),
        F.concat("p_name", F.lit(" & Ñandú - "), "p_type", F.lit("!")).alias("keyword"),
    )
    titles = _pages(spark, sf_dir).select(
        F.lit("page").alias("source"),
        F.col("page_id").alias("id"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("keyword"),
    )
    return parts.unionByName(titles).select(
        "source",
        "id",
        text.output_name(F.col("keyword"), "csv").alias("csv_name"),
        text.output_name(F.col("keyword"), "json").alias("json_name"),
    )


@query
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.keyed(derived.request_log(spark, sf_dir)).select("event_id", "key")


@query
def progress_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = (
        F.when(F.col("endpoint") == "signup", "starting")
        .when(F.col("endpoint") == "click", "retrying")
        .when(F.col("endpoint") == "purchase", "completed")
        .when(F.col("endpoint") == "error", "failed")
        .otherwise("page")
    )
    page = F.least("attempt", "max_pages")
    return derived.request_log(spark, sf_dir).select(
        "event_id", jobs.progress_pct(phase, page, F.col("max_pages")).alias("progress_pct")
    )


@query
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.with_errors(derived.products(spark, sf_dir))
    return checked.select("keyword", "pos", F.array_join("errors", "|").alias("errors"))


@query
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.products(spark, sf_dir).select(
        "keyword", "pos", validate.completeness().alias("completeness")
    )


@query
def backoff_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = F.col("event_id") % 9 + 1
    return derived.request_log(spark, sf_dir).select(
        "event_id", requests.backoff_delay(attempt).alias("delay_seconds")
    )


@query
def retry_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.number_failures(derived.job_events(spark, sf_dir)).select(
        "job_id", "event_id", "attempt", jobs.retry_delay(F.col("attempt")).alias("delay_seconds")
    )


# Joins


@query
def enrich_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pipeline.found_products(_landed(spark, sf_dir), None)
    final = pipeline.final_products(found, derived.detail_pages(spark, sf_dir))
    return final.select("keyword", "page_no", "item_number", "title", "url", "price", "upc")


def _run(spark: SparkSession, sf_dir: str) -> pipeline.Run:
    """All landed pages: pages without cards too, for keywords that find nothing."""
    landed = _landed(spark, sf_dir).unionByName(derived.empty_pages(spark, sf_dir))
    return pipeline.run(landed, derived.detail_pages(spark, sf_dir), None)


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords asked for: every brand, many times over, and some that find nothing."""
    part = derived.table(spark, sf_dir, "part")
    extra = part.where(F.col("p_partkey") % 100 == 0).select(
        F.concat(F.lit("none "), "p_name").alias("keyword")
    )
    return part.select(F.col("p_brand").alias("keyword")).unionByName(extra)


@query
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = summary.batch_results(_requested(spark, sf_dir), _run(spark, sf_dir).summary())
    return results.select("keyword", "success", "valid_products", "error")


@query
def batch_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _requested(spark, sf_dir)
    return summary.batch_success(
        summary.batch_results(asked, _run(spark, sf_dir).summary()), asked
    )


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).summary()


@query
def run_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation part of a run's results: every error of every row."""
    return _run(spark, sf_dir).errors()


@query
def run_invalid_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).invalid_products().select(
        "keyword", "index", "title", "url", "item_number", F.array_join("errors", "|").alias("errors")
    )


@query
def run_job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run reports of its jobs: started, each page, and the end."""
    run = _run(spark, sf_dir)
    asked = derived.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("job_id"))
    none = derived.table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(
        F.col("p_partkey").alias("job_id"), F.concat(F.lit("none "), "p_name").alias("keyword")
    )
    jobs_of_run = asked.withColumnRenamed("p_brand", "keyword").unionByName(none)
    return run.job_events(jobs_of_run).select("job_id", "event_id", "status", "progress", "keyword", "error")


@query
def cache_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(requests.cache_asof(derived.request_log(spark, sf_dir)))


@query
def dead_letter_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived.job_events(spark, sf_dir)
    done = jobs.completed_jobs(jobs.jobs_latest(events)).select(F.col("job_id").cast("string"))
    return jobs.remove_dead_letters(jobs.dead_letters(events), done).select("job_id", "keyword")


@query
def job_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artefacts named after brands; jobs that search for 'brand<n>'."""
    files = (
        derived.table(spark, sf_dir, "part")
        .groupBy("p_brand")
        .agg(F.max("p_partkey").alias("modified"))
        .select(text.output_name(F.col("p_brand"), "json").alias("filename"), "modified")
    )
    word = F.concat(F.lit("Brand"), (F.col("job_id") % 30).cast("string"))
    return jobs.job_files(_jobs(spark, sf_dir).withColumn("keyword", word), files)


@query
def nearest_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwise.functions import nesting

    pages = _pages(spark, sf_dir).select(
        "page_id", nesting.page_links(markup.normalise(F.col("html"))).alias("links")
    )
    return links.unnest(pages, ["page_id"], "links").select("page_id", "pos", "container")


@query
def spec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived.detail_pages(spark, sf_dir).select(
        "clean_url", details.definition_pairs(markup.normalise(F.col("html"))).alias("pairs")
    )
    return links.unnest(pages, ["clean_url"], "pairs").select("clean_url", "term", "definition")


# Aggregations


@query
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validation_summary(derived.products(spark, sf_dir))


@query
def error_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.error_list(derived.products(spark, sf_dir)).drop("page_no")


@query
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.quality_score(derived.products(spark, sf_dir), ["keyword"])


@query
def products_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.products_per_job(derived.products(spark, sf_dir), _brand_jobs(spark, sf_dir))


@query
def dead_letter_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = jobs.dead_letters(derived.job_events(spark, sf_dir))
    return letters.agg(F.count("*").alias("total"))


@query
def highest_page_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = F.format_string(
        '<nav><a href="/s?page=%d">a</a><a href="s?p=%d">b</a>'
        '<a href="https://shop.example/page/4">c</a></nav>',
        F.col("page_id") % 5 + 1,
        F.col("page_id") % 9,
    )
    pages = _pages(spark, sf_dir).select("page_id", F.concat("html", nav).alias("html"))
    return paging.highest_page_link(pages).select("page_id", "highest_url")


@query
def jobs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(_jobs(spark, sf_dir))


@query
def attempt_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts are numbered by time, as in a log that does not carry the number."""
    log = derived.request_log(spark, sf_dir).drop("attempt")
    return requests.attempt_outcome(log)


# Windows


@query
def dedup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page twice over, so that each of its links repeats."""
    pages = _pages(spark, sf_dir).select("page_id", F.concat("html", "html").alias("html"))
    return links.distinct_links(pages, prefix="/").select("page_id", "pos", "href")


@query
def dedup_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup.first_per_identifier(derived.products(spark, sf_dir))
    return kept.select("keyword", "pos", "item_number", "url")


@query
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.distinct_links(derived.listing_pages(spark, sf_dir))
    return paging.running_total(found)


@query
def page_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 2 of some brands is missing, so their prefix ends before it."""
    pages = paging.with_next_page(derived.listing_pages(spark, sf_dir))
    landed = pages.where(~(F.col("keyword").endswith("3") & (F.col("page_no") == 2)))
    return paging.page_prefix(landed, None).select("keyword", "page_no", "last_page")


@query
def capped_page_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a page limit of its own per run, above what a request may ask for."""
    pages = paging.with_next_page(derived.listing_pages(spark, sf_dir))
    landed = pages.where(~(F.col("keyword").endswith("3") & (F.col("page_no") == 2)))
    return paging.page_prefix(landed, derived.PAGE_LIMIT).select("keyword", "page_no", "last_page")


@query
def progress_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = jobs.progress_changes(derived.job_events(spark, sf_dir))
    return changed.select("job_id", "event_id", "status", "progress")


@query
def pacing_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {endpoint: PACING for endpoint in derived.STATUS_OF_EVENT}
    return requests.pacing_wait(derived.request_log(spark, sf_dir), limits).select(
        "event_id", "endpoint", "waited_micros"
    )


@query
def retry_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(jobs.retry_routing(derived.job_events(spark, sf_dir)))


# Order and union


@query
def ordered_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every distinct link in the order of discovery."""
    found = staged(
        links.distinct_links(derived.listing_pages(spark, sf_dir)).select("keyword", "page_no", "pos", "href"), "found"
    )
    return scan.with_row_index(found, ["keyword"], ["page_no", "pos"], name="nth").select(
        "keyword", "nth", "href"
    )


@query
def union_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product links of two landing tables as one."""
    pages = derived.listing_pages(spark, sf_dir)
    odd = links.distinct_links(pages.where(F.col("page_no") % 2 == 1))
    even = links.distinct_links(pages.where(F.col("page_no") % 2 == 0))
    return odd.unionByName(even).select("keyword", "page_no", "pos", "href")


# Sequential rules


@query
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only successful runs are stored."""
    return requests.cache_hits(derived.request_log(spark, sf_dir), ok=F.col("status_code") == 200)


@query
def pacing_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.pacing_deny(derived.request_log(spark, sf_dir), *PACING)


# Streams, each run over all that has landed and then stopped


@query
def stream_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, out = work_dir(spark, "landed"), work_dir(spark, "streamed")
    derived.listing_pages(spark, sf_dir).repartition(4).write.parquet(source)
    stream_pages.run(stream_pages.page_stream(spark, source, files_per_batch=2), out)
    final = stream_pages.read_products(spark, out)
    return final.select("keyword", "page_no", "item_number", "title", "price")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_state.event_stream(spark, sf_dir, "events.parquet")


def _job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.job_events_of(_event_stream(spark, sf_dir))


@query
def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(stream_state.live_jobs(_job_stream(spark, sf_dir)))


# The given events fill one batch of any order, and none is forgotten while they last.
IN_ONE_RUN = {"lateness": "10 minutes", "retention": 20 * 366 * 86_400}


@query
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_state.progress(_job_stream(spark, sf_dir), **IN_ONE_RUN)


@query
def stream_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing decisions; rows for retries that have come due depend on where the stream ends."""
    routed = stream_state.retries(_job_stream(spark, sf_dir), **IN_ONE_RUN).where(F.col("status") != "due")
    return _plain_times(routed).select("job_id", "event_id", "attempt", "next_retry_at", "status")


def _request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.request_log_of(_event_stream(spark, sf_dir))


@query
def stream_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _request_stream(spark, sf_dir)
    return stream_state.cache_hits(log.withColumn("ok", F.col("status_code") == 200))


@query
def stream_pacing_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_state.pacing_deny(_request_stream(spark, sf_dir), *PACING)
