"""The whole run: landed pages to final products and run results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import cards, dedup, details, jobs, paging, scan, summary, validate
from shelfwise.operators.paging import DEFAULT_MAX_PAGES
from shelfwise.runtime import spread, staged
from shelfwise.schemas import ORIGIN_COLUMNS, PRODUCT_COLUMNS
from shelfwise.site import DEFAULT_SITE, SiteProfile


@dataclass(frozen=True)
class Run:
    """All rows found on the pages that count, the final products, and the last page of each keyword."""

    found: DataFrame
    products: DataFrame
    ends: DataFrame

    def summary(self) -> DataFrame:
        return summary.run_summary(self.found, self.products, self.ends)

    def invalid_products(self) -> DataFrame:
        """Rows that broke a rule, with their place among all rows of their keyword and their errors."""
        return validate.invalid_products(self.found, ["page_no", "pos"])

    def job_events(self, of_run: DataFrame, max_pages: int | None = None) -> DataFrame:
        """What the run has to say of its jobs (job_id, keyword), as rows of the job event table.

        Started, every page with its percentage, completed or failed; event_id is the order inside a job. Without
        `max_pages` the percentage is of the pages that counted.
        """
        ended = scan.join_null_safe(of_run.select("job_id", "keyword"), self.summary(), ["keyword"])
        total = F.lit(max_pages) if max_pages is not None else F.greatest("pages_scraped", F.lit(1))
        pages = F.sequence(F.lit(0), F.col("pages_scraped") + 1)
        last = F.col("event_id") == F.col("pages_scraped") + 1
        outcome = F.when(F.col("success"), "completed").otherwise("failed")
        phase = F.when(F.col("event_id") == 0, "starting").when(last, outcome).otherwise("page")
        return ended.withColumn("event_id", F.explode(pages)).select(
            F.col("job_id").cast("bigint").alias("job_id"),
            F.current_timestamp().alias("ts"),
            F.col("event_id").cast("bigint").alias("event_id"),
            F.when(last, outcome).otherwise("running").alias("status"),
            jobs.progress_pct(phase, F.col("event_id"), total).alias("progress"),
            "keyword",
            F.when(last, F.col("error")).alias("error"),
        )

    def errors(self) -> DataFrame:
        """All errors, one row each, in the order (page_no, pos, error_no)."""
        return validate.error_list(self.found)


def _found(
    pages: DataFrame, max_pages: int | None, site: SiteProfile
) -> tuple[DataFrame, DataFrame]:
    near = pages if max_pages is None else pages.where(F.col("page_no") <= max_pages)
    flagged = paging.with_next_page(near, site.base_url).drop("next_url")
    linked = spread(staged(cards.linked_pages(flagged, site), "links"))
    ends = staged(paging.last_pages(linked, max_pages), "ends")
    kept = paging.counted_pages(linked, ends).drop("has_more")
    return staged(cards.products_of(kept, site), "found"), ends


def found_products(
    pages: DataFrame, max_pages: int | None = DEFAULT_MAX_PAGES, site: SiteProfile = DEFAULT_SITE
) -> DataFrame:
    """Product rows of each keyword's page prefix, before validation.

    Whether a page counts depends on the other pages of its keyword, so the pages would be read
    twice. Instead they are read once: links and paging flags, a small part of the HTML, are
    written, and both the prefix and the products come from that table. The product rows are
    written too: they have several readers, and a filter on a title must not be pushed below the
    rules that make the title, where it would repeat all of them.
    """
    return _found(pages, max_pages, site)[0]


def final_products(found: DataFrame, detail_pages: DataFrame | None = None) -> DataFrame:
    """Valid, distinct products, enriched from their pages.

    Neither the rules nor the identifiers read UPC or price, so invalid and repeated rows are
    dropped before the join. Only pages that a product asks for are read for details.
    """
    kept = dedup.first_per_identifier(
        validate.valid_products(found.select(*ORIGIN_COLUMNS, *PRODUCT_COLUMNS))
    )
    if detail_pages is None:
        return kept
    kept = staged(kept, "kept")
    asked = kept.select(F.col("url").alias("clean_url")).distinct()
    wanted = detail_pages.join(asked, "clean_url", "left_semi")
    return details.enrich(kept, details.extract_details(wanted))


def run(
    pages: DataFrame,
    detail_pages: DataFrame | None = None,
    max_pages: int | None = DEFAULT_MAX_PAGES,
    site: SiteProfile = DEFAULT_SITE,
) -> Run:
    """All landed pages of a keyword count where `max_pages` is None."""
    found, ends = _found(pages, max_pages, site)
    return Run(found, staged(final_products(found, detail_pages), "final"), ends)
