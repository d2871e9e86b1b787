"""Row rules, their reports, and the quality score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.markup import is_blank
from shelfwise.operators import scan
from shelfwise.schemas import PRODUCT_COLUMNS, PRODUCT_FIELDS
from shelfwise.site import DEFAULT_SITE

# Weights of the score.
VALID_WEIGHT, COMPLETE_WEIGHT, SCORE_DIGITS = 0.7, 0.3, 3


@dataclass(frozen=True)
class Rules:
    """What a product row must satisfy."""

    required: tuple[str, ...] = ("title", "url", "item_number")
    url_pattern: str = DEFAULT_SITE.url_pattern
    item_pattern: str = DEFAULT_SITE.item_pattern
    title_min: int = 3
    title_max: int = 500


DEFAULT_RULES = Rules()


def validation_errors(rules: Rules = DEFAULT_RULES) -> Column:
    """Error texts of a product row, in rule order; empty for a valid row. The texts are fixed values."""
    title, url, item = F.col("title"), F.col("url"), F.col("item_number")
    checks = [
        (is_blank(F.col(c)), F.lit(f"Missing required field: {PRODUCT_FIELDS[c]}"))
        for c in rules.required
    ]
    checks += [
        ((url != "") & ~url.rlike(rules.url_pattern), F.concat(F.lit("Invalid URL format: "), url)),
        (
            (item != "") & ~item.rlike("(?U)" + rules.item_pattern),
            F.concat(F.lit("Invalid TCIN format: "), item),
        ),
        (
            (title != "") & (F.length(title) < rules.title_min),
            F.concat(F.lit("Title too short: "), title),
        ),
        (F.length(title) > rules.title_max, F.concat(F.lit("Title too long: "), title)),
    ]
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(failed, F.array(message)).otherwise(none) for failed, message in checks])


def with_errors(products: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    return products.withColumn("errors", validation_errors(rules))


def valid_products(products: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    return with_errors(products, rules).where(F.size("errors") == 0).drop("errors")


def invalid_products(
    products: DataFrame, order: list[str], rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Invalid rows with their position in the input of their keyword and their errors."""
    checked = scan.with_row_index(with_errors(products, rules), ["keyword"], order, name="index")
    return checked.where(F.size("errors") > 0)


def error_list(products: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One row per error; (page_no, pos, error_no) is the order of the flat list."""
    return with_errors(products, rules).select(
        "keyword", "page_no", "pos", F.posexplode("errors").alias("error_no", "error")
    )


def validation_summary(products: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Totals and valid rate per keyword."""
    checked = products.select("keyword", (F.size(validation_errors(rules)) == 0).alias("ok"))
    return checked.groupBy("keyword").agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("valid"),
        F.count_if(~F.col("ok")).alias("invalid"),
        (F.count_if("ok") / F.count("*")).alias("valid_rate"),
    )


def filled_fields() -> Column:
    """How many of the 18 fields hold more than white space."""
    return reduce(
        lambda a, b: a + b, [F.when(is_blank(F.col(c)), 0).otherwise(1) for c in PRODUCT_COLUMNS]
    )


def completeness() -> Column:
    return filled_fields() / len(PRODUCT_COLUMNS)


def score(valid: Column, total: Column, filled: Column) -> Column:
    """Score from the number of valid rows, all rows, and filled fields of the valid rows.

    Counts are summed as integers, so the result does not depend on the order of the rows.
    """
    rate = valid / F.nullif(total, F.lit(0))
    complete = filled / (F.nullif(valid, F.lit(0)) * len(PRODUCT_COLUMNS))
    weighted = VALID_WEIGHT * rate + COMPLETE_WEIGHT * F.coalesce(complete, F.lit(0.0))
    return F.coalesce(F.round(weighted, SCORE_DIGITS), F.lit(0.0))


def quality_score(
    products: DataFrame, keys: list[str] | None = None, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Quality per group, or over all rows; no rows at all score 0."""
    ok = F.size(validation_errors(rules)) == 0
    measured = products.select(
        *(keys or []), ok.alias("ok"), F.when(ok, filled_fields()).alias("filled")
    )
    return measured.groupBy(*(keys or [])).agg(
        score(F.count_if("ok"), F.count("*"), F.sum("filled")).alias("quality_score")
    )
