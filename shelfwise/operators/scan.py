"""Ordered scans that survive hot keys.

A plain window puts all rows of a key into one task. Here rows are dealt by ranges of (key, order),
so every part has about as many rows, whatever the keys and the clock do: a key with a third of all
rows, and a key whose rows all have one time, fill many parts. Windows run inside the parts of a key;
then one summary row for each part of a key is scanned, and the carry of the earlier parts is joined
back. Only a key that crosses a border between two parts has a carry, so there are fewer carries
than parts, and they are sent to all tasks. Results are exact. Null keys are a key of their own, and a null
order comes first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.runtime import staged

PART = "_part"


@dataclass(frozen=True)
class Carry:
    """How a value is carried along the order."""

    scan: Callable[[Column], Column]
    total: Callable[[Column, Column], Column]
    join: Callable[[Column, Column], Column]


SUM = Carry(
    F.sum,
    lambda value, order: F.sum(value),
    lambda earlier, here: F.coalesce(earlier, F.lit(0)) + F.coalesce(here, F.lit(0)),
)
MAX = Carry(F.max, lambda value, order: F.max(value), F.greatest)
LAST = Carry(
    lambda value: F.last(value, ignorenulls=True),
    lambda value, order: F.max_by(value, F.when(value.isNotNull(), order)),
    lambda earlier, here: F.coalesce(here, earlier),
)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same name; null keys meet null keys. Keys come once."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def parted(rows: DataFrame, keys: list[str], order: list[str], rows_per_part: int | None = None) -> DataFrame:
    """Rows with the number of their part; parts are ranges of (keys, order) of about equal size.

    rows_per_part: about so many rows in each; without it parts are sized by Spark.

    The ranges are found by reading the rows once more, and are written, since a repeated task could find others.
    Stage rows that are costly to make.
    """
    number = [] if rows_per_part is None else [1 + rows.count() // rows_per_part]
    ranged = rows.repartitionByRange(*number, *keys, *order).withColumn(PART, F.spark_partition_id())
    return staged(ranged, "parts")


def carried(
    totals: DataFrame, keys: list[str], values: dict[str, tuple[Column, Carry]], few: bool = True
) -> DataFrame:
    """(keys, part) with the values carried over the earlier parts of the key; first parts are left out.

    few: parts come from `parted`, so that fewer rows than parts are left.
    """
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    scanned = totals.withColumns(
        {name: how.scan(value).over(earlier) for name, (value, how) in values.items()}
        | {"_first": F.min(PART).over(Window.partitionBy(*keys))}
    )
    left = scanned.where(F.col(PART) > F.col("_first")).select(*keys, PART, *values)
    return F.broadcast(left) if few else left


def before(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[Column, Carry]],
    chunk: Column | None = None,
) -> DataFrame:
    """Adds, under each name, the value carried over all strictly earlier rows of the key.

    chunk: a number that does not decrease along the order, instead of parts of equal size; it saves
    the sorting by ranges where rows are known to be spread evenly over it.
    """
    few = chunk is None
    rows = parted(rows, keys, order) if few else rows.withColumn(PART, F.coalesce(chunk.cast("bigint"), F.lit(-(2**62))))
    earlier = (
        Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = rows.withColumns(
        {f"_{name}_here": how.scan(value).over(earlier) for name, (value, how) in values.items()}
    )
    totals = rows.groupBy(*keys, PART).agg(
        *[
            how.total(value, F.struct(*order)).alias(f"_{name}_total")
            for name, (value, how) in values.items()
        ]
    )
    carries = carried(
        totals, keys, {f"_{name}_carry": (F.col(f"_{name}_total"), how) for name, (_, how) in values.items()}, few
    )
    joined = join_null_safe(local, carries, [*keys, PART], "left")
    return joined.withColumns(
        {name: how.join(F.col(f"_{name}_carry"), F.col(f"_{name}_here")) for name, (_, how) in values.items()}
    ).drop(PART, *[f"_{name}_{kind}" for name in values for kind in ("here", "carry")])


def with_row_index(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column | None = None,
    name: str = "row_index",
) -> DataFrame:
    """Zero-based position of each row within its key."""
    return before(rows, keys, order, {name: (F.lit(1).cast("bigint"), SUM)}, chunk)
