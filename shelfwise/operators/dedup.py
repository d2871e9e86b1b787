"""First product per identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def first_per_identifier(
    products: DataFrame,
    key: str = "item_number",
    within: tuple[str, ...] = ("keyword",),
    order: tuple[str, ...] = ("page_no", "pos"),
) -> DataFrame:
    """Keep the first row of each identifier: the key, else the URL; rows with neither all stay.

    `row_number() = 1` becomes a group limit in front of the shuffle as well, so an identifier
    repeated on very many rows sends one row per task. Rows without an identifier are told apart
    by their position.
    """
    identity = F.when(F.col(key) != "", F.struct(F.lit(0).alias("kind"), F.col(key).alias("value")))
    identity = identity.when(
        F.col("url") != "", F.struct(F.lit(0).alias("kind"), F.col("url").alias("value"))
    ).otherwise(
        F.struct(F.lit(1).alias("kind"), F.concat_ws("\u0001", *order).alias("value"))
    )
    first = Window.partitionBy(*within, "identity").orderBy(*order)
    return (
        products.withColumn("identity", identity)
        .withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") == 1)
        .drop("identity", "nth")
    )
