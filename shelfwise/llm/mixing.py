"""Mixes sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.names import spare
from shelfwise.runtime import staged

SEED = "mix-1"
# Without given weights a source weighs as its size to this power.
POWER = 0.5
# One draw has at most this mean, as exp(-mean) must not vanish; larger means take a sum of draws.
LARGEST_MEAN = 500.0
HASH_DIGITS = 13


def uniform(*parts: Column) -> Column:
    """Number in [0, 1) from 52 bits of a hash."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**HASH_DIGITS))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as far as doubles tell them from 1."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("all"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["all"], F.array(F.element_at(state["all"], -1) + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["all"])


def source_rates(
    docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, epochs: float = 1.0
) -> DataFrame:
    """(source, size, rate): size in characters and one per document; rate is the mean number of copies.

    The mixture has `epochs` times the size of all sources. weights: share of each source, of any sum; a
    source without a weight gets none. None: size ** power. A null source is a source of its own.
    """
    sizes = docs.groupBy("source").agg(
        F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).cast("double").alias("size")
    )
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow("size", F.lit(power)))
    else:
        table = F.create_map(*[F.lit(x) for item in weights.items() for x in item]) if weights else F.lit(None)
        given = F.when(F.col("source").isNotNull(), table[F.col("source")]) if weights else F.lit(0.0)
        weighted = sizes.withColumn("weight", F.coalesce(given, F.lit(0.0)))
    total = weighted.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    # One row meets the sources: not a join of two large sides.
    return weighted.join(F.broadcast(total)).select(
        "source", "size",
        F.when(
            F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * epochs * F.col("all_size") / F.col("size")
        ).otherwise(0.0).alias("rate"),
    )


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = POWER,
    epochs: float = 1.0,
    seed: str = SEED,
) -> DataFrame:
    """`docs` (doc_id, text, source, ...) with each row repeated as a Poisson draw says, in random order.

    The draw inverts the distribution of the source's rate at a hash of seed and doc_id, so it does not
    depend on partitions, order or retries. Adds `copy` (from 1) and `shuffle_key` in place of columns of these names; rows are dealt to
    partitions by a hash and sorted by shuffle_key inside them. Rows with the same doc_id share a draw; for a
    null doc_id the hash of the text stands in. Null texts have size 0. An empty table gives no rows.
    """
    names = ("of_source", "n_draws", "draw_cdf", "draw_key", "drawn", "n_times", "n_copy")
    source, draws, cdf, identity, drawn, times, number = spare(docs, *names)
    rates = staged(
        source_rates(docs, weights, power, epochs)
        .withColumn("draws", F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int"))
        .withColumn("cdf", poisson_cdf(F.col("rate") / F.col("draws")))
        .select(F.col("source").alias(source), F.col("draws").alias(draws), F.col("cdf").alias(cdf)),
        "rates",
    )
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    joined = docs.join(rates, docs["source"].eqNullSafe(rates[source])).withColumn(identity, own)
    joined = joined.withColumn(
        drawn,
        F.transform(
            F.sequence(F.lit(1), F.col(draws)),
            lambda k: uniform(F.lit(seed), F.col(identity), k.cast("string")),
        ),
    )
    count = F.aggregate(
        drawn,
        F.lit(0),
        lambda n, u: n + F.size(F.filter(cdf, lambda c: c <= u)),
    )
    copies = joined.withColumn(times, count).where(F.col(times) > 0)
    exploded = copies.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(times))))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), identity, F.col(number).cast("string")))
    return (
        exploded.select(
            *[docs[c] for c in docs.columns if c not in ("copy", "shuffle_key")],
            F.col(number).alias("copy"),
            key.alias("shuffle_key"),
        )
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of `documents` mixed by the square root of their sources' sizes."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size AS rate FROM sizes
), pmf AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM rates, generate_series(0, 200) AS g(k)
), cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf
), lists AS (
  SELECT source, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source
), drawn AS (
  SELECT d.*, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS identity, cdf
  FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source
), counted AS (
  SELECT * EXCLUDE (cdf),
    len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('mix-1:' || identity || ':1'), 1, 13))::BIGINT / 4503599627370496.0)) AS times
  FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
  md5('mix-1:order:' || identity || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, times + 1)) AS copy FROM counted)
"""
