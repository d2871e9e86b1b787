"""Quality rules whose cutoffs bound the share of good documents they reject. DataFrame functions only."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.names import spare
from shelfwise.runtime import staged

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
# Of the good documents of a stratum, all rules together reject at most this share ...
FALSE_REJECTIONS = 0.05
# ... but for this chance that any of the cutoffs is wrong.
ERROR = 0.05
# The statistic of each rule and its possible cutoffs, from mild to strict. A document is
# rejected if the statistic is above the cutoff.
RULES: dict[str, list[float]] = {
    "symbols": [3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02],
    "repeated_lines": [0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "repeated_words": [0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.04],
    "capitals": [0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "long_words": [20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0, 6.5],
    "short_words": [-2.0, -2.5, -3.0, -3.25, -3.5, -3.75, -4.0, -4.25],
}


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with a struct `__q` of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the
    statistics of RULES. Columns in between start with two underscores.

    n_repeat_words sorts window hashes with their positions, and only for texts with a repeated window:
    n log n in the length of the text.
    """
    t, w = F.col("__t"), F.col("__w")
    df = docs.withColumn("__t", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn("__w", F.array_remove(F.split(t, SPACE), ""))
    df = df.withColumn("__n", F.size(w)).withColumn("__h", F.transform(w, lambda x: F.xxhash64(x)))
    n, h = F.col("__n"), F.col("__h")
    windows = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])
    )
    df = df.withColumn("__g", F.when(n > WINDOW, windows))
    g = F.col("__g")
    repeated = F.size(F.array_distinct(g)) < F.size(g)
    df = df.withColumn(
        "__s", F.when(repeated, F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    )
    s = F.col("__s")
    twice = F.filter(
        s,
        lambda e, k: (F.get(s, k - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(e["h"])),
    )
    df = df.withColumn("__p", F.array_sort(F.transform(twice, lambda e: e["i"])))
    p = F.col("__p")
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__l", lines)
    df = df.withColumn(
        "__b",
        F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            (F.length(t) - F.length(F.regexp_replace(t, "[A-Z!]", ""))).alias("capitals"),
            F.size("__l").alias("n_lines"),
        ),
    )
    b = F.col("__b")
    words, chars = F.greatest(b["n_words"], F.lit(1)), F.greatest(b["word_chars"], F.lit(1))
    return df.withColumn(
        "__q",
        F.struct(
            *[b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            ((b["n_words"] < 10) | (100 * b["n_repeat_words"] > 20 * b["n_words"])).alias("base_failed"),
            (b["n_symbols"] / words).alias("symbols"),
            (b["n_dup_lines"] / F.greatest(b["n_lines"], F.lit(1))).alias("repeated_lines"),
            (b["n_repeat_words"] / words).alias("repeated_words"),
            (b["capitals"] / chars).alias("capitals"),
            (b["word_chars"] / words).alias("long_words"),
            (-b["word_chars"] / words).alias("short_words"),
        ),
    ).select(*[docs[c] for c in docs.columns], "__q")


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """P(X <= k) for X binomial of n trials with chance `share`; 1 where k is above the mean."""

    def step(state: Column, j: Column) -> Column:
        lp = state["lp"] + F.log((n - j + 1) / j) + log(share / (1 - share))
        return F.struct(lp.alias("lp"), (state["total"] + F.exp(lp)).alias("total"))

    first = n.cast("double") * log(1 - share)
    start = F.struct(first.alias("lp"), F.exp(first).alias("total"))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * share, 1.0).otherwise(F.aggregate(steps, start, step, lambda state: state["total"]))


def cutoffs(
    measures: DataFrame, labels: DataFrame, stratum: str = "lang",
    false_rejections: float = FALSE_REJECTIONS, error: float = ERROR,
) -> DataFrame:
    """One row per stratum with the strictest safe cutoff of every rule (null: none is safe).

    The good documents among `labels` (doc_id, quality) are the holdout: those with no label but 1, past the
    base rules. A cutoff is safe if its false rejections k of n good documents are so few that a share of
    false_rejections / rules would give k or fewer with chance at most error / (rules x strata), an exact
    binomial bound. Cutoffs are tested from mild to strict and k only grows, so that a sequence needs no
    correction of its own (fixed-sequence testing); strata and rules are corrected by Bonferroni.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    share = false_rejections / len(RULES)
    held = (
        measures.select("doc_id", F.col(stratum).alias("stratum"), "__q")
        .join(good.select("doc_id"), "doc_id", "left_semi")
        .where(~F.col("__q.base_failed"))
    )
    counts = held.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *[
            F.count_if(F.col(f"__q.{rule}") > F.lit(cut)).alias(f"{rule}_{i}")
            for rule, cuts in RULES.items()
            for i, cut in enumerate(cuts)
        ],
    )
    counts = staged(counts, "holdout")
    tests = len(RULES) * max(1, counts.count())
    safe = [
        F.array_max(
            F.array(
                *[
                    F.when(binomial_tail(F.col(f"{rule}_{i}"), F.col("n"), share) <= error / tests, F.lit(i))
                    for i in range(len(cuts))
                ]
            )
        ).alias(rule)
        for rule, cuts in RULES.items()
    ]
    chosen = counts.select("stratum", *safe)
    return chosen.select(
        "stratum",
        *[F.get(F.array(*map(F.lit, cuts)), F.col(rule)).alias(rule) for rule, cuts in RULES.items()],
    )


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """`docs` (doc_id, text, and the stratum) with the struct `__q` of measures and the boolean `__kept`.

    Measures are taken once and written down; cutoffs come from those of the labelled documents. A null
    text has no words and fails the base rules. A null stratum is a stratum of its own; one without labels keeps what
    the base rules keep.
    Repeated rows are judged one by one. Labels of unknown documents and null ids are ignored. Without
    labels only the base rules act. An empty table gives no rows.
    """
    measures = staged(measured(docs), "measures")
    cuts = staged(cutoffs(measures, labels, stratum, **options), "cutoffs").select(
        F.col("stratum").alias("__stratum"), *[F.col(rule).alias(f"__cut_{rule}") for rule in RULES]
    )
    passed = ~F.col("__q.base_failed")
    for rule in RULES:
        passed &= F.coalesce(F.col(f"__q.{rule}") <= F.col(f"__cut_{rule}"), F.lit(True))
    joined = measures.join(cuts, measures[stratum].eqNullSafe(cuts["__stratum"]), "left")
    return joined.withColumn("__kept", passed).select(*[measures[c] for c in measures.columns], "__kept")


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that pass all rules. Columns whose names begin with two underscores are set aside meanwhile."""
    own = [c for c in docs.columns if c.startswith("__")]
    aside = dict(zip(own, spare(docs, *[f"column_{i}" for i in range(len(own))]), strict=True))
    kept = judged(docs.withColumnsRenamed(aside), labels, **options).where("__kept")
    return kept.select([aside.get(c, c) for c in docs.columns]).withColumnsRenamed({v: k for k, v in aside.items()})


def quality_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged(docs.select("doc_id", "text", "lang"), labels, **options).select(
        "doc_id", *[F.col(f"__q.{c}").alias(c) for c in columns], F.col("__kept").alias("kept")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )
