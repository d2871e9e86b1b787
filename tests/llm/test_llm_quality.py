"""Quality rules: base counts against plain counting, bounds against exact binomial sums."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import quality


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeated = len(words), len(covered)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated,
        n < 10 or 100 * repeated > 20 * n,
    )


TEXTS = [
    None, "", " \n\t ", "one two", "a b c d e f g h i j", "a b c d e " * 4, "x\ny\nx\n\nx \n", "né à # $ %% & | < > *",
    "a a a a a a a a a a a a", "w1 w2 w3 w4 w5 u v w1 w2 w3 w4 w5 " + " ".join(f"z{i}" for i in range(90)),
    " ".join(f"q{i}" for i in range(20000)), "non breaking space", "\x0bvertical\x0cfeed",
]


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int")


def test_base_counts(documents, no_labels):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[4]), (4, TEXTS[4])]
    found = quality.quality_report(documents(rows), no_labels).collect()
    own = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found]
    assert sorted(own, key=repr) == sorted([(d, *plain_counts(t)) for d, t in rows], key=repr)
    assert all(r.kept == (not r.base_failed) for r in found)  # without labels no cutoff is safe


def test_query_counts(spark, sf_dir, tables):
    found = {r.doc_id: r for r in quality.op10_quality_rules(spark, sf_dir).collect()}
    rows = tables("SELECT doc_id, text FROM '{dir}/documents.parquet'")
    assert len(found) == len(rows)
    for doc_id, text in rows:
        r = found[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(text)
        assert not (r.kept and r.base_failed)


def test_binomial_bound_is_exact(spark):
    cases = [(0, 50), (1, 200), (3, 1000), (40, 5000), (0, 0), (9, 100)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        exact = sum(math.comb(r.n, j) * 0.01**j * 0.99 ** (r.n - j) for j in range(r.k + 1))
        assert r.p == pytest.approx(1.0 if r.k > 0.01 * r.n else exact, rel=1e-9)


def good(i):
    return f"plain text number {i} with some ordinary words in it and a calm end"


def test_cutoffs_are_the_strictest_safe_ones(spark, documents):
    """Each stratum has cutoffs of its own; one that rejects too many good documents is not taken."""
    rows = [(i, good(i), "en") for i in range(2000)]
    rows += [(10_000 + i, good(i) + (" # #" if i % 2 else ""), "de") for i in range(2000)]
    rows += [(20_000, good(1) + " # # #", "en"), (20_001, good(1) + " # # #", "de"), (20_002, good(1) + " # #", "fr"), (20_003, good(1), None)]
    labels = spark.createDataFrame(
        [(d, 1, "x") for d, *_ in rows if d < 20_000] + [(20_000, 0, "y"), (None, 1, "z"), (99_999, 1, "z"), (5, None, "z")],
        "doc_id long, quality int, text string",
    )
    df = documents(rows)
    cuts = {r.stratum: r for r in quality.cutoffs(quality.measured(df), labels).collect()}
    assert set(cuts) == {"en", "de"}
    symbols = {"en": 0.0, "de": 2 / 16}
    for lang, worst in symbols.items():
        safe = [c for c in quality.RULES["symbols"] if c >= worst]
        assert cuts[lang].symbols == safe[-1]
    kept = {r.doc_id: r for r in quality.judged(df, labels).where("doc_id >= 20000").collect()}
    assert not kept[20_000]["__kept"] and not kept[20_001]["__kept"]
    assert kept[20_002]["__kept"] and kept[20_003]["__kept"]  # no holdout, no cutoff


def test_few_labels_give_no_cutoff(spark, documents):
    df = documents([(i, good(i), "en") for i in range(30)])
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    row = quality.cutoffs(quality.measured(df), labels).first()
    assert all(row[rule] is None for rule in quality.RULES)


def test_good_documents_are_seldom_rejected(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    judged = quality.judged(docs, labels).join(labels.where("quality = 1").select("doc_id"), "doc_id")
    tried = judged.where("not __q.base_failed")
    assert tried.where("not __kept").count() <= quality.FALSE_REJECTIONS * tried.count()


def test_filter_keeps_columns_and_takes_empty_tables(documents, no_labels):
    df = documents([(1, good(1)), (2, "short"), (None, None)])
    kept = quality.quality_filter(df, no_labels)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]
    assert quality.quality_filter(documents([]), no_labels).count() == 0


def test_no_python_on_the_way(documents, no_labels):
    plan = quality.measured(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_columns_named_like_helpers_are_kept(spark, documents):
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(12 if i % 2 else 3))) for i in range(6)]
    docs = documents(rows)
    for name in ("__w", "__q", "__kept", "__cut_symbols", "column_0"):
        docs = docs.withColumn(name, quality.F.col("doc_id") * 2)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["__w"], r["__q"], r["__kept"], r.column_0) for r in kept.collect()) == [(i, *[2 * i] * 4) for i in (1, 3, 5)]
