"""Language model scores: counts and base against plain counting, the model by held-out texts."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from shelfwise.llm import lm


def plain_scores(rows):
    """{doc_id: (held_out, tokens, known, train tokens, base score)}."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    counts = collections.Counter(w for own, h in zip(words, held, strict=True) if not h for w in own)
    total, distinct = sum(counts.values()), len(counts)
    return [
        (d, h, len(own), sum(counts[w] > 0 for w in own), total,
         round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), 6))
        for (d, _), own, h in zip(rows, words, held, strict=True)
    ]


def found_scores(df):
    return [
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
        for r in lm.score_texts(df).collect()
    ]


def test_query_counts(spark, sf_dir, tables):
    found = lm.op3_lm_scoring(spark, sf_dir).collect()
    rows = tables("SELECT doc_id, text FROM '{dir}/documents.parquet'")
    own = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert sorted(own) == sorted(plain_scores(rows))


def test_model_beats_the_base_on_held_out_texts(spark):
    """From about 300,000 training tokens on; with fewer the model falls a little short of the base."""
    held = [r for r in lm.op3_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_scores_do_not_depend_on_partitions_and_beat_the_base(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(partitions)
    held = [r for r in lm.score_texts(docs).collect() if r.held_out]
    mean = sum(r.score for r in held) / sum(r.n_tokens for r in held)
    assert mean > sum(r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert SEEN.setdefault("mean", mean) == pytest.approx(mean, rel=1e-6)


SEEN = {}


def test_nulls_repeats_and_unknown_words(documents):
    rows = [(1, "A b  a\tB"), (1, "A b  a\tB"), (2, None), (3, ""), (None, "é B"), (5, "x" * 5000 + " a")]
    rows += [(i, "never seen") for i in range(6, 40) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sorted(found_scores(documents(rows)), key=repr) == sorted(plain_scores(rows), key=repr)


def test_only_held_out_texts_and_empty_table(documents):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, "some words") for i in ids]
    assert sorted(found_scores(documents(rows))) == sorted(plain_scores(rows))
    assert lm.score_texts(documents([])).count() == 0


def test_probabilities_sum_to_one():
    shares = np.full(lm.CLASSES, 1 / lm.CLASSES)
    model = lm.Model.fresh(shares)
    contexts = np.random.default_rng(0).integers(0, lm.CLASSES + 1, (3, lm.CONTEXT))
    for context in contexts:
        every = model.log_probabilities(np.repeat(context[None], lm.CLASSES, 0), np.arange(lm.CLASSES))
        assert np.exp(every).sum() == pytest.approx(1, abs=1e-5)


def test_training_learns_what_follows_what():
    shares = np.full(lm.CLASSES, 1e-6)
    shares[1:4] = 1 / 3
    shares /= shares.sum()
    trainer = lm.Trainer(lm.Model.fresh(shares), shares, 1)
    targets = np.tile([1, 2, 3], 4000)
    contexts = np.stack([np.roll(targets, k) for k in range(1, lm.CONTEXT + 1)], axis=1)
    before = trainer.model.log_probabilities(contexts, targets).mean()
    for i in range(0, len(targets), 400):
        trainer.learn(contexts[i : i + 400], targets[i : i + 400])
    assert trainer.model.log_probabilities(contexts, targets).mean() > before + 0.3


@pytest.mark.parametrize("frequent", [1, 40])
def test_counts_of_rare_words_come_back_by_a_join(documents, monkeypatch, frequent):
    """With hardly a frequent word, texts ask for nearly all counts; scores are those with all words known."""
    rows = [(i % 50, f"the A{i % 7} b{i} b{i} the\tc{i // 3} end{i % 400}") for i in range(600)] + [(3, None), (None, "the zz")]
    whole = sorted((repr(r[:-1]), r.score) for r in lm.score_texts(documents(rows)).select(*NAMES, "score").collect())
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    df = documents(rows)
    assert sorted(found_scores(df), key=repr) == sorted(plain_scores(rows), key=repr)
    asking = sorted((repr(r[:-1]), r.score) for r in lm.score_texts(df).select(*NAMES, "score").collect())
    assert [k for k, _ in asking] == [k for k, _ in whole]
    assert [x for _, x in asking] == pytest.approx([x for _, x in whole], abs=1e-6)


NAMES = ("doc_id", "held_out", "n_tokens", "n_known")


def test_large_scores_neither_overflow_nor_vanish():
    shares = np.full(lm.CLASSES, 1 / lm.CLASSES)
    model = lm.Model.fresh(shares)
    contexts = np.random.default_rng(0).integers(0, lm.CLASSES + 1, (700, lm.CONTEXT))
    targets = np.arange(700) % lm.CLASSES
    for scale in (1, 3000):
        model.output = model.output * np.float32(scale)
        score = (model.predicted(contexts) @ model.output.T + model.bias).astype(np.float64)
        top = score.max(axis=1, keepdims=True)
        every = score - top - np.log(np.exp(score - top).sum(axis=1, keepdims=True))
        assert model.log_probabilities(contexts, targets) == pytest.approx(every[np.arange(700), targets], rel=1e-4, abs=1e-4)


def test_texts_are_scored_where_they_are_read(spark, sf_dir):
    """Disk: no shuffle carries texts or a row per word and block."""
    plan = lm.op3_lm_scoring(spark, sf_dir)._jdf.queryExecution().toString()
    assert "text" not in plan.split("== Physical Plan ==")[1] and "FlatMapCoGroups" not in plan
