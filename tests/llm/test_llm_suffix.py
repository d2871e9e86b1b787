"""Repeated 100-byte strings against a set of all strings so far."""

import hashlib
import random

import numpy as np
import pytest
from plain_texts import sentence

from shelfwise.llm import suffix


def plain_removal(rows):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            window = raw[p : p + 100]
            if window in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(raw)))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df, **options):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return [tuple(r[c] for c in columns) for r in suffix.remove_repeats(df, **options).collect()]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    passage = sentence(rng, 60)
    out = []
    for i in range(40):
        low = rng.randrange(0, 150)
        out.append((i, sentence(rng, 20) + passage[low : low + rng.randrange(60, 200)] + sentence(rng, 20)))
    out += [(50, "a" * 350), (51, "a" * 120), (52, "ab" * 200), (53, "é" * 80 + "a" * 99), (54, None), (55, "")]
    out += [(56, passage), (57, passage), (58, passage[1:101]), (59, passage[1:100]), (None, passage[2:])]
    out += [(60, sentence(rng, 4000)), (61, out[-1][1] + passage)]
    return out


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_all_batches_and_levels_give_the_plain_result(documents, rows, batches):
    assert sorted(found(documents(rows), batches=batches), key=repr) == sorted(plain_removal(rows), key=repr)


def test_query(spark, sf_dir, tables):
    rows = tables("SELECT doc_id, text FROM '{dir}/documents.parquet'")
    result = suffix.op4_suffix_dedup(spark, sf_dir).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in result) == sorted(plain_removal(rows))


def test_different_texts_around_one_phrase_lose_nothing(spark):
    """All windows share an anchor and nothing else: equality of many contexts must not rest on few bits."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    phrases = ["".join(rng.choices(letters, k=suffix.GRAM)) for _ in range(4000)]
    data = [np.frombuffer(x.encode(), np.uint8) for x in phrases]
    smallest = min(range(len(data)), key=lambda i: int(suffix.rolling.Prefix(data[i]).windows(np.array([0]), np.array([suffix.GRAM]))[0]))
    around = suffix.LENGTH - suffix.GRAM
    rows = [(i, "".join(rng.choices(letters, k=around // 2)) + phrases[smallest] + "".join(rng.choices(letters, k=around // 2))) for i in range(150_000)]
    result = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result.where("n_removed > 0").count() == 0


def test_texts_of_one_doc_id_are_told_apart(documents):
    rng = random.Random(6)
    rows = [(i // 300, sentence(rng, 25)) for i in range(900)]
    assert sorted(found(documents(rows))) == sorted((i, len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)


def test_repeated_rows_are_one_document_and_an_empty_table_gives_none(documents):
    text = sentence(random.Random(1), 80)
    one = plain_removal([(1, text)])
    assert found(documents([(1, text), (1, text)])) == one * 2
    assert found(documents([])) == []
