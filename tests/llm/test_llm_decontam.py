"""Benchmark decontamination against plain greedy string tiling."""

import random
import re
import time

import numpy as np
import pytest
from plain_texts import sentence

from shelfwise.llm import decontam


def plain_tiles(text, item, least):
    """The longest common run of unmarked words, again and again."""
    a, b, out = set(), set(), []
    while True:
        best = None
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while (
                    i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n]
                    and i + n not in a and j + n not in b
                ):
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        a.update(range(i, i + n))
        b.update(range(j, j + n))
        out.append(best)


def test_tiling_of_repeated_words_takes_linear_memory():
    one = np.full(40_000, 7, np.uint64)
    assert decontam.tile(one, one[:20_000], 5) == [(0, 0, 20_000)]
    text, item = np.tile(np.array([1, 2], np.uint64), 20_000), np.tile(np.array([2, 1, 3], np.uint64), 7_000)
    began = time.process_time()
    assert sum(n for _, _, n in decontam.tile(text, item, 2)) == 14_000
    assert time.process_time() - began < 20


def words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def plain_leaks(docs, items):
    out = set()
    for doc_id, text in docs:
        best = {}
        for item_id, question in items:
            own = words(question)
            if own:
                tiles = plain_tiles(words(text), own, min(len(own), decontam.MIN_TILE))
                covered = sum(n for _, _, n in tiles)
                if covered >= decontam.COVERAGE * len(own):
                    best[item_id] = max(best.get(item_id, (0, 0, 0)), (covered / len(own), len(tiles), covered))
        out |= {(doc_id, item_id, *found) for item_id, found in best.items()}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_tiles_are_those_of_plain_tiling(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        text, item = (rng.integers(1, 4, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        assert decontam.tile(text, item, 3) == plain_tiles(text.tolist(), item.tolist(), 3)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    items = [(i, sentence(rng, 30)) for i in range(12)] + [(50, "Which way, then?"), (51, None), (52, ""), (53, "…?")]
    docs = [(i, sentence(rng, 60)) for i in range(10)]
    for i, (_, text) in enumerate(items[:12]):
        own = text.split()
        halves = own[18:] + ["between"] + own[:18]  # reordered
        partly = own[: 8 + i]  # 8 to 19 of 30 words
        docs.append((100 + i, sentence(rng, 20) + " " + " ".join(halves).upper() + ". " + sentence(rng, 20)))
        docs.append((200 + i, sentence(rng, 20) + " " + ", ".join(partly)))
    docs += [(300, None), (301, ""), (302, "so: WHICH way then"), (None, items[0][1]), (303, items[3][1]), (303, items[3][1])]
    docs += [(304, sentence(rng, 1500) + " " + items[5][1] + " " + sentence(rng, 500))]
    return docs, items + [items[2]]


def test_query_finds_what_plain_tiling_finds(spark, documents, case):
    docs, items = case
    benchmark = spark.createDataFrame([(i, q, "x") for i, q in items], "item_id long, text string, seed string")
    found = [tuple(r) for r in decontam.contaminated(documents(docs), benchmark).collect()]
    expected = plain_leaks(docs, items)
    assert {(d, i, round(c, 9), t, n) for d, i, c, t, n in found} == {(d, i, round(c, 9), t, n) for d, i, c, t, n in expected}
    assert sum(d == 303 for d, *_ in found) == 2  # a repeated row gives its own rows
    leaked = {d for d, *_ in expected}
    assert {100, 111, 302, 304, None} <= leaked and not leaked & {*range(10), 200, 300, 301}


def test_filter_keeps_all_columns_of_clean_documents(spark, documents, case):
    docs, items = case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = documents(docs)
    kept = decontam.decontaminate(df, benchmark)
    leaked = {d for d, *_ in plain_leaks(docs, items)}
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in leaked)


def test_empty_tables(spark, documents):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(documents([(1, "a b c d e f")]), nothing).count() == 0
    assert decontam.decontaminate(documents([(1, "a b c d e f")]), nothing).count() == 1
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.contaminated(documents([]), some).count() == 0
