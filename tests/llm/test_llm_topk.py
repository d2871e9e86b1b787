"""Exact top-k search against comparing everything."""

import math
import random

import duckdb
import numpy as np
import pytest

from shelfwise.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label string, cell string, bound string"


def plain(rows, k, step=topk.QUERY_STEP):
    kept = set()
    for vec_id, vector in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.add((vec_id, tuple(math.floor(1024 * float(np.float32(x))) for x in vector)))
    out = []
    for own, query in kept:
        if own is None or own % step:
            continue
        scores = [(sum(a * b for a, b in zip(query, v)), i) for i, v in kept if i != own]
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(own, rank, i, score) for rank, (score, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def found(frame):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in frame.collect()), key=repr)


def searched(spark, rows, k=topk.K):
    table = spark.createDataFrame([(i, v, "x", "c", "b") for i, v in rows], SCHEMA).repartition(4)
    vectors = topk.quantised(table)
    return found(topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in centres[i % 6]]) for i in range(1500)]
    rows += [(i, [0.5] * 8) for i in range(2000, 2600)]  # one vector in very many rows
    rows += [(i, [round(x) / 2 for x in centres[i % 6]]) for i in range(3000, 3100)]  # ties
    rows += [(4000, None), (4100, []), (4200, [1.0, None]), (4300, [float("nan")] * 8), (4400, [float("inf")] * 8)]
    rows += [(None, [1.0] * 8), (None, [0.5] * 8), (-100, [-1.0] * 8), (4500, [1.0, 2.0]), (4600, [0.0] * 8)]
    return rows + rows[:20]


def test_equals_comparing_everything(spark, rows):
    assert searched(spark, rows) == plain(rows, 10)


def test_many_cells_and_shards(spark, rows, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "LEAF", 4)
    assert searched(spark, rows, 3) == plain(rows, 3)


def test_fewer_rows_than_ranks_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (100, [0.0, 1.0])]
    assert searched(spark, rows) == plain(rows, 10)
    assert searched(spark, [(0, [1.0])]) == []
    assert searched(spark, []) == []


def test_numbers_beyond_doubles(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**19 for _ in range(8)]) for i in range(150)]
    assert searched(spark, rows) == plain(rows, 10)


def test_scores_that_no_long_holds_become_the_nearest():
    big = np.array([[2**40, 2**40], [-(2**40), 0]], dtype=np.int64)
    assert topk._products(big, big[0]).tolist() == [topk.LONG.max, topk.LONG.min]


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.integers(-20, 20, (3000, 4)), rng.integers(900, 1000, (50, 4))])
    tree = topk.BallTree(vectors, [[i] for i in range(len(vectors))])
    query = np.array([1000, 900, 950, 990])
    scores = sorted(((int(v @ query), -i) for i, v in enumerate(vectors)), reverse=True)[:10]
    assert tree.search(query, -1, 10, topk.LONG.min) == [(score, -i) for score, i in scores]
    assert tree.search(query, -1, 10, scores[4][0]) == [(score, -i) for score, i in scores if score >= scores[4][0]]


def test_query_equals_its_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    expected = connection.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.OP13_SQL})").fetchall()
    assert found(topk.op13_exact_top_k(spark, sf_dir)) == sorted(expected, key=repr)
