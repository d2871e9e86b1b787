"""Poisson replication against SciPy-free inversion in Python, and its SQL."""

import hashlib
import math
from collections import Counter

import duckdb
import pytest

from shelfwise.llm import mixing


def plain_copies(rows, weights=None, power=mixing.POWER, epochs=1.0):
    """Counter of (doc_id, text, source, copy)."""
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(text or "") + 1
    given = {s: n**power if weights is None else (weights.get(s, 0) if s is not None else 0) for s, n in sizes.items()}
    out = Counter()
    for doc_id, text, _, source in rows:
        total = sum(given.values())
        rate = given[source] / total * epochs * sum(sizes.values()) / sizes[source] if total else 0
        draws = max(1, math.ceil(rate / mixing.LARGEST_MEAN))
        identity = hashlib.md5((text or "").encode()).hexdigest() if doc_id is None else str(doc_id)
        times = 0
        for draw in range(1, draws + 1):
            u = int(hashlib.md5(f"{mixing.SEED}:{identity}:{draw}".encode()).hexdigest()[:13], 16) / 16**13
            mean = rate / draws
            p, k = math.exp(-mean), 0
            all_p = p
            while all_p <= u:
                k += 1
                p *= mean / k
                all_p += p
            times += k
        out.update((doc_id, text, source, c) for c in range(1, times + 1))
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, "text " * (i % 9), "en", ["web", "books", "code"][i % 3 if i > 50 else 0]) for i in range(150)]
    return [*out, (None, "no id", "en", "web"), (None, None, "en", None), (7, "again", "en", "books"), (7, "again", "en", "books")]


@pytest.mark.parametrize(
    "options",
    [{}, {"weights": {"web": 1, "books": 8}}, {"weights": {}}, {"epochs": 3.0}, {"weights": {"code": 1}, "epochs": 300.0}],
)
def test_copies(documents, rows, options):
    df = documents(rows)
    mixed = mixing.mix(df, **options)
    assert Counter((r.doc_id, r.text, r.source, r.copy) for r in mixed.collect()) == plain_copies(rows, **options)
    assert [c for c in mixed.columns if c not in ("copy", "shuffle_key")] == [c for c in df.columns if c != "copy"]


def test_query_is_its_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = db.execute(f"SELECT doc_id, copy, shuffle_key FROM ({mixing.OP7_SQL})").fetchall()
    found = [(r.doc_id, r.copy, r.shuffle_key) for r in mixing.op7_source_mixing(spark, sf_dir).collect()]
    assert sorted(found) == sorted(expected)


def test_partitions_are_in_order_of_the_shuffle_key(documents, rows):
    keys = mixing.mix(documents(rows)).select("shuffle_key").rdd.mapPartitions(lambda p: [[r[0] for r in p]]).collect()
    assert all(k == sorted(k) for k in keys)


def test_no_python_on_the_way(documents, rows):
    plan = mixing.mix(documents(rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_empty_table(documents):
    assert mixing.mix(documents([])).count() == 0
