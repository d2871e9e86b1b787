"""Source divergence against a plain count of whole texts."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(divergence.UPPER, divergence.LOWER)


def plain(rows, least, top):
    """rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in row) for row in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = Counter(term.translate(LOWER) for term in TERM.findall(text))
        docs[lang].update(found.keys())
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []

    def ranked(lang, source, part, values, most):
        values.sort(key=lambda x: (-x[1], x[0].encode()))
        out.extend((lang, source, part, item, value, rank) for rank, (item, value) in enumerate(values[:most], 1))

    for lang, sources in groups.items():
        kept = [term for term, n in docs[lang].items() if n >= least]

        def shares(count):
            total = sum(count[term] for term in kept) + 2 * len(kept)
            return {term: 1 + 1_000_000_000 * (count[term] + 2) // total for term in kept}

        p = {source: shares(counts[lang, source]) for source in sources}
        q = shares(sum((counts[lang, source] for source in sources), Counter()))
        for a in sources:
            pairs = [(b, sum((p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t]) for t in kept)) for b in sources - {a}]
            ranked(lang, a, "pair", pairs, None)
            used = [t for t in kept if counts[lang, a][t] > 0 and p[a][t] > q[t]]
            ranked(lang, a, "term", [(t, (p[a][t] - q[t]) ** 2 // (p[a][t] + q[t])) for t in used], top)
    return sorted(out)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def found(frame):
    return sorted(tuple(row[c] for c in COLUMNS) for row in frame.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["The", "the", "the,", "THE-the", "Ünd", "ünd", "a b", "x1y", "é.", "42", "don't", "\x1cgap", "𝒳z", "𝒳Z"]
    rows = []
    for _ in range(400):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["web", "web", "web", "news", "", None, "x y"])
        own = words if source == "web" else words[3:]
        breaks = [" ", "\n", "\t ", "\r\n", "\x0b", "\f"]
        rows.append(("".join(rng.choice(own) + rng.choice(breaks) for _ in range(rng.randrange(30))), lang, source))
    rows += [("Only rare words", "fr", "one"), (None, "fr", "two"), ("", "it", "alone")]
    rows.append((" ".join(f"w{i}" for i in range(20_000)) + "-".join(["long"] * 3000), "en", "long"))
    rows += [("same same text", "en", "copies")] * 30
    return rows


def test_equals_the_plain_count(spark, rows, documents):
    table = documents([(i % 50, *row) for i, row in enumerate(rows)]).repartition(5)
    assert found(divergence.source_divergence(table)) == plain(rows, 10, 10)


def test_small_blocks_many_parts_and_shuffled_groups(spark, rows, documents, monkeypatch):
    for name, value in (("DOC_BITS", 3), ("BLOCK_BYTES", 200), ("ROWS", 5), ("CELLS", 8), ("SENT_GROUPS", 0), ("NEAR", 33)):
        monkeypatch.setattr(divergence, name, value)
    table = documents([(i, *row) for i, row in enumerate(rows)], clashing=False).repartition(6)
    assert found(divergence.source_divergence(table, least_docs=3, top=4)) == plain(rows, 3, 4)


def test_empty_table(documents):
    assert divergence.source_divergence(documents([])).count() == 0


def test_postings_round_trip():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 300 * 5000, 4000))
    row, doc = keys // 5000, keys % 5000
    rows, row = np.unique(row, return_inverse=True)
    group = doc // 400 * 10**6
    n = np.where(row % 3 == 0, 1, rng.integers(1, 10**6, len(doc)))
    payload = divergence._postings(row, group, doc, n, len(rows))
    for sliced in (payload, pa.concat_arrays([payload[:7], payload])[7:]):
        back = divergence._entries(sliced)
        assert all((x == y).all() for x, y in zip(back, (row, group, doc, n), strict=True))


def test_shares_beyond_doubles(spark):
    n = 10**16 + 1
    row = spark.range(1).select(divergence._share(divergence.F.lit(n), divergence.F.lit(3 * n), divergence.F.lit(5)).alias("p"))
    assert row.first().p == 1 + 1_000_000_000 * (n + 2) // (3 * n + 10)


def test_query_equals_its_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = connection.execute(f"SELECT {', '.join(COLUMNS)} FROM ({divergence.OP12_SQL})").fetchall()
    assert found(divergence.op12_source_divergence(spark, sf_dir)) == sorted(expected)
