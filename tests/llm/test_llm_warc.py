"""Archives: exact round trips, segments, chunked framing, and damage."""

import base64
import gzip
import hashlib
from pathlib import Path

import duckdb
import pytest

from shelfwise.llm import warc

PAGES = [
    (5, "http://a/x y", "same"), (3, "http://b/", "same"), (9, None, "same"), (None, "http://c/", "same"),
    (1, "http://d/", None), (2, "http://d/", ""), (4, "http://e/é", "é😀\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 30),
    (6, "http://f/", "long " * 50_000), (7, "http://f/", "0\r\n\r\n"), (7, "http://f/", "0\r\n\r\n"), (8, "http://g/", "\n"), (None, None, "no id"), (None, "http://c/", "no id"),
]


def plain(pages, least):
    """One response per payload of enough bytes: the smallest page_id; every other row, repeated ones too, revisits it."""
    out, first = [], {}
    for page_id, _, text in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        payload = (text or "").encode()
        revisit = len(payload) >= least and payload in first
        first.setdefault(payload, page_id)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page_id, len(payload), digest, "revisit" if revisit else "response", first[payload] if revisit else None, True))
    return out


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, row int")


def result(df):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=repr)


@pytest.mark.parametrize("least", [0, 3])
@pytest.mark.parametrize("sizes", [{}, {"segment_bytes": 100, "chunk_bytes": 7}, {"segment_bytes": 997, "chunk_bytes": 64}])
def test_round_trip(pages, tmp_path, least, sizes):
    assert result(warc.round_trip(pages(PAGES), str(tmp_path / "w"), least, **sizes)) == sorted(plain(PAGES, least), key=repr)


def test_payloads_come_back_whole(spark, pages, tmp_path):
    warc.write(pages(PAGES), str(tmp_path / "w"), segment_bytes=200, chunk_bytes=50)
    full = [bytes(r.payload) for r in warc.read(spark, str(tmp_path / "w")).where("type = 'response'").collect()]
    assert sorted(full) == sorted({(t or "").encode() for _, _, t in PAGES})


def test_missing_segment_and_cut_archive_are_not_intact(spark, pages, tmp_path):
    warc.write(pages([(1, "u", "abc" * 500), (2, "v", "short")]), str(tmp_path / "w"), segment_bytes=300)
    text = b"".join(gzip.open(f).read() for f in sorted(Path(tmp_path / "w").glob("*.gz")))
    records = text.split(b"WARC/1.1\r\n")
    number = next(i for i, r in enumerate(records) if b"WARC-Segment-Number: 3" in r)
    for name, left in (("gone", records[:number] + records[number + 1 :]), ("cut", [r[:-44] if i == number else r for i, r in enumerate(records)])):
        Path(tmp_path / name).mkdir()
        Path(tmp_path / name / "a.warc").write_bytes(b"WARC/1.1\r\n".join(left))
        rows = {r.record_id.split(":")[2]: r.intact for r in warc.read(spark, str(tmp_path / name)).collect()}
        assert rows == {"1": False, "2": True}
    Path(tmp_path / "twice").mkdir()
    for copy in "ab":  # every segment twice
        Path(tmp_path / "twice" / f"{copy}.warc").write_bytes(text)
    assert all(r.intact for r in warc.read(spark, str(tmp_path / "twice")).where("record_id like '%page:1:%'").collect())


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_chunked_framing(size):
    for payload in (b"", b"a", b"0\r\n\r\n" * 9, b"\r\n\r\nWARC/1.1\r\n" * 5):
        framed = warc.chunked(payload, size)
        assert warc.unchunked(framed) == payload
        assert warc.SEPARATOR.encode() not in framed
        assert warc.unchunked(framed[:-3]) is None


def test_query_is_its_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    columns = "page_id, payload_bytes, payload_digest, record_type, refers_to, intact"
    expected = db.execute(f"SELECT {columns} FROM ({warc.OP9_SQL})").fetchall()
    assert result(warc.op9_warc(spark, sf_dir)) == sorted(expected, key=repr)


def test_very_many_small_pages_all_come_back(spark, tmp_path):
    """Record borders fall at every place of the reader's buffers."""
    n = 200_000
    many = spark.range(n, numPartitions=2).selectExpr("id AS page_id", "concat('u', id) AS url", "concat('page ', id) AS html")
    back = warc.round_trip(many, str(tmp_path / "w")).selectExpr("count(*)", "count(DISTINCT page_id)", "count_if(intact)")
    assert tuple(back.first()) == (n, n, n)


def test_a_payload_that_half_the_rows_share(pages, tmp_path):
    rows = [(i, f"http://h/{i % 3}", "common") for i in range(500)] + [(i, "u", "common") for i in [7] * 300]
    assert result(warc.round_trip(pages(rows).repartition(20), str(tmp_path / "w"))) == sorted(plain(rows, 0), key=repr)


def test_empty_table(pages, tmp_path):
    assert warc.round_trip(pages([]), str(tmp_path / "w")).count() == 0
