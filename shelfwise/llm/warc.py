"""Writes pages as WARC records, in segments where they are long, and reads archives back."""

from __future__ import annotations

from base64 import b32encode
from collections.abc import Iterator
from hashlib import md5, sha1
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.runtime import staged, work_dir

VERSION = b"WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
# Records are cut where the next one starts. This text holds no beginning of itself, so a reader finds it also where
# one of its buffers ends inside (with RECORD_END in front it would not).
SEPARATOR = "WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192

RECORD = (
    "record_id string, type string, uri string, refers_to string, digest string, segment int, "
    "origin string, total long, block binary"
)


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing. A chunk also ends inside every record start that the payload holds, so that the
    framed bytes never look like the border of two records."""
    out, at = [], 0
    while at < len(payload):
        end = min(len(payload), at + size)
        found = payload.find(VERSION, at, end + len(VERSION))
        if 0 <= found < end:
            end = found + 4
        out.append(b"%x\r\n%s\r\n" % (end - at, payload[at:end]))
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload; None where the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            return None
        if not size:
            return b"".join(out)
        if body[line + 2 + size : line + 4 + size] != b"\r\n":
            return None
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def base32_sha1(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return VERSION + lines.encode() + b"\r\n" + block


def _page_record(page_id: object, row: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def records(row: dict, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of a page: a revisit, a response, or a response and its continuations."""
    identity = _page_record(row["page_id"], row["row"])
    uri = quote(row["url"] or "", safe="%/:=&?~#+!$,;'@()*[]")
    common = [
        ("WARC-Record-ID", identity),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + b32encode(bytes.fromhex(row["digest"])).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if row["payload"] is None:
        refers = ("WARC-Refers-To", _page_record(row["first_id"], row["first_row"]))
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record([("WARC-Type", "revisit"), *common, refers, profile], HTTP)
        return
    block = HTTP + chunked(row["payload"], chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    parts = range(0, len(block), segment_bytes)
    for number, low in enumerate(parts, 1):
        part = block[low : low + segment_bytes]
        total = [("WARC-Segment-Total-Length", len(block))] if number == len(parts) else []
        if number == 1:
            yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], part)
        else:
            own = md5(f"{identity}{number}".encode()).hexdigest()
            yield _record(
                [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:part:{own}>"), ("WARC-Date", DATE),
                 ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", identity), ("WARC-Segment-Number", number), *total],
                part,
            )


def _to_records(segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                rows = batch.slice(low, 200).to_pylist()
                made = [r for row in rows for r in records(row, segment_bytes, chunk_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    return run


def _row_of(digest: str, url: str, copy: Column) -> Column:
    """What tells the records of a page_id apart."""
    return F.concat_ws("-", F.md5(F.concat_ws(":", digest, F.coalesce(F.col(url), F.lit("-")))), copy.cast("string"))


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """A row per page to write: (page_id, url, digest, payload, row, first_id, first_row).

    Of the rows with an equal payload of at least `least` bytes one has it: that of the smallest (page_id, url), nulls
    last, one of them where the row is repeated. The others have a null payload and name it. Shorter rows
    all have their payload. Whole payloads go through one shuffle, after each task has kept one per digest; the rest are
    short rows, so a payload or a row that fills a third of the table is no hot spot.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = F.length("payload") >= least
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    responses = (
        rows.where(long)
        .groupBy("digest")
        .agg(F.min_by(F.struct("page_id", "url", "payload"), order).alias("first"))
        .select("first.page_id", "first.url", "digest", "first.payload", F.lit(0).alias("copy"))
    )
    firsts = (
        rows.where(long)
        .groupBy("digest")
        .agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(
            "digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"),
            _row_of("digest", "first.url", F.lit(0)).alias("first_row"),
        )
    )
    counted = rows.where(long).groupBy("page_id", "url", "digest").agg(F.count("*").cast("int").alias("copies"))
    chosen = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    revisits = counted.join(firsts, "digest").select(
        "page_id", "url", "digest", "first_id", "first_row",
        F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), chosen.alias("chosen"),
    ).where("copy > 0 or not chosen").drop("chosen")
    short = rows.where(~long).groupBy("page_id", "url", "digest").agg(
        F.count("*").cast("int").alias("copies"), F.first("payload").alias("payload")
    )
    short = short.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    both = responses.unionByName(short) if least > 0 else responses
    return (
        both.unionByName(revisits, allowMissingColumns=True)
        .withColumn("row", _row_of("digest", "url", F.col("copy")))
        .select("page_id", "url", "digest", "payload", "row", "first_id", "first_row")
    )


def write(
    pages: DataFrame, path: str, least: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES
) -> None:
    """Write `pages` (page_id, url, html) as gzip files of WARC records, one for each partition of payloads."""
    made = with_first(pages, least).mapInArrow(_to_records(segment_bytes, chunk_bytes), "record binary")
    lines = made.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 200):
            out = []
            for raw in batch.column("value").slice(low, 200).to_pylist():
                head, _, rest = raw.removeprefix(VERSION).partition(b"\r\n\r\n")
                h = {}
                for line in head.decode("utf-8", "replace").split("\r\n"):
                    name, _, value = line.partition(":")
                    h[name.strip().lower()] = value.strip()
                number = lambda k: int(h[k]) if h.get(k, "").isdigit() else None
                block = rest[: number("content-length") or 0]
                if len(block) < (number("content-length") or 0):
                    block = None  # cut off: its length does not hold
                out.append(
                    {
                        "record_id": h.get("warc-record-id"),
                        "type": h.get("warc-type"),
                        "uri": h.get("warc-target-uri"),
                        "refers_to": h.get("warc-refers-to"),
                        "digest": h.get("warc-payload-digest"),
                        "segment": number("warc-segment-number"),
                        "origin": h.get("warc-segment-origin-id") or h.get("warc-record-id"),
                        "total": number("warc-segment-total-length"),
                        "block": block,
                    }
                )
            kinds = {"segment": pa.int32(), "total": pa.int64(), "block": pa.binary()}
            names = [c.split()[0] for c in RECORD.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in out], kinds.get(n, pa.string())) for n in names], names
            )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 200):
            part = batch.slice(low, 200)
            payloads, good = [], []
            for blocks, total, digest, kind in zip(
                *(part.column(c).to_pylist() for c in ("blocks", "total", "digest", "type")), strict=True
            ):
                whole = None if None in blocks else b"".join(blocks)
                payload = None
                if whole is not None and (total is None or total == len(whole)):
                    head, _, body = whole.partition(b"\r\n\r\n")
                    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() and kind != "revisit" else body
                payloads.append(payload)
                good.append(payload is not None and (kind == "revisit" or digest == "sha1:" + base32_sha1(payload)))
            names = [n for n in part.schema.names if n not in ("blocks", "total")]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in names), pa.array(payloads, pa.binary()), pa.array(good)],
                [*names, "payload", "intact"],
            )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Logical records of the archives at path: record_id, type, uri, refers_to, digest, payload, intact.

    Records are cut at record borders by the reader, so a file is never held whole; plain files are also read
    in parallel. Segments are grouped by the record that they continue and put in order of their numbers; a
    record is whole if numbers run from 1 and lengths add up to the stated total. Records that are cut off,
    incomplete, badly framed or of another digest come with intact = false. Repeated segments count once.
    """
    raw = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("value"))
    parsed = raw.where(F.length("value") > 4).mapInArrow(_parse, RECORD)
    fields = ("record_id", "type", "uri", "refers_to", "digest")
    single = parsed.where("segment is null").select(*fields, F.array("block").alias("blocks"), "total")
    head = F.struct(*fields)
    joined = (
        parsed.where("segment is not null")
        .groupBy("origin")
        .agg(
            F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"),
            F.max(F.when(F.col("segment") == 1, head)).alias("head"),
            F.max("total").alias("total"),
        )
    )
    in_order = F.transform("parts", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    segmented = joined.select(
        F.coalesce("head.record_id", "origin").alias("record_id"),
        F.coalesce("head.type", F.lit("response")).alias("type"),
        *[F.col(f"head.{c}").alias(c) for c in fields[2:]],
        F.when(in_order, F.transform("parts", lambda x: x["block"]))
        .otherwise(F.array(F.lit(None).cast("binary")))
        .alias("blocks"),
        F.coalesce("total", F.lit(-1)).alias("total"),  # the last segment must state it
    )
    return single.union(segmented).mapInArrow(
        _decode,
        "record_id string, type string, uri string, refers_to string, digest string, payload binary, intact boolean",
    )


def page_of(record_id: str) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:([^:]*):", 1)


def round_trip(pages: DataFrame, path: str, least: int = 0, **sizes) -> DataFrame:
    """Write `pages` (page_id, url, html) to path, read the archives, and give a row per page:
    page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Null html is an empty payload; urls are written percent-encoded, a null one as empty. Null page_ids come last
    in the choice of the response and come back as null. A repeated row has a record of its own, a revisit. An
    empty table gives no rows.
    """
    write(pages, path, least, **sizes)
    # The archives are read once; what is kept of a record is short.
    found = staged(
        read(pages.sparkSession, path).select(
            "record_id", "type", "refers_to", "digest", "intact", F.length("payload").cast("long").alias("bytes")
        ),
        "records",
    )
    id_type = pages.schema["page_id"].dataType
    full = found.where("type = 'response'").select(
        F.col("record_id").alias("full_id"), F.col("bytes").alias("full_bytes"), F.col("intact").alias("full_intact")
    )
    revisit = F.col("type") == "revisit"
    joined = found.join(full, found["refers_to"] == full["full_id"], "left")
    return joined.select(
        F.nullif(page_of("record_id"), F.lit("")).cast(id_type).alias("page_id"),
        F.when(revisit, F.col("full_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, F.nullif(page_of("refers_to"), F.lit("")).cast(id_type)).alias("refers_to"),
        (F.col("intact") & F.when(revisit, F.coalesce("full_intact", F.lit(False))).otherwise(True)).alias("intact"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of `pages` through archives in a work folder."""
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), work_dir(spark, "warc"))


OP9_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload,
    lpad(sha1(coalesce(html, '')), 40, '0') AS hex
  FROM pages
), digests AS (
  SELECT *, list_reduce(
      [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8)) & 31)::INTEGER + 1, 1)
       FOR i IN range(32)], lambda a, b: a || b) AS digest
  FROM payloads
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, true AS intact
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM digests)
"""
