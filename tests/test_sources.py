"""Landed files, rejected rows, artefact catalogue, and the shared work folder."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfwise import runtime
from shelfwise.operators import details, jobs
from shelfwise.plans import derived
from shelfwise.schemas import PRODUCT_COLUMNS
from shelfwise.sources import landing, sinks


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_landed_pages_through_the_reader(spark, sf_dir, tmp_path, fmt):
    pages = derived.listing_pages(spark, sf_dir)
    pages.write.format(fmt).save(str(tmp_path / "pages"))
    back = landing.scan_pages(spark, str(tmp_path / "pages"), fmt)
    assert back.columns == ["keyword", "page_no", "html"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pages.collect()))


def test_envelopes_are_pages_or_rejected_with_a_reason(spark):
    bodies = {
        1: json.dumps({"results": [{"content": "<p>x</p>"}, {"content": "y"}]}),
        2: json.dumps({"results": []}), 3: "{}", 4: json.dumps({"results": [{"content": None}]}),
        5: '{"results": [', 6: "<html>", 7: "", 8: None, 9: json.dumps({"results": [{"content": ""}]}),
    }
    fetched = spark.createDataFrame(list(bodies.items()), "id int, body string")
    assert {r.id: r.html for r in landing.decode_envelopes(fetched).collect()} == {1: "<p>x</p>", 9: ""}
    rejected = landing.rejected_envelopes(fetched)
    reasons = {r.id: r.reason for r in rejected.collect()}
    assert {i for i, r in reasons.items() if r == landing.NO_RESULTS} == {2, 3, 4}
    assert {i for i, r in reasons.items() if r == landing.UNREADABLE} == {5, 6, 7, 8}
    assert {r.reason: r.rows for r in landing.rejected_counts(rejected).collect()} == {landing.NO_RESULTS: 3, landing.UNREADABLE: 4}
    assert next(r.raw for r in rejected.collect() if r.id == 5) == bodies[5]


def test_dead_letter_lines_that_are_no_entry_are_listed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"job_id": "1", "keyword": "k"}\n{"keyword": "no id"}\n\nnot json\n{"job_id": "2"\n')
    path = str(tmp_path)
    assert [r.job_id for r in landing.read_dead_letters(spark, path).collect()] == ["1"]
    rejected = sorted((r.line, r.reason) for r in landing.rejected_dead_letters(spark, path).collect())
    assert rejected == [
        ("not json", landing.UNREADABLE), ('{"job_id": "2"', landing.UNREADABLE), ('{"keyword": "no id"}', landing.NO_ENTRY),
    ]


def test_catalogue_names_what_is_stored_now(spark, sf_dir, tmp_path):
    path, products = str(tmp_path), derived.products(spark, sf_dir)
    sinks.write_run(products, path, "first")
    some = products.where(F.col("keyword").endswith("2") & (F.col("pos") % 3 == 0))
    for _ in range(2):  # a run that is repeated under its name adds nothing
        sinks.write_run(some, path, "second")
    assert landing.read_commits(spark, path).groupBy("run_id").count().count() == 2
    held = landing.read_products_json(spark, f"{path}/json").groupBy("output_name").count().collect()
    listed = landing.read_catalogue(spark, path).where("format = 'json'").collect()
    assert {r.output_name: r.products for r in listed} == {r.output_name: r["count"] for r in held}
    assert {r.run_id for r in listed} == {"first", "second"}
    name = next(r.output_name for r in listed if r.run_id == "second")
    assert landing.read_artefact(spark, path, name).count() == next(r.products for r in listed if r.output_name == name)


def test_a_run_that_stops_half_way_leaves_no_commit(spark, sf_dir, tmp_path, monkeypatch):
    path, products = str(tmp_path), derived.products(spark, sf_dir)
    sinks.write_run(products.where("pos % 2 = 0"), path, "whole")

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(sinks, "write_products_json", stop)
        with pytest.raises(RuntimeError):
            sinks.write_run(products, path, "half")
    assert {r.run_id for r in landing.read_commits(spark, path).collect()} == {"whole"}


def test_many_long_names_are_searched_in_seconds(spark):
    names = spark.range(20_000).select(
        F.concat(*[F.md5((F.col("id") + k).cast("string")) for k in range(3)], F.lit("_PRODUCTS.json.backup"))
        .alias("filename"), F.col("id").alias("modified"),
    )
    asked = spark.range(300).select(
        F.col("id").alias("job_id"), F.substring(F.md5((F.col("id") * 60).cast("string")), 3, 12).alias("keyword")
    )
    assert len(names.first().filename) == 117
    began = time.time()
    found = {r.job_id: r.modified for r in jobs.job_files(asked, names).collect()}
    assert time.time() - began < 60 and len(found) == 300
    rows = names.collect()
    for r in asked.limit(20).collect():
        assert found[r.job_id] == max(n.modified for n in rows if r.keyword in n.filename.lower())


def test_an_empty_search_term_is_in_every_name(spark):
    files = spark.createDataFrame([("a_PRODUCTS.csv", 1), ("b_PRODUCTS.csv", 2)], "filename string, modified int")
    asked = spark.createDataFrame([(1, ""), (2, "A_"), (3, "zz")], "job_id int, keyword string")
    assert {r.job_id: r.filename for r in jobs.job_files(asked, files).collect()} == {1: "b_PRODUCTS.csv", 2: "a_PRODUCTS.csv"}


def test_definition_pairs_of_odd_lists_and_of_very_many_terms(spark):
    page = (
        "<dl><dt>A<dt class='x'>B</dt><dd>1</dd><dd>2</dd><dt>C</dt></dl><dl><DT>D</DT>\n<DD>3 <b>x</b></DD><dt>E</dl><dd>4"
        "<dtx>no</dtx><dt>F</dt>"
    )
    many = "<dl>" + "".join(f"<dt>t{i}</dt><dd>d{i}</dd>" for i in range(8000)) + "</dl>"
    terms = "<dl>" + "".join(f"<dt>t{i}</dt>" for i in range(8000)) + "<dd>last</dd></dl>"
    rows = spark.createDataFrame([(1, page), (2, many), (3, terms), (4, "")], "i int, html string")
    found = rows.select("i", details.definition_pairs(F.col("html")).alias("p"))
    began = time.time()
    pairs = {r.i: [(x.pos, x.term.strip(), x.definition) for x in r.p] for r in found.collect()}
    assert time.time() - began < 20
    assert pairs[1] == [(0, "A", "1"), (1, "B", "1"), (2, "D", "3x")]
    assert pairs[2] == [(i, f"t{i}", f"d{i}") for i in range(8000)]
    assert [p[2] for p in pairs[3]] == ["last"] * 8000 and pairs[4] == []


def test_work_folders_go_when_their_owner_releases_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "CHECKPOINT_DIR", "spark.shelfwise.test.dir")
    spark.conf.set(runtime.CHECKPOINT_DIR, f"file://{tmp_path}/shared")
    runtime.staged(spark.range(3), "some")
    assert list(Path(tmp_path, "shared").glob("shelfwise-*/some-*/part-*"))
    runtime.release(spark)
    assert not list(Path(tmp_path, "shared").glob("shelfwise-*"))


def test_job_products_gives_every_product_of_each_completed_job(spark, tmp_path):
    from shelfwise.plans.catalog import QUERIES

    made = [(k, f"tin {k}", f"Brand#{11 + k % 2}", 1.5) for k in range(1, 12)]
    parts = spark.createDataFrame(made, "p_partkey bigint, p_name string, p_brand string, p_retailprice double")
    seen = [(1, 1, 11, "view"), (2, 2, 11, "purchase"), (3, 1, 41, "purchase"), (4, 1, 12, "purchase"), (5, 2, 12, "error")]
    events = spark.createDataFrame(seen, "event_id bigint, s bigint, user_id bigint, event_type string")
    events = events.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"))
    for name, table in (("part", parts), ("events", events)):
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    found = QUERIES["job_products"](spark, str(tmp_path))
    # Part 11 is listed twice; its brand and those of the other odd keys is Brand#12.
    assert {(r.job_id, r.title) for r in found.collect()} == {(j, f"tin {k}") for j in (11, 41) for k in (2, 4, 6, 8, 10)}
    assert found.count() == 10


def test_job_products_are_made_in_cells_that_keep_the_jobs_of_a_product_together(spark, monkeypatch):
    monkeypatch.setattr(jobs, "CELL_ROWS", 2000, raising=False)
    monkeypatch.setattr(jobs, "CELL_JOBS", 20, raising=False)
    asked = [(j, "hot", "completed") for j in range(59)] + [(None, "hot", "completed"), (70, "cold", "completed"), (71, "hot", "failed")]
    held = [("hot_PRODUCTS.json", f"tin {k}") for k in range(500)] + [("cold_PRODUCTS.json", "pan")] * 2 + [("other_PRODUCTS.json", "tin 1")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as between large tables
    try:
        latest = spark.createDataFrame(asked, "job_id bigint, keyword string, status string")
        found = jobs.job_products(latest, spark.createDataFrame(held, "output_name string, title string"))
        assert found.columns == ["output_name", "job_id", "title"]
        rows = found.select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    pairs = [(r.job_id, r.title) for r in rows if r.output_name == "hot_PRODUCTS.json"]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(j, f"tin {k}") for j in [*range(59), None] for k in range(500)}
    assert [(r.job_id, r.title) for r in rows if r.output_name != "hot_PRODUCTS.json"] == [(70, "pan")] * 2
    # 60 jobs are in 3 parts: no product is begun more often than that, and no task makes most of the rows.
    tasks = {}
    for r in rows:
        tasks.setdefault(r.task, []).append((r.output_name, r.title))
    assert sum(1 + sum(a != b for a, b in zip(t, t[1:], strict=False)) for t in tasks.values()) <= 3 * 502
    assert max(map(len, tasks.values())) < len(rows) / 3


def test_packed_json_artefacts_read_like_plain_ones_and_take_less_disk(spark, tmp_path):
    fields = {c: F.lit("same in each row") for c in PRODUCT_COLUMNS} | {"title": F.format_string("tin %d", "id")}
    made = spark.range(2000).select(
        F.lit("tins").alias("keyword"), F.lit(1).alias("page_no"), F.col("id").alias("pos"), *[v.alias(c) for c, v in fields.items()]
    )
    sinks.write_products_json(made, f"{tmp_path}/plain")
    sinks.write_products_json(made, f"{tmp_path}/packed", compression="gzip")
    plain, packed = (landing.read_products_json(spark, f"{tmp_path}/{x}") for x in ("plain", "packed"))
    assert packed.count() == 2000 and packed.exceptAll(plain).isEmpty()
    size = {x: sum(p.stat().st_size for p in Path(tmp_path, x).rglob("part-*")) for x in ("plain", "packed")}
    assert size["packed"] < size["plain"] / 5
