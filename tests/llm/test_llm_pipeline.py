"""The pipeline, and the registration of its queries."""

import random
import re

import pytest
from plain_texts import sentence

import __spark_entry__
import corpus_pipeline
from shelfwise.llm import mixing, queries
from test_llm_decontam import plain_leaks
from test_llm_jaccard import plain_classes
from test_llm_lines import plain_removed
from test_llm_mixing import plain_copies
from test_llm_quality import plain_counts


def test_all_queries_are_registered():
    registered = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(registered)
    for number in range(1, 11):
        assert sum(name.startswith(f"op{number}_") for name in registered) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(registered)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of documents, labels and benchmark with cases for every stage."""
    rng = random.Random(21)
    rows = [(i, "\n".join(sentence(rng, 15) for _ in range(4)), "en", "web" if i % 3 else "books") for i in range(40)]
    items = [(i, sentence(rng, 20)) for i in range(3)]
    rows += [(100, rows[0][1] + " tail", "en", "web"), (101, rows[5][1], "en", "books"), (102, "too short", "en", "web")]
    rows += [(103, sentence(rng, 12) + "\n" + items[1][1] + "\n" + sentence(rng, 12), "en", "web")]
    rows += [(104, sentence(rng, 30) + "\nthe same line in all of them\n" + sentence(rng, 20), None, None)]
    rows += [(105, "the same line in all of them\n" + sentence(rng, 40), "en", "web"), (106, None, "en", "web"), (107, "", None, "web")]
    rows += [(None, sentence(rng, 40), "en", "web")]
    path = str(tmp_path_factory.mktemp("small"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], schema)
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_pipeline_is_that_of_the_plain_operators(spark, small):
    path, rows, items = small
    rows = [r for r in rows if not plain_counts(r[1])[-1]]  # one label makes no cutoff safe
    removed = plain_removed([r[:2] for r in rows])
    texts = []
    for doc_id, text, lang, source in rows:
        if any(d == doc_id for d, _ in removed):
            text = "\n".join(x for at, x in enumerate(text.split("\n")) if (doc_id, at) not in removed)
            if not re.search(r"\w", text):
                continue
        texts.append((doc_id, text, lang, source))
    classes = plain_classes([r[:2] for r in texts])
    texts = [r for r, (c, _) in zip(texts, classes, strict=True) if r[0] == c]
    leaked = {d for d, *_ in plain_leaks([r[:2] for r in texts], items)}
    texts = [r for r in texts if r[0] not in leaked]
    assert {101, 102, 103, 106, 107}.isdisjoint(r[0] for r in texts) and {104, 105, None} <= {r[0] for r in texts}
    found = corpus_pipeline.run(spark, path)
    own = sorted([(r.doc_id, r.text, r.source, r.copy) for r in found.collect()], key=repr)
    assert own == sorted(plain_copies(texts).elements(), key=repr)


def test_stages_keep_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small[0]).schema.simpleString() == docs.schema.simpleString()


def test_every_stage_takes_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small[0]).count() == 0
    assert mixing.mix(docs).columns[-2:] == ["copy", "shuffle_key"]
