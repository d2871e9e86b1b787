"""The near-copy join against all pairs of word 5-gram sets."""

import random

import pytest
from plain_texts import sentence

from shelfwise.llm import jaccard


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(rows):
    """(class id, links) per row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((min(ids, default=None), links[i]))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(1000 + i, sentence(rng, 40)) for i in range(40)]
    for i in range(30):
        base = sentence(rng, rng.randrange(20, 120)).split()
        for k in range(rng.randrange(2, 6)):
            text = list(base)
            for _ in range(k):
                text[rng.randrange(len(text))] = "other"
            out.append((len(out), " ".join(text) if k % 2 else " ".join(text).upper()))
    long = sentence(rng, 3000).split()
    out += [(5000, " ".join(long)), (5001, " ".join(long[100:]))]
    out += [(6000, None), (6001, ""), (6002, " \n "), (6003, "two words"), (6004, "Two  words"), (6005, "words two")]
    out += [(None, out[50][1]), (7, out[50][1]), (7, out[50][1])]
    return out


def test_classes_and_links_are_those_of_all_pairs(documents, rows):
    found = jaccard.near_duplicates(documents(rows)).collect()
    expected = plain_classes(rows)
    with_words = [((d, *e)) for (d, t), e in zip(rows, expected, strict=True) if (t or "").strip()]
    order = repr
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in found if r.doc_id not in (6000, 6001, 6002)], key=order) == sorted(with_words, key=order)
    assert {(r.doc_id, r.class_id, r.n_links) for r in found if r.doc_id in (6000, 6001, 6002)} == {(i, i, 0) for i in (6000, 6001, 6002)}


def test_large_groups_are_compared_in_parts(documents, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_TEXTS", 2)
    rng = random.Random(3)
    base = sentence(rng, 60).split()
    many = [(i, " ".join([*base[: i + 1], f"x{i}", *base[i + 2 :]])) for i in range(25)]
    found = {(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(documents(many)).collect()}
    assert found == {(d, *e) for (d, _), e in zip(many, plain_classes(many), strict=True)}


def test_one_row_of_each_class_stays(documents, rows):
    df = documents(rows)
    kept = jaccard.deduplicate(df)
    assert kept.columns == df.columns
    classes = {c for (_, t), (c, _) in zip(rows, plain_classes(rows), strict=True) if (t or "").strip()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(classes | {6000, 6001, 6002})


def test_pruning_keeps_likely_pairs():
    for n, least in jaccard.min_matches(0.8, 1e-6, 24, 240):
        assert least < 0.8 * n


def test_empty_table(documents):
    assert jaccard.near_duplicates(documents([])).count() == 0
    assert jaccard.deduplicate(documents([])).count() == 0
