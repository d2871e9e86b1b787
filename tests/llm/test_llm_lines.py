"""Line dedup against all pairs of lines."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from plain_texts import sentence

from shelfwise.llm import lines, rolling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_removed(docs):
    """{(doc_id, line number)} of the lines that are no first occurrence of their group."""
    found = []
    for doc_id, text in sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0)):
        for at, line in enumerate((text or "").split("\n")):
            norm = re.sub(r"\d+", "0", line.lower())
            if words := re.findall(r"[a-z0-9]+", norm):
                sim = lines.simhash(rolling.plain_words(pa.array([norm])))[0]
                found.append((doc_id, at, norm, words, sim))
    parent = list(range(len(found)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(found)):
        for j in range(i):
            a, b = found[i], found[j]
            near = a[3] == b[3] or (
                bin(int(a[4]) ^ int(b[4])).count("1") <= lines.MAX_BITS
                and 1 - distance(a[2], b[2]) / max(len(a[2]), len(b[2])) >= lines.SIMILARITY
            )
            if near:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {(d, at) for i, (d, at, *_) in enumerate(found) if find(i) != i}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    shared = [sentence(rng, 14) for _ in range(6)]
    out = []
    for i in range(25):
        text = [sentence(rng, rng.randrange(6, 14)) for _ in range(rng.randrange(1, 4))]
        common = list(rng.choice(shared))
        if i % 3 == 0:
            common[rng.randrange(len(common))] = "z"
        text.insert(rng.randrange(len(text) + 1), "".join(common))
        if i % 4 == 0:
            text += ["", f"Posted on {i} May, {i} comments!", "***"]
        out.append((i, "\n".join(text)))
    out += [(30, None), (31, ""), (32, "\n \n"), (33, "--\n**"), (34, shared[0]), (34, shared[0]), (None, out[3][1])]
    out += [(35, "solo\nsolo\nSOLO!\n" + " ".join(["long"] * 600)), (36, " ".join(["long"] * 600))]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_edit_similarity(seed):
    rng = random.Random(seed)
    for _ in range(2000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            b[rng.randrange(len(b) + 1) : rng.randrange(len(b) + 1)] = rng.choice(["", "a", "bc"])
        b = "".join(b)
        expected = distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
        assert lines.edit_similar(a, b, 0.8) == expected


def test_simhash_of_short_and_long_lines_is_the_majority_of_bits():
    texts = ["a b c", " ".join(f"w{i}" for i in range(700)), "one", " ".join(f"v{i}" for i in range(255))]
    words = rolling.plain_words(pa.array(texts))
    for row, sim in enumerate(lines.simhash(words)):
        own = words.hash[words.row == row]
        bits = [int(sum((int(h) >> k) & 1 for h in own) * 2 > len(own)) for k in range(64)]
        assert int(sim) == sum(b << k for k, b in enumerate(bits))


def test_pigeonhole_cut_joins_what_all_pairs_join(monkeypatch):
    rng = np.random.default_rng(1)
    sims = rng.integers(0, 1 << 63, 40, dtype=np.uint64).repeat(6)
    sims = np.unique(sims ^ (np.uint64(1) << rng.integers(0, 64, len(sims)).astype(np.uint64)))

    def groups(many):
        monkeypatch.setattr(lines, "MANY", many)
        forest = lines.Forest(len(sims))
        lines.close(sims, forest, np.arange(len(sims)))
        return [forest.find(i) for i in range(len(sims))]

    assert groups(10) == groups(10_000)


def test_report_is_that_of_all_pairs(documents, docs):
    found = lines.line_report(documents(docs)).collect()
    assert {(r.doc_id, at) for r in found for at in r.removed} == plain_removed(docs)
    assert all(r.n_removed == len(r.removed) for r in found)
    assert {r.doc_id for r in found} == {d for d, t in docs if re.search(r"\w", t or "")}


def test_large_groups_are_verified_in_parts(documents, monkeypatch):
    monkeypatch.setattr(lines, "PART_LINES", 2)
    base = "the quick brown fox jumps over the lazy dog while nobody looks at the very old house near the river"
    docs = [(i, base + " " + "ab"[i % 2] * (i // 2)) for i in range(12)]
    found = lines.line_report(documents(docs)).collect()
    assert {(r.doc_id, at) for r in found for at in r.removed} == plain_removed(docs)


def test_lines_outside_the_largest_class_are_compared_with_all_parts(documents, monkeypatch):
    """Other orders of the same words have equal SimHashes but are no near-copies."""
    monkeypatch.setattr(lines, "PART_LINES", 2)
    words = "the quick brown fox jumps over that lazy dog while nobody looks".split()
    orders = [words, words[::-1], words[6:] + words[:6], words[::2] + words[1::2], words[1::2] + words[::2]]
    docs = [(10 * i + k, " ".join(order) + " the" * k) for i, order in enumerate(orders) for k in range(5 - i)]
    found = lines.line_report(documents(docs)).collect()
    removed = {(r.doc_id, at) for r in found for at in r.removed}
    assert removed and removed == plain_removed(docs)


def test_texts_lose_repeated_lines_and_nothing_else(documents, docs):
    df = documents(docs)
    kept = lines.dedup_lines(df)
    assert kept.columns == df.columns
    removed, expected = plain_removed(docs), []
    for doc_id, text in docs:
        left = "\n".join(x for at, x in enumerate((text or "").split("\n")) if (doc_id, at) not in removed)
        if not any(d == doc_id for d, _ in removed):
            expected.append((doc_id, text, None if text is None else len(text)))
        elif re.search(r"\w", left):
            expected.append((doc_id, left, len(left)))
    assert sorted([(r.doc_id, r.text, r.n_chars) for r in kept.collect()], key=repr) == sorted(expected, key=repr)


def test_empty_table(documents):
    assert lines.line_report(documents([])).count() == 0
    assert lines.dedup_lines(documents([])).count() == 0


def plain_classes(texts):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if distance(texts[i], texts[j]) <= (1 - lines.SIMILARITY) * max(len(texts[i]), len(texts[j])) + 1e-9:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def altered(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = rng.choice([[], ["ünlike"], ["of", "the"]])
    return " ".join(words)


def test_sieve_finds_the_classes_of_all_pairs():
    """Also where the bounds leave a pair open, for characters beyond one byte, and for very short and empty lines."""
    rng = random.Random(5)
    texts = ["", "a", "ab", "é" * 70, "e" * 70]
    for _ in range(6):
        base = sentence(rng, 35)
        texts += [altered(rng, base, n) for n in (0, 1, 4, 8, 14, 20)]
    i, j = np.triu_indices(len(texts), 1)
    sieve = lines.Sieve(texts, lines.SIMILARITY)
    sieve.add(i, j)
    assert [sieve.forest.find(k) for k in range(len(texts))] == plain_classes(texts)


def test_bounds_are_never_above_the_distance():
    rng = random.Random(6)
    pairs = [(base := sentence(rng, 30), altered(rng, base, rng.randrange(12))) for _ in range(40)]
    codes = [[np.frombuffer(x.encode("utf-32-le"), np.uint32) % lines.BINS for x in own] for own in zip(*pairs, strict=True)]
    apart = np.array([distance(a, b) for a, b in pairs])
    found = lines._blocks_apart(*([x.astype(np.uint8) for x in own] for own in codes), apart)
    assert (found <= apart).all() and found.any()
    for (a, b), d in zip(pairs, apart, strict=True):
        assert not lines._few_words(a, b, d - 1)


def test_unlike_lines_are_not_compared_one_by_one(monkeypatch):
    """Time: lines with close SimHashes of which the lengths alone do not tell that they differ."""
    rng = random.Random(7)
    asked = []
    monkeypatch.setattr(lines, "edit_similar", lambda a, b, least: asked.append((a, b)))
    texts = [sentence(rng, 60) for _ in range(40)]
    n = len(texts)
    table = pa.table(
        {"home": pa.array([1] * n, pa.int64()), "other": pa.array([0] * n, pa.int64()), "part": pa.array([0] * n, pa.int64()),
         "line": [f"{i:03}".encode() for i in range(n)], "sim": pa.array([5] * n, pa.int64()), "text": texts}
    )
    assert lines._verify(lines.SIMILARITY)(table).num_rows == 0 and not asked


def test_stars_of_small_and_large_keys_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    rest = np.int64(~np.int64(lines.MASKS[0]))
    sims = []
    for size in (1, 2, 2, 2, 3, 3, 5, 70):
        own = rng.integers(-(1 << 62), 1 << 62, dtype=np.int64) & np.int64(lines.MASKS[0])
        free = rng.integers(0, 1 << 62, size, dtype=np.int64) & rest
        free[1::2] = free[: len(free) // 2 * 2 : 2] ^ (rest & -rest)
        sims.append(np.unique(own | free))
    sim = np.concatenate(sims)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sim), np.int8)), pa.array(sim)], ["number", "sim"])
    found = pa.Table.from_batches(lines._stars(iter([batch])))
    expected = set()
    for own in sims:
        forest = lines.Forest(len(own))
        lines._close_all(own.view(np.uint64), forest, np.arange(len(own)))
        roots = [forest.find(k) for k in range(len(own))]
        expected |= {(int(own[k]), int(own[r])) for k, r in enumerate(roots) if roots.count(r) > 1}
    assert len(expected) > 60
    assert set(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)) == expected
    homes = dict(zip(found["b"].to_pylist(), found["home"].to_pylist(), strict=True))
    assert all(homes[b] == h for b, h in zip(found["b"].to_pylist(), found["home"].to_pylist(), strict=True))


def test_dealt_keys_bring_all_close_hashes_together_in_few_rows():
    """Cost: hashes travel packed, ten keys each, not in a row a key; those of several lines are named."""
    rng = np.random.default_rng(8)
    sims = rng.integers(-(1 << 62), 1 << 62, 300)
    sims = np.concatenate([sims, *(sims[:60] ^ np.int64(sum(1 << int(b) for b in rng.choice(62, n, replace=False))) for n in (1, 2, 3, 3))])
    batches = [pa.RecordBatch.from_arrays([pa.array(x)], ["sim"]) for x in (sims, sims[5:9], sims[:3])]
    dealt = pa.Table.from_batches(list(lines._dealt(7)(iter(batches))))
    assert dealt.num_rows <= 7
    found = pa.concat_tables([lines._bucket_stars(dealt.filter(pa.compute.equal(dealt["bucket"], k))) for k in range(7)])
    several = [a for a, home in zip(found["a"].to_pylist(), found["home"].to_pylist(), strict=True) if home is None]
    assert sorted(several) == sorted({*sims[5:9].tolist(), *sims[:3].tolist()})
    homes = {}
    for a, home in zip(found["a"].to_pylist(), found["home"].to_pylist(), strict=True):
        homes.setdefault(a, set()).add(home)
    i, j = np.triu_indices(len(sims), 1)
    close = np.bitwise_count((sims[i] ^ sims[j]).view(np.uint64)) <= lines.MAX_BITS
    assert close.sum() >= 240
    for x, y in zip(sims[i[close]].tolist(), sims[j[close]].tolist(), strict=True):
        assert homes[x] & homes[y] - {None}


def test_the_rest_is_sifted_too(monkeypatch):
    """Time: lines outside the largest class were compared with all others one by one."""
    rng = random.Random(9)
    asked = []
    monkeypatch.setattr(lines, "edit_similar", lambda a, b, least: asked.append((a, b)))
    texts = [sentence(rng, 60) for _ in range(30)]
    texts += [texts[0] + " end"]
    n = len(texts)
    table = pa.table(
        {"line": [f"{i:03}".encode() for i in range(n)], "root": [f"{i:03}".encode() for i in range(n)], "text": texts,
         "sim": pa.array([5] * n, pa.int64()), "asks": [i == 0 for i in range(n)]}
    )
    assert lines._verify_rest(lines.SIMILARITY)(table).to_pylist() == [{"a": b"030", "b": b"000"}] and not asked


def test_words_across_slices_and_around_punctuation_of_unicode(monkeypatch):
    texts = ["", "Don\u2019t\u00a0stop\u3001now", "\u00e9t\u00e9 \u20ac5 \u2030", "a" * 50 + " b", None, "\u2014", "x\u2014"]
    whole = rolling.plain_words(pa.array(texts))
    assert whole.row.tolist() == [1] * 4 + [2] * 2 + [3] * 2 + [6]
    monkeypatch.setattr(rolling, "HASHED_BYTES", 8)
    assert all((a == b).all() for a, b in zip(whole, rolling.plain_words(pa.array(texts)), strict=True))
