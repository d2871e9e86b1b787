"""Surrogates: form, agreement, distinctness."""

import re
import time

import pytest

from shelfwise.llm import pii

ROWS = [
    (1, "Write to Anna.Berg@mail.example.com or call +49 170 1234567. Dr. Anna Petersen knows. password = hunter22x"),
    (2, "anna.berg@MAIL.example.com; Mrs Anna Petersen and Mr. Petersen, host 192.168.0.17, card 4111 1111 1111 1111"),
    (3, "Card 4111-1111-1111-1111, IBAN DE89 3704 0044 0532 0130 00, mac 00:1A:2b:3c:4D:5e, ssn 123-45-6789"),
    (4, "Г-жа Мария Иванова и Г-н Иван Петров; Κύριος Νίκος Παππάς"),
    (5, "Version 1.2.3, 12:30, room 4711, nothing here."),
    (6, None), (7, ""), (None, "Mr Paul Klein"), (8, "Mr Paul Klein"), (8, "Mr Paul Klein"),
    (9, "word " * 20000 + "Mr Paul Klein"),
]


@pytest.fixture(scope="module")
def replaced(documents):
    return pii.pseudonymise(documents(ROWS), "k").collect()


def test_rest_of_the_text_and_other_columns_stay(documents, replaced):
    by_id = {r.doc_id: r for r in replaced}
    df = documents(ROWS)
    assert pii.pseudonymise(df, "k").columns == [*df.columns, "n_entities"] and len(replaced) == len(ROWS)
    for doc_id, text in ROWS:
        own, parts, at = by_id[doc_id].text, [], 0
        found = pii.find(text or "")
        assert by_id[doc_id].n_entities == len(found)
        for start, end, _, _ in found:
            parts.append(re.escape(text[at:start]))
            at = end
        if text is None:
            assert own is None
        else:
            assert re.fullmatch("(.+?)".join([*parts, re.escape(text[at:])]), own, re.S)
            assert not any(text[a:b] in own for a, b, k, _ in found if not k.startswith("given"))
    assert by_id[5].text == ROWS[4][1]


def test_mentions_of_one_entity_agree(replaced):
    by_id = {r.doc_id: r.text for r in replaced}
    email = r"\S+@\S+?\.example\.org"
    assert re.search(email, by_id[1])[0].lower() == re.search(email, by_id[2])[0].lower()
    card = [re.sub(r"\D", "", re.search(r"[Cc]ard ([\d -]{19})", by_id[i])[1]) for i in (2, 3)]
    assert card[0] == card[1] != "4" + "1" * 15 and pii.luhn(card[0]) == 0
    family = re.search(r"Dr\. \w+ (\w+)", by_id[1])[1]
    assert f"Mr. {family}," in by_id[2] and re.search(rf"Mrs \w+ {family}", by_id[2])
    assert by_id[None] == by_id[8] and by_id[9].endswith(by_id[8])


def test_form_gender_and_script(replaced):
    by_id = {r.doc_id: r.text for r in replaced}
    iban = re.search(r"IBAN (DE\d\d(?: \d{4}){4} \d\d)", by_id[3])[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.search(r"mac (?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}, ssn \d{3}-\d\d-\d{4}$", by_id[3])
    for number in re.search(r"host (\S+),", by_id[2])[1].split("."):
        assert 0 < int(number) < 255
    assert not re.search("[A-Za-z]", by_id[4])
    given = re.search(r"Mrs (\w+)", by_id[2])[1]
    assert any(given.startswith(n) for n in pii.GIVEN["f", "latin"])


def test_no_two_entities_share_a_surrogate(spark):
    """Many more names than any list holds, and dense numbers."""
    names = [f"{a}{b}{c}{d}{e}" for a in "klmnprst" for b in "aeiou" for c in "klmnprst" for d in "aeiou" for e in range(70)]
    entities = [("ssn", f"{i:09d}") for i in range(300)] + [("given:f:latin", n) for n in names[:100_000]]
    entities += [("family:latin", n) for n in names[:20_000]] + [("phone", str(i)) for i in range(90000, 100000)]
    rows = pii.assign(spark.createDataFrame(entities, "kind string, entity string"), "k").collect()
    assert {(r.kind, r.entity) for r in rows} == set(entities) and len(names) > 100_000
    for kinds in (["ssn"], ["phone"], ["given:f:latin", "family:latin"]):
        own = [r.surrogate.lower() for r in rows if r.kind in kinds]
        assert len(set(own)) == len(own)
        assert not any(r.surrogate == r.entity for r in rows if r.kind in kinds)
        if kinds != ["phone"]:
            assert not set(own) & {e for k, e in entities if k in kinds}


def test_every_kind_is_permuted_inside_its_form():
    """All cards of a bank, valid or not; all addresses of a net; all codes of a shape; hexadecimal ones apart."""
    whole = {
        "card": [f"4{i:06d}{d}" for i in range(0, 10**6, 997) for d in range(10)],
        "ip": [f"{a}.168.0.{b}" for a in (0, 1, 10, 192, 254, 255) for b in range(256)],
        "iban": [f"DE{c:02d}{b:04d}" for c in range(100) for b in range(0, 10_000, 397)],
        "secret": [f"{a}{b}{c}1" for a in "abcxyz" for b in "abcdefgxyz" for c in "0123456789"],
        "email": [f"{a}{b}@{c}o.de" for a in "abcdef" for b in "aeiou" for c in "bdfg"],
        "mac": [f"0{a}:1b:{b}f" for a in "0123456789abcdef" for b in "0123456789abcdef"],
    }
    for kind, values in whole.items():
        made = [pii.surrogate(kind, value, "k") for value in values]
        assert len(set(made)) == len(set(values)), kind
        assert not any(a == b for a, b in zip(made, values)), kind
        if kind == "card":
            assert all((pii.luhn(a) == 0) == (pii.luhn(b) == 0) and a[0] == b[0] for a, b in zip(made, values))


def test_beginnings_of_names_can_be_read_back():
    for script in pii.FAMILY:
        first = [*pii.FAMILY[script], *(n for (_, s), names in pii.GIVEN.items() if s == script for n in names)]
        assert len(set(first)) == len(first)
        assert not any(a != b and a.startswith(b) for a in first for b in first)


def test_permutation_and_its_inverse():
    for size in (2, 3, 10, 1000, 62**40):
        some = range(min(size, 300))
        made = [pii.moved("k", "t", size, x) for x in some]
        assert len(set(made)) == len(made) and all(0 <= y < size and y != x for x, y in zip(some, made))
    assert pii.moved("k", "t", 1, 0) == 0
    # All digits of a long value change their meaning, not only the last ones.
    a, b = (pii.reshaped("k", "secret", "Q" * 199 + c, pii.CODE) for c in "QR")
    assert sum(x == y for x, y in zip(a, b)) < 40


def test_texts_with_known_entities(documents):
    """Built from parts, so that what is replaced is known without looking for it."""
    people = ["Mr. Quentin Ravelo", "Mrs Ottilie Ravelo", "Dr Xaver Umbrecht"]
    things = ["q.ravelo@post.example.com", "10.20.30.40", "123-45-6789", "+49 170 1234567", "00:1a:2b:3c:4d:5e", "020 7946 0958"]
    rows, rest = [], {}
    for i in range(60):
        known = [people[i % 3], things[i % 6], things[(i + 1) % 6]]
        if i % 4 == 0:
            known.append("My name is " * (i % 8 == 0) + "Priya Raghunathan" if i % 8 == 0 else "Anna Lindqvist")
        words = [f"Plain words number {i} go here, then {{}} and so on." for _ in known]
        rows.append((i, " ".join(words).format(*known)))
        rest[i] = words
    seen, back = {}, {r.doc_id: r for r in pii.pseudonymise(documents(rows), "k").collect()}
    for i, text in rows:
        pattern = " ".join(re.escape(w).replace(r"\{\}", "(.+?)") for w in rest[i])
        before, after = (re.fullmatch(pattern, t).groups() for t in (text, back[i].text))
        for a, b in zip(before, after, strict=True):
            assert a != b and seen.setdefault(a, b) == b  # one surrogate everywhere
            if not a[-1].isdigit() and "@" not in a and ":" not in a:
                assert a.split()[-1] not in b and (a.split()[0] == b.split()[0] or a.startswith("Anna"))
            else:
                assert re.sub(r"\w", "x", a)[:3] == re.sub(r"\w", "x", b)[:3] or "@" in a or "." in a
    assert len(set(seen.values())) == len(seen)
    family = {a.split()[-1]: b.split()[-1] for a, b in seen.items() if a.startswith(("Mr", "Dr"))}
    assert seen["Mr. Quentin Ravelo"].split()[-1] == seen["Mrs Ottilie Ravelo"].split()[-1] == family["Ravelo"]


@pytest.mark.parametrize("run", ["a", "1", "A", "a.", "1 ", "a:", "ab@", "Mr ", "0:", "token ", "+1", "name: A"])
def test_long_runs_take_linear_time(run):
    began = time.process_time()
    pii.find(run * (1_000_000 // len(run)))
    assert time.process_time() - began < 12


def test_a_million_letters_take_under_a_second():
    began = time.process_time()
    assert pii.find("a" * 1_000_000) == []
    assert time.process_time() - began < 1


def test_the_key_decides(documents):
    one, two, again = (pii.pseudonymise(documents(ROWS[:2]), key).collect()[0].text for key in ("a", "b", "a"))
    assert one == again != two


def test_empty_table(documents):
    assert pii.pseudonymise(documents([]), "k").count() == 0
