"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from shelfwise.llm import repair

BLANK = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_damage(rows):
    """[(conv_id, turn, role, text)] to the rows after damage; every conversation keeps a key."""
    kept = {}
    for conv_id, turn, role, text in rows:
        out = kept.setdefault(conv_id, [])
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        pick = zlib.crc32(name.encode()) % 20
        if pick == 0:
            continue
        text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
        out += [(turn, "user" if pick == 4 else role, text)] * (2 if pick == 3 else 1)
    return kept


def plain_findings(rows):
    """All findings of one conversation, with whole audits and texts in a best-first search."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        letters = BLANK.findall(text)
        faults.append(
            "b" if not letters else "d" if (role, text) in seen else "t" if letters[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    turns = [turn for turn, _, _ in rows if turn is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
            return gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest
        for symbol, role in (("u", "user"), ("a", "assistant")):
            if (state, symbol) in NEXT:
                heapq.heappush(heap, (cost + 5, audit + "I", at, NEXT[state, symbol], (*out, role + ":")))
        if at == len(rows):
            continue
        _, role, text = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, out))
        if faults[at] in ("b", "d"):
            continue
        more = 5 if faults[at] == "t" else 0
        for letter, price, symbol, named in (("K", 0, role[:1], role), ("R", 1, "u", "user"), ("R", 1, "a", "assistant")):
            if (state, symbol) in NEXT:
                said = (*out, f"{named}:{text}")
                heapq.heappush(heap, (cost + price + more, audit + letter, at + 1, NEXT[state, symbol], said))


SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(frame):
    return {row.conv_id: tuple(row[c] for c in COLUMNS) for row in frame.collect()}


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    texts = ["Yes.", "No?", "so", " ", "", "a\n", "Well! ", "été", None, "end.\t\v"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "$", "student"]
    rows = []
    for conv_id in range(300):
        few = rng.random() < 0.5
        for turn in range(rng.randrange(1, 9)):
            text = f"Line {rng.randrange(50)}." if few and rng.random() < 0.9 else rng.choice(texts)
            role = ("user", "assistant")[turn % 2] if few and rng.random() < 0.8 else rng.choice(roles)
            rows.append((conv_id, None if rng.random() < 0.05 else rng.choice([turn, turn, turn * 3]), role, text))
    rows += [(None, 1, "user", "Null conversation."), (None, None, "assistant", "Yes."), (900, 5, "user", None)]
    # Ways of different phase that never meet, and a very long conversation.
    rows += [(901, i, "tool", f"t {i}.") for i in range(40)]
    rows += [(902, i, "user" if i % 3 else "assistant", f"t {i}" + "." * (i % 7 > 0)) for i in range(3000)]
    rows += [(903, 2, "user", "Same.")] * 50
    return rows


def test_damaged_conversations_equal_the_plain_search(spark, cases):
    table = spark.createDataFrame([(*row, "x") for row in cases], SCHEMA + ", copies string").repartition(7)
    found = rows_of(repair.find_repairs(repair.ordered_rows(repair.damaged(table))))
    plain = {conv_id: plain_findings(rows) for conv_id, rows in plain_damage(cases).items()}
    assert found == plain


def test_undamaged_conversations_and_their_repaired_turns(spark, cases):
    table = spark.createDataFrame([(*row, "x", 1) for row in cases], SCHEMA + ", audit string, blank int").repartition(3)
    rows = repair.ordered_rows(table.withColumn("copies", repair.F.lit(1)))
    findings = repair.find_repairs(rows)
    by_conversation = {}
    for conv_id, *row in cases:
        role, text = (" " if x is None else x for x in row[1:])
        by_conversation.setdefault(conv_id, []).append((row[0], role, text))
    found = rows_of(findings)
    assert found == {conv_id: plain_findings(rows) for conv_id, rows in by_conversation.items()}
    assert rows_of(repair.repair(table)) == found

    said = {conv_id: [] for conv_id in found}
    for row in sorted(repair.repaired_turns(rows, findings).collect(), key=lambda row: row.place):
        said[row.conv_id].append((row.place, row.role, row.text))
        assert (row.action == "insert") == (row.turn is None and row.text == "") or row.turn is None
    for conv_id, turns in said.items():
        assert [place for place, _, _ in turns] == list(range(1, len(turns) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for _, role, _ in turns))
        text = "\n".join(f"{role}:{text}" for _, role, text in turns)
        assert hashlib.sha256(text.encode()).hexdigest() == found[conv_id][-1]


def test_conversation_without_rows_after_damage(spark):
    gone = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    table = spark.createDataFrame([(7, gone, "user", "Yes.")], SCHEMA)
    found = rows_of(repair.find_repairs(repair.ordered_rows(repair.damaged(table))))
    assert found == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_the_plain_search(spark, sf_dir, tables):
    rows = tables("SELECT conv_id, turn, role, text FROM '{dir}/conversations.parquet'")
    found = rows_of(repair.op11_conversation_repair(spark, sf_dir))
    assert found == {conv_id: plain_findings(kept) for conv_id, kept in plain_damage(rows).items()}


def test_grammar_with_a_conflict_is_refused():
    with pytest.raises(ValueError):
        repair.parse_table((("A", ("A", "A")), ("A", ("x",))))
