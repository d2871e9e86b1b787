"""Repairs the role structure of conversations by a generalised LR parse with weighted edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLANKS = " \t\n\x0b\f\r"
ENDS = ".!?"
# Role initials a conversation may have: s?(ua)+, or nothing.
GRAMMAR = (
    ("Talk", ()),
    ("Talk", ("s", "Turns")),
    ("Talk", ("Turns",)),
    ("Turns", ("Pair",)),
    ("Turns", ("Turns", "Pair")),
    ("Pair", ("u", "a")),
)
END = "$"
LEGAL_PAIRS = {"su", "ua", "au"}
# Roles that an edit can give, by initial.
GIVEN = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

FINDING = (
    "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
    " repaired_sha256 string"
)
TURN = "conv_id {0}, place long, action string, turn long, role string, text string"


def parse_table(grammar: tuple = GRAMMAR) -> tuple[list[dict], list[dict]]:
    """SLR(1) actions and gotos by state. An action is ("shift", state), ("reduce", production) or ("accept",)."""
    rules = (("", (grammar[0][0],)), *grammar)
    heads = {head for head, _ in rules}

    def closure(items: set) -> frozenset:
        items = set(items)
        while True:
            wanted = {rules[r][1][dot] for r, dot in items if dot < len(rules[r][1])}
            more = {(r, 0) for r, (head, _) in enumerate(rules) if head in wanted} - items
            if not more:
                return frozenset(items)
            items |= more

    empty = {head for head, body in rules if not body}
    first = {head: set() for head in heads}
    follow = {head: set() for head in heads}
    follow[""].add(END)

    def begins(symbols: tuple) -> tuple[set, bool]:
        found: set = set()
        for symbol in symbols:
            found |= first[symbol] if symbol in heads else {symbol}
            if symbol not in empty:
                return found, False
        return found, True

    for _ in range(len(rules) * len(rules)):
        for head, body in rules:
            found, vanishes = begins(body)
            first[head] |= found
            if vanishes:
                empty.add(head)
            for i, symbol in enumerate(body):
                if symbol in heads:
                    found, vanishes = begins(body[i + 1 :])
                    follow[symbol] |= found | (follow[head] if vanishes else set())

    states, actions, gotos = [closure({(0, 0)})], [], []
    for state in states:
        action: dict = {}
        goto: dict = {}
        moves: dict = {}
        for r, dot in state:
            head, body = rules[r]
            if dot < len(body):
                moves.setdefault(body[dot], set()).add((r, dot + 1))
            elif r == 0:
                action[END] = ("accept",)
            else:
                for symbol in follow[head]:
                    if symbol in action:
                        raise ValueError(f"the grammar is not SLR(1) at {head}")
                    action[symbol] = ("reduce", r)
        for symbol, items in moves.items():
            target = closure(items)
            if target not in states:
                states.append(target)
            at = states.index(target)
            if symbol in heads:
                goto[symbol] = at
            elif symbol in action:
                raise ValueError(f"the grammar is not SLR(1) at {symbol}")
            else:
                action[symbol] = ("shift", at)
        actions.append(action)
        gotos.append(goto)
    for action in actions:
        for symbol, what in action.items():
            if what[0] == "reduce":
                action[symbol] = ("reduce", rules[what[1]][0], len(rules[what[1]][1]))
    return actions, gotos


class Stack(NamedTuple):
    """A node of the graph-structured stack: nodes share what lies below them."""

    state: int
    below: Stack | None


class Top(NamedTuple):
    """The best way to a stack top: its audit is a chain of letters, its order among all tops a short key."""

    cost: int
    key: str
    stack: Stack
    audit: tuple
    digest: object
    turns: int


def _letters(audit: tuple) -> str:
    parts = []
    while audit:
        audit, letters = audit
        parts.append(letters)
    return "".join(reversed(parts))


class Repair:
    """The cheapest edits of one conversation, row by row.

    `tops` has one entry for each LR state on top of a stack: stacks with equal tops are merged, and the smaller (cost, audit)
    stays, since the state alone says what may follow in this grammar. Audits are compared by keys: all
    ways have read the same rows, so one audit begins another only where inserts follow, and the order of two
    others never changes. A key is the rank of such a beginning plus its inserts. So a row costs
    a fixed number of steps, and only letters (not texts) are kept.
    """

    TABLE = parse_table()

    def __init__(self) -> None:
        start = Stack(0, None)
        self.tops = {0: Top(0, "", start, (), hashlib.sha256(), 0)}
        self.rows = 0
        self._insert()

    def _shift(self, stack: Stack, symbol: str) -> Stack | None:
        actions, gotos = self.TABLE
        while True:
            action = actions[stack.state].get(symbol)
            if action is None:
                return None
            if action[0] == "shift":
                return Stack(action[1], stack)
            if action[0] == "accept":
                return stack
            _, head, length = action
            for _ in range(length):
                stack = stack.below
            stack = Stack(gotos[stack.state][head], stack)

    @staticmethod
    def _better(tops: dict, state: int, cost: int, key: str) -> bool:
        have = tops.get(state)
        return have is None or (cost, key) < (have[0], have[1])

    @staticmethod
    def _said(top: Top, role: str, text: str) -> tuple[object, int]:
        digest = top.digest.copy()
        digest.update((f"\n{role}:{text}" if top.turns else f"{role}:{text}").encode("utf-8", "surrogatepass"))
        return digest, top.turns + 1

    def _insert(self) -> None:
        """Adds what is reached by inserts, then ranks the keys anew."""
        waiting = list(self.tops.values())
        while waiting:
            top = waiting.pop(0)
            for symbol, role in GIVEN.items():
                stack = self._shift(top.stack, symbol)
                if stack is not None and self._better(self.tops, stack.state, top.cost + INSERT, top.key + "I"):
                    made = Top(top.cost + INSERT, top.key + "I", stack, (top.audit, "I"), *self._said(top, role, ""))
                    self.tops[stack.state] = made
                    waiting.append(made)
        keys = sorted({top.key for top in self.tops.values()})
        short: dict[str, str] = {}
        base, rank = None, -1
        for key in keys:
            if base is None or not key.startswith(base):
                base, rank = key, rank + 1
            short[key] = chr(rank) + key[len(base) :]
        self.tops = {state: top._replace(key=short[top.key]) for state, top in self.tops.items()}

    def read(self, role: str, text: str, must_go: bool, cut: bool) -> None:
        """One row. must_go: only Delete is allowed; cut: costs more unless deleted."""
        found: dict[int, tuple] = {}

        def offer(cost: int, key: str, stack: Stack, *rest: object) -> None:
            if self._better(found, stack.state, cost, key):
                found[stack.state] = (cost, key, stack, *rest)

        more = TRUNCATED if cut else 0
        for top in self.tops.values():
            offer(top.cost + DELETE, top.key + "D", top.stack, top, "D", None)
            if must_go:
                continue
            ways = [("K", 0, role[:1], role), *(("R", REROLE, symbol, given) for symbol, given in GIVEN.items())]
            for letter, price, symbol, named in ways:
                stack = self._shift(top.stack, symbol) if symbol != END else None
                if stack is not None:
                    offer(top.cost + price + more, top.key + letter, stack, top, letter, named)
        self.tops = {}
        for state, (cost, key, stack, top, letter, named) in found.items():
            said = (top.digest, top.turns) if named is None else self._said(top, named, text)
            self.tops[state] = Top(cost, key, stack, (top.audit, letter), *said)
        self._insert()
        self.rows += 1
        if self.rows % 1024 == 0:
            self._pack()

    def _pack(self) -> None:
        """Long chains of letters become strings; shared beginnings stay shared from one packing to the next."""
        for state, top in self.tops.items():
            parts, cell = [], top.audit
            while cell and len(cell[1]) == 1:
                parts.append(cell[1])
                cell = cell[0]
            self.tops[state] = top._replace(audit=(cell, "".join(reversed(parts))) if len(parts) > 1 else top.audit)

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired turns)."""
        done = [top for top in self.tops.values() if self._shift(top.stack, END) is not None]
        best = min(done, key=lambda top: (top.cost, top.key))
        return best.cost, _letters(best.audit), best.digest.hexdigest()


class _Conversation:
    """Counts and edits of the rows of one conversation, in order."""

    def __init__(self) -> None:
        self.repair = Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.role = None

    def read(self, turn: int | None, role: str, text: str, repeated: bool, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if self.role is not None and self.role + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.role = role[:1]
        self.blank += blank
        self.duplicate += repeated and not blank
        cut = cut and not (blank or repeated)
        self.truncated += cut
        self.repair.read(role, text, blank or repeated, cut)

    def end(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.end())


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[name].to_pylist() for name in names), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


NOTHING = object()


def _find(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def findings() -> Iterator[tuple]:
        now, one = NOTHING, None
        names = ["conv_id", "turn", "role", "text", "copies", "repeated", "blank", "cut"]
        for conv_id, turn, role, text, copies, repeated, blank, cut in _rows(batches, names):
            if now is NOTHING or conv_id != now:
                if one is not None:
                    yield now, *one.end()
                now, one = conv_id, _Conversation()
            for copy in range(copies):
                one.read(turn, role, text, repeated or copy > 0, blank, cut)
        if one is not None:
            yield now, *one.end()

    return _batches(findings(), schema)


def _apply(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, audit first, order) to the turns that the audit leaves."""

    def turns() -> Iterator[tuple]:
        now, audit, at, place, last = NOTHING, "", 0, 0, ""

        def inserts() -> Iterator[tuple]:
            nonlocal at, place, last
            while at < len(audit) and audit[at] == "I":
                last = "a" if last == "u" else "u"
                at, place = at + 1, place + 1
                yield now, place, "insert", None, GIVEN[last], ""

        for conv_id, turn, role, text, copies, given in _rows(
            batches, ["conv_id", "turn", "role", "text", "copies", "audit"]
        ):
            if given is not None:
                if now is not NOTHING:
                    yield from inserts()
                now, audit, at, place, last = conv_id, given, 0, 0, ""
                continue
            for _ in range(copies):
                yield from inserts()
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                place += 1
                last = role[:1] if letter == "K" else "a" if last == "u" else "u"
                yield now, place, "keep" if letter == "K" else "rerole", turn, role if letter == "K" else GIVEN[last], text
        if now is not NOTHING:
            yield from inserts()

    return _batches(turns(), schema)


def _arrow(df: DataFrame, columns: str) -> tuple[str, pa.Schema]:
    """Spark and Arrow schema of `columns`, where {0} is the type of conv_id."""
    ddl = columns.format(dict(df.dtypes)["conv_id"])
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def ordered_rows(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with their faults, dealt by conversation.

    Null role or text is one space. One shuffle by conv_id, then sorts that spill: no conversation is held in memory. Order is
    turn (nulls first), then role and text, so equal rows are neighbours. A row without copies stands
    only for its conversation.
    """
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    same = Window.partitionBy("conv_id", "there", "said").orderBy(F.asc_nulls_first("turn"))
    stripped = F.rtrim("text", F.lit(BLANKS))
    return (
        conversations.select(
            "conv_id", "turn",
            F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies",
        )
        .withColumn("said", said)
        .withColumn("there", F.col("copies") > 0)
        .withColumn("blank", stripped == "")
        .withColumn("cut", ~F.substring(stripped, -1, 1).isin(*ENDS))
        .repartition("conv_id")
        .withColumn("repeated", F.row_number().over(same) > 1)
        .select("conv_id", "turn", "role", "text", "copies", "repeated", "blank", "cut")
    )


def find_repairs(rows: DataFrame) -> DataFrame:
    """One row per conversation of `ordered_rows`: faults, cheapest cost, audit, SHA-256 of the repaired turns.

    The audit has a letter for each edit in order: Keep, Rerole, Delete, Insert. Among edits of equal cost the
    ASCII-least audit is taken. A task streams over its sorted rows and keeps one entry per LR state, so a very
    long conversation takes time but no memory beyond its audit.
    """
    ddl, schema = _arrow(rows, FINDING)
    ordered = rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(lambda batches: _find(batches, schema), ddl)


def repaired_turns(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """The conversations after their audits: (conv_id, place from 1, action, turn, role, text)."""
    ddl, schema = _arrow(rows, TURN)
    audits = findings.select("conv_id", "audit")
    both = rows.unionByName(audits, allowMissingColumns=True).repartition("conv_id")
    ordered = both.sortWithinPartitions(
        "conv_id", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "text"
    ).select("conv_id", "turn", "role", "text", "copies", "audit")
    return ordered.mapInArrow(lambda batches: _apply(batches, schema), ddl)


def repair(conversations: DataFrame) -> DataFrame:
    """Findings for a table (conv_id, turn, role, text); see `find_repairs`.

    Null role or text counts as one space, null conv_id is a conversation of its own, other columns are not read. Repeated
    rows are duplicates. An empty table gives no rows.
    """
    return find_repairs(ordered_rows(conversations.withColumn("copies", F.lit(1))))


def damaged(conversations: DataFrame) -> DataFrame:
    """The table with faults that a hash of conv_id and turn picks; dropped rows have no copies."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    pick = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(pick == 0, "").when(pick == 4, "user").otherwise(role).alias("role"),
        F.when(pick.isin(0, 1), "").when(pick == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(pick == 0, 0).when(pick == 3, 2).otherwise(1).alias("copies"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation of `conversations`, after the damage of the contract."""
    return find_repairs(ordered_rows(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
