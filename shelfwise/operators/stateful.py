"""Truly sequential rules per key.

Whether a request hits an entry or finds a token depends on what happened to the one before it, so
no aggregate can express it. Rows are dealt by ranges of (key, time) into blocks of about equal size,
so a hot key fills many blocks and small keys share one. A block is walked along time from the state in
which the rows before it have left the key.

Those states come from one pass. What a block does to a state is a function with few pieces: on each
piece the end state is the start state moved by a constant, or a constant. Blocks of keys that cross
a border between blocks give their functions, all in parallel; the functions of a key are then applied one
after another, which reads a few numbers per block and no rows. A second pass walks all
blocks. What is written does not depend on how long a key stays overloaded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators import scan
from shelfwise.operators.scan import PART
from shelfwise.runtime import staged

# Rows of a block, about.
ROWS_PER_BLOCK = 1_000_000


@dataclass(frozen=True)
class StateMap:
    """End state by start state: the first edge that is not below the start names the piece.

    A piece with `moves` adds its value to the start, another one is its value. No start (None) acts as the first edge,
    which is the time of the first row.
    """

    edges: np.ndarray
    moves: np.ndarray
    values: np.ndarray

    def __call__(self, start: int | None) -> int:
        start = int(self.edges[0]) if start is None else start
        piece = int(np.searchsorted(self.edges, start, side="left"))
        value = int(self.values[piece])
        return start + value if self.moves[piece] else value


@dataclass(frozen=True)
class Rule:
    """`walk(times, start, ok=ok)` gives a flag per row and the end state; `state_map(times, ok=ok)` all end states.

    ok: whether what a row does succeeds. A state is a time; at and after it, it says no more than None.
    """

    walk: Callable[..., tuple[np.ndarray, int]]
    state_map: Callable[..., StateMap]


def _runs(batch: pd.DataFrame, key: str) -> Iterator[tuple[tuple, slice]]:
    """Consecutive rows of one (key, block) in a sorted batch. Null keys are one key."""
    keys, blocks = batch[key], batch[PART].to_numpy()
    codes = pd.factorize(keys, use_na_sentinel=True)[0]
    cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    edges = [0, *cuts.tolist(), len(batch)]
    for first, last in zip(edges, edges[1:]):
        one = keys.iloc[first]
        yield (None if pd.isna(one) else one, blocks[first]), slice(first, last)


def _flagged(batches: Iterator[pd.DataFrame], key: str, rule: Rule) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Each batch with its flags; only the state of the current block is held."""
    current, state = None, None
    for batch in batches:
        if batch.empty:
            continue
        times, ok, starts = batch["at"].to_numpy(), batch["ok"].to_numpy(dtype=bool), batch["start"]
        flags = np.zeros(len(batch), dtype=bool)
        for block, rows in _runs(batch, key):
            if block != current:
                start = starts.iloc[rows.start]
                current, state = block, None if pd.isna(start) else int(start)
            flags[rows], state = rule.walk(times[rows], state, ok=ok[rows])
        yield batch, flags


def _maps(batches: Iterator[pd.DataFrame], key: str, rule: Rule) -> Iterator[pd.DataFrame]:
    """The state map of each block; the times of one block are held."""
    current, times, oks = None, [], []

    def row() -> pd.DataFrame:
        found = rule.state_map(np.concatenate(times), ok=np.concatenate(oks))
        return pd.DataFrame(
            {key: [current[0]], PART: [current[1]], "edges": [found.edges], "moves": [found.moves], "ends": [found.values]}
        )

    for batch in batches:
        if batch.empty:
            continue
        at, ok = batch["at"].to_numpy(), batch["ok"].to_numpy(dtype=bool)
        for block, rows in _runs(batch, key):
            if block != current:
                if current is not None:
                    yield row()
                current, times, oks = block, [], []
            times.append(at[rows])
            oks.append(ok[rows])
    if current is not None:
        yield row()


def _starts(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Maps sorted by (key, block) to the start state of the block that follows each of them."""
    current, state = None, None
    for batch in batches:
        out = []
        for one, following, edges, moves, ends in zip(
            *(batch[c] for c in (key, "following", "edges", "moves", "ends")), strict=True
        ):
            one = None if pd.isna(one) else one
            if current is None or current[0] != one:
                current, state = (one,), None
            state = StateMap(np.asarray(edges), np.asarray(moves), np.asarray(ends))(state)
            out.append((one, following, state))
        yield pd.DataFrame(out, columns=[key, PART, "start"])


def _start_states(blocks: DataFrame, key: str, rule: Rule) -> DataFrame | None:
    """(key, block, start) of all blocks of a key but its first; None if no key has two.

    Only a key that crosses a border between two blocks is here, so there are fewer rows than blocks.
    """
    of_key = Window.partitionBy(key)
    crossing = staged(
        blocks.select(key, PART)
        .groupBy(key, PART)
        .agg(F.count("*").alias("n"))
        .withColumn("following", F.lead(PART).over(of_key.orderBy(PART)))
        .where(F.col("following").isNotNull())
        .select(key, PART, "following"),
        "crossing",
    )
    if crossing.isEmpty():
        return None
    kind = dict(blocks.dtypes)[key]
    rows = scan.join_null_safe(blocks, F.broadcast(crossing), [key, PART])
    maps = _in_order(rows, key).mapInPandas(
        lambda batches: _maps(batches, key, rule),
        f"{key} {kind}, {PART} int, edges array<bigint>, moves array<boolean>, ends array<bigint>",
    )
    # The maps are made by many tasks; one task per key then reads them.
    maps = scan.join_null_safe(staged(maps, "maps"), F.broadcast(crossing), [key, PART])
    starts = (
        maps.repartition(key)
        .sortWithinPartitions(key, PART)
        .mapInPandas(lambda batches: _starts(batches, key), f"{key} {kind}, {PART} int, start bigint")
    )
    return staged(starts, "starts")


def _in_order(blocks: DataFrame, key: str) -> DataFrame:
    return blocks.repartition(key, PART).sortWithinPartitions(key, PART, "at", "tie")


def walk(
    rows: DataFrame,
    key: str,
    at: str,
    tie: str,
    rule: Rule,
    rows_per_block: int = ROWS_PER_BLOCK,
    ok: Column | None = None,
) -> DataFrame:
    """Adds `flag`, what the walk says of each row. `at` is an integer time, `tie` orders equal ones.

    A row without a time has no place in the order: it changes nothing and its flag is null.
    """
    done = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    timed = rows.select(key, F.col(at).alias("at"), F.col(tie).alias("tie"), done.alias("ok"))
    blocks = scan.parted(timed.where("at IS NOT NULL"), [key], ["at", "tie"], rows_per_block)
    starts = _start_states(blocks, key, rule)
    if starts is None:
        known = blocks.withColumn("start", F.lit(None).cast("bigint"))
    else:
        known = scan.join_null_safe(blocks, F.broadcast(starts), [key, PART], "left")

    def flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, flags in _flagged(batches, key, rule):
            yield batch[[key, "at", "tie"]].set_axis([key, at, tie], axis=1).assign(flag=flags)

    types = dict(rows.dtypes)
    flagged = _in_order(known, key).mapInPandas(
        flag, f"{key} {types[key]}, {at} bigint, {tie} {types[tie]}, flag boolean"
    )
    untimed = rows.where(F.col(at).isNull()).select(key, at, tie, F.lit(None).cast("boolean").alias("flag"))
    return flagged.unionByName(untimed)
