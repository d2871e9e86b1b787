"""Removes repeated and nearly repeated lines: SimHash, pigeonhole blocks, edit similarity, connected groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import rolling
from shelfwise.llm.graph import components
from shelfwise.llm.names import spare
from shelfwise.runtime import staged

# Two lines are linked if their SimHashes differ in at most MAX_BITS bits and their edit similarity,
# 1 - distance / longer length, is at least SIMILARITY. Equal normalised lines are always linked.
MAX_BITS = 3
SIMILARITY = 0.8
# 64 bits in BLOCKS blocks: at most MAX_BITS of them differ, so BLOCKS - MAX_BITS agree. A key is such a
# choice of blocks, about 26 bits.
BLOCKS = 5
# Size of the parts of a large set of lines; a task compares at most two parts.
PART_LINES, PART_BYTES = 512, 2_000_000
MANY = 2048

# Candidate pairs are sifted SIFTED at a time, and a task verifies the sets of about BUCKET_BYTES of lines. BLOCK
# characters of a line at a time are searched in the other line, for lines up to SEARCHED characters, some SEARCHES
# blocks at once.
SIFTED, BUCKET_BYTES = 8192, 4_000_000
# Text whose lines are hashed at a time: so little that numpy's arrays stay in the caches.
PIECE_BYTES = 1 << 19
# SimHashes that a task deals out by their keys at a time, and keys of a bucket.
DEALT, BUCKET_KEYS = 1 << 18, 400_000
BLOCK, SEARCHED, SEARCHES = 64, 4096, 4096
BINS = 128

EDGES = np.linspace(0, 64, BLOCKS + 1).round().astype(int)
CHOICES = list(combinations(range(BLOCKS), BLOCKS - MAX_BITS))
MASKS = [
    int(np.uint64(sum(((1 << int(EDGES[b + 1] - EDGES[b])) - 1) << int(EDGES[b]) for b in chosen)).view(np.int64))
    for chosen in CHOICES
]


def normal_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of all texts in lower case with every run of digits as 0, and the row of each."""
    lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    rows = pc.list_parent_indices(lines).to_numpy()
    flat = pc.replace_substring_regex(pc.utf8_lower(pc.list_flatten(lines)), r"\d+", "0")
    return flat, rows


# The 8 bits of a byte, one in each byte of a word.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def _majority(hashes: np.ndarray, edges: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per segment, the bits that most of its hashes have."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if counts.max() < 256:
        # Eight counters of 8 bits in one sum.
        ones = np.stack([np.add.reduceat(SPREAD[octets[:, k]], edges) for k in range(8)], axis=1).view(np.uint8)
    else:
        ones = np.add.reduceat(np.unpackbits(octets, axis=1, bitorder="little"), edges, axis=0, dtype=np.int32)
    return np.packbits(ones > (counts // 2)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def line_keys(words: rolling.Words) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, 128-bit hash of their word sequence)."""
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    edges = np.flatnonzero(np.diff(words.row, prepend=-1))
    counts = np.diff(edges, append=len(words.hash))
    place = (np.arange(len(words.hash)) - np.repeat(edges, counts)).astype(np.uint64)
    first = rolling.mix(words.hash + place * rolling.BASE)
    second = rolling.mix(words.hash ^ rolling.mix(place + np.uint64(977)))
    key = np.stack([np.add.reduceat(first, edges), np.add.reduceat(second, edges)], axis=1)
    return words.row[edges], key


def simhash(words: rolling.Words) -> np.ndarray:
    """64-bit SimHash over the words of each line that has one."""
    if not len(words.hash):
        return np.zeros(0, np.uint64)
    edges = np.flatnonzero(np.diff(words.row, prepend=-1))
    counts = np.diff(edges, append=len(words.hash))
    if counts.max() < 256:
        return _majority(words.hash, edges, counts)
    out = np.empty(len(edges), np.uint64)
    for chosen in (counts < 256, counts >= 256):
        sizes = counts[chosen]
        if len(sizes):
            out[chosen] = _majority(words.hash[np.repeat(chosen, counts)], np.cumsum(sizes) - sizes, sizes)
    return out


def _lines(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rolling.pieces(batch, "text", PIECE_BYTES):
                flat, rows = normal_lines(part.column("text"))
                words = rolling.plain_words(flat)
                filled, key = line_keys(words)
                keys = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(16), len(key), [None, pa.py_buffer(np.ascontiguousarray(key))]
                ).cast(pa.binary())
                if with_text:
                    text = flat.take(pa.array(filled)).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([keys, text], ["line", "text"])
                    continue
                row = rows[filled]
                firsts = np.searchsorted(rows, np.arange(part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array(simhash(words).view(np.int64)),
                        part.column("doc_key").take(pa.array(row)),
                        part.column("doc_id").take(pa.array(row)),
                        pa.array(filled - firsts[row], pa.int32()),
                        pc.binary_length(flat).take(pa.array(filled)).cast(pa.int32()),
                        pa.array(np.bincount(row, minlength=part.num_rows)[row], pa.int32()),
                    ],
                    ["line", "sim", "doc_key", "doc_id", "at", "n_bytes", "n_lines"],
                )

    return run


class Forest:
    """Union of sets of 0..n-1; the smallest member stands for its set."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.find(x), self.find(y)))
        self.parent[y] = x


def close(sims: np.ndarray, forest: Forest, members: np.ndarray) -> None:
    """Join members of sims with at most MAX_BITS different bits. A large set is first cut by a further
    pigeonhole, over MAX_BITS + 1 parts of the word, so that not all pairs are compared."""
    if len(members) > MANY:
        edges = np.linspace(0, 64, MAX_BITS + 2).round().astype(int)
        for low, high in zip(edges, edges[1:], strict=False):
            part = (sims[members] >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)
            order = np.argsort(part, kind="stable")
            for same in np.split(members[order], np.flatnonzero(np.diff(part[order])) + 1):
                if len(same) > 1:
                    _close_all(sims, forest, same)
    else:
        _close_all(sims, forest, members)


def _close_all(sims: np.ndarray, forest: Forest, members: np.ndarray) -> None:
    own = sims[members]
    for k in range(len(members) - 1):
        near = np.flatnonzero(np.bitwise_count(own[k + 1 :] ^ own[k]) <= MAX_BITS)
        for x in near:
            forest.join(members[k], members[k + 1 + x])


def _small_stars(sim: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, home) of many segments of the same size at once: the smallest place spreads from hash to close hash."""
    at_once = (1 << 20) // size**2
    for k in range(0, len(starts), at_once):
        own = np.sort(sim[starts[k : k + at_once, None] + np.arange(size)], axis=1).view(np.uint64)
        near = np.bitwise_count(own[:, :, None] ^ own[:, None, :]) <= MAX_BITS
        some = np.count_nonzero(near, axis=(1, 2)) > size
        own, near = own[some], near[some]
        root, before = np.broadcast_to(np.arange(size), own.shape), None
        while before is None or (root != before).any():
            root, before = np.where(near, root[:, None, :], size).min(axis=2), root
        flat, sims = (root + np.arange(len(own))[:, None] * size).ravel(), own.ravel()
        sets = np.zeros(len(sims), np.uint64)
        np.add.at(sets, flat, rolling.mix(sims))
        near = np.bincount(flat, minlength=len(sims))[flat] > 1
        yield sims[near], sims[flat[near]], sets[flat[near]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by number and chosen bits: per key, its sets of close SimHashes as (a, b, home), with b the
    smallest hash of the set of a and home a hash of all members, the same for equal sets of other keys. One
    key's hashes, 8 bytes each, are held at a time."""
    masks = np.array(MASKS, np.int64)
    kept_number, kept = np.zeros(0, np.int8), np.zeros(0, np.int64)

    def edges(sim: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(sim)]])
        two = starts[ends - starts == 2]
        one, other = sim[two], sim[two + 1]
        near = np.bitwise_count((one ^ other).view(np.uint64)) <= MAX_BITS
        one, other = one[near], other[near]
        least, sets = np.minimum(one, other).view(np.uint64), rolling.mix(one.view(np.uint64)) + rolling.mix(other.view(np.uint64))
        a, b, home = [one.view(np.uint64), other.view(np.uint64)], [least, least], [sets, sets]
        sizes = ends - starts
        for size in range(3, min(int(sizes.max(initial=0)), 64) + 1):
            for star in _small_stars(sim, starts[sizes == size], size):
                for column, new in zip((a, b, home), star, strict=True):
                    column.append(new)
        for i in np.flatnonzero(sizes > 64):
            sims = np.unique(sim[starts[i] : ends[i]]).view(np.uint64)
            forest = Forest(len(sims))
            close(sims, forest, np.arange(len(sims)))
            roots = np.array([forest.find(x) for x in range(len(sims))])
            sets = np.zeros(len(sims), np.uint64)
            np.add.at(sets, roots, rolling.mix(sims))
            near = np.flatnonzero(np.bincount(roots, minlength=len(sims))[roots] > 1)
            a.append(sims[near])
            b.append(sims[roots[near]])
            home.append(sets[roots[near]])
        none = [np.zeros(0, np.uint64)]
        columns = [pa.array(np.concatenate(none + x).view(np.int64)) for x in (a, b, home)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "home"])

    def borders(number: np.ndarray, sim: np.ndarray) -> np.ndarray:
        return np.flatnonzero((np.diff(number) != 0) | (np.diff(sim & masks[number]) != 0)) + 1

    for batch in batches:
        number = np.concatenate([kept_number, batch.column("number").to_numpy()])
        sim = np.concatenate([kept, batch.column("sim").to_numpy()])
        cuts = borders(number, sim)
        last = int(cuts[-1]) if len(cuts) else 0
        yield edges(sim[:last], cuts[:-1])
        kept_number, kept = number[last:], sim[last:]
    yield edges(kept, borders(kept_number, kept))


def _dealt(buckets: int):
    """(bucket, numbers, sims): for each number the SimHashes by a hash of their chosen bits, packed as bytes. For
    number 0 a hash of several lines is sent twice."""

    def deal(sims: np.ndarray) -> pa.RecordBatch:
        sims, counts = np.unique(sims, return_counts=True)
        salts = rolling.BASE * np.arange(len(MASKS), dtype=np.uint64)
        keys = np.concatenate([(sims & mask).view(np.uint64) ^ salt for mask, salt in zip(MASKS, salts, strict=True)])
        bucket = (rolling.mix(keys) % np.uint64(buckets)).astype(np.int32)
        number = np.repeat(np.arange(len(MASKS), dtype=np.int8), len(sims))
        several = np.flatnonzero(counts > 1)
        bucket, number, sims = (
            np.concatenate([x, x[several]]) for x in (bucket, number, np.tile(sims, len(MASKS)))
        )
        order = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")
        bucket = bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        offsets = np.append(starts, len(bucket))
        packed = [
            pa.Array.from_buffers(
                pa.binary(), len(starts), [None, pa.py_buffer((offsets * x.itemsize).astype(np.int32)), pa.py_buffer(x[order])]
            )
            for x in (number, sims)
        ]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), *packed], ["bucket", "numbers", "sims"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("sim").to_numpy())
            n += len(held[-1])
            if n >= DEALT:
                yield deal(np.concatenate(held))
                held, n = [], 0
        if n:
            yield deal(np.concatenate(held))

    return run


def _bucket_stars(table: pa.Table) -> pa.Table:
    """The stars of a bucket's keys, and (sim, sim, null) for each SimHash of several lines."""
    numbers, sims = (
        np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("numbers", np.int8), ("sims", np.int64))
    )
    several, sorted_numbers, sorted_sims = np.zeros(0, np.int64), [], []
    for number, mask in enumerate(MASKS):
        own, counts = np.unique(sims[numbers == number], return_counts=True)
        if number == 0:
            several = own[counts > 1]
        sorted_sims.append(own[np.argsort(own & mask)])
        sorted_numbers.append(np.full(len(own), number, np.int8))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(sorted_numbers)), pa.array(np.concatenate(sorted_sims))], ["number", "sim"]
    )
    alone = pa.RecordBatch.from_arrays([several, several, pa.nulls(len(several), pa.int64())], ["a", "b", "home"])
    return pa.Table.from_batches([*_stars(iter([batch])), alone])


def _common(most: int, equal: Callable[[int], bool]) -> int:
    """Largest k up to `most` with equal(k), which holds for all smaller ones."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if equal(middle) else (low, middle - 1)
    return low


# How many words of either line to pass over, the fewest first.
SKIPS = [(p, n - p) for n in (2, 1, 3, 4, 5, 6) for p in sorted(range(n + 1), key=lambda p, n=n: abs(2 * p - n))]


def _few_words(a: str, b: str, most: float) -> bool:
    """Whether replacing runs of words, one after the other, makes b of a with at most `most` characters. False says
    nothing: there may be a shorter way."""
    x, y = a.split(" "), b.split(" ")
    own = set(x)
    if 2 * len(own.intersection(y)) < len(own):
        return False
    i = j = 0
    cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p, q = next(((p, q) for p, q in SKIPS if x[i + p : i + p + 2] == y[j + q : j + q + 2] != []), (1, 1))
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        if cost > most:
            return False
        i, j = i + p, j + q
    return cost + max(sum(map(len, x[i:])) + len(x) - i, sum(map(len, y[j:])) + len(y) - j) <= most


def edit_similar(a: str, b: str, least: float) -> bool:
    """Whether 1 - Levenshtein distance / longer length >= least (bit-parallel, one step per character)."""
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    most = (1 - least) * len(a) + 1e-9
    if len(a) - len(b) > most:
        return False
    # What both begin and end with adds no distance.
    same = _common(len(b), lambda k: a[:k] == b[:k])
    a, b = a[same:], b[same:]
    same = _common(len(b), lambda k: a[len(a) - k :] == b[len(b) - k :])
    a, b = a[: len(a) - same], b[: len(b) - same]
    if len(a) <= most or _few_words(a, b, most):
        return True
    if not b:
        return False
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    every, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    up, down, distance = every, 0, len(b)
    for i, c in enumerate(a):
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right_up = down | (~(diagonal | up) & every)
        right_down = up & diagonal
        if right_up & top:
            distance += 1
        elif right_down & top:
            distance -= 1
        if distance - (len(a) - 1 - i) > most:
            return False
        right_up = (right_up << 1 | 1) & every
        right_down = (right_down << 1) & every
        up = right_down | (~(diagonal | right_up) & every)
        down = right_up & diagonal
    return distance <= most


def _bags_apart(codes: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance of lines i and j: characters that one has and the other lacks."""
    lines, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    rows = np.repeat(np.arange(len(lines)), [len(codes[k]) for k in lines])
    bags = np.bincount(rows * BINS + np.concatenate([codes[k] for k in lines]), minlength=len(lines) * BINS)
    bags = bags.reshape(-1, BINS).astype(np.int32)
    more = bags[at[: len(i)]] - bags[at[len(i) :]]
    return np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))


def _blocks_apart(
    a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None
) -> np.ndarray:
    """A lower bound of the edit distance of a and b, where it is at most `most`: each block of BLOCK characters of a is
    searched where it can stand in b, and the least distances are added (one 64-bit word per block, all at once).
    Blocks before `first` and from `last` on add nothing."""
    n = np.array([len(x) // BLOCK for x in a], np.int64)
    first = np.zeros_like(n) + first
    n = np.maximum((n if last is None else last) - first, 0)
    pair = np.repeat(np.arange(len(a)), n)
    begin = (np.arange(len(pair)) - np.repeat(np.cumsum(n) - n - first, n)) * BLOCK
    own = np.concatenate([x[f * BLOCK : (f + k) * BLOCK] for x, f, k in zip(a, first.tolist(), n.tolist(), strict=True)])
    own = own.reshape(-1, BLOCK)
    rows = np.arange(len(pair)) * (BINS + 1)
    masks = np.zeros(len(pair) * (BINS + 1), np.uint64)  # the last one of a block is of a character that is nowhere
    for k in range(BLOCK):
        masks[rows + own[:, k]] |= np.uint64(1) << np.uint64(k)
    sizes = np.array([len(x) for x in b])
    offsets = np.cumsum(sizes) - sizes
    low = np.maximum(begin - most[pair], 0)
    steps = int((np.minimum(begin + BLOCK + most[pair], sizes[pair]) - low).max(initial=0))
    # A search that goes on after its own part of the text can only lower the bound.
    text = np.concatenate([*b, np.full(steps, BINS, np.uint8)]).astype(np.int64)
    at = low + offsets[pair]
    up, down = np.full(len(pair), ~np.uint64(0)), np.zeros(len(pair), np.uint64)
    score = np.full(len(pair), BLOCK, np.int64)
    best, one, top = score.copy(), np.uint64(1), np.uint64(BLOCK - 1)
    for _ in range(steps):
        match = masks.take(rows + text.take(at, mode="clip"), mode="clip")
        at += 1
        diagonal = (((match & up) + up) ^ up) | match
        vertical = match | down
        right_up = down | ~(diagonal | up)
        right_down = up & diagonal
        score += ((right_up >> top) - (right_down >> top)).view(np.int64)
        np.minimum(best, score, out=best)
        right_up <<= one
        right_down <<= one
        up = right_down | ~(vertical | right_up)
        down = right_up & vertical
    return np.bincount(pair, weights=best, minlength=len(a))


class Sieve:
    """Classes of similar lines: cheap bounds for many pairs at once, then the pairs that are left one by one."""

    def __init__(self, texts: list[str], similarity: float):
        self.texts, self.similarity = texts, similarity
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.forest = Forest(len(texts))

    def _most(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (1 - self.similarity) * np.maximum(self.lengths[i], self.lengths[j]) + 1e-9

    def _apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a lower bound shows that the lines are not similar."""
        codes = {
            k: (np.frombuffer(self.texts[k].encode("utf-32-le"), np.uint32) % BINS).astype(np.uint8)
            for k in set(i.tolist()) | set(j.tolist())
        }
        most = self._most(i, j)
        apart = _bags_apart(codes, i, j) > most
        long = np.maximum(self.lengths[i], self.lengths[j])
        rest = np.flatnonzero(~apart & (long >= BLOCK) & (long <= SEARCHED))
        # Those that a few other words tell to be similar need no search, and half of the blocks tell most unlike lines.
        rest = np.array([k for k in rest.tolist() if not self._alike(i[k], j[k], most[k])], np.int64)
        early = (self.lengths[i] // BLOCK + 1) // 2
        bound = np.zeros(len(i))
        for some in self._runs(rest, long):
            bound[some] = self._bound(codes, i[some], j[some], most[some], 0, early[some])
        apart[rest] = bound[rest] > most[rest]
        rest = rest[~apart[rest]]
        for some in self._runs(rest, long):
            bound[some] += self._bound(codes, i[some], j[some], most[some], early[some], None)
        apart[rest] = bound[rest] > most[rest]
        return apart

    @staticmethod
    def _runs(rest: np.ndarray, long: np.ndarray) -> list[np.ndarray]:
        """Pairs of similar length that have about SEARCHES blocks in half of each line."""
        rest = rest[np.argsort(long[rest], kind="stable")]
        blocks = np.cumsum(long[rest] // BLOCK) // (2 * SEARCHES)
        return np.split(rest, np.flatnonzero(np.diff(blocks)) + 1) if len(rest) else []

    @staticmethod
    def _bound(codes, i, j, most, first, last) -> np.ndarray:
        return _blocks_apart([codes[k] for k in i], [codes[k] for k in j], most.astype(np.int64), first, last)

    def _alike(self, i: int, j: int, most: float) -> bool:
        if self.forest.find(i) == self.forest.find(j):
            return True
        if _few_words(self.texts[i], self.texts[j], most):
            self.forest.join(int(i), int(j))
            return True
        return False

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the similar ones of the pairs (i, j)."""
        keep = np.abs(self.lengths[i] - self.lengths[j]) <= self._most(i, j)
        i, j = i[keep], j[keep]
        for k in range(0, len(i), SIFTED):
            find = self.forest.find
            some = np.array([k + x for x, (p, q) in enumerate(zip(i[k : k + SIFTED].tolist(), j[k : k + SIFTED].tolist(), strict=True)) if find(p) != find(q)], np.int64)
            if not len(some):
                continue
            for p, q in zip(*(x[some][~apart].tolist() for apart in [self._apart(i[some], j[some])] for x in (i, j)), strict=True):
                if find(p) != find(q) and edit_similar(self.texts[p], self.texts[q], self.similarity):
                    self.forest.join(p, q)


def _linked(forest: Forest, lines: list[bytes]) -> pa.Table:
    """Edges from members to the smallest of their set."""
    roots = [forest.find(i) for i in range(len(lines))]
    far = [i for i, root in enumerate(roots) if root != i]
    return pa.table(
        {"a": pa.array([lines[i] for i in far], pa.binary()), "b": pa.array([lines[roots[i]] for i in far], pa.binary())}
    )


def _verify(similarity: float):
    """Of each set, all pairs of part 0 and another part; those inside part 0 belong to the first other part."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("home", "ascending"), ("other", "ascending"), ("line", "ascending")])
        lines, texts = table.column("line").to_pylist(), table.column("text").to_pylist()
        sims = table.column("sim").to_numpy().view(np.uint64)
        home, other, part = (table.column(c).to_numpy() for c in ("home", "other", "part"))
        sieve = Sieve(texts, similarity)
        edges = [0, *(np.flatnonzero((np.diff(home) != 0) | (np.diff(other) != 0)) + 1), len(lines)]
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for start, end in zip(edges, edges[1:], strict=False):
            i, j = np.triu_indices(end - start, 1)
            i, j = i + start, j + start
            near = np.bitwise_count(sims[i] ^ sims[j]) <= MAX_BITS
            if other[start] > 1:
                near &= (part[i] != 0) | (part[j] != 0)
            waiting.append((i[near], j[near]))
            held += len(waiting[-1][0])
            if held >= SIFTED or end == len(lines):
                sieve.add(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting, held = [], 0
        return _linked(sieve.forest, lines)

    return run


def _verify_rest(similarity: float):
    """Lines of the rest against the lines of a part, unless both have one class already."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("line")
        lines, texts = table.column("line").to_pylist(), table.column("text").to_pylist()
        sims = table.column("sim").to_numpy().view(np.uint64)
        root = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        others = np.flatnonzero(~asks)
        sieve = Sieve(texts, similarity)
        waiting, held = [], 0
        for i in np.flatnonzero(asks):
            near = others[(np.bitwise_count(sims[others] ^ sims[i]) <= MAX_BITS) & (root[others] != root[i])]
            waiting.append((np.full(len(near), i), near))
            held += len(near)
            if held >= SIFTED:
                sieve.add(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting, held = [], 0
        if waiting:
            sieve.add(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
        return _linked(sieve.forest, lines)

    return run


def _parts(n: Column, n_bytes: Column) -> Column:
    return F.greatest(F.ceil(n / PART_LINES), F.ceil(n_bytes / PART_BYTES), F.lit(1))


def _homes(once: DataFrame) -> DataFrame:
    """(line, sim, home, parts): the sets of lines in which every pair of close SimHashes stands together.

    A connected group of SimHashes that fits one part is a set as a whole. A larger one, which may be a long
    chain, is compared by the sets of its keys instead.
    """
    buckets = once.count() * len(CHOICES) // BUCKET_KEYS + 1
    stars = staged(
        once.select("sim").mapInArrow(_dealt(buckets), "bucket int, numbers binary, sims binary")
        .groupBy("bucket").applyInArrow(_bucket_stars, "a long, b long, home long").distinct(),
        "stars",
    )
    # All other lines are far from every line.
    groups = components(stars.select("a", "b")).select(F.col("node").alias("sim"), F.col("root").alias("group"))
    near = stars.select(F.col("a").alias("sim")).distinct().join(groups, "sim", "left")
    grouped = once.select("line", "sim", "n_bytes").join(near, "sim").withColumn("group", F.coalesce("group", "sim"))
    sizes = (
        grouped.groupBy("group")
        .agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
        .select("group", _parts(F.col("n"), F.col("bytes")).alias("parts"))
    )
    wanted = staged(grouped.join(sizes, "group"), "wanted-lines")
    small = wanted.where("parts = 1").select("line", "sim", F.col("group").alias("home"), F.col("parts"))
    large = (
        wanted.where("parts > 1")
        .join(stars.where(F.col("home").isNotNull()).select(F.col("a").alias("sim"), "home"), "sim", "left")
        .select("line", "sim", F.coalesce("home", "sim").alias("home"), "n_bytes")
    )
    sizes = large.groupBy("home").agg(_parts(F.count("*"), F.sum("n_bytes")).alias("parts"))
    return staged(small.unionByName(large.join(sizes, "home").select("line", "sim", "home", "parts")), "homes")


def line_classes(once: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(line, root) of all lines that are linked to another one.

    Each part of a set is compared with itself and with part 0, so rows grow with the set. Then only the lines
    outside the largest class found so far are compared with the other parts: pairs inside one class
    are connected already.
    """
    homes = _homes(once)
    read = staged(
        texts.join(homes.select("line"), "line", "left_semi").groupBy("line").agg(F.min("text").alias("text")), "line-texts"
    )
    part = F.pmod(F.xxhash64("line"), F.col("parts"))
    others = F.when((F.col("part") == 0) & (F.col("parts") > 1), F.sequence(F.lit(1).cast("long"), F.col("parts") - 1))
    parted = homes.withColumn("part", part)
    tasks = parted.withColumn("other", F.explode(F.coalesce(others, F.array("part")))).join(read, "line")
    volume = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(2 * volume // BUCKET_BYTES) + 1
    first = components(
        tasks.select("home", "other", "part", "line", "sim", "text")
        .groupBy(F.pmod(F.xxhash64("home", "other"), F.lit(buckets)))
        .applyInArrow(_verify(similarity), "a binary, b binary")
    ).select(F.col("node").alias("line"), "root")

    members = staged(
        parted.where("parts > 2").join(first, "line", "left").withColumn("root", F.coalesce("root", "line")), "large-sets"
    )
    main = members.groupBy("home", "root").agg(F.count("*").alias("n")).groupBy("home").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    rest = members.join(main, "home").where(F.col("root") != F.col("main"))
    if rest.isEmpty():
        return first
    rests = rest.groupBy("home").agg(F.ceil(F.count("*") / PART_LINES).alias("rests"))
    asking = rest.join(rests, "home").select(
        "home", F.pmod(F.xxhash64("line", F.lit(1)), F.col("rests")).alias("at"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts") - 1)).alias("other"),
        "part", "line", "sim", "root", F.lit(True).alias("asks"),
    ).where(F.col("other") != F.col("part"))
    asked = members.where("part > 0").join(rests, "home").select(
        "home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)).alias("at"),
        F.col("part").alias("other"), "part", "line", "sim", "root", F.lit(False).alias("asks"),
    )
    more = (
        asking.unionByName(asked).drop("part").join(read, "line")
        .groupBy("home", "at", "other").applyInArrow(_verify_rest(similarity), "a binary, b binary")
    )
    known = first.select(F.col("line").alias("a"), F.col("root").alias("b"))
    return components(known.unionByName(more)).select(F.col("node").alias("line"), "root")


def document_key():
    """One key for all rows with the same doc_id and text: such repeated rows count as one document."""
    return F.unhex(
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))))
    )


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, text): all lines with a word (doc_key, doc_id, at, and n_lines of the document), and the repeated
    ones (doc_key, at), as often as the row of the document.

    `at` counts the \\n-split lines of a text from 0. Lines are compared in lower case without punctuation
    and with digits as 0. Of each connected group the occurrence with the smallest (doc_id, at) stays; a
    null doc_id comes last. Lines without a word are never repeated.
    """
    ids = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).withColumn("doc_key", document_key())
    id_type = ids.schema["doc_id"].dataType.simpleString()
    lines = staged(
        ids.select("doc_id", "doc_key", "text").mapInArrow(
            _lines(False), f"line binary, sim long, doc_key binary, doc_id {id_type}, at int, n_bytes int, n_lines int"
        ),
        "lines",
    )
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "at", "doc_key")
    once = staged(
        lines.groupBy("line").agg(
            F.first("sim").alias("sim"), F.min(place).alias("first"), F.count("*").alias("n"),
            F.max("n_bytes").alias("n_bytes"),
        ),
        "distinct-lines",
    )
    texts = ids.select("text").mapInArrow(_lines(True), "line binary, text string")
    classes = line_classes(once, texts, similarity)
    # Lines that stand once and have no other of their class take no part in what follows.
    rooted = (
        once.select("line", "first", "n").join(classes, "line", "left")
        .where((F.col("n") > 1) | F.col("root").isNotNull())
        .withColumn("root", F.coalesce("root", "line"))
    )
    firsts = rooted.groupBy("root").agg(F.min("first").alias("stays"), F.sum("n").alias("total")).where("total > 1")
    stays = rooted.join(firsts, "root").select("line", "stays")
    repeated = lines.join(stays, "line").where(
        ~(
            (F.col("stays.at") == F.col("at"))
            & (F.col("stays.doc_key") == F.col("doc_key"))
        )
    )
    return lines, repeated.select("doc_key", "at")


def _rebuild(gone_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column("text").to_pylist(), batch.column(gone_name).to_pylist()
            for i, at in enumerate(gone):
                if at:
                    at = set(at)
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in at)
            names = [n for n in batch.schema.names if n != gone_name]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` without repeated lines; a document that loses its last line with a word goes.

    All columns stay as they are but `text`, and `n_chars` where there is one. Documents that had no word
    (null and empty texts) stay as they are.
    """
    key, gone_at, lost = spare(docs, "line_key", "lines_gone", "lost_lines")
    _, repeated = repeated_lines(docs, similarity)
    gone = repeated.groupBy("doc_key").agg(F.collect_set("at").alias(gone_at))
    joined = docs.withColumn(key, document_key()).join(gone.withColumnRenamed("doc_key", key), key, "left")
    rebuilt = joined.drop(key).withColumn(lost, F.col(gone_at).isNotNull())
    schema = rebuilt.drop(gone_at).schema
    rebuilt = rebuilt.mapInArrow(_rebuild(gone_at), schema)
    rebuilt = rebuilt.where(~F.col(lost) | F.col("text").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rebuilt = rebuilt.withColumn(
            "n_chars", F.when(F.col(lost), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return rebuilt.select(docs.columns)


def line_report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document with a line with a word: doc_id, n_lines, n_removed, removed (line numbers).

    Repeated rows with the same doc_id and text are one document.
    """
    lines, repeated = repeated_lines(docs, similarity)
    counts = lines.groupBy("doc_key").agg(F.first("doc_id").alias("doc_id"), F.max("n_lines").cast("long").alias("n_lines"))
    gone = repeated.groupBy("doc_key").agg(F.sort_array(F.collect_set("at")).alias("removed"))
    none = F.array().cast("array<int>")
    return counts.join(gone, "doc_key", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", none).alias("removed"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
