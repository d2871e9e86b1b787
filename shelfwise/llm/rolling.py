"""Hashes of words and byte windows of many texts at once, in numpy, for use inside Arrow tasks.

A hash is a polynomial in random byte values modulo 2**64, so that every window's hash comes from two
prefix sums. Work goes on in slices of about a megabyte: memory is a small multiple of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
# Bytes of words hashed at a time: few enough for the processor's caches.
HASHED_BYTES = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32
WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# ASCII characters that are neither letters nor digits.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
PUNCTUATION_BYTES = PUNCTUATION.astype(np.uint8).tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n-1); the longest answer so far is kept."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        _powers[int(base)] = kept
    return kept[:n]


class Prefix:
    """Prefix sums over some bytes; `windows` gives the hash of each [start, end)."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES.take(data) * powers(BASE, len(data)), out=self.sums[1:])
        self.shift = powers(INVERSE, len(data) + 1)

    def windows(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.shift[start])


class Flat(NamedTuple):
    """The UTF-8 bytes of all texts of a batch, and where each text begins (one more at the end)."""

    data: np.ndarray
    offsets: np.ndarray


def flat(texts: pa.Array) -> Flat:
    """Nulls count as empty texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return Flat(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `most` bytes of text; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    which = np.cumsum(lengths) // most
    edges = np.flatnonzero(np.diff(which)) + 1
    for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        if end > start:
            yield batch.slice(start, end - start)


class Words(NamedTuple):
    """Words of a batch in order: byte range, row of the batch, hash."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def find_words(text: Flat, separator: np.ndarray, folded: np.ndarray) -> Words:
    """Maximal runs of non-separator bytes, never across texts; hashed over the `folded` bytes."""
    inside = ~separator
    first, last = inside.copy(), inside.copy()
    first[1:] &= separator[:-1]
    last[:-1] &= separator[1:]
    filled = np.flatnonzero(np.diff(text.offsets))
    begins, ends = text.offsets[filled], text.offsets[filled + 1] - 1
    first[begins] = inside[begins]
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.repeat(np.arange(len(text.offsets) - 1), np.diff(np.searchsorted(start, text.offsets)))
    return Words(start, end, row, word_hashes(folded, start, end))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + HASHED_BYTES, side="right")))
        low, high = start[i], end[j - 1]
        out[i:j] = Prefix(data[low:high]).windows(start[i:j] - low, end[i:j] - low)
        i = j
    return out


def spaced_words(texts: pa.Array) -> Words:
    """Words between ASCII white space, with A-Z in lower case."""
    text = flat(texts)
    return find_words(text, WHITE_SPACE[text.data], LOWER_ASCII[text.data])


def plain_words(texts: pa.Array) -> Words:
    """Words of letters and digits in lower case: ASCII punctuation and the general punctuation of
    Unicode (U+0080 to U+00BF, U+2000 to U+207F, U+3000 to U+303F) separate."""
    text = flat(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    data = text.data
    separator = np.frombuffer(bytearray(data.tobytes().translate(PUNCTUATION_BYTES)), bool)
    lead = np.flatnonzero(data[:-1] >= 0xC2)
    two = lead[data[lead] == 0xC2]
    lead = lead[lead < len(data) - 2]
    first, second = data[lead], data[lead + 1]
    three = lead[
        ((first == 0xE2) & ((second == 0x80) | (second == 0x81)))
        | ((first == 0xE3) & (second == 0x80))
    ]
    separator[two] = separator[two + 1] = True
    separator[three] = separator[three + 1] = separator[three + 2] = True
    return find_words(text, separator, data)


class Grams(NamedTuple):
    hash: np.ndarray
    row: np.ndarray
    at: np.ndarray  # index of the first word


def grams(words: Words, n: int, short: bool) -> Grams:
    """All runs of n words of each text. short: a text of fewer words counts as one run of them all."""
    h, row = words.hash, words.row
    m = max(0, len(h) - n + 1)
    value = h[:m].copy()
    for k in range(1, n):
        value = value * BASE + h[k : k + m]
    at = np.flatnonzero(row[:m] == row[n - 1 :]) if m else np.zeros(0, np.int64)
    value, found = mix(value[at]), row[at]
    if short and len(h):
        firsts = np.flatnonzero(np.diff(row, prepend=-1))
        sizes = np.diff(firsts, append=len(h))
        few = firsts[sizes < n]
        if len(few):
            extra = np.array(
                [mix(np.array([sum((i + 2) * int(x) for i, x in enumerate(h[f : f + s])) % (1 << 64)], np.uint64))[0]
                 for f, s in zip(few, sizes[sizes < n], strict=True)], np.uint64,
            )
            value, found, at = np.append(value, extra), np.append(found, row[few]), np.append(at, few)
            order = np.argsort(at, kind="stable")
            value, found, at = value[order], found[order], at[order]
    return Grams(value, found, at)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose rows take `counts` values each, in order."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
