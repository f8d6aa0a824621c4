"""Hashed word shingles of whole texts, many texts at a time with numpy.

Words are runs of bytes that are not ASCII white space, A-Z lower-cased. A word's hash is a polynomial of its bytes,
read from running sums over the text; a shingle's hash mixes the hashes of its words in order. All are 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZE = 5
# Bytes of text that are hashed at a time; what a task holds besides the batch itself.
BLOCK = 1 << 20
SLICE = 8 << 20

_ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers over all bits; no two numbers become one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte (A-Z as a-z), and which bytes are white space."""
    byte = np.arange(256, dtype=np.uint64)
    byte[65:91] += np.uint64(32)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return mix(byte + np.uint64(0x51ED270B)) | _ONE, space


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    steps = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    for step in steps:
        step[0] = 1
    return np.cumprod(steps[0]), np.cumprod(steps[1])


def _word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first place of each word; no word goes beyond an edge."""
    values, space = _tables()
    filled = ~space[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, filled[:-1]
    before[edges[edges < len(data)]] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, filled[1:]
    inner = edges[(edges > 0) & (edges <= len(data))]
    after[inner - 1] = False
    starts, ends = np.flatnonzero(filled & ~before), np.flatnonzero(filled & ~after)
    size = 1 << max(16, int(len(data)).bit_length())
    power, inverse = _powers(size)
    sums = np.cumsum(values[data] * power[: len(data)])
    found = sums[ends] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return mix(found * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie one after the other, and the number of words up to each text's start."""
    _, space = _tables()
    hashes, places, start = [], [], 0
    while start < len(data):
        stop = min(len(data), start + BLOCK)
        while stop < len(data):  # not inside a word
            gap = np.flatnonzero(space[data[stop : stop + BLOCK]])
            stop = stop + int(gap[0]) if len(gap) else min(len(data), stop + BLOCK)
            if len(gap):
                break
        inside = offsets[(offsets >= start) & (offsets <= stop)] - start
        found, at = _word_hashes(data[start:stop], inside)
        hashes.append(found)
        places.append(at + start)
        start = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    places_of_all = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(places_of_all, offsets)


def shingle_hashes(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The hashes of all runs of `size` words; of fewer words, but not none, the whole as one."""
    if 0 < len(words) < size:
        found = np.uint64(len(words)) + np.zeros(1, np.uint64)
        for word in words:
            found = mix(found * np.uint64(0x9E3779B97F4A7C15) + word)
        return found
    found = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        found = mix(found * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k])
    return found


def slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about SLICE bytes together; a longer text is a part of its own."""
    lengths = pc.fill_null(pc.binary_length(batch[name]), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, length in enumerate(lengths):
        if total and total + length > SLICE:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(length)
    if start < batch.num_rows:
        yield batch.slice(start)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts one after the other, and where each starts and the last ends; null is empty."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def shingle_sets(column: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """For each text its distinct shingles, ascending."""
    data, offsets = buffer_of(column)
    words, starts = word_hashes(data, offsets)
    whole = shingle_hashes(words, size) if len(words) >= size else np.zeros(0, np.uint64)
    sets = []
    for first, last in zip(starts[:-1], starts[1:]):
        sets.append(np.unique(whole[first : last - size + 1] if last - first >= size else shingle_hashes(words[first:last], size)))
    return sets
