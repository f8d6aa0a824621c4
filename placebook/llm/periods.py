"""Runs: stretches of words that repeat with a period, by uniting suffixes in the order of descending common prefixes.

Suffixes of a text's words are sorted; neighbours with a common prefix of l words are united, the longest prefixes first,
so that after a length l a class has all positions at which the same l words start. Each class keeps its positions in
order. Where two positions i < j become neighbours in a class and j - i = q is at most l, the words from i to j + l repeat
with period q: they seed a run. A run of at least twice its period has such a pair at its very start, for positions
between would give it a smaller period, and no seed has a period that is not the smallest, for the same reason. So a seed
whose word before i differs from that q later is a whole run, once.

Only words in stretches that can hold a long enough run are sorted: each three words in a row of such a run are found
again at a distance of at most a quarter of the stretch.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placebook.operators.joins import named, own_name

# A run has at least so many words, and at least so many times its period.
LEAST_WORDS = 6
LEAST_PERIODS = 4
# Positions of a class are kept in blocks of at most so many.
POSITIONS = 1024


def words_of(text: str | None) -> list[bytes]:
    """What stands between ASCII blanks, in UTF-8; bytes.split() takes just 09-0D and 20 for blanks."""
    return (text or "").encode().split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers, from 0 in the order of their first places."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(word, len(seen)) for word in words), np.int64, len(words))


# --- where runs can be ------------------------------------------------------------------------------------------------


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Pairs of numbers as numbers of the same order."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Parts (first, end) of the words, apart from each other, of which one holds each long enough run with all its words."""
    n = len(words) - 2
    if n < LEAST_WORDS - 2:
        return []
    triples = _ranks(_ranks(words[:-2], words[1:-1]), words[2:])
    order = np.argsort(triples, kind="stable")
    same = triples[order[1:]] == triples[order[:-1]]
    gaps = np.full(n + 1, n + 9, np.int64)  # to the next or last place of the same three words, the nearer
    distance = (order[1:] - order[:-1])[same]
    gaps[order[:-1][same]] = distance
    gaps[order[1:][same]] = np.minimum(gaps[order[1:][same]], distance)
    gaps = gaps[:n]
    able = gaps <= (n + 2) // LEAST_PERIODS
    while able.any():
        edges = np.flatnonzero(np.diff(np.concatenate(([0], able.view(np.int8), [0]))))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        most = np.where(lengths >= LEAST_WORDS - 2, (lengths + 2) // LEAST_PERIODS, 0)
        still = able.copy()
        still[able] = gaps[able] <= np.repeat(most, lengths)
        if (still == able).all():
            return [(a, a + length + 2) for a, length in zip(starts.tolist(), lengths.tolist())]
        able = still
    return []


# --- suffixes ---------------------------------------------------------------------------------------------------------


def sorted_suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes sorted, and the common prefix of each with the one before it (0 for the first).

    Ranks by the first 1, 2, 4, ... words are kept until all differ, and give the common prefixes afterwards.
    """
    n = len(words)
    ranks = [np.unique(words, return_inverse=True)[1]]
    width = 1
    while width < n and ranks[-1].max() < n - 1:
        following = np.zeros(n, np.int64)
        following[: n - width] = ranks[-1][width:] + 1
        ranks.append(_ranks(ranks[-1], following))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    first, second, common = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = (first + (1 << level) <= n) & (second + (1 << level) <= n)
        equal = inside & (ranks[level][np.minimum(first, n - 1)] == ranks[level][np.minimum(second, n - 1)])
        first[equal] += 1 << level
        second[equal] += 1 << level
        common[1:][equal] += 1 << level
    return order, common


class Positions:
    """Numbers in order, in blocks, so that adding one moves a block at most."""

    __slots__ = ("blocks", "size")

    def __init__(self, position: int):
        self.blocks, self.size = [[position]], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, position: int) -> tuple[int | None, int | None]:
        """Adds a new number; the numbers before and after it."""
        blocks = self.blocks
        b = bisect_left(blocks, position, key=lambda block: block[-1]) if len(blocks) > 1 else 0
        b = min(b, len(blocks) - 1)
        block = blocks[b]
        place = bisect_left(block, position)
        before = block[place - 1] if place else blocks[b - 1][-1] if b else None
        after = block[place] if place < len(block) else blocks[b + 1][0] if b + 1 < len(blocks) else None
        block.insert(place, position)
        self.size += 1
        if len(block) > POSITIONS:
            blocks[b : b + 1] = [block[: POSITIONS // 2], block[POSITIONS // 2 :]]
        return before, after


def runs_of_stretch(words: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) within a sequence of words."""
    order, common = sorted_suffixes(words)
    least = min(max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q) for q in range(1, LEAST_WORDS))
    edges = np.flatnonzero(common >= least)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    classes: dict[int, Positions] = {}  # by the suffix that stands for the class
    above: dict[int, int] = {}
    found = []

    def top(i: int) -> int:
        while above.setdefault(i, i) != i:
            above[i] = i = above[above[i]]
        return i

    def seed(i: int | None, j: int | None, length: int) -> None:
        if i is not None and j is not None and j - i <= length:
            q = j - i
            if q + length >= max(LEAST_WORDS, LEAST_PERIODS * q) and (i == 0 or words[i - 1] != words[j - 1]):
                found.append((i, q + length, q))

    for edge, length in zip(edges.tolist(), common[edges].tolist()):
        one, two = top(int(order[edge - 1])), top(int(order[edge]))
        large, small = (classes.setdefault(i, Positions(i)) for i in (one, two))
        if large.size < small.size:
            one, two, large, small = two, one, small, large
        above[two] = one
        del classes[two]
        # In ascending order: what comes before a position is final, what comes after it only where the next comes later.
        last = later = None
        for position in small:
            before, after = large.add(position)
            if later is not None and later < position:
                seed(last, later, length)
            if before != last:
                seed(before, position, length)
            last, later = position, after
        seed(last, later, length)
    return found


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text's words, by start, then period: stretches of the smallest period q that
    no neighbouring word extends, of at least LEAST_WORDS words and LEAST_PERIODS times q.
    """
    numbers = numbered(words)
    return sorted(((first + i, length, q) for first, end in stretches(numbers) for i, length, q in runs_of_stretch(numbers[first:end])), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those that any run contains after its first period."""
    changes = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        changes[start + q] += 1
        changes[start + length] -= 1
    return b" ".join([word for word, inside in zip(words, np.cumsum(changes).tolist()) if not inside]) if runs else b" ".join(words)


RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
ROW = pa.struct([("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def periodic_runs(docs: DataFrame, arrange: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """`docs` with two columns that replace any of the same names: `runs`, an array of (start, length, period) by start, then
    period, in words from 0; and `collapsed`, the words joined by blanks without those that repeat earlier periods of a run.

    Needs doc_id and text. Words are what stands between ASCII blanks; a null or empty text has none, no runs, and an empty
    `collapsed`. Every row stays, repeated ones included. A row is worked on by itself, in memory that grows with its text.
    `arrange` may change the words of a row, given its doc_id, before runs are looked for.
    """

    @F.arrow_udf("struct<runs:array<struct<start:long,length:long,period:long>>,collapsed:string>")
    def found(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for doc_id, text in zip(ids.to_pylist(), texts):
            words = words_of(text.as_py())
            if arrange is not None:
                words = arrange(doc_id, words)
            runs = runs_of(words)
            rows.append({"runs": [dict(zip(("start", "length", "period"), run)) for run in runs], "collapsed": collapsed(words, runs).decode()})
        return pa.array(rows, ROW)

    others, name = [named(column) for column in docs.columns if column not in ("runs", "collapsed")], own_name("found")
    done = docs.select(*others, found(F.col("doc_id").cast("long"), F.col("text")).alias(name))
    return done.select(*others, F.col(f"{name}.runs").alias("runs"), F.col(f"{name}.collapsed").alias("collapsed"))
