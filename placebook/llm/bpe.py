"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a piece of bytes is determined by one token per prefix: the last token of that prefix's own encoding.
Of all tokens that end at a place exactly one goes together with the last token of the prefix before it, so the table
is filled from left to right and never has to be revised when bytes are appended. After an edit only the places near
it are computed anew: once as many places in a row as the longest token has bytes agree with the old table, all later
ones do.

Two neighbouring tokens go together if encoding their joined bytes gives these two. A sequence is an encoding if all
its neighbours go together: the first merge across a border would also happen in the encoding of the two alone.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A vocabulary is sent to every executor; a larger file is refused.
VOCABULARY_BYTES = 64 << 20
# Encoded pieces, and checked pairs, that a task remembers before it starts afresh.
REMEMBERED = 300_000
# Characters of a piece that is remembered, and bytes of one that is encoded together with others.
SHORT = 64
# Characters of texts whose new pieces are encoded together.
TOGETHER = 2_000_000

# The characters that Unicode calls white space.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: lines of a token in base 64 and its rank."""
    ranks = {}
    for line in data.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class BytePairEncoder:
    """Encodes pieces of bytes by ranks: of all neighbours whose joined bytes have a rank, the lowest is merged first,
    the leftmost of equals. A piece that is itself in the vocabulary is one token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        missing = [byte for byte in range(256) if bytes([byte]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.parts: dict[int, tuple[int, int]] = {}
        self.sound = True
        reachable, joined = {}, {-1: -1}
        self.base = max(self.bytes_of) + 1
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            splits = [(ranks[token[:i]], ranks[token[i:]]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            joined.update((left * self.base + right, rank) for left, right in splits)
            if len(token) == 1:
                reachable[token] = rank
                continue
            # With lower ranks alone, which are done, the token's bytes become two parts that go together; else it is merged.
            halves = next((split for split in splits if self.sound and self._lower(split, rank) and self._check(*split, rank)), None)
            if halves is None:
                merged = self._merge(token, stop=2)
                if len(merged) != 2:
                    continue
                halves = ranks[merged[0]], ranks[merged[1]]
                self.sound &= halves[0] < rank or len(merged[0]) == 1
                self.sound &= halves[1] < rank or len(merged[1]) == 1
            self.parts[rank] = halves
            reachable[token] = rank
        keys = np.fromiter(joined, np.int64, len(joined))
        order = np.argsort(keys)
        self.joined, self.joined_ranks = keys[order], np.fromiter(joined.values(), np.int64, len(joined))[order]
        self.halves = np.full((2, self.base), -1, np.int64)
        for rank, halves in self.parts.items():
            self.halves[:, rank] = halves
        # For every beginning of a token that an encoding can have, the tokens that end where it ends, longest first, each
        # with its number of bytes.
        self.tails: dict[bytes, tuple[tuple[int, int], ...]] = {b"": ()}
        for begin in sorted({token[:i] for token in reachable for i in range(1, len(token) + 1)}, key=len):
            shorter = next(begin[i:] for i in range(1, len(begin) + 1) if begin[i:] in self.tails)
            own = ((len(begin), reachable[begin]),) if begin in reachable else ()
            self.tails[begin] = own + self.tails[shorter]
        self.automaton = Automaton(self.tails)
        self.longest = max(map(len, reachable))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.many = Pairs(self)
        self.pieces = Pieces(self)
        self.table = np.full(max(self.bytes_of) + 1, None, object)
        self.lengths = np.zeros(len(self.table), np.int64)
        for rank, token in self.bytes_of.items():
            self.table[rank], self.lengths[rank] = token, len(token)

    def _merge(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """Merges step by step until nothing can be merged or `stop` parts are left. Only for short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            found = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(((rank, i) for rank, i in found if rank is not None), default=(None, 0))
            if rank is None:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def go_together(self, left: int, right: int) -> bool:
        """Whether encoding the joined bytes of both tokens gives these two."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[left, right] = self._check(left, right)
        return known

    def _lower(self, split: tuple[int, int], rank: int) -> bool:
        """Whether both parts are single bytes or made by merges of lower rank."""
        return all(part in self.parts and part < rank or len(self.bytes_of[part]) == 1 for part in split)

    def _check(self, left: int, right: int, below: int = 1 << 62) -> bool:
        if not self.sound:
            a, b = self.bytes_of[left], self.bytes_of[right]
            return self._merge(a + b) == [a, b]
        # Undo the merges that made both tokens, latest first, and see whether the parts that met at the border would
        # have been merged across it before one of them was merged on its own side.
        until_left = until_right = below
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < until_left and across <= until_right:
                return False
            if left in self.parts and (right not in self.parts or left > right):
                until_left, left = left, self.parts[left][1]
            elif right in self.parts:
                until_right, right = right, self.parts[right][0]
            else:
                return True

    def check_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the tokens of each pair go together; undoes the merges of all pairs at a time."""
        if not self.sound:
            return np.array([self.go_together(*pair) for pair in zip(left.tolist(), right.tolist())], bool)
        result, rows = np.ones(len(left), bool), np.arange(len(left))
        until_left = until_right = np.full(len(left), 1 << 62)
        while rows.size:
            keys = left * self.base + right
            places = np.minimum(np.searchsorted(self.joined, keys), len(self.joined) - 1)
            across = self.joined_ranks[places]
            merged = (self.joined[places] == keys) & (across < until_left) & (across <= until_right)
            result[rows[merged]] = False
            in_left, in_right = self.halves[1, left], self.halves[0, right]
            undo_left = (in_left >= 0) & ((in_right < 0) | (left > right))
            undo_right = ~undo_left & (in_right >= 0)
            until_left, left = np.where(undo_left, left, until_left), np.where(undo_left, in_left, left)
            until_right, right = np.where(undo_right, right, until_right), np.where(undo_right, in_right, right)
            on = ~merged & (undo_left | undo_right)
            rows, left, right, until_left, until_right = (values[on] for values in (rows, left, right, until_left, until_right))
        return result

    def last_tokens(self, data: bytes, last: list[int] | None = None, until: int | None = None) -> list[int]:
        """For each prefix the last token of its encoding; goes on after the prefixes that `last` holds."""
        last = [] if last is None else last
        find, known = self.tails.get, self.pairs.get
        start = max(0, len(last) + 1 - self.longest)
        for end in range(len(last) + 1, (len(data) if until is None else until) + 1):
            # Bytes that begin no token do not either with more behind them.
            while (tails := find(data[start:end])) is None:
                start += 1
            for size, token in tails:
                if size == end:
                    break
                before = last[end - size - 1]
                together = known((before, token))
                if together or together is None and self.go_together(before, token):
                    break
            else:
                raise AssertionError("no token ends a prefix")
            last.append(token)
        return last

    def walk_back(self, last: list[int]) -> list[int]:
        tokens, end = [], len(last)
        while end:
            token = last[end - 1]
            tokens.append(token)
            end -= len(self.bytes_of[token])
        return tokens[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk_back(self.last_tokens(piece))

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of many pieces: the same table as of one piece, a place of all pieces at a time. Sorted pieces that
        begin alike share their table up to where they part.
        """
        found: list[bytes] = [b""] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                found[i] = struct.pack("<I", whole)
            elif len(piece) > SHORT:
                ids = self.encode_piece(piece)
                found[i] = struct.pack(f"<{len(ids)}I", *ids)
            elif piece:
                rest.append((piece, i))
        if not rest:
            return found
        rest.sort()
        sizes = np.array([len(piece) for piece, _ in rest], np.int64)
        longest, every = int(sizes.max()), np.arange(len(rest))
        data = np.array([piece for piece, _ in rest], f"S{longest}").view(np.uint8).reshape(len(rest), longest).T.copy()
        alike = np.zeros(len(rest), np.int64)
        alike[1:] = np.logical_and.accumulate(data[:, 1:] == data[:, :-1]).sum(axis=0)
        alike[1:] = np.minimum(alike[1:], np.minimum(sizes[1:], sizes[:-1]))
        last = np.full((longest + 1, len(rest)), -1, np.int32)
        states, automaton = np.zeros(len(rest), np.int64), self.automaton
        for end in range(1, longest + 1):
            own = (sizes >= end) & (alike < end)
            rows = np.flatnonzero(own)
            states[rows] = automaton.step(states[rows], data[end - 1, rows].astype(np.int64))
            tails = automaton.tail[states[rows]]
            while rows.size:
                tokens, starts = automaton.token[tails], end - automaton.size[tails]
                if not tails.all():
                    raise AssertionError("no token ends a prefix")
                fits, behind = starts == 0, np.flatnonzero(starts)
                fits[behind] = self.many.together(last[starts[behind], rows[behind]].astype(np.int64), tokens[behind])
                last[end, rows[fits]] = tokens[fits]
                rows, tails = rows[~fits], automaton.next_tail[tails[~fits]]
            shared = np.maximum.accumulate(np.where(own, every, 0))
            states, last[end] = states[shared], last[end, shared]
        self.many.remember()
        # From the ends back, a token of all pieces at a time.
        rows, ends, steps = every, sizes, []
        while rows.size:
            tokens = last[ends, rows]
            steps.append((rows, tokens))
            ends = ends - self.lengths[tokens]
            rows, ends = rows[ends > 0], ends[ends > 0]
        counts = np.bincount(np.concatenate([rows for rows, _ in steps]), minlength=len(rest))
        after = np.cumsum(counts)
        ids = np.empty(int(after[-1]), "<u4")
        for step, (rows, tokens) in enumerate(steps):
            ids[after[rows] - 1 - step] = tokens
        packed, borders = ids.tobytes(), [0, *(4 * after).tolist()]
        for (_, i), first, until in zip(rest, borders, borders[1:]):
            found[i] = packed[first:until]
        return found

    def decode(self, ids: Sequence[int] | np.ndarray) -> bytes:
        """The bytes of the ids; raises an error for an id that the vocabulary lacks."""
        return b"".join(self.table[np.asarray(ids, np.int64)])


class Automaton:
    """The beginnings of tokens as numbered states, for many pieces at once. After each byte a piece's state is the longest
    beginning that ends there; state 0 is the empty one.
    """

    def __init__(self, tails: dict[bytes, tuple[tuple[int, int], ...]]):
        number = {begin: i for i, begin in enumerate(tails)}
        own = {begin: bool(found) and found[0][0] == len(begin) for begin, found in tails.items()}
        self.size = np.array([len(begin) for begin in tails], np.int64)
        self.token = np.array([found[0][1] if own[begin] else -1 for begin, found in tails.items()], np.int64)
        fail, tail, next_tail = (np.zeros(len(tails), np.int64) for _ in range(3))
        keys = np.zeros(len(tails) - 1, np.int64)
        for i, begin in enumerate(tails):
            if i:
                keys[i - 1] = number[begin[:-1]] << 8 | begin[-1]
                fail[i] = next(number[begin[j:]] for j in range(1, len(begin) + 1) if begin[j:] in number)
                next_tail[i] = tail[fail[i]]
                tail[i] = i if own[begin] else next_tail[i]
        self.fail, self.tail, self.next_tail = fail, tail, next_tail
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], order + 1

    def step(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The states after one more byte each."""
        result, rows = np.empty_like(states), np.arange(len(states))
        while rows.size:
            keys = states << 8 | bytes_
            places = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[places] == keys
            result[rows[found]] = self.targets[places[found]]
            rows, states, bytes_ = rows[~found], self.fail[states[~found]], bytes_[~found]
        return result


class Pairs:
    """For many pairs of tokens at once whether they go together; what is known is kept as sorted numbers."""

    def __init__(self, encoder: BytePairEncoder):
        self.encoder, self.new = encoder, []
        self.known, self.verdicts = np.array([-1], np.int64), np.array([False])

    def together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.encoder.base + right
        places = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        verdicts, missing = self.verdicts[places], self.known[places] != keys
        if missing.any():
            new, where = np.unique(keys[missing], return_inverse=True)
            found = self.encoder.check_many(*np.divmod(new, self.encoder.base))
            self.new.append((new, found))
            verdicts[missing] = found[where]
        return verdicts

    def remember(self) -> None:
        """Takes over the pairs that were checked since the last time."""
        if len(self.known) > REMEMBERED:
            self.known, self.verdicts = self.known[:1], self.verdicts[:1]
        keys = np.concatenate([self.known, *(keys for keys, _ in self.new)])
        verdicts = np.concatenate([self.verdicts, *(found for _, found in self.new)])
        self.known, first = np.unique(keys, return_index=True)
        self.verdicts = verdicts[first]
        self.new.clear()


class Pieces(dict):
    """Packed ids of pieces of text. Once it is full, only pieces that come again are taken over to a new one."""

    def __init__(self, encoder: BytePairEncoder):
        super().__init__()
        self.encoder, self.earlier = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.earlier.pop(piece, None)
        if found is None:
            ids = self.encoder.encode_piece(piece.encode())
            found = struct.pack(f"<{len(ids)}I", *ids)
        self.keep(piece, found)
        return found

    def keep(self, piece: str, found: bytes) -> None:
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.earlier = dict(self)
                self.clear()
            self[piece] = found

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """The packed ids of texts that are given as their pieces. Short pieces that are new are encoded together."""
        new = [piece for piece in set().union(*texts) if piece not in self and piece not in self.earlier and len(piece) <= SHORT]
        for piece, found in zip(new, self.encoder.encode_pieces([piece.encode() for piece in new])):
            self.keep(piece, found)
        packed_ids = self.__getitem__
        return [b"".join(map(packed_ids, pieces)) for pieces in texts]


class EditedPiece:
    """The encoding of one piece that is appended to and edited, by merges alone (no lookup of the whole piece)."""

    def __init__(self, encoder: BytePairEncoder, data: bytes = b""):
        self.encoder, self.data = encoder, bytes(data)
        self.last = encoder.last_tokens(self.data)
        self.computed = len(self.last)

    def append(self, data: bytes) -> None:
        self.data += data
        self.encoder.last_tokens(self.data, self.last)
        self.computed += len(data)

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Puts `data` in place of the bytes from `start` to `stop`."""
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        last, agreed = old[:start], 0
        while len(last) < len(self.data):
            self.encoder.last_tokens(self.data, last, len(last) + 1)
            self.computed += 1
            place = len(last) - 1
            agreed = agreed + 1 if place >= start + len(data) and old[place - shift] == last[-1] else 0
            if agreed >= self.encoder.longest:
                last += old[place - shift + 1 :]
        self.last = last

    def tokens(self) -> list[int]:
        return self.encoder.walk_back(self.last)


def _characters(kind: str) -> str:
    """The characters of a Unicode category's first letter up to U+FFFF, as ranges of a character class."""
    ranges: list[list[int]] = []
    for code in range(0x10000):
        if unicodedata.category(chr(code))[0] == kind:
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\u{first:04x}-\\u{last:04x}" for first, last in ranges)


@cache
def splitter(pattern: str):
    """A function that gives all matches of the pattern in a text. `\\s` means Unicode's white space, as in tiktoken.

    Up to U+FFFF the classes of letters and numbers are written out, which the standard library's engine searches
    faster; texts with other characters take the engine that knows the classes.
    """
    spelled = re.sub(r"\\s(?=[^\[\]]*\])", lambda _: SPACES, pattern).replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")
    general = regex.compile(spelled)
    written = spelled
    for kind in "LN":
        inside = _characters(kind)
        written = re.sub(rf"\\p\{{{kind}\}}(?=[^\[\]]*\])", lambda _, c=inside: c, written).replace(rf"\p{{{kind}}}", f"[{inside}]")
    plain = re.compile(written)
    beyond = re.compile("[\U00010000-\U0010ffff]")
    return lambda text: (general if beyond.search(text) else plain).findall(text)


@cache
def _encoder(data: bytes) -> BytePairEncoder:
    return BytePairEncoder(read_ranks(data))


def load_vocabulary(spark: SparkSession, path: str):
    """The rank file, read once by the driver and sent to the executors; at most VOCABULARY_BYTES."""
    with open(path, "rb") as file:
        data = file.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def encode(vocabulary, pattern: str, text: Column) -> Column:
    """The text's ids as packed little-endian unsigned 32-bit integers, each match of the pattern encoded separately,
    without special tokens. A null or empty text has no ids.
    """

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        pieces, split = _encoder(vocabulary.value).pieces, splitter(pattern)
        packed_ids, waiting, characters = [], [], 0
        for item in texts:
            item = item.as_py() or ""
            waiting.append(split(item))
            characters += len(item)
            if characters >= TOGETHER:
                packed_ids += pieces.encode(waiting)
                waiting, characters = [], 0
        return pa.array(packed_ids + pieces.encode(waiting), pa.binary())

    return packed(text)


def decode(vocabulary, ids: Column) -> Column:
    """The bytes of packed ids; null stays null."""

    @F.arrow_udf("binary")
    def unpacked(column: pa.Array) -> pa.Array:
        encoder = _encoder(vocabulary.value)
        blobs = (item.as_py() for item in column)
        return pa.array([None if blob is None else encoder.decode(np.frombuffer(blob, "<u4")) for blob in blobs], pa.binary())

    return unpacked(ids)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with two more columns, replacing any of the same names: `ids`, the packed ids of the whole text, and
    `decoded`, the bytes that decoding them gives. Every row stays, repeated rows included; null counts as empty.
    """
    vocabulary = load_vocabulary(docs.sparkSession, path)
    encoded = docs.withColumn("ids", encode(vocabulary, pattern, F.col(f"`{text}`")))
    return encoded.withColumn("decoded", decode(vocabulary, F.col("ids")))
