"""The language of a text by a small convolutional network over its bytes.

A text is cut into windows of a fixed number of bytes. Filters of several widths slide over a window; of each the largest
value counts, and a softmax over a linear layer of these gives the window's chance of each language. A text's chances are
those of all its windows, weighted by their letters. As the input is one of 256 values, a filter is a table of what each
byte at each of its places adds, so applying it is looking up rows and adding them.

The network is trained in numpy, on the driver, from a bounded sample of windows of labelled texts; it is applied by
tasks to batches of windows, so that memory does not depend on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from placebook.operators.joins import named, own_name
from placebook.session import materialize

# Bytes of a window, filter widths (ascending), filters of each.
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
# Learned languages at most, the most frequent; labelled texts and windows that are learned from, at most about so many in
# all and as many of each language.
LANGUAGES = 200
TEXTS = 4_000
WINDOWS_OF_A_TEXT = 4
EPOCHS = 12
BATCH = 128
RATE = 0.01
# Windows that are computed at a time: what they need stays in a processor's cache.
AT_A_TIME = 16

# The language of a text without letters.
NONE = "und"

# Bytes as the network sees them: A-Z like a-z, digits alike, control characters and blanks alike; 0 fills up windows.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[ord("0") : ord("9") + 1] = ord("0")
FOLD[:33] = ord(" ")
# Bytes that are of letters: ASCII letters and all beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[ord("a") : ord("z") + 1] = LETTERS[128:] = True


def windows_of(data: bytes | memoryview) -> np.ndarray:
    """The windows of a text's UTF-8 bytes one after the other, folded, the last filled up with 0; at least one."""
    folded = FOLD[np.frombuffer(data, np.uint8)]
    count = max(1, -(-len(folded) // WINDOW))
    found = np.zeros(count * WINDOW, np.uint8)
    found[: len(folded)] = folded
    return found.reshape(count, WINDOW)


def _softmax(values: np.ndarray) -> np.ndarray:
    raised = np.exp(values - values.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


@dataclass
class Network:
    """`tables[k]` has for each byte what it adds at place k of a filter, for all filters wider than k; these are the last
    ones, as filters are in ascending order of their widths. Places beyond a window's end add nothing.
    """

    languages: list[str]
    tables: list[np.ndarray]
    shifts: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], rng: np.random.Generator) -> Network:
        numbers = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        tables = [numbers(256, FILTERS * sum(width > k for width in WIDTHS)) for k in range(max(WIDTHS))]
        filters = FILTERS * len(WIDTHS)
        return cls(languages, tables, np.zeros(filters, np.float32), numbers(filters, len(languages)), np.zeros(len(languages), np.float32))

    def _sums(self, windows: np.ndarray) -> np.ndarray:
        """What each filter gives at each place of each window."""
        x = windows.astype(np.intp)
        total = np.take(self.tables[0], x, axis=0, mode="clip")
        for k, table in enumerate(self.tables[1:], 1):
            total[:, :-k, -table.shape[1] :] += np.take(table, x[:, k:], axis=0, mode="clip")
        return total

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """The largest value of each filter in each window, at least 0."""
        return np.maximum(self._sums(windows).max(axis=1) + self.shifts, 0)

    def chances(self, windows: np.ndarray) -> np.ndarray:
        return _softmax(self.pooled(windows) @ self.weights + self.bias)

    def train(self, windows: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> None:
        """Adam on the cross entropy; only the places where a filter had its largest value learn."""
        values = [*self.tables, self.shifts, self.weights, self.bias]
        first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        step, filters = 0, len(self.shifts)
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(windows))
            for batch in np.array_split(order, max(1, -(-len(order) // BATCH))):
                x, n = windows[batch], len(batch)
                places, largest = np.zeros((n, filters), np.int64), np.zeros((n, filters), np.float32)
                for i in range(0, n, AT_A_TIME):
                    sums = self._sums(x[i : i + AT_A_TIME])
                    places[i : i + AT_A_TIME] = sums.argmax(axis=1)
                    largest[i : i + AT_A_TIME] = sums.max(axis=1)
                pooled = np.maximum(largest + self.shifts, 0)
                error = _softmax(pooled @ self.weights + self.bias)
                error[np.arange(n), labels[batch]] -= 1
                error /= n
                back = (error @ self.weights.T) * (pooled > 0)
                slopes = []
                for k, table in enumerate(self.tables):
                    slope, count = np.zeros_like(table), table.shape[1]
                    at = places[:, -count:] + k
                    inside = at < WINDOW
                    bytes_there = np.take_along_axis(x, np.minimum(at, WINDOW - 1), axis=1)
                    np.add.at(slope, (bytes_there, np.arange(count)), back[:, -count:] * inside)
                    slopes.append(slope)
                slopes += [back.sum(axis=0), pooled.T @ error, error.sum(axis=0)]
                step += 1
                for value, slope, m, v in zip(values, slopes, first, second):
                    m += 0.1 * (slope - m)
                    v += 0.01 * (slope * slope - v)
                    value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def judge(self, texts: Iterator[bytes | memoryview]) -> tuple[np.ndarray, np.ndarray]:
        """The number of the likeliest language of each text, and its chance."""
        waiting, owners, sums, n_waiting = [], [], [], 0

        def flush() -> None:
            nonlocal waiting, owners, n_waiting
            if waiting:
                x, owner = np.concatenate(waiting), np.concatenate(owners)
                for i in range(0, len(x), AT_A_TIME):
                    part = x[i : i + AT_A_TIME]
                    weighted = self.chances(part) * (LETTERS[part].sum(axis=1) + 0.01)[:, None]
                    inside = owner[i : i + AT_A_TIME]
                    starts = np.flatnonzero(np.diff(inside, prepend=-1))
                    for text, row in zip(inside[starts].tolist(), np.add.reduceat(weighted, starts, axis=0)):
                        sums[text] += row
            waiting, owners, n_waiting = [], [], 0

        for data in texts:
            found = windows_of(data)
            sums.append(np.zeros(len(self.languages)))
            waiting.append(found)
            owners.append(np.full(len(found), len(sums) - 1))
            n_waiting += len(found)
            if n_waiting >= 64 * AT_A_TIME:
                flush()
        flush()
        totals = np.array(sums).reshape(-1, len(self.languages))
        best = totals.argmax(axis=1)
        return best, totals[np.arange(len(totals)), best] / np.maximum(totals.sum(axis=1), 1e-30)


# --- Spark -----------------------------------------------------------------------------------------------------------


def is_held_out(doc_id: Column) -> Column:
    """The rows that are never learned from; rows without an id are none of them, and are not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _draw(*parts) -> Column:
    """A number from 0 to 1 by a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def training_windows(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, windows, numbers of their languages) of labelled rows that are not held out: about TEXTS texts, as
    many of each language, chosen by a hash of their ids, and up to WINDOWS_OF_A_TEXT windows of each.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")) & has_letter(F.col("text")))
    known = known.select("doc_id", "text", "lang")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = sorted(counts.agg(F.collect_list(F.struct("lang", "n"))).first()[0])
    if not counts:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    share = {row.lang: min(1.0, TEXTS / len(counts) / row.n) for row in counts}
    shares = F.create_map(*[F.lit(v) for pair in share.items() for v in pair])
    chosen = known.where(_draw(F.col("doc_id"), F.lit(1)) < F.coalesce(shares[F.col("lang")], F.lit(0.0)))

    @F.arrow_udf("array<binary>")
    def drawn(ids: pa.Array, texts: pa.Array) -> pa.Array:
        found = []
        for i, text in zip(ids.to_pylist(), texts):
            windows = windows_of(text.as_buffer())
            rng = np.random.default_rng(i % (1 << 32))
            places = rng.permutation(len(windows))[:WINDOWS_OF_A_TEXT]
            found.append([windows[p].tobytes() for p in sorted(places.tolist()) if LETTERS[windows[p]].any()])
        return pa.array(found, pa.list_(pa.binary()))

    seed = F.xxhash64("doc_id")
    rows = chosen.select("lang", drawn(seed, F.col("text")).alias("windows"))
    rows = materialize(rows.select("lang", F.explode("windows").alias("window")), "language-windows")
    languages = sorted(share)
    pairs = sorted((row.lang, bytes(row.window)) for row in rows.agg(F.collect_list(F.struct("lang", "window"))).first()[0])
    numbers = {language: i for i, language in enumerate(languages)}
    windows = np.frombuffer(b"".join(window for _, window in pairs), np.uint8).reshape(-1, WINDOW)
    return languages, windows, np.array([numbers[language] for language, _ in pairs], np.int64)


def learn(docs: DataFrame) -> Network | None:
    """A network of the labelled rows of `docs` that are not held out; None where there are none."""
    languages, windows, labels = training_windows(docs)
    if not languages:
        return None
    rng = np.random.default_rng(1)
    network = Network.new(languages, rng)
    network.train(windows, labels, rng)
    return network


def predicted(network: Network | None, text: Column) -> Column:
    """A struct of `lang_pred` and `score`: the likeliest learned language and its chance; `und` and 0 for a null text, one
    without a letter, and where nothing was learned.
    """
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    none = F.struct(F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    if network is None:
        return none

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judged(texts: pa.Array) -> pa.Array:
        best, chance = network.judge(text.as_buffer() if text.is_valid else b"" for text in texts)
        names = pa.array(network.languages).take(pa.array(best, pa.int64()))
        return pa.StructArray.from_arrays([names.cast(pa.string()), pa.array(np.clip(chance, 0, 1), pa.float64())], fields=list(kind))

    return F.when(has_letter(text), judged(text)).otherwise(none)


def languages(docs: DataFrame) -> DataFrame:
    """`docs` with the columns held_out, lang_pred and score, which replace any of the same names; needs doc_id, text and
    lang. Learns from rows with a text, an id and a lang that are not held out. Every row stays, repeated ones included; a
    null text, one without a letter, and every text where nothing could be learned is `und` with a score of 0. Texts are
    judged whole, whatever their length; ties go to the language that sorts first.
    """
    network = learn(docs)
    found = predicted(network, F.col("text"))
    others = [named(name) for name in docs.columns if name not in ("held_out", "lang_pred", "score")]
    judged = own_name("judged")
    done = docs.select(*others, is_held_out(F.col("doc_id")).alias("held_out"), found.alias(judged))
    return done.select(*others, "held_out", F.col(f"{judged}.lang_pred").alias("lang_pred"), F.col(f"{judged}.score").alias("score"))
