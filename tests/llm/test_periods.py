import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from placebook.llm import periods
from placebook.llm.queries import op13_periodic_runs


def plain_runs(words):
    """All periods one by one: maximal stretches in which words a period apart are equal, of the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                found.setdefault((i, length), q)  # the smallest period comes first
            i = j
    # A longer period of the same stretch, or of a part of it, is no smallest period.
    return sorted((i, length, q) for (i, length), q in found.items() if not any(words[i + p : i + length] == words[i : i + length - p] for p in range(1, q)))


def plain_collapsed(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs))


def made(rng, n, letters):
    words = []
    while len(words) < n:
        piece = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
        words += piece * rng.choice((1, 1, 2, 4, 5, 7))
        words = words[: len(words) - rng.randrange(0, 3)]
    return words[:n]


def test_runs_equal_plain_ones():
    rng = random.Random(7)
    for n in [*range(0, 14), *[rng.randrange(14, 160) for _ in range(1500)]]:
        words = made(rng, n, [b"a", b"b", b"c", b"d", b"e"][: rng.randrange(1, 6)])
        runs = periods.runs_of(words)
        assert runs == plain_runs(words), words
        assert periods.collapsed(words, runs) == plain_collapsed(words, runs)
        whole = sorted(periods.runs_of_stretch(periods.numbered(words)))
        assert whole == runs  # the same without leaving stretches out


def test_suffixes_are_sorted():
    rng = random.Random(3)
    for _ in range(300):
        words = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 40))])
        order, common = periods.sorted_suffixes(words)
        suffixes = sorted(range(len(words)), key=lambda i: words[i:].tolist())
        assert order.tolist() == suffixes
        for k in range(1, len(words)):
            a, b = words[order[k - 1] :].tolist(), words[order[k] :].tolist()
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == same


def test_positions_stay_in_order(monkeypatch):
    monkeypatch.setattr(periods, "POSITIONS", 4)
    rng = random.Random(1)
    numbers = rng.sample(range(1000), 300)
    positions, known = periods.Positions(numbers[0]), [numbers[0]]
    for number in numbers[1:]:
        before, after = positions.add(number)
        assert before == max((k for k in known if k < number), default=None)
        assert after == min((k for k in known if k > number), default=None)
        known.append(number)
    assert list(positions) == sorted(numbers) and max(map(len, positions.blocks)) <= 4


@pytest.mark.parametrize("words", [[b"a"] * 30_000, [b"a", b"b"] * 20_000, ([b"x"] * 500 + [b"y"]) * 60, [str(i % 7001).encode() for i in range(30_000)]])
def test_long_texts(words):
    runs = periods.runs_of(words)
    assert (0, len(words)) in {(start, length) for start, length, _ in runs}


def test_words_end_at_ascii_blanks_only():
    assert periods.words_of("a\u00a0b\x1cc\x85d\x0be \r\n\x0c\tf") == ["a\u00a0b\x1cc\x85d".encode(), b"e", b"f"]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected_row(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *row, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(plain_collapsed(words, runs)))


def test_query_equals_plain_rows(spark, sf_dir):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {row.doc_id: tuple(row) for row in op13_periodic_runs(spark, sf_dir).select(*names).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        if len((text or "").split()) < 600:
            assert got[doc_id] == expected_row(doc_id, text)
    assert sum(row[1] > 0 for row in got.values()) > 3


def test_odd_rows_and_columns(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a a a a a a a"), (5, "x " * 50_000), (6, "a b a b a b a b c"), (6, "a b a b a b a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("runs"), F.lit("k").alias("found"), F.lit(3).alias("a.b"))
    got = periods.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "found", "a.b", "runs", "collapsed"]
    found = {row.doc_id: row for row in got.collect()}
    assert [found[i].collapsed for i in (1, 2, 3)] == ["", "", ""] and all(found[i].runs == [] for i in (1, 2, 3))
    assert found[None].collapsed == "a" and tuple(found[5].runs[0]) == (0, 50_000, 1)
    assert [tuple(r) for r in found[6].runs] == [(0, 8, 2)] and found[6].collapsed == "a b c" and got.where("doc_id = 6").count() == 2
    assert periods.periodic_runs(docs.limit(0)).collect() == []
