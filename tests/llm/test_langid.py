import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from placebook.llm import langid
from placebook.llm.queries import op12_language_id


@pytest.fixture
def network():
    return langid.Network.new(["de", "en", "fr"], np.random.default_rng(4))


def plain_chances(network, window):
    """The softmax over the largest values of all filters, one place at a time."""
    pooled = []
    for f in range(len(network.shifts)):
        width = langid.WIDTHS[f // langid.FILTERS]
        largest = -math.inf
        for start in range(langid.WINDOW):
            total = 0.0
            for k in range(width):
                if start + k < langid.WINDOW:
                    column = f - (len(network.shifts) - network.tables[k].shape[1])
                    total += float(network.tables[k][window[start + k], column])
            largest = max(largest, total)
        pooled.append(max(0.0, largest + float(network.shifts[f])))
    out = [sum(p * float(network.weights[f, c]) for f, p in enumerate(pooled)) + float(network.bias[c]) for c in range(3)]
    raised = [math.exp(v - max(out)) for v in out]
    return [v / sum(raised) for v in raised]


def test_chances_equal_plain_ones(network):
    rng = random.Random(1)
    network.shifts += np.linspace(-0.2, 0.2, len(network.shifts)).astype(np.float32)
    windows = langid.windows_of("".join(rng.choice("abc déß.\n7Z") for _ in range(400)).encode())
    assert np.allclose(network.chances(windows), [plain_chances(network, w) for w in windows], atol=1e-5)


def test_whole_texts_are_judged(network):
    """Windows of many texts are computed together; each text's chance is that of its own windows."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghij k") for _ in range(n)).encode() for n in (0, 1, 191, 192, 193, 5000, 60_000, 3, 400_000)]
    best, chance = network.judge(iter(texts))
    for text, b, c in zip(texts, best, chance):
        windows = langid.windows_of(text)
        assert len(windows) == max(1, -(-len(text) // langid.WINDOW))
        weighted = (network.chances(windows) * (langid.LETTERS[windows].sum(axis=1) + 0.01)[:, None]).sum(axis=0)
        assert b == weighted.argmax() and abs(c - weighted.max() / weighted.sum()) < 1e-5
    assert [len(found) for found in network.judge(iter([]))] == [0, 0]


def test_windows_are_folded():
    first = langid.windows_of("Ab 9\té".encode())[0]
    assert bytes(first[:7]) == b"ab 0 " + "é".encode() and not first[7:].any()


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    words = {0: "der die und ich ", 1: "the of and you "}
    windows = np.concatenate([langid.windows_of("".join(rng.permutation(list(words[i % 2].split())).tolist() + ["zq" * int(rng.integers(1, 40))]).encode())[:1] for i in range(300)])
    labels = np.arange(300) % 2
    network = langid.Network.new(["a", "b"], np.random.default_rng(1))
    loss = lambda: -np.log(network.chances(windows)[np.arange(300), labels]).mean()
    before = loss()
    network.train(windows, labels, rng)
    assert loss() < 0.05 < before


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_held_out_texts_are_told_apart(spark):
    rows = op12_language_id(spark, "/root/testdata/sf0.01").join(documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1) and 0 <= row.score <= 1
    held = [row for row in rows if row.held_out]
    assert sum(row.lang == row.lang_pred for row in held) / len(held) > 0.97


def test_labels_of_held_out_rows_are_not_read(spark, sf_dir):
    docs = documents(spark, sf_dir)
    other = docs.withColumn("lang", F.when(langid.is_held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert langid.training_windows(other)[0] == langid.training_windows(docs)[0]
    one, two = langid.learn(docs), langid.learn(other)
    assert all((a == b).all() for a, b in zip([*one.tables, one.weights], [*two.tables, two.weights]))


def test_odd_rows_and_columns(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    odd = [(None, "the of and the", "en"), (900_001, None, "en"), (900_002, "", None), (900_003, "12 34 !?\n\t", "fr"), (900_004, "é" * 300_000, None), (900_005, "the of", None), (900_005, "the of", None)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    docs = docs.union(odd).select("*", F.lit("mine").alias("score"), F.lit(1).alias("_judged"), F.lit(2).alias("a.b"))
    got = langid.languages(docs)
    assert got.columns == ["doc_id", "text", "lang", "_judged", "a.b", "held_out", "lang_pred", "score"]
    found = {row.doc_id: row for row in got.collect() if row.doc_id is None or row.doc_id > 900_000}
    assert [found[900_001 + i].lang_pred for i in range(3)] == ["und"] * 3 and found[900_003].score == 0.0
    assert found[900_004].lang_pred in ("de", "en", "es", "fr") and found[None].held_out is False
    assert got.where("doc_id = 900005").count() == 2 and {row._judged for row in got.collect()} == {1}


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.languages(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "the of", None), (None, "x", "en")], empty.schema)
    assert {(r.lang_pred, r.score) for r in langid.languages(unlabelled).collect()} == {("und", 0.0)}
    single = spark.createDataFrame([(i, "the of", "en") for i in range(9)], empty.schema)
    assert {(r.lang_pred, r.score) for r in langid.languages(single).collect()} == {("en", 1.0)}
