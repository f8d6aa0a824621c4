import random
import re

import numpy as np
import pytest

from placebook.llm import graphs, jaccard
from placebook.llm.queries import op7_ngram_jaccard_join


def plain_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_force(rows):
    sets = [plain_set(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), 1 << 63), 1 << 63 if doc is None else doc)
    found = [(doc, len(sets[i]), smallest[find(i)]) for i, (doc, _) in enumerate(rows)]
    return sorted((-1 if doc is None else doc, n, -1 if c == 1 << 63 else c) for doc, n, c in found)


def results(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def family(rng, size, words, edits):
    """Copies of copies, each with some words replaced."""
    texts = [[f"w{rng.randrange(400)}" for _ in range(words)]]
    while len(texts) < size:
        copy = list(rng.choice(texts))
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        texts.append(copy)
    return [" ".join(text) for text in texts]


def corpus(seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = []
    for size, words, edits in ((60, 150, 6), (25, 60, 3), (12, 12, 1), (9, 400, 12)):
        texts += family(rng, size, words, edits)
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) + " " + passage for _ in range(30)]
    texts += [passage + f" end{i % 4}" for i in range(12)]
    texts += ["", None, " \n", "one", "One", "a b c d", "a b c D", "a b c", "d c b a"] + ["same text for all of these"] * 5
    rng.shuffle(texts)
    return [(i * 3 + 1, text) for i, text in enumerate(texts)]


@pytest.mark.parametrize("limits", [(2048, 2_000_000, 1000, 1_000_000), (16, 3000, 2, 500)])
def test_equals_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("BLOCK_SETS", "BLOCK_SHINGLES", "LEAST_HOT", "BATCH_SHINGLES"), limits):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(limits[0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert results(jaccard.similar_groups(df)) == brute_force(rows)


def test_sets_whose_names_are_alike_stay_apart(spark):
    """Names of six bits: all sets share theirs with others and get new ones."""
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(jaccard.similar_groups(df, bits=6)) == brute_force(rows)


def test_repeated_rows_missing_ids_and_other_columns(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (None, "A b c d e f"), (None, "x y z"), (None, "x y z"), (5, None), (None, ""), (2, "x y"), (9, "q " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(jaccard.similar_groups(df)) == brute_force(rows)
    more = df.selectExpr("*", "1 as key", "2 as mark", "3 as n", "4 as component_id")
    left = jaccard.keep_one_of_each_group(more)
    assert left.columns == more.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect())[:4] == [(0, ""), (0, "x y z"), (0, "x y z"), (2, "x y")]
    assert left.count() == 8 and {r.key for r in left.collect()} == {1}
    assert jaccard.similar_groups(df.limit(0)).count() == 0


def test_search_finds_what_connects(spark):
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.choice(500, 40, replace=False)
        sets = [np.unique(np.where(rng.random(40) < rng.random() * 0.15, rng.integers(0, 900, 40), base)).astype(np.int64) for _ in range(30)]
        links = jaccard.search(sets, np.arange(30), np.ones(30, bool), np.ones(30, bool))
        all_links = [(i, j) for i in range(30) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        assert {tuple(sorted(link)) for link in links} <= {tuple(sorted(link)) for link in all_links}
        assert parts(links, 30) == parts(all_links, 30)


def parts(links, n):
    label = list(range(n))
    for a, b in links:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    return label


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 200), (7, 7)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 4999)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[300] == got[200] == 100 and got[5000] == 4999
    assert all(got[1000 + i] == 1000 for i in range(50))
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert results(op7_ngram_jaccard_join(spark, sf_dir)) == brute_force(rows)
