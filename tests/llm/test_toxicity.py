import math
import random
import re

from pyspark.sql import functions as F

from placebook.llm import toxicity
from placebook.llm.queries import op1_toxicity


def test_features_of_odd_texts():
    names = toxicity.FEATURES
    for text in (None, "", " \n", "!!!", "123", "é", "ALL CAPS", "w " * 50_000):
        found = toxicity.features(text, {})
        assert len(found) == len(names) and all(value >= 0 for value in found)
    found = dict(zip(names, toxicity.features("You are an IDIOT! An id1ot, i.d.i.o.t. The grumk grumk", {"grumk": 3.0})))
    assert found["insults"] == 1 / 15 and found["learned"] == 6 / 15  # id and ot are words, and so is each lone letter
    assert found["heaviest"] == 3.0
    assert found["nearness"] == 1 / 4 and found["disguised"] > 0 and found["disguised_hits"] > 1


def test_held_out_rows_follow_the_rule(spark):
    import zlib

    rows = spark.range(200).select("id", toxicity.is_held_out(F.col("id")).alias("out")).collect()
    assert all(row.out == (zlib.crc32(str(row.id).encode()) % 4 == 2) for row in rows)
    assert spark.sql("select cast(null as long) as id").select(toxicity.is_held_out(F.col("id"))).first()[0] is False


def corpus(spark, n=900):
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(300)]
    bad = ["grumk", "zorfle", "blatt", "idiot", "moron"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(None, "you idiot"), (n + 1, None), (n + 2, ""), (0, rows[0][1])]
    labels += [(3, None), (0, 1), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(9)), spark.createDataFrame(labels, "doc_id long, toxic int"), n


def plain_learned(rows):
    """(half, toxic, text) rows: the words of high odds of each half and of both, counted one by one."""
    found = {}
    for key, halves in ((0, {0}), (1, {1}), (2, {0, 1})):
        own = [(toxic, set(re.findall(r"[^\W\d_]+", text.lower()))) for half, toxic, text in rows if half in halves]
        n = {label: sum(toxic == label for toxic, _ in own) for label in (0, 1)}
        words = {}
        for word in set().union(*[words for _, words in own]) if own else ():
            counts = {label: sum(toxic == label and word in text for toxic, text in own) for label in (0, 1)}
            total = sum(toxic == 1 and word in set(re.findall(r"[^\W\d_]+", text.lower())) for _, toxic, text in rows)
            odds = ((counts[1] + 0.5) / (n[1] + 1)) / ((counts[0] + 0.5) / (n[0] + 1))
            if total >= toxicity.LEAST_TEXTS and counts[1] >= toxicity.LEAST_TEXTS and odds >= toxicity.LEAST_ODDS:
                words[word] = round(math.log(odds), 9)
        found[key] = words
    return found


def test_learned_words_equal_counted_ones(spark):
    docs, labels, _ = corpus(spark, 300)
    rows = toxicity.labelled_texts(docs, labels)
    got = {key: {word: round(odds, 9) for word, odds in words.items()} for key, words in toxicity.learned_words(rows).items()}
    assert got == plain_learned([(row.half, int(row.toxic), row.text or "") for row in rows.collect()]) and len(got[2]) >= 3


def test_scores_are_steps_of_the_pool_of_adjacent_chances(spark):
    """The calibration equals pooling adjacent violators, by hand, of the chances of the rows kept for it."""
    docs, labels, _ = corpus(spark)
    scorer = toxicity.Scorer(docs, labels)
    rows = toxicity.labelled_texts(docs, labels).where("kept")
    numbers = toxicity._feature_column(spark, scorer.learned, F.col("text"), F.col("half").cast("int"))
    described = rows.select("toxic", toxicity.array_to_vector(numbers).alias("_features"))
    by_chance = {}
    for row in scorer._chances(described).collect():
        by_chance.setdefault(row._chance, []).append(row.toxic)
    pools = []
    for chance, values in sorted(by_chance.items()):
        pools.append([sum(values), len(values), [chance]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    expected = {chance: total / n for total, n, chances in pools for chance in chances}
    frame = spark.createDataFrame([(chance,) for chance in expected], "_chance double")
    for row in scorer.steps.transform(frame).collect():
        assert abs(row._calibrated - expected[row._chance]) < 1e-9


def test_any_names_of_columns(spark):
    docs, labels, n = corpus(spark, 300)
    names = ["_features", "_raw", "_probability", "_predicted", "_chance", "_calibrated", "_all", "a.b"]
    more = docs.select("doc_id", "text", *[F.lit(i).alias(name) for i, name in enumerate(names)])
    got = toxicity.toxicity(more, labels)
    assert got.columns == ["doc_id", "text", *names, "held_out", "score", "predicted"]
    assert {tuple(row)[2:10] for row in got.collect()} == {tuple(range(8))}


def test_held_out_rows_are_told_apart(spark):
    docs, labels, n = corpus(spark)
    got = toxicity.toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert len(got) == n + 4 and all(0 <= row.score <= 1 and row.toxic == 9 for row in got)
    held = [row for row in got if row.held_out and row.doc_id < n]
    right = sum(row.predicted == (row.doc_id % 8 == 0) for row in held) / len(held)
    assert len(held) > 150 and right > 0.98
    assert [row.predicted for row in got if row.doc_id is None] == [1]


def test_without_labels_nothing_is_toxic(spark):
    docs, labels, n = corpus(spark, 40)
    assert {row.score for row in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {row.score for row in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_query_scores_every_document(spark):
    sf_dir = "/root/testdata/sf0.1"  # smaller tables have too few toxic rows to learn from
    got = op1_toxicity(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = [row for row in rows if row.held_out and row.toxic is not None]
    caught = [row.predicted for row in held if row.toxic]
    clean = [row.predicted for row in held if not row.toxic]
    assert sum(caught) >= 0.85 * len(caught) and sum(clean) <= 0.01 * len(clean)
