"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The features are densities of insulting words, from a short fixed list and from a list learned of the labelled rows,
how near such words are to a second person, and the rates of capitals, punctuation and disguised spellings. Learned
words are those that toxic texts have far more often than others. Words that a row itself taught must not describe it
while the trees learn, so each half of the rows is described by the words of the other half; texts are scored with the
words of both. A part of the rows is kept from the trees for the calibration.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from placebook.operators.joins import named
from placebook.session import materialize

# Labelled rows that are learned from: all, or if there are more, about so many, chosen by a hash of their ids.
TRAINING_ROWS = 40_000
# Learned words at most, those of the highest odds, and what makes one: toxic texts that have it, odds against others.
LEARNED_WORDS = 5_000
LEAST_TEXTS = 4
LEAST_ODDS = 8.0
# Trees, their depth, and the share of rows (one in so many) that is kept for the calibration.
TREES = 16
DEPTH = 3
CALIBRATION = 4
# A score from here on is predicted as toxic.
TOXIC_FROM = 0.3

# Insults, second persons, and what stands for a letter in a disguised word.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb scum trash loser losers pathetic worthless disgusting clown clowns garbage fool "
    "fools imbecile imbeciles jerk jerks creep creeps vermin filth filthy ugly hate hateful retard retarded bastard "
    "bastards bitch whore slut shit crap asshole arsehole fuck fucking dickhead "
    "dumm idioten trottel arschloch abschaum scheisse scheiße wertlos erbärmlich connard connasse imbécile salaud ordure "
    "idiota idiotas imbécil estúpido estúpida basura cabrón gilipollas mierda".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros tus su".split()
)
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None, "_": None})

WORD = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"[^\W\d_]+(?:[0134578@$!|*._-]+[^\W\d_]+)+")
FEATURES = "words insults learned heaviest hits distinct nearness capitals exclamations punctuation disguised disguised_hits".split()


def features(text: str | None, learned: Mapping[str, float]) -> list[float]:
    """The numbers named in FEATURES; a null text is like an empty one."""
    text = text or ""
    lowered = text.lower()
    words = WORD.findall(lowered)
    n = len(words) or 1
    hits = [i for i, word in enumerate(words) if word in learned or word in INSULTS]
    weights = [learned.get(words[i], 0.0) for i in hits]
    nearness = 0.0
    if hits:
        persons = [i for i, word in enumerate(words) if word in SECOND_PERSON]
        k = 0
        for i in hits:
            while k + 1 < len(persons) and persons[k + 1] <= i:
                k += 1
            for place in persons[k : k + 2]:
                nearness = max(nearness, 1 / (1 + abs(place - i)))
    disguised = DISGUISED.findall(lowered)
    uncovered = [word.translate(DISGUISES) for word in disguised]
    letters = sum(map(len, words))
    marks = max(0, len(text) - letters - text.count(" ") - text.count("\n"))
    return [
        math.log1p(len(words)),
        sum(words[i] in INSULTS for i in hits) / n,
        sum(weights) / n,
        max(weights, default=0.0),
        math.log1p(len(hits)),
        math.log1p(len({words[i] for i in hits})),
        nearness,
        0.0 if text.islower() else sum(map(str.isupper, text)) / (letters or 1),
        text.count("!") / n,
        marks / n,
        len(disguised) / n,
        math.log1p(sum(word in learned or word in INSULTS for word in uncovered)),
    ]


def is_held_out(doc_id: Column) -> Column:
    """The rows that are never learned from; rows without an id are none of them, and are not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(half, kept, text, toxic) of the rows to learn from, stored. A document with several labels is toxic if one says
    so; rows without a label are left out. About TRAINING_ROWS rows at most, so their ids are sent to every task.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    share = min(1.0, TRAINING_ROWS / max(1, known.count()))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20))
    draw = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n))
    chosen = known.where(chance).select("doc_id", "toxic", draw(2, 2).alias("half"), (draw(CALIBRATION, 3) == 0).alias("kept"))
    return materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").drop("doc_id"), "labelled")


def learned_words(rows: DataFrame) -> dict[int, dict[str, float]]:
    """For each half of the rows (0, 1), and for both (2), the words of high odds with the logarithm of their odds."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda word: word != "")
    of = {name: [F.count_if((F.col("toxic") == label) & (F.col("half") == half)) for half in (0, 1)] for name, label in (("toxic", 1), ("other", 0))}
    totals = rows.agg(F.array(*of["toxic"]).alias("toxic"), F.array(*of["other"]).alias("other")).first()
    counts = rows.select("half", "toxic", F.explode(words).alias("word")).groupBy("word")
    counts = counts.agg(*[column.alias(f"{name}{half}") for name, both in of.items() for half, column in enumerate(both)])
    counts = materialize(counts.where(F.col("toxic0") + F.col("toxic1") >= LEAST_TEXTS), "word-counts")
    found = {}
    for key, halves in ((0, [0]), (1, [1]), (2, [0, 1])):
        toxic, other = (sum((F.col(f"{name}{half}") for half in halves), F.lit(0)) for name in ("toxic", "other"))
        n_toxic, n_other = (sum(totals[name][half] for half in halves) for name in ("toxic", "other"))
        odds = ((toxic + 0.5) / (n_toxic + 1)) / ((other + 0.5) / (n_other + 1))
        able = counts.select("word", odds.alias("odds")).where((toxic >= LEAST_TEXTS) & (odds >= LEAST_ODDS))
        able = able.orderBy(F.desc("odds"), "word").limit(LEARNED_WORDS)
        pairs = able.agg(F.collect_list(F.struct("word", "odds"))).first()[0]
        found[key] = {word: math.log(odds) for word, odds in pairs}
    return found


def _feature_column(spark, learned: dict[int, dict[str, float]], text: Column, half: Column) -> Column:
    """The features of a text, by the words of the other half, or of both where `half` is 2."""
    sent = spark.sparkContext.broadcast(learned)
    words_of = {0: 1, 1: 0, 2: 2}

    @F.arrow_udf("array<double>")
    def described(texts: pa.Array, halves: pa.Array) -> pa.Array:
        rows = [features(t.as_py(), sent.value[words_of[h.as_py()]]) for t, h in zip(texts, halves)]
        return pa.array(rows, pa.list_(pa.float64()))

    return described(text, half)


class Scorer:
    """Learns from labelled rows; scores texts from 0 to 1."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        rows = labelled_texts(docs, labels)
        self.spark, self.trees, self.steps = docs.sparkSession, None, None
        self.learned = learned_words(rows)
        numbers = _feature_column(self.spark, self.learned, F.col("text"), F.col("half").cast("int"))
        described = materialize(rows.select("toxic", "kept", numbers.alias("numbers")), "described")
        described = described.select("toxic", "kept", array_to_vector("numbers").alias("_features"))
        kinds = described.groupBy("kept").agg(F.countDistinct("toxic").alias("kinds"))
        kinds = kinds.agg(F.map_from_entries(F.collect_list(F.struct("kept", "kinds")))).first()[0]
        if kinds.get(False) == 2:
            trees = GBTClassifier(labelCol="toxic", featuresCol="_features", predictionCol="_predicted", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=64, seed=1)
            self.trees = trees.fit(described.where("not kept")).setRawPredictionCol("_raw").setProbabilityCol("_probability")
            if kinds.get(True):
                # The trees give few different chances, so that rows of one chance are one, with their number as weight.
                chances = self._chances(described.where("kept")).groupBy("toxic", "_chance").agg(F.count("*").cast("double").alias("_rows"))
                steps = IsotonicRegression(labelCol="toxic", featuresCol="_chance", predictionCol="_calibrated", weightCol="_rows")
                self.steps = steps.fit(materialize(chances, "chances"))

    def _chances(self, described: DataFrame) -> DataFrame:
        found = self.trees.transform(described).withColumn("_chance", vector_to_array("_probability")[1])
        return found.drop("_features", "_raw", "_probability", "_predicted")

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """`docs` with a column `score`, replacing one of that name. Every row stays, repeated ones included; null is
        like an empty text. Where too few rows are labelled for both kinds to be learned, all scores are 0.

        The calibration makes steps; a thousandth of the score is the trees' own, so that order within a step is kept.
        """
        if self.trees is None:
            return docs.withColumn("score", F.lit(0.0))
        numbers = _feature_column(self.spark, self.learned, named(text), F.lit(2))
        # The caller's columns are packed, so that none of theirs has the name of one made here.
        packed = docs.select(F.struct(*map(named, docs.columns)).alias("_all"), array_to_vector(numbers).alias("_features"))
        found = self._chances(packed)
        score = F.col("_chance")
        if self.steps is not None:
            found = self.steps.transform(found)
            calibrated = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_calibrated")))
            score = 0.999 * calibrated + 0.001 * F.col("_chance")
        return found.select(*[F.col("_all")[name].alias(name) for name in docs.columns if name != "score"], score.alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with the columns held_out, score and predicted, which replace any of the same names; learns from labelled
    rows of `docs` that are not held out. Needs doc_id and text in docs, doc_id and toxic in labels.
    """
    scored = Scorer(docs, labels).score(docs.withColumn("held_out", is_held_out(F.col("doc_id"))))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))
