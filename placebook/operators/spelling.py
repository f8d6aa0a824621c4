"""Search for short typed texts with mistakes, which share too few trigrams with what is meant.

A field is cut into pieces, its runs of up to MOST_WORDS words. A typed text matches a field if it is within one edit
(two from LONG characters on) of a piece: a letter missing, added or replaced; two swapped letters are two edits.

    miss  = edits / characters of the typed text, for the nearest piece
    score = product over matching fields of max(miss, 0.001) ** weight     lower is better

Two texts within n edits have a form in common, each after deleting at most n characters. So every distinct piece is
stored under its forms, and a typed text meets only the pieces that share one, whose edits are then counted. The index
grows with the vocabulary, not with the records. Of each piece and field it keeps the smallest record ids, which are all
that a match in one field needs; matches in both go through the field where the pieces found are in fewer records.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placebook.functions.text import long_enough, normalize_query
from placebook.operators.joins import lookup, shuffle_partitions, skew_join
from placebook.operators.search import BEST, WEIGHTS, SearchIndex, best_records, first_ids, fuzzy_search, weighed
from placebook.session import BROADCAST_ROWS, fits_broadcast, materialize

# Characters of the longest typed text that is looked for (longer ones survive two edits by their trigrams), characters
# from which two edits are allowed, and words of a piece at most.
SHORT = 12
LONG = 6
MOST_WORDS = 3
MOST_EDITS = 2

# Forms up to which a search asks the scan of a saved index for just theirs.
PUSHED_FORMS = 300


@dataclass(frozen=True)
class SpellingIndex:
    """What a search needs of the searched table."""

    forms: DataFrame  # form, piece: each distinct piece under what is left of it after up to two deletions
    places: DataFrame  # piece, field, text, pairs: the field texts with the piece and in how many pairs each is
    firsts: DataFrame  # piece, field, ids, pairs: the smallest ids of records with the piece, pairs with it
    pairs: DataFrame  # nom, adresse, ids: as in the search index
    depth: int

    def save(self, path: str) -> SpellingIndex:
        spark, parts = self.forms.sparkSession, shuffle_partitions(self.forms)
        self.forms.repartitionByRange(parts, "form", "piece").sortWithinPartitions("form").write.parquet(f"{path}/forms")
        for name, table in (("places", self.places), ("firsts", self.firsts)):
            table.repartitionByRange(parts, *table.columns[:3]).sortWithinPartitions("piece").write.parquet(f"{path}/{name}")
        self.pairs.write.parquet(f"{path}/pairs")
        spark.createDataFrame([(self.depth,)], "depth int").coalesce(1).write.parquet(f"{path}/depth")
        return load_spelling(spark, path)


def load_spelling(spark: SparkSession, path: str) -> SpellingIndex:
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("forms", "places", "firsts", "pairs")]
    return SpellingIndex(*tables, spark.read.parquet(f"{path}/depth").first()[0])


def plain_words(c: Column) -> Column:
    """A normalised text's words with one blank between them."""
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def pieces_of(c: Column | str) -> Column:
    """The distinct runs of up to MOST_WORDS words of a text that are short enough to be within reach of a typed one."""
    words = F.split(plain_words(F.col(c) if isinstance(c, str) else c), " ")
    count = F.size(words)
    names = [f"w{i}" for i in range(MOST_WORDS)]
    side_by_side = F.arrays_zip(*[(F.slice(words, i + 1, count) if i else words).alias(name) for i, name in enumerate(names)])
    # Beyond the last word there is null, and what is joined with it is null too.
    joined = lambda z, n: F.concat(*[part for name in names[:n] for part in (F.lit(" "), z[name])][1:])
    runs = F.flatten(F.transform(side_by_side, lambda z: F.array(*[joined(z, n) for n in range(1, MOST_WORDS + 1)])))
    able = lambda piece: piece.isNotNull() & F.char_length(piece).between(2, SHORT + MOST_EDITS)
    return F.array_distinct(F.filter(runs, able))


def _without_one(c: Column) -> Column:
    """What is left of a text after deleting any one character."""
    return F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))


def forms_of(c: Column | str) -> Column:
    """A text of two characters or more, and what is left of it after one deletion, or of four or more after two."""
    c = F.col(c) if isinstance(c, str) else c
    one = _without_one(c)
    two = F.when(F.char_length(c) >= LONG - MOST_EDITS, F.flatten(F.transform(one, _without_one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(c), one, two))


def allowed(q: Column | str) -> Column:
    return F.when(F.char_length(q) < LONG, 1).otherwise(MOST_EDITS)


def build_spelling(index: SearchIndex) -> SpellingIndex:
    """The index of the pieces of a search index's texts, which are those of three characters or more."""
    places = index.texts.select(F.explode(pieces_of("text")).alias("piece"), "field", "text", "ids", "pairs")
    places = materialize(places, "places")
    counts = places.groupBy("piece", "field").agg(F.sum("pairs").alias("pairs"))
    ids = first_ids(places.select("piece", "field", F.explode("ids").alias("id")).distinct(), ["piece", "field"], index.depth)
    firsts = materialize(lookup(ids, counts, ["piece", "field"], "inner"), "firsts")
    pieces = firsts.select("piece").distinct().repartition(shuffle_partitions(firsts), "piece")
    forms = materialize(pieces.select(F.explode(forms_of("piece")).alias("form"), "piece"), "forms")
    return SpellingIndex(forms, places.drop("ids"), firsts, index.pairs, index.depth)


def near_pieces(typed: DataFrame, index: SpellingIndex, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(q, piece, edits): all pieces within the allowed edits of each distinct typed text q."""
    asked = materialize(typed.select("q").distinct().select("q", F.explode(forms_of("q")).alias("form")), "asked-forms")
    asked = asked.where(F.char_length("q") - F.char_length("form") <= allowed("q"))
    forms = index.forms
    wanted = asked.select("form").distinct().limit(PUSHED_FORMS + 1).agg(F.collect_list("form")).first()[0]
    if len(wanted) <= PUSHED_FORMS:
        forms = forms.where(F.col("form").isin(wanted))
    met = skew_join(forms, asked, ["form"], limit=limit)
    met = met.where(F.char_length("piece") - F.char_length("form") <= allowed("q")).select("q", "piece").distinct()
    # The explode keeps the edits from being counted again in the condition on them.
    counted = met.withColumn("edits", F.explode(F.array(F.levenshtein("piece", "q", MOST_EDITS))))
    return materialize(counted.where((F.col("edits") >= 0) & (F.col("edits") <= allowed("q"))), "near-pieces")


def _edits(text: Column | str, q: Column | str) -> Column:
    """The edits of a text's nearest piece; null where none is within reach."""
    q = F.col(q) if isinstance(q, str) else q
    counts = F.transform(pieces_of(text), lambda piece: F.levenshtein(piece, q, MOST_EDITS))
    return F.array_min(F.filter(counts, lambda n: (n >= 0) & (n <= allowed(q))))


def _miss() -> Column:
    return F.col("edits") / F.char_length("q")


def misspelled_search(
    queries: DataFrame,
    index: SpellingIndex,
    k: int = BEST,
    weights: Mapping[str, float] = WEIGHTS,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """The best `k` records for each query (qid, text) of 3 to SHORT characters: qid, rank, id, score. Others, and nulls,
    find nothing. Repeated queries each get their results. `limit` (rows to broadcast) does not change the result.
    """
    if k > index.depth:
        raise ValueError(f"the index keeps {index.depth} ids per piece, too few for the best {k}")
    typed = queries.where(long_enough("text")).select("qid", plain_words(normalize_query("text")).alias("q"))
    typed = typed.where(F.char_length("q").between(3, SHORT))
    near = near_pieces(typed, index, limit)

    met = materialize(skew_join(index.firsts, near, ["piece"], limit=limit), "met-pieces")
    single = met.select("q", "field", F.explode("ids").alias("id"), "edits").groupBy("q", "field", "id").agg(F.min("edits").alias("edits"))
    single = single.select("q", F.array("id").alias("ids"), weighed("field", _miss(), weights).alias("score"))

    costs = met.groupBy("q", "field").agg(F.sum("pairs").alias("cost"))
    narrow = costs.groupBy("q").agg(F.min_by("field", F.struct("cost", "field")).alias("field"), F.count("*").alias("_n"))
    narrow = materialize(narrow.where(F.col("_n") == len(WEIGHTS)).drop("_n"), "narrow")
    hits = lookup(near, narrow, ["q"], "inner", limit)
    hits = skew_join(index.places.select("piece", "field", "text"), hits, ["field", "piece"], limit=limit)
    hits = materialize(hits.groupBy("q", "field", "text").agg(F.min("edits").alias("edits")), "spelled-hits")
    fits = fits_broadcast(hits, limit)
    both = []
    for name, other in (WEIGHTS, reversed(WEIGHTS)):
        own = hits.where(F.col("field") == name).select("q", F.col("text").alias(name), weighed("field", _miss(), weights).alias("score"))
        joined = skew_join(index.pairs, own, [name], fits=fits).where(F.char_length(other) >= 3)
        joined = joined.withColumn("edits", F.explode(F.array(_edits(other, "q")))).where(F.col("edits").isNotNull())
        both.append(joined.select("q", "ids", (F.col("score") + weighed(F.lit(other), _miss(), weights)).alias("score")))
    best = best_records(single.unionByName(both[0]).unionByName(both[1]), k)
    ranked = materialize(best.groupBy("q").agg(F.collect_list(F.struct("rank", "id", "score")).alias("found")), "ranked")
    return skew_join(typed, ranked, ["q"], limit=limit).select("qid", F.inline("found"))


def search_with_spelling(queries: DataFrame, index: SearchIndex, spelling: SpellingIndex, k: int = BEST, **options) -> DataFrame:
    """`fuzzy_search`; what finds nothing there and is short is looked for with mistakes. `options` go to the former."""
    found = materialize(fuzzy_search(queries, index, k, **options), "found")
    rest = queries.join(found.select("qid").distinct(), "qid", "left_anti")
    return found.unionByName(misspelled_search(rest, spelling, k, options.get("weights", WEIGHTS), options.get("limit", BROADCAST_ROWS)))
