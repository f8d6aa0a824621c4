"""Accent-insensitive fuzzy search of many typed texts in a table of names and addresses.

A text matches a field if the field shares enough of the text's trigrams:

    miss  = 1 - |trigrams(text) & trigrams(field)| / |trigrams(text)|      matches if miss <= threshold
    score = product over matching fields of max(miss, 0.001) ** weight     lower is better

How this is done without comparing everything with everything, and without losing anything:

* A field that shares at least `need` of a text's n trigrams shares one of any n - need + 1 of them. Only the rarest
  n - need + 1 trigrams of each text are joined, and the hits then checked in full.
* Copies are worked on once: typed texts, field texts and (name, address) pairs are made distinct. Each keeps its
  `depth` smallest record ids; ids decide between equal scores, so no more than `depth` of them can be among the best.
* A record that matches in both fields is found through the field in which the typed text is the less common one, and
  its other field is checked directly. So in the more common field only the best few are needed. Those of a text that
  has very many hits to expect are looked for with small misses first; it leaves once it has found enough.

With a `distance` the place counts too. A trigram's shift is its first place in the field less that in the text. Only
trigrams shifted by at most threshold * distance are shared, and the miss grows by the shift that most of them have (of
equally many the smallest, never less than 0) divided by the distance. The index keeps the place of each trigram, so that
those too far behind are left out before any text is looked at.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from placebook.functions.text import long_enough, normalize_query, trigrams
from placebook.operators.joins import lookup, shuffle_partitions, skew_join
from placebook.session import BROADCAST_ROWS, fits_broadcast, materialize

# How many results, the largest miss that still matches, field weights; the smallest miss in the score.
BEST = 5
THRESHOLD = 0.35
WEIGHTS = {"nom": 0.7, "adresse": 0.3}
LEAST_MISS = 0.001

# Rounds of growing misses before the threshold, for typed texts whose rarest trigrams lie in more field texts than this.
ROUNDS = (0.1, 0.2)
COSTLY_FROM = 1_000_000

# Files of a saved index's postings per task, and the trigrams up to which a search asks the scan for just theirs.
POSTING_PARTS = 4
PUSHED_GRAMS = 200


@dataclass(frozen=True)
class SearchIndex:
    """What a search needs of the searched table."""

    texts: DataFrame  # field, text, ids, pairs: each distinct text of a field and in how many pairs it occurs
    pairs: DataFrame  # nom, adresse, ids: each distinct pair of texts
    grams: DataFrame  # field, gram, texts, pairs: in how many texts and pairs each trigram occurs
    depth: int  # ids kept per text and pair, ascending
    postings: DataFrame | None = None  # field, gram, pos, text, ids, pairs: each text under each of its trigrams; saved indexes only

    def save(self, path: str) -> SearchIndex:
        """Stores the index, its texts also under each of their trigrams: a search then reads only those it is about."""
        ordered = spread_texts(self.texts).repartitionByRange(POSTING_PARTS * shuffle_partitions(self.texts), "field", "gram", "text")
        ordered.sortWithinPartitions("field", "gram", "text").write.parquet(f"{path}/postings")
        self.texts.write.parquet(f"{path}/texts")
        self.pairs.write.parquet(f"{path}/pairs")
        self.grams.write.parquet(f"{path}/grams")
        self.texts.sparkSession.createDataFrame([(self.depth,)], "depth int").coalesce(1).write.parquet(f"{path}/depth")
        return load_index(self.texts.sparkSession, path)


def load_index(spark: SparkSession, path: str) -> SearchIndex:
    depth = spark.read.parquet(f"{path}/depth").first()[0]
    return SearchIndex(*[spark.read.parquet(f"{path}/{part}") for part in ("texts", "pairs", "grams")], depth, spark.read.parquet(f"{path}/postings"))


def spread_texts(texts: DataFrame) -> DataFrame:
    """Each text under each of its trigrams, with the trigram's first place in it, from 1."""
    spread = texts.select("field", F.explode(trigrams("text")).alias("gram"), "text", "ids", "pairs")
    return spread.withColumn("pos", F.expr("locate(gram, text)"))


def wanted_postings(rare: DataFrame, index: SearchIndex, reach: int | None = None) -> DataFrame:
    """The index's postings; of a saved index, if few trigrams are wanted, only theirs, by filters that reach the scan.
    With a `reach` only trigrams at most so far behind a place that a typed text has them at.
    """
    if index.postings is None:
        return spread_texts(index.texts)
    wanted = rare.groupBy("field", "gram").agg(F.max(F.expr("locate(gram, q)")).alias("last")).limit(PUSHED_GRAMS + 1)
    wanted = wanted.agg(F.collect_list(F.struct("field", "gram", "last"))).first()[0]
    if len(wanted) > PUSHED_GRAMS:
        return index.postings

    def asked(row) -> Column:
        same = (F.col("field") == row["field"]) & (F.col("gram") == row["gram"])
        return same if reach is None else same & (F.col("pos") <= row["last"] + reach)

    return index.postings.where(reduce(or_, map(asked, wanted), F.lit(False)))


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first `n` rows of each key. A key's rows are dealt to as many pieces as there are tasks, each piece gives its
    first n, and only these come together, however many rows a key has and however large n is.
    """
    piece = F.pmod(F.xxhash64(*order), F.lit(shuffle_partitions(df)))
    for within in ([*keys, "_piece"], keys):
        df = df.withColumn("_piece", piece).withColumn("_place", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
        df = df.where(F.col("_place") <= n)
    return df.drop("_piece", "_place")


def first_ids(df: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """The smallest `depth` ids of each key, ascending."""
    return first_rows(df.select(*keys, "id"), keys, ["id"], depth).groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def build_index(records: DataFrame, depth: int = BEST) -> SearchIndex:
    """Index of records (id, nom, adresse) with unique ids. Save it to search it more than once."""
    plain = records.select("id", normalize_query("nom").alias("nom"), normalize_query("adresse").alias("adresse"))
    pairs = materialize(first_ids(plain, ["nom", "adresse"], depth), "pairs")
    fields = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("text")) for name in WEIGHTS]))
    long = pairs.select(fields.alias("_f"), "ids").select("_f.field", "_f.text", "ids").where(F.char_length("text") >= 3)
    counts = long.groupBy("field", "text").agg(F.count("*").alias("pairs"))
    texts = first_ids(long.withColumn("id", F.explode("ids")).drop("ids"), ["field", "text"], depth).join(counts, ["field", "text"])
    # Searching a text takes long for its size, so the texts are kept in many parts however small they are.
    texts = materialize(texts.repartition(shuffle_partitions(records), "text"), "texts")
    grams = texts.select("field", F.explode(trigrams("text")).alias("gram"), "pairs").groupBy("field", "gram")
    return SearchIndex(texts, pairs, materialize(grams.agg(F.count("*").alias("texts"), F.sum("pairs").alias("pairs")), "grams"), depth)


def least_overlap(n: Column, miss: float) -> Column:
    """The fewest of n trigrams that must be shared for a miss of at most `miss`; one at least."""
    floor = F.floor((1 - miss) * n)
    return F.greatest(F.when(1 - floor / n <= miss, floor).otherwise(floor + 1), F.lit(1)).cast("int")


def rare_grams(queries: DataFrame, grams: DataFrame, threshold: float, limit: int = BROADCAST_ROWS) -> DataFrame:
    """For each distinct query text `q` and field the rarest trigrams, one per row, as far as they occur in the field.

    Columns: q, field, gram, `grams` from rare to common, `place` among them, `need`, and the `texts` and `pairs` with it.
    """
    split = queries.select("q").distinct().withColumn("gram", F.explode(trigrams("q")))
    split = split.withColumn("field", F.explode(F.array(*map(F.lit, WEIGHTS))))
    counted = skew_join(split, grams, ["field", "gram"], "left", limit).fillna(0, ["texts", "pairs"])
    ranked = counted.groupBy("q", "field").agg(F.sort_array(F.collect_list(F.struct("texts", "gram", "pairs"))).alias("ranked"))
    n = F.size("ranked")
    needed = ranked.withColumn("need", least_overlap(n, threshold))
    rarest = F.posexplode(F.slice("ranked", F.lit(1), n - F.col("need") + 1)).alias("place", "_g")
    return (
        needed.select("q", "field", F.col("ranked.gram").alias("grams"), "need", rarest)
        .select("q", "field", "_g.gram", "grams", "place", "need", "_g.texts", "_g.pairs")
        .where(F.col("texts") > 0)
    )


def shift(gram: Column, text: Column | str, q: Column | str = "q") -> Column:
    """How much later the trigram is in the text than in the typed one."""
    return F.call_function("locate", gram, F.col(text)) - F.call_function("locate", gram, F.col(q))


def in_reach(gram: Column, text: Column | str, reach: int | None) -> Column:
    """Whether a text shares a trigram."""
    has = F.contains(F.col(text), gram)
    return has if reach is None else has & (shift(gram, text) <= reach)


def shared(grams: Column | str, text: Column | str, reach: int | None = None) -> Column:
    """How many of the trigrams a text shares."""
    return F.size(F.filter(grams, lambda gram: in_reach(gram, text, reach)))


def late_by(grams: Column | str, text: Column | str, reach: int) -> Column:
    """The shift that most of the shared trigrams have, of equally many the smallest; 0 for negative ones and for none."""
    shifts = F.transform(F.filter(grams, lambda gram: in_reach(gram, text, reach)), lambda gram: shift(gram, text))
    ranked = F.transform(F.array_distinct(shifts), lambda s: F.struct((-F.size(F.filter(shifts, lambda other: other == s))).alias("n"), s.alias("s")))
    return F.greatest(F.coalesce(F.array_min(ranked)["s"], F.lit(0)), F.lit(0))


@dataclass(frozen=True)
class Rule:
    """What counts as a match: the largest miss, and over how many characters a shift becomes a whole miss, if it counts."""

    threshold: float
    distance: float | None = None

    @property
    def reach(self) -> int | None:
        return None if self.distance is None else int(self.threshold * self.distance)

    def miss(self, count: Column, grams: Column | str, text: Column | str) -> Column:
        """The miss of a text that shares `count` of the trigrams."""
        grams = F.col(grams) if isinstance(grams, str) else grams
        plain = 1 - count / F.size(grams)
        return plain if self.distance is None else plain + late_by(grams, text, self.reach) / F.lit(float(self.distance))


def grams_of(rare: DataFrame) -> DataFrame:
    """The trigrams of each query text, from rare to common in each field: q, field, grams."""
    return rare.groupBy("q", "field").agg(F.any_value("grams").alias("grams"))


def few_enough(rare: DataFrame, limit: int) -> bool:
    """Whether both tables that a search broadcasts, the rare trigrams and all trigrams of each text, are within the limits."""
    return fits_broadcast(rare.drop("grams"), limit) and fits_broadcast(grams_of(rare), limit)


def match_texts(rare: DataFrame, index: SearchIndex, fits: bool, limit: int = BROADCAST_ROWS, rule: Rule = Rule(THRESHOLD)) -> DataFrame:
    """Every field text that shares with a query text at least `need`, and less than `below` (if given), of its trigrams.

    Columns: q, field, text, ids, pairs, miss, and the columns `rare` has besides. If the rare trigrams fit a broadcast the
    texts are not shuffled at all.
    """
    on = ["field", "gram"]
    postings = wanted_postings(rare, index, rule.reach)
    counts = index.grams.select(*on, F.col("texts").alias("rows"))
    rare = rare.drop("texts", "pairs")
    if fits:
        met = postings.join(F.broadcast(rare.drop("grams")), on).join(F.broadcast(grams_of(rare)), ["q", "field"])
    else:
        needed = rare.select(*on).distinct()
        if fits_broadcast(needed, limit):
            postings = postings.join(F.broadcast(needed), on, "left_semi")
        met = skew_join(postings, rare, on, fits=False, counts=counts.join(needed, on, "left_semi"))
    if rule.reach is not None:
        met = met.where(F.col("pos") - F.expr("locate(gram, q)") <= rule.reach)
    rarer = F.slice("grams", F.lit(1), F.col("place"))
    met_before = F.exists(rarer, lambda gram: in_reach(gram, "text", rule.reach))
    # The explode keeps the count from being taken again in each of the conditions on it.
    counted = met.where(~met_before).withColumn("_shared", F.explode(F.array(shared("grams", "text", rule.reach))))
    checked = counted.where(F.col("_shared") >= F.col("need"))
    if "below" in rare.columns:
        checked = checked.where(F.col("_shared") < F.col("below"))
    checked = checked.withColumn("miss", F.explode(F.array(rule.miss(F.col("_shared"), "grams", "text"))))
    if rule.distance is not None:
        checked = checked.where(F.col("miss") <= rule.threshold)
    return checked.drop("_shared", "gram", "pos", "grams", "place", "need", "below")


def find_hits(rare: DataFrame, index: SearchIndex, k: int, rule: Rule, fits: bool, limit: int, rounds: tuple[float, ...]) -> DataFrame:
    """Hits (q, field, text, ids, pairs, miss, whole, costly): where `whole` all hits of the query text in the field, else
    at least those that make the best `k` records. Of a costly text only the field where its rarest trigrams are the less
    common is whole, of others both are.
    """
    costs = rare.groupBy("q", "field").agg(F.sum("pairs").alias("cost"), F.sum("texts").alias("_texts"))
    narrow = costs.groupBy("q").agg(F.min_by("field", F.struct("cost", "field")).alias("_field"), F.count("*").alias("_n"), F.max("_texts").alias("_most"))
    routed = lookup(rare, narrow, ["q"], "inner", fits=fits).withColumn("costly", F.col("_most") >= COSTLY_FROM)
    # Where only one field has any of the trigrams, nothing matches twice and the best are enough.
    whole = ~F.col("costly") | ((F.col("field") == F.col("_field")) & (F.col("_n") == len(WEIGHTS)))
    routed = materialize(routed.withColumn("whole", whole).drop("_field", "_n", "_most"), "routed")
    n, hits, misses = F.size("grams"), None, [*rounds, rule.threshold]
    # Shares tell nothing of the order where the place counts too.
    if rule.distance is not None or routed.where(~F.col("whole")).limit(1).count() == 0:
        misses = [rule.threshold]
    for earlier, miss in zip([None, *misses], misses):
        need = F.when(F.col("whole"), F.col("need")).otherwise(least_overlap(n, miss))
        below = n + 1 if earlier is None else least_overlap(n, earlier)
        wanted = routed.withColumns({"need": need, "below": below}).where(F.col("place") <= n - F.col("need"))
        found = materialize(match_texts(wanted, index, fits, limit, rule), "hits")
        hits = found if hits is None else hits.unionByName(found)
        if miss == rule.threshold:
            return hits
        enough = hits.where(~F.col("whole")).groupBy("q").agg(F.sum(F.size("ids")).alias("_n")).where(F.col("_n") >= k)
        routed = routed.where(~F.col("whole")).join(enough, "q", "left_anti")


def _worth_checking(hits: DataFrame, fits: bool) -> DataFrame:
    """Of each query text the whole hits in that field where they are the fewer, if the other field may match as well."""
    cost = hits.where("whole").groupBy("q", "field").agg(F.sum("pairs").alias("cost"), F.bool_or("costly").alias("_costly"))
    chosen = cost.groupBy("q").agg(F.min_by("field", F.struct("cost", "field")).alias("field"), F.count("*").alias("_n"), F.bool_or("_costly").alias("_costly"))
    chosen = chosen.where(F.col("_costly") | (F.col("_n") == len(WEIGHTS)))
    return lookup(hits.where("whole"), chosen.select("q", "field"), ["q", "field"], "left_semi", fits=fits)


def weighed(field: Column | str, miss: Column | str, weights: Mapping[str, float]) -> Column:
    """The logarithm of a field's part of the score."""
    field, miss = (F.col(c) if isinstance(c, str) else c for c in (field, miss))
    weight = reduce(lambda other, name: other.when(field == name, F.lit(float(weights[name]))), WEIGHTS, F)
    return weight * F.ln(F.greatest(miss, F.lit(LEAST_MISS)))


def _matched_twice(hits: DataFrame, pairs: DataFrame, rule: Rule, weights: Mapping[str, float], fits: bool) -> DataFrame:
    """Pairs whose other text matches too: q, ids, score."""
    both = []
    for name, other in (WEIGHTS, reversed(WEIGHTS)):
        own = hits.where(F.col("field") == name).select("q", F.col("text").alias(name), "score", trigrams("q").alias("_grams"))
        met = skew_join(pairs, own, [name], fits=fits)
        counted = met.withColumn("_shared", F.explode(F.array(shared("_grams", other, rule.reach)))).where(F.col("_shared") > 0)
        near = counted.where(1 - F.col("_shared") / F.size("_grams") <= rule.threshold)
        missed = near.withColumns({"_other": F.lit(other), "_miss": F.explode(F.array(rule.miss(F.col("_shared"), "_grams", other)))})
        checked = missed.where(F.col("_miss") <= rule.threshold)
        both.append(checked.select("q", "ids", (F.col("score") + weighed("_other", "_miss", weights)).alias("score")))
    return both[0].unionByName(both[1])


def best_records(found: DataFrame, k: int) -> DataFrame:
    """The best `k` records of each query text from (q, ids, score).

    A record can come up three times: by its name, by its address and by both. The lowest score is the true one. So the
    best k records are within the 3 * (k + 1) best rows by score and first id, and only these come together.
    """
    scored = found.select("q", "ids", F.col("ids")[0].alias("id"), F.round(F.exp("score"), 6).alias("score"))
    short = first_rows(scored, ["q"], ["score", "id"], 3 * (k + 1))
    each = short.select("q", "score", F.explode("ids").alias("id")).groupBy("q", "id").agg(F.min("score").alias("score"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("rank") <= k)


def fuzzy_search(
    queries: DataFrame,
    records: DataFrame | SearchIndex,
    k: int = BEST,
    threshold: float = THRESHOLD,
    weights: Mapping[str, float] = WEIGHTS,
    limit: int = BROADCAST_ROWS,
    rounds: tuple[float, ...] = ROUNDS,
    distance: float | None = None,
) -> DataFrame:
    """The best `k` records for each query (qid, text): qid, rank, id, score. Queries under 3 characters find nothing.

    With a `distance` matches near the start of a field are preferred, and those too far behind are none.
    `limit` (rows to broadcast) and `rounds` (misses to try first for costly texts) do not change the result.
    """
    rule = Rule(threshold, distance)
    index = records if isinstance(records, SearchIndex) else build_index(records, k)
    if k > index.depth:
        raise ValueError(f"the index keeps {index.depth} ids per text, too few for the best {k}")
    typed = queries.where(long_enough("text")).select("qid", normalize_query("text").alias("q"))
    rare = materialize(rare_grams(typed, index.grams, threshold, limit), "rare")
    few_queries = few_enough(rare, limit)
    rounds = tuple(miss for miss in rounds if miss < threshold)
    hits = find_hits(rare, index, k, rule, few_queries, limit, rounds).withColumn("score", weighed("field", "miss", weights))
    narrow = materialize(_worth_checking(hits, few_queries).select("q", "field", "text", "score"), "narrow")
    both = _matched_twice(narrow, index.pairs, rule, weights, fits_broadcast(narrow, limit))
    best = best_records(hits.select("q", "ids", "score").unionByName(both), k)
    ranked = materialize(best.groupBy("q").agg(F.collect_list(F.struct("rank", "id", "score")).alias("found")), "ranked")
    return skew_join(typed, ranked, ["q"], limit=limit).select("qid", F.inline("found"))
