"""Benchmark passages in training texts, found by a broadcast hash set of the benchmark's word windows.

A hash of the first words of each window of a text is looked up in the set as the text is read, so that only hits leave a
task, and a row holds one number for each of its words at a time, however long it is. Only where a hash is found the
window's whole text is made and compared, which verifies the hit. The set is broadcast if it is within the library's limits;
a larger one is joined by shuffling, with windows that very many texts have spread over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placebook.llm.tables import ascii_lower
from placebook.operators.joins import lookup, own_name, skew_join
from placebook.session import fits_broadcast, materialize

WINDOW = 13
# Words at the start of a window that are hashed to look it up; of a shorter window all.
START = 5
# A text is contaminated if at least one in so many of its words is hit.
SHARE = 20

# What stands between words: ASCII but for digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null text has none."""
    spaced = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), GAPS, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def windows_of(words: Column, length: int) -> Column:
    """All runs of `length` words as (place, words joined by spaces)."""
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - (length - 1))).otherwise(F.array().cast("array<int>"))
    joined = lambda i: F.array_join(F.slice(words, i, length), " ")
    return F.transform(starts, lambda i: F.struct(i.alias("place"), joined(i).alias("window")))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(window, length, item_id) of every item, each once, stored. An item of fewer words than a window is one."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    short = F.array(F.struct(F.lit(1).alias("place"), F.array_join("words", " ").alias("window")))
    windows = F.when(F.size("words") < WINDOW, short).otherwise(windows_of(F.col("words"), WINDOW))
    found = items.select("item_id", F.least(F.size("words"), F.lit(WINDOW)).alias("length"), F.explode(F.transform(windows, lambda w: w["window"])).alias("window"))
    return materialize(found.distinct(), "benchmark-windows")


def start_hashes(words: Column, size: int) -> Column:
    """The hashes of `size` words from each place on; the first place is 0."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(words, i, size)))


def find_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Where benchmark windows lie in texts: (_row, place, length, window), stored. `docs`: _row, words."""
    distinct = materialize(windows.select("window", "length").distinct(), "distinct-windows")
    lengths = distinct.agg(F.collect_set("length")).first()[0]  # of 13 numbers at most
    if not lengths:
        return docs.select("_row", F.lit(0).alias("place"), F.lit(0).alias("length"), F.lit("").alias("window")).limit(0)
    size = F.least(F.col("length"), F.lit(START))
    starts = distinct.select(F.xxhash64(F.slice(F.split("window", " "), 1, size)).alias("start"), "length").distinct()
    met = None
    for n in sorted({min(length, START) for length in lengths}):
        some = starts.where(size == n)
        scanned = docs.select("_row", F.posexplode(start_hashes(F.col("words"), n)).alias("place", "start"))
        found = skew_join(scanned, some, ["start"], fits=fits_broadcast(some)).select("_row", (F.col("place") + 1).alias("place"), "length")
        met = found if met is None else met.unionByName(found)
    met = materialize(met, "window-starts").distinct().groupBy("_row").agg(F.collect_list(F.struct("place", "length")).alias("met"))
    texts = lookup(docs, met, ["_row"], "inner").dropDuplicates(["_row"])
    joined = F.transform("met", lambda m: F.struct(m["place"].alias("place"), m["length"].alias("length"), F.array_join(F.slice("words", m["place"], m["length"]), " ").alias("window")))
    return materialize(skew_join(texts.select("_row", F.inline(joined)), distinct, ["window", "length"]).select("_row", "place", "length", "window"), "benchmark-hits")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with the columns n_words, n_hit, n_items, items (the hit items' ids as sorted strings), spans (the runs of
    hit words, as first and last place from 1) and contaminated; they replace any of the same names.

    Words are runs of ASCII digits and letters, A-Z lower-cased, and of all characters beyond ASCII. A window is 13
    consecutive words of an item, or all words of an item of fewer; a word inside any occurrence of a window is hit.
    Rows of the same doc_id and text share one result; a null or empty text has no words and no hits; items without
    words are in no text; an item_id that occurs twice is one item.
    """
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text"), F.octet_length("text"))
    own = own_name("row")
    keyed = docs.drop("n_words", "n_hit", "n_items", "items", "spans", "contaminated").withColumn(own, row)
    windows = benchmark_windows(benchmark)
    hits = find_hits(keyed.select(F.col(own).alias("_row"), words_of(F.col("text")).alias("words")), windows)

    covered = hits.select("_row", "place", "length").distinct()
    covered = covered.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("place", "length"))).alias("found"))
    covered = covered.select("_row", merged(F.col("found")).alias("spans"))
    items = skew_join(hits.select("_row", "window").distinct(), windows.select("window", F.col("item_id").cast("string").alias("item")), ["window"])
    items = items.groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = materialize(covered.join(items, "_row"), "contaminated")

    counted = keyed.withColumn("n_words", F.size(words_of(F.col("text"))).cast("long"))
    judged = lookup(counted, found.withColumnRenamed("_row", own), [own]).drop(own)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["last"] - span["first"] + 1)
    judged = judged.withColumn("n_hit", F.coalesce(n_hit, F.lit(0).cast("long")))
    judged = judged.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    judged = judged.withColumn("n_items", F.size("items").cast("long"))
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the contaminated rows, columns as they were."""
    whole = docs.select("doc_id", "text", F.struct("*").alias("_all"))
    return contamination(whole, benchmark).where(~F.col("contaminated")).select("_all.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs`, the hit words taken out of their texts; what stands between words stays. All rows stay, also those of
    which nothing is left; columns as they were.
    """
    judged = contamination(docs.select("doc_id", "text", F.struct("*").alias("_all")), benchmark)
    text = F.coalesce(F.col("text"), F.lit(""))
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), 0), F.split(text, WORD, -1)
    inside = lambda place: F.exists("spans", lambda span: (span["first"] <= place) & (place <= span["last"]))
    left = F.transform(gaps, lambda gap, i: F.concat(gap, F.when((i >= F.size(words)) | inside(i + 1), F.lit("")).otherwise(F.coalesce(F.get(words, i), F.lit("")))))
    cleaned = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(left, ""))
    return judged.select("_all.*", cleaned.alias("_cleaned")).withColumn("text", F.col("_cleaned")).drop("_cleaned")


def merged(found: Column) -> Column:
    """Sorted occurrences merged where they touch or overlap."""
    start = F.array().cast("array<struct<first:int,last:int>>")

    def step(spans: Column, hit: Column) -> Column:
        last = F.get(spans, F.size(spans) - 1)
        end = hit["place"] + hit["length"] - 1
        grown = F.struct(last["first"].alias("first"), F.greatest(last["last"], end).alias("last"))
        fresh = F.struct(hit["place"].alias("first"), end.alias("last"))
        joins = F.coalesce(hit["place"] <= last["last"] + 1, F.lit(False))
        return F.when(joins, F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(spans, F.array(fresh)))

    return F.aggregate(found, start, step)


ORACLE = r"""
with lowered as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
), items as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark
), wanted as (
  select distinct item_id, least(13, len(words)) as n, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') as w
  from (select item_id, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) as i from items where len(words) > 0)
), windows as (
  select r, i, n, array_to_string(words[i:i + n - 1], ' ') as w
  from (select r, words, n, unnest(range(1, len(words) - n + 2)) as i from lowered, (select distinct n from wanted) where len(words) >= n)
), hits as (
  select distinct r, i, windows.n, item_id from windows join wanted using (w)
), covered as (
  select r, count(distinct place) as n_hit from (select r, unnest(range(i, i + n)) as place from hits) group by r
), found as (
  select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by r
)
select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from lowered left join covered using (r) left join found using (r)
"""
