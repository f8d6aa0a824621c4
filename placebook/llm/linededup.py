"""Lines that earlier documents already have, found through sorted runs of line hashes.

Batches of documents come one after the other. The distinct line hashes of each batch are joined with the runs of all
earlier batches, what is new becomes a run of its own, and once a level has `fanout` runs they are merged into one of
the next level, so that their number grows with the logarithm of the number of batches. A run is a table bucketed and
sorted by hash: joining a batch with any number of runs shuffles the batch once and no run at all.

Of a key's documents the first batch wins, and within a batch the smallest id. Where batches come by ascending id, that
is the smallest id of all. A hash is 128 bits of MD5, of which no two keys of any real corpus share one.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placebook.llm.tables import ascii_lower, id_or_last
from placebook.operators.joins import own_name, shuffle_partitions, skew_join
from placebook.session import materialize, new_folder

# Keys of fewer characters are never dropped.
LEAST_KEY = 10
# Batches that a whole table is cut into, and runs of one level that are merged into one of the next.
BATCHES = 4
FANOUT = 3

BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines between the line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def hash_of(line: Column) -> Column:
    """128 bits for a line with a long enough key, else null."""
    key = key_of(line)
    return F.when(F.char_length(key) >= LEAST_KEY, F.unhex(F.md5(key)))


class LineRuns:
    """The line hashes of all batches so far, in levels of sorted runs."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = new_folder(spark, "line-runs")
        self.levels: list[list[str]] = []

    def _store(self, hashes: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        placed = hashes.repartition(self.buckets, "hash")
        writer = placed.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.folder}/{name}")
        writer.format("parquet").saveAsTable(name)
        return name

    def _push(self, name: str, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = self._store(reduce(DataFrame.unionAll, [self.spark.table(run) for run in runs]))
            for run in runs:
                self.spark.sql(f"drop table {run}")
            self._push(merged, level + 1)

    def forget(self) -> None:
        """Takes the runs out of the session's catalog; their files stay."""
        for name in (name for level in self.levels for name in level):
            self.spark.sql(f"drop table {name}")
        self.levels = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes a batch, rows of (doc, hash), and returns its keys that lose lines: (hash, owner), stored. The owner is
        the one document that keeps them, or null where an earlier batch has the key.
        """
        found = lines.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        found = materialize(found.repartition(self.buckets, "hash"), "batch-keys")
        placed = new = found.repartition(self.buckets, "hash")
        earlier = []
        for run in self.runs():
            earlier.append(placed.join(run.hint("merge"), "hash", "left_semi").select("hash", F.lit(None).cast("long").alias("owner")))
            new = new.join(run.hint("merge"), "hash", "left_anti")
        within = new.where("first < last").select("hash", F.col("first").alias("owner"))
        losing = materialize(reduce(DataFrame.unionAll, earlier, within), "losing-keys")
        self._push(self._store(new.select("hash")))
        return losing


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """`docs`, with `text` reduced to the lines that stay and two more columns that replace any of the same names:
    `n_lines` before and `n_dropped`. Needs doc_id and text; all other columns stay.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least LEAST_KEY characters
    that are found in two documents or more lose all their lines but those in the document with the smallest id. Rows
    with the same id count as one document; rows without an id count as one, which comes last. A null or empty text is
    one empty line, which stays, and comes back as an empty text. Repeated rows stay repeated. What a row loses is kept by
    its id and text, so rows of one id with different texts are worked on apart.
    """
    spark = docs.sparkSession
    keys = F.filter(F.transform(lines_of(F.col("text")), key_of), lambda key: F.char_length(key) >= LEAST_KEY)
    hashes = F.array_distinct(F.transform(keys, lambda key: F.unhex(F.md5(key))))
    mark = F.xxhash64("text")
    lines = docs.select(id_or_last().alias("doc"), mark.alias("mark"), F.explode(hashes).alias("hash"))
    edges = docs.select(id_or_last().alias("doc")).agg(F.percentile_approx("doc", [(i + 1) / batches for i in range(batches - 1)], 10_000)).first()[0]
    batch = reduce(lambda found, edge: found + (F.col("doc") > edge).cast("int"), edges or [], F.lit(0))
    lines = materialize(lines.withColumn("batch", batch), "lines")

    runs, losing = LineRuns(spark, fanout), []
    try:
        for i in range(batches):
            losing.append(runs.add(lines.where(F.col("batch") == i).select("doc", "hash")).withColumn("batch", F.lit(i)))
    finally:
        runs.forget()
    drops = skew_join(lines, reduce(DataFrame.unionAll, losing), ["batch", "hash"])
    drops = drops.where(F.col("owner").isNull() | (F.col("doc") != F.col("owner")))
    of_doc, of_mark, lost, kept = map(own_name, ("doc", "mark", "lost", "kept"))
    drops = drops.groupBy(F.col("doc").alias(of_doc), F.col("mark").alias(of_mark)).agg(F.collect_set("hash").alias(lost))

    texts = docs.withColumn(of_doc, id_or_last()).withColumn(of_mark, mark).join(drops, [of_doc, of_mark], "left").drop(of_doc, of_mark)
    all_lines = lines_of(F.col("text"))
    staying = F.filter(all_lines, lambda line: ~F.coalesce(F.array_contains(lost, hash_of(line)), F.lit(False)))
    done = texts.withColumn(kept, F.when(F.col(lost).isNull(), all_lines).otherwise(staying)).withColumn("n_lines", F.size(all_lines).cast("long"))
    done = done.withColumn("n_dropped", F.col("n_lines") - F.size(kept)).withColumn("text", F.array_join(kept, "\n"))
    return done.drop(kept, lost)


ORACLE = r"""
with lines as (
  select doc_id, unnest(list_zip(string_split(coalesce(text, ''), chr(10)), range(1, len(string_split(coalesce(text, ''), chr(10))) + 1))) as l
  from documents
), keyed as (
  select doc_id, l[1] as line, l[2] as place,
         translate(trim(l[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
), owners as (
  select k, min(doc_id) as owner from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2
), judged as (
  select doc_id, place, line, owner is null or owner = doc_id as stays from keyed left join owners using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (not stays) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (stays), '')) as kept_sha256
from judged group by doc_id
"""
