"""A search index that is kept up to date: records come, change and go without the index being built anew.

Each batch of records becomes a segment, a saved search index of its own. Once a level has FANOUT segments they are merged
into one of the next level, so that their number grows with the logarithm of the number of batches. A record that goes, or
comes again, is noted as gone in the one segment that has it. There it may be among the few ids that a text keeps: those
texts are repaired from the segment's records and laid over it, all others stay as they are stored.

A search looks in each segment that has any of the typed trigrams and keeps the best of all. As every record lives in one
segment, that is what one index of all records would find. Versions are small files, as of a versioned table: a reader
keeps the one that it began with.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from placebook.functions.text import long_enough, normalize_query, trigrams
from placebook.operators.joins import lookup, own_name
from placebook.operators.search import BEST, WEIGHTS, SearchIndex, build_index, first_ids, first_rows, fuzzy_search, load_index, spread_texts
from placebook.session import materialize
from placebook.sinks.versions import VersionFiles

FANOUT = 4
RECORD = ["id", "nom", "adresse"]


@dataclass(frozen=True)
class Segment:
    folder: str  # index and records
    level: int
    low: int  # smallest and largest id
    high: int
    gone: list[str] = field(default_factory=list)  # ids that are not to be found any more
    patch: str | None = None  # texts and pairs as they are without those


@dataclass(frozen=True)
class Version:
    number: int
    depth: int
    segments: list[Segment] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)


class LiveIndex:
    """`create` starts an empty one, `LiveIndex(spark, path)` opens it. One writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self._files = VersionFiles(spark, self.path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, depth: int = BEST, fanout: int = FANOUT) -> LiveIndex:
        """An index for the best `depth` of a search at most; fails if there is one."""
        new = cls(spark, path, fanout)
        new._files.write(0, asdict(Version(0, depth)))
        return new

    def version(self, number: int | None = None) -> Version:
        loaded = self._files.load(self._files.numbers()[-1] if number is None else number)
        return Version(**{**loaded, "segments": [Segment(**segment) for segment in loaded["segments"]]})

    # --- what a segment holds ---

    def _records(self, segment: Segment) -> DataFrame:
        """The records of a segment that are not gone."""
        records = self.spark.read.parquet(f"{segment.folder}/records")
        return lookup(records, self.spark.read.parquet(*segment.gone), ["id"], "left_anti") if segment.gone else records

    def _index(self, segment: Segment) -> SearchIndex:
        """The index of a segment, with repaired texts and pairs in the place of those that lost an id."""
        index = load_index(self.spark, f"{segment.folder}/index")
        if segment.patch is None:
            return index
        texts, pairs = (self.spark.read.parquet(f"{segment.patch}/{name}") for name in ("texts", "pairs"))
        filled = F.size("ids") > 0

        def patched(stored: DataFrame, patch: DataFrame, keys: list[str], rows: DataFrame) -> DataFrame:
            return lookup(stored, patch.select(*keys), keys, "left_anti").unionByName(rows)

        return replace(
            index,
            texts=patched(index.texts, texts, ["field", "text"], texts.where(filled)),
            pairs=patched(index.pairs, pairs, ["nom", "adresse"], pairs.where(filled)),
            postings=patched(index.postings, texts, ["field", "text"], spread_texts(texts.where(filled))),
        )

    # --- writing ---

    def _segment(self, records: DataFrame, level: int, depth: int) -> Segment | None:
        folder = f"{self.path}/{own_name('segment')[1:]}"
        records.write.parquet(f"{folder}/records")
        stored = self.spark.read.schema(records.schema).parquet(f"{folder}/records")
        low, high = stored.agg(F.min("id"), F.max("id")).first()
        if low is None:
            return None
        build_index(stored, depth).save(f"{folder}/index")
        return Segment(folder, level, low, high)

    def _without(self, segment: Segment, ids: DataFrame, low: int, high: int, depth: int) -> Segment:
        """A segment without the records of these ids, `low` to `high`. Its records are only read if it may have any."""
        if high < segment.low or segment.high < low:
            return segment
        gone = materialize(lookup(self._records(segment).select("id"), ids, ["id"], "left_semi"), "gone")
        if gone.limit(1).count() == 0:
            return segment
        folder = f"{self.path}/{own_name('gone')[1:]}"
        gone.write.parquet(folder)
        after = replace(segment, gone=[*segment.gone, folder], patch=f"{folder}-patch")

        index, stored = self._index(segment), load_index(self.spark, f"{segment.folder}/index")
        plain = self._records(after).select("id", normalize_query("nom").alias("nom"), normalize_query("adresse").alias("adresse"))

        def hit(table: DataFrame, keys: list[str]) -> DataFrame:
            """Rows of the stored table that lost an id now or before."""
            now = lookup(table.select(*keys, F.explode("ids").alias("id")), gone, ["id"], "left_semi").select(*keys).distinct()
            if segment.patch is not None:
                name = "texts" if "text" in keys else "pairs"
                now = now.unionByName(self.spark.read.parquet(f"{segment.patch}/{name}").select(*keys)).distinct()
            return materialize(now, "repaired")

        lost_pairs, lost_texts = hit(index.pairs, ["nom", "adresse"]), hit(index.texts, ["field", "text"])
        none = F.array().cast(dict(stored.pairs.dtypes)["ids"])
        ids_of = first_ids(lookup(plain, lost_pairs, ["nom", "adresse"], "left_semi"), ["nom", "adresse"], depth)
        lookup(lost_pairs, ids_of, ["nom", "adresse"]).withColumn("ids", F.coalesce("ids", none)).write.parquet(f"{after.patch}/pairs")

        fields = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("text")) for name in WEIGHTS]))
        by_text = lookup(plain.select("id", fields.alias("_f")).select("id", "_f.field", "_f.text"), lost_texts, ["field", "text"], "left_semi")
        counts = lookup(stored.texts.select("field", "text", "pairs"), lost_texts, ["field", "text"], "left_semi")
        repaired = lookup(counts, first_ids(by_text, ["field", "text"], depth), ["field", "text"])
        repaired.select("field", "text", F.coalesce("ids", none).alias("ids"), "pairs").write.parquet(f"{after.patch}/texts")
        return after

    def _apply(self, records: DataFrame | None, ids: DataFrame, batch: tuple[str, int] | None) -> int:
        version = self.version()
        if batch is not None and version.batches.get(batch[0], -1) >= batch[1]:
            return version.number
        ids = materialize(ids.where(F.col("id").isNotNull()).select("id").distinct(), "ids")
        low, high = ids.agg(F.min("id"), F.max("id")).first()
        segments = [s if low is None else self._without(s, ids, low, high, version.depth) for s in version.segments]
        if records is not None:
            new = self._segment(records, 0, version.depth)
            segments += [new] if new else []
        segments = self._merged(segments, version.depth)
        batches = version.batches if batch is None else {**version.batches, batch[0]: batch[1]}
        self._files.write(version.number + 1, asdict(Version(version.number + 1, version.depth, segments, batches)))
        return version.number + 1

    def _merged(self, segments: list[Segment], depth: int) -> list[Segment]:
        """Levels with too many segments made one of the next."""
        level = 0
        while any(s.level >= level for s in segments):
            full = [s for s in segments if s.level == level]
            if len(full) >= self.fanout:
                records = self._records(full[0])
                for s in full[1:]:
                    records = records.unionByName(self._records(s))
                made = self._segment(records, level + 1, depth)
                segments = [s for s in segments if s.level != level] + ([made] if made else [])
            level += 1
        return segments

    def put(self, records: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Adds records (id, nom, adresse) with ids of their own, in the place of those with the same id; the new version's
        number. Records without an id are none. A `batch` (writer, number) that was brought in before changes nothing.
        """
        records = materialize(records.select(*RECORD).where(F.col("id").isNotNull()), "records")
        return self._apply(records, records, batch)

    def remove(self, ids: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Takes out the records of these ids."""
        return self._apply(None, ids, batch)

    # --- reading ---

    def records(self, number: int | None = None) -> DataFrame:
        version = self.version(number)
        found = self.spark.createDataFrame([], "id long, nom string, adresse string")
        for segment in version.segments:
            found = found.unionByName(self._records(segment))
        return found

    def needed(self, queries: DataFrame, number: int | None = None) -> list[Segment]:
        """The segments that have any trigram of the typed texts."""
        typed = queries.where(long_enough("text")).select(F.explode(trigrams(normalize_query("text"))).alias("gram")).distinct()
        typed = materialize(typed, "typed-grams")
        have = lambda s: lookup(self.spark.read.parquet(f"{s.folder}/index/grams"), typed, ["gram"], "left_semi").limit(1).count()
        return [segment for segment in self.version(number).segments if have(segment)]

    def search(self, queries: DataFrame, k: int = BEST, number: int | None = None, **options) -> DataFrame:
        """As `fuzzy_search` of all records of a version, the last by default; `options` are those of it."""
        if k > self.version(number).depth:
            raise ValueError(f"the index keeps {self.version(number).depth} ids per text, too few for the best {k}")
        row = own_name("row")
        asked = materialize(queries.select(F.monotonically_increasing_id().alias(row), "qid", "text"), "asked")
        numbered = asked.select(F.col(row).alias("qid"), "text")
        found = None
        for segment in self.needed(queries, number):
            some = fuzzy_search(numbered, self._index(segment), k, **options).drop("rank")
            found = some if found is None else found.unionByName(some)
        if found is None:
            return asked.select("qid", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0)
        best = first_rows(materialize(found, "found"), ["qid"], ["score", "id"], k)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("score", "id"))).withColumnRenamed("qid", row)
        return lookup(ranked, asked.select(row, "qid"), [row], "inner").select("qid", "rank", "id", "score")
