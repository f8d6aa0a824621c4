"""A table that is updated in place, by versions.

A version is a small file that names the table's base and the changes since, so writing one switches all readers at once;
no data file is ever changed, and who reads a version goes on reading it. Changes are laid over the base when it is read.
Versions are numbered; one is written beside its place and then moved there, which fails if another writer was first: that
writer's changes are then kept and one's own come after them. On file systems whose rename is atomic (HDFS, local disks)
no reader sees half a version.

A change is one row for each key: `put` (the whole row), `set` (some columns of a row that is there) or `drop`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from placebook.operators.joins import lookup, named, own_name
from placebook.operators.latest import last_per_id
from placebook.session import fits_broadcast, materialize

# Changes that a reader lays over a base one by one before they are folded into one, which does not touch the base.
FOLD_FROM = 8


class AlreadyWritten(Exception):
    """Another writer was first."""


class VersionFiles:
    """The version files of a table, through the file system that Spark reads the path with."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, configuration = spark._jvm, spark._jsc.hadoopConfiguration()
        self._hadoop, self._gateway, self._io = jvm.org.apache.hadoop.fs, spark.sparkContext._gateway, jvm.org.apache.commons.io.IOUtils
        self._folder = self._hadoop.Path(f"{path}/_versions")
        self._files = self._folder.getFileSystem(configuration)
        self._folder = self._files.makeQualified(self._folder)
        self._context = self._hadoop.FileContext.getFileContext(self._folder.toUri(), configuration)

    def _path(self, name: str):
        return self._hadoop.Path(self._folder, name)

    def numbers(self) -> list[int]:
        if not self._files.exists(self._folder):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(self._folder)]
        return sorted(int(name[1:-5]) for name in names if name.startswith("v") and name.endswith(".json"))

    def load(self, number: int) -> dict:
        stream = self._files.open(self._path(f"v{number:012d}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, number: int, content: dict) -> None:
        """Raises AlreadyWritten if there is such a version."""
        waiting, place = self._path(own_name("waiting")), self._path(f"v{number:012d}.json")
        stream = self._files.create(waiting, True)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        try:
            self._context.rename(waiting, place, self._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0))
        except Exception:
            self._files.delete(waiting, False)
            if self._files.exists(place):
                raise AlreadyWritten(number) from None
            raise


@dataclass(frozen=True)
class Version:
    number: int
    keys: list[str]
    schema: str
    base: str
    changes: list[str] = field(default_factory=list)
    # By writer the last batch that it has brought in.
    batches: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """`create` writes the first version, `VersionedTable(spark, path)` opens a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = VersionFiles(spark, self.path)

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: Sequence[str]) -> VersionedTable:
        """A new table of rows with unique keys; fails if there is one. It needs a column besides the keys."""
        if set(df.columns) <= set(keys):
            raise ValueError("the table has no column besides its keys")
        table = cls(df.sparkSession, path)
        if table.versions():
            raise AlreadyWritten(path)
        table._files.write(0, asdict(Version(0, list(keys), df.schema.json(), table._store(df, "base"))))
        return table

    def _store(self, df: DataFrame, kind: str) -> str:
        folder = f"{self.path}/{own_name(kind)[1:]}"
        df.write.parquet(folder)
        return folder

    def versions(self) -> list[int]:
        return self._files.numbers()

    def version(self, number: int | None = None) -> Version:
        """A version, the last by default."""
        return Version(**self._files.load(self.versions()[-1] if number is None else number))

    # --- reading ---

    def _schema(self, version: Version) -> T.StructType:
        return T.StructType.fromJson(json.loads(version.schema))

    def _rest(self, version: Version) -> list[str]:
        return [name for name in self._schema(version).names if name not in version.keys]

    def _change_schema(self, version: Version) -> T.StructType:
        fields = {f.name: f for f in self._schema(version).fields}
        row = T.StructType([T.StructField(name, fields[name].dataType) for name in self._rest(version)])
        key = T.StructType([T.StructField(name, fields[name].dataType) for name in version.keys])
        return T.StructType([T.StructField("key", key), T.StructField("kind", T.StringType()), T.StructField("set", T.ArrayType(T.StringType()))]).add("row", row).add("in_base", "boolean")

    def _base(self, version: Version) -> DataFrame:
        return self.spark.read.schema(self._schema(version)).parquet(version.base)

    def _merged(self, version: Version) -> DataFrame:
        """One change for each key: what all changes together make of it."""
        schema, parts = self._change_schema(version), []
        for place, folder in enumerate(version.changes):
            parts.append(self.spark.read.schema(schema).parquet(folder).withColumn("at", F.lit(place)))
        if len(parts) == 1:
            return parts[0].drop("at")
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        whole_at = F.when(F.col("kind") != "set", F.col("at"))
        columns = [F.max(whole_at).alias("whole_at"), F.max_by(F.struct("kind", "row", "in_base"), whole_at).alias("whole")]
        names = self._rest(version)
        for i, name in enumerate(names):
            set_at = F.when(F.array_contains("set", name), F.col("at"))
            columns += [F.max(set_at).alias(f"at{i}"), F.max_by(F.struct(F.col("row")[name].alias("v")), set_at).alias(f"v{i}")]
        found = every.groupBy("key").agg(*columns)
        later = [F.col(f"at{i}").isNotNull() & (F.col("whole_at").isNull() | (F.col(f"at{i}") > F.col("whole_at"))) for i in range(len(names))]
        row = [F.when(is_later, F.col(f"v{i}.v")).otherwise(F.col("whole.row")[name]).alias(name) for i, (name, is_later) in enumerate(zip(names, later))]
        set_names = F.filter(F.array(*[F.when(is_later, F.lit(name)) for name, is_later in zip(names, later)]), lambda name: name.isNotNull())
        kind = F.coalesce("whole.kind", F.lit("set"))
        return found.select("key", kind.alias("kind"), F.when(kind == "set", set_names).otherwise(F.array().cast("array<string>")).alias("set"), F.struct(*row).alias("row"), F.col("whole.in_base").alias("in_base"))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the last by default. Few changes are broadcast, and the base is then not shuffled."""
        version = self.version(number)
        base = self._base(version)
        if not version.changes:
            return base
        merged = materialize(self._merged(version), "changes")
        change = own_name("change")
        keyed = merged.select("key.*", F.struct("kind", "set", "row").alias(change))
        met = lookup(base, keyed, version.keys)
        met = met.where(F.col(change).isNull() | (F.col(f"{change}.kind") != "drop"))
        taken = lambda name: F.coalesce((F.col(f"{change}.kind") == "put") | F.array_contains(F.col(f"{change}.set"), name), F.lit(False))
        columns = [named(name) if name in version.keys else F.when(taken(name), F.col(f"{change}.row")[name]).otherwise(named(name)).alias(name) for name in base.columns]
        added = merged.where((F.col("kind") == "put") & ~F.col("in_base")).select("key.*", "row.*")
        return met.select(*columns).unionByName(added)

    # --- writing ---

    def _change(self, version: Version, df: DataFrame, kind: str, columns: Sequence[str]) -> DataFrame:
        """Rows with unique keys as changes; those with a null in a key are none."""
        schema = self._change_schema(version)
        types = {f.name: f.dataType for f in schema["row"].dataType.fields}
        key = F.struct(*[named(f.name).cast(f.dataType).alias(f.name) for f in schema["key"].dataType.fields])
        row = F.struct(*[(named(name) if name in columns else F.lit(None)).cast(kind_).alias(name) for name, kind_ in types.items()])
        for name in version.keys:
            df = df.where(named(name).isNotNull())
        set_names = F.array(*map(F.lit, columns if kind == "set" else [])).cast("array<string>")
        return df.select(key.alias("key"), F.lit(kind).alias("kind"), set_names.alias("set"), row.alias("row"), F.lit(False).alias("in_base"))

    def _with_place(self, version: Version, changes: DataFrame) -> DataFrame:
        """Changes that say whether the base has their key."""
        keys = changes.select("key.*")
        base = self._base(version).select(*map(named, version.keys))
        there = materialize(lookup(base, keys, version.keys, "left_semi").distinct(), "known-keys")
        known, change = own_name("known"), own_name("change")
        keyed = changes.select("key.*", F.struct("key", "kind", "set", "row").alias(change))
        marked = lookup(keyed, there.withColumn(known, F.lit(True)), version.keys)
        return marked.select(f"{change}.*", F.coalesce(known, F.lit(False)).alias("in_base"))

    def _commit(self, make: Callable[[Version], Version | None]) -> int:
        """Writes the version that `make` makes of the last one, again if another writer was first."""
        while True:
            last = self.version()
            made = make(last)
            if made is None:
                return last.number
            try:
                self._files.write(last.number + 1, asdict(replace(made, number=last.number + 1)))
                return last.number + 1
            except AlreadyWritten:
                continue

    def _bring(self, df: DataFrame, kind: str, columns: Sequence[str], batch: tuple[str, int] | None) -> int:
        if batch is not None and self.version().batches.get(batch[0], -1) >= batch[1]:
            return self.version().number
        changes = materialize(self._change(self.version(), df, kind, columns), "changes")
        stored: dict[str, str] = {}  # by base, as it decides whether a row is new

        def make(version: Version) -> Version | None:
            if batch is not None and version.batches.get(batch[0], -1) >= batch[1]:
                return None
            place = version.base if kind == "put" else ""
            if place not in stored:
                stored[place] = self._store(self._with_place(version, changes) if kind == "put" else changes, kind)
            batches = version.batches if batch is None else {**version.batches, batch[0]: batch[1]}
            return replace(version, changes=[*version.changes, stored[place]], batches=batches)

        number = self._commit(make)
        if len(self.version().changes) >= FOLD_FROM:
            number = self.fold()
        return number

    def update(self, updates: DataFrame, columns: Sequence[str], order: Sequence[str], batch: tuple[str, int] | None = None) -> int:
        """Overwrites the named columns of the rows whose key occurs in `updates`, null and '' too; the new version's number.

        The last update of a key by `order` counts; keys unknown to the table are ignored. A `batch` (writer, number)
        that the writer has brought in before, or one with a smaller number, changes nothing: a repeated batch has no
        second effect. So do `put` and `drop`.
        """
        keys = self.version().keys
        return self._bring(last_per_id(updates, order, keys=keys), "set", columns, batch)

    def put(self, rows: DataFrame, order: Sequence[str], batch: tuple[str, int] | None = None) -> int:
        """Puts whole rows in the place of those with the same key, or adds them; the last of a key by `order` counts."""
        version = self.version()
        return self._bring(last_per_id(rows, order, keys=version.keys), "put", self._rest(version), batch)

    def drop(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Takes out the rows with these keys."""
        return self._bring(keys.select(*map(named, self.version().keys)).distinct(), "drop", [], batch)

    def fold(self) -> int:
        """Makes one of all changes; the base is not read."""
        return self._rebuilt(lambda version: replace(version, changes=[self._store(self._merged(version), "fold")]) if len(version.changes) > 1 else None)

    def compact(self) -> int:
        """Writes the rows as they are now as a new base."""
        return self._rebuilt(lambda version: replace(version, base=self._store(self.read(version.number), "base"), changes=[]) if version.changes else None)

    def _rebuilt(self, make: Callable[[Version], Version | None]) -> int:
        """Like `_commit`, but changes that another writer has brought in meanwhile stay behind what was made."""
        made: list[tuple[Version, Version]] = []

        def again(version: Version) -> Version | None:
            if made:
                seen, result = made[0]
                if version.base == seen.base and version.changes[: len(seen.changes)] == seen.changes and not (version.base != result.base and len(version.changes) > len(seen.changes)):
                    return replace(result, changes=[*result.changes, *version.changes[len(seen.changes) :]], batches=version.batches)
                made.clear()
            result = make(version)
            if result is not None:
                made.append((version, result))
            return result

        return self._commit(again)


def update_stream(updates: DataFrame, table: VersionedTable, columns: Sequence[str], order: Sequence[str], checkpoint: str, writer: str, trigger=None) -> StreamingQuery:
    """Writes each batch of a stream of updates into the table as a version of its own. A batch that is run again after a
    failure has no second effect; `writer` names the stream, and a new checkpoint needs a new name.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table.update(batch, columns, order, (writer, batch_id))

    stream = updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()
