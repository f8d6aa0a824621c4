"""Codes of vectors: each of four parts of a vector is replaced by the number of the nearest entry of a small codebook.

Vectors become integers, so that every sum and distance is exact. Chunks of vectors are stored once: of each part
position the points in the order of a Hilbert curve, cut into flat blocks of which the box (least and greatest value of
each component) and the sum are kept. In each round a block's box tells which entries can be nearest to any point in it.
A block with one such entry goes to it as a whole, by its sum; only the others are computed point by point, against their
short list. A chunk is one row, so neither the rounds nor the codes need a shuffle or a join: what leaves the tasks is,
for each, one sum and one count per entry.

How far an entry e is from a point x, less how far the entry p nearest to the middle of the box is, is linear in x, so
its least value over a box is exact: an entry is on the short list if that is not above zero.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from placebook.operators.joins import skew_join
from placebook.session import materialize, new_folder

PARTS = 4
ENTRIES = 256  # two hex digits
ROUNDS = 4
SCALE = 1024
# Vectors of a chunk, which is one row; points of a block; chunks of a file, so that a reader's batch stays small.
CHUNK = 16_384
BLOCK = 64
FILE_CHUNKS = 16


# --- order of a Hilbert curve ----------------------------------------------------------------------------------------


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """The places of the points (n x d integers) in the order of a Hilbert curve over their box; ties stay in order."""
    n, d = points.shape
    if n < 2 or not d:
        return np.arange(n)
    bits = max(1, min(8, 64 // d))
    low, high = points.min(axis=0), points.max(axis=0)
    x = (((points - low) << bits) // (high - low + 1)).astype(np.uint8).T.copy()
    for level in range(bits - 1, 0, -1):
        below = np.uint8((1 << level) - 1)
        for i in range(d):
            turned = ((x[i] >> level) & 1).astype(bool)
            swapped = np.where(turned, 0, (x[0] ^ x[i]) & below).astype(np.uint8)
            x[0] ^= np.where(turned, below, swapped).astype(np.uint8)
            x[i] ^= swapped
    for i in range(1, d):
        x[i] ^= x[i - 1]
    last = np.zeros(n, np.uint8)
    for level in range(bits - 1, 0, -1):
        last ^= np.where((x[d - 1] >> level) & 1, np.uint8((1 << level) - 1), np.uint8(0))
    x ^= last
    rows = [(x[i] >> level) & 1 for level in range(bits - 1, -1, -1) for i in range(d)]
    packed = np.packbits(np.stack(rows), axis=0)
    return np.lexsort(packed[::-1])


# --- blocks ----------------------------------------------------------------------------------------------------------


@dataclass
class Blocks:
    """The points of one part position of a chunk in blocks: `points` in curve order, `order` their places in the chunk."""

    order: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Blocks:
        order = hilbert_order(points)
        points = points[order]
        starts = np.arange(0, len(points), BLOCK)
        ends = np.minimum(starts + BLOCK, len(points))
        boxes = [f.reduceat(points, starts, axis=0) for f in (np.minimum, np.maximum, np.add)]
        return cls(order, points, *boxes, ends - starts)


def kernel_type(d: int, most: int) -> type:
    """The numbers in which all distances of integers up to `most` are exact: floats while they are, they are faster."""
    largest = 10 * max(1, d) * max(1, most) ** 2
    if largest < 1 << 53:
        return np.float64
    if largest < 1 << 63:
        return np.int64
    raise ValueError("components are too large for exact distances")


class Codebook:
    """The entries of one part position, and what the short lists need of them."""

    def __init__(self, entries: np.ndarray, most: int):
        self.kind = kernel_type(entries.shape[1], max(most, int(np.abs(entries).max(initial=0))))
        self.entries = entries.astype(self.kind)
        self.norms = (self.entries * self.entries).sum(axis=1)
        self.apart: dict[int, np.ndarray] = {}

    def short_lists(self, blocks: Blocks) -> Iterator[np.ndarray]:
        """For each block the entries that can be nearest to any point of its box, ascending."""
        low, high = blocks.low.astype(self.kind), blocks.high.astype(self.kind)
        middles, widths = low + high, high - low  # both twice what they are
        along = middles @ self.entries.T
        pivots = np.argmin(2 * self.norms - 2 * along, axis=1)
        for block, p in enumerate(pivots.tolist()):
            if p not in self.apart:
                self.apart[p] = np.abs(self.entries - self.entries[p])
            reach = along[block] - along[block, p] + self.apart[p] @ widths[block]
            yield np.flatnonzero(reach >= self.norms - self.norms[p])

    def assign(self, blocks: Blocks, errors: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
        """(codes, sums, errors, counts, exact) of the points in curve order; entry by entry the sums and counts of its
        points; errors on request; whether each point was computed rather than taken with its block.
        """
        n, k, d = len(blocks.points), *self.entries.shape
        codes, exact = np.zeros(n, np.int64), np.zeros(n, bool)
        found = np.zeros(n, self.kind) if errors else None
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        start = 0
        for block, able in enumerate(self.short_lists(blocks)):
            end = start + int(blocks.counts[block])
            if len(able) == 1 and not errors:
                codes[start:end] = able[0]
                sums[able[0]] += blocks.sums[block]
                counts[able[0]] += end - start
            else:
                points = blocks.points[start:end].astype(self.kind)
                distances = self.norms[able] - 2 * (points @ self.entries[able].T)
                nearest = np.argmin(distances, axis=1)
                codes[start:end] = able[nearest]
                exact[start:end] = True
                if errors:
                    found[start:end] = distances[np.arange(end - start), nearest] + (points * points).sum(axis=1)
            start = end
        if exact.any():
            inside, points = codes[exact], blocks.points[exact]
            order = np.argsort(inside, kind="stable")
            entries, starts = np.unique(inside[order], return_index=True)
            sums[entries] += np.add.reduceat(points[order].astype(np.int64), starts, axis=0)
            counts[entries] += np.diff(np.append(starts, len(inside)))
        return codes, sums, found, counts, exact


# --- tables ----------------------------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Whether a vector has components, none of them null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))


def _whole(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max(initial=0) >= 1 << 31:
        raise ValueError("components are too large for exact distances")
    return scaled.astype(np.int64)


def _chunk_rows(batches: Iterable[pa.RecordBatch], dimensions: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, vector, label), by the CHUNK, as rows of the table of blocks."""

    def row(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables).combine_chunks()
        column = table["vector"].chunk(0)
        lengths = np.diff(column.offsets.to_numpy())
        if (lengths != dimensions).any():
            raise ValueError(f"vectors of {dimensions} components and of {lengths[lengths != dimensions][0]}")
        points = _whole(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dimensions)
        most = int(np.abs(points).max())
        kind = "<i2" if most < 1 << 15 else "<i4"
        width = dimensions // PARTS
        parts = [Blocks.of(points[:, p * width : (p + 1) * width]) for p in range(PARTS)]
        packed = lambda name, kind: b"".join(getattr(part, name).astype(kind).tobytes() for part in parts)
        lists = [pa.ListArray.from_arrays([0, len(points)], table[name].chunk(0)) for name in ("vec_id", "label")]
        rest = [kind, most, packed("order", "<i4"), packed("points", kind), packed("low", kind), packed("high", kind), packed("sums", "<i8")]
        return pa.RecordBatch.from_arrays([*lists, *[pa.array([value], field.type) for value, field in zip(rest, list(schema)[2:])]], schema=schema)

    waiting: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        while table.num_rows:
            room = CHUNK - sum(t.num_rows for t in waiting)
            waiting.append(table.slice(0, room))
            table = table.slice(room)
            if sum(t.num_rows for t in waiting) == CHUNK:
                yield row(waiting)
                waiting = []
    if waiting:
        yield row(waiting)


def block_table(vectors: DataFrame, dimensions: int) -> DataFrame:
    """The stored chunks of rows (vec_id, vector, label): ids, labels, and of all part positions the blocks."""
    ids, labels = vectors.schema["vec_id"].dataType, vectors.schema["label"].dataType
    fields = [T.StructField("ids", T.ArrayType(ids)), T.StructField("labels", T.ArrayType(labels)), T.StructField("kind", T.StringType())]
    fields += [T.StructField("most", T.LongType()), *[T.StructField(name, T.BinaryType()) for name in ("order", "points", "low", "high", "sums")]]
    schema = T.StructType(fields)

    def chunks(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        return _chunk_rows(batches, dimensions, to_arrow_schema(schema))

    folder = new_folder(vectors.sparkSession, "vector-blocks")
    vectors.select("vec_id", "vector", "label").mapInArrow(chunks, schema).write.option("maxRecordsPerFile", FILE_CHUNKS).parquet(folder)
    return vectors.sparkSession.read.schema(schema).parquet(folder)


def _blocks_of(row: dict, dimensions: int) -> list[Blocks]:
    width, n = dimensions // PARTS, len(row["order"].as_py()) // (4 * PARTS)
    n_blocks = -(-n // BLOCK)
    counts = np.minimum(BLOCK, n - np.arange(n_blocks) * BLOCK)
    read = lambda name, kind, *shape: np.frombuffer(row[name].as_py(), kind).reshape(PARTS, *shape)
    kind = row["kind"].as_py()
    orders, points = read("order", "<i4", n), read("points", kind, n, width)
    low, high, sums = (read(name, of, n_blocks, width) for name, of in (("low", kind), ("high", kind), ("sums", "<i8")))
    return [Blocks(orders[p], points[p], low[p], high[p], sums[p], counts) for p in range(PARTS)]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}


def next_codebooks(chunks: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, each entry becomes the floor of the mean of its parts. Each task
    gives one row for each entry that it used.
    """
    width = codebooks[0].shape[1]

    def partial_sums(batches):
        totals = [(np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)) for book in codebooks]
        books: dict[int, list[Codebook]] = {}
        for row in _rows(batches):
            most = row["most"].as_py()
            for p, blocks in enumerate(_blocks_of(row, width * PARTS)):
                book = books.setdefault(most.bit_length(), [Codebook(entries, (1 << most.bit_length()) - 1) for entries in codebooks])[p]
                _, sums, _, counts, _ = book.assign(blocks, errors=False)
                totals[p][0][:] += sums
                totals[p][1][:] += counts
        used = [(p, e) for p in range(PARTS) for e in np.flatnonzero(totals[p][1]).tolist()]
        columns = [[p for p, _ in used], [e for _, e in used], [int(totals[p][1][e]) for p, e in used], [totals[p][0][e].tolist() for p, e in used]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "entry", "n", "sums"])

    sums = chunks.drop("ids", "labels").mapInArrow(partial_sums, "part int, entry int, n long, sums array<long>").groupBy("part", "entry")
    sums = sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    done = [book.copy() for book in codebooks]
    for row in sums.agg(F.collect_list(F.struct("*"))).first()[0]:  # at most PARTS * ENTRIES rows
        done[row.part][row.entry] = [total // row.n for total in row.sums]
    return done


def codes(chunks: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of all chunks."""
    width = codebooks[0].shape[1]
    schema = T.StructType([T.StructField("vec_id", chunks.schema["ids"].dataType.elementType), T.StructField("label", chunks.schema["labels"].dataType.elementType)])
    schema = schema.add("code", "string").add("error", "long")

    def coded(batches):
        for row in _rows(batches):
            n = len(row["ids"])
            numbers, errors = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
            for p, blocks in enumerate(_blocks_of(row, width * PARTS)):
                found, _, distances, _, _ = Codebook(codebooks[p], row["most"].as_py()).assign(blocks, errors=True)
                numbers[blocks.order, p] = found
                errors[blocks.order] += distances.astype(np.int64)
            text = numbers.tobytes().hex()
            step = 2 * PARTS
            values = [row["ids"].values, row["labels"].values, pa.array([text[i : i + step] for i in range(0, n * step, step)], pa.string()), pa.array(errors)]
            yield pa.RecordBatch.from_arrays(values, ["vec_id", "label", "code", "error"])

    return chunks.mapInArrow(coded, schema)


def digest(codebooks: list[np.ndarray]) -> str:
    """A digest of all entries: decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in codebooks for x in book.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error), stored, of rows with vec_id, embedding and label, and the four codebooks.

    Rows are dropped whose vector is null, empty, or holds a null or non-finite component. A component x becomes
    floor(1024 x). The codebooks start as the parts of the 256 rows of smallest id, equal ids by their vectors, rows
    without an id last; with fewer rows they have fewer entries. A tie between entries goes to the lower one; entries
    that no part is nearest to stay. Repeated rows stay repeated; an empty table gives an empty one and empty codebooks.
    All vectors must have as many components, a multiple of four, else an error says so; so it does for components too
    large for exact distances in 64 bits (beyond about 200,000). Other columns are ignored.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"), "label").where(usable(F.col("embedding")))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES)
    first = first.agg(F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "vector")))).first()[0]
    dimensions = len(first[0].vector) if first else 0
    if dimensions % PARTS or any(len(row.vector) != dimensions for row in first):
        raise ValueError(f"vectors need one number of components that is a multiple of {PARTS}")
    whole = _whole(np.array([row.vector for row in first], np.float64).reshape(len(first), dimensions))
    width = dimensions // PARTS
    books = [whole[:, p * width : (p + 1) * width] for p in range(PARTS)]
    chunks = block_table(rows, dimensions)
    for _ in range(rounds if first else 0):
        books = next_codebooks(chunks, books)
    return materialize(codes(chunks, books), "codes"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The codes with label_error, the errors summed over rows of equal labels; rows without a label are one group."""
    keyed = coded.withColumns({"_label": F.col("label"), "_none": F.col("label").isNull()})
    default = F.lit("") if isinstance(coded.schema["label"].dataType, T.StringType) else F.lit(0)
    keyed = keyed.withColumn("_label", F.coalesce("_label", default.cast(coded.schema["label"].dataType)))
    sums = materialize(keyed.groupBy("_label", "_none").agg(F.sum("error").alias("label_error")), "label-errors")
    return skew_join(keyed, sums, ["_label", "_none"]).drop("_label", "_none")


def _oracle() -> str:
    ctes = [
        """kept as (
  select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
)""",
        "parts as (select r, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] as x from kept, range(4) as t(p))",
        "book0 as (select p, r - 1 as e, x as c from parts where r <= 256)",
    ]
    for i in range(ROUNDS + 1):
        distance = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
        ctes.append(f"near{i} as materialized (select r, p, any_value(x) as x, min({{'d': {distance}, 'e': e}}) as best from parts join book{i} using (p) group by r, p)")
        if i < ROUNDS:
            ctes.append(
                f"""means{i} as (
  select p, e, list(floor(s / n) order by k) as c
  from (select p, best.e as e, k, sum(x[k]) as s, count(*) as n from near{i}, range(1, 1000) as t(k) where k <= len(x) group by all) group by p, e
)"""
            )
            ctes.append(f"book{i + 1} as materialized (select p, e, coalesce(m.c, b.c) as c from book{i} b left join means{i} m using (p, e))")
    ctes.append(f"final as (select r, string_agg(printf('%02x', best.e::int), '' order by p) as code, sum(best.d)::bigint as error from near{ROUNDS} group by r)")
    ctes.append(f"digest as (select sha256(coalesce(string_agg(array_to_string(list_transform(c, lambda x: x::bigint), ','), ',' order by p, e), '')) as codebooks_sha256 from book{ROUNDS})")
    result = "select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join final using (r), digest"
    return "with " + ",\n".join(ctes) + "\n" + result


ORACLE = _oracle()
