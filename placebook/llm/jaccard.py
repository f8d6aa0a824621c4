"""Groups of documents whose word shingles overlap: every link with a Jaccard similarity of at least 0.8.

1. Documents with equal sets are one class. What follows works on one set for each class.
2. Sets that cannot have a link are left out, exactly. Two linked sets share enough of their lowest hashes, so a set of
   whose lowest hashes too few are in any other set has no link; the rest is asked the same of all its hashes: four
   fifths must be in another set. Each step is one shuffle of (shingle, set). A batch that holds a shingle many times
   sends it once and counts the rest itself, so no shingle brings more rows to a task than there are batches.
3. Sets that share one of their rarest shingles, as many as a linked set can lack and one more, are in one block.
4. Blocks are searched by T-occurrence: of a set's inverted lists the shortest are merged by a heap, and the documents
   met there are looked up in the long lists by binary search until they reach the overlap or cannot any more
   (DivideSkip). Documents already known to be in one group are not compared again.
5. A block beyond the limits of a task is cut into chunks: each is searched alone, groups of different chunks are joined
   through representatives, and only what is then outside the block's largest group is searched in all its chunks.
6. Links make components.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from placebook.llm.graphs import components
from placebook.llm.shingles import mix, shingle_sets, slices
from placebook.llm.tables import LAST_ID, id_or_last
from placebook.operators.joins import lookup, own_name, shuffle_partitions, skew_join
from placebook.session import materialize

# Two sets are linked if their intersection has at least this share, in hundredths, of their union.
LEAST = 80
# What one task takes of a block: sets, and shingles of all sets.
BLOCK_SETS = 2048
BLOCK_SHINGLES = 2_000_000
# Shingles of sets that a task puts in order at a time.
BATCH_SHINGLES = 1_000_000
# A shingle in fewer sets is not looked at as one that could be too much for a task.
LEAST_HOT = 1000
REPRESENTATIVE_ROUNDS = 2


def least_shared(n):
    """Of a set of n, the shingles that a linked set has at least: the intersection has this share of n."""
    return -(-LEAST * n // 100)


def extra(n):
    """How many of the lowest shingles two linked sets share at least, of those that head() takes."""
    return n // 20 + 1


def head(n):
    return n - least_shared(n) + extra(n)


def wanted_overlap(n, m):
    """The overlap from which sets of n and m are linked: LEAST * (n + m - i) <= 100 * i."""
    return -(-LEAST * (n + m) // (100 + LEAST))


# --- sets -----------------------------------------------------------------------------------------------------------


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _key(values: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, from its shingles in order."""
    place = np.arange(1, len(values) + 1, dtype=np.uint64)
    out = []
    for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.sum(mix(values + place * np.uint64(seed)), dtype=np.uint64)
        out.append(int(mix(np.array([total + np.uint64(len(values))]))[0].astype(np.int64)))
    return out[0], out[1]


Names = dict[tuple[int, int], int]


def _name(values: np.ndarray, renamed: Names, bits: int = 64) -> int:
    """The one number that a set goes by: the first of its key, unless another set has that one."""
    key = _key(values)
    return renamed.get(key, _short(key[0], bits))


def _short(number: int, bits: int) -> int:
    return number if bits == 64 else number & ((1 << bits) - 1)


def set_keys(docs: DataFrame) -> DataFrame:
    """(doc, mark, n, key, key2) for each row of (doc, mark, text): size and key of its set of shingles."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part["text"])
                names = [_key(s) for s in sets]
                columns = [part["doc"], part["mark"], pa.array([len(s) for s in sets], pa.int64())]
                columns += [pa.array([name[i] for name in names], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "mark", "n", "key", "key2"])

    return docs.mapInArrow(keys, "doc long, mark long, n long, key long, key2 long")


def names_of_alike(classes: DataFrame, bits: int = 64) -> Names:
    """New names for the sets whose key begins with the same number as another one's, but for one of these sets.

    Of n different sets about n * n / 2 ** 65 are concerned, three of ten thousand million.
    """
    short = F.col("key") if bits == 64 else F.col("key").bitwiseAND((1 << bits) - 1)
    named = classes.select(short.alias("name"), "key", "key2")
    alike = named.groupBy("name").agg(F.count("*").alias("rows")).where("rows > 1").select("name")
    alike = lookup(named, materialize(alike, "alike"), ["name"], "left_semi")
    rows = sorted(tuple(row) for row in alike.agg(F.collect_list(F.struct("name", "key", "key2"))).first()[0])
    again = [tuple(row[1:]) for before, row in zip(rows, rows[1:]) if before[0] == row[0]]
    free, last = [], 0
    while len(free) < len(again):
        tried = list(range(last - 1, last - 1 - len(again), -1))
        last = tried[-1]
        taken = set(named.where(F.col("name").isin(tried)).agg(F.collect_set("name")).first()[0])
        free += [number for number in tried if number not in taken]
    return dict(zip(again, free))


def whole_sets(docs: DataFrame, renamed: Names, bits: int = 64) -> DataFrame:
    """(key, n, tokens) for each row of (doc, mark, text) that has words; the key is the set's name."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s for s in shingle_sets(part["text"]) if len(s)]
                columns = [pa.array([_name(s, renamed, bits) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, _lists(sets)], ["key", "n", "tokens"])

    return docs.mapInArrow(sets_of, "key long, n long, tokens array<long>")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(values))


def _read_lists(column: pa.Array) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


# --- which sets share how many shingles with any other ----------------------------------------------------------------


def _postings(keys: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (token, key, n) of one batch of sets. A token of two sets or more is sent once, as of a set already counted
    (n = 0), and its sets are counted here: rows without a token, n of whose tokens are shared.
    """
    token = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    key = np.repeat(keys, [len(s) for s in sets])
    order = np.lexsort((key, token))
    token, key = token[order], key[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
    token, key = token[fresh], key[fresh]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    last = np.ones(len(token), bool)
    last[:-1] = first[1:]
    shared = ~(first & last)
    counted, times = np.unique(key[shared], return_counts=True)
    tokens = pa.concat_arrays([pa.array(token[first].astype(np.int64)), pa.nulls(len(counted), pa.int64())])
    n = np.concatenate([np.where(shared[first], 0, 1), times]).astype(np.int64)
    return pa.RecordBatch.from_arrays([tokens, pa.array(np.concatenate([key[first], counted]).astype(np.int64)), pa.array(n)], ["token", "key", "n"])


def prefix_postings(docs: DataFrame, renamed: Names, bits: int = 64) -> DataFrame:
    """The postings of the lowest shingles of the sets of (doc, mark, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s for s in shingle_sets(part["text"]) if len(s)]
                keys = np.array([_name(s, renamed, bits) for s in sets], np.int64)
                yield _postings(keys, [s[: head(len(s))].view(np.int64) for s in sets])

    return docs.mapInArrow(rows, "token long, key long, n long")


def all_postings(sets: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets = batch["key"].to_numpy(zero_copy_only=False), _read_lists(batch["tokens"])
            part = np.cumsum([0, *map(len, sets)])[:-1] // BATCH_SHINGLES
            for first, last in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right"))):
                yield _postings(keys[first:last], sets[first:last])

    return sets.select("key", "tokens").mapInArrow(rows, "token long, key long, n long")


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by token and key: each set (key) with the number n of its tokens that another set has too."""
    carried = None  # of the last token: up to two rows that stand for all of it
    for batch in batches:
        counted = batch.filter(pc.is_null(batch["token"]))
        rows = batch.filter(pc.is_valid(batch["token"]))
        token, key, n = (rows[name].to_numpy(zero_copy_only=False) for name in ("token", "key", "n"))
        keys, sums = [counted["key"].to_numpy(zero_copy_only=False)], [counted["n"].to_numpy(zero_copy_only=False)]
        if len(token):
            if carried is not None:
                token, key, n = (np.concatenate(both) for both in zip(carried, (token, key, n)))
            first = np.ones(len(token), bool)
            first[1:] = token[1:] != token[:-1]
            group = np.cumsum(first) - 1
            starts = np.flatnonzero(first)
            different = key != key[starts][group]
            shared = np.bincount(group, different, len(starts)) > 0
            now = shared[group] & (n > 0)
            keys.append(key[now])
            sums.append(np.ones(int(now.sum()), np.int64))
            start = starts[-1]
            if shared[-1]:
                other = start + int(np.argmax(different[start:]))
                carried = token[[start, other]], key[[start, other]], np.zeros(2, np.int64)
            else:
                carried = token[start : start + 1], key[start : start + 1], n[start:].max(keepdims=True)
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(sums), len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total)], ["key", "shared"])


def shared_counts(postings: DataFrame) -> DataFrame:
    """(key, shared): for each set of which any token is in another set too, at least the number of such tokens."""
    dealt = postings.repartition(shuffle_partitions(postings), F.coalesce("token", "key")).sortWithinPartitions("token", "key")
    return dealt.mapInArrow(_detect, "key long, shared long").groupBy("key").agg(F.sum("shared").alias("shared"))


# --- blocks -----------------------------------------------------------------------------------------------------------


def rare_postings(sets: DataFrame) -> DataFrame:
    """(token, key) for the rarest shingles of each set, one more than a linked set can lack.

    The order is by the number of sets that have a shingle. Those that no other set has come first and lead to no one, so
    of the shared ones as many are given as remain; a set that has too few of them has no link and gives none.
    """
    tokens = sets.select("key", "n", F.explode("tokens").alias("token"))
    counts = materialize(tokens.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1"), "counts")
    met = skew_join(tokens, counts, ["token"], counts=counts.where(F.col("rows") >= LEAST_HOT))
    ranked = met.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("rows", "token"))).alias("found"))
    take = F.size("found") - F.ceil(F.col("n") * LEAST / 100).cast("int") + 1
    return ranked.where(take > 0).select(F.explode(F.slice("found", F.lit(1), take)).alias("t"), "key").select("t.token", "key")


# --- search -----------------------------------------------------------------------------------------------------------


def search(sets: list[np.ndarray], groups: np.ndarray, indexed: np.ndarray, queries: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) between queries and indexed sets that make one group of every two groups with any such link.

    Sets that are in one group already are not compared; `groups` has the group of each set.
    """
    groups = np.unique(groups, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets], np.int64)
    owners = np.flatnonzero(indexed)
    token = np.concatenate([sets[i] for i in owners]) if len(owners) else np.zeros(0, np.int64)
    owner = np.repeat(owners, sizes[owners])
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]

    links = []
    for q in np.flatnonzero(queries):
        if not sizes[q]:
            continue
        first, last = np.searchsorted(token, sets[q], "left"), np.searchsorted(token, sets[q], "right")
        by_length = np.argsort(last - first, kind="stable")
        n = int(sizes[q])
        least = least_shared(n)
        short, long = by_length[: n - least + 1], by_length[n - least + 1 :]
        lists = []
        for k in short:
            found = owner[first[k] : last[k]]
            found = found[groups[found] != groups[q]]
            if len(found):
                lists.append(found[(LEAST * sizes[found] <= 100 * n) & (LEAST * n <= 100 * sizes[found])].tolist())
        met = [(d, sum(1 for _ in same)) for d, same in groupby(heapq.merge(*lists))]
        if not met:
            continue
        candidates = np.array([d for d, _ in met])
        counts = np.array([c for _, c in met])
        needed = wanted_overlap(n, sizes[candidates])
        for done, k in enumerate(long):
            if done % 64 == 0:
                able = counts + (len(long) - done) >= needed
                candidates, counts, needed = candidates[able], counts[able], needed[able]
                if not len(candidates):
                    break
            found = owner[first[k] : last[k]]
            place = np.searchsorted(found, candidates)
            counts += (place < len(found)) & (found[np.minimum(place, len(found) - 1)] == candidates) if len(found) else 0
        for d in candidates[counts >= needed]:
            if groups[d] != groups[q]:
                links.append((int(q), int(d)))
                groups[groups == groups[d]] = groups[q]
    return links


def _search_unit(table: pa.Table) -> pa.Table:
    """One task's search: rows (key, group, index, query, tokens) of a unit; links (a, b)."""
    table = table.combine_chunks()
    column = lambda name: table[name].chunk(0) if table.num_rows else pa.array([], table.schema.field(name).type)
    keys, groups = (column(name).to_numpy(zero_copy_only=False) for name in ("key", "group"))
    index, query = (column(name).to_numpy(zero_copy_only=False).astype(bool) for name in ("index", "query"))
    links = search(_read_lists(column("tokens")), groups, index, query)
    ends = [pa.array([int(keys[link[i]]) for link in links], pa.int64()) for i in (0, 1)]
    return pa.Table.from_arrays(ends, ["a", "b"])


def search_units(rows: DataFrame) -> DataFrame:
    """Links of all units: rows of (unit, key, group, index, query, tokens)."""
    found = rows.select("unit", "key", "group", "index", "query", "tokens").groupBy("unit")
    return materialize(found.applyInArrow(_search_unit, "a long, b long"), "links")


def _grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`nodes` with the group that the links so far put them in."""
    groups = components(links).withColumnsRenamed({"node": "key", "component": "_group"})
    return lookup(nodes.drop("group"), groups, ["key"]).withColumn("group", F.coalesce("_group", "key")).drop("_group")


def _unit(*parts) -> Column:
    return F.concat_ws(":", *parts)


def links_of_blocks(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Links (a, b) that connect all linked sets: sets (key, n, tokens), blocks (key, block)."""
    nodes = materialize(lookup(sets, blocks, ["key"], "inner"), "blocks")
    chunks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = materialize(nodes.groupBy("block").agg(chunks.alias("chunks")), "block-sizes")
    nodes = lookup(nodes, sizes, ["block"], "inner")
    nodes = nodes.withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks")).withColumn("group", F.col("key"))
    both = [F.lit(True).alias("index"), F.lit(True).alias("query")]
    links = [search_units(nodes.select("*", *both, _unit("block", "chunk").alias("unit")))]

    large = nodes.where("chunks > 1")
    if sizes.where("chunks > 1").limit(1).count() == 0:
        return links[0]
    for i in range(REPRESENTATIVE_ROUNDS):
        large = materialize(_grouped(large, reduce(DataFrame.unionAll, links)), "groups")
        chosen = large.groupBy("block", "group", "chunk").agg(F.min(F.struct(F.xxhash64("key", F.lit(i)), "key")).alias("_chosen"))
        counted = chosen.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("parts"))
        chosen = lookup(chosen.select("block", F.col("_chosen.key").alias("key")), counted, ["block"], "inner").drop("block")
        part = _unit("block", F.pmod(F.xxhash64("key", F.lit(~i)), "parts")).alias("unit")
        links.append(search_units(lookup(large, chosen, ["key"], "inner").select("*", *both, part)))

    large = materialize(_grouped(large, reduce(DataFrame.unionAll, links)), "groups")
    main = large.groupBy("block", "group").agg(F.count("*").alias("size")).groupBy("block").agg(F.max_by("group", F.struct("size", "group")).alias("main"))
    large = lookup(large, main, ["block"], "inner")
    outside = large.where(F.col("group") != F.col("main"))
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    parts = materialize(outside.groupBy("block").agg(parts.alias("parts")), "outside")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    large, outside = (lookup(side, parts, ["block"], "inner") for side in (large, outside))
    index = large.select("key", "group", "tokens", F.lit(True).alias("index"), F.lit(False).alias("query"), "block", "chunk", every("parts").alias("part"))
    query = outside.withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int")).drop("chunk")
    query = query.select("key", "group", "tokens", F.lit(False).alias("index"), F.lit(True).alias("query"), "block", "part", every("chunks").alias("chunk"))
    rows = index.unionByName(query).withColumn("unit", _unit("block", "chunk", "part"))
    links.append(search_units(rows))
    return reduce(DataFrame.unionAll, links)


# --- all of it --------------------------------------------------------------------------------------------------------


def similar_groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) for each row of `docs`, which needs doc_id and text; `mark` is a hash of
    the text.

    A row's set has the distinct runs of five words of its text; of fewer words, but not none, the whole as one. Rows
    are linked if their sets have a Jaccard similarity of at least 0.8; a row without words has no link. component_id
    is the smallest doc_id that links lead to, the row's own included; rows without an id are linked like others and
    have no smallest id unless a row with one is in reach. Repeated rows have equal sets and stay repeated. Sets are told
    apart by 128 bits; in between they go by names of `bits`, which are given anew where two are alike.
    """
    texts = docs.select(id_or_last().alias("doc"), F.xxhash64("text").alias("mark"), "text")
    named = materialize(set_keys(texts), "set-keys")
    classes = named.where("n > 0").groupBy("key", "key2").agg(F.min("doc").alias("first"), F.min(F.struct("doc", "mark")).alias("row"), F.min("n").alias("n"))
    classes = materialize(classes, "classes")
    renamed = names_of_alike(classes, bits)
    name = F.col("key1") if bits == 64 else F.col("key1").bitwiseAND((1 << bits) - 1)
    for (key, key2), new in renamed.items():
        name = F.when((F.col("key1") == key) & (F.col("key2") == key2), F.lit(new)).otherwise(name)
    classes = classes.withColumnRenamed("key", "key1").withColumn("key", name)

    shared = materialize(shared_counts(prefix_postings(texts, renamed, bits)), "shared")
    maybe = materialize(lookup(classes, shared, ["key"], "inner").where(F.col("shared") >= extra_of_partner(F.col("n"))).select("key", "row.*"), "maybe")
    chosen = lookup(texts, maybe.select("doc", "mark").distinct(), ["doc", "mark"], "left_semi")
    sets = materialize(lookup(whole_sets(chosen, renamed, bits), maybe.select("key").distinct(), ["key"], "left_semi").dropDuplicates(["key"]), "sets")
    shared = materialize(shared_counts(all_postings(sets)), "shared")
    sets = lookup(sets, shared, ["key"], "inner").where(F.col("shared") >= F.ceil(F.col("n") * LEAST / 100)).drop("shared")
    sets = materialize(sets, "linked-sets")

    postings = materialize(rare_postings(sets), "postings")
    centres = postings.groupBy("token").agg(F.min("key").alias("b"), F.max("key").alias("_last")).where("b <> _last").drop("_last")
    centres = materialize(centres, "centres")
    edges = skew_join(postings, centres, ["token"]).select(F.col("key").alias("a"), "b").distinct()
    blocks = components(edges).withColumnsRenamed({"node": "key", "component": "block"})
    groups = components(links_of_blocks(sets, blocks)).withColumnsRenamed({"node": "key", "component": "group"})

    linked = lookup(classes, groups, ["key"], "left")
    linked = materialize(linked, "linked")
    least = linked.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("first").alias("least"))
    least = materialize(least, "least")
    found = materialize(lookup(linked, least, ["group"], "left").select(F.col("key1").alias("key"), "key2", F.coalesce("least", "first").alias("component")), "components")
    joined = skew_join(named, found, ["key", "key2"], "left").withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")))
    known = lambda name: F.when(F.col(name) != LAST_ID, F.col(name))
    return joined.select(known("doc").alias("doc_id"), "mark", F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def extra_of_partner(n: Column) -> Column:
    """extra() of the smallest set that can be linked to one of n."""
    return F.floor(F.ceil(n * LEAST / 100) / 20) + 1


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that are linked, directly or through others, to a row with a smaller id; columns as they
    were. Rows with the same id and text stay or go together; rows without an id stay unless linked to one with an id.
    """
    groups = similar_groups(docs.select("doc_id", "text"))
    doc, mark = own_name("doc"), own_name("mark")
    staying = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(id_or_last().alias(doc), F.col("mark").alias(mark)).distinct()
    marked = docs.withColumn(doc, id_or_last()).withColumn(mark, F.xxhash64("text"))
    return lookup(marked, materialize(staying, "staying"), [doc, mark], "left_semi").drop(doc, mark)
