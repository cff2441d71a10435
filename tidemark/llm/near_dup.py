"""Near-duplicate documents by MinHash with tensored banding.

A plain banded index needs `tables * rows` minhashes a document. Here a document
gets `halves` short sketches of `rows` minhashes each, and each pair of sketches
makes one table key, so `halves * rows` minhashes give `halves * (halves - 1) / 2`
tables of `2 * rows` rows: about the square root of the hashing work.

Steps, each of which moves ids and fixed-size values only, save one pass of text:

1. One row a document: its shingle count, a 128-bit digest of its shingle set and
   the sketches. Documents with equal sets collapse to their smallest id.
2. Table keys of those representatives; keys with one member go.
3. Every member of a key is compared with the key's smallest member (a star, so a
   key with m members gives m - 1 pairs), on full shingle sets.
4. Components of the links found. Only members of keys that still span several
   components go on; there, pairs of different components whose minhashes agree
   often enough are compared on full sets as well, and components are joined again.

All steps name a row by a hash of its doc_id and text; a component gets its smallest
doc_id at the end.

Defined cases: null or empty text, or text without words, has no shingles and is
its own component. `deduplicated` takes every row by itself: rows with one doc_id and
different texts are different documents, rows without a doc_id are documents, and rows
that agree in doc_id and text are one. `near_duplicates` has one row a doc_id, as its
SQL: of several texts the one with the smallest row hash counts in all steps and the
others in none, and rows without a doc_id, which no link can name, are left out.
Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textvec
from tidemark.llm.common import dropped, partitions_for, stored

SHINGLE = 5
PERCENT = 85
#: A pair at the threshold shares a table with this probability at least, by sketches of up to ROWS minhashes, HALVES at most.
RECALL = 0.9965
ROWS, HALVES = 5, 16
#: A one-permutation sketch: the hash space in BINS parts, of each the smallest shingle as one byte (0: none).
BINS = 512
#: Members of a table key in one part; a key with more of them is compared part by part, in as many tasks as it has pairs of parts.
PART = 2048


def shape(percent: int) -> tuple[int, int]:
    """(halves, rows) for a threshold: the longest sketches of which few enough reach RECALL at it."""
    for rows in range(ROWS, 0, -1):
        p = (percent / 100) ** rows
        for halves in range(2, HALVES + 1):
            if 1 - (1 - p) ** halves - halves * p * (1 - p) ** (halves - 1) >= RECALL:
                return halves, rows
    raise ValueError(f"no sketches for {percent} %")


def _sketch(batches: Iterator[pa.RecordBatch], size: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    count, rows = size
    seeds = np.random.default_rng(7).integers(1, 2**63, (count * rows, 2), dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        for part, data, at in textvec.slices(batch, "text"):
            values, first = textvec.shingle_sets(data, at, SHINGLE)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            n = part.num_rows
            low, high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            hashes = np.zeros((n, count * rows), np.uint64)
            if len(full):
                low[full] = np.add.reduceat(values, first[full])
                high[full] = np.add.reduceat(textvec.mix(values ^ np.uint64(0x5851F42D4C957F2D)), first[full])
                for k, (a, b) in enumerate(seeds):
                    hashes[full, k] = np.minimum.reduceat(values * a + b, first[full])
            # Values come ascending in each row, so the first in a part of the hash space is its smallest.
            bins = np.zeros((n, BINS), np.uint8)
            owner, part_of = np.repeat(np.arange(n), sizes), (values >> np.uint64(55)).astype(np.int64)
            lead = np.ones(len(values), bool)
            lead[1:] = (part_of[1:] != part_of[:-1]) | (owner[1:] != owner[:-1])
            bins[owner[lead], part_of[lead]] = values[lead] % np.uint64(255) + np.uint64(1)
            mixed = textvec.mix(hashes)
            halves = np.zeros((n, count), np.uint64)
            for k in range(rows):
                halves = halves * np.uint64(0xD6E8FEB86659FD93) + mixed[:, k::rows]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("doc_id")),
                    part.column(part.schema.get_field_index("id")),
                    pa.array(sizes, pa.int64()),
                    pa.array(low.view(np.int64)),
                    pa.array(high.view(np.int64)),
                    pa.array([x.tobytes() for x in textvec.mix(halves)], pa.binary()),
                    pa.array([x.tobytes() for x in bins], pa.binary()),
                ],
                names=["doc_id", "id", "n_shingles", "set_low", "set_high", "halves", "bins"],
            )


def _tables(halves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two sketches and the salt of each table."""
    one, two = np.triu_indices(halves, 1)
    return one, two, textvec.mix(np.arange(len(one), dtype=np.uint64) + np.uint64(99))


def _key(first: np.ndarray, second: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return textvec.mix(first * np.uint64(0xD6E8FEB86659FD93) + second + salt)


def _first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first key that two rows share, from their sketches; rows share a key if two sketches agree."""
    one, two, salt = _tables(x.shape[1])
    table = np.zeros((x.shape[1], x.shape[1]), np.int64)
    table[one, two] = np.arange(len(one))
    same = x == y
    i = same.argmax(axis=1)
    row = np.arange(len(x))
    same[row, i] = False
    j = same.argmax(axis=1)
    return _key(x[row, i], x[row, j], salt[table[i, j]])


def _table_keys(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    one, two, salt = _tables(count)
    for batch in batches:
        for row in range(0, batch.num_rows, 2000):
            part = batch.slice(row, 2000)
            halves = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(-1, count)
            keys = _key(halves[:, one], halves[:, two], salt)
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), len(one))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids, pa.int64())], names=["key", "doc_id"])


def _set_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in textvec.slices(batch, "text"):
            values, first = textvec.shingle_sets(data, at, SHINGLE)
            raw = values.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), pa.array([raw[8 * a : 8 * b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())],
                names=["doc_id", "shingles"],
            )


def _likely(x: np.ndarray, y: np.ndarray, total: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sketches allow the threshold: their estimate is within five standard deviations of it or above.

    Each part of the hash space that either row fills samples one shingle of the union, without replacement.
    """
    sampled = np.maximum(((x | y) != 0).sum(axis=1), 1)
    same = ((x == y) & (x != 0)).sum(axis=1)
    level = percent / 100
    union = np.maximum(total / (1 + level), sampled)
    spread = np.sqrt(level * (1 - level) / sampled * np.maximum(1 - sampled / union, 0.03))
    return same / sampled >= level - 5 * spread - 1 / sampled


def _rest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one key and different components that may be similar, each from the first key it shares.

    Rows come sorted by key, low, high and part. A group of the first three holds one part of a key's
    members (low = high), which are compared with each other, or two, which are compared across.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    found: list[np.ndarray] = []

    def compared(rows: pa.Table, edges: np.ndarray) -> Iterator[np.ndarray]:
        key = rows.column("key").to_numpy().view(np.uint64)
        ids, parts, sizes, own, low, high = (rows.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles", "part", "low", "high"))
        marks = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(len(key), -1)
        halves = np.frombuffer(b"".join(rows.column("halves").to_pylist()), np.uint64).reshape(len(key), -1)
        for a, b in zip([0, *edges], [*edges, len(key)], strict=True):
            across = low[a] != high[a]
            middle = a + int(np.searchsorted(own[a:b], high[a])) if across else b
            for i in range(a, middle, 512):
                for j in range(middle if across else i, b, 512):
                    x, y = slice(i, min(i + 512, middle)), slice(j, min(j + 512, b))
                    ok = parts[x, None] != parts[None, y]
                    small, large = np.minimum(sizes[x, None], sizes[None, y]), np.maximum(sizes[x, None], sizes[None, y])
                    ok &= 100 * small >= percent * large
                    p, q = np.nonzero(ok)
                    p, q = p + i, q + j
                    good = p < q
                    p, q = p[good], q[good]
                    for k in range(0, len(p), 2048):
                        u, v = p[k : k + 2048], q[k : k + 2048]
                        close = _likely(marks[u], marks[v], sizes[u] + sizes[v], percent) & (_first_shared(halves[u], halves[v]) == key[u])
                        one, two = ids[u][close], ids[v][close]
                        yield np.stack([np.minimum(one, two), np.maximum(one, two)])

    def flushed(least: int) -> Iterator[pa.RecordBatch]:
        if sum(x.shape[1] for x in found) >= least:
            one, two = np.concatenate(found, axis=1)
            found.clear()
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], schema=schema)

    def changes(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        return np.flatnonzero(np.any([np.diff(rows.column(c).to_numpy()) for c in ("key", "low", "high")], axis=0)) + 1

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        edges = changes(pa.Table.from_batches([x.slice(x.num_rows - 1) for x in held[-2:-1]] + [batch]))
        if not len(edges):
            continue  # one group so far
        rows = pa.Table.from_batches(held)
        edges = changes(rows)
        # The last group may go on in the next batch.
        for pairs in compared(rows.slice(0, edges[-1]), edges[:-1]):
            found.append(pairs)
            yield from flushed(1 << 16)
        held = rows.slice(edges[-1]).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        for pairs in compared(rows, changes(rows)):
            found.append(pairs)
            yield from flushed(1 << 16)
    yield from flushed(1)


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component): the smallest id reachable over `links` (a, b), for every id in them.

    Alternates two steps until nothing changes: every node's larger neighbours move
    to its smallest neighbour, then its smaller ones do. Ids, not groups, move;
    minima are taken before the shuffle, and the state is written each round.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before, last = None, None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if last is not None:
            dropped(last)
        last = edges
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    # Now every node points at its component's smallest id.
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "doc_id")


def _given(step: Callable, value) -> Callable:
    """`step` of batches with its second argument bound."""
    return lambda batches: step(batches, value)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return stored(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_given(textvec.similar_pairs, percent), "a long, b long"))


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with __row, a hash that names a row by its doc_id and text."""
    return docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.lit("|"), "text"))


def _sketched(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sketches): doc_id (the row hash) and text; and one sketch a row, with the doc_id itself as `id`."""
    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = keyed.select(F.col("__row").alias("doc_id"), "text", F.col("doc_id").alias("id"))
    sketches = rows.mapInArrow(_given(_sketch, shape(percent)), "doc_id long, id long, n_shingles long, set_low long, set_high long, halves binary, bins binary")
    return rows, stored(sketches)


def _placed(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """doc_id (the row hash), id, n_shingles and component (a row hash) of each different row of `sketches`."""
    n, size = partitions_for(rows), shape(percent)
    # Rows with one hash agree in all columns but the sketches' order; this moves ids only.
    whole = sketches.groupBy("doc_id").agg(F.min(F.struct("id", "set_low", "set_high", "n_shingles")).alias("s")).select("doc_id", "s.*")
    filled = sketches.where("n_shingles > 0")
    distinct = stored(filled.groupBy("set_low", "set_high", "n_shingles").agg(F.min(F.struct("doc_id", "halves", "bins")).alias("s")).select("set_low", "set_high", "n_shingles", "s.*"))
    keys = distinct.select("doc_id", "halves")
    members = keys.select("doc_id", "halves").mapInArrow(_given(_table_keys, size[0]), "key long, doc_id long")
    stars = members.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    found = stored(members.join(stars.select("key", "head"), "key"))
    star = found.where("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    needed = found.select("doc_id").distinct()
    texts = rows.select("doc_id", "text")
    sets = stored(texts.join(needed, "doc_id").repartition(n, "doc_id").mapInArrow(_set_column, "doc_id long, shingles binary").dropDuplicates(["doc_id"]))
    links = _confirmed(star, sets, percent)
    first = stored(components(links))
    placed = found.join(first, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low != high")
    # The members of a key are dealt in parts, and each two parts meet in a group of their own.
    parts = open_keys.select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    dealt = placed.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = dealt.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "doc_id", "component")
    rest = rest.join(distinct.select("doc_id", "n_shingles", "bins", "halves"), "doc_id")
    group = ["key", "low", "high"]
    rest = rest.select(*group, "part", "doc_id", "component", "n_shingles", "bins", "halves").repartition(n, *group).sortWithinPartitions(*group, "part")
    pairs = rest.mapInArrow(_given(_rest, percent), "a long, b long").distinct()
    more = _confirmed(pairs, sets, percent)
    groups = components(links.union(more))
    placed = distinct.join(groups, "doc_id", "left").select("set_low", "set_high", F.coalesce("component", "doc_id").alias("component"))
    # Rows without shingles stand alone.
    return whole.join(placed, ["set_low", "set_high"], "left").select("doc_id", "id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each doc_id; see the module."""
    rows, sketches = _sketched(docs.where("doc_id is not null"), percent)
    # The row that counts for each id, before anything is linked.
    counted = sketches.groupBy("id").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    placed = stored(_placed(rows, sketches.join(counted, "doc_id", "left_semi"), percent))
    named = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    return placed.join(named, "component").select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near-duplicate rows, that of the smallest doc_id, with all its columns."""
    rows, sketches = _sketched(docs, percent)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("doc_id").alias("row")))
    kept = _placed(rows, sketches, percent).groupBy("component").agg(first.alias("f")).select(F.col("f.row").alias("__row"))
    return _keyed(docs).join(kept, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
