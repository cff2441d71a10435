"""Benchmark decontamination by greedy string tiling.

A document and a test item share seeds: windows of `min_match` words with one
Karp-Rabin hash. Seeds on one diagonal join to maximal common runs; tiling then
takes the longest run again and again, marks its words on both sides, and cuts
what other runs have in common with marked words. The tiles never overlap, and
their order is free, so a passage whose sentences were put in another order is
still covered. An item leaks into a document if tiles cover at least `coverage`
of the item's words.

The items are the stated query set: their windows go to every task, in blocks of
a bounded number of bytes, one pass over the documents a block. Documents are
never shuffled.

Defined cases: null or empty texts have no words and match nothing; items shorter
than `min_match` words match as a whole. Words are compared with A-Z in lower
case. Repeated rows of documents give a row each; of rows with one item_id the one
covered best counts. A null doc_id is carried like any other; items with a null
item_id are left out of `leaks`, as no finding could name them, and count in
`decontaminated`. An empty table of either kind
gives an empty result. Other columns are ignored by `leaks` and
kept as they are by `decontaminated`.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textvec

MIN_MATCH = 5
COVERAGE = 0.6
#: Bytes of item text whose windows are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
FOUND = "doc_id long, item_id long, item_words long, matched_words long, n_tiles long, longest_tile long, coverage double"


def tiles(seeds: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from `seeds`, the (document, item) places of equal windows of `size` words.

    Returns (document place, item place, words) of each tile: longest first, ties by
    the earlier place in the document, then in the item.
    """
    order = np.lexsort((seeds[:, 0], seeds[:, 0] - seeds[:, 1]))
    seeds = seeds[order]
    joined = np.zeros(len(seeds), dtype=bool)
    joined[1:] = (np.diff(seeds[:, 0]) == 1) & (np.diff(seeds[:, 0] - seeds[:, 1]) == 0)
    firsts = np.flatnonzero(~joined)
    lasts = np.append(firsts[1:], len(seeds)) - 1
    heap = [(-int(seeds[b, 0] - seeds[a, 0]) - size, int(seeds[a, 0]), int(seeds[a, 1])) for a, b in zip(firsts, lasts, strict=True)]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    out = []
    while heap:
        length, i, j = heapq.heappop(heap)
        length = -length
        free = [i + k not in in_doc and j + k not in in_item for k in range(length)]
        if all(free):
            in_doc.update(range(i, i + length))
            in_item.update(range(j, j + length))
            out.append((i, j, length))
            continue
        k = 0
        while k < length:
            if not free[k]:
                k += 1
                continue
            end = k
            while end < length and free[end]:
                end += 1
            if end - k >= size:
                heapq.heappush(heap, (k - end, i + k, j + k))
            k = end
    return out


class _Items:
    """The windows of a block of items, sorted by hash, by window size."""

    def __init__(self, rows: list[tuple[int, str]], min_match: int):
        self.ids = [r[0] for r in rows]
        data, at = textvec.column_bytes(pa.array([r[1] or "" for r in rows], pa.large_string()))
        starts, ends, first = textvec.word_spans(data, at)
        words = textvec.word_hashes(data, starts, ends, lower=True)
        self.counts = np.diff(first)
        self.by_size = {}
        for size in range(1, min_match + 1):
            hashes, owner, place = textvec.windows(words, first, size)
            own = self.counts[owner] >= min_match if size == min_match else self.counts[owner] == size
            if own.any():
                order = np.argsort(hashes[own], kind="stable")
                seen = np.zeros(1 << 20, dtype=bool)
                seen[(hashes[own] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
                self.by_size[size] = (hashes[own][order], owner[own][order], place[own][order], seen)

    def matches(self, data: np.ndarray, at: np.ndarray, coverage: float) -> list[tuple]:
        """(row, item_id, item words, matched words, tiles, longest, coverage) of every leak."""
        starts, ends, first = textvec.word_spans(data, at)
        words = textvec.word_hashes(data, starts, ends, lower=True)
        best: dict[tuple[int, int], tuple] = {}
        for size, (hashes, owner, place, seen) in self.by_size.items():
            value, row, where = textvec.windows(words, first, size)
            maybe = np.flatnonzero(seen[(value & np.uint64((1 << 20) - 1)).astype(np.int64)])
            low, high = (np.searchsorted(hashes, value[maybe], side=s) for s in ("left", "right"))
            hit = high > low
            low, high, maybe = low[hit], high[hit], maybe[hit]
            if not len(maybe):
                continue
            many = high - low
            took = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            rows, places = np.repeat(row[maybe], many), np.repeat(where[maybe], many)
            items, spots = owner[took], place[took]
            order = np.lexsort((items, rows))
            pair = np.stack([rows, items], axis=1)[order]
            seeds = np.stack([places, spots], axis=1)[order]
            edges = [0, *(np.flatnonzero((np.diff(pair, axis=0) != 0).any(axis=1)) + 1), len(pair)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                r, item = int(pair[a, 0]), int(pair[a, 1])
                total = int(self.counts[item])
                touched = np.unique(seeds[a:b, 1][:, None] + np.arange(size))
                if len(touched) < coverage * total:  # tiles can't cover more words than seeds touch
                    continue
                found = tiles(seeds[a:b], size)
                matched = sum(x[2] for x in found)
                if matched >= coverage * total:
                    result = (r, self.ids[item], total, matched, len(found), max(x[2] for x in found), matched / total)
                    key = (r, self.ids[item])
                    if key not in best or result[-1] > best[key][-1]:
                        best[key] = result
        return sorted(best.values())


def _blocks(benchmark: DataFrame, min_match: int, unnamed: bool = False) -> Iterator[_Items]:
    """The items in blocks; with `unnamed`, also those without an id, which get ids of their own below all others."""
    own = F.lit(-(2**62)) - F.pmod(F.xxhash64("text"), F.lit(2**62))
    named = benchmark.withColumn("item_id", F.coalesce(F.col("item_id").cast("long"), own)) if unnamed else benchmark.where("item_id is not null")
    items = named.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        if rows:
            yield _Items(sorted((r.item_id, r.text) for r in rows), min_match)


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and item that leaks into it."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], FOUND)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in _blocks(benchmark, min_match):
        sent = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, at in textvec.slices(batch, "text"):
                    found = sent.value.matches(data, at, coverage)
                    if found:
                        columns = list(zip(*found, strict=True))
                        owner = part.column(0).take(pa.array(columns[0], pa.int64()))
                        yield pa.RecordBatch.from_arrays(
                            [owner, *(pa.array(x, pa.int64()) for x in columns[1:6]), pa.array(columns[6], pa.float64())],
                            names=["doc_id", "item_id", "item_words", "matched_words", "n_tiles", "longest_tile", "coverage"],
                        )

        out = out.unionByName(source.mapInArrow(find, FOUND))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The documents into which no item leaks, one without an id included, with all their columns."""
    for block in _blocks(benchmark, min_match, unnamed=True):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, at in textvec.slices(batch, "text"):
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[[x[0] for x in sent.value.matches(data, at, coverage)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
