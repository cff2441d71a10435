"""Packing token pieces into sequences by a configuration linear program.

The lengths of all pieces form a histogram of at most `capacity` entries, however
many documents there are. Over it the driver solves the configuration program
"cover every length with as few patterns as possible", where a pattern is a
multiset of lengths that fits one sequence: multiplicative weights on the lengths,
and in each round the patterns of greatest weight by a knapsack dynamic program,
until every length is covered in full. The fractional solution is rounded, the
program is solved again for what is left, and the pieces that no whole pattern
takes then go where they fit best, into room that patterns left over or new sequences
(README has their share).

The result is a plan of ranges: "the pieces of length L with ranks r to r + m go
to sequences s to s + m at offset o". Its size depends on `capacity`, never on the
number of pieces. Each piece then finds its place from its rank among the pieces
of its length. Ranks are counted in salted groups, so that a length that many
pieces share (full pieces, copies) is spread over many tasks.

Defined cases: null text is empty; an empty text is one piece with the end token
only. Repeated rows are packed as often as they occur. A null doc_id is packed
like any other. Columns other than doc_id and text are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textvec
from tidemark.llm.common import stored

CAPACITY = 1024
END_ID = 2
#: Groups in which the pieces of one length are counted.
SALTS = 256
#: The program is solved from two starts, (power, step): weights grow as that power of the length, as long pieces are
#: harder to place late, and a pattern covers at most that part of its scarcest length in a round. The better plan counts.
STARTS = ((2.0, 0.5), (8.0, 1.0))
#: One pricing gives patterns of almost the greatest weight, PER_PRICING at most; the next prices anew.
NEAR_BEST = 0.02
PER_PRICING = 64
#: A pattern that is taken once more in rounding fills so much of a sequence; others wait for the next pass or the fill.
FULL = 0.995
#: Fixed value: how byte-level files of this kind split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """The byte-level BPE of a `tokenizers` file as a tiktoken encoding: the same ids, several times faster.

    In such a file the ids of ordinary tokens grow in the order of the merges, which is all
    that byte-pair merging needs; if they don't, this raises.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    # Byte-level files write each byte as one printable character: itself where it is printable, else 256 and on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocabulary = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    made = [model["model"]["vocab"][a + b] for a, b in merges]
    if made != sorted(made):
        raise ValueError(f"{path}: ids are not in the order of merges")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens=special)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token pieces of at most `capacity` ids of every document; `with_ids` adds the ids themselves.

    A document longer than `capacity` is cut so that only its first piece may be shorter.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            for part, _, _ in textvec.slices(batch, "text"):
                owners = part.column(part.schema.get_field_index("doc_id"))
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                for i, text in enumerate(part.column(part.schema.get_field_index("text")).to_pylist()):
                    ids = np.append(model.encode_to_numpy(text or "", allowed_special="all", disallowed_special=()).astype("<u4"), np.array([end_id], "<u4"))
                    first = len(ids) % capacity or min(capacity, len(ids))
                    start = 0
                    for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                        own = ids[start:end]
                        for column, value in zip(rows, (i, k, start, len(own), zlib.crc32(own.tobytes()), own), strict=True):
                            column.append(value)
                        start = end
                columns = [owners.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in rows[5]], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))


def _priced(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack table: for every room the greatest weight that fits, and the length taken last (-2: none, one room less)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        fits = fitting[room]
        value = best[room - lengths[:fits]] + weights[:fits]
        k = int(value.argmax())
        if value[k] > best[room - 1]:
            best[room], took[room] = value[k], k
        else:
            best[room], took[room] = best[room - 1], -2
    return best, took


def _traced(took: np.ndarray, lengths: np.ndarray, room: int) -> np.ndarray:
    """The counts a length that the knapsack table holds for `room`."""
    counts = np.zeros(len(lengths), dtype=np.int64)
    while room > 0 and took[room] != -1:
        if took[room] == -2:
            room -= 1
            continue
        counts[took[room]] += 1
        room -= int(lengths[took[room]])
    return counts


def heaviest_pattern(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of lengths of the greatest total weight that fits `capacity`, as a count a length."""
    _, took = _priced(weights, lengths, capacity)
    return _traced(took, lengths, capacity)


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, power: float = STARTS[0][0], step: float = STARTS[0][1]) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns, amounts, bound): a fractional cover of all of `demand` by patterns, by multiplicative weights, and
    a lower bound of any cover, from the best dual weights seen.

    Each round prices the open lengths by their weights and takes the patterns within `NEAR_BEST` of the heaviest,
    each until it covers `step` of its scarcest length or closes a length, and lowers the weights of what it covers.
    After `rounds` rounds every pattern closes a length, so at most as many rounds follow as there are lengths; the
    program ends when all are closed.
    """
    start = (lengths / capacity) ** power
    weights = start.copy()
    left = demand.astype(float)
    bound = float(demand @ lengths) / capacity
    chosen: dict[bytes, float] = {}
    done = 0
    while len(open_ := np.flatnonzero(left > 1e-9 * demand)):
        best, took = _priced(weights[open_], lengths[open_], capacity)
        top = float(best[capacity])
        bound = max(bound, float(demand[open_] @ weights[open_]) / top)
        done += 1
        value = weights[open_] + best[capacity - lengths[open_]]
        for k in np.argsort(-value, kind="stable")[:PER_PRICING]:
            if value[k] < (1 - NEAR_BEST) * top:
                break
            own = _traced(took, lengths[open_], capacity - int(lengths[open_[k]]))
            own[k] += 1
            at, counts = open_[own > 0], own[own > 0]
            # The first is always taken; the weights of others may have dropped since they were priced.
            if k != int(value.argmax()) and float(weights[at] @ counts) < (1 - NEAR_BEST) * top or (left[at] <= 1e-9 * demand[at]).any():
                continue
            amount = min(float((left[at] / counts).min()), (step if done <= rounds else 1.0) * float((demand[at] / counts).min()))
            pattern = np.zeros(len(lengths), dtype=np.int64)
            pattern[at] = counts
            chosen[pattern.tobytes()] = chosen.get(pattern.tobytes(), 0.0) + amount
            left[at] -= counts * amount
            weights[at] *= np.exp(-counts * amount / (2 * demand[at]))
    return np.array([np.frombuffer(x, np.int64) for x in chosen]), np.array(list(chosen.values())), bound


def best_fit(lengths: np.ndarray, left: np.ndarray, rank: np.ndarray, groups: list[tuple[int, int, int]], sequences: int, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(ranges, sequences) that place what is `left`, longest first, where the least room is left over.

    `groups` are the sequences so far, as (first, count, ids in each); equal sequences are handled at once.
    """
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for first, count, used in groups:
        rooms[capacity - used].append((first, count))
    ranges: list[tuple[int, int, int, int, int]] = []
    for k in range(len(lengths) - 1, -1, -1):
        length, n, at = int(lengths[k]), int(left[k]), int(rank[k])
        room = length
        while n:
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                room, new = capacity, -(-n // (capacity // length))
                rooms[room].append((sequences, new))
                sequences += new
            first, count = rooms[room].pop()
            each = min(room // length, n)
            taken = min(count, n // each)
            for j in range(each):
                ranges.append((length, at, taken, first, capacity - room + j * length))
                at += taken
            n -= each * taken
            if taken < count:
                rooms[room].append((first + taken, count - taken))
            rooms[room - each * length].append((first, taken))
            room = length
    return ranges, sequences


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 150, passes: int = 4, report: dict | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(ranges, sequences): ranges of (length, first rank, count, first sequence, offset), the better of two starts of the program.

    `report` gets the pieces placed by the program and by the fill, the sequences, the cover's amount and its lower bound.
    """
    found = [_planned(histogram, capacity, rounds, passes, *start) for start in STARTS]
    ranges, sequences, said = min(found, key=lambda x: (x[1], x[2]["by_fill"]))
    if report is not None:
        report.update(said, bound=max(x[2]["bound"] for x in found))
    return ranges, sequences


def _planned(histogram: dict[int, int], capacity: int, rounds: int, passes: int, power: float, step: float) -> tuple[list[tuple[int, int, int, int, int]], int, dict]:
    """(ranges, sequences, report) of one start.

    Every pass rounds the fractional cover down, then takes its patterns once more in the order of what rounding
    cut off, each no more often than what is left allows, and solves again for the rest. After `passes` passes it
    goes on as long as a pass places at least a tenth of what is left. After each pass it is known how many sequences
    there are if the rest goes to the best fitting room; the pass after which they are fewest is the last that counts.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    rank = np.zeros(len(lengths), dtype=np.int64)
    ranges: list[tuple[int, int, int, int, int]] = []
    groups: list[tuple[int, int, int]] = []
    sequences = 0

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal sequences
        offset = 0
        for k in np.flatnonzero(pattern)[::-1]:
            for _ in range(int(pattern[k])):
                ranges.append((int(lengths[k]), int(rank[k]), times, sequences, offset))
                rank[k] += times
                left[k] -= times
                offset += int(lengths[k])
        groups.append((sequences, times, offset))
        sequences += times

    if len(lengths) and lengths[-1] == capacity:
        only = np.zeros(len(lengths), dtype=np.int64)
        only[-1] = 1
        use(only, int(left[-1]))
    full, pieces_left, done, rest = sequences, int(left.sum()), 0, 0
    cover = bound = 0.0
    best = (list(ranges), sequences) if not pieces_left else None
    while left.sum():
        some, before = np.flatnonzero(left), int(left.sum())
        patterns, amounts, least = solve(lengths[some], left[some].astype(float), capacity, rounds, power, step)
        if not done:
            cover, bound = float(amounts.sum()), least
        done += 1
        whole = np.zeros((len(patterns), len(lengths)), dtype=np.int64)
        whole[:, some] = patterns

        def allowed(pattern: np.ndarray) -> int:
            used = pattern > 0
            return int((left[used] // pattern[used]).min())

        def fill() -> None:
            nonlocal best, rest
            more, total = best_fit(lengths, left, rank, groups, sequences, capacity)
            if best is None or total <= best[1]:  # of equal plans that with more by the program
                best, rest = (ranges + more, total), int(left.sum())

        for k in np.argsort(-(patterns @ lengths[some]), kind="stable"):
            times = min(int(np.floor(amounts[k] + 1e-6)), allowed(whole[k]))
            if times > 0:
                use(whole[k], times)
        fill()
        for k in np.lexsort((-(amounts % 1), -(patterns @ lengths[some]))):
            if patterns[k] @ lengths[some] >= FULL * capacity and allowed(whole[k]):
                use(whole[k], 1)
        fill()
        if before == left.sum() or done >= passes and 10 * (before - left.sum()) < before:
            break
    return *best, {"pieces": pieces_left, "by_program": pieces_left - rest, "by_fill": rest, "sequences": best[1], "full": full, "cover": cover, "bound": bound, "passes": done}


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of `cut` (from `pieces`) with sequence_id and offset."""
    cut = stored(cut)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    rows = counts.collect()  # capacity * SALTS rows at most
    histogram: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for row in sorted(rows, key=lambda r: (r.length, r.salt)):
        base[row.length, row.salt] = histogram.get(row.length, 0)
        histogram[row.length] = histogram.get(row.length, 0) + row.n
    ranges, _ = plan(histogram, capacity)
    ranges.sort()
    lengths, firsts, _, bins, offsets = (np.array(x, dtype=np.int64) for x in (zip(*ranges, strict=True) if ranges else ([],) * 5))
    # A rank never reaches 2**40, so (length, rank) is one sortable number.
    keys = (lengths << 40) | firsts
    start = np.full((capacity + 1, SALTS), 0, dtype=np.int64)
    for (length, salt), n in base.items():
        start[length, salt] = n
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", number)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salt, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy().astype(np.int64) for x in ("length", "salt", "rank"))
            rank = rank + start[length, salt]
            at = np.searchsorted(keys, (length << 40) | rank, side="right") - 1
            columns = [batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(bins[at] + rank - firsts[at]), pa.array(offsets[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(pieces(docs, tokenizer, capacity, end_id), capacity)
