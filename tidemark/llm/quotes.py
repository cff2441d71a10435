"""Conversations in reply order, by linking quotations to the messages they come from.

Lines that start with `>` are quoted; the number of marks is the nesting level. Runs of
lines of one level, and each line of its own, are passages. Passages are normalised (A-Z
and other letters in lower case, white space joined) and hashed. A hash of a level-1
passage is looked up among what messages wrote themselves: first in the same
conversation, then anywhere. The message that accounts for most quoted characters is the
parent; it must precede in the order of (conv_id, turn), so replies form a forest.
Deeper levels name older ancestors and bear on nothing but the count of linked passages.
Roots and depths come from pointer doubling, in a number of joins that grows with the
logarithm of the depth.

A task parses one message at a time; all linking is joins on hashes. The index of
passages holds one row a hash, limited to hashes that are quoted, and its join is salted.

Defined cases: null text is empty. A message without a quote that can be linked is a
root of its own conversation. Rows that share (conv_id, turn) each give a row with a
parent of its own; as ancestors of others they are one message, which holds the passages
of all and has the parent of the row with the smallest hash. Rows with a null conv_id or turn are
never parents. Lines that introduce a quote ("... wrote:") go with it. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SALTS = 64
#: Least length of a passage that links to a message of another conversation.
FAR_CHARS = 8
_MARKS = re.compile(r"^(?:[ \t]{0,3}>)+")
_INTRO = re.compile(r"(?:wrote|schrieb|écrit|escribió)\s*:\s*$", re.I)
_SPACE = re.compile(r"\s+")
_UNITS = "array<struct<level: int, hash: long, chars: int>>"


def parse(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """(text without quotes, passages as (level, hash, characters)); level 0 is the author's own."""
    lines = []
    for raw in text.split("\n"):
        m = _MARKS.match(raw)
        lines.append((m.group().count(">") if m else 0, raw[m.end() :] if m else raw))
    own = []
    for k, (level, body) in enumerate(lines):
        following = next((lv for lv, b in lines[k + 1 : k + 3] if b.strip() or lv), 0)
        if level == 0 and following and _INTRO.search(body):
            lines[k] = (0, "")
            continue
        if level == 0:
            own.append(body)
    units: dict[tuple[int, int], int] = {}

    def add(level: int, body: str) -> None:
        normal = _SPACE.sub(" ", body).strip().lower()
        if normal:
            units[level, np.uint64(xxhash.xxh3_64_intdigest(normal)).view(np.int64).item()] = len(normal)

    run: list[str] = []
    for k, (level, body) in enumerate(lines):
        add(level, body)
        if body.strip():
            run.append(body)
        if run and (k + 1 == len(lines) or lines[k + 1][0] != level or not lines[k + 1][1].strip()):
            add(level, " ".join(run))
            run = []
    clean = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if len(own) < len(lines) else text
    return clean, [(level, h, n) for (level, h), n in units.items()]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("chars", pa.int32())]))
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            got = [parse(x or "") for x in part.column(3).to_pylist()]
            units = [[{"level": a, "hash": h, "chars": n} for a, h, n in u] for _, u in got]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array([c for c, _ in got], pa.string()), pa.array(units, kind)], names=["conv_id", "turn", "role", "text", "units"])


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, key, parent, n_linked): the parent (conv_id, turn) of every row that has one; `key` tells rows of one (conv_id, turn) apart."""
    quotes = parsed.where("exists(units, u -> u.level > 0)").select("conv_id", "turn", "key", F.explode("units").alias("u")).where("u.level > 0")
    quotes = stored(quotes.select("conv_id", "turn", "key", "u.level", "u.hash", "u.chars").distinct())
    asked = quotes.select("hash").distinct()
    own = parsed.where("conv_id is not null and turn is not null").select(F.struct("conv_id", "turn").alias("m"), F.explode("units").alias("u")).where("u.level = 0")
    # A passage that very many wrote is dealt by message; what is asked for is repeated for each share.
    spread = F.pmod(F.xxhash64("m"), F.lit(SALTS)).cast("int").alias("salt")
    shares = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = own.select("m", F.col("u.hash").alias("hash"), F.col("u.chars").alias("chars"), spread).join(shares, ["hash", "salt"], "left_semi")
    here = own.groupBy(F.col("m.conv_id").alias("conv_id"), "hash").agg(F.min("m").alias("near"))
    # Across conversations a short passage ("ok", "thanks") names nobody.
    anywhere = own.where(F.col("chars") >= FAR_CHARS).groupBy("hash").agg(F.min("m").alias("far")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = quotes.withColumn("salt", F.pmod(F.xxhash64("conv_id", "turn", "key"), F.lit(SALTS)).cast("int"))
    found = salted.join(here, ["conv_id", "hash"], "left").join(anywhere, ["hash", "salt"], "left")
    me = F.struct("conv_id", "turn")
    found = found.withColumn("source", F.when(F.col("near") < me, F.col("near")).when(F.col("far") < me, F.col("far"))).where("source is not null")
    votes = found.groupBy("conv_id", "turn", "key", "source").agg(F.sum(F.when(F.col("level") == 1, F.col("chars"))).alias("chars"), F.count("*").alias("n"))
    best = votes.groupBy("conv_id", "turn", "key").agg(F.max(F.struct(F.coalesce("chars", F.lit(0)).alias("chars"), F.struct((-F.col("source.turn")).alias("t"), (-F.col("source.conv_id")).alias("c")).alias("o"), F.col("source").alias("source"))).alias("b"), F.sum("n").alias("n_linked"))
    return best.where("b.chars > 0").select("conv_id", "turn", "key", F.col("b.source").alias("parent"), "n_linked")


def roots(parents: DataFrame) -> DataFrame:
    """(m, root, depth) of every message in `parents` (conv_id, turn, key, parent), by pointer doubling; of rows of one message that of the smallest key."""
    chosen = parents.groupBy("conv_id", "turn").agg(F.min(F.struct("key", "parent")).alias("p"))
    state = stored(chosen.select(F.struct("conv_id", "turn").alias("m"), F.col("p.parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = state.select(F.col("m").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        moved = state.join(up, "root", "left")
        if not moved.where("above is not null").limit(1).count():
            return state
        state = stored(moved.select("m", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def reply_ordered(messages: DataFrame) -> DataFrame:
    """One row a message without its quotes, with its parent and its place in reply order.

    Rows of one thread_conv, sorted by (thread_turn, depth, turn), read every message after its parent.
    """
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    parsed = messages.select(*columns).mapInArrow(_parsed, f"conv_id long, turn long, role string, text string, units {_UNITS}")
    parsed = stored(parsed.withColumn("key", F.xxhash64("role", "text", "units")))
    parents = stored(links(parsed))
    # A row's place follows from its own parent: the parent's root, or the parent itself, and one step more.
    above = roots(parents).select(F.col("m").alias("parent"), "root", "depth")
    reply = parents.join(above, "parent", "left").select("conv_id", "turn", "key", "parent", "n_linked", F.coalesce("root", "parent").alias("root"), (F.coalesce("depth", F.lit(0)) + 1).alias("depth"))
    rows = parsed.join(reply, ["conv_id", "turn", "key"], "left")
    quoted = F.size(F.filter("units", lambda u: u["level"] > 0)).cast("long")
    return rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.col("parent.conv_id").alias("parent_conv"),
        F.col("parent.turn").alias("parent_turn"),
        F.coalesce("root.conv_id", "conv_id").alias("thread_conv"),
        F.coalesce("root.turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        quoted.alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
