"""Quality rules: per-document word statistics and cross-document line frequency.

Base statistics come from the words and lines of each text. The line rule then
normalises every line (letters in lower case, runs of white space as one space),
hashes it, and counts in how many different texts of the
document's host it stands. Lines of any length above `max_texts` are boilerplate and
are removed; a document that keeps too little is rejected as depleted. Exact copies
count as one text, so the lines of a copied article are no boilerplate.

All of it is DataFrame functions. What is shuffled are hashes and counts; the join
of frequent lines back to documents is salted, because one line of one host may
stand in a large part of all rows.

Defined cases: a null text has no words and no lines, so it fails the base rules. A
null host is a host of its own. Repeated rows are judged alike and each gives a row.
Null ids are carried. Other columns are kept by `cleaned` and ignored by `verdicts`;
all of a row's own columns travel in one struct, so none clashes with a helper's
name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, normal_line, packed, spaces, unpacked

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_TEXTS = 20
MIN_LEFT_PERCENT = 30
SALTS = 64


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def base_statistics(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("__text", text).withColumn("__words", words_of(F.col("__text")))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    rows = rows.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]", ""))).cast("long"),
            "__lines": lines,
            "__1": F.transform("__words", lambda w: F.xxhash64(w)),
        }
    ).drop("__words", "__text")
    # Windows by doubling: hashes of 2, then 4, then 8 words from each place on.
    pair = lambda c, k: F.zip_with(c, F.slice(c, k + 1, F.greatest(F.size(c), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumns({"n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "__2": pair("__1", 1)}).drop("__lines", "__1")
    rows = rows.withColumn("__4", pair("__2", 2)).drop("__2")
    rows = rows.withColumn("__8", F.slice(pair("__4", 4), F.lit(1), F.greatest(F.size("__4") - (WINDOW - 1), F.lit(0)))).drop("__4")
    rows = rows.withColumn("__some", F.size(F.array_distinct("__8")) < F.size("__8"))
    # Only a text in which some window repeats goes on: sort the windows, keep the places of
    # those that equal a neighbour, and add up how many words they cover.
    rows = rows.withColumn("__sorted", F.when(F.col("__some") & (F.size("__8") > 0), F.array_sort(F.transform("__8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__8")
    at = lambda k: F.get(F.col("__sorted"), k)["h"]
    twice = F.transform("__sorted", lambda e, k: F.when(F.coalesce(at(k - 1) == e["h"], F.lit(False)) | F.coalesce(at(k + 1) == e["h"], F.lit(False)), e["i"]))
    rows = rows.withColumn("__places", F.when(F.col("__some"), F.sort_array(F.filter(twice, lambda i: i.isNotNull())))).drop("__sorted", "__some")
    steps = F.zip_with("__places", F.slice("__places", F.lit(2), F.greatest(F.size("__places"), F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")).drop("__places")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    """Two hashes that name a row by its content, and one that names its text."""
    return docs.withColumns(
        {
            "__k1": F.xxhash64("doc_id", host, "text"),
            "__k2": F.xxhash64("text", F.lit("|"), host, "doc_id"),
            "__host": F.coalesce(F.col(host).cast("string"), F.lit("\x00null")),
        }
    )


def frequent_lines(docs: DataFrame, host: str = "source", max_texts: int = MAX_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(occurrences, frequent): the lines of each row, and the (host, line) pairs above the limit."""
    rows = _keyed(docs.select("doc_id", F.col(host), "text"), host)
    # Two steps inside the array, so that each line is normalised once.
    normal = F.filter(F.transform(F.split("text", "\n"), normal_line), lambda x: x != "")
    each = F.transform(normal, lambda x, i: F.struct(F.xxhash64(x).alias("line"), (spaces(x) + 1).alias("w"), i.alias("at")))
    lines = rows.select("__k1", "__k2", "__host", F.xxhash64("text").alias("__t"), F.explode_outer(each).alias("__l")).where("__l is not null")
    lines = lines.select("__k1", "__k2", "__host", "__t", F.col("__l.line").alias("__line"), F.col("__l.w").alias("__w"), F.col("__l.at").alias("__at"))
    texts = lines.select("__host", "__line", "__t").distinct()
    frequent = texts.groupBy("__host", "__line").agg(F.count("*").alias("n_texts")).where(F.col("n_texts") > max_texts)
    return lines, frequent


def _removed(docs: DataFrame, host: str, max_texts: int) -> DataFrame:
    """__k1, __k2, removed_words, __gone (hashes of the lines to remove) of the rows that lose lines."""
    lines, frequent = frequent_lines(docs, host, max_texts)
    # The salt spreads the rows of a common line. Rows that agree in all have one key: their lines count by place, once.
    mine = lines.withColumn("__salt", F.pmod("__k1", F.lit(SALTS)).cast("int"))
    salted = frequent.select("__host", "__line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    hits = mine.join(salted, ["__host", "__line", "__salt"])
    per_row = hits.groupBy("__k1", "__k2").agg(F.collect_set(F.struct(F.col("__at").alias("at"), F.col("__w").alias("w"), F.col("__line").alias("line"))).alias("__hits"))
    words = F.aggregate("__hits", F.lit(0).cast("long"), lambda total, h: total + h["w"])
    return per_row.select("__k1", "__k2", words.alias("removed_words"), F.array_distinct(F.col("__hits.line")).alias("__gone"))


def _judged(rows: DataFrame, removed: DataFrame) -> DataFrame:
    rows = rows.join(removed, ["__k1", "__k2"], "left").withColumn("removed_words", F.least(F.coalesce("removed_words", F.lit(0)), F.col("n_words")).cast("long"))
    depleted = 100 * (F.col("n_words") - F.col("removed_words")) < MIN_LEFT_PERCENT * F.col("n_words")
    return rows.withColumn("kept", ~F.col("base_failed") & ~depleted)


def verdicts(docs: DataFrame, host: str = "source", max_texts: int = MAX_TEXTS) -> DataFrame:
    """One row a document: base statistics, base_failed, removed_words, kept."""
    removed = _removed(docs, host, max_texts).drop("__gone")
    rows = base_statistics(_keyed(docs.select("doc_id", F.col(host), "text"), host)).drop("text", host, "__host")
    return _judged(rows, removed).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def cleaned(docs: DataFrame, host: str = "source", max_texts: int = MAX_TEXTS) -> DataFrame:
    """The kept documents, without their frequent lines; all columns stay."""
    removed = _removed(docs, host, max_texts)
    # The join moves each text once, in the packed row.
    rows = _judged(base_statistics(_keyed(packed(docs, host), host)).drop("text", host), removed)
    # One value of both verdicts: a filter on the base rules alone would be pushed down and compute them again.
    rows = rows.where(F.least((~F.col("base_failed")).cast("int"), F.col("kept").cast("int")) == 1)
    text = F.col("__whole.text")
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains("__gone", F.xxhash64(normal_line(x))), F.lit(False)))
    return unpacked(rows, docs, F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(lines, "\n")))
