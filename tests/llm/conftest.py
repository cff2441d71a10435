import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with columns that clash with helpers' names."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)
        for name in ("kept", "lines", "n_words", "salt", "key", "length", "piece", "__k", "component", "toxic", "a") if clash else ():
            df = df.withColumn(name, F.lit("mine"))
        return df

    return make


ODD = [(1, None), (2, ""), (3, " \t\n "), (None, "a few words stand here"), (5, "repeated row of words"), (5, "repeated row of words"), (6, "word " * 30000), (7, "x" * 200000), (8, "é 😀 ﷺ \u0000 ok"), (9, "one\n\n\ntwo three four five six\none"), (10, "tie"), (11, "tie")]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def nothing(docs_of):
    return docs_of([])
