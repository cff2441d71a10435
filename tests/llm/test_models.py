"""The fitted operators on held-out labels, and the pipeline."""

import html
import os
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import ODD
from tests.oracle import connect, differences
from tidemark.llm import html_blocks, language_id, queries, toxicity
from tidemark.llm.common import bounded_sample, fold

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_segments_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 25)
        dense = [rng.choice([-1.0, -1.0, 2.0, 0.5, 3.0]) for _ in range(n)]
        places = [k for k in range(n) if dense[k] != -1.0]
        got = toxicity.maximal_segments(np.array(places, int), np.array([dense[k] for k in places]), -1.0)

        def split(a, b):
            """Greatest segment (shortest, then first), then both sides of it."""
            best = max(((sum(dense[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            _, _, _, i, j = best
            return [*split(a, i), (i, j, best[0]), *split(j, b)]

        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in split(0, n)]


def toxic_rows(n=1200):
    rng = random.Random(2)
    stem = ["zorb", "quix", "mungo"]
    rows, labels = [], []
    for d in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        bad = d % 6 == 0
        for _ in range(rng.randrange(2, 6) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(stem) + rng.choice(["", "s", "ish", f"{rng.randrange(1000)}"]))
        rows.append((d, " ".join(words)))
        labels.append((d, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, docs_of):
    rows, labels = toxic_rows()
    marks = spark.createDataFrame([*labels, (None, 1, 1), (99999, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs_of(rows), marks)
    got = {r.doc_id: r for r in toxicity.score(docs_of(rows), model).collect()}
    held = [(got[d].predicted, t) for d, _, t in labels if got[d].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97 and any(t for _, t in held)
    assert any(got[d].n_passages for d, _, t in labels if t)


def test_toxicity_without_labels_and_of_odd_rows(spark, odd, nothing, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(odd, none) is None and {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    rows, labels = toxic_rows(300)
    model = toxicity.fit(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(nothing, model).count() == 0


def test_languages_on_held_out_rows(spark, docs_of):
    rng = random.Random(3)
    letters = {"aa": "abcdeé", "bb": "uvwxyz", "cc": "あいうえ"}
    rows = [(d, " ".join("".join(rng.choice(letters[k]) for _ in range(4)) for _ in range(rng.randrange(4, 200)))) for d in range(600) for k in [list(letters)[d % 3]]]
    from pyspark.sql import functions as F

    df = docs_of(rows).withColumn("lang", F.element_at(F.array(*map(F.lit, letters)), (F.col("doc_id") % 3 + 1).cast("int")))
    net = language_id.fit(df)
    got = {r.doc_id: r for r in language_id.identify(df, net).collect()}
    held = [d for d, _ in rows if got[d].held_out]
    assert np.mean([got[d].lang_pred == list(letters)[d % 3] for d in held]) > 0.98 and len(held) > 80


def test_languages_of_odd_rows(spark, odd, nothing):
    net = language_id.train(["abc def", "xyz uvw"] * 20, ["aa", "bb"] * 20, epochs=1)
    got = {r.doc_id: r for r in language_id.identify(odd, net).collect()}
    assert {got[d].lang_pred for d in (1, 2, 3)} == {"und"} and got[6].lang_pred in ("aa", "bb") and language_id.identify(odd, net).count() == len(ODD)
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.identify(nothing, net).count() == 0 and language_id.fit(nothing) is None


def test_windows_cover_every_byte():
    data = np.arange(1000, dtype=np.int64).astype(np.uint8)
    codes, rows, sizes = language_id.windows_of(data, np.array([0, 0, 300, 1000]))
    assert sizes.sum() == 1000 and rows.tolist() == [1, 1, 2, 2, 2]
    assert np.concatenate([c[:s] for c, s in zip(codes, sizes, strict=True)]).tolist() == (data.astype(int) + 1).tolist()
    parts = list(language_id.window_batches(data, np.array([0, 0, 300, 1000]), 2))
    assert [len(c) for c, _, _ in parts] == [2, 2, 1] and all((np.concatenate(x) == y).all() for x, y in zip(zip(*parts, strict=True), (codes, rows, sizes), strict=True))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu a</a></li></ul></nav><!-- x --><div class="ad">Buy &amp; save</div>
<article><h1>Head &eacute; &am</h1><p><b>One  two<br>three<p>Four\nfive &lt;x&gt;</p></article><footer>&copy; us"""


def test_nothing_but_raw_text_is_dropped():
    texts = lambda page: [t for _, t, _ in html_blocks.blocks(page)]
    assert texts("<p>a<svg width='1'/></p><article><p>b</p></article><svg><text>no</text></svg><p>c") == ["a", "b", "c"]
    for name in ("title-bar", "select-menu", "template-x", "svg-icon"):
        assert texts(f"<{name}>head</{name}><p>b</p>") == ["head", "b"]
    assert texts("<select><option>o</option><p>b</p>") == ["o", "b"] and texts("<object><p>b</p></object><p>c") == ["b", "c"]
    assert texts("<p>area <math><mi>x</mi></math> here") and "x" in " ".join(texts("<p>area <math><mi>x</mi></math> here"))
    assert texts("<svg><text>no</text></svg>") == texts("<textarea>never closed <p>x") == texts("<style>p") == []


def test_blocks():
    assert [t for _, t, _ in html_blocks.blocks(PAGE)] == ["Menu a", "Buy & save", "Head é &am", "One two three", "Four five <x>", "© us"]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<script>never closed <p>x") == []
    assert [t for _, t, _ in html_blocks.blocks("a < b <p>c<a href='>'>d</a> <div title=\"x>y\">e")] == ["a < b", "cd", "e"]


def test_gradients_are_right():
    rng = np.random.default_rng(4)
    net = html_blocks.Net()
    x, mask = rng.normal(size=(5, 3, html_blocks.INPUT)).astype(np.float32), np.ones((5, 3), np.float32)
    mask[3:, 1] = 0
    y = (rng.random((5, 3)) < 0.5).astype(np.float32)

    def loss():
        z = net.logits(x, mask).astype(np.float64)
        return ((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum()

    for w, g in zip(net.weights(), net.step(x, mask, y), strict=True):
        at = np.unravel_index(int(np.abs(g).argmax()), w.shape)
        old = w[at].copy()
        w[at] = old + 1e-2
        up = loss()
        w[at] = old - 1e-2
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 2e-3 + 0.05 * abs(g[at])


@tables
def test_main_text_of_pages_and_of_layouts_never_seen(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    net = html_blocks.fit(pages)
    right = 0
    rows = html_blocks.extract(pages, net).collect()
    source = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S).group(1)
        expected = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split("</?(?:p|h1)>", inside)]
        right += r.text == "\n".join(x for x in expected if x)
        assert r.n_chars == len(r.text)
    assert right >= 0.97 * len(rows)
    rng = np.random.default_rng(9)
    texts = [t for h in list(source.values())[:20] for p, t, _ in html_blocks.blocks(h) if "article" in p]
    wrong = total = 0
    for k in range(60):
        page, labels = html_blocks._layout(texts[k : k + 6], texts, rng)
        found = html_blocks.blocks(page)
        if len(found) == len(labels):
            keep = html_blocks.main_mask(net, [found])[0]
            wrong += int((keep != (np.array(labels) > 0)).sum())
            total += len(labels)
    assert wrong < 0.1 * total
    some = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>"), (3, "u", "<p>")], "page_id long, url string, html string")
    assert [r.text for r in html_blocks.extract(some, net).collect()] == [""] * 4
    assert html_blocks.extract(some.limit(0), net).count() == 0


def test_samples_are_bounded(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "id % 2 as label")
    got = bounded_sample(df.unionAll(df), "label", "doc_id", 10, 3)
    assert len(got) == 60 and len(set(got)) == 60 and got == bounded_sample(df, "label", "doc_id", 10, 3)
    import zlib

    assert [r.f for r in df.limit(50).select(fold().alias("f")).collect()] == [zlib.crc32(str(k).encode()) % 5 for k in range(50)]


@tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), queries.oracle_sql()[name], connect(SF)) is None


@tables
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
        assert name == "pack" or at.columns == docs.columns
    packed = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    leaked = {r.doc_id for r in queries.op6_string_tiling(spark, SF).collect()}
    failed = {r.doc_id for r in queries.op2_quality_rules(spark, SF).where("not kept").collect()}
    assert kept and not kept & leaked and not kept & failed


def test_training_windows_come_from_the_whole_text(spark):
    from pyspark.sql import functions as F

    texts = ["h" * 1024 + "".join(chr(97 + k % 7) for k in range(20_000)) + str(n) for n in range(10)] + ["short", ""]
    got = [r.w for r in spark.createDataFrame([(t,) for t in texts], "text string").select(language_id.sampled_windows(F.col("text")).alias("w")).collect()]
    assert all(0 < len(w) <= 1024 for w in got[:10]) and sum(w.count("h") for w in got[:10]) < 5 * 1024 and got[10:] == ["short", ""]
