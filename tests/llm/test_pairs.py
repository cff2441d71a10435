"""Near-duplicates, line dedup and tiling against brute force, and on odd rows."""

import itertools
import random
import re

import numpy as np
import pytest

from tidemark.llm import line_dedup, line_dedup_native, near_dup, queries, textvec, tiling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def prose(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = {}
    for d, t, *_ in rows:
        if d is not None:
            sets.setdefault(d, shingles(t))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates_equal_brute_force(spark, docs_of):
    rng = random.Random(1)
    rows = []
    for k in range(12):
        base = prose(rng, rng.randrange(60, 200))
        rows += [(100 * k, base), (100 * k + 7, base)]
        rows += [(100 * k + j, edited(rng, base, rng.randrange(6))) for j in range(8, 20)]
        rows += [(100 * k + j, prose(rng, 40) + " " + base) for j in range(20, 22)]
    rows += [(9000 + j, t) for j, t in enumerate(["one two", "ONE two", "one", None, "", "a b c d e", "A b c d e"])]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs_of(rows)).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in components(rows).items()}


@pytest.mark.parametrize("part", [3, 5])
def test_members_of_a_key_in_parts(part):
    """Every pair of different components comes out once, whatever the parts and the batches."""
    import pyarrow as pa

    rng = random.Random(part)
    names = ["key", "low", "high", "part", "doc_id", "component", "n_shingles", "bins", "halves"]
    rows, want = [], set()
    for key_no, members in enumerate([1, 2, 14, 23]):
        half = np.full(2, key_no + 1, np.uint64)
        one, two, salt = near_dup._tables(2)
        key = int(near_dup._key(half[one], half[two], salt).view(np.int64)[0])
        parts = -(-members // part)
        ids = [100 * key_no + k for k in range(members)]
        component = {i: i // 2 for i in ids}
        want |= {(a, b) for a in ids for b in ids if a < b and component[a] != component[b]}
        for i in ids:
            p = rng.randrange(parts)
            rows += [(key, min(p, o), max(p, o), p, i, component[i], 50, bytes([7]) * near_dup.BINS, half.tobytes()) for o in range(parts)]
    rows.sort(key=lambda r: r[:4])
    table = pa.table({n: [r[k] for r in rows] for k, n in enumerate(names)})
    for size in (1, 7, 1000):
        got = [(r["a"], r["b"]) for b in near_dup._rest(iter(table.to_batches(max_chunksize=size)), 85) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want


def test_open_keys_in_parts_lose_no_link(spark, docs_of, monkeypatch):
    monkeypatch.setattr(near_dup, "PART", 4)
    rng = random.Random(8)
    base = prose(rng, 60)
    # Copies of one base with up to five edits: many of them share keys, and only some are similar.
    rows = [(j, edited(rng, base, rng.randrange(6))) for j in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs_of(rows)).collect()}
    assert got == components(rows)


def test_a_large_group_makes_few_pairs(spark, docs_of):
    rng = random.Random(2)
    base = prose(rng, 150)
    rows = [(k, edited(rng, base, 12)) for k in range(150)] + [(1000 + k, base) for k in range(50)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs_of(rows)).collect()}
    assert got == {d: c for d, (_, c) in components(rows).items()}
    assert len({r.doc_id for r in near_dup.deduplicated(docs_of(rows)).collect()}) == len(set(got.values()))


def test_sketches_allow_what_is_at_the_threshold():
    rng = np.random.default_rng(3)
    for size in (60, 400, 5000):
        both = int(0.85 * size)
        for _ in range(20):
            values = rng.integers(0, 2**64, 2 * size - both, dtype=np.uint64)
            marks = np.zeros((2, near_dup.BINS), np.uint8)
            for k, own in enumerate((values[:size], values[-size:])):
                own = np.sort(own)
                part, first = np.unique((own >> np.uint64(55)).astype(int), return_index=True)
                marks[k, part] = own[first] % np.uint64(255) + np.uint64(1)
            similar = both / (2 * size - both)
            if similar >= 0.85:
                assert near_dup._likely(marks[:1], marks[1:], np.array([2 * size]))[0]


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_allow_sets_at_the_threshold(percent):
    rng = np.random.default_rng(3)
    for union in (60, 400, 5000):
        both = -(-percent * union // 100)
        for _ in range(20):
            values = rng.integers(0, 2**64, union, dtype=np.uint64)
            only = (union - both) // 2
            marks = np.zeros((2, near_dup.BINS), np.uint8)
            for k, own in enumerate((values[: union - only], np.concatenate([values[:both], values[union - only :]]))):
                own = np.sort(own)
                part, first = np.unique((own >> np.uint64(55)).astype(int), return_index=True)
                marks[k, part] = own[first] % np.uint64(255) + np.uint64(1)
            assert near_dup._likely(marks[:1], marks[1:], np.array([union + both]), percent)[0]


def test_the_stage_links_from_80_percent(spark, docs_of):
    import corpus_pipeline

    rng = random.Random(8)
    rows = []
    for k in range(30):
        words = prose(rng, 104).split(" ")  # 100 shingles; two changes leave 90 of a union of 110
        changed = list(words)
        changed[30], changed[60] = f"e{k}", f"f{k}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
    for k in range(0, 60, 2):
        a, b = shingles(rows[k][1]), shingles(rows[k + 1][1])
        assert 0.80 <= len(a & b) / len(a | b) < 0.85
    df = docs_of(rows)
    assert near_dup.deduplicated(df).count() == 60
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == set(range(0, 60, 2))


def test_every_row_counts_by_itself(spark, docs_of):
    rng = random.Random(9)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    near = a.rsplit(" ", 1)[0] + " changed"
    rows = [(None, c), (None, d), (5, a), (5, b), (9, near), (9, b), (11, d), (None, None)]
    got = sorted(((r.doc_id, r.text) for r in near_dup.deduplicated(docs_of(rows)).collect()), key=str)
    assert got == sorted([(None, c), (None, None), (5, a), (5, b), (11, d)], key=str)
    items = spark.createDataFrame([(None, " ".join(c.split(" ")[:20]))], "item_id long, text string")
    assert (None, c) not in {(r.doc_id, r.text) for r in tiling.decontaminated(docs_of(rows), items).collect()}
    # op9: one row an id, each id by one text in every step.
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs_of(rows)).collect()}
    texts = {k: min((r.h, r.text) for r in near_dup._keyed(docs_of(rows)).where(f"doc_id = {k}").selectExpr("__row h", "text").collect())[1] for k in (5, 9, 11)}
    assert found == {k: (n, i) for k, (n, i) in components(list(texts.items())).items()}


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 99), (7, 7)], "a long, b long")
    got = {r.doc_id: r.component for r in near_dup.components(links).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {100: 99} or got == {k: 0 for k in range(61)} | {99: 99, 100: 99}


def near_lines(rows):
    lines = []
    for d, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            words = " ".join(line.lower().split()).split(" ")
            if len(words) >= 4:
                lines.append(((d, p), words))
    lines.sort()
    gone, seen = {}, []
    for at, w in lines:
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for other, o in seen:
            exact = w == other
            both = len(s & o)
            if exact or (s and o and 100 * both >= 80 * (len(s) + len(o) - both)):
                gone.setdefault(at[0], set()).add(at[1])
                break
        seen.append((w, s))
    return gone


@pytest.mark.parametrize("native", [False, True])
def test_line_dedup_equals_brute_force(spark, docs_of, native):
    rng = random.Random(4)
    shared = [prose(rng, rng.randrange(4, 60)) for _ in range(15)]
    rows = []
    for d in range(60):
        lines = [prose(rng, rng.randrange(1, 40)) for _ in range(3)] + [edited(rng, rng.choice(shared), rng.choice([0, 0, 1, 2])) for _ in range(2)]
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines)))
    df = docs_of(rows)
    expected = near_lines(rows)
    got = {r.doc_id: set(r.removed) for r in line_dedup.report(df, native=native).collect() if r.removed}
    assert got == expected
    texts = {r.doc_id: r.text for r in line_dedup.without_repeats(df, native=native).collect()}
    assert texts == {d: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in expected.get(d, ())) for d, t in rows}


def test_lines_with_equal_small_sets_match(spark, docs_of):
    lines = ["a a a a a", "a a a a a a a", "x y x y x y x", "x y x y x y x y x", "p q r p q r p q", "p q r p q r p q r p q", "a b c d e f", "a b c d e g", "k k k k"]
    rows = list(enumerate(lines))
    got = {r.doc_id: set(r.removed) for r in line_dedup.report(docs_of(rows)).collect() if r.removed}
    assert got == near_lines(rows) == {1: {0}, 3: {0}, 5: {0}}


def test_hot_shingles_are_dealt_and_compared_in_parts(spark, docs_of, monkeypatch):
    """One phrase in every line and one near-copied line in a third of all, with limits so low that they are dealt."""
    monkeypatch.setattr(line_dedup, "HOT", 4)
    monkeypatch.setattr(line_dedup, "PART", 3)
    rng = random.Random(11)
    phrase, base = prose(rng, 6), prose(rng, 30)
    rows = [(d, (edited(rng, base, rng.choice([0, 1, 2])) if d % 3 == 0 else phrase + " " + prose(rng, rng.randrange(1, 4), 6)) + "\n" + phrase) for d in range(90)]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (7, "other " + rows[8][1])]
    df = docs_of(rows)
    got = {r.doc_id: set(r.removed) for r in line_dedup.report(df.where("doc_id <> 7 and doc_id is not null")).collect() if r.removed}
    assert got == near_lines([r for r in rows if r[0] not in (7, None)])
    assert len(line_dedup.report(df).collect()) == len(rows)


def test_native_lines_run_no_python_and_equal_brute_force(spark, docs_of, monkeypatch):
    """op3's form: hot shingles in parts, white space of all kinds, equal small sets, repeated rows, prefixes longer than what goes with a row."""
    monkeypatch.setattr(line_dedup, "HOT", 4)
    monkeypatch.setattr(line_dedup, "PART", 3)
    monkeypatch.setattr(line_dedup, "FIRST", 2)
    monkeypatch.setattr(line_dedup_native, "EVERY", 1)
    monkeypatch.setattr(line_dedup_native, "STANDS_OUT", 0)
    plans, write = [], line_dedup.stored

    def stored(df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, **options)

    monkeypatch.setattr(line_dedup, "stored", stored)
    rng = random.Random(12)
    phrase, base = prose(rng, 6), prose(rng, 40)
    rows = [(d, (edited(rng, base, rng.choice([0, 1, 2])) if d % 3 == 0 else phrase + " " + prose(rng, rng.randrange(1, 4), 6)) + "\n" + phrase) for d in range(60)]
    odd = ["a a a a a", "a a a a a a a", "x y x y x y x", "x y x y x y x y x", "k k k k", " \t " + base.upper().replace(" ", "\t"), base.replace(" ", "  ") + "\x0b"]
    rows += [(100 + k, line) for k, line in enumerate(odd)]
    got = {r.doc_id: set(r.removed) for r in line_dedup.report(docs_of(rows), native=True).collect() if r.removed}
    assert got == near_lines(rows)
    assert {101, 103, 105, 106} <= set(got)
    df = docs_of([*rows, (None, rows[0][1]), (7, rows[7][1]), (7, "other " + rows[8][1]), (200, None)])
    report = line_dedup.report(df, native=True)
    plans.append(report._jdf.queryExecution().executedPlan().toString())
    assert len(report.collect()) == df.count()
    assert len(plans) > 10 and not any("Python" in p or "InArrow" in p or "Pandas" in p for p in plans)


def test_native_sets_are_made_once_and_equal_brute_force(spark, docs_of, monkeypatch):
    """Lines that are compared with their groups after the earliest have their sets from before; copies are told by their places."""
    asked, make = [], line_dedup_native.sets

    def sets(docs, lines, *more):
        asked.append([tuple(r) for r in lines.select("__doc", "__row", "p").collect()])
        return make(docs, lines, *more)

    monkeypatch.setattr(line_dedup_native, "sets", sets)
    monkeypatch.setattr(line_dedup_native, "EVERY", 1)
    rng = random.Random(13)
    base = prose(rng, 80)
    rows = [(d, edited(rng, base, rng.choice([1, 2, 3])) + "\n" + prose(rng, 12)) for d in range(60)]
    rows += [(100 + d, rows[d % 7][1]) for d in range(40)] + [(3, rows[3][1]), (99, "not asked for by any line")]
    got = {r.doc_id: set(r.removed) for r in line_dedup.report(docs_of(rows), native=True).collect() if r.removed}
    assert got == near_lines([r for k, r in enumerate(rows) if k != len(rows) - 2])
    places = [x for part in asked for x in part]
    assert len(asked) == 2 and asked[0] and len(places) == len(set(places))


def test_open_lines_pair_by_what_their_prefixes_share(spark):
    """Lines with one hot shingle and little else in common make no pairs; a pair that may match comes out once, however long its prefixes."""
    rng = random.Random(14)
    rows = []
    for k in range(60):
        twin = k // 2 if k < 8 else k
        own = sorted(random.Random(twin).sample(range(100, 10**6), 23))
        tokens = [1, *own, *sorted(rng.sample(range(10**6, 2 * 10**6), 2))]
        rows += [(t, (k, 0), 125, tokens.index(t), 1, sum(1 << b for b in {x % 63 for x in tokens}), len(tokens), tokens[: line_dedup.FIRST], None) for t in (1, own[0])]
    schema = "token long, line struct<__doc: long, __at: long>, n int, i int, parts int, m long, c int, ts array<long>, closed boolean"
    got = [(r.a[0], r.b[0]) for r in line_dedup._open_pairs(spark.createDataFrame(rows, schema), 80).collect()]
    assert sorted(got) == [(0, 1), (2, 3), (4, 5), (6, 7)]


def test_op3_asks_for_the_form_without_python(monkeypatch):
    asked = []
    monkeypatch.setattr(line_dedup, "report", lambda docs, **options: asked.append(options))
    monkeypatch.setattr(queries, "table", lambda *_: None)
    queries.op3_line_dedup(None, "")
    assert asked == [{"native": True}]


def tile_coverage(text, item):
    w, t = (WORD.findall(x.translate(LOWER)) for x in (text or "", item))
    used_w, used_t, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(w)):
            for j in range(len(t)):
                k = 0
                while i + k < len(w) and j + k < len(t) and w[i + k] == t[j + k] and i + k not in used_w and j + k not in used_t:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < min(5, len(t)):
            return total
        total += best[0]
        used_w.update(range(best[1], best[1] + best[0]))
        used_t.update(range(best[2], best[2] + best[0]))


def test_tiling_equals_brute_force(spark, docs_of):
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randrange(3, 30), 60)) for k in range(8)] + [(50, None), (51, ""), (None, "w1 w2 w3 w4 w5 w6")]
    rows = [(d, prose(rng, 40, 60)) for d in range(20)]
    for d in range(20, 40):
        words = rng.choice(items[:8])[1].split(" ")
        parts = [words[k : k + 7] for k in range(0, len(words), 7)]
        rng.shuffle(parts)
        rows.append((d, prose(rng, 10) + " " + " ".join(" ".join(p).upper() for p in parts) + " " + prose(rng, 10)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched_words for r in tiling.leaks(docs_of(rows), benchmark).collect()}
    expected = {}
    for d, t in rows:
        for i, item in items:
            if item and i is not None and (m := tile_coverage(t, item)) >= 0.6 * len(item.split(" ")):
                expected[d, i] = m
    assert got == expected and any(k[0] >= 20 for k in got)
    kept = {r.doc_id for r in tiling.decontaminated(docs_of(rows), benchmark).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in expected}


@pytest.mark.parametrize("blocks", [1, 40])
def test_items_in_blocks(spark, docs_of, monkeypatch, blocks):
    items = [(k, f"alpha{k} beta gamma{k} delta eps{k} zeta") for k in range(20)]
    monkeypatch.setattr(tiling, "BLOCK_BYTES", sum(len(t) for _, t in items) // blocks + 1)
    rows = [(k, "before " + t + " after") for k, t in items]
    assert sorted((r.doc_id, r.item_id) for r in tiling.leaks(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()) == [(k, k) for k in range(20)]


def test_odd_rows_and_nothing(spark, odd, nothing):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(odd).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[6][0] == 1 and got[11] == (1, 10) and None not in got
    assert near_dup.deduplicated(odd).columns == odd.columns
    report = line_dedup.report(odd).collect()
    assert len(report) == odd.count() and all(r.n_removed == 0 for r in report)
    assert line_dedup.without_repeats(odd).columns == odd.columns
    items = spark.createDataFrame([(1, "a few words stand here")], "item_id long, text string")
    assert [r.doc_id for r in tiling.leaks(odd, items).collect()] == [None]
    assert tiling.decontaminated(odd, items).count() == odd.count() - 1
    assert near_dup.near_duplicates(nothing).count() == line_dedup.report(nothing).count() == tiling.leaks(nothing, items).count() == 0
    assert tiling.leaks(odd, items.limit(0)).count() == 0 and near_dup.deduplicated(nothing).count() == 0


def test_word_hashes_do_not_depend_on_place():
    import pyarrow as pa

    texts = ["alpha beta  gamma", "", "beta\talpha", "x" * 5000 + " beta"]
    data, at = textvec.column_bytes(pa.array(texts))
    starts, ends, first = textvec.word_spans(data, at)
    h = textvec.word_hashes(data, starts, ends)
    assert list(np.diff(first)) == [3, 0, 2, 2] and h[0] == h[4] and h[1] == h[3] == h[6] and len(set(h.tolist())) == 4
