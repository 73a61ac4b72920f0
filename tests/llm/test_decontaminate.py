import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm import decontaminate as D


def sellers(pattern, text):
    """Smallest edit distance of the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(text, item, q, window, step, rate):
    text, item = D.folded(text), D.folded(item)
    if len(item) < q:
        return None
    w = min(window, len(item))
    best = min(sellers(item[s : s + w], text) for s in D.window_starts(len(item), window, step))
    return best if best <= D.edits_allowed(w, rate, q) else None


def noisy(rnd, text, edits):
    text = list(text)
    for _ in range(edits):
        k, kind = rnd.randrange(len(text)), rnd.randrange(3)
        if kind == 0:
            text[k] = rnd.choice("abcx ")
        elif kind == 1:
            del text[k]
        else:
            text.insert(k, rnd.choice("abcx "))
    return "".join(text)


@given(st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_search_equals_brute_force(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    items = [" ".join(word() for _ in range(rnd.randint(2, 12))) for _ in range(4)]
    text = " ".join(word() for _ in range(10)) + " " + noisy(rnd, rnd.choice(items), rnd.randint(0, 6)) + " " + " ".join(word() for _ in range(rnd.randint(0, 30)))
    made = D.Items(list(range(4)), [D.folded(t) for t in items], 4, 24, 5, 0.15)
    keep = [i for i, t in enumerate(made.texts) if len(t) >= 4]
    made = D.Items(keep, [made.texts[i] for i in keep], 4, 24, 5, 0.15).prepared()
    got = {row[0]: row[1] for row in made.found(text)}
    want = {i: b for i in keep if (b := brute(text, items[i], 4, 24, 5, 0.15)) is not None}
    assert got == want


def test_slices(monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and then goes home to sleep for a long while, it is said"
    made = D.Items([7], [item], 8, 80, 8, 0.1).prepared()
    text = "z" * 900 + item + "y" * 700
    whole = made.found(text)
    for size in (500, 700, 930, 960):
        monkeypatch.setattr(D, "SLICE", size)
        assert made.found(text) == whole and whole[0][0] == 7


def test_odd_rows_and_columns(spark):
    item = "Of onbleeror atin onored heing stnter ofanblewhwh ertionen thon theser therti thnt blewh aantiinghe for."
    bench = spark.createDataFrame([(1, item), (2, None), (3, "tiny"), (None, item)], "item_id long, text string")
    rows = [(1, item.upper().replace(" ", "\n  "), 5), (2, None, 5), (3, "", 5), (4, item[:50], 5), (5, "é" * 2000 + item, 5), (None, item, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = D.matches(docs, bench).collect()
    assert not [r for r in got if r.item_id == 3]
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == {(1, 1, 0), (5, 1, 0), (None, 1, 0)}
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4}
    assert D.matches(docs.limit(0), bench).count() == 0 and D.matches(docs, bench.limit(0)).count() == 0
    assert D.clean(docs, bench, block_chars=60).count() == 3  # several blocks


def test_banded_is_exact_inside_the_band():
    rnd = random.Random(3)
    for _ in range(30):
        p, t = ["".join(rnd.choice("ab") for _ in range(n)) for n in (12, 30)]
        cost, _ = D.banded(D.codes(p)[None, :], D.codes(t), np.array([-12]), 54)
        assert cost[0] == sellers(p, t)


def test_short_items_are_whole_words(spark):
    bench = spark.createDataFrame([(1, "Xyzzy"), (2, "c++"), (3, ""), (4, " a  b "), (5, "xyzzy")], "item_id long, text string")
    rows = [(1, "say XYZZY."), (2, "xyzzyx _xyzzy"), (3, "in c++ and a\tb"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits, r.doc_end) for r in D.matches(docs, bench).collect()}
    assert got == {(1, 1, 0, 9), (1, 5, 0, 9), (3, 2, 0, 6), (3, 4, 0, 14)}
    assert {r.doc_id for r in D.clean(docs, bench).collect()} == {2, 4, 5}


def rows_of(made, text):
    return {r[0]: r[1:] for r in made.found(text)}


def plainly(made, text):
    """As found(), by aligning every window of every item with the whole text."""
    text, out = D.folded(text), {}
    for n, item in enumerate(made.texts):
        w = min(made.window, len(item))
        e = D.edits_allowed(w, made.error_rate, made.q)
        for s in D.window_starts(len(item), made.window, made.step):
            cost, end = D.banded(D.codes(item[s : s + w])[None, :], D.codes(text), np.array([-w]), len(text) + w)
            if cost[0] <= e:
                out[made.ids[n]] = min(out.get(made.ids[n], (99, 0, 0, 0)), (int(cost[0]), s, s + w, int(end[0])))
    return out


@given(st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_repetitive_texts_equal_brute_force(seed):
    """Runs of short periods in items and texts, shortened and looked at in small chunks or not, give the same rows."""
    rnd = random.Random(seed)
    unit = lambda: rnd.choice(["-", "ab", "- ", "abc", "=", "xyzxy"]) * rnd.randint(1, 60)
    word = lambda: "".join(rnd.choice("abx") for _ in range(rnd.randint(1, 7)))
    some = lambda n: " ".join(rnd.choice([unit, word, word])() for _ in range(n))
    items = [D.folded(some(rnd.randint(1, 6))) for _ in range(4)]
    text = " ".join([some(3), noisy(rnd, rnd.choice(items), rnd.randint(0, 4)), some(2), rnd.choice(["-", "ab"]) * rnd.randint(0, 300)])
    made = D.Items(list(range(4)), items, 4, 24, 5, 0.15)
    made = D.Items([n for n in range(4) if len(items[n]) >= 4], [t for t in items if len(t) >= 4], 4, 24, 5, 0.15).prepared()
    want = plainly(made, text)
    assert rows_of(made, text) == want
    before = D.MANY, D.CHUNK
    try:
        D.MANY, D.CHUNK = 0, 7
        assert rows_of(made, text) == want
    finally:
        D.MANY, D.CHUNK = before


def test_shortened_runs_keep_every_short_stretch():
    rnd = random.Random(7)
    for _ in range(40):
        text = "".join(rnd.choice(["a" * rnd.randint(1, 300), "abc" * rnd.randint(1, 90), "xy", "q" * 3, "abcdefghijklmnop" * 9]) for _ in range(6))
        c, origin = D.shortened(D.codes(text), 20)
        short = "".join(chr(x) for x in c)
        assert [text[k] for k in origin] == list(short)
        for n in (1, 7, 20):
            first = {}
            for k in range(len(text) - n, -1, -1):
                first[text[k : k + n]] = k
            kept = {}
            for k in range(len(short) - n, -1, -1):
                kept[short[k : k + n]] = int(origin[k])
            assert kept == first


def test_long_runs_take_little_time_and_memory():
    """Items with rules of dashes and runs of two letters against long documents of the same."""
    import resource
    import time

    items = [f"question {k} has a rule {'-' * 100} and an answer that is {k * k}" for k in range(20)] + ["ab" * 1000, "the end of it all " * 40]
    made = D.Items(list(range(22)), items, 8, 80, 8, 0.1).prepared()
    texts = ["-" * 1_000_000, "ab" * 500_000, ("-" * 80 + " row ") * 500, items[3] + "-" * 40_000 + items[5], "the end of it all " * 5000]
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    got = [rows_of(made, t) for t in texts]
    assert time.process_time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000
    assert set(got[0]) == set(range(20)) and got[1][20][0] == 0 and got[4][21][:2] == (0, 0)
    assert got[3][3][0] == 0 and got[3][5][0] == 0


def test_least_length_of_items(spark):
    bench = spark.createDataFrame([(1, "the"), (2, "a passage of some length")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "all the cats"), (2, "here is a passage of some length."), (3, "none")], "doc_id long, text string")
    assert {r.doc_id for r in D.clean(docs, bench).collect()} == {3}
    assert {r.doc_id for r in D.clean(docs, bench, least_chars=D.STAGE_LEAST_CHARS).collect()} == {1, 3}
