import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm import runs


def by_force(words, least=12):
    """(start, end, smallest period) of every maximal stretch of ``least`` words and two periods."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 2 + 1):
        s = q
        while s < n:
            if words[s] != words[s - q]:
                s += 1
                continue
            e = s
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s + q >= max(least, 2 * q) and (s - q, e) not in seen:  # longer periods of it are multiples
                seen.add((s - q, e))
                out.append((s - q, e, q))
            s = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def caught(words, cuts=(), **options):
    catcher = runs.RunCatcher(**options)
    told = set()
    for part in np.split(np.array(words, np.int64), sorted(cuts)):
        told.update(catcher.append(part))
    return catcher.runs(), told


words_of = st.one_of(
    st.lists(st.integers(0, 1), max_size=90),
    st.lists(st.integers(0, 3), max_size=120),
    st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 9)), max_size=6).map(lambda x: [w for part, k in x for w in part * k]),
)


@given(words_of, st.lists(st.integers(0, 90), max_size=12), st.sampled_from([6, 9, 12]))
@settings(max_examples=300, deadline=None)
def test_equals_brute_force_however_words_are_appended(words, cuts, least):
    want = by_force(words, least)
    got, told = caught(words, [c for c in cuts if c <= len(words)], least=least)
    assert got == want
    assert set(want) <= told


@given(words_of)
@settings(max_examples=60, deadline=None)
def test_word_by_word(words):
    got, told = caught(words, range(1, len(words)))
    assert got == by_force(words)
    for s, e, q in told:  # every square is told when its last word comes
        assert e - s >= max(12, 2 * q) and all(words[k] == words[k - q] for k in range(s + q, e))


def test_long_periods():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 5000, 3000)
    words = np.concatenate([rng.integers(0, 5000, 777), np.tile(base, 3)[:7001], rng.integers(0, 50, 501), np.full(900, 7), np.tile([1, 2, 3, 4, 5], 77)]).tolist()
    got, _ = caught(words)
    assert got == by_force(words)
    assert any(q == 3000 and e - s >= 7001 for s, e, q in got)


@pytest.mark.parametrize("words", [[0] * 4000, [0, 1] * 1500, ([0] * 40 + [1]) * 30 + ([0] * 40 + [2]) * 30])
def test_repetitive(words):
    assert caught(words)[0] == by_force(words)
    assert caught(words, range(100, len(words), 100))[0] == by_force(words)


def test_fibonacci_and_thue_morse():
    fib, before = [0, 1], [0]
    while len(fib) < 900:
        fib, before = fib + before, fib
    assert caught(fib)[0] == by_force(fib)
    morse = [bin(k).count("1") % 2 for k in range(4096)]  # equal polynomial hashes of different blocks
    assert caught(morse)[0] == by_force(morse)
    assert caught(morse, range(64, 4096, 64))[0] == by_force(morse)


def test_a_million_words_of_one_kind_take_seconds():
    got, _ = caught(np.zeros(1_000_000, np.int64))
    assert got == [(0, 1_000_000, 1)]


def test_groups_of_texts():
    rng = random.Random(5)
    texts = [[rng.randrange(k % 4 + 1) for _ in range(rng.randrange(60))] for k in range(40)] + [[], [0]]
    assert runs.runs_of(texts) == [by_force(t) for t in texts]
    assert runs.runs_of([]) == [] and runs.runs_of([[]]) == [[]]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = by_force(words)
    kept = [w for k, w in enumerate(words) if not any(s + q <= k < e for s, e, q in found)]
    told = [(s, e - s, q) for s, e, q in found]
    best = min(told, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(told), *best, exponent, sha("".join(f"{s},{n},{q}\n" for s, n, q in told)), sha(" ".join(kept)))


def test_rows_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", " \t\n", "a " * 30, "x" * 3000, "  é b \x1f\x0b c " * 9, "one two three " * 5 + "end", "lonely"]
    texts += [" ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randrange(80))) for _ in range(150)]
    rows = [(k, t, 1, "n") for k, t in enumerate(texts)] + [(3, "a " * 30, 2, "m"), (None, "b " * 20, 3, "o"), (3, "other text", 2, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, period string").repartition(3)
    got = runs.collapse(docs, plant=True, group_words=200)
    assert got.columns == runs.NAMES
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(k, t) for k, t, *_ in rows), key=repr)


def test_real_outputs(spark):
    docs = spark.createDataFrame([(1, "start " + "very good " * 7 + "end"), (2, "no run")], "id long, body string")
    got = {r.doc_id: r for r in runs.collapse(docs, id_col="id", text_col="body", with_text=True).collect()}
    assert got[1].collapsed == "start very good end" and [tuple(r) for r in got[1].runs] == [(1, 14, 2)]
    assert got[2].collapsed == "no run" and got[2].runs == [] and got[2].exponent_milli is None
    assert got[1].collapsed_sha256 == hashlib.sha256(b"start very good end").hexdigest()


def test_empty(spark):
    assert runs.collapse(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(r.text or "") < 6000]
    got = {r.doc_id: tuple(r) for r in runs.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs) and len(short) > 100
    for r in short:
        assert got[r.doc_id] == expected(r.doc_id, r.text)
