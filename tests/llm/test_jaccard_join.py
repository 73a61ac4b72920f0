import random
from itertools import combinations

import numpy as np
import pytest

from gridspark.llm import jaccard_join as J
from gridspark.llm.shingles import shingle_set


def brute(rows, threshold=0.8):
    """doc_id -> (class_id, set_id, n_links), from all pairs."""
    sets = {d: frozenset(shingle_set(t).tolist()) for d, t in rows}
    by = {}
    for d, s in sorted(sets.items()):
        by.setdefault(s, []).append(d)
    firsts = {s: min(ds) for s, ds in by.items() if s}
    near = {s: [] for s in firsts}
    for a, b in combinations(firsts, 2):
        if len(a & b) >= threshold * len(a | b):
            near[a].append(b)
            near[b].append(a)
    root = {}
    for s in sorted(firsts, key=firsts.get):
        if s not in root:
            front = [s]
            root[s] = firsts[s]
            while front:
                for x in near[front.pop()]:
                    if x not in root:
                        root[x] = firsts[s]
                        front.append(x)
    return {d: (root[s], firsts[s], len(near[s])) if s else (d, d, 0) for d, s in sets.items()}


def corpus(seed, groups=12, dense=0, words=90):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(40)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(words)] + passage * (g % 2)
        for _ in range(rnd.randint(1, 5)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = word()
            rows.append(" ".join(w))
    base = [word() for _ in range(words)]
    for _ in range(dense):
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, "other", 1) for d, t in rows], "doc_id long, text string, c string, node int")
    return {r.doc_id: (r.class_id, r.set_id, r.n_links) for r in J.jaccard_join(docs, **more).collect()}


def test_equals_brute_force(spark):
    rows = corpus(1) + [(900, None), (901, ""), (902, "..."), (903, "two words"), (904, "Two words"), (905, "two")]
    assert run(spark, rows) == brute(rows)


def test_dense_group_and_deep_splits(spark):
    rows = corpus(2, groups=30, dense=60)
    assert run(spark, rows, leaf_rows=8, block_rows=16, levels=4) == brute(rows)


def test_empty_repeated_and_null(spark):
    assert run(spark, []) == {}
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    rows = J.jaccard_join(docs).collect()
    assert len(rows) == 4 and sorted(r.class_id for r in rows if r.class_id is not None) == [1, 1, 1]


def test_runs_reach_the_target():
    assert J.runs_needed(0.8, 2, 0.9) == 1
    assert J.runs_needed(0.8, 2, 0.9999) == 4
    assert J.runs_needed(0.8, 2, 0.99) == 2
    for threshold, branches in ((0.8, 2), (0.6, 2), (0.5, 4)):
        runs = J.runs_needed(threshold, branches, 0.9999)
        assert J.recall(threshold, branches, runs, 6) >= 0.9999 > J.recall(threshold, branches, runs - 1, 6)
    with pytest.raises(ValueError):
        J.runs_needed(0.3, 2, 0.9999)


def test_recall_of_simulated_paths():
    rng, s, runs, pool = np.random.default_rng(2), 0.6, 2, 6
    def meets(shared, depth):
        return depth == 0 or any(rng.random() < shared / pool and meets(shared, depth - 1) for _ in range(2))
    found = 0
    for _ in range(4000):
        shared = rng.binomial(pool, s)
        found += any(rng.random() < s and meets(shared, 2) for _ in range(2 * runs))
    assert abs(found / 4000 - J.recall(s, 2, runs, 3, pool)) < 0.03


def test_low_threshold_with_forced_deep_splits(spark):
    rows = corpus(5, groups=40, dense=40)
    want = brute(rows, 0.5)
    assert run(spark, rows, threshold=0.5, branches=4, leaf_rows=2, block_rows=8, levels=5) == want
    assert sum(n for _, _, n in want.values()) > 400


def test_a_split_is_made_once(spark, monkeypatch):
    made, plain = {}, J.written
    monkeypatch.setattr(J, "written", lambda df, name: made.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or plain(df, name))
    rows = corpus(5, groups=4, dense=60)
    assert run(spark, rows, threshold=0.5, leaf_rows=4, levels=3) == brute(rows, 0.5)
    assert "Generate explode" in made["split1"]
    assert not any("Generate" in plan for name, plan in made.items() if name in ("sizes1", "level1", "sizes2", "level2"))


def test_density_is_told_without_a_row_for_a_token(spark):
    """Buckets in which 9 of 10 and 1 of 20 members share the drawn token."""
    rows = [(1, 400, [7 if k % 10 else k] * 64) for k in range(400)] + [(2, 400, [7 if k % 20 == 0 else 10_000 + k] * 64) for k in range(400)]
    large = spark.createDataFrame(rows, "node long, size long, sig array<long>")
    found = J._dense(large, lambda k, salt: J.F.lit(k + 1), 2)
    assert [r.node for r in found.collect()] == [1] and "Generate" not in found._jdf.queryExecution().toString()


def test_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(1, long), (2, long + " end"), (3, "w1 w2 w3 w4 w5"), (4, long.replace("w7 ", "x "))]
    assert run(spark, rows) == brute(rows)


def test_long_components(spark):
    edges = spark.createDataFrame([(f"{k:04d}".encode(), f"{k + 1:04d}".encode()) for k in range(120)], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in J.components(edges).collect()}
    assert len(got) == 121 and set(got.values()) == {b"0000"}


def test_components_settle_however_many_rounds_it_takes(spark, monkeypatch):
    monkeypatch.setattr(J, "range", lambda n: iter((0, 1)), raising=False)  # a loop over a number of rounds ends after two
    edges = spark.createDataFrame([(f"{k:04d}".encode(), f"{k + 1:04d}".encode()) for k in range(40)], "a binary, b binary")
    got = [(bytes(r.node), bytes(r.root)) for r in J.components(edges).collect()]
    assert len(got) == len(dict(got)) == 41 and set(dict(got).values()) == {b"0000"}


def test_shingles():
    assert len(shingle_set("a b c d e f")) == 2
    assert np.array_equal(shingle_set("A  b, c d e"), shingle_set("a b c d e"))


def test_small_buckets_of_large_sets_are_split(spark, monkeypatch):
    """Near copies in few members, of more tokens than a block may hold."""
    rows = corpus(21, groups=6, dense=30)
    monkeypatch.setattr(J, "BLOCK_TOKENS", 700)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.set_id, r.n_links) for r in J.jaccard_join(df, leaf_rows=256).collect()}
    assert got == brute(rows)


def test_large_sets_take_bounded_memory():
    """A bucket of 20 million tokens, matched in ranges of their values."""
    import resource

    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 64, 200_000, np.uint64))
    bucket = J._Bucket((0, 0, 0))
    for k in range(100):
        keep = rng.random(len(base)) > 0.02 * (k % 8)
        bucket.names.append(bytes([k]))
        bucket.blocks.append(0)
        bucket.paths.append([0])
        bucket.sets.append(base[keep])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = bucket.links(0.8)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 250_000
    some = rng.integers(0, 100, (60, 2))
    for a, b in some.tolist():
        shared = len(np.intersect1d(bucket.sets[a], bucket.sets[b]))
        assert got[a, b] == (a != b and shared >= 0.8 * (len(bucket.sets[a]) + len(bucket.sets[b]) - shared))


@pytest.mark.parametrize("many", [4, 20_000])
def test_the_centre_of_a_large_component_is_no_key(spark, many):
    name = lambda k: k.to_bytes(4, "big")
    edges = [(name(0), name(k)) for k in range(1, 2000)] + [(name(k), name(k + 1)) for k in range(5000, 5200)] + [(name(1999), name(6000))]
    found = {r.node: r.root for r in J.components(spark.createDataFrame(edges, "a binary, b binary"), many).collect()}
    assert len(found) == 2000 + 201 + 1
    assert all(bytes(root) == name(0 if int.from_bytes(node, "big") in {*range(2000), 6000} else 5000) for node, root in found.items())


def test_stars_take_no_round(spark, monkeypatch):
    made, plain = [], J.written
    monkeypatch.setattr(J, "written", lambda df, name: made.append(name) or plain(df, name))
    edges = spark.createDataFrame([(b"1", b"0"), (b"2", b"0"), (b"4", b"3"), (b"2", b"0")], "a binary, b binary")
    got = {(bytes(r.node), bytes(r.root)) for r in J.components(edges).collect()}
    assert got == {(b"0", b"0"), (b"1", b"0"), (b"2", b"0"), (b"3", b"3"), (b"4", b"3")} and made == ["edges", "low"]
    assert J.components(edges.limit(0)).collect() == []


@pytest.mark.parametrize("many", [2, 20_000])
def test_names_of_classes(spark, many):
    """A root of most rows, roots of two, roots without any id and rows without a root."""
    rows = [(b"c%d" % k, k + 7, b"hub") for k in range(50)] + [(b"d%d" % k, 100 + k if k % 3 else None, b"r%d" % (k // 2)) for k in range(40)]
    rows += [(b"e", 5, None), (b"f", None, None), (b"g", None, b"x"), (b"h", None, b"x")]
    told = spark.createDataFrame(rows, "c binary, set_id long, root binary")
    least = {}
    for _, s, root in rows:
        least[root] = min((x for x in (least.get(root), s) if x is not None), default=None)
    found = J.class_names(told, many)
    got = sorted(((bytes(r.c), r.class_id) for r in found.collect()), key=str)
    assert got == sorted(((c, None if root is None else least[root]) for c, _, root in rows), key=str)
