import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm import toxicity as X


@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 12))
@settings(max_examples=80, deadline=None)
def test_neighbours_equal_full_scoring(seed, block, k):
    rng = np.random.default_rng(seed)
    terms, n = 12, int(rng.integers(0, 40))
    idf = rng.uniform(0.5, 3, terms)
    def vector():
        t = np.sort(rng.choice(terms, rng.integers(0, 6), replace=False)).astype(np.int64)
        return t, X.weighed(t, rng.integers(1, 4, len(t)).astype(float), idf)
    vectors = [vector() for _ in range(n)]
    index = X.BlockMaxIndex(vectors, terms, block)
    dense = np.zeros((n, terms))
    for row, (t, w) in zip(dense, vectors):
        row[t] = w
    t, w = vector()
    other = vector()
    found = index.nearest([other, (t, w), other], k)
    ids, scores = found[1]
    assert np.array_equal(found[0][0], found[2][0])
    full = dense[:, t] @ w if n else np.empty(0)
    want = [i for i in np.lexsort((np.arange(n), -np.round(full, 12))) if full[i] > 0][:k]
    assert ids.tolist() == want and np.allclose(scores, full[want])


def corpus(spark, n=400):
    rows, labels = [], []
    for d in range(n):
        bad = d % 4 == 0
        words = [f"w{(d * 7 + k * k) % 90}" for k in range(30)] + (["vile", "rotten"][: 1 + d % 2] if bad else [])
        rows.append((d, " ".join(words), "en", f"s{d}", 0.5))
        if d % 3:
            labels.append((d, 1, int(bad)))
    rows += [(9001, None, "en", "s", 0.5), (9002, "", "en", "s", 0.5), (9003, "vile " * 20_000, "en", "s", 0.5), (9004, "unseen words", "en", "s", 0.5), (5, rows[5][1], "en", "s", 0.5)]
    labels += [(1, 1, None), (None, 1, 1), (77_777, 1, 1), (5, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_and_odd_texts(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in X.toxicity(docs, labels).collect()}
    assert len(got) == 404 and X.toxicity(docs, labels).count() == 405
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [r for d, r in got.items() if r.held_out and d < 400]
    assert held and all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert [got[d].predicted for d in (9001, 9002, 9003, 9004)] == [0, 0, 1, 0]
    assert got[9003].evidence and all(e.doc_id % 4 == 0 for e in got[9003].evidence)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = corpus(spark)
    out = X.held_out(X.F.col("doc_id"), 5, 0)
    flipped = labels.withColumn("toxic", X.F.when(out, 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    score = lambda l: {r.doc_id: r.score for r in X.toxicity(docs, l).collect()}
    assert score(labels) == score(flipped)


def test_without_labels_or_documents(spark):
    docs, labels = corpus(spark, 20)
    assert {r.predicted for r in X.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert X.toxicity(docs.limit(0), labels).count() == 0
    model = X.fit(docs, labels)
    assert X.score(docs, model).columns == [*docs.columns, "_toxicity"]


def test_rare_labels_do_not_switch_the_operator_off(spark):
    """Toxic rows at 0.4 %, and calibration of 64 rows a class: a draw in the natural mix would hold none or one of them."""
    rows = [(d, " ".join(f"w{(d * 7 + k * k) % 90}" for k in range(20)) + (" vile rotten foul" if d % 250 == 0 else "")) for d in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    without = [(d, 1, 0) for d in range(50_000, 80_000)]  # labels without a document
    labels = spark.createDataFrame([(d, 1, int(d % 250 == 0)) for d, _ in rows] + without, "doc_id long, quality int, toxic int")
    model = X.fit(docs, labels, examples=64, calibration=64)
    got = {r.doc_id: r._toxicity.predicted for r in X.score(docs, model).collect()}
    assert {d for d, p in got.items() if p} == {d for d in got if d % 250 == 0}


def test_few_labels_fall_back_to_the_vote(spark):
    docs, _ = corpus(spark)
    for toxic in (0, 4):
        labels = spark.createDataFrame([(d, int(d == toxic)) for d in range(40)], "doc_id long, toxic int")
        model = X.fit(docs, labels)
        assert (model.slope, model.offset) == X.FALLBACK and (model.labels == 1).sum() == 1
        assert model.probability(0.5) == 0.5 and model.probability(0.9) > 0.9


def test_weighted_logistic_fit():
    rng = np.random.default_rng(3)
    for share in (0.3, 1e-2, 1e-5):
        y = np.repeat([0.0, 1.0], 500)
        weight = np.where(y == 1, share, 1 - share) * 2000 / share
        x = np.clip(rng.normal(0.15 + 0.6 * y, 0.05), 0, 1)
        slope, offset = X.logistic(x, y, weight)
        assert ((slope * x + offset > 0) == (y == 1)).mean() > 0.97
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        assert abs((weight * p).sum() / (weight * y).sum() - 1) < 1e-2
    slope, offset = X.logistic(rng.uniform(size=1000), y, np.ones(1000))
    assert np.isfinite(slope) and abs(1 / (1 + np.exp(-(slope * 0.5 + offset))) - 0.5) < 0.1


def test_copies_of_examples_with_rare_wording_are_found(spark):
    """No two toxic examples share a toxic word; copies of them, not labelled, are still nearest to them."""
    def text(d):
        prose = np.random.default_rng(d).choice(300, 20, replace=False)
        return " ".join(f"w{k}" for k in prose) + (f" q{d}x q{d}y" if d % 4 == 0 else "")
    rows = [(d, text(d)) for d in range(400)] + [(1000 + d, text(d)) for d in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d % 4 == 0)) for d in range(400)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    got = {r.doc_id: r._toxicity for r in X.score(docs, model).collect()}
    for d in model.ids.tolist():
        assert got[1000 + d].evidence[0].doc_id == d and got[1000 + d].evidence[0].cosine > 1 - 1e-9
        assert (next(model.votes([text(d)]))[0] > 0.5) == (d % 4 == 0)


def test_evidence_does_not_delete_terms():
    a, b = np.array([1.0, 0, 30, 10, 0]), np.array([0, 1.0, 0, 10, 40])
    for n in (40, 4000):
        e = X.evidence(a, b, n, n)
        assert e.min() >= 0.04 and e.argmin() == 3 and e[2] > e[0] and np.allclose(e, X.evidence(b, a, n, n))
    assert np.allclose(X.evidence(a, b, 0, 40), 0.04)


def test_scores_equal_brute_force(spark):
    """Terms, document frequencies, evidence, neighbours, vote and calibration, all in plain Python over dense vectors."""
    import math
    from collections import Counter

    docs, labels = corpus(spark, 300)
    got = {r.doc_id: r.score for r in X.toxicity(docs, labels).collect() if r.doc_id != 5}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    known = {}
    for r in labels.collect():
        if r.toxic is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in dict(texts):
            known[r.doc_id] = max(known.get(r.doc_id, 0), r.toxic)
    hashes = spark.createDataFrame([(d,) for d in known], "doc_id long").select("doc_id", X.F.expr("pmod(xxhash64(doc_id, 11), 5) = 0").alias("apart")).collect()
    apart = {r.doc_id: r.apart for r in hashes}
    index = sorted(d for d in known if not apart[d])
    features = {d: Counter(X.features(t)) for d, t in texts}
    terms = sorted({t for d in index for t in features[d]})
    n = [sum(known[d] == y for d in index) for y in (0, 1)]
    idf = {}
    for t in terms:
        a, b = (sum(t in features[d] for d in index if known[d] == y) for y in (1, 0))
        r1, r0 = a / n[1], b / n[0]
        telling = 0.01 + (abs(r1 - r0) / (r1 + r0) * (a + b) / (a + b + 4)) ** 2
        df = sum(t in set(X.features(x)) for _, x in texts)
        idf[t] = (math.log((1 + len(texts)) / (1 + df)) + 1) * telling
    def vector(d):
        v = np.array([(1 + math.log(features[d][t])) * idf[t] if features[d][t] else 0.0 for t in terms])
        return v / (np.linalg.norm(v) or 1)
    matrix = np.array([vector(d) for d in index])
    def vote(d):
        cosine = matrix @ vector(d)
        near = [k for k in np.lexsort((np.arange(len(index)), -np.round(cosine, 12))) if cosine[k] > 0][:15]
        w = cosine[near] ** 2 / (0.05 + np.maximum(0, 1 - cosine[near]))
        return float((w * [known[index[k]] for k in near]).sum() / (1 + w.sum()))
    held = sorted(d for d in known if apart[d])
    y = np.array([known[d] for d in held], float)
    total = [sum(v == k for v in known.values()) for k in (0, 1)]
    slope, offset = X.logistic(np.array([vote(d) for d in held]), y, np.array([total[int(v)] / (y == v).sum() for v in y]))
    for d, s in got.items():
        assert abs(s - 1 / (1 + math.exp(-(slope * vote(d) + offset)))) < 1e-6, d


def test_repeated_ids_with_other_texts_give_one_model(spark):
    """Rows in another order and partitioning: the same scores."""
    words = "red blue green sour kind vile rude calm warm cold".split()
    rows = [(k, " ".join(words[(k * j + j) % 10] for j in range(1, 9)) + (" vile rude" if k % 3 == 0 else "") + extra) for k in range(90) for extra in ("", " once more")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)], "doc_id long, toxic int")
    scores = []
    for order, parts in ((rows, 2), (rows[::-1], 7)):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        scores.append(sorted((r.text, r["_toxicity"]["score"]) for r in X.score(docs, X.fit(docs, labels)).collect()))
    assert scores[0] == scores[1]


def test_fit_leaves_nothing_sent(spark, monkeypatch):
    """The driver and its block store keep no copy of the terms or the model once they are fitted."""
    sent, plain = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(plain(value)) or sent[-1])
    docs, labels = corpus(spark, 60)
    model = X.fit(docs, labels)
    assert len(sent) == 2 and not any(b._jbroadcast.isValid() for b in sent)
    assert all("_value" not in vars(b) for b in sent) and 0 <= next(model.votes(["any"]))[0] < 1
