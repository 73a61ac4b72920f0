import hashlib
import re

from pyspark.sql import functions as F

from gridspark.llm import exact_dedup as X


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(digest(t), []).append(d)
    return sorted((d, min(g), len(g), d == min(g), s) for d, s in ((d, digest(t)) for d, t in rows) for g in [groups[s]])


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, True) for d, t in rows], "doc_id long, text string, keep_id string, id int, kept boolean")


def run(df, **more):
    return sorted(tuple(r) for r in X.exact_dedup(df, **more).collect())


def test_equals_brute_force(spark):
    rows = [(9, "a  b"), (3, "a\tb"), (5, "a b"), (4, None), (7, ""), (1, " a b"), (2, "é"), (8, "é"), (6, "a\n\r b")]
    rows += [(100 + k, f"text {k % 7}") for k in range(60)] + [(500 + k, "x" * 200_000) for k in range(3)]
    assert run(frame(spark, rows)) == brute(rows)


def test_frequent_digests_never_shuffle(spark):
    rows = [(k, "hot") for k in range(3000)] + [(10_000 + k, f"cold {k // 2}") for k in range(500)]
    df = frame(spark, rows)
    assert run(df, share=4) == brute(rows)
    digests = df.select(F.col("doc_id").alias("id"), X.text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    winners = X.frequent(digests, 4, 64).collect()
    assert [(r["first"].id, r.group_size) for r in winners] == [(0, 3000)]


def test_many_hot_digests_are_all_split_off(spark):
    rows = [(k, f"hot {k % 400}") for k in range(8000)] + [(10_000 + k, f"cold {k}") for k in range(4000)]
    df = frame(spark, rows).repartition(16)
    digests = df.select(F.col("doc_id").alias("id"), X.text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    winners = X.frequent(digests).collect()
    assert sorted(r["first"].id for r in winners) == list(range(400)) and {r.group_size for r in winners} == {20}
    assert run(df) == brute(rows)


def test_a_hot_repeated_row_stays_once(spark):
    rows = [(1, "same")] * 2000 + [(None, "x")] * 2000 + [(2, "y")]
    got = X.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == 4001 and sorted((r.doc_id or 0, r.group_size) for r in got if r.kept) == [(0, 2000), (1, 2000), (2, 1)]


def test_null_ids_and_repeats(spark):
    got = X.exact_dedup(frame(spark, [(None, "a"), (2, "a"), (2, "a"), (None, "b")])).collect()
    assert sum(r.kept for r in got) == 2
    assert {r.keep_id for r in got if r.group_size == 3} == {2}
    assert X.exact_dedup(frame(spark, [])).count() == 0


def test_stage_keeps_one_of_repeated_rows(spark):
    df = frame(spark, [(2, "a"), (2, "a"), (3, "a "), (3, "a"), (4, "b"), (None, None), (None, "")])
    kept = X.stage(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (2, "a"), (3, "a "), (4, "b")]
