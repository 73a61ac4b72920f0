"""run() against a plain version of every stage, each on what the stage before it kept."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import decontaminate, toxicity
from gridspark.llm.common import written
from tests.llm.test_decontaminate import brute as occurs
from tests.llm.test_exact_dedup import digest
from tests.llm.test_jaccard_join import brute as near

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, path):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    items = [" ".join(word() for _ in range(20)) for _ in range(3)]
    texts = []
    for k in range(120):
        base = [word() for _ in range(70)]
        texts.append(" ".join(base))
        if k % 6 == 0:
            texts.append(" ".join(base) + " \n")  # an exact copy
        if k % 5 == 0:
            base[30] = word()
            texts.append(" ".join(base))  # a near copy
        if k % 8 == 0:
            texts.append(" ".join(base[:20]) + " " + items[k % 3] + " " + " ".join(word() for _ in range(20)))
        if k % 3 == 0:
            texts.append(" ".join(word() for _ in range(40)) + " vile rotten nasty")
    texts += [None, "", "  ", "one two"]
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], COLUMNS)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, int("vile" in (t or ""))) for k, t in enumerate(texts) if k % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return dict(enumerate(texts)), items


def test_run_equals_brute_force(spark, tmp_path):
    texts, items = fixture(spark, tmp_path)
    docs = {d: t for d, t in texts.items() if "vile" not in (t or "")}
    first = {}
    for d, t in sorted(docs.items()):
        first.setdefault(digest(t), d)
    docs = {d: t for d, t in docs.items() if d in first.values()}
    classes = near(list(docs.items()))
    docs = {d: t for d, t in docs.items() if classes[d][0] == d}
    docs = {d: t for d, t in docs.items() if all(occurs(t, i, 8, 80, 8, 0.1) is None for i in items)}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(docs) < len(texts) - 60
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_stages_keep_the_columns(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[2] == "n-gram Jaccard join"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_helpers_are_the_operators():
    assert corpus_pipeline.STAGES[0][1] is toxicity.stage and corpus_pipeline.STAGES[3][1] is decontaminate.stage


@pytest.mark.parametrize("number", range(4))
def test_stages_return_clashing_columns_unchanged(spark, tmp_path, number):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(60)
    clashing = ["_id", "_digest_hash", "_toxicity", "_told", "id", "digest_hash", "lost_id", "told", "toxicity", "gone", "c", "node", "kept", "Size", "row", "first"]
    for name in clashing:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    docs = written(docs.unionByName(docs.where("doc_id < 3")), "clashing")
    kept = corpus_pipeline.STAGES[number][1](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    given = {r.doc_id: r for r in docs.collect()}
    rows = kept.collect()
    assert rows and all(given[r.doc_id] == r for r in rows)
