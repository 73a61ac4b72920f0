"""Packed tiles, products of them, and moments that merge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.errors import NanError
from gridspark.operators import linalg, moments
from gridspark.plans import storage, tiles
from gridspark.sources import tensors as T


def test_packed_tiles_hold_the_matrix(spark):
    x = np.random.default_rng(1).normal(size=(3, 13, 9))
    t = T.from_values(spark, x)
    made = tiles.packed(t.df.repartition(5), ["i0"], F.col("i1"), F.col("i2"), F.col("v"), (13, 9), (5, 4))
    assert made.counts == (3, 3)
    got = np.zeros_like(x)
    for r in made.df.collect():
        high = tiles.edge(r.row, 5, 13)
        got[r.i0, 5 * r.row : 5 * r.row + high, 4 * r.col : 4 * r.col + 4] = tiles.as_block(bytes(r.block), high)
    assert np.array_equal(got, x)
    assert made.df.count() == 27


@pytest.mark.parametrize("sent", [0, 1 << 30])
def test_products_of_tiles(spark, monkeypatch, sent):
    """Broadcast and dealt to groups, of one inner tile and of several, with batch axes on either side."""
    rng = np.random.default_rng(2)
    for name, value in (("BLOCK_PRODUCTS", 0), ("TILE", 8), ("BLOCK_ELEMENTS", 64), ("BROADCAST_BYTES", sent), ("HELD_ELEMENTS", 100)):
        monkeypatch.setattr(linalg, name, value)
    for a, b in (((23, 40), (40, 17)), ((23, 5), (5, 31)), ((3, 9, 20), (20, 6)), ((9, 20), (2, 20, 6)), ((2, 1, 3, 11), (4, 11, 10)), ((70,), (70, 9))):
        x, y = rng.normal(size=a), rng.normal(size=b)
        assert np.allclose(linalg.matmul(T.from_values(spark, x), T.from_values(spark, y)).to_numpy(), x @ y)


def test_elements_are_shuffled_once(spark, monkeypatch):
    """The plan has one exchange of elements a side; what else moves are tiles."""
    monkeypatch.setattr(linalg, "BLOCK_PRODUCTS", 0)
    x = T.from_values(spark, np.ones((50, 40)))
    y = T.from_values(spark, np.ones((40, 60)))
    plan = linalg.matmul(x, y).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FlatMapGroupsInArrow") == 2 and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("scattered", [False, True])
def test_covariances_of_many_events(spark, monkeypatch, scattered):
    """Samples that come whole, and samples whose elements lie in different tasks, over two levels and over three."""
    rng = np.random.default_rng(3)
    x = 1e6 + rng.normal(size=(2, 300, 20)) @ rng.normal(size=(20, 20))
    want = np.stack([np.cov(m.T) for m in x])
    t = T.from_values(spark, x)
    if scattered:
        t = t.with_df(t.df.repartition(7, "i2"))
    for pending in (1 << 20, 500, 100):
        monkeypatch.setattr(moments, "PENDING", pending)
        assert np.allclose(linalg.cov(t, ddof=1).to_numpy(), want, rtol=1e-7, atol=1e-6)


def test_whole_samples_stay_where_they_are(spark):
    """One pass over the input and no join; a task that has samples whole hands on one row."""
    t = T.from_array_column(spark.range(4000).select("id", F.expr("transform(sequence(1, 20), k -> id * k % 17 + k) AS x")), "id", "x", 4000, 20)
    plan = linalg.cov(t).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Range (") == 1 and "Join" not in plan
    rows = np.array(t.df.collect())
    own = moments.Gathered(20)
    own.add(np.column_stack([np.zeros(len(rows)), rows[:, 0], rows[:, 1]]).astype(np.int64), rows[:, 2])
    assert own.moments[0][0] == 4000 and not list(own.rest(1)) and sum(b.num_rows for b in own.told(0)) == 1


def test_wider_than_a_gram_matrix(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(30, 24))
    monkeypatch.setattr(linalg, "GRAM_EVENTS", 20)
    assert np.allclose(linalg.cov(T.from_values(spark, x)).to_numpy(), np.cov(x.T, ddof=0))


def test_nan_is_told(spark):
    x = np.ones((5, 20))
    x[2, 3] = np.nan
    with pytest.raises(NanError):
        linalg.cov(T.from_values(spark, x)).rows()


def test_large_sides_meet_without_copies(spark, monkeypatch):
    """F1 matmul_outer: no exchange of tiles, tiles of float32 stay as narrow, and one exchange of parts of tiles a side."""
    for name, value in (("BLOCK_PRODUCTS", 0), ("TILE", 16), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(linalg, name, value)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # Spark may broadcast tables that are as small as these
    tables = []
    monkeypatch.setattr(linalg, "stored", lambda df, name: tables.append(df) or storage.stored(df, name))
    rng = np.random.default_rng(5)
    for a, b in (((90, 7), (7, 75)), ((3, 9, 5), (5, 6)), ((9, 5), (2, 5, 6)), ((3, 1, 4, 5), (2, 5, 6))):
        x, y = rng.normal(size=a).astype(np.float32).astype(float), rng.normal(size=b)
        made = linalg.matmul(T.from_values(spark, x), T.from_values(spark, y))
        plan = made.df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        assert np.allclose(made.to_numpy(), x @ y)
        left, right = tables[-2:]
        places = int(np.prod(x.shape)), int(np.prod(y.shape))
        assert [t.agg(F.sum(F.length(t.columns[-1]))).first()[0] for t in (left, right)] == [4 * places[0], 8 * places[1]]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_parts_of_tiles_from_scattered_elements(spark, monkeypatch):
    """Whatever the order of elements and however few a task gathers, each is in its place, and values keep all their bits."""
    x = np.random.default_rng(6).normal(size=(4, 30, 21))
    x[0] = np.arange(630).reshape(30, 21) - 300
    x[1, 2:4] = [[1e300], [-0.0]]
    x[2, 0, 0] = np.nan
    rows = [(*(int(k) for k in at), float(v)) for at, v in np.ndenumerate(x)]
    df = spark.createDataFrame([rows[k] for k in np.random.default_rng(7).permutation(len(rows))], "b long, r long, c long, v double").repartition(3)
    for gathered in (1, 100, 1 << 19):
        monkeypatch.setattr(tiles, "GATHERED", gathered)
        for narrow in (False, True):
            made = tiles.packed(df, ["b"], F.col("r"), F.col("c"), F.col("v"), (30, 21), (8, 5), narrow, 4)
            got = np.zeros_like(x)
            for r in made.df.collect():
                high, wide = tiles.edge(r.row, 8, 30), tiles.edge(r.col, 5, 21)
                assert len(r.block) == high * wide * (4 if narrow and r.b == 0 else len(r.block) // (high * wide))
                got[r.b, 8 * r.row : 8 * r.row + high, 5 * r.col : 5 * r.col + wide] = tiles.as_block(bytes(r.block), high, wide)
            assert np.array_equal(got.view(np.int64), x.view(np.int64))
