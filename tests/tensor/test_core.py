import math

import numpy as np
import pytest

from gridspark.errors import BoundsError, ComputationError, NanError, NonFiniteError, ValidationError
from gridspark.frame import EMPTY, UINT64
from gridspark.operators import elementwise as E
from gridspark.operators import order, reduce
from gridspark.operators import structure as S
from gridspark.sources import tensors as T


@pytest.fixture
def t(spark):
    return lambda values, shape=None, dtype="float", **kw: T.from_values(spark, values, shape, dtype, **kw)


def same(frame, want, tol=1e-9):
    got = frame.to_numpy()
    want = np.asarray(want, got.dtype if got.dtype == object else float)
    assert got.shape == want.shape == frame.shape
    assert np.array_equal(got, want) if got.dtype == object else np.allclose(got, want, rtol=tol, atol=tol, equal_nan=True)


def test_arithmetic_broadcasts(t):
    a, b = np.arange(6.0).reshape(2, 3), np.array([[10.0], [20.0]])
    for op, want in ((E.add, a + b), (E.sub, a - b), (E.mul, a * b), (E.div, a / b)):
        same(op(t(a), t(b)), want)
        same(op(t(a), t([4.0])), {E.add: a + 4, E.sub: a - 4, E.mul: a * 4, E.div: a / 4}[op])
    same(E.add(t([[1.0], [2.0]]), t([[1.0, 2.0, 3.0]])), [[2, 3, 4], [3, 4, 5]])
    with pytest.raises(ValidationError):
        E.add(t([1.0, 2.0]), t([1.0, 2.0, 3.0]))
    with pytest.raises(ValidationError):
        E.add(EMPTY, t([1.0]))


def test_scalars_are_literals(spark, t):
    two = T.scalar(spark, 2.0)
    out = E.mul(t([[1.0, 2.0]]), two)
    same(out, [[2, 4]])
    assert "Join" not in out.df._jdf.queryExecution().toString()
    same(E.add(two, two), [4.0])


def test_value_errors(t):
    for bad, kind in ((math.nan, NanError), (math.inf, NonFiniteError)):
        for op in (E.add, E.mul, E.sub, E.div):
            with pytest.raises(kind):
                op(t([1.0, bad]), t([1.0, 1.0])).rows()
    with pytest.raises(ComputationError):
        E.div(t([1.0, 2.0]), t([1.0, 0.0])).rows()
    with pytest.raises(NanError):
        E.div(t([math.nan]), t([0.0])).rows()
    with pytest.raises(NonFiniteError):
        E.sqrt(t([-1.0])).rows()
    with pytest.raises(NonFiniteError):
        E.log(t([0.0])).rows()
    with pytest.raises(NonFiniteError):
        E.exp(t([89.0])).rows()
    with pytest.raises(NonFiniteError):
        E.factorial(t([35.0])).rows()
    with pytest.raises(ValidationError):
        E.factorial(t([2.5])).rows()
    with pytest.raises(NonFiniteError):
        E.relu(t([math.inf])).rows()
    same(E.relu(t([-math.inf, -1.0, 3.0])), [0, 0, 3])


def test_functions(t):
    same(E.sqrt(t([4.0, 2.0])), [2, math.sqrt(2)])
    same(E.exp(t([0.0, 1.0])), [1, math.e])
    same(E.log(t([1.0, 5.0])), [0, math.log(5)])
    same(E.power(t([2.0, 4.0]), t([-1.0, 0.5])), [0.5, 2])
    same(E.factorial(t([0.0, 5.0, 20.0])), [1, 120, math.factorial(20)])
    out = E.neg(t([0.0, 1.0, math.inf])).to_numpy()
    assert math.copysign(1, out[0]) == -1 and out[2] == -math.inf
    assert E.equal(t([1.0, 2.0]), t([1.0, 2.0])) and not E.equal(t([1.0, math.nan]), t([1.0, math.nan]))
    assert E.equal(EMPTY, EMPTY) and not E.equal(t([1.0]), EMPTY)


def test_unsigned(t):
    m = 1 << 64
    a, b = [m - 1, 5, 0, 1 << 40], [2, 7, 1, (1 << 33) + 3]
    u = lambda x: t(x, dtype=UINT64)
    same(E.add(u(a), u(b)), [(x + y) % m for x, y in zip(a, b)])
    same(E.sub(u(a), u(b)), [(x - y) % m for x, y in zip(a, b)])
    same(E.mul(u(a), u(b)), [x * y % m for x, y in zip(a, b)])
    same(E.div(u(a), u(b)), [x // y for x, y in zip(a, b)])
    same(E.neg(u(a)), [-x % m for x in a])
    same(E.power(u([3, 2, 0]), u([41, 64, 0])), [pow(3, 41, m), 0, 1])
    same(E.factorial(u([3, 21, 70])), [6, math.factorial(21) % m, 0])
    same(reduce.sum(u(a)), [sum(a) % m])
    same(reduce.cumsum(u([m - 1, 2, 3])), [m - 1, 1, 4])
    with pytest.raises(ComputationError):
        E.div(u([1]), u([0])).rows()


def test_views(spark, t):
    a = t(np.arange(1.0, 13).reshape(3, 4))
    v = a.view((1, 1), (2, 2))
    same(v, [[6, 7], [10, 11]])
    assert v.to_string() == "[[6, 7],\n [10, 11]]\n" and v.is_view and not v.owns_data
    same(a.view((2, 1), (3,)), [10, 11, 12])
    same(a[1], [5, 6, 7, 8])
    same(a[1][2], [7])
    same(a.at(6), [7])
    with pytest.raises(BoundsError):
        a[3]
    with pytest.raises(BoundsError):
        a.view((2, 2), (2, 2))
    with pytest.raises(ValidationError):
        a.view((0,), (1,))
    b = t(np.arange(100.0).reshape(5, 20))
    assert b.alias_view((0, 0), (3, 4), (13, 4)).to_string() == "[[0, 4, 8, 12],\n [13, 17, 21, 25],\n [26, 30, 34, 38]]\n"
    same(t([42.0, 99.0]).alias_view((1,), (4,), (0,)), [99] * 4)
    with pytest.raises(BoundsError):
        b.alias_view((4, 19), (2,), (1,))
    same(S.with_view_assigned(a, (1, 1), t([[0.0, 1.0], [2.0, 3.0]])), [[1, 2, 3, 4], [5, 0, 1, 8], [9, 2, 3, 12]])
    assert list(a.view((0, 0), (1, 4))) == [1, 2, 3, 4]
    assert a.index_to_coords(6) == (1, 2) and a.coords_to_index((1, 2)) == 6
    assert a.shape_string() == "[3, 4]\n" and EMPTY.to_string() == "[]\n"
    assert a.strides == (4, 1) and a.total_bytes == 48 and EMPTY.num_elements == 0


def test_structure(t):
    a = np.arange(24.0).reshape(2, 3, 4)
    same(S.reshape(t(a), (4, 6)), a.reshape(4, 6))
    same(S.transpose(t(a)), a.transpose())
    same(S.transpose(t(a), (1, -1, 0)), a.transpose(1, 2, 0))
    same(S.pad(t(a), 1, 0, 2, 1, 9.0), np.pad(a, ((0, 0), (1, 0), (2, 1)), constant_values=9))
    same(S.pad_symmetric(t(a), 1, 2), np.pad(a, ((0, 0), (1, 1), (2, 2))))
    near = a.repeat(3, 1).repeat(3, 2)[:, :7, :10]
    same(S.upsample(t(a), 3, S.UpsampleMode.NEAREST), near)
    zero = np.zeros((2, 5, 7))
    zero[:, ::2, ::2] = a
    same(S.upsample(t(a), 2), zero)
    same(S.copy_from(t(a), t([[1.0, 2.0, 3.0, 4.0]])), np.broadcast_to([1.0, 2, 3, 4], a.shape))
    x = t([[1.0, 3, 2], [15, 7, 6]])
    same(S.gather(x, order.argsort(x, -1), -1), [[1, 2, 3], [6, 7, 15]])
    same(S.gather(x, order.argsort(x, None, True)), [[15, 7, 6], [3, 2, 1]])
    for bad in (lambda: S.reshape(t(a), (5, 5)), lambda: S.upsample(t(a), 0), lambda: S.pad(t([1.0]), 1, 1, 1, 1), lambda: S.transpose(t(a), (0, 1))):
        with pytest.raises(ValidationError):
            bad()
    with pytest.raises(BoundsError):
        S.transpose(t(a), (0, 0, 1))
    with pytest.raises(BoundsError):
        S.gather(x, t([[7, 0, 0]], dtype=UINT64), 1).rows()


def test_reductions(spark, t):
    a = np.random.default_rng(0).normal(size=(2, 3, 4))
    for axis in (None, 0, 1, -1):
        keep = dict(axis=axis, keepdims=True) if axis is not None else {}
        shaped = lambda x: x if axis is not None else [x]
        same(reduce.sum(t(a), axis), shaped(a.sum(**keep)))
        same(reduce.mean(t(a), axis), shaped(a.mean(**keep)))
        same(reduce.var(t(a), axis), shaped(a.var(**keep)))
        same(reduce.stddev(t(a), axis, 1), shaped(a.std(ddof=1, **keep)))
        arg = a.argmax(axis=axis, keepdims=True) if axis is not None else [a.argmax()]
        same(reduce.argmax(t(a), axis), arg)
        same(reduce.cumsum(t(a), axis), a.cumsum(axis))
    same(reduce.sum(EMPTY, spark=spark), [0])
    same(reduce.argmax(t([1.0, math.inf, math.inf, -math.inf])), [1])
    for f, bad, kind in ((reduce.sum, math.nan, NanError), (reduce.sum, math.inf, NonFiniteError), (reduce.argmax, math.nan, NanError)):
        with pytest.raises(kind):
            f(t([1.0, bad])).rows()
    with pytest.raises(BoundsError):
        reduce.sum(t(a), 3)
    with pytest.raises(ValidationError):
        reduce.var(t([1.0]), None, 1)


def test_order(t):
    nan, inf = math.nan, math.inf
    same(order.sort(t([3.0, nan, 1, -2, nan])), [-2, 1, 3, nan, nan])
    same(order.sort(t([inf, -1.0, -inf, 5, 0])), [-inf, -1, 0, 5, inf])
    a = np.random.default_rng(1).normal(size=(3, 4))
    same(order.sort(t(a), 0), np.sort(a, 0))
    same(order.sort(t(a)), np.sort(a, None).reshape(3, 4))
    same(order.argsort(t(a), 1), a.argsort(1))
    same(order.argsort(t([2.0, 1, 2, 1, 2])), [1, 3, 0, 2, 4])
    same(order.argsort(t([2.0, 1, 2, 1, 2]), 0, True), [0, 2, 4, 1, 3])
    same(order.argsort(t([1.0, nan, 0, 2]), None, True), [3, 0, 2, 1])


def test_ranks_by_range_exchange_equal_plain_ones(spark, monkeypatch):
    from gridspark.plans import scan

    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=997), 1)
    v[::97] = np.nan
    x = T.from_values(spark, v)
    want = np.argsort(np.where(np.isnan(v), np.inf, v), kind="stable")
    monkeypatch.setattr(scan.ranked, "__defaults__", (20, 100))
    same(order.argsort(x), want)
    falling = np.argsort(np.where(np.isnan(v), np.inf, -v), kind="stable")
    same(order.argsort(x, None, True), falling)
    same(order.sort(x), np.sort(v))
    big = [(1 << 64) - 1 - k % 50 for k in range(300)]  # beyond what a double tells apart
    same(order.sort(T.from_values(spark, big, dtype="uint64")), sorted(big))


def test_running_sums_of_three_levels(spark, monkeypatch):
    from gridspark.plans import scan

    monkeypatch.setattr(scan.running_sum, "__defaults__", (7,))
    whole = np.arange(1.0, 301)
    same(reduce.cumsum(T.from_values(spark, whole)), whole.cumsum())
    x = np.random.default_rng(3).normal(size=(3, 120))
    same(reduce.cumsum(T.from_values(spark, x), 1), x.cumsum(1))
    high = [(1 << 64) - 1, 5, *range(80)]
    same(reduce.cumsum(T.from_values(spark, high, dtype="uint64")), [sum(high[: k + 1]) % (1 << 64) for k in range(len(high))])


@pytest.mark.parametrize("kind", ["equal", "half NaN", "mixed", "infinite"])
def test_ties_are_even_over_parts(spark, kind):
    from pyspark.sql import functions as F

    from gridspark.plans import scan

    rng = np.random.default_rng(4)
    n = 20_000
    v = {"equal": np.full(n, 3.0), "half NaN": np.where(np.arange(n) % 2, math.nan, np.arange(n) % 7), "mixed": np.where(rng.random(n) < 0.6, 5.0, rng.normal(size=n)), "infinite": np.where(rng.random(n) < 0.5, math.inf, -math.inf)}[kind]
    df = spark.createDataFrame(list(enumerate(v.tolist())), "k long, v double")
    by = [F.isnan("v"), F.col("v"), F.col("k")]
    got = scan.ranked(df, by, n, "at", few=100, part_rows=2000)
    rows = got.select("k", "at").toPandas().sort_values("at")
    assert rows["at"].tolist() == list(range(n)) and rows["k"].tolist() == np.argsort(np.where(np.isnan(v), np.inf if kind != "infinite" else 0, v), kind="stable").tolist()
    sizes = [r["count"] for r in df.repartitionByRange(10, *by).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 2 * 2000


@pytest.mark.parametrize("kind", ["equal", "apart", "ties and NaN"])
def test_long_axes_are_ranked_with_all_keys(spark, monkeypatch, kind):
    from gridspark.plans import scan

    rng = np.random.default_rng(6)
    a = {
        "equal": np.full((400, 3), 2.0),
        "apart": rng.normal(size=(400, 3)) + [0.0, 100.0, -50.0],
        "ties and NaN": np.where(rng.random((400, 3)) < 0.3, math.nan, rng.integers(0, 6, (400, 3))),
    }[kind]
    monkeypatch.setattr(scan.ranked_along, "__defaults__", (50,))
    monkeypatch.setattr(scan.ranked, "__defaults__", (20, 100))
    x = T.from_values(spark, a)
    for descending, key in ((False, a), (True, -a)):
        same(order.argsort(x, 0, descending), np.where(np.isnan(key), np.inf, key).argsort(0, kind="stable"))
    same(order.sort(x, 0), np.sort(a, 0))
    same(order.sort(S.transpose(x), 1), np.sort(a, 0).T)


@pytest.mark.parametrize("few", [256, 2])
def test_table_rows_by_file(spark, tmp_path, monkeypatch, few):
    """Several files of several row groups: dense numbers in the files' order, without a sort or a shuffle of rows."""
    rows = [(float(k), float(k * k % 11), "x") for k in range(1000)]
    spark.createDataFrame(rows, "a double, b double, _row string").repartition(4).write.option("parquet.block.size", 2048).parquet(str(tmp_path / "t"))
    monkeypatch.setattr(T, "FEW_FILES", few)
    table = spark.read.parquet(str(tmp_path / "t"))
    x = T.from_table(table, None, ["b", "a"])
    assert x.shape == (1000, 2)
    got = x.to_numpy()
    assert sorted(map(tuple, got.tolist())) == sorted((b, a) for a, b, _ in rows)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    want = [r["a"] for f in files for r in spark.read.parquet(str(f)).collect()]
    assert len(files) == 4 and got[:, 1].tolist() == want
    assert few == 2 or "Join" not in x.df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in (plan := x.df._jdf.queryExecution().executedPlan().toString()) and "Sort" not in plan


def test_positions_in_the_flat_order(t):
    x, other = t([[1.0, 2.0], [3.0, 4.0]]), t([5.0, 6.0])
    first, last = x.begin(), x.end()
    assert last - first == 4 and first + 4 == last and last - 4 == first and hash(first + 4) == hash(last)
    assert first < last and first <= first and last > first and last >= first + 2 and first != last
    assert not first == other.begin() and not first < other.end() and not first >= other.begin()
    assert (first + 2).value.item() == 3.0 and (last - 1).value.is_view
    moved = first
    moved += 1
    assert moved.value.item() == 2.0 and first.flat == 0
    assert EMPTY.begin() == EMPTY.end()
    for outside in (last, first - 1):
        with pytest.raises(BoundsError):
            outside.value


def test_graph_edge_remembers_its_result(spark):
    from gridspark.operators.autograd import AddEdge

    x = T.from_values(spark, [1.0])
    edge = AddEdge((x, x), x)
    assert edge.output is x and AddEdge((x, x)).output is None


def test_too_wide_a_table_is_an_error(spark):
    with pytest.raises(ValidationError):
        T.to_table(T.zeros(spark, (2, 1025)))


def test_moving_back_gives_the_cache_back(spark):
    here = T.arange(spark, 10.0).to("HOST")
    assert here.df.storageLevel.useMemory and not here.to("DEVICE").df.storageLevel.useMemory


def test_sources(spark):
    same(T.arange(spark, 0, 1, 0.2), [0, 0.2, 0.4, 0.6, 0.8])
    same(T.arange(spark, 5.0, 0.0), [0])
    same(T.arange(spark, 3), [0, 1, 2])
    for args, kind in (((0, 1, 0), ValidationError), ((0, math.nan), NonFiniteError)):
        with pytest.raises(kind):
            T.arange(spark, *args)
    one = lambda x: T.scalar(spark, x)
    same(T.linspace(one(0.0), one(1.0), 4, endpoint=False)[0], [0, 0.25, 0.5, 0.75])
    values, step = T.linspace(T.from_values(spark, [[0.0], [10.0]]), T.from_values(spark, [[3.0, 4.0, 5.0]]), 3, 2)
    want = np.stack([np.linspace(np.array([[0.0], [10]]), np.array([[3.0, 4, 5]]), 3)], 0)[0].transpose(1, 2, 0)
    same(values, want)
    same(step, (np.array([[3.0, 4, 5]]) - np.array([[0.0], [10]])) / 2)
    same(T.linspace(one(1.0), one(2.0), 0)[0], [0])
    same(T.linspace(one(1.0), one(2.0), 1)[1], [0])
    with pytest.raises(NanError):
        T.linspace(one(math.nan), one(1.0), 3)
    assert abs(T.integral(spark, lambda x: x * x, 0, 1, 4).item() - 1 / 3) < 1e-9
    assert abs(T.integral(spark, lambda x: __import__("pyspark").sql.functions.sin(x), 0, math.pi, 64).item() - 2) < 5e-6
    with pytest.raises(ValidationError):
        T.from_values(spark, [1.0, 2.0], (3,))
    with pytest.raises(ValidationError):
        T.zeros(spark, ())
    with pytest.raises(ValidationError):
        T.from_column(spark.createDataFrame([(0, 1.0), (1, None)], "k long, x double"), "k", "x", 2).rows()
    rows = [(2, 1.0, 5.0), (1, 2.0, 6.0), (1, 1.0, 7.0)]
    same(T.from_table(spark.createDataFrame(rows, "a int, b double, c double"), ["a", "b", "c"], ["b", "c"]), [[1, 7], [2, 6], [1, 5]])


def test_graph(t):
    a, b, c = (t([[1.0, 2.0]], requires_grad=True) for _ in range(3))
    y = E.add(E.add(a, b), c)
    assert y.requires_grad and y.source_function.name == "add" and y.source_function.inputs[1] is c
    assert y.source_function.inputs[0].source_function.inputs == (a, b)
    assert E.sub(a, b).source_function is None and a.view((0, 0), (1, 1)).requires_grad and a.clone().requires_grad
    assert y.gradient is None and y.source_function.forward() is None


def test_locations(t):
    a = t([1.0, 2.0])
    assert a.to("HOST").memory_location == "HOST" and a.to("DEVICE") is a
    with pytest.raises(ValidationError):
        a.view((0,), (1,)).to("HOST")
    with pytest.raises(ValidationError):
        EMPTY.to("HOST")
