"""Registered queries over the given tables, each with the DuckDB SQL that gives the same rows.

Results are coordinates i0, i1, ... and the value v, rounded so that the order of floating sums does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.frame import UINT64, TensorFrame
from gridspark.functions import unsigned
from gridspark.operators import elementwise, linalg, ml, nn, order, reduce
from gridspark.operators import stats_chisquare as chi2
from gridspark.operators import stats_norm as norm
from gridspark.operators import structure
from gridspark.sources import tensors

Query = Callable[[SparkSession, str], DataFrame]
Rounding = Callable[[str, int], Column]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WIDTH = 64
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *FEATURES]

# -- inputs -----------------------------------------------------------------------------------------------------


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def emb(spark: SparkSession, d: str) -> TensorFrame:
    """{rows, 64}"""
    df = read(spark, d, "embeddings")
    return tensors.from_array_column(df, "vec_id", "embedding", df.count(), WIDTH)


def images(spark: SparkSession, d: str) -> TensorFrame:
    """{rows, 8, 8}"""
    e = emb(spark, d)
    return structure.reshape(e, (e.shape[0], 8, 8))


def values(spark: SparkSession, d: str, column=None) -> TensorFrame:
    """{events}"""
    df = read(spark, d, "events")
    return tensors.from_column(df, "event_id", "value" if column is None else column, df.count())


def lines(spark: SparkSession, d: str, columns: list[str]) -> TensorFrame:
    """{lineitems, columns}"""
    return tensors.from_table(read(spark, d, "lineitem"), LINE_ORDER, columns)


def any_lines(spark: SparkSession, d: str, columns: list[str]) -> TensorFrame:
    """{lineitems, columns}, in the files' order, for what does not depend on it"""
    return tensors.from_table(read(spark, d, "lineitem"), None, columns)


def degrees(spark: SparkSession, d: str) -> TensorFrame:
    """{events}: 1 to 7 degrees of freedom"""
    return values(spark, d, F.col("event_id") % 7 + 1)


def shares(spark: SparkSession, d: str) -> TensorFrame:
    """{events}: probabilities inside (0, 1)"""
    n = read(spark, d, "events").count()
    return values(spark, d, (F.col("event_id") + 0.5) / F.lit(float(n)))


EMB = "SELECT vec_id AS i0, (k - 1)::BIGINT AS i1, embedding[k]::DOUBLE AS v FROM embeddings, range(1, 65) r(k)"
IMG = "SELECT vec_id AS i0, ((k - 1) // 8)::BIGINT AS i1, ((k - 1) % 8)::BIGINT AS i2, embedding[k]::DOUBLE AS v FROM embeddings, range(1, 65) r(k)"
EV = "SELECT event_id AS i0, value AS v FROM events"
LINES = f"SELECT row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS i0, * FROM lineitem"
FEAT = " UNION ALL ".join(f"SELECT i0, {k}::BIGINT AS i1, {c}::DOUBLE AS v FROM l" for k, c in enumerate(FEATURES))


def scaled_round(name: str, digits: int) -> Column:
    """SQL's own formula, half away from zero. Spark's round takes each value through decimal text, which costs more than the rest of a product."""
    v = F.col(name)
    scaled = v * F.lit(10.0**digits)
    whole = F.rint(scaled)
    whole = F.when(F.abs(scaled - whole) == 0.5, scaled + F.signum(scaled) * F.lit(0.5)).otherwise(whole)
    return F.when(F.abs(scaled) == float("inf"), v).otherwise(whole / F.lit(10.0**digits))


def out(t: TensorFrame, digits: int = 6, rounding: Rounding = F.round) -> DataFrame:
    value = rounding("v", digits) + F.lit(0.0) if t.is_float else F.col("v").cast("long")
    return t.df.select(*t.coords, value.alias("v"))


def register(name: str, query: Query, sql: str | None, digits: int = 6, rank: int | None = None, whole: bool = False, rounding: Rounding = F.round) -> None:
    """``sql`` gives i0, ... and v unrounded; None if SQL can't express the query."""
    QUERIES[name] = lambda spark, d: out(query(spark, d), digits, rounding)
    if sql is not None:
        coords = ", ".join(f"i{k}::BIGINT AS i{k}" for k in range(rank or 1))
        value = "v::BIGINT" if whole else f"round(v::DOUBLE, {digits}) + 0.0"
        SQL[name] = f"SELECT {coords}, {value} AS v FROM ({sql}) result"


def scalar(spark: SparkSession, x: float) -> TensorFrame:
    return tensors.scalar(spark, x)


# -- flagship and sources ---------------------------------------------------------------------------------------


def zscore(spark: SparkSession, d: str) -> TensorFrame:
    x = lines(spark, d, FEATURES)
    return elementwise.div(reduce.center(x, 0), reduce.stddev(x, 0, 1))


register("zscore", zscore, f"WITH l AS ({LINES}), f AS ({FEAT}), m AS (SELECT i1, avg(v) AS a, stddev_samp(v) AS s FROM f GROUP BY i1) SELECT i0, i1, (v - a) / s AS v FROM f JOIN m USING (i1)", rank=2)
register("feature_means", lambda s, d: reduce.mean(any_lines(s, d, FEATURES), 0), f"WITH l AS ({LINES}), f AS ({FEAT}) SELECT 0 AS i0, i1, avg(v) AS v FROM f GROUP BY i1", 4, 2)
register("zeros", lambda s, d: tensors.zeros(s, emb(s, d).shape), f"SELECT i0, i1, 0 AS v FROM ({EMB})", rank=2)
register("arange", lambda s, d: tensors.arange(s, 1.0, 1.0 + 0.5 * read(s, d, "events").count(), 0.5), "SELECT i - 1 AS i0, 1 + 0.5 * (i - 1) AS v FROM (SELECT row_number() OVER () AS i FROM events)")


def spaced(s: SparkSession, d: str, endpoint: bool) -> TensorFrame:
    e = emb(s, d)
    start = structure.reshape(reduce.mean(e, 1), (e.shape[0],))
    return tensors.linspace(start, elementwise.add(start, scalar(s, 2.0)), 5, 1, endpoint)[0]


for _name, _end, _parts in (("linspace", True, 4), ("linspace_no_endpoint", False, 5)):
    register(_name, lambda s, d, e=_end: spaced(s, d, e), f"SELECT i0, p AS i1, m + p * 2.0::DOUBLE / {_parts} AS v FROM (SELECT i0, avg(v) AS m FROM ({EMB}) GROUP BY i0), range(5) r(p)", rank=2)


register("linspace_step", lambda s, d: (e := reduce.mean(emb(s, d), 1)) and tensors.linspace(e, elementwise.mul(e, scalar(s, 3.0)), 9)[1], f"SELECT i0, 0 AS i1, avg(v) / 4 AS v FROM ({EMB}) GROUP BY i0", rank=2)
register("linspace_scalars", lambda s, d: tensors.linspace(scalar(s, -1.0), scalar(s, 2.0), read(s, d, "events").count())[0], "SELECT i - 1 AS i0, -1 + 3.0::DOUBLE * (i - 1) / (n - 1) AS v FROM (SELECT row_number() OVER () AS i, count(*) OVER () AS n FROM events)")
register("arange_stop", lambda s, d: tensors.arange(s, float(read(s, d, "orders").count())), "SELECT i - 1 AS i0, i - 1 AS v FROM (SELECT row_number() OVER () AS i FROM orders)")


def simpson(s: SparkSession, d: str) -> TensorFrame:
    found = read(s, d, "events").agg(F.max("value").alias("b"), F.count("*").alias("n")).first()
    return tensors.integral(s, lambda x: x * x, 0.0, found["b"], found["n"])


register("integral", simpson, "SELECT 0 AS i0, max(value) ** 3 / 3 AS v FROM events", 2)

# -- structure --------------------------------------------------------------------------------------------------

register("view_block", lambda s, d: emb(s, d).view((0, 8), (emb(s, d).shape[0] // 2, 16)), f"SELECT i0, i1 - 8 AS i1, v FROM ({EMB}) WHERE i0 < (SELECT count(*) // 2 FROM embeddings) AND i1 BETWEEN 8 AND 23", rank=2)
register("alias_view", lambda s, d: (e := emb(s, d)).alias_view((0, 1), (e.shape[0] // 2, 10), (127, 6)), f"SELECT a AS i0, b AS i1, v FROM (SELECT i0 * 64 + i1 AS k, v FROM ({EMB})) e JOIN (SELECT vec_id AS a, b, 1 + 127 * vec_id + 6 * b AS k FROM embeddings, range(10) r(b) WHERE vec_id < (SELECT count(*) // 2 FROM embeddings)) USING (k)", rank=2)
register("index_axis", lambda s, d: structure.transpose(emb(s, d))[5], f"SELECT i0, v FROM ({EMB}) WHERE i1 = 5")
register("element_at", lambda s, d: (e := emb(s, d)).at(e.num_elements - 3), f"SELECT 0 AS i0, v FROM ({EMB}) WHERE i0 * 64 + i1 = (SELECT count(*) * 64 - 3 FROM embeddings)")
register("transpose", lambda s, d: structure.transpose(images(s, d), (2, 0, 1)), f"SELECT i2 AS i0, i0 AS i1, i1 AS i2, v FROM ({IMG})", rank=3)
register("reshape", lambda s, d: structure.reshape(emb(s, d), (emb(s, d).num_elements // 16, 16)), f"SELECT (i0 * 64 + i1) // 16 AS i0, i1 % 16 AS i1, v FROM ({EMB})", rank=2)
register("copy_from", lambda s, d: (e := emb(s, d)) and structure.copy_from(e, reduce.mean(e, 0)), f"SELECT e.i0, i1, m AS v FROM ({EMB}) e JOIN (SELECT i1, avg(v) AS m FROM ({EMB}) GROUP BY i1) USING (i1)", rank=2)
register("view_assigned", lambda s, d: (e := emb(s, d)) and structure.with_view_assigned(e, (0, 0), elementwise.neg(e.view((0, 4), (e.shape[0], 3)))), f"SELECT e.i0, e.i1, coalesce(-f.v, e.v) AS v FROM ({EMB}) e LEFT JOIN ({EMB}) f ON e.i0 = f.i0 AND e.i1 + 4 = f.i1 AND e.i1 < 3", rank=2)

GRID = "SELECT vec_id AS i0, a AS i1, b AS i2 FROM embeddings, range({h}) x(a), range({w}) y(b)"
register("pad", lambda s, d: structure.pad(images(s, d), 1, 2, 0, 3, 0.5), f"SELECT i0, i1, i2, coalesce(v, 0.5) AS v FROM ({GRID.format(h=11, w=11)}) LEFT JOIN (SELECT i0, i1 + 1 AS i1, i2, v FROM ({IMG})) USING (i0, i1, i2)", rank=3)
register("pad_symmetric", lambda s, d: structure.pad_symmetric(images(s, d), 1, 2), f"SELECT i0, i1, i2, coalesce(v, 0) AS v FROM ({GRID.format(h=10, w=12)}) LEFT JOIN (SELECT i0, i1 + 1 AS i1, i2 + 2 AS i2, v FROM ({IMG})) USING (i0, i1, i2)", rank=3)
register("upsample_zeros", lambda s, d: structure.upsample(images(s, d), 2), f"SELECT i0, i1, i2, coalesce(v, 0) AS v FROM ({GRID.format(h=15, w=15)}) LEFT JOIN (SELECT i0, 2 * i1 AS i1, 2 * i2 AS i2, v FROM ({IMG})) USING (i0, i1, i2)", rank=3)
register("upsample_nearest", lambda s, d: structure.upsample(images(s, d), 2, structure.UpsampleMode.NEAREST), f"SELECT g.i0, g.i1, g.i2, v FROM ({GRID.format(h=15, w=15)}) g JOIN ({IMG}) e ON g.i0 = e.i0 AND g.i1 // 2 = e.i1 AND g.i2 // 2 = e.i2", rank=3)
register("gather_axis", lambda s, d: (e := emb(s, d)) and structure.gather(e, order.argsort(e, 1), 1), f"SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, v FROM ({EMB})", rank=2)
register("gather_flat", lambda s, d: (e := emb(s, d)) and structure.gather(e, order.argsort(e, None, True)), f"SELECT k // 64 AS i0, k % 64 AS i1, v FROM (SELECT row_number() OVER (ORDER BY v DESC, i0, i1) - 1 AS k, v FROM ({EMB}))", rank=2)

register("clone_of_view", lambda s, d: (e := emb(s, d)).view((1, 3), (e.shape[0] - 1, 20)).clone(), f"SELECT i0 - 1 AS i0, i1 - 3 AS i1, v FROM ({EMB}) WHERE i0 >= 1 AND i1 BETWEEN 3 AND 22", rank=2)
register("element_by_coords", lambda s, d: (e := emb(s, d)).at(e.coords_to_index((e.shape[0] // 2, 5))), "SELECT 0 AS i0, embedding[6]::DOUBLE AS v FROM embeddings WHERE vec_id = (SELECT count(*) // 2 FROM embeddings)")
register("element_by_position", lambda s, d: (e := emb(s, d)) and (e.begin() + e.num_elements // 3).value, f"SELECT 0 AS i0, v FROM ({EMB}) WHERE i0 * 64 + i1 = (SELECT count(*) * 64 // 3 FROM embeddings)")
register("assign_scalar", lambda s, d: structure.copy_from(emb(s, d), scalar(s, 7.5)), f"SELECT i0, i1, 7.5 AS v FROM ({EMB})", rank=2)
register("assign_view_of_view", lambda s, d: (e := emb(s, d)) and structure.with_view_assigned(e.view((0, 10), (e.shape[0], 30)), (0, 5), tensors.zeros(s, (e.shape[0], 10))), f"SELECT i0, i1 - 10 AS i1, CASE WHEN i1 BETWEEN 15 AND 24 THEN 0 ELSE v END AS v FROM ({EMB}) WHERE i1 BETWEEN 10 AND 39", rank=2)
register("alias_view_overlaps", lambda s, d: (e := emb(s, d)).alias_view((0, 0), (e.shape[0] - 1, 4, 6), (64, 0, 1)), f"SELECT i0, a AS i1, i1 AS i2, v FROM ({EMB}), range(4) r(a) WHERE i1 < 6 AND i0 < (SELECT count(*) - 1 FROM embeddings)", rank=3)
register("alias_view_windows", lambda s, d: (e := values(s, d)).alias_view((0,), (e.shape[0] - 4, 5), (1, 1)), "SELECT event_id - k AS i0, k AS i1, value AS v FROM events, range(5) r(k) WHERE event_id - k BETWEEN 0 AND (SELECT count(*) - 5 FROM events)", rank=2)
register("gather_rows", lambda s, d: (e := emb(s, d)) and structure.gather(e, labels_as_index(s, d), 1), "SELECT vec_id AS i0, k AS i1, embedding[label + 1]::DOUBLE AS v FROM embeddings, range(64) r(k)", rank=2)


def labels_as_index(s: SparkSession, d: str) -> TensorFrame:
    """{rows, 1}: labels as unsigned integers"""
    df = read(s, d, "embeddings")
    column = df.select(F.col("vec_id").cast("long").alias("i0"), F.lit(0).cast("long").alias("i1"), F.col("label").cast("decimal(20,0)").alias("v"))
    return TensorFrame(column, (df.count(), 1), UINT64)


def metadata(s: SparkSession, d: str) -> DataFrame:
    """What is known of a tensor without a pass over it."""
    e = structure.transpose(images(s, d), (1, 0, 2))
    total = reduce.sum(values(s, d, F.col("event_id") % 1000)).item()
    row = (e.rank, e.num_elements, e.total_bytes, e.element_size_bytes, *e.strides, *e.index_to_coords(e.num_elements - 1), e.owns_data, total)
    names = ["rank", "elements", "bytes", "element_bytes", "stride0", "stride1", "stride2", "last0", "last1", "last2"]
    return s.createDataFrame([row], ", ".join([*[f"{n} long" for n in names], "owns boolean", "total double"]))


QUERIES["metadata"] = metadata
SQL["metadata"] = """SELECT 3::BIGINT AS rank, 64 * n AS elements, 256 * n AS bytes, 4::BIGINT AS element_bytes, 8 * n AS stride0, 8::BIGINT AS stride1, 1::BIGINT AS stride2,
  7::BIGINT AS last0, n - 1 AS last1, 7::BIGINT AS last2, false AS owns, t AS total FROM (SELECT count(*) AS n FROM embeddings), (SELECT sum(event_id % 1000)::DOUBLE AS t FROM events)"""

# -- element-wise -----------------------------------------------------------------------------------------------

PAIR = "SELECT vec_id AS i0, (k - 1)::BIGINT AS i1, embedding[k]::DOUBLE {} embedding[65 - k]::DOUBLE AS v FROM embeddings, range(1, 65) r(k)"


def mirrored(t: TensorFrame) -> TensorFrame:
    """The columns of a matrix in reverse."""
    return t.with_df(t.df.select("i0", (F.lit(t.shape[1] - 1) - F.col("i1")).alias("i1"), "v"))


for _name, _op, _sql in (("add", elementwise.add, "+"), ("sub", elementwise.sub, "-"), ("mul", elementwise.mul, "*")):
    register(_name, lambda s, d, f=_op: (e := emb(s, d)) and f(e, mirrored(e)), PAIR.format(_sql), rank=2)
register("div", lambda s, d: elementwise.div(values(s, d), values(s, d, F.col("event_id") + 1)), "SELECT event_id AS i0, value / (event_id + 1) AS v FROM events")
register("neg", lambda s, d: elementwise.neg(emb(s, d)), f"SELECT i0, i1, -v AS v FROM ({EMB})", rank=2)
register("add_broadcast", lambda s, d: (e := emb(s, d)) and elementwise.add(e, elementwise.mul(reduce.mean(e, 1), scalar(s, 3.0))), f"SELECT i0, i1, v + 3 * avg(v) OVER (PARTITION BY i0) AS v FROM ({EMB})", rank=2)
register("sqrt", lambda s, d: elementwise.sqrt(values(s, d)), f"SELECT i0, sqrt(v) AS v FROM ({EV})")
register("exp", lambda s, d: elementwise.exp(emb(s, d)), f"SELECT i0, i1, exp(v) AS v FROM ({EMB})", rank=2)
register("log", lambda s, d: elementwise.log(values(s, d), infinite=True), f"SELECT i0, ln(v) AS v FROM ({EV})")
register("pow", lambda s, d: elementwise.power(values(s, d), scalar(s, 0.75)), f"SELECT i0, pow(v, 0.75) AS v FROM ({EV})")
register("factorial", lambda s, d: elementwise.factorial(values(s, d, F.col("event_id") % 19)), "SELECT event_id AS i0, factorial((event_id % 19)::INTEGER)::DOUBLE AS v FROM events", 0)
register("relu", lambda s, d: nn.relu(emb(s, d)), f"SELECT i0, i1, greatest(v, 0) AS v FROM ({EMB})", rank=2)


def multiple(factor: int, event_id: str = "event_id") -> Column:
    """SQL's HUGEINT of an event: up to 38 digits, unwrapped"""
    return F.col(event_id).cast("decimal(20,0)") * F.lit(factor).cast("decimal(18,0)") + F.lit(7)


def unsigned_events(s: SparkSession, d: str, factor: int) -> TensorFrame:
    """{events}: multiples of event_id, wrapped as unsigned 64-bit integers are"""
    return unwrapped_events(s, d, factor).map(unsigned.wrapped)


def unwrapped_events(s: SparkSession, d: str, factor: int) -> TensorFrame:
    """{events}: multiples of event_id, for what depends on their size; SQL divides and sorts them as they are"""
    t = values(s, d)
    return TensorFrame(read(s, d, "events").select(F.col("event_id").alias("i0"), multiple(factor).alias("v")), t.shape, UINT64)


def as_signed(t: TensorFrame) -> TensorFrame:
    """The lower 62 bits, which fit the driver's BIGINT."""
    return t.with_df(t.df.select(*t.coords, F.pmod("v", F.lit(1 << 62).cast("decimal(20,0)")).alias("v")))


_U = "(event_id::HUGEINT * {f} + 7)"
for _name, _op, _sql in (
    ("add_uint64", elementwise.add, "(a + b) % m"),
    ("sub_uint64", elementwise.sub, "(b - a + m) % m"),
    ("mul_uint64", elementwise.mul, "((a % 4294967296) * b + ((a // 4294967296) * b % 4294967296) * 4294967296) % m"),
    ("div_uint64", elementwise.div, "b // a"),
):
    _first, _second = (123456789123, 999999999999937) if _name in ("add_uint64", "mul_uint64") else (999999999999937, 123456789123)
    register(
        _name,
        lambda s, d, f=_op, x=_first, y=_second, e=unwrapped_events if _name == "div_uint64" else unsigned_events: as_signed(f(e(s, d, x), e(s, d, y))),
        f"SELECT event_id AS i0, ({_sql}) % 4611686018427387904 AS v FROM (SELECT event_id, {_U.format(f=123456789123)} AS a, {_U.format(f=999999999999937)} AS b, 18446744073709551616::HUGEINT AS m FROM events)",
        whole=True,
    )


def negated(s: SparkSession, d: str, factor: int) -> TensorFrame:
    """{events}: 2^64 less the multiples of event_id; below 0, SQL's remainder is that of the size, with the sign"""
    t = as_signed(elementwise.neg(unsigned_events(s, d, factor)))
    below = (multiple(factor, "i0") > unsigned.literal(unsigned.MODULUS)) & (F.col("v") > 0)
    return t.with_df(t.df.select("i0", F.when(below, F.col("v") - unsigned.literal(1 << 62)).otherwise(F.col("v")).alias("v")))


register("neg_uint64", lambda s, d: negated(s, d, 999999999999937), f"SELECT event_id AS i0, ((m - a) % m) % 4611686018427387904 AS v FROM (SELECT event_id, {_U.format(f=999999999999937)} AS a, 18446744073709551616::HUGEINT AS m FROM events)", whole=True)
register("sort_uint64", lambda s, d: as_signed(order.sort(unwrapped_events(s, d, 999999999999937))), f"SELECT row_number() OVER (ORDER BY a) - 1 AS i0, a % 4611686018427387904 AS v FROM (SELECT {_U.format(f=999999999999937)} AS a FROM events)", whole=True)
register("cumsum_uint64", lambda s, d: as_signed(reduce.cumsum(unsigned_events(s, d, 999999999999937))), f"SELECT event_id AS i0, (sum({_U.format(f=999999999999937)}) OVER (ORDER BY event_id) % 18446744073709551616::HUGEINT) % 4611686018427387904 AS v FROM events", whole=True)
register("sum_uint64", lambda s, d: as_signed(reduce.sum(unsigned_events(s, d, 999999999999937))), f"SELECT 0 AS i0, (sum({_U.format(f=999999999999937)}) % 18446744073709551616::HUGEINT) % 4611686018427387904 AS v FROM events", whole=True)


def exponents(s: SparkSession, d: str, modulus: int, least: int) -> TensorFrame:
    t = values(s, d)
    return TensorFrame(read(s, d, "events").select(F.col("event_id").alias("i0"), (F.col("event_id") % modulus + least).cast("decimal(20,0)").alias("v")), t.shape, UINT64)


_TIMES = lambda x, y: f"((({x}) % 4294967296) * ({y}) + ((({x}) // 4294967296) * ({y}) % 4294967296) * 4294967296) % m"
_POWERS = f"CASE event_id % 3 WHEN 0 THEN a WHEN 1 THEN {_TIMES('a', 'a')} ELSE {_TIMES(_TIMES('a', 'a'), 'a')} END"
register(
    "pow_uint64", lambda s, d: as_signed(elementwise.power(unsigned_events(s, d, 999999999999937), exponents(s, d, 3, 1))),
    f"SELECT event_id AS i0, ({_POWERS}) % 4611686018427387904 AS v FROM (SELECT event_id, {_U.format(f=999999999999937)} AS a, 18446744073709551616::HUGEINT AS m FROM events)", whole=True,
)
register("factorial_uint64", lambda s, d: as_signed(elementwise.factorial(exponents(s, d, 21, 0))), "SELECT event_id AS i0, factorial((event_id % 21)::INTEGER) % 4611686018427387904 AS v FROM events", whole=True)


def same_tensor(s: SparkSession, d: str) -> DataFrame:
    e = emb(s, d)
    return s.createDataFrame([(elementwise.equal(e, mirrored(mirrored(e))), elementwise.equal(e, mirrored(e)))], "same boolean, other boolean")


QUERIES["equal"] = same_tensor
SQL["equal"] = f"WITH e AS ({EMB}) SELECT bool_and(a.v = a.v) AS same, bool_and(a.v = b.v) AS other FROM e a JOIN e b ON a.i0 = b.i0 AND b.i1 = 63 - a.i1"

# -- reductions and scans ---------------------------------------------------------------------------------------

register("sum_all", lambda s, d: reduce.sum(values(s, d)), f"SELECT 0 AS i0, sum(v) AS v FROM ({EV})", 3)
register("sum_axis0", lambda s, d: reduce.sum(emb(s, d), 0), f"SELECT 0 AS i0, i1, sum(v) AS v FROM ({EMB}) GROUP BY i1", rank=2)
register("sum_axis1", lambda s, d: reduce.sum(emb(s, d), -1), f"SELECT i0, 0 AS i1, sum(v) AS v FROM ({EMB}) GROUP BY i0", rank=2)
register("mean", lambda s, d: reduce.mean(values(s, d)), f"SELECT 0 AS i0, avg(v) AS v FROM ({EV})")
register("var", lambda s, d: reduce.var(emb(s, d), 0), f"SELECT 0 AS i0, i1, var_pop(v) AS v FROM ({EMB}) GROUP BY i1", rank=2)
register("var_ddof1", lambda s, d: reduce.var(values(s, d), None, 1), f"SELECT 0 AS i0, var_samp(v) AS v FROM ({EV})", 4)
register("stddev", lambda s, d: reduce.stddev(emb(s, d), 1, 1), f"SELECT i0, 0 AS i1, stddev_samp(v) AS v FROM ({EMB}) GROUP BY i0", rank=2)
register("argmax_axis", lambda s, d: reduce.argmax(emb(s, d), 1), f"SELECT i0, 0 AS i1, i1 AS v FROM (SELECT *, row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) AS r FROM ({EMB})) WHERE r = 1", rank=2, whole=True)
register("argmax_all", lambda s, d: reduce.argmax(values(s, d)), f"SELECT 0 AS i0, e.i0 AS v FROM ({EV}) e ORDER BY e.v DESC, e.i0 LIMIT 1", whole=True)
register("cumsum_axis", lambda s, d: reduce.cumsum(emb(s, d), 1), f"SELECT i0, i1, sum(v) OVER (PARTITION BY i0 ORDER BY i1) AS v FROM ({EMB})", rank=2)
register("cumsum_down", lambda s, d: reduce.cumsum(emb(s, d), 0), f"SELECT i0, i1, sum(v) OVER (PARTITION BY i1 ORDER BY i0) AS v FROM ({EMB})", rank=2)
register("cumsum_flat", lambda s, d: reduce.cumsum(values(s, d)), f"SELECT i0, sum(v) OVER (ORDER BY i0) AS v FROM ({EV})", 3)

# -- order ------------------------------------------------------------------------------------------------------

register("sort_axis", lambda s, d: order.sort(emb(s, d), 1), f"SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v) - 1 AS i1, v FROM ({EMB})", rank=2)
register("sort_flat", lambda s, d: order.sort(emb(s, d)), f"SELECT k // 64 AS i0, k % 64 AS i1, v FROM (SELECT row_number() OVER (ORDER BY v) - 1 AS k, v FROM ({EMB}))", rank=2)
register("argsort_axis", lambda s, d: order.argsort(emb(s, d), 0), f"SELECT row_number() OVER (PARTITION BY i1 ORDER BY e.v, e.i0) - 1 AS i0, i1, e.i0 AS v FROM ({EMB}) e", rank=2, whole=True)
register("argsort_asc", lambda s, d: order.argsort(values(s, d)), "SELECT row_number() OVER (ORDER BY value, event_id) - 1 AS i0, event_id AS v FROM events", whole=True)
register("argsort_desc", lambda s, d: order.argsort(values(s, d), None, True), "SELECT row_number() OVER (ORDER BY value DESC, event_id) - 1 AS i0, event_id AS v FROM events", whole=True)

# -- algebra ----------------------------------------------------------------------------------------------------

register("matmul", lambda s, d: (e := emb(s, d)) and linalg.matmul(structure.transpose(e), e), f"WITH e AS ({EMB}) SELECT a.i1 AS i0, b.i1, sum(a.v * b.v) AS v FROM e a JOIN e b USING (i0) GROUP BY a.i1, b.i1", rank=2)
register("matvec", lambda s, d: (e := emb(s, d)) and linalg.matmul(e, structure.reshape(reduce.mean(e, 0), (WIDTH,))), f"WITH e AS ({EMB}), m AS (SELECT i1, avg(v) AS m FROM e GROUP BY i1) SELECT i0, sum(v * m) AS v FROM e JOIN m USING (i1) GROUP BY i0")
register("vecmat", lambda s, d: (e := emb(s, d)) and linalg.matmul(structure.reshape(reduce.mean(e, 1), (e.shape[0],)), e), f"WITH e AS ({EMB}), m AS (SELECT i0, avg(v) AS m FROM e GROUP BY i0) SELECT i1 AS i0, sum(v * m) AS v FROM e JOIN m USING (i0) GROUP BY i1")
register("dot", lambda s, d: (v := elementwise.sqrt(values(s, d))) and linalg.matmul(v, v), f"SELECT 0 AS i0, sum(v) AS v FROM ({EV})", 3)
register("matmul_batched", lambda s, d: (g := images(s, d)) and linalg.matmul(g, structure.transpose(g, (0, 2, 1))), f"WITH e AS ({IMG}) SELECT a.i0, a.i1, b.i1 AS i2, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.i0 = b.i0 AND a.i2 = b.i2 GROUP BY a.i0, a.i1, b.i1", rank=3)
register("matmul_outer", lambda s, d: (e := emb(s, d)) and linalg.matmul(e, structure.transpose(e)), f"WITH e AS ({EMB}) SELECT a.i0, b.i0 AS i1, sum(a.v * b.v) AS v FROM e a JOIN e b USING (i1) GROUP BY a.i0, b.i0", rank=2, rounding=scaled_round)
register("cov_wide", lambda s, d: linalg.cov(emb(s, d)), f"WITH e AS ({EMB}) SELECT a.i1 AS i0, b.i1, covar_pop(a.v, b.v) AS v FROM e a JOIN e b USING (i0) GROUP BY a.i1, b.i1", rank=2)
register("cov", lambda s, d: linalg.cov(any_lines(s, d, FEATURES), ddof=1), f"WITH l AS ({LINES}), f AS ({FEAT}) SELECT a.i1 AS i0, b.i1, covar_samp(a.v, b.v) AS v FROM f a JOIN f b USING (i0) GROUP BY a.i1, b.i1", 3, 2)
register("cov_batched", lambda s, d: linalg.cov(images(s, d), [1], [2]), f"WITH e AS ({IMG}) SELECT a.i0, a.i2 AS i1, b.i2, covar_pop(a.v, b.v) AS v FROM e a JOIN e b ON a.i0 = b.i0 AND a.i1 = b.i1 GROUP BY a.i0, a.i2, b.i2", rank=3)
_TURN = "(CASE WHEN d >= 0 THEN 1 ELSE -1 END) / (abs(d) + sqrt(1 + d * d))"


def squares(s: SparkSession, d: str) -> TensorFrame:
    """{rows, 2, 2}: the first four columns, as matrices of which the upper triangle counts"""
    e = emb(s, d)
    return structure.reshape(e.view((0, 0), (e.shape[0], 4)), (e.shape[0], 2, 2))


register(
    "eig_values",
    lambda s, d: linalg.eig(squares(s, d))[0],
    f"WITH m AS (SELECT vec_id AS i0, embedding[1]::DOUBLE AS p, embedding[2]::DOUBLE AS o, embedding[4]::DOUBLE AS q FROM embeddings), t AS (SELECT *, (q - p) / (2 * o) AS d FROM m), r AS (SELECT *, {_TURN} AS t FROM t) SELECT i0, 0 AS i1, k AS i2, CASE WHEN k = 0 THEN p - t * o ELSE q + t * o END AS v FROM r, range(2) x(k)",
    rank=3,
)
register(
    "eig_vectors",
    lambda s, d: linalg.eig(squares(s, d))[1],
    f"WITH m AS (SELECT vec_id AS i0, embedding[1]::DOUBLE AS p, embedding[2]::DOUBLE AS o, embedding[4]::DOUBLE AS q FROM embeddings), t AS (SELECT *, (q - p) / (2 * o) AS d FROM m), r AS (SELECT *, {_TURN} AS t FROM t), c AS (SELECT *, 1 / sqrt(1 + t * t) AS c FROM r) SELECT i0, a AS i1, b AS i2, CASE WHEN a = b THEN c WHEN a = 0 THEN t * c ELSE -t * c END AS v FROM c, range(2) x(a), range(2) y(b)",
    rank=3,
)
register(
    "pca_variance",
    lambda s, d: ml.pca(any_lines(s, d, ["l_quantity", "l_extendedprice"])).explained_variance,
    "SELECT 0 AS i0, k AS i1, CASE WHEN k = 0 THEN 1 + abs(r) ELSE 1 - abs(r) END AS v FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem), range(2) x(k)",
    rank=2,
)


def cubes(s: SparkSession, d: str) -> TensorFrame:
    """{rows, 3, 3}: the first nine columns, as matrices of which the upper triangle counts"""
    e = emb(s, d)
    return structure.reshape(e.view((0, 0), (e.shape[0], 9)), (e.shape[0], 3, 3))


register(
    "eig_values_sorted",
    lambda s, d: order.sort(linalg.eig(cubes(s, d))[0], 2),
    """WITH m AS (SELECT vec_id AS i0, embedding[1]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[9]::DOUBLE AS c, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[6]::DOUBLE AS z FROM embeddings),
    q AS (SELECT *, (a + b + c) / 3 AS q FROM m),
    p AS (SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (x * x + y * y + z * z)) / 6) AS p FROM q),
    r AS (SELECT *, ((a - q) * ((b - q) * (c - q) - z * z) - x * (x * (c - q) - y * z) + y * (x * z - y * (b - q))) / (2 * p ** 3) AS r FROM p),
    t AS (SELECT i0, q, p, acos(greatest(-1, least(1, r))) / 3 AS t FROM r)
    SELECT i0, 0 AS i1, k AS i2, q + 2 * p * cos(t + 2 * pi() * CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END / 3) AS v FROM t, range(3) g(k)""",
    rank=3,
)
register("eig_covariance", lambda s, d: linalg.eig(linalg.cov(emb(s, d)))[0], None)

PAIRED = ["l_quantity", "l_extendedprice"]
_Z2 = f"SELECT i0, (l_quantity - a) / s AS x, (l_extendedprice - b) / t * sign(r) AS y FROM ({LINES}), (SELECT avg(l_quantity) AS a, stddev_samp(l_quantity) AS s, avg(l_extendedprice) AS b, stddev_samp(l_extendedprice) AS t, corr(l_quantity, l_extendedprice) AS r FROM lineitem)"
# a component's sign is free, so squares are compared
_SQUARED = lambda t: elementwise.mul(t, t)
register("pca_projections_squared", lambda s, d: _SQUARED(ml.pca(lines(s, d, PAIRED)).projections), f"SELECT i0, k AS i1, CASE WHEN k = 0 THEN (x + y) ** 2 / 2 ELSE (x - y) ** 2 / 2 END AS v FROM ({_Z2}), range(2) g(k)", rank=2)
register("pca_loadings_products", lambda s, d: (p := ml.pca(any_lines(s, d, PAIRED)).loadings) and linalg.matmul(p, structure.transpose(elementwise.mul(p, structure.copy_from(p, tensors.from_values(s, [[2.0, 1.0]]))))), "SELECT i AS i0, j AS i1, CASE WHEN i = j THEN 1.5 ELSE sign(r) / 2 END AS v FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem), range(2) f(i), range(2) g(j)", rank=2)
register("pca_projections", lambda s, d: ml.pca(emb(s, d), 3).projections, None)


def spectrum_sums(s: SparkSession, d: str) -> TensorFrame:
    """{2}: the sum of a covariance's eigenvalues and that of their squares"""
    values = linalg.eig(linalg.cov(emb(s, d)))[0].df.agg(F.array(F.sum("v"), F.sum(F.col("v") * F.col("v"))).alias("x"))
    return TensorFrame(values.select(F.posexplode("x").alias("i0", "v")).select(F.col("i0").cast("long"), "v"), (2,))


register(
    "eig_covariance_sums", spectrum_sums,
    f"WITH e AS ({EMB}), c AS (SELECT a.i1 AS x, b.i1 AS y, covar_pop(a.v, b.v) AS v FROM e a JOIN e b USING (i0) GROUP BY a.i1, b.i1) SELECT k AS i0, CASE WHEN k = 0 THEN sum(CASE WHEN x = y THEN v END) ELSE sum(v * v) END AS v FROM c, range(2) g(k) GROUP BY k", 5,
)


def mixtures(s: SparkSession, d: str) -> TensorFrame:
    """{rows, 24}: 24 mixtures of the first two columns"""
    df = read(s, d, "embeddings")
    mixed = F.expr("transform(sequence(0, 23), k -> (k + 1) * embedding[0] + (24 - k) * embedding[1])")
    return tensors.from_array_column(df.select("vec_id", mixed.alias("x")), "vec_id", "x", df.count(), 24)


# two components hold all that mixtures of two columns spread over: squared lengths and variances stay
_MIXED = "SELECT vec_id AS i0, k AS i1, (k + 1) * embedding[1]::DOUBLE + (24 - k) * embedding[2]::DOUBLE AS v FROM embeddings, range(24) r(k)"
register("pca_panel_lengths", lambda s, d: reduce.sum(_SQUARED(ml.pca(mixtures(s, d), 2, False).projections), 1), f"WITH e AS ({_MIXED}), m AS (SELECT i1, avg(v) AS a FROM e GROUP BY i1) SELECT i0, 0 AS i1, sum((v - a) ** 2) AS v FROM e JOIN m USING (i1) GROUP BY i0", 4, 2)
register("pca_panel_variance", lambda s, d: reduce.sum(ml.pca(mixtures(s, d), 2, False).explained_variance, 1), f"WITH e AS ({_MIXED}), m AS (SELECT i1, var_samp(v) AS a FROM e GROUP BY i1) SELECT 0 AS i0, 0 AS i1, sum(a) AS v FROM m", 4, 2)

# -- learning ---------------------------------------------------------------------------------------------------


def labelled(s: SparkSession, d: str) -> TensorFrame:
    """{rows, 3}: two measures and the label"""
    df = read(s, d, "embeddings")
    cut = df.select("vec_id", F.element_at("embedding", 1).alias("a"), F.col("label").alias("b"), F.element_at("embedding", 2).alias("c"))
    return tensors.from_columns(cut, "vec_id", ["a", "b", "c"], df.count())


def truth(s: SparkSession, d: str) -> TensorFrame:
    """{rows, 10}: one-hot labels"""
    df = read(s, d, "embeddings")
    t = tensors.from_columns(df, "vec_id", ["label"], df.count())
    return ml.one_hot_expand_at(t, 1, 0, 10)


register(
    "one_hot", lambda s, d: ml.one_hot_expand_at(labelled(s, d), 1, 1, 10, 2, -1),
    "SELECT vec_id AS i0, k AS i1, CASE WHEN k = 0 THEN embedding[1]::DOUBLE WHEN k = 11 THEN embedding[2]::DOUBLE WHEN k - 1 = label THEN 2 ELSE -1 END AS v FROM embeddings, range(12) r(k)", rank=2,
)
register("softmax_axis", lambda s, d: ml.softmax(emb(s, d), 1), f"SELECT i0, i1, exp(v) / sum(exp(v)) OVER (PARTITION BY i0) AS v FROM ({EMB})", 9, 2)
register("softmax_flat", lambda s, d: ml.softmax(emb(s, d)), f"SELECT i0, i1, exp(v) / sum(exp(v)) OVER () AS v FROM ({EMB})", 12, 2)
register(
    "cross_entropy", lambda s, d: ml.cross_entropy(emb(s, d).view((0, 0), (emb(s, d).shape[0], 10)), truth(s, d), 1),
    f"SELECT 0 AS i0, avg(l) AS v FROM (SELECT -ln(max(CASE WHEN i1 = label THEN exp(v) END) / sum(exp(v))) AS l FROM ({EMB}) e JOIN embeddings t ON t.vec_id = e.i0 WHERE i1 < 10 GROUP BY i0)", 9,
)
register(
    "cross_entropy_rows", lambda s, d: ml.cross_entropy(emb(s, d).view((0, 0), (emb(s, d).shape[0], 10)), truth(s, d), 1, reduction_mean=False),
    f"SELECT i0, 0 AS i1, -ln(max(CASE WHEN e.i1 = label THEN exp(v) END) / sum(exp(v))) AS v FROM ({EMB}) e JOIN embeddings t ON t.vec_id = e.i0 WHERE e.i1 < 10 GROUP BY i0", rank=2,
)
register("mean_squared_error", lambda s, d: (e := emb(s, d)) and ml.mean_squared_error(e, mirrored(e), 1), f"WITH e AS ({EMB}), s AS (SELECT a.i0, sum((a.v - b.v) ** 2) AS q FROM e a JOIN e b ON a.i0 = b.i0 AND b.i1 = 63 - a.i1 GROUP BY a.i0) SELECT 0 AS i0, avg(q) AS v FROM s")

# -- distributions ----------------------------------------------------------------------------------------------

def moderate(s: SparkSession, d: str) -> TensorFrame:
    """{events}: values below 150"""
    return values(s, d, F.col("value") % 150)


_Z = "(SELECT event_id AS i0, (value % 150 - 50) / 30 AS z FROM events)"
P_SERIES = "list_sum(list_transform(range(0, 400), lambda n: exp(-({x}) + (({s}) + n) * ln({x}) - lgamma(({s}) + n + 1))))"
_NORM = lambda f: lambda s, d: f(moderate(s, d), scalar(s, 50.0), scalar(s, 30.0))
register("norm_pdf", _NORM(norm.pdf), f"SELECT i0, exp(-z * z / 2) / (30 * sqrt(2 * pi())) AS v FROM {_Z}", 9)
register("norm_logpdf", _NORM(norm.logpdf), f"SELECT i0, -z * z / 2 - ln(30) - 0.5 * ln(2 * pi()) AS v FROM {_Z}", 9)
register("norm_cdf", _NORM(norm.cdf), f"SELECT i0, 0.5 + 0.5 * sign(z) * {P_SERIES.format(x='z * z / 2', s='0.5::DOUBLE')} AS v FROM {_Z}", 9)
_HORNER = lambda x, c: "((((({}*{x}+{})*{x}+{})*{x}+{})*{x}+{})*{x}+{})".format(*[f"({k!r})::DOUBLE" for k in c], x=x)
_TAIL = lambda p: f"{_HORNER(f'sqrt(-2*ln({p}))', norm.ACKLAM_C)} / {_HORNER(f'sqrt(-2*ln({p}))', (0.0, *norm.ACKLAM_D))}"
_MIDDLE = f"(q - 0.5) * {_HORNER('((q-0.5)*(q-0.5))', norm.ACKLAM_A)} / {_HORNER('((q-0.5)*(q-0.5))', norm.ACKLAM_B)}"
QUANTILE = f"CASE WHEN q < 0.02425 THEN {_TAIL('q')} WHEN q > 0.97575 THEN -({_TAIL('(1-q)')}) ELSE {_MIDDLE} END"
_Q = "(SELECT event_id AS i0, (event_id + 0.5)::DOUBLE / (SELECT count(*) FROM events) AS q FROM events)"
register("norm_ppf", lambda s, d: norm.ppf(shares(s, d), scalar(s, 1.0), scalar(s, 2.0)), f"SELECT i0, 1 + 2 * ({QUANTILE}) AS v FROM {_Q}", 8)
register("norm_isf", lambda s, d: norm.isf(shares(s, d), scalar(s, 1.0), scalar(s, 2.0)), f"SELECT i0, 1 + 2 * ({QUANTILE}) AS v FROM (SELECT i0, 1 - q AS q FROM {_Q})", 8)
register("norm_mean", lambda s, d: norm.mean(values(s, d), scalar(s, 1.0)), EV)
register("norm_var", lambda s, d: norm.var(scalar(s, 0.0), values(s, d)), f"SELECT i0, v * v AS v FROM ({EV})", 4)
register("norm_stddev", lambda s, d: norm.stddev(scalar(s, 0.0), values(s, d)), EV)
_S0 = "xor({seed}::UBIGINT, ((event_id::HUGEINT + 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)"
DRAWS = """SELECT i0, greatest(1e-16, least(1 - 1e-16, ((d::HUGEINT * 2685821657736338717::HUGEINT) % 18446744073709551616::HUGEINT)::DOUBLE / 18446744073709551616::DOUBLE)) AS q FROM (
  SELECT i0, xor(c, c >> 27) AS d FROM (SELECT i0, xor(b, ((b::HUGEINT * 33554432) % 18446744073709551616::HUGEINT)::UBIGINT) AS c FROM (
  SELECT i0, xor(a, a >> 12) AS b FROM (SELECT event_id AS i0, {s0} AS a FROM events))))"""
register("norm_rvs", lambda s, d: norm.rvs(s, scalar(s, 2.5), scalar(s, 0.75), values(s, d).shape, 123456789), f"SELECT i0, 2.5 + 0.75 * ({QUANTILE}) AS v FROM ({DRAWS.format(s0=_S0.format(seed=123456789))})")
register("randn", lambda s, d: norm.randn(s, values(s, d).shape, 42), f"SELECT i0, {QUANTILE} AS v FROM ({DRAWS.format(s0=_S0.format(seed=42))})")

_C = "(SELECT event_id AS i0, value / 10 AS x, (event_id % 7 + 1)::DOUBLE AS k FROM events)"
_CHI = lambda f: lambda s, d: f(values(s, d, F.col("value") / 10), degrees(s, d))
_LOGPDF = "(k / 2 - 1) * ln(x) - x / 2 - k / 2 * ln(2) - lgamma(k / 2)"
register("chi2_pdf", _CHI(lambda x, k: chi2.pdf(x, k, infinite=True)), f"SELECT i0, exp({_LOGPDF}) AS v FROM {_C}", 9, rounding=scaled_round)
register("chi2_logpdf", _CHI(lambda x, k: chi2.logpdf(x, k, infinite=True)), f"SELECT i0, {_LOGPDF} AS v FROM {_C}", 8, rounding=scaled_round)
register("chi2_cdf", _CHI(chi2.cdf), f"SELECT i0, {P_SERIES.format(x='x / 2', s='k / 2')} AS v FROM {_C}", 9)
register("chi2_ppf", lambda s, d: (k := degrees(s, d)) and chi2.cdf(chi2.ppf(shares(s, d), k), k), f"SELECT i0, q AS v FROM {_Q}", 9)
register("chi2_isf", lambda s, d: (k := degrees(s, d)) and chi2.cdf(chi2.isf(shares(s, d), k), k), f"SELECT i0, 1 - q AS v FROM {_Q}", 9)
register("chi2_rvs", lambda s, d: chi2.cdf(chi2.rvs(s, scalar(s, 3.0), values(s, d).shape, 99), scalar(s, 3.0)), f"SELECT i0, q AS v FROM ({DRAWS.format(s0=_S0.format(seed=99))})", 9)
register("chi2_mean", lambda s, d: chi2.mean(degrees(s, d)), "SELECT event_id AS i0, event_id % 7 + 1 AS v FROM events")
register("chi2_var", lambda s, d: chi2.var(degrees(s, d)), "SELECT event_id AS i0, 2 * (event_id % 7 + 1) AS v FROM events")
register("chi2_stddev", lambda s, d: chi2.stddev(degrees(s, d)), "SELECT event_id AS i0, sqrt(2 * (event_id % 7 + 1)) AS v FROM events", 9)

# -- networks ---------------------------------------------------------------------------------------------------


def kernel(s: SparkSession, channels: tuple[int, int]) -> TensorFrame:
    return tensors.from_values(s, [[[[(9 * c + 3 * r + k + 1) / 10 for k in range(3)] for r in range(3)]] for c in range(2)], (*channels, 3, 3))


def planes(s: SparkSession, d: str) -> TensorFrame:
    """{rows, 1, 8, 8}"""
    e = emb(s, d)
    return structure.reshape(e, (e.shape[0], 1, 8, 8))


_K = "SELECT c, r, k, (9 * c + 3 * r + k + 1)::DOUBLE / 10 AS w FROM range(2) a(c), range(3) b(r), range(3) d(k)"
register(
    "conv2d", lambda s, d: nn.conv2d(planes(s, d), kernel(s, (2, 1)), 2, (1, 1)),
    f"WITH g AS (SELECT vec_id AS i0, x AS i2, y AS i3 FROM embeddings, range(4) p(x), range(4) q(y)) SELECT g.i0, c AS i1, g.i2, g.i3, sum(v * w) AS v FROM g, ({_K}) w JOIN ({IMG}) e ON e.i0 = g.i0 AND e.i1 = 2 * g.i2 - 1 + 2 - r AND e.i2 = 2 * g.i3 - 1 + 2 - k GROUP BY g.i0, c, g.i2, g.i3", rank=4,
)
register(
    "conv2d_transpose", lambda s, d: nn.conv2d_transpose(planes(s, d), kernel(s, (1, 2)), 2, (1, 1), (1, 1)),
    f"SELECT e.i0, c AS i1, 2 * e.i1 + r - 1 AS i2, 2 * e.i2 + k - 1 AS i3, sum(v * w) AS v FROM ({IMG}) e, ({_K}) w WHERE 2 * e.i1 + r - 1 BETWEEN 0 AND 15 AND 2 * e.i2 + k - 1 BETWEEN 0 AND 15 GROUP BY ALL", rank=4,
)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
