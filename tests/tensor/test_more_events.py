"""Queries over more events than sf0.1 has, against their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import catalog
from gridspark.plans.scan import running_sum

ROWS = 120_000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Events whose unsigned multiples pass 10^20."""
    path = tmp_path_factory.mktemp("more")
    duckdb.sql(f"COPY (SELECT k AS event_id, (k % 4096) / 8 AS value FROM range({ROWS}) r(k)) TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["add_uint64", "cumsum_uint64", "mul_uint64", "pow_uint64", "sub_uint64", "sum_uint64", "div_uint64", "sort_uint64", "neg_uint64", "log", "chi2_logpdf", "chi2_pdf"])
def test_equals_sql(spark, folder, name):
    got = sorted(tuple(r) for r in catalog.queries()[name](spark, folder).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet'")
    want = sorted(db.execute(catalog.oracle_sql()[name]).fetchall())
    if name.endswith("uint64"):
        assert got == want
    else:
        assert [r[0] for r in got] == [r[0] for r in want]
        assert np.allclose([r[1] for r in got], [r[1] for r in want], rtol=1e-8, atol=2e-6, equal_nan=True)


@pytest.mark.parametrize("name", ["cumsum_uint64", "cumsum_flat"])
def test_running_sums_across_gaps(spark, tmp_path, name):
    """Events whose ids have gaps, so that blocks of positions are missing."""
    duckdb.sql(f"COPY (SELECT k % 1000 + k // 1000 * 200000 AS event_id, (k % 4096) / 8 AS value FROM range({ROWS}) r(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    assert got == sorted(db.execute(catalog.oracle_sql()[name]).fetchall())


def test_running_sums_across_gaps_of_three_levels(spark):
    places = [(k % 5 + k // 5 * 40, 0.5 * k) for k in range(300)]
    got = running_sum(spark.createDataFrame(places, "i long, v double"), [], F.col("i"), len(places), "v", "total", "double", 7).orderBy("i").collect()
    assert [r.total for r in got] == np.cumsum([v for _, v in places]).tolist()


def test_outer_product_is_rounded_as_sql_rounds(spark, tmp_path):
    """Products whose millionths end near a half, where a decimal text rounds otherwise than SQL does."""
    duckdb.sql(f"""COPY (SELECT k AS vec_id, list_concat([(k * 37.37 + 30000)::FLOAT], list_transform(range(63), lambda x: 0::FLOAT)) AS embedding
        FROM range(150) r(k)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)""")
    got = sorted(tuple(r) for r in catalog.queries()["matmul_outer"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet'")
    assert got == sorted(db.execute(catalog.oracle_sql()["matmul_outer"]).fetchall())


def rows_and_sql(spark, path, name, found):
    """A query's values, and its SQL's, of events with each of the ``found`` values at one to seven degrees of freedom."""
    each = ", ".join(f"({7 * n + k}, {v!r}::DOUBLE)" for n, v in enumerate(found) for k in range(7))
    duckdb.sql(f"COPY (SELECT event_id::BIGINT AS event_id, value FROM (VALUES {each}) e(event_id, value)) TO '{path}/events.parquet' (FORMAT parquet)")
    got = sorted(tuple(r) for r in catalog.queries()[name](spark, str(path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS FROM '{path}/events.parquet'")
    want = sorted(db.execute(catalog.oracle_sql()[name]).fetchall())
    assert [r[0] for r in got] == [r[0] for r in want] and len(got) == 7 * len(found)
    return np.array([r[1] for r in got]), np.array([r[1] for r in want])


def test_log_densities_are_rounded_as_sql_rounds(spark, tmp_path):
    """Arguments so large that the eighth digit is beyond a double, besides 0."""
    got, want = rows_and_sql(spark, tmp_path, "chi2_logpdf", [0.0, 0.5, 1e5, 1e10, 1e16])
    assert np.array_equal(got, want, equal_nan=True)


def test_densities_next_to_zero(spark, tmp_path):
    """At two degrees SQL gives NaN at 0 only, and 1/2 for the least arguments above it."""
    got, want = rows_and_sql(spark, tmp_path, "chi2_pdf", [0.0, 5e-324, 1e-300, 1e-17, 1e-9, 0.5])
    assert np.isnan(want).sum() == 2 and np.allclose(got, want, rtol=1e-12, atol=1e-9, equal_nan=True)
