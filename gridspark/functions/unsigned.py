"""64-bit unsigned arithmetic, wrapping, on DECIMAL(20, 0) columns."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DecimalType

MODULUS = 1 << 64
TYPE = "decimal(20,0)"
_WIDE = "decimal(38,0)"


def literal(value: int) -> Column:
    return F.lit(str(value)).cast(_WIDE)


def wrapped(x: Column) -> Column:
    return F.pmod(x.cast(_WIDE), literal(MODULUS)).cast(TYPE)


def halves(x: Column) -> tuple[Column, Column]:
    """The upper and the lower 32 bits."""
    low = F.pmod(x.cast(_WIDE), literal(1 << 32))
    high = F.floor((x.cast(_WIDE) - low).cast("decimal(25,0)") / literal(1 << 32).cast("decimal(12,0)"))
    return high.cast("decimal(12,0)"), low.cast("decimal(12,0)")


def multiply(a: Column, b: Column) -> Column:
    high, low = halves(b)
    upper = F.pmod((a.cast(TYPE) * high).cast(_WIDE), literal(1 << 32)) * literal(1 << 32).cast("decimal(12,0)")
    return wrapped(upper.cast(_WIDE) + (a.cast(TYPE) * low).cast(_WIDE))


def from_bits(x: Column) -> Column:
    """The unsigned value of a BIGINT's bits."""
    wide = x.cast(_WIDE)
    return F.when(x < 0, wide + literal(MODULUS)).otherwise(wide).cast(TYPE)


@pandas_udf(DecimalType(20, 0))
def power(a: pd.Series, b: pd.Series) -> pd.Series:
    """Squares and multiplies whole columns, 64 times at most; NumPy's products wrap as they should."""
    base, left = (np.array([int(x) for x in c], np.uint64) for c in (a, b))
    out = np.ones(len(base), np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * base, out)
        base, left = base * base, left >> np.uint64(1)
    return pd.Series([Decimal(x) for x in out.tolist()], dtype=object)
