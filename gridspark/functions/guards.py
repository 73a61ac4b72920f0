"""Value checks as column expressions, so they run inside the generated code of the stage that computes the value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.errors import NanError, NonFiniteError, ValidationError, message

_STRICT = [True]


def set_checks(mode: str) -> None:
    """'strict' (the default) adds the value checks to every plan built from now on; 'off' leaves them out."""
    _STRICT[0] = {"strict": True, "off": False}[mode]


def fails(kind: type[Exception], where: str, what: str) -> Column:
    return F.raise_error(F.lit(message(kind, where, what))).cast("double")


def ensure(value: Column, bad: Column, kind: type[Exception], where: str, what: str) -> Column:
    return F.when(bad, fails(kind, where, what)).otherwise(value) if _STRICT[0] else value


def no_nan(value: Column, where: str) -> Column:
    return ensure(value, F.isnan(value), NanError, where, "NaN in the input")


def finite(value: Column, where: str) -> Column:
    """A finite value; its being NaN or infinite is the non-finite error."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return ensure(value, bad, NonFiniteError, where, "a result is not finite")


def no_null(value: Column, where: str) -> Column:
    return F.when(value.isNull(), fails(ValidationError, where, "a null value")).otherwise(value)
