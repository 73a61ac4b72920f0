"""Typed errors, and their way through a Spark job.

Checks on metadata raise at once. Checks on values are expressions in the plan; they fail at the action with a
message that starts with the error's prefix, and ``raised`` turns that into the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


class NanError(ValueError):
    prefix = "NaN Error"


class NonFiniteError(RuntimeError):
    prefix = "Non-finite Error"


class ValidationError(ValueError):
    prefix = "Validation Error"


class ComputationError(RuntimeError):
    prefix = "Computation Error"


class BoundsError(IndexError):
    prefix = "Bounds Error"


class DeviceError(RuntimeError):
    prefix = "Device Error"


KINDS = (NanError, NonFiniteError, ValidationError, ComputationError, BoundsError, DeviceError)


def message(kind: type[Exception], where: str, what: str) -> str:
    return f"{kind.prefix}: {where}: {what}"


def require(ok: bool, kind: type[Exception], where: str, what: str) -> None:
    if not ok:
        raise kind(message(kind, where, what))


@contextmanager
def raised() -> Iterator[None]:
    """Runs an action; a failed value check becomes its typed error."""
    try:
        yield
    except KINDS:
        raise
    except Exception as failure:
        text = str(failure)
        for kind in KINDS:
            at = text.find(f"{kind.prefix}: ")
            if at >= 0:
                raise kind(text[at:].split("\n", 1)[0]) from failure
        raise
