"""Shape arithmetic on the driver: broadcasting, row-major strides, axes. No data is touched."""

from __future__ import annotations

from math import prod

from gridspark.errors import BoundsError, ValidationError, require

Shape = tuple[int, ...]
LIMIT = (1 << 63) - 1


def checked(shape, where: str = "shape") -> Shape:
    shape = tuple(int(n) for n in shape)
    require(len(shape) > 0, ValidationError, where, "an empty shape")
    require(all(n > 0 for n in shape), ValidationError, where, f"a dimension of {shape} is not positive")
    require(prod(shape) <= LIMIT, BoundsError, where, f"too many elements in {shape}")
    return shape


def strides(shape: Shape) -> Shape:
    """Row-major element steps."""
    out, step = [], 1
    for n in reversed(shape):
        out.append(step)
        step *= n
    return tuple(reversed(out))


def axis_of(axis: int, rank: int, where: str) -> int:
    require(-rank <= axis < rank, BoundsError, where, f"axis {axis} of a tensor of rank {rank}")
    return axis % rank


def aligned(shape: Shape, rank: int) -> Shape:
    return (1,) * (rank - len(shape)) + tuple(shape)


def broadcast(shapes: list[Shape], where: str) -> Shape:
    """The common shape of right-aligned operands; a dimension fits if it is 1 or that of the others."""
    rank = max(map(len, shapes))
    out = []
    for column in zip(*(aligned(s, rank) for s in shapes)):
        n = max(column)
        require(all(k in (1, n) for k in column), ValidationError, where, f"shapes {shapes} don't broadcast")
        out.append(n)
    return checked(out, where)


def unravel(flat: int, shape: Shape) -> Shape:
    require(0 <= flat < prod(shape), BoundsError, "index_to_coords", f"{flat} of {prod(shape)}")
    return tuple(flat // s % n for s, n in zip(strides(shape), shape))


def ravel(coords, shape: Shape) -> int:
    require(len(coords) == len(shape), ValidationError, "coords_to_index", "as many coordinates as axes are needed")
    require(all(0 <= c < n for c, n in zip(coords, shape)), BoundsError, "coords_to_index", f"{tuple(coords)} of {shape}")
    return sum(c * s for c, s in zip(coords, strides(shape)))
