"""Column expressions that the volume operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOXEL = ("vol", "z", "y", "x")


def clamp(i: Column, n: Column) -> Column:
    """An index held inside [0, n - 1]."""
    return F.greatest(F.lit(0), F.least(n - 1, i))


def linear_index(z: Column, y: Column, x: Column, ny: Column, nx: Column) -> Column:
    """Offset of a voxel when x runs fastest, as a long."""
    return (z.cast("long") * ny + y) * nx + x


def from_linear(i: Column, ny: Column, nx: Column) -> tuple[Column, Column, Column]:
    """(z, y, x) of an offset when x runs fastest."""
    return F.floor(i / (ny.cast("long") * nx)).cast("int"), (F.floor(i / nx) % ny).cast("int"), (i % nx).cast("int")


def pick(options: list[Column], which: Column) -> Column:
    """options[which] for a column of positions."""
    return F.element_at(F.array(*options), which + 1)


def taps(k: Column, n_in: Column, n_out: Column, order: int) -> tuple[Column, list[Column]]:
    """For output position k: the unclamped floor of its place in the input, and the weights of the inputs around it.

    order 1 has weights for offsets 0 and 1, order 3 (Catmull-Rom) for -1 to 2.
    """
    t = (k + 0.5) * n_in / n_out - 0.5
    i0 = F.floor(t)
    f = t - i0
    if order == 1:
        return i0.cast("int"), [1 - f, f]
    f2, f3 = f * f, f * f * f
    return i0.cast("int"), [0.5 * (-f + 2 * f2 - f3), 0.5 * (2 - 5 * f2 + 3 * f3), 0.5 * (f + 4 * f2 - 3 * f3), 0.5 * (f3 - f2)]
