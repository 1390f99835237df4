"""Separable resampling on planes.

Rows are dealt and sorted by plane of constant z, so a task meets whole planes one after another: x and y are resampled there
as NumPy arrays, and lines leave as one row each. The same lines, dealt by y, are the planes along z. So three axes cost two
shuffles, the second of packed lines, and a task holds one plane, or as many small ones as an Arrow batch has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.functions.columns import clamp, taps


def resample_array(a, axis: int, size: int, order: int):
    """The array `a` with `size` samples along `axis`: the sum over taps of clamped samples times their weights.

    Samples that no tap names are not read, so a value that is not finite spoils its neighbours only.
    """
    import numpy as np

    n = a.shape[axis]
    at = (np.arange(size) + 0.5) * n / size - 0.5
    first = np.floor(at)
    f = at - first
    if order == 1:
        lead, weights = 0, [1 - f, f]
    else:
        f2, f3 = f * f, f * f * f
        lead, weights = -1, [0.5 * (-f + 2 * f2 - f3), 0.5 * (2 - 5 * f2 + 3 * f3), 0.5 * (f + 4 * f2 - 3 * f3), 0.5 * (f3 - f2)]
    along = [-1 if k == axis else 1 for k in range(a.ndim)]
    taken = [np.take(a, np.clip(first.astype(np.int64) + lead + j, 0, n - 1), axis) * w.reshape(along) for j, w in enumerate(weights)]
    return sum(taken[1:], taken[0])


def _whole_groups(batches: Iterator, across: str) -> Iterator:
    """Tables of whole (vol, across) groups, from batches of rows sorted by them, each with the first row of every group in it."""
    import numpy as np
    import pyarrow as pa

    def keys(rows):
        return rows["vol"].to_numpy(zero_copy_only=False), rows[across].to_numpy()

    held, key = [], None
    for rows in batches:
        if not rows.num_rows:
            continue
        vol, k = keys(rows)
        if held and (vol[-1], k[-1]) == key:
            held.append(rows)
            continue
        last = int(np.flatnonzero((vol != vol[-1]) | (k != k[-1]))[-1]) + 1 if (vol[0], k[0]) != (vol[-1], k[-1]) else 0
        if held or last:
            yield _starts(pa.Table.from_batches([*held, rows.slice(0, last)]).combine_chunks(), across)
        held, key = [rows.slice(last)], (vol[-1], k[-1])
    if held:
        yield _starts(pa.Table.from_batches(held).combine_chunks(), across)


def _starts(table, across: str):
    import numpy as np

    vol, k = table["vol"].to_numpy(), table[across].to_numpy()
    return table, np.flatnonzero(np.concatenate([[True], (vol[1:] != vol[:-1]) | (k[1:] != k[:-1])]))


def _cells(column):
    """Numbers, or arrays of them, of a table's column as one array of doubles, null as NaN, and the numbers in each row."""
    import pyarrow as pa

    column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    nested = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    flat = column.flatten() if nested else column
    return flat.cast("double").to_numpy(zero_copy_only=False), column.value_lengths().to_numpy() if nested else None


def _lines(table, starts, parts: list, across: str, up: str):
    """A batch of lines (vol, across, up, line) from parts (groups, samples of each as (groups, lines, numbers))."""
    import numpy as np
    import pyarrow as pa

    group = np.concatenate([np.repeat(g, a.shape[1]) for g, a in parts])
    place = np.concatenate([np.tile(np.arange(a.shape[1], dtype=np.int32), len(g)) for g, a in parts])
    lengths = np.concatenate([np.full(len(g) * a.shape[1], a.shape[2]) for g, a in parts])
    first = pa.array(starts[group])
    line = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.concatenate([a.reshape(-1) for _, a in parts])))
    columns = {"vol": table["vol"].take(first), across: table[across].take(first), up: pa.array(place), "line": line}
    return pa.table(columns).to_batches()


def _alike(*columns):
    """Groups whose columns are equal: (values, their places)."""
    import numpy as np

    kinds, of = np.unique(np.stack(columns, 1), axis=0, return_inverse=True)
    return [(kind, np.flatnonzero(of.reshape(-1) == i)) for i, kind in enumerate(kinds)]


def _extents(shape: DataFrame, axes: str) -> list:
    """Extents that the header gives, if `shape` has them: with them, what is missing at a volume's end is seen as well."""
    return [F.col(f"n{k}").cast("int") for k in axes if f"n{k}" in shape.columns]


def _planes(voxels: DataFrame, shape: DataFrame, across: str, axes: Sequence[str], order: int, value: str, channels: int) -> DataFrame:
    """Lines (vol, across, up, line) of planes of constant `across`, resampled along `axes`. Up and along a line run the other axes in z, y, x order."""
    up, fast = [k for k in "zyx" if k != across]
    width = channels or 1

    def run(batches):
        import numpy as np

        for table, starts in _whole_groups(batches, across):
            cells = _cells(table[value])[0].reshape(-1, width)
            u, f = table[up].to_numpy(), table[fast].to_numpy()
            new = np.concatenate([[1], u[1:] != u[:-1]]).astype(np.int64)
            new[starts] = 1
            height, count = np.add.reduceat(new, starts), np.diff(np.append(starts, len(u)))
            long = count // height
            at = np.arange(len(u)) - np.repeat(starts, count)
            if (count % height).any() or (u != at // np.repeat(long, count)).any() or (f != at % np.repeat(long, count)).any():
                raise ValueError("a plane is not dense: voxels are missing or repeated")
            for k, there in ((up, height), (fast, long)):
                if f"n{k}" in table.column_names and (table[f"n{k}"].to_numpy()[starts] != there).any():
                    raise ValueError(f"a plane is not dense: lines are missing along {k}")
            parts = []
            for kind, g in _alike(count, height, *(table[f"t{k}"].to_numpy()[starts] for k in axes)):
                plane = cells[starts[g][:, None] + np.arange(kind[0])].reshape(len(g), kind[1], kind[0] // kind[1], width)
                for k, size in zip(axes, kind[2:], strict=True):
                    plane = resample_array(plane, 1 if k == up else 2, int(size), order)
                parts.append((g, plane.reshape(len(g), plane.shape[1], -1)))
            yield from _lines(table, starts, parts, across, up)

    sizes = shape.select("vol", *(F.col(f"t{k}").cast("int") for k in axes), *_extents(shape, up + fast))
    rows = voxels.select("vol", *(F.col(k).cast("int").alias(k) for k in "zyx"), value).join(sizes, "vol")
    rows = rows.repartition("vol", across).sortWithinPartitions("vol", across, up, fast)
    return rows.mapInArrow(run, f"vol {dict(voxels.dtypes)['vol']}, {across} int, {up} int, line array<double>")


def _along_z(lines: DataFrame, shape: DataFrame, order: int) -> DataFrame:
    """Lines (vol, z, y, line along x) resampled along z; those of one y are a plane."""

    def run(batches):
        import numpy as np

        for table, starts in _whole_groups(batches, "y"):
            cells, lengths = _cells(table["line"])
            offset = np.cumsum(lengths) - lengths
            count = np.diff(np.append(starts, table.num_rows))
            if (table["z"].to_numpy() != np.arange(table.num_rows) - np.repeat(starts, count)).any() or (lengths != np.repeat(lengths[starts], count)).any():
                raise ValueError("a volume is not dense: planes are missing or differ")
            if "nz" in table.column_names and (table["nz"].to_numpy()[starts] != count).any():
                raise ValueError("a volume is not dense: planes are missing at its end")
            parts = []
            for (count, length, size), g in _alike(np.diff(np.append(starts, table.num_rows)), lengths[starts], table["tz"].to_numpy()[starts]):
                at = offset[starts[g][:, None] + np.arange(count)]
                parts.append((g, resample_array(cells[at[:, :, None] + np.arange(length)], 1, int(size), order)))
            yield from _lines(table, starts, parts, "y", "z")

    rows = lines.join(shape.select("vol", F.col("tz").cast("int"), *_extents(shape, "z")), "vol").repartition("vol", "y").sortWithinPartitions("vol", "y", "z")
    return rows.mapInArrow(run, f"vol {dict(lines.dtypes)['vol']}, y int, z int, line array<double>")


def _samples(lines: DataFrame, fast: str, value: str, channels: int) -> DataFrame:
    """Voxels of packed lines."""
    cells = F.col("line")
    if channels:
        last = (F.size("line") / channels).cast("int") - 1
        cells = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("line", i * channels + 1, channels))
    others = [k for k in "zyx" if k != fast]
    return lines.select("vol", *others, F.posexplode(cells).alias(fast, value)).select("vol", "z", "y", "x", value)


def resample_axis(voxels: DataFrame, shape: DataFrame, axis: str, order: int, value: str = "val", channels: int = 0) -> DataFrame:
    """Resample `value` of dense voxels along `axis` to the length in `shape` (vol, t<axis>). channels > 0: `value` is an array of that size."""
    across = "y" if axis == "z" else "z"
    return _samples(_planes(voxels, shape, across, [axis], order, value, channels), "x", value, channels)


def resample(voxels: DataFrame, shape: DataFrame, order: int, value: str = "val", channels: int = 0) -> DataFrame:
    """All three axes of dense voxels: linear (order 1) or Catmull-Rom (order 3), edges clamped. `shape`: vol, tz, ty, tx.

    Voxels that are missing or repeated end the job, since values beside a hole would silently be wrong; holes at a volume's end are
    seen if `shape` has the extents nz, ny, nx too.
    """
    return _samples(_along_z(_planes(voxels, shape, "z", "yx", order, value, channels), shape, order), "x", value, channels)


def tap_table(meta: DataFrame, order: int) -> DataFrame:
    """vol, k, i, w over the x axis of `meta` (vol, nx, tx): input samples and weights of every output sample."""
    rows = meta.select("vol", "nx", "tx", F.explode(F.sequence(F.lit(0), F.col("tx") - 1)).alias("k"))
    i0, weights = taps(F.col("k"), F.col("nx"), F.col("tx"), order)
    first = -1 if order == 3 else 0
    pairs = F.array(*(F.struct(F.lit(j).alias("tap"), clamp(i0 + first + j, F.col("nx")).alias("i"), w.alias("w")) for j, w in enumerate(weights)))
    return rows.select("vol", "k", F.explode(pairs).alias("p")).select("vol", "k", "p.tap", "p.i", "p.w")
