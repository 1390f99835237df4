"""Volumes as planes: one row (vol, z, ny, nx, data) a plane, its values in one array, x fastest, as files give them too.

Planes go through cropping, resampling, tiling, scoring and blending without becoming voxels. Shuffles carry planes or lines: by plane to
pack voxels, by slab (the planes that one row of tiles along z needs, resampled where they arrive), by plane to add the slabs up, and
by y to go back along z. A task holds a slab of one volume, and of scores patch_z x patch_y x width x classes at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.operators import grid, tiles
from voxelith.operators.resample import _cells, _whole_groups, resample_array

PLANE = ["vol", "z", "ny", "nx", "data"]


def pack(voxels: DataFrame, value: str = "val") -> DataFrame:
    """PLANE rows of dense voxels. A plane whose voxels do not fill its extents, or repeat, ends the job."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).cast("double").alias("v"))))
    out = voxels.groupBy("vol", F.col("z").cast("int").alias("z")).agg((F.max("y") + 1).cast("int").alias("ny"), (F.max("x") + 1).cast("int").alias("nx"), cells.alias("c"))
    astray = F.exists(F.transform("c", lambda s, i: s["y"] * F.col("nx") + s["x"] != i), lambda odd: odd)
    data = F.when((F.size("c") == F.col("ny") * F.col("nx")) & ~astray, F.col("c.v")).otherwise(F.raise_error(F.lit("a plane is not dense: voxels are missing or repeated")).cast("array<double>"))
    return out.select("vol", "z", "ny", "nx", data.alias("data"))


def unpack(planes: DataFrame, value: str = "val") -> DataFrame:
    """vol, z, y, x, value of planes."""
    out = planes.select("vol", "z", "nx", F.posexplode("data").alias("i", value))
    return out.select("vol", "z", F.floor(F.col("i") / F.col("nx")).cast("int").alias("y"), (F.col("i") % F.col("nx")).cast("int").alias("x"), value)


def measured(voxels: DataFrame) -> DataFrame:
    """vol, box, mean_, sd_: the box around values other than 0 (all of a volume without any) and the moments of all voxels in it, in one scan.

    Values outside the box are 0 and add nothing, so the box's moments follow from its size and from number, mean and variance of the
    values other than 0. Volumes must be dense.
    """
    other = F.col("val") != 0
    own = [F.count(F.when(other, 1)).alias("k_"), F.coalesce(F.avg(F.when(other, F.col("val"))), F.lit(0.0)).alias("m_"), F.coalesce(F.var_pop(F.when(other, F.col("val"))), F.lit(0.0)).alias("v_")]
    out = voxels.groupBy("vol").agg(*grid.box_columns(), *own)
    n = F.col("zhi") - F.col("zlo")
    for k in "yx":
        n = n * (F.col(f"{k}hi") - F.col(f"{k}lo"))
    share = F.col("k_") / n
    mean = share * F.col("m_")
    var = share * (F.col("v_") + (F.col("m_") - mean) ** 2) + (1 - share) * mean * mean
    return out.withColumns({"mean_": mean, "sd_": F.sqrt(var)}).drop("k_", "m_", "v_")


def _reach(k: Column, n: Column, t: Column, order: int, last: bool) -> Column:
    """The first or last input sample that output sample k of t takes from n."""
    i = F.floor((k + 0.5) * n / t - 0.5).cast("int") + (F.lit(order // 2 + 1) if last else F.lit(-(order // 2)))
    return F.least(F.greatest(i, F.lit(0)), n - 1)


def resized(planes: DataFrame, shape: DataFrame, order: int, channels: int = 0) -> DataFrame:
    """Planes resampled along y and x to the ty, tx of `shape` (vol, ty, tx); channels > 0: that many numbers a voxel. Nothing is shuffled."""
    width = channels or 1
    kind = dict(planes.dtypes)["vol"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, lengths = _cells(pa.table(b.select(["data"]))["data"])
            ends = np.cumsum(lengths)
            sizes = [b[c].to_numpy() for c in ("ny", "nx", "ty", "tx")]
            out = []
            for end, length, ny, nx, ty, tx in zip(ends, lengths, *sizes, strict=True):
                plane = flat[end - length : end].reshape(ny, nx, width)
                out.append(resample_array(resample_array(plane, 1, int(tx), order), 0, int(ty), order).reshape(-1))
            data = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *out])))
            yield pa.RecordBatch.from_pydict({"vol": b["vol"], "z": b["z"], "ny": b["ty"], "nx": b["tx"], "data": data})

    rows = planes.join(shape.select("vol", F.col("ty").cast("int"), F.col("tx").cast("int")), "vol").select(*PLANE, "ty", "tx")
    return rows.mapInArrow(run, f"vol {kind}, z int, ny int, nx int, data array<double>")


def slabs(planes: DataFrame, shape: DataFrame, patch: tuple[int, int, int], ratio: float, order: int, rule: Callable = tiles.starts) -> DataFrame:
    """`planes` of resized() with the row of tiles along z that needs them: kz, z0 and what the next step needs of the volume, once for each row.

    `shape`: vol, nz (planes there are), tz, ty, tx (the size to reach along z, and the sizes along y and x). Volumes smaller than the
    patch are padded with zeros, half of them, rounded down, before. The rows of tiles that need a plane are filtered from the short
    array of starts.
    """
    s = shape.select("vol", F.col("nz").alias("sz_"), *(F.col(f"t{k}").alias(f"t{k}") for k in "zyx"))
    padded = s.select("*", *(F.greatest(F.col(f"t{k}"), F.lit(p)).alias(f"n{k}") for k, p in zip("zyx", patch, strict=True)))
    padded = tiles.with_starts(padded, patch, ratio, rule)
    padded = padded.select("vol", "sz_", "tz", *(F.col(f"n{k}").alias(f"p{k}") for k in "zyx"), *(grid.offset(F.col(f"t{k}"), p).alias(f"o{k}") for k, p in zip("zyx", patch, strict=True)), "bz", "by", "bx")
    clamp = lambda k: F.least(F.greatest(k, F.lit(0)), F.col("tz") - 1)
    first = lambda b: _reach(clamp(b - F.col("oz")), F.col("sz_"), F.col("tz"), order, False)
    last = lambda b: _reach(clamp(b - F.col("oz") + patch[0] - 1), F.col("sz_"), F.col("tz"), order, True)
    needs = F.filter(F.transform("bz", lambda b, i: F.struct(i.cast("int").alias("kz"), b.cast("int").alias("z0"))), lambda t: (first(t["z0"]) <= F.col("z")) & (F.col("z") <= last(t["z0"])))
    rows = planes.join(padded, "vol").withColumn("t_", F.explode(needs))
    return rows.select("vol", "t_.kz", "t_.z0", "z", "sz_", "tz", "oz", "oy", "ox", "py", "px", "ny", "nx", "by", "bx", "data")


def _taps(n: int, size: int, order: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input samples and weights (outputs, taps) of output samples k of `size` from n."""
    at = (k + 0.5) * n / size - 0.5
    first = np.floor(at).astype(np.int64)
    f = at - first
    if order == 1:
        return np.clip(first[:, None] + [0, 1], 0, n - 1), np.stack([1 - f, f], 1)
    w = [0.5 * (-f + 2 * f**2 - f**3), 0.5 * (2 - 5 * f**2 + 3 * f**3), 0.5 * (f + 4 * f**2 - 3 * f**3), 0.5 * (f**3 - f**2)]
    return np.clip(first[:, None] + [-1, 0, 1, 2], 0, n - 1), np.stack(w, 1)


def window(patch: tuple[int, int, int]) -> np.ndarray:
    """tiles.gaussian_weight() of every place of a patch."""
    d2 = [((np.arange(p) - p // 2) / (p / 8.0)) ** 2 for p in patch]
    w = 10 * np.exp(-0.5 * (d2[0][:, None, None] + d2[1][:, None] + d2[2]))
    return np.where(w == 0, w[w > 0].min() if (w > 0).any() else 5e-324, w)


def bricks(planes: DataFrame, shape: DataFrame, patch: tuple[int, int, int], ratio: float, rule: Callable = tiles.starts) -> DataFrame:
    """vol, tile_id, z0, y0, x0, brick: one row a tile, its values in an array, x fastest, as tiles.score_bricks() takes them.

    Pieces are sliced from planes by Spark's own functions and joined by tile, so voxels never become rows. `shape`: vol, nz, ny, nx, at
    least the patch along each axis.
    """
    starts = tiles.with_starts(shape.select("vol", "nz", "ny", "nx"), patch, ratio, rule).select("vol", "bz", "by", "bx")
    at = lambda k, keep=None: F.filter(F.transform(f"b{k}", lambda b, i: F.struct(i.cast("int").alias("i"), b.cast("int").alias("b"))), keep or (lambda s: F.lit(True)))
    rows = planes.join(starts, "vol").withColumn("tz", F.explode(at("z", lambda s: (s["b"] <= F.col("z")) & (F.col("z") < s["b"] + patch[0]))))
    rows = rows.withColumn("ty", F.explode(at("y"))).withColumn("tx", F.explode(at("x")))
    line = lambda ly: F.slice("data", (F.col("ty.b") + ly) * F.col("nx") + F.col("tx.b") + 1, patch[2])
    piece = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(patch[1] - 1)), line))
    tile = (F.col("tz.i") * F.size("by") + F.col("ty.i")) * F.size("bx") + F.col("tx.i")
    rows = rows.select("vol", tile.alias("tile_id"), F.col("tz.b").alias("z0"), F.col("ty.b").alias("y0"), F.col("tx.b").alias("x0"), "z", piece.alias("piece"))
    joined = F.array_sort(F.collect_list(F.struct("z", "piece")))
    return rows.groupBy("vol", "tile_id", "z0", "y0", "x0").agg(joined.alias("p")).select("vol", "tile_id", "z0", "y0", "x0", F.flatten("p.piece").alias("brick"))


def overlap_add(rows: DataFrame, patch: tuple[int, int, int], load: Callable, folds: list[int], classes: int, order: int, plan: DataFrame | None = None, tasks: int = 0) -> DataFrame:
    """vol, z, y, sums, weights, n: lines of weighted scores added up over the tiles of one slab and all folds, from slabs().

    `load(fold)` gives, once for each fold and worker, a function of (tile_id, brick of the patch's shape) to scores (classes, *patch);
    all folds' models stay loaded. A slab is resampled along z, then its tiles are scored row by row along y; lines that no later row
    of tiles covers leave, so that a task holds sums for patch_z x patch_y x width x classes numbers. Slabs are dealt by a hash, or to the
    `tasks` tasks of `plan` (tiles.tasks_by_cost() of the padded shape), which have about equal numbers of tiles.
    """
    kind = dict(rows.dtypes)["vol"]
    pz, py, px = patch

    def lines(vol, z0: int, y0: int, sums: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        depth, height = sums.shape[:2]
        n, wide = depth * height, sums.shape[2] * classes
        list_ = lambda a, step: pa.ListArray.from_arrays(pa.array(np.arange(0, n * step + 1, step, dtype=np.int32)), pa.array(a.reshape(-1)))
        z, y = np.repeat(np.arange(z0, z0 + depth, dtype=np.int32), height), np.tile(np.arange(y0, y0 + height, dtype=np.int32), depth)
        return pa.RecordBatch.from_pydict({"vol": vol.take(pa.array(np.zeros(n, np.int64))), "z": pa.array(z), "y": pa.array(y), "sums": list_(sums, wide), "weights": list_(weights, sums.shape[2]), "n": list_(counts, sums.shape[2])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, weight = {}, window(patch)
        for table, starts in _whole_groups(batches, "kz"):
            flat, lengths = _cells(table["data"])
            ends = np.cumsum(lengths)
            column = {c: table[c].to_numpy() for c in ("z", "z0", "sz_", "tz", "oz", "oy", "ox", "py", "px", "ny", "nx")}
            for lo, hi in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                one = {c: int(v[lo]) for c, v in column.items()}
                z, ny, nx, z0 = column["z"][lo:hi], one["ny"], one["nx"], one["z0"]
                if (np.diff(z) != 1).any():
                    raise ValueError("a volume is not dense: planes are missing or repeated")
                there = flat[ends[lo] - lengths[lo] : ends[hi - 1]].reshape(hi - lo, ny, nx)
                k = np.arange(z0, z0 + pz) - one["oz"]
                inside = np.flatnonzero((k >= 0) & (k < one["tz"]))
                at, w = _taps(one["sz_"], one["tz"], order, k[inside])
                used = w != 0
                if (at[used] < z[0]).any() or (at[used] > z[-1]).any():
                    raise ValueError("a volume is not dense: planes are missing at its end")
                at = np.clip(at - z[0], 0, hi - lo - 1)
                slab = np.zeros((pz, one["py"], one["px"]))
                slab[inside, one["oy"] : one["oy"] + ny, one["ox"] : one["ox"] + nx] = sum(there[at[:, j]] * w[:, j, None, None] for j in range(w.shape[1]))
                by, bx = table["by"][int(lo)].as_py(), table["bx"][int(lo)].as_py()
                sums, weights, counts = np.zeros((pz, py, one["px"], classes)), np.zeros((pz, py, one["px"])), np.zeros((pz, py, one["px"]), np.int32)
                kz, vol = table["kz"][int(lo)].as_py(), table["vol"].slice(int(lo), 1)
                for ky, y0 in enumerate(by):
                    for kx, x0 in enumerate(bx):
                        tile = (kz * len(by) + ky) * len(bx) + kx
                        for fold in folds:
                            if fold not in models:
                                models[fold] = load(fold)
                            scores = np.asarray(models[fold](tile, slab[:, y0 : y0 + py, x0 : x0 + px]), float)
                            if scores.shape != (classes, *patch):
                                raise ValueError(f"the model gave {scores.shape}, not {(classes, *patch)}")
                            sums[:, :, x0 : x0 + px] += weight[..., None] * np.moveaxis(scores, 0, -1)
                        weights[:, :, x0 : x0 + px] += weight * len(folds)
                        counts[:, :, x0 : x0 + px] += len(folds)
                    done = py if ky + 1 == len(by) else by[ky + 1] - y0
                    yield lines(vol.combine_chunks() if isinstance(vol, pa.ChunkedArray) else vol, z0, y0, sums[:, :done], weights[:, :done], counts[:, :done])
                    if done < py:
                        for a in (sums, weights, counts):
                            a[:, : py - done] = a[:, done:].copy()
                            a[:, py - done :] = 0

    dealt = rows.repartition("vol", "kz") if plan is None else rows.join(plan.select("vol", "kz", "task"), ["vol", "kz"]).repartitionById(tasks, "task").drop("task")
    dealt = dealt.sortWithinPartitions("vol", "kz", "z")
    return dealt.mapInArrow(run, f"vol {kind}, z int, y int, sums array<double>, weights array<double>, n array<int>")


def blended(parts: DataFrame, shape: DataFrame, patch: tuple[int, int, int], classes: int) -> DataFrame:
    """PLANE rows of logits (classes numbers a voxel) and n, the scores each voxel had: slabs of overlap_add() added up, padding taken off.

    `shape`: vol, tz, ty, tx, the size without padding.
    """
    kind = dict(parts.dtypes)["vol"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, "z"):
            sums, weights, counts = (_cells(table[c])[0] for c in ("sums", "weights", "n"))
            wide = _cells(table["weights"])[1]
            ends = np.cumsum(wide)
            column = {c: table[c].to_numpy() for c in ("z", "y", "oz", "oy", "ox", "ty", "tx")}
            made = []
            for lo, hi in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                px, a, b = int(wide[lo]), ends[lo] - wide[lo], ends[hi - 1]
                y = column["y"][lo:hi]
                first = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
                oy, ox, ty, tx = (int(column[c][lo]) for c in ("oy", "ox", "ty", "tx"))
                add = lambda v, w: np.add.reduceat(v.reshape(hi - lo, px * w), first, 0).reshape(len(first), px, w)[oy : oy + ty, ox : ox + tx]  # noqa: E731, B023
                plane = add(sums[a * classes : b * classes], classes) / add(weights[a:b], 1)
                made.append((int(lo), int(column["z"][lo] - column["oz"][lo]), ty, tx, plane.reshape(-1), add(counts[a:b], 1).reshape(-1)))
            list_ = lambda vs, kind_: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, vs)]).astype(np.int32)), pa.array(np.concatenate(vs).astype(kind_)))
            yield pa.RecordBatch.from_pydict({"vol": table["vol"].take(pa.array([m[0] for m in made])).combine_chunks(), **{c: pa.array([m[i] for m in made], pa.int32()) for i, c in enumerate(("z", "ny", "nx"), 1)}, "data": list_([m[4] for m in made], float), "n": list_([m[5] for m in made], np.int32)})

    offsets = [grid.offset(F.col(f"t{k}"), p).alias(f"o{k}") for k, p in zip("zyx", patch, strict=True)]
    sizes = shape.select("vol", F.col("tz").cast("int"), F.col("ty").cast("int"), F.col("tx").cast("int"), *offsets)
    rows = parts.join(sizes, "vol").filter((F.col("z") >= F.col("oz")) & (F.col("z") < F.col("oz") + F.col("tz"))).drop("tz")
    rows = rows.repartition("vol", "z").sortWithinPartitions("vol", "z", "y")
    return rows.mapInArrow(run, f"vol {kind}, z int, ny int, nx int, data array<double>, n array<int>")


def first_largest(digits: int | None = 6, bins: Sequence[int] | None = None) -> Callable:
    """Of scores (..., classes), the first largest class after rounding; with `bins`, the bin whose classes have the largest total
    probability, as classes.merged_argmax() has it."""

    def decide(scores: np.ndarray) -> np.ndarray:
        if bins is None:
            return (scores if digits is None else np.round(scores, digits)).argmax(-1).astype(np.int32)
        return _binned(np.exp(scores - scores.max(-1, keepdims=True)), bins).argmax(-1).astype(np.int32)

    return decide


def probabilities(temperature: float = 1.0, bins: Sequence[int] | None = None) -> Callable:
    """Of scores (..., classes), their softmax at a temperature, summed over bins."""
    if temperature <= 0:
        raise ValueError("the temperature must be above 0")

    def decide(scores: np.ndarray) -> np.ndarray:
        e = np.exp((scores - scores.max(-1, keepdims=True)) / temperature)
        p = e / e.sum(-1, keepdims=True)
        return p if bins is None else _binned(p, bins)

    return decide


def _binned(p: np.ndarray, bins: Sequence[int]) -> np.ndarray:
    return np.stack([p[..., [c for c, b in enumerate(bins) if b == k]].sum(-1) for k in range(max(bins) + 1)], -1)


def decided(planes: DataFrame, shape: DataFrame, classes: int, decide: Callable, value: str = "labels", order: int = 1) -> DataFrame:
    """vol, z, y, value: planes of logits resampled along z to tz of `shape` (vol, nz planes there are, tz), and what `decide` makes of each
    voxel's scores, as lines along x: labels (int), or arrays of numbers put end to end (double). Lines are dealt by y.

    Scores that are not finite end the job.
    """
    kind = dict(planes.dtypes)["vol"]
    whole = value == "labels"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, "y"):
            flat, lengths = _cells(table["line"])
            ends, tz, z = np.cumsum(lengths), table["tz"].to_numpy(), table["z"].to_numpy()
            vols, zs, ys, out = [], [], [], []
            for lo, hi in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                if (z[lo:hi] != np.arange(hi - lo)).any() or table["nz"][int(lo)].as_py() != hi - lo:
                    raise ValueError("a volume is not dense: planes are missing or repeated")
                lines = flat[ends[lo] - lengths[lo] : ends[hi - 1]].reshape(hi - lo, -1)
                if not np.isfinite(lines).all():
                    raise ValueError(f"scores of volume {table['vol'][int(lo)].as_py()} are not finite")
                fine = resample_array(lines, 0, int(tz[lo]), order).reshape(int(tz[lo]), -1, classes)
                made = decide(fine).reshape(len(fine), -1)
                vols += [int(lo)] * len(made)
                zs.append(np.arange(len(made), dtype=np.int32))
                ys += [table["y"][int(lo)].as_py()] * len(made)
                out.append(made)
            wide = np.concatenate([np.full(len(x), x.shape[1]) for x in out])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *wide]).astype(np.int32)), pa.array(np.concatenate([x.reshape(-1) for x in out])))
            yield pa.RecordBatch.from_pydict({"vol": table["vol"].take(pa.array(vols)).combine_chunks(), "z": pa.array(np.concatenate(zs)), "y": pa.array(ys, pa.int32()), value: lists})

    row = F.explode(F.transform(F.sequence(F.lit(0), F.col("ny") - 1), lambda y: F.struct(y.cast("int").alias("y"), F.slice("data", y * F.col("nx") * classes + 1, F.col("nx") * classes).alias("line"))))
    lines = planes.select("vol", "z", row.alias("r")).select("vol", "z", "r.y", "r.line")
    lines = lines.join(shape.select("vol", F.col("nz").cast("int"), F.col("tz").cast("int")), "vol").repartition("vol", "y").sortWithinPartitions("vol", "y", "z")
    return lines.mapInArrow(run, f"vol {kind}, z int, y int, {value} array<{'int' if whole else 'double'}>")


def voxels_of_lines(lines: DataFrame, value: str = "labels", name: str = "label", width: int = 0, *more: str) -> DataFrame:
    """vol, z, y, x, name of lines along x, and the columns `more` that lines carry; width > 0: so many numbers a voxel, as an array."""
    cells = F.col(value)
    if width:
        cells = F.transform(F.sequence(F.lit(0), (F.size(value) / width).cast("int") - 1), lambda i: F.slice(value, i * width + 1, width))
    return lines.select("vol", "z", "y", *more, F.posexplode(cells).alias("x", name))


def pack_lines(voxels: DataFrame, value: str = "label", name: str = "labels") -> DataFrame:
    """vol, z, y, name: the values of each line along x, in order; numbers, or arrays of numbers put end to end."""
    cells = F.array_sort(F.collect_list(F.struct("x", F.col(value).alias("v"))))
    out = voxels.groupBy("vol", F.col("z").cast("int").alias("z"), F.col("y").cast("int").alias("y")).agg(cells.alias("c"))
    nested = dict(voxels.dtypes)[value].startswith("array")
    return out.select("vol", "z", "y", (F.flatten("c.v") if nested else F.col("c.v")).alias(name))


def uncropped(lines: DataFrame, bbox: DataFrame, shape: DataFrame, background: int | list[float], value: str = "labels") -> DataFrame:
    """Lines (vol, z, y, value array) of whole crops on the full grid. `shape`: vol, nz, ny, nx; a list as `background` has a voxel's numbers.

    Background is put around each line, and lines of background are made where no line was: there is no join with the grid, since what
    lies outside the box follows from the box.
    """
    sides = bbox.join(shape.select("vol", "nz", "ny", "nx"), "vol")
    kind = dict(lines.dtypes)[value]
    fill = F.array(*map(F.lit, background if isinstance(background, list) else [background])).cast(kind)
    empty = lambda n: F.flatten(F.array_repeat(fill, n))
    moved = F.concat(empty(F.col("xlo")), F.col(value), empty(F.col("nx") - F.col("xhi")))
    inner = lines.join(sides, "vol").select("vol", (F.col("z") + F.col("zlo")).cast("int").alias("z"), (F.col("y") + F.col("ylo")).cast("int").alias("y"), moved.alias(value))
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = sides.select("*", axis("nz").alias("z")).select("*", axis("ny").alias("y"))
    inside = (F.col("z") >= F.col("zlo")) & (F.col("z") < F.col("zhi")) & (F.col("y") >= F.col("ylo")) & (F.col("y") < F.col("yhi"))
    return inner.unionByName(outer.filter(~inside).select("vol", F.col("z").cast("int"), F.col("y").cast("int"), empty(F.col("nx")).alias(value)))
