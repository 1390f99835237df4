"""Overlapping tiles: grids, extraction, scoring and blending."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Patch = tuple[int, int, int]


def starts(n: Column, patch: Column, ratio: float) -> Column:
    """Tile starts along an axis: evenly spread, the last one flush with the end; null if the axis is shorter than the patch."""
    steps = F.ceil((n - patch) / (patch * ratio)).cast("int")
    spread = F.transform(F.sequence(F.lit(0), steps), lambda i: F.when(steps > 0, F.round(i * (n - patch) / steps)).otherwise(0).cast("int"))
    return F.when(n >= patch, spread)


def fixed_starts(n: Column, patch: Column, ratio: float) -> Column:
    """Tile starts at multiples of int(patch * ratio), and one more flush with the end if they leave something."""
    step = F.floor(patch * ratio).cast("int")
    even = F.sequence(F.lit(0), F.greatest(n - patch, F.lit(0)), step)
    last = F.element_at(even, -1)
    return F.when(last + patch < n, F.array_append(even, F.greatest(F.lit(0), n - patch))).otherwise(even)


def with_starts(shape: DataFrame, patch: Patch, ratio: float, rule: Callable = starts) -> DataFrame:
    """`shape` (vol, nz, ny, nx) with the arrays bz, by, bx of tile starts."""
    return shape.withColumns({f"b{k}": rule(F.col(f"n{k}"), F.lit(p), ratio) for k, p in zip("zyx", patch, strict=True)})


def tile_grid(shape: DataFrame, patch: Patch, ratio: float) -> DataFrame:
    """vol, tile_id, z0, y0, x0; ids in z, y, x order."""
    s = with_starts(shape, patch, ratio)
    s = s.select("vol", "by", "bx", F.posexplode("bz").alias("kz", "z0")).select("vol", "bx", "by", "kz", "z0", F.posexplode("by").alias("ky", "y0"))
    s = s.select("vol", "kz", "z0", "ky", "y0", F.size("by").alias("cy"), F.size("bx").alias("cx"), F.posexplode("bx").alias("kx", "x0"))
    return s.select("vol", ((F.col("kz") * F.col("cy") + F.col("ky")) * F.col("cx") + F.col("kx")).alias("tile_id"), "z0", "y0", "x0")


def workload(shape: DataFrame, tiers: list[Patch], ratio: float) -> DataFrame:
    """vol, tier, tiles: tiles of each volume, padded to the patch where it is smaller, at each patch size."""
    count = lambda k, p: F.size(starts(F.greatest(F.col(f"n{k}"), F.lit(p)), F.lit(p), ratio))
    rows = [F.struct(F.lit(i).alias("tier"), (count("z", t[0]) * count("y", t[1]) * count("x", t[2])).alias("tiles")) for i, t in enumerate(tiers)]
    return shape.select("vol", F.explode(F.array(*rows)).alias("r")).select("vol", "r.tier", F.col("r.tiles").cast("long").alias("tiles"))


def tasks_by_cost(shape: DataFrame, patch: Patch, ratio: float, tasks: int, rule: Callable = starts, bucket: Column | None = None) -> DataFrame:
    """vol, kz, tiles, task: rows of tiles along z, dealt to `tasks` tasks of about equal numbers of tiles; a task's rows follow each other.

    `shape`: vol, nz, ny, nx, at least the patch. Volumes stand in order of `bucket` (by default one of 1024 by a hash) and vol; the
    tiles before a row tell its task, so a large volume goes to several tasks and small ones share one. A task has at most its share and
    one row of tiles more. Only the buckets' sums are put in order in one place, and they are few.
    """
    s = with_starts(shape, patch, ratio, rule)
    bucket = F.pmod(F.xxhash64("vol"), F.lit(1024)).cast("long") if bucket is None else bucket
    s = s.select("vol", bucket.alias("bucket"), F.size("bz").alias("rows"), (F.size("by") * F.size("bx")).cast("long").alias("tiles")).withColumn("cost", F.col("rows") * F.col("tiles"))
    sums = [(r["bucket"], r["cost"]) for r in s.groupBy("bucket").agg(F.sum("cost").alias("cost")).orderBy("bucket").collect()]
    before, total = [], 0
    for b, cost in sums:
        before.append((b, total))
        total += cost
    offsets = F.broadcast(s.sparkSession.createDataFrame(before, "bucket long, before long"))
    w = Window.partitionBy("bucket").orderBy("vol").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("own", F.coalesce(F.sum("cost").over(w), F.lit(0))).join(offsets, "bucket")
    rows = s.select("vol", "tiles", (F.col("before") + F.col("own")).alias("first"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("kz"))
    place = F.col("first") + F.col("kz") * F.col("tiles")
    return rows.select("vol", "kz", "tiles", F.floor(place * tasks / max(1, total)).cast("int").alias("task"))


def _covering(k: str, p: int) -> Column:
    """(i, b) of the tile starts in b<k> whose tile covers position <k>."""
    all_ = F.transform(f"b{k}", lambda b, i: F.struct(i.alias("i"), b.alias("b")))
    return F.filter(all_, lambda s: (s["b"] <= F.col(k)) & (F.col(k) < s["b"] + p))


def extract(voxels: DataFrame, shape: DataFrame, patch: Patch, ratio: float, rule: Callable = starts) -> DataFrame:
    """vol, tile_id, lz, ly, lx, z, y, x, val: each voxel in every tile that covers it.

    The tiles along an axis that cover a position are filtered from the axis's short array of starts and
    exploded, so there is no range join.
    """
    s = with_starts(shape, patch, ratio, rule)
    rows = voxels.join(s.select("vol", "bz", "by", "bx"), "vol")
    for k, p in zip("zyx", patch, strict=True):
        rows = rows.withColumn(f"s{k}", F.explode(_covering(k, p)))
    tile = (F.col("sz.i") * F.size("by") + F.col("sy.i")) * F.size("bx") + F.col("sx.i")
    return rows.select("vol", tile.alias("tile_id"), *((F.col(k) - F.col(f"s{k}.b")).alias(f"l{k}") for k in "zyx"), "z", "y", "x", "val")


def gaussian_weight(patch: Patch) -> Column:
    """10 * exp(-d2 / 2) from the tile's middle (integer division), sigma an eighth of the patch; never zero."""
    d2 = sum((F.pow((F.col(f"l{k}") - p // 2) / (p / 8.0), 2) for k, p in zip("yx", patch[1:], strict=True)), F.pow((F.col("lz") - patch[0] // 2) / (patch[0] / 8.0), 2))
    farthest = sum(max(p // 2, p - 1 - p // 2) ** 2 / (p / 8.0) ** 2 for p in patch)
    w = 10 * F.exp(-0.5 * d2)
    least = 10 * math.exp(-0.5 * farthest) or 5e-324
    return F.when(w == 0, least).otherwise(w)


def score_linear(tiles: DataFrame, weights: list[tuple[int, list[float], list[float]]], classes: int) -> DataFrame:
    """tiles with fold and logits: w[c] * val + b[c] + 0.01 * tile_id * (c % 3) for each (fold, w, b) of `weights`.

    A scorer that needs no model, in place of a plugged-in one. The weights are literals, so folds are exploded
    in place and nothing is joined.
    """
    one = lambda w, b, c: F.lit(w[c]) * F.col("val") + F.lit(b[c]) + 0.01 * F.col("tile_id") * (c % 3)
    folds = F.array(*(F.struct(F.lit(fold).alias("fold"), F.array(*(one(w, b, c) for c in range(classes))).alias("logits")) for fold, w, b in weights))
    return tiles.withColumn("scored_", F.explode(folds)).select(*tiles.columns, "scored_.fold", "scored_.logits")


def bricks(cut: DataFrame, patch: Patch) -> DataFrame:
    """vol, tile_id, z0, y0, x0, brick: one row a tile of extract()'s rows, its values in an array, x fastest. A brick has the patch's size."""
    i = (F.col("lz") * patch[1] + F.col("ly")) * patch[2] + F.col("lx")
    first = [F.min(F.col(k) - F.col(f"l{k}")).alias(f"{k}0") for k in "zyx"]
    cells = F.array_sort(F.collect_list(F.struct(i.alias("i"), F.col("val").cast("double").alias("val"))))
    return cut.groupBy("vol", "tile_id").agg(*first, cells.getField("val").alias("brick"))


#: Bytes of scores that leave a task of score_bricks() at a time.
PIECE = 4 << 20


def score_bricks(tiles: DataFrame, patch: Patch, folds: list[int], load: Callable, classes: int) -> DataFrame:
    """vol, tile_id, fold, lz, ly, lx, z, y, x, logits of `tiles`, the rows of bricks(), from a model.

    `load(fold)` gives, once for each fold and worker, a function of (tile_id, brick of the patch's shape) to an array of the
    classes' scores, (classes, *patch). A task holds one brick's scores and PIECE bytes of planes that are about to leave, however many
    bricks it has; a row that leaves is one plane of a tile.
    """
    import numpy as np
    import pyarrow as pa

    cells, heads = patch[1] * patch[2], ["vol", "tile_id", "fold", "z0", "y0", "x0"]

    def planes(b: pa.RecordBatch, at: list[int], lz: list[int], scores: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(scores)
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, classes, dtype=np.int32)), pa.array(flat.reshape(-1)))
        outer = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, cells, dtype=np.int32)), inner)
        own = b.select(heads).take(pa.array(at))
        return pa.RecordBatch.from_arrays([*own.columns, pa.array(lz, pa.int32()), outer], [*heads, "lz", "logits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, model = None, None
        for b in batches:
            at, lz, scores, size = [], [], [], 0
            for i, (f, tile) in enumerate(zip(b["fold"].to_pylist(), b["tile_id"].to_pylist(), strict=True)):
                if model is None or f != fold:
                    fold, model = f, load(int(f))
                brick = np.array(b["brick"][i].values.to_numpy(zero_copy_only=False), float)
                out = np.asarray(model(int(tile), brick.reshape(patch)), float)
                if out.shape != (classes, *patch):
                    raise ValueError(f"the model gave {out.shape}, not {(classes, *patch)}")
                for k in range(patch[0]):
                    at.append(i)
                    lz.append(k)
                    scores.append(out[:, k].reshape(classes, -1).T)
                    size += scores[-1].nbytes
                    if size >= PIECE:
                        yield planes(b, at, lz, scores)
                        at, lz, scores, size = [], [], [], 0
            if at:
                yield planes(b, at, lz, scores)

    rows = tiles.withColumn("fold", F.explode(F.array(*map(F.lit, folds))))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in heads) + ", lz int, logits array<array<double>>"
    scored = score_with(rows, run, schema).select(*heads, "lz", F.posexplode("logits").alias("i", "logits"))
    scored = scored.withColumns({"ly": F.floor(F.col("i") / patch[2]).cast("int"), "lx": F.col("i") % patch[2]})
    return scored.select("vol", "tile_id", "fold", "lz", "ly", "lx", *((F.col(f"{k}0") + F.col(f"l{k}")).alias(k) for k in "zyx"), "logits")


def score_with(bricks: DataFrame, scorer: Callable, schema: str) -> DataFrame:
    """Plug-in scoring: `scorer` maps an iterator of Arrow batches of bricks (with a fold column) to batches of `schema`.

    Rows are dealt by fold and brick, sorted by fold, so that a worker holds one fold's model at a time while
    all workers share the work of each fold.
    """
    return bricks.repartition("fold", "vol", "tile_id").sortWithinPartitions("fold").mapInArrow(scorer, schema)


def channel_check(rows: DataFrame, classes: int) -> DataFrame:
    """How many rows have the number of classes that the caller expects, and how many do not."""
    return rows.groupBy((F.size("logits") == classes).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


def blend(scores: DataFrame, patch: Patch, classes: int, shape: DataFrame | None = None, ratio: float = 0.5, folds: int = 0, rule: Callable = starts) -> DataFrame:
    """vol, z, y, x, logits, complete: Gaussian-weighted sums over tiles, averaged over folds.

    Sums over one fold's weights normalise all folds, so `complete` says whether every fold scored every tile. With `shape`
    (vol, nz, ny, nx), `ratio`, `rule` and the number of `folds` that made the tiles, it compares a plain count with the number of
    tiles that cover the voxel; without them, folds and tiles are collected as sets, which costs more.
    """
    s = scores.withColumn("wt", gaussian_weight(patch))
    seen = [] if shape is not None else [F.size(F.collect_set("fold")).alias("folds"), F.size(F.collect_set("tile_id")).alias("tiles")]  # countDistinct would multiply all rows
    sums = [F.sum(F.col("wt") * F.col("logits")[c]).alias(f"l{c}") for c in range(classes)]
    s = s.groupBy("vol", "z", "y", "x").agg(*sums, F.sum("wt").alias("all_wt"), F.count(F.lit(1)).alias("n"), *seen)
    s = s.withColumn("complete", F.col("n") == F.col("folds") * F.col("tiles")) if seen else with_coverage(s, shape, patch, ratio, folds, rule)
    return s.select("vol", "z", "y", "x", F.array(*(F.col(f"l{c}") / F.col("all_wt") for c in range(classes))).alias("logits"), "complete")


def with_coverage(rows: DataFrame, shape: DataFrame, patch: Patch, ratio: float, folds: int, rule: Callable = starts) -> DataFrame:
    """`rows` (vol, z, y, x, n) with `complete`: whether n scores are what `folds` folds of all tiles that cover the voxel give."""
    out = rows.join(with_starts(shape, patch, ratio, rule).select("vol", "bz", "by", "bx"), "vol")
    expected = F.lit(folds)
    for k, p in zip("zyx", patch, strict=True):
        expected = expected * F.size(_covering(k, p))
    return out.withColumn("complete", F.col("n") == expected).drop("bz", "by", "bx")


def blend_uniform(scores: DataFrame, classes: int) -> DataFrame:
    """vol, z, y, x, logits: the plain mean of all tiles that cover a voxel."""
    return scores.groupBy("vol", "z", "y", "x").agg(F.array(*(F.avg(F.col("logits")[c]) for c in range(classes))).alias("logits"))
