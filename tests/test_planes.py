"""Planes, slabs and runs against the voxel forms and plain loops."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.operators import evaluate, grid, jobs, planes, resample, tiles
from voxelith.plans.flagship import linear_model

VOX = "vol long, z int, y int, x int, val double"


def volumes(spark, arrays):
    return spark.createDataFrame([(v, *map(int, i), float(a[i])) for v, a in arrays.items() for i in np.ndindex(*a.shape)], VOX)


def test_packing_is_undone_and_refuses_holes(spark):
    rng = np.random.default_rng(1)
    v = volumes(spark, {1: rng.normal(size=(2, 3, 5)), 2: rng.normal(size=(1, 1, 1))})
    assert {tuple(r) for r in planes.unpack(planes.pack(v)).collect()} == {tuple(r) for r in v.collect()}
    for bad in (v.filter("not (y = 1 and x = 2)"), v.unionByName(v.filter("z = 0 and y = 0"))):
        with pytest.raises(Exception, match="not dense"):
            planes.pack(bad).collect()


def test_box_and_moments_in_one_scan(spark):
    rng = np.random.default_rng(2)
    a = {1: np.zeros((4, 5, 6)), 2: rng.normal(1e6, 1, size=(3, 4, 5)), 3: np.zeros((3, 3, 3)), 4: np.zeros((5, 5, 5))}
    a[1][1:3, 2:5, 3] = rng.normal(size=(2, 3))
    a[4][2, 2, 2] = -7
    v = volumes(spark, a)
    got = {r["vol"]: r for r in planes.measured(v).collect()}
    box = {r["vol"]: r for r in grid.nonzero_bbox(v).collect()}
    for vol, x in a.items():
        b = box[vol]
        assert all(got[vol][c] == b[c] for c in b.asDict())
        inner = x[b["zlo"] : b["zhi"], b["ylo"] : b["yhi"], b["xlo"] : b["xhi"]]
        assert np.isclose(got[vol]["mean_"], inner.mean(), rtol=1e-12) and np.isclose(got[vol]["sd_"], inner.std(), rtol=1e-7, atol=1e-12)


@pytest.mark.parametrize("patch", [(4, 4, 4), (3, 5, 4)])
def test_slabs_blend_like_voxels(spark, patch):
    """Resampled, padded, tiled, scored and blended by slabs and by voxels: volumes of several sizes, some smaller than the patch."""
    rng, order, classes, ratio = np.random.default_rng(3), 3, 2, 0.5
    a = {1: rng.normal(size=(5, 6, 7)), 2: rng.normal(size=(2, 9, 3)), 3: rng.normal(size=(6, 2, 11))}
    to = {1: (8, 6, 5), 2: (3, 7, 4), 3: (9, 3, 9)}
    v = volumes(spark, a)
    shape = spark.createDataFrame([(i, *a[i].shape, *to[i]) for i in a], "vol long, nz int, ny int, nx int, tz int, ty int, tx int")
    weights = [(f, rng.normal(size=classes).tolist(), rng.normal(size=classes).tolist()) for f in range(3)]
    load = linear_model(weights, classes)
    parts = planes.overlap_add(planes.slabs(planes.resized(planes.pack(v), shape, order), shape, patch, ratio, order), patch, load, [0, 1, 2], classes, order)
    out = planes.blended(parts, shape, patch, classes).collect()

    net = shape.select("vol", *(F.col(f"t{k}").alias(f"n{k}") for k in "zyx"))
    padded = net.select("vol", *(F.greatest(F.col(f"n{k}"), F.lit(p)).alias(f"n{k}") for k, p in zip("zyx", patch, strict=True)))
    cut = tiles.extract(grid.pad_to(resample.resample(v, shape, order), net, patch), padded, patch, ratio)
    flat = tiles.blend(tiles.score_linear(cut, weights, classes), patch, classes, padded, ratio, 3)
    want = {(r["vol"], r["z"], r["y"], r["x"]): r["logits"] for r in grid.unpad(flat.select("vol", "z", "y", "x", "logits"), net, patch).collect()}
    assert len(out) == sum(t[0] for t in to.values())
    for r in out:
        data = np.array(r["data"]).reshape(r["ny"], r["nx"], classes)
        for y, x in np.ndindex(r["ny"], r["nx"]):
            assert np.allclose(data[y, x], want.pop((r["vol"], r["z"], y, x)), atol=1e-9)
        assert min(r["n"]) >= 3 and len(r["n"]) == r["ny"] * r["nx"]
    assert not want
    back = shape.select("vol", F.col("tz").alias("nz"), *(F.col(f"n{k}").alias(f"t{k}") for k in "zyx"))
    blended = planes.blended(parts, shape, patch, classes)
    lines = planes.decided(planes.resized(blended, back, 1, classes), back, classes, planes.first_largest()).collect()
    voxels = spark.createDataFrame([(k[0], *k[1:], list(map(float, d))) for r in out for (k, d) in [((r["vol"], r["z"], i // r["nx"], i % r["nx"]), r["data"][classes * i : classes * i + classes]) for i in range(r["ny"] * r["nx"])]], "vol long, z int, y int, x int, logits array<double>")
    own = {(r["vol"], r["z"], r["y"], r["x"]): int(np.round(r["logits"], 6).argmax()) for r in resample.resample(voxels, back, 1, "logits", classes).collect()}
    assert {(r["vol"], r["z"], r["y"], x): l for r in lines for x, l in enumerate(r["labels"])} == own


def test_slabs_give_a_constant_back_and_check_the_model(spark):
    a = {1: np.full((9, 8, 13), 2.5)}
    shape = spark.createDataFrame([(1, 9, 8, 13, 9, 8, 13)], "vol long, nz int, ny int, nx int, tz int, ty int, tx int")
    rows = planes.slabs(planes.resized(planes.pack(volumes(spark, a)), shape, 1), shape, (4, 4, 4), 0.5, 1)
    parts = planes.overlap_add(rows, (4, 4, 4), lambda f: lambda t, b: np.stack([b, -b]), [0], 2, 1)
    for r in planes.blended(parts, shape, (4, 4, 4), 2).collect():
        assert np.allclose(np.array(r["data"]).reshape(-1, 2), [2.5, -2.5])
    with pytest.raises(Exception, match="the model gave"):
        planes.overlap_add(rows, (4, 4, 4), lambda f: lambda t, b: b[None], [0], 2, 1).collect()
    for hole in ("z <> 4", "z <> 8"):
        with pytest.raises(Exception, match="not dense"):
            planes.overlap_add(rows.filter(hole), (4, 4, 4), lambda f: lambda t, b: np.stack([b, -b]), [0], 2, 1).collect()


def test_bricks_of_planes_are_those_of_voxels(spark):
    rng = np.random.default_rng(4)
    a = {1: rng.normal(size=(5, 6, 7)), 2: rng.normal(size=(4, 4, 9))}
    v, patch = volumes(spark, a), (4, 4, 4)
    shape = grid.extent(v)
    old = {(r["vol"], r["tile_id"]): (r["z0"], r["y0"], r["x0"], r["brick"]) for r in tiles.bricks(tiles.extract(v, shape, patch, 0.5), patch).collect()}
    new = {(r["vol"], r["tile_id"]): (r["z0"], r["y0"], r["x0"], r["brick"]) for r in planes.bricks(planes.pack(v), shape, patch, 0.5).collect()}
    assert old == new and len(new) > 4
    plan = planes.bricks(planes.pack(v), shape, patch, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_lines_are_put_back_without_a_grid_join(spark):
    full = {1: (4, 5, 6), 2: (3, 3, 3)}
    shape = spark.createDataFrame([(v, *n) for v, n in full.items()], "vol long, nz int, ny int, nx int")
    bbox = spark.createDataFrame([(1, 1, 3, 0, 5, 2, 6), (2, 0, 3, 0, 3, 0, 3)], "vol long, zlo int, zhi int, ylo int, yhi int, xlo int, xhi int")
    inner = [(1, z, y, x) for z in range(2) for y in range(5) for x in range(4)] + [(2, z, y, x) for z in range(3) for y in range(3) for x in range(3)]
    labels = spark.createDataFrame([(*k, 10 + sum(k)) for k in inner], "vol long, z int, y int, x int, label int")
    lines = planes.uncropped(planes.pack_lines(labels), bbox, shape, 5)
    got = {(r["vol"], r["z"], r["y"], x): v for r in lines.collect() for x, v in enumerate(r["labels"])}
    want = {(v, *i): 5 for v, n in full.items() for i in np.ndindex(*n)} | {(v, z + (v == 1), y, x + 2 * (v == 1)): 10 + v + z + y + x for v, z, y, x in inner}
    assert got == want
    assert {(r["vol"], r["z"], r["y"], r["x"]): r["label"] for r in grid.uncrop_labels(labels, bbox, shape, 5).collect()} == want
    tpm = labels.select("vol", "z", "y", "x", F.array(F.col("label") / 100, 1 - F.col("label") / 100).alias("p"))
    probabilities = planes.uncropped(planes.pack_lines(tpm, "p", "p"), bbox, shape, [0.0, 1.0], "p")
    for r in probabilities.collect():
        for x, p in enumerate(np.array(r["p"]).reshape(-1, 2)):
            l = want[r["vol"], r["z"], r["y"], x]
            assert np.allclose(p, [0, 1] if l == 5 else [l / 100, 1 - l / 100])
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan


def test_maps_are_compared_run_by_run(spark):
    rng = np.random.default_rng(5)
    rows = {"a": [], "b": []}
    for vol in (1, 2, 3):
        for name in rows:
            for z, y, x in np.ndindex(3, 6, 7):
                if vol == 3 and (name == "a") == (z == 1) or rng.random() < (0.2 if vol == 2 else 0):
                    continue
                rows[name].append((vol, z, y, x, int(rng.integers(0, 3)) if vol < 3 else (y * 7 + x) // 10))
    rows["a"].append((1, 9, 0, 0, None))
    rows["a"].append((1, 0, 0, 0, 99))  # a place given twice: the smaller label counts
    schema = "vol long, z int, y int, x int, label int"
    a, b = (evaluate.runs(spark.createDataFrame(r, schema), F.lit(7)) for r in rows.values())
    long = [r for r in a.filter("vol = 3").collect()]
    assert all(len(r["runs"]) == 5 for r in long) and len(long) == 2
    got = Counter({(r["vol"], r["ref"], r["pred"]): r["n"] for r in evaluate.compared(a, b).collect()})
    sides = [{}, {}]
    for side, name in zip(sides, rows, strict=True):
        for *k, l in rows[name]:
            if l is not None:
                side[tuple(k)] = min(l, side.get(tuple(k), l))
    want = Counter((k[0], sides[0].get(k), sides[1].get(k)) for k in sides[0].keys() | sides[1].keys())
    assert got == want
    empty = evaluate.runs(spark.createDataFrame([], schema), F.lit(7))
    assert evaluate.compared(empty, empty).collect() == []
    assert sum(r["n"] for r in evaluate.compared(a, empty).collect()) == len(sides[0])


def test_median_by_refinement_equals_sorting(spark):
    rng = np.random.default_rng(6)
    groups = {
        "even": rng.normal(size=1000).tolist(),
        "odd": rng.exponential(size=1001).tolist(),
        "scales": (10.0 ** rng.uniform(-320, 300, 1500)).tolist(),
        "ties": [1.0] * 700 + rng.random(600).tolist(),
        "one": [4.0] * 900,
        "two": [1.0, 2.0],
        "zeros": [0.0] * 500 + [5e-324] * 500 + [1e308] * 501,
        "signs": (rng.normal(size=999) * 10.0 ** rng.uniform(-30, 300, 999)).tolist(),
        "wild": [float("inf")] * 300 + [float("nan")] * 30 + rng.random(500).tolist(),
        "lost": [float("nan")] * 20 + [1.0] * 5,
        "low": [float("-inf")] * 9 + [1.0],
        "near": (1 + rng.integers(0, 900, 1200) * 2.0**-52).tolist(),
        None: rng.random(301).tolist(),
    }
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("two", None)], "g string, v double").repartition(3)
    for most in (50, 10_000):
        got = {r["g"]: r["median"] for r in evaluate.exact_median(rows, "g", "v", most).collect()}
        assert got.keys() == groups.keys()
        for k, vs in groups.items():
            s = sorted(vs, key=lambda v: (v != v, v))
            want = s[(len(s) - 1) // 2] * 0.5 + s[len(s) // 2] * 0.5 if s[(len(s) - 1) // 2] != s[len(s) // 2] else s[len(s) // 2]
            assert got[k] == want or (got[k] != got[k] and want != want) or abs(got[k] - want) <= 1e-15 * abs(want), (k, got[k], want)


def test_folds_are_0_to_9(spark):
    job = lambda f: spark.createDataFrame([(1, f)], "job_id int, folds string")
    assert [r["model"] for r in jobs.expand_folds(job("0,9,,my_12.onnx")).collect()] == ["fold_0_fp16.onnx", "fold_9_fp16.onnx", "my_12.onnx"]
    for bad in ("12", "-1", "3,10", "1.5"):
        with pytest.raises(Exception, match="folds are 0 to 9"):
            jobs.expand_folds(job(bad)).collect()
        assert jobs.expand_folds(job(bad), strict=False).filter("model is null").count() == 1


def test_tasks_have_equal_work(spark):
    rng = np.random.default_rng(7)
    rows = [(v, *map(int, rng.integers(8, 60 if v % 10 else 300, 3))) for v in range(300)]
    shape = spark.createDataFrame(rows, "vol long, nz int, ny int, nx int")
    plan = tiles.tasks_by_cost(shape, (8, 8, 8), 0.5, 20).collect()
    work = Counter()
    for r in plan:
        work[r["task"]] += r["tiles"]
    tiles_of = {r["vol"]: r["tiles"] for r in tiles.workload(shape, [(8, 8, 8)], 0.5).collect()}
    assert sum(work.values()) == sum(tiles_of.values()) and set(work) == set(range(20))
    share = sum(work.values()) / 20
    most = max(r["tiles"] for r in plan)
    assert all(abs(w - share) <= most for w in work.values())
    assert max(work.values()) <= 1.5 * np.median(list(work.values()))
    assert max(tiles_of.values()) > share  # a volume that is more than a task's share is cut


def test_slabs_go_to_the_tasks_of_a_plan(spark):
    rng = np.random.default_rng(8)
    a = {v: rng.normal(size=(8 + 4 * (v % 3), 9, 8)) for v in range(6)}
    shape = spark.createDataFrame([(v, *x.shape, *x.shape) for v, x in a.items()], "vol long, nz int, ny int, nx int, tz int, ty int, tx int")
    rows = planes.slabs(planes.resized(planes.pack(volumes(spark, a)), shape, 1), shape, (4, 4, 4), 0.5, 1)
    load = linear_model([(0, [1.0, 2.0], [0.0, 1.0])], 2)
    plan = tiles.tasks_by_cost(shape, (4, 4, 4), 0.5, 5)
    one, two = (planes.blended(planes.overlap_add(rows, (4, 4, 4), load, [0], 2, 1, *more), shape, (4, 4, 4), 2) for more in ((), (plan, 5)))
    assert {(r["vol"], r["z"]): r["data"] for r in one.collect()} == {(r["vol"], r["z"]): r["data"] for r in two.collect()}
    dealt = planes.overlap_add(rows, (4, 4, 4), load, [0], 2, 1, plan, 5)
    assert dealt.rdd.getNumPartitions() == 5
