"""Hand-made cases and properties of the volume operators."""

import gzip
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.operators import classes, evaluate, geometry, grid, resample, tiles
from voxelith.sources import nifti


def volume(spark, a, vol=1):
    rows = [(vol, *map(int, i), float(v)) for i, v in np.ndenumerate(a) for i in [i]]
    return spark.createDataFrame(rows, "vol long, z int, y int, x int, val double")


def array(df, shape, value="val"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r[value]
    return out


def test_bbox_counts_negatives_and_falls_back_to_the_whole(spark):
    a = np.zeros((4, 5, 6))
    a[1, 2, 3], a[2, 4, 1] = -1, 2
    both = volume(spark, a).unionByName(volume(spark, np.zeros((2, 2, 2)), 2))
    got = {r["vol"]: tuple(r)[1:] for r in grid.nonzero_bbox(both).collect()}
    assert got == {1: (1, 3, 2, 5, 1, 4), 2: (0, 2, 0, 2, 0, 2)}


def test_known_tile_counts(spark):
    shape = spark.createDataFrame([(1, 340, 340, 213)], "vol long, nz int, ny int, nx int")
    tiers = [(256, 256, 192), (192, 192, 128), (128, 128, 96)]
    assert [r["tiles"] for r in tiles.workload(shape, tiers, 0.5).orderBy("tier").collect()] == [8, 27, 100]


def test_a_patch_larger_than_the_axis_has_no_starts(spark):
    shape = spark.createDataFrame([(1, 4, 8, 9)], "vol long, nz int, ny int, nx int")
    r = tiles.with_starts(shape, (8, 8, 8), 0.5).first()
    assert r["bz"] is None and r["by"] == [0] and r["bx"] == [0, 1]


def test_all_48_orientations_invert(spark):
    heads, cells = [], []
    n = (2, 3, 4)
    for k, (perm, flips) in enumerate(itertools.product(itertools.permutations(range(3)), itertools.product((1, -1), repeat=3))):
        m = np.full((3, 3), 0.05)
        for i in range(3):
            m[perm[i], i] = flips[i] * (i + 1)
        heads.append((k, *n, *[float(v) for r in range(3) for v in (*m[r], 10.0 * r)]))
        cells += [(k, *i, float(i[0] + 10 * i[1] + 100 * i[2])) for i in itertools.product(*map(range, n))]
    h = spark.createDataFrame(heads, "vol long, n0 int, n1 int, n2 int, " + ", ".join(f"{c} double" for c in geometry.AFFINE))
    v = spark.createDataFrame(cells, "vol long, i0 int, i1 int, i2 int, val double")
    axes = geometry.canonical_affine(geometry.axes_to_canonical(h)).cache()
    for r in axes.collect():
        assert sorted((r["d0"], r["d1"], r["d2"])) == [0, 1, 2]
        assert all(r[f"c{i}{i}"] > 0 for i in range(3))
    there = geometry.to_canonical(v, axes)
    back = geometry.from_canonical(there, axes)
    assert there.count() == len(cells)
    assert {tuple(r) for r in back.select("vol", "i0", "i1", "i2", "val").collect()} == set(cells)
    # a voxel keeps its place in the world
    r = axes.filter("vol = 13").first()
    one = there.filter("vol = 13 and val = 321").first()
    a = np.array([[r[f"a{i}{j}"] for j in range(4)] for i in range(3)])
    c = np.array([[r[f"c{i}{j}"] for j in range(4)] for i in range(3)])
    assert np.allclose(a @ [1, 2, 3, 1], c @ [one["x"], one["y"], one["z"], 1])


@pytest.mark.parametrize("order", [1, 3])
def test_resampling_to_the_same_shape_changes_nothing(spark, order):
    a = np.random.default_rng(1).normal(size=(3, 4, 5))
    shape = spark.createDataFrame([(1, 3, 4, 5)], "vol long, tz int, ty int, tx int")
    assert np.allclose(array(resample.resample(volume(spark, a), shape, order), a.shape), a)


def test_cubic_matches_a_plain_loop(spark):
    a, m = np.random.default_rng(2).normal(size=(1, 1, 9)), 14
    shape = spark.createDataFrame([(1, m)], "vol long, tx int")
    got = array(resample.resample_axis(volume(spark, a), shape, "x", 3), (1, 1, m))[0, 0]
    for k in range(m):
        t = (k + 0.5) * 9 / m - 0.5
        i, f = int(np.floor(t)), t - np.floor(t)
        p = [a[0, 0, min(8, max(0, i + j))] for j in (-1, 0, 1, 2)]
        want = 0.5 * (2 * p[1] + (p[2] - p[0]) * f + (2 * p[0] - 5 * p[1] + 4 * p[2] - p[3]) * f**2 + (3 * p[1] - p[0] - 3 * p[2] + p[3]) * f**3)
        assert abs(got[k] - want) < 1e-12


def test_padding_and_cropping_invert(spark):
    a = np.random.default_rng(3).normal(size=(3, 9, 4))
    v = volume(spark, a)
    shape = grid.extent(v)
    padded = grid.pad_to(v, shape, (8, 8, 8))
    assert padded.count() == 8 * 9 * 8
    assert np.allclose(array(grid.unpad(padded, shape, (8, 8, 8)), a.shape), a)


def test_blending_a_constant_gives_it_back(spark):
    v = volume(spark, np.full((8, 9, 13), 2.5))
    t = tiles.extract(v, grid.extent(v), (8, 8, 8), 0.5).withColumns({"fold": F.lit(0), "logits": F.array("val", -F.col("val"))})
    out = tiles.blend(t, (8, 8, 8), 2).collect()
    assert len(out) == 8 * 9 * 13 and all(r["complete"] and np.allclose(r["logits"], [2.5, -2.5]) for r in out)
    missing = t.unionByName(t.withColumn("fold", F.lit(1)).filter("tile_id > 0"))
    assert not all(r["complete"] for r in tiles.blend(missing, (8, 8, 8), 2).collect())


def test_merged_labels_need_not_follow_the_largest_class(spark):
    l = [-9.0] * 18
    l[3], l[1], l[6], l[7] = 1.0, 0.9, 0.9, 0.9
    r = spark.createDataFrame([(l,)], "logits array<double>").select(classes.argmax(F.col("logits")).alias("a"), classes.merged_argmax(F.col("logits")).alias("m"), classes.remap(classes.argmax(F.col("logits"))).alias("r")).first()
    assert (r["a"], r["m"], r["r"]) == (3, 0, 2)


def test_first_of_equal_maxima_wins_and_softmax_sums_to_one(spark):
    r = spark.createDataFrame([([1.0, 3.0, 3.0],)], "l array<double>").select(classes.argmax(F.col("l")).alias("a"), classes.softmax(F.col("l"), 2.0).alias("p")).first()
    assert r["a"] == 1 and abs(sum(r["p"]) - 1) < 1e-12
    with pytest.raises(ValueError):
        classes.softmax(F.col("l"), 0)


def test_dice_of_a_map_with_itself_is_one(spark):
    p = spark.range(100).select(F.lit(1).alias("vol"), (F.col("id") % 7).alias("ref"), (F.col("id") % 7).alias("pred"))
    assert {r["dice"] for r in evaluate.dice(evaluate.confusion(p)).collect()} == {1.0}


def test_damaged_files_are_set_aside(spark, tmp_path):
    good = nifti.encode(np.arange(24, dtype=np.uint8).reshape(2, 3, 4), np.eye(3, 4))
    files = {"good.nii": good, "cut.nii": good[:360], "magic.nii": good[:344] + b"xx\0\0" + good[348:], "short.nii": good[:100], "size.nii": b"\0\0\0\0" + good[4:]}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in geometry.header_status(nifti.headers(spark, str(tmp_path))).collect()}
    assert status == {"good.nii": "ok", "cut.nii": "truncated", "magic.nii": "bad_magic", "short.nii": "short_file", "size.nii": "bad_header_size"}
    rows = nifti.voxels(nifti.slabs(spark, str(tmp_path))).collect()
    assert len(rows) == 24 and all(r["val"] == np.arange(24).reshape(2, 3, 4)[r["x"], r["y"], r["z"]] for r in rows)


def test_stream_takes_each_file_once(spark, tmp_path):
    from voxelith.streaming.ingest import stream_headers

    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"v{i}.nii").write_bytes(nifti.encode(np.zeros((2, 2, 2), np.uint8), np.eye(3, 4)))
        (tmp_path / "in" / f"cut{i}.nii.gz").write_bytes(gzip.compress(b"x" * 1000)[:15])
        stream_headers(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["gzip_truncated", "gzip_truncated", "ok", "ok"]


def test_large_and_damaged_headers_are_judged(spark):
    rows = [(1, 352 + 512 * 512 * 300 * 4, 512, 512, 300, 32, 0.0), (2, 352, 512, 512, 300, 32, 352.0), (3, 400, 32767, 32767, 32767, 64, 0.0), (4, 10**9, -5, 32767, 32767, 64, 1e30)]
    h = spark.createDataFrame([(v, n, 348, "n+1", 3, 1, 16, *r) for v, n, *r in rows], "vol long, n_bytes long, sizeof_hdr int, magic string, ndim int, dim4 int, datatype int, n0 int, n1 int, n2 int, bitpix int, vox_offset double")
    got = {r["vol"]: r["status"] for r in geometry.header_status(h).collect()}
    assert got == {1: "ok", 2: "truncated", 3: "truncated", 4: "truncated"}


def test_a_model_of_the_wrong_size_is_told(spark):
    a = np.arange(64.0).reshape(4, 4, 4)
    shape = spark.createDataFrame([(1, 4, 4, 4)], "vol long, nz int, ny int, nx int")
    cut = tiles.bricks(tiles.extract(volume(spark, a), shape, (4, 4, 4), 0.5), (4, 4, 4))
    out = tiles.score_bricks(cut, (4, 4, 4), [0], lambda f: lambda t, x: np.stack([x, -x]), 2)
    assert np.array_equal(array(out.withColumn("v", F.col("logits")[1]), (4, 4, 4), "v"), -a)
    with pytest.raises(Exception, match="not \\(3, 4, 4, 4\\)"):
        tiles.score_bricks(cut, (4, 4, 4), [0], lambda f: lambda t, x: np.stack([x, -x]), 3).collect()


@pytest.mark.parametrize("channels", [0, 2])
def test_planes_of_several_sizes_over_many_batches(spark, channels):
    """Planes that span Arrow batches, several of them in one, and of two sizes, against each axis on the whole array."""
    rng, sizes, to = np.random.default_rng(5), {1: (4, 9, 7), 2: (3, 6, 8), 3: (4, 9, 7)}, {1: (5, 4, 9), 2: (6, 7, 3), 3: (5, 4, 9)}
    a = {v: rng.normal(size=(*n, channels) if channels else n) for v, n in sizes.items()}
    rows = [(v, *map(int, i), a[v][i].tolist()) for v, n in sizes.items() for i in np.ndindex(*n)]
    rows = spark.createDataFrame(rows, f"vol long, z int, y int, x int, val {'array<double>' if channels else 'double'}")
    shape = spark.createDataFrame([(v, *t) for v, t in to.items()], "vol long, tz int, ty int, tx int")
    for batch in ("10", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {(r["vol"], r["z"], r["y"], r["x"]): r["val"] for r in resample.resample(rows, shape, 3, channels=channels).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == sum(int(np.prod(t)) for t in to.values())
        for v, t in to.items():
            want = a[v]
            for axis in (2, 1, 0):
                want = resample.resample_array(want, axis, t[axis], 3)
            for i in np.ndindex(*t):
                assert np.allclose(got[(v, *i)], want[i], atol=1e-12)


def test_a_value_that_is_not_finite_spoils_only_its_neighbours(spark):
    a = np.ones((1, 3, 12))
    a[0, 1, 2] = np.nan
    shape = spark.createDataFrame([(1, 1, 3, 12)], "vol long, tz int, ty int, tx int")
    got = array(resample.resample(volume(spark, a), shape, 1), a.shape)
    assert np.isfinite(got[0, :, 6:]).all() and np.isfinite(got[0, 0]).sum() >= 10


@pytest.mark.parametrize("hole", ["y = 1 and x = 2", "x = (z + y) % 4", "y = 2", "z = 1", "x = 3", "y = 3", "z = 3", "z = 2 and y = 3"])
def test_every_hole_is_refused(spark, hole):
    """One voxel, one of each line, a line, a plane, and the last ones along each axis."""
    v = volume(spark, np.random.default_rng(8).normal(size=(4, 4, 4)))
    shape = spark.createDataFrame([(1, 4, 4, 4, 4, 5, 3)], "vol long, nz int, ny int, nx int, tz int, ty int, tx int")
    assert resample.resample(v, shape, 1).count() == 60
    with pytest.raises(Exception, match="not dense"):
        resample.resample(v.filter(f"not ({hole})"), shape, 1).collect()
    with pytest.raises(Exception, match="not dense"):
        resample.resample(v.unionByName(v.filter(hole)), shape, 3).collect()


def test_blend_counts_tiles(spark):
    """`complete` by arithmetic agrees with sets of folds and tiles, and sees a tile that one fold lacks."""
    a, patch = np.random.default_rng(6).normal(size=(4, 5, 9)), (4, 4, 4)
    shape = spark.createDataFrame([(1, 4, 5, 9)], "vol long, nz int, ny int, nx int")
    cut = tiles.extract(volume(spark, a), shape, patch, 0.5)
    scores = tiles.score_linear(cut, [(0, [1.0], [0.0]), (1, [2.0], [1.0])], 1)
    for rows in (scores, scores.filter("not (tile_id = 1 and fold = 1)")):
        two = [{tuple(r[k] for k in "zyx"): r["complete"] for r in b.collect()} for b in (tiles.blend(rows, patch, 1), tiles.blend(rows, patch, 1, shape, 0.5, 2))]
        assert len(two[0]) == a.size and two[0].keys() == two[1].keys()
        if rows is scores:
            assert all(two[0].values()) and two[0] == two[1]
        else:
            assert not all(two[1].values()) and all(two[0][k] for k, v in two[1].items() if v)
