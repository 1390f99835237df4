"""The job from folder to folder: orientations, formats, class sets, probabilities and the finer grid."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.operators import geometry, grid, resample, tiles
from voxelith.operators.classes import AIR, MERGE_18_TO_6
from voxelith.plans.flagship import Plan, linear_model
from voxelith.plans.segment_files import read_folder, segment_folder
from voxelith.sources import jnifti, nifti

PATCH = (4, 4, 4)
#: Axes of the file -> world axes, and signs.
TURNED = {"a.nii.gz": ((2, 0, 1), (1, -1, 1)), "b.jnii": ((1, 0, 2), (-1, -1, 1)), "c.nii": ((0, 1, 2), (1, 1, 1))}
SIZE = {"a.nii.gz": (6, 7, 9), "b.jnii": (5, 8, 6), "c.nii": (7, 4, 5)}  # in the world: x, y, z
SPACING = (0.8, 1.0, 1.5)


def world(name):
    """Values by (z, y, x): an object in the middle of nothing."""
    rng = np.random.default_rng(len(name))
    a = np.zeros(SIZE[name][::-1])
    a[1:-1, 1:, 1:-1] = np.round(rng.random(a[1:-1, 1:, 1:-1].shape) * 50 + 1)
    return a


def own_axes(a, name):
    """(z, y, x) -> the file's axes, and its affine."""
    d, g = TURNED[name]
    b = a.transpose(2, 1, 0).transpose(d)
    for i in range(3):
        if g[i] < 0:
            b = np.flip(b, i)
    affine = np.zeros((3, 4))
    for i in range(3):
        affine[d[i], i] = g[i] * SPACING[d[i]]
        affine[d[i], 3] = 3.0 * d[i] + (0 if g[i] > 0 else SPACING[d[i]] * (SIZE[name][d[i]] - 1))
    return b, affine


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("images")
    for name in TURNED:
        b, affine = own_axes(world(name), name)
        if name.endswith(".jnii"):
            cells = [(1, *map(int, i), *b.shape, *affine.ravel().tolist(), float(b[i])) for i in np.ndindex(*b.shape)]
            rows = spark.createDataFrame(cells, "vol long, i0 int, i1 int, i2 int, n0 int, n1 int, n2 int, " + ", ".join(f"{c} double" for c in geometry.AFFINE) + ", val double")
            jnifti.export(rows, str(top / "sub"), name="double").collect()
            (top / "sub" / "vol-1.jnii").rename(top / name)
        else:
            raw = nifti.header_bytes(b.shape, affine, 64) + b.astype("<f8").tobytes(order="F")
            (top / name).write_bytes(gzip.compress(raw) if name.endswith("gz") else raw)
    (top / "bad.nii.gz").write_bytes((top / "a.nii.gz").read_bytes()[:-30])
    (top / "bad.jnii").write_text("{}")
    return str(top)


def model(classes):
    rng = np.random.default_rng(1)
    return [(f, (rng.normal(size=classes) / 20).tolist(), rng.normal(size=classes).tolist()) for f in range(2)]


def by_voxels(spark, plan, upsample):
    """{file: (z, y, x) -> logits} of the box on its own grid, or at the plan's spacing and in its place on the whole grid; and the boxes."""
    names = sorted(TURNED)
    cells = [(k, *map(int, i), float(world(n)[i])) for k, n in enumerate(names) for i in np.ndindex(*world(n).shape)]
    v = spark.createDataFrame(cells, "vol long, z int, y int, x int, val double")
    meta = spark.createDataFrame([(k, *SIZE[n][::-1], *SPACING[::-1]) for k, n in enumerate(names)], "vol long, nz int, ny int, nx int, sz double, sy double, sx double")
    bbox = grid.nonzero_bbox(v)
    crop = grid.crop(v, bbox)
    shape = grid.target_shape(bbox.join(meta, "vol").select("vol", *((F.col(f"{k}hi") - F.col(f"{k}lo")).alias(f"n{k}") for k in "zyx"), "sz", "sy", "sx"), plan.spacing)
    net = shape.select("vol", *(F.col(f"t{k}").alias(f"n{k}") for k in "zyx"))
    padded = net.select("vol", *(F.greatest(F.col(f"n{k}"), F.lit(p)).alias(f"n{k}") for k, p in zip("zyx", plan.patch, strict=True)))
    cut = tiles.extract(grid.pad_to(resample.resample(grid.zscore(crop), shape, 3), net, plan.patch), padded, plan.patch, plan.ratio)
    out = tiles.blend(tiles.score_linear(cut, model(plan.classes), plan.classes), plan.patch, plan.classes, padded, plan.ratio, 2).select("vol", "z", "y", "x", "logits")
    out = grid.unpad(out, net, plan.patch)
    if upsample:
        out = grid.place_upsampled(out, bbox, meta, plan.spacing)
    else:
        back = shape.select("vol", *(F.col(f"n{k}").alias(f"t{k}") for k in "zyx"))
        out = resample.resample(out, back, 1, "logits", plan.classes)
        out = out.join(bbox, "vol").select("vol", *((F.col(k) + F.col(f"{k}lo")).alias(k) for k in "zyx"), "logits")
    found = {n: {} for n in names}
    for r in out.collect():
        found[names[r["vol"]]][r["z"], r["y"], r["x"]] = np.array(r["logits"])
    return found


def read_back(report, canonical=False):
    """{file: array by (z, y, x[, class])} and affines of what a job wrote."""
    out, affines = {}, {}
    for r in report:
        if r["out_path"] is None:
            continue
        name, path = r["path"].rsplit("/", 1)[1], r["out_path"]
        if path.endswith(".jnii"):
            h = dict(zip([x.split()[0] for x in jnifti.HEADER.split(", ")], jnifti.read_header(path), strict=True))
            assert h["status"] == "ok"
            b, affine = np.array(list(jnifti._planes(h))).reshape(h["array_size"]), np.array(h["affine"])[:3]
        else:
            raw = open(path, "rb").read()
            raw = gzip.decompress(raw) if path.endswith(".gz") else raw
            h = dict(zip([x.split()[0] for x in nifti.HEADER.split(", ")], nifti.parse_header(path, raw, len(raw)), strict=True))
            shape = (h["n0"], h["n1"], h["n2"]) + ((h["dim4"],) if h["ndim"] == 4 else ())
            b = np.frombuffer(raw, nifti.NUMPY[h["datatype"]], offset=352).reshape(shape, order="F")
            affine = np.array([[h[f"s{i}{j}"] for j in range(4)] for i in range(3)])
        if not canonical:
            d, g = TURNED[name]
            for i in range(3):
                if g[i] < 0:
                    b = np.flip(b, i)
            b = b.transpose(*np.argsort(d), *range(3, b.ndim))
        out[name], affines[name] = b.transpose(2, 1, 0, *range(3, b.ndim)), affine
    return out, affines


STATUS = {"a.nii.gz": "ok", "b.jnii": "ok", "c.nii": "ok", "bad.nii.gz": "gzip_truncated", "bad.jnii": "no_header"}


def test_a_folder_is_read_once_for_all_formats(spark, folder):
    volumes, voxels, report = read_folder(spark, folder)
    assert {r["path"].rsplit("/", 1)[1]: r["status"] for r in report.collect()} == STATUS
    of = {r["vol"]: r["path"].rsplit("/", 1)[1] for r in volumes.collect()}
    assert sorted(of.values()) == sorted(TURNED)
    rows = voxels.collect()
    assert len(rows) == sum(int(np.prod(s)) for s in SIZE.values())
    for r in rows:
        assert own_axes(world(of[r["vol"]]), of[r["vol"]])[0][r["i0"], r["i1"], r["i2"]] == r["val"]


@pytest.mark.parametrize("suffix", [".nii.gz", ".jnii"])
def test_labels_and_merged_labels(spark, folder, tmp_path, suffix):
    for bins, background in ((None, 0), (MERGE_18_TO_6, AIR)):
        plan = Plan(patch=PATCH, folds=(0, 1), classes=18, bins=bins, background=background)
        report = segment_folder(spark, folder, str(tmp_path / str(background)), linear_model(model(18), 18), plan, suffix).collect()
        assert {r["path"].rsplit("/", 1)[1]: r["status"] for r in report} == STATUS
        got, affines = read_back(report)
        assert sorted(got) == sorted(TURNED)
        for name, logits in by_voxels(spark, plan, False).items():
            assert np.allclose(affines[name], own_axes(world(name), name)[1], atol=1e-6) and got[name].shape == SIZE[name][::-1]
            wrong = 0
            for i in np.ndindex(*got[name].shape):
                l = logits.get(i)
                e = None if l is None else np.exp(l - l.max())
                want = background if l is None else int(l.argmax()) if bins is None else int(np.array([e[[c for c, b in enumerate(bins) if b == k]].sum() for k in range(6)]).argmax())
                wrong += got[name][i] != want
            assert wrong == 0


@pytest.mark.parametrize("suffix,shuffle", [(".nii", 1), (".jnii", 4)])
def test_probabilities(spark, folder, tmp_path, suffix, shuffle):
    plan = Plan(patch=PATCH, folds=(0, 1), classes=18, bins=MERGE_18_TO_6, background=AIR, probabilities=True, temperature=2.0)
    got, _ = read_back(segment_folder(spark, folder, str(tmp_path), linear_model(model(18), 18), plan, suffix, shuffle).collect())
    for name, logits in by_voxels(spark, plan, False).items():
        assert got[name].shape == (*SIZE[name][::-1], 6) and np.allclose(got[name].sum(-1), 1, atol=1e-6)
        for i in np.ndindex(*SIZE[name][::-1]):
            want = np.eye(6)[AIR]
            if i in logits:
                e = np.exp((logits[i] - logits[i].max()) / 2)
                want = np.array([(e / e.sum())[[c for c, b in enumerate(MERGE_18_TO_6) if b == k]].sum() for k in range(6)])
            assert np.allclose(got[name][i], want, atol=1e-6)


def test_the_whole_grid_at_the_models_spacing(spark, folder, tmp_path):
    plan = Plan(patch=PATCH, folds=(0, 1), classes=3, upsample=True, background=0)
    got, affines = read_back(segment_folder(spark, folder, str(tmp_path), linear_model(model(3), 3), plan).collect(), canonical=True)
    for name, logits in by_voxels(spark, plan, True).items():
        shape = tuple(int(np.floor(n * s / 0.75 + 0.5)) for n, s in zip(SIZE[name][::-1], SPACING[::-1], strict=True))
        assert got[name].shape == shape
        assert np.allclose(affines[name][:, :3], np.eye(3) * 0.75, atol=1e-6)
        assert np.allclose(affines[name][:, 3], [3.0 * i + 0.5 * (0.75 - SPACING[i]) for i in range(3)], atol=1e-5)
        for i in np.ndindex(*shape):
            assert got[name][i] == (logits[i].argmax() if i in logits else 0)


def test_folders_are_compared_whatever_the_format(spark, folder, tmp_path):
    from voxelith.plans.compare_files import compared_folders

    plan = Plan(patch=PATCH, folds=(0, 1), classes=3)
    load = linear_model(model(3), 3)
    for side, suffix in (("x", ".nii"), ("y", ".jnii")):
        segment_folder(spark, folder, str(tmp_path / side), load, plan, suffix).collect()
    report, dice = compared_folders(spark, str(tmp_path / "x"), str(tmp_path / "y"))
    rows = report.collect()
    assert len(rows) == 3 and all(r["verdict"] == "PASS" and r["agreement"] == 1 and r["worst"] == 1 for r in rows)
    assert sorted(r["voxels"] for r in rows) == sorted(int(np.prod(s)) for s in SIZE.values())
    assert sum(r["n_both"] for r in dice.collect()) == sum(r["voxels"] for r in rows)


def test_files_are_segmented_as_they_arrive(spark, folder, tmp_path):
    import shutil

    from voxelith.streaming.segment import stream_segment

    (tmp_path / "in").mkdir()
    for names in (["a.nii.gz", "bad.nii.gz"], ["c.nii"], []):
        for n in names:
            shutil.copy(f"{folder}/{n}", tmp_path / "in" / n)
        stream_segment(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "report"), str(tmp_path / "ck"), linear_model(model(3), 3), Plan(patch=PATCH, folds=(0,), classes=3)).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "report")).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["status"], r["batch"]) for r in rows} == {("a.nii.gz", "ok", 0), ("bad.nii.gz", "gzip_truncated", 0), ("c.nii", "ok", 1)}
    assert len(list((tmp_path / "out").iterdir())) == 2 and len({r["out_path"] for r in rows}) == 3
