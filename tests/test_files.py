"""Files as streams: damage of every kind, bounded memory, and writing piece by piece."""

import base64
import gzip
import io
import json
import math
import struct
import tracemalloc
import zlib

import numpy as np
import pytest

from voxelith.operators import geometry
from voxelith.sources import files, jnifti, nifti
from voxelith.sources.files import Damaged, Stream

AFFINE = np.array([[2.0, 0, 0, 5], [0, 1, 0, -3], [0, 0, 1.5, 7]])


def read_all(raw, step):
    s, out = Stream(io.BytesIO(raw)), []
    while piece := s.read(step):
        out.append(piece)
    return b"".join(out), s


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_members_zeros_and_what_follows(monkeypatch, piece):
    monkeypatch.setattr(Stream, "PIECE", max(2, piece))
    a, b = np.random.default_rng(1).bytes(5000), b"b" * 70_000
    two = gzip.compress(a) + gzip.compress(b"") + gzip.compress(b)
    for step in (1000, 100_000):
        assert read_all(a, step)[0] == a
        got, s = read_all(two + b"\0" * 600, step)
        assert got == a + b and not s.trailing and s.given == len(a + b)
        got, s = read_all(two + b"\0\0junk", step)
        assert got == a + b and s.trailing
    for cut in (3, 12, 2000, len(two) - 40, len(two) - 3):
        with pytest.raises(Damaged, match="gzip_truncated"):
            read_all(two[:cut], 4096)
    with pytest.raises(Damaged, match="gzip_damaged"):
        read_all(two[:-6] + b"\1" + two[-5:], 4096)
    s = Stream(io.BytesIO(two))
    s.skip(4990)
    assert s.read(20) == (a + b)[4990:5010]
    s.skip()
    assert s.given == len(a + b) and read_all(b"", 5)[0] == b""


def test_a_header_takes_little_memory_however_large_the_file(tmp_path):
    h = nifti.header_bytes((1000, 1000, 400), AFFINE)
    path = tmp_path / "large.nii.gz"
    with gzip.open(path, "wb", compresslevel=1) as f:
        f.write(h)
        for _ in range(400):
            f.write(bytes(1_000_000))
    for whole, most in ((False, 3 << 20), (True, 12 << 20)):
        tracemalloc.start()
        row = nifti.read_header(str(path), whole)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most and row[5] == 1000
        assert row[11] == (352 + 400_000_000 if whole else None) and row[-1] is None


def spoiled(raw, *changes):
    out = bytearray(raw)
    for at, b in changes:
        out[at : at + len(b)] = b
    return bytes(out)


def test_every_damage_of_a_volume_has_a_reason(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    good = nifti.encode(a, AFFINE)
    nan, inf = struct.pack("<f", math.nan), struct.pack("<f", math.inf)
    z = gzip.compress(good)
    cases = {
        "good.nii": (good, "ok"),
        "good.nii.gz": (z, "ok"),
        "more.nii": (good + b"more", "ok"),
        "tiny.nii": (b"x", "short_file"),
        "short.nii.gz": (gzip.compress(good[:200]), "short_file"),
        "half.nii.gz": (z[: len(z) - 12], "gzip_truncated"),
        "start.nii.gz": (z[:20], "gzip_truncated"),
        "broken.nii.gz": (z[:-8] + b"abcd" + z[-4:], "gzip_damaged"),
        "junk.nii.gz": (z + b"junk", "trailing_bytes"),
        "cut.nii": (good[:-1], "truncated"),
        "cut.nii.gz": (gzip.compress(good[:-1]), "truncated"),
        "offset.nii": (spoiled(good, (108, nan)), "bad_offset"),
        "offset.nii.gz": (gzip.compress(spoiled(good, (108, inf))), "bad_offset"),
        "before.nii": (spoiled(good, (108, struct.pack("<f", -8))), "bad_offset"),
        "scale.nii": (spoiled(good, (112, nan)), "bad_scale"),
        "affine.nii": (spoiled(good, (284, nan)), "bad_affine"),
        "extent.nii": (spoiled(good, (42, struct.pack("<h", -2)), (46, struct.pack("<h", 0))), "bad_extent"),
        "order.nii": (spoiled(good, (0, struct.pack(">i", 348))), "bad_header_size"),
        "magic.nii": (spoiled(good, (344, b"xx")), "bad_magic"),
        "flat.nii": (spoiled(good, (40, struct.pack("<h", 2))), "not_3d"),
        "four.nii": (spoiled(good, (40, struct.pack("<2h", 4, 2)), (48, struct.pack("<h", 2))), "four_d"),
        "type.nii": (spoiled(good, (70, struct.pack("<h", 128))), "unsupported_type"),
    }
    for name, (raw, _) in cases.items():
        (tmp_path / name).write_bytes(raw)
    heads = geometry.header_status(nifti.headers(spark, str(tmp_path)))
    name = lambda r: r["path"].rsplit("/", 1)[1]
    scanned = nifti.scan(heads).cache()
    assert {name(r): r["status"] for r in nifti.statuses(scanned).collect()} == {k: s for k, (_, s) in cases.items()}
    planes = nifti.good_planes(scanned).collect()
    readable = {k for k, (_, s) in cases.items() if s in ("ok", "trailing_bytes")}
    assert {(name(r), r["z"]) for r in planes} == {(k, z) for k in readable for z in range(4)}
    assert all(r["data"] == a[:, :, r["z"]].T.ravel().tolist() for r in planes)
    deep = {name(r): r["status"] for r in geometry.header_status(nifti.headers(spark, str(tmp_path), whole=True)).collect()}
    assert deep == {k: "ok" if s == "trailing_bytes" else s for k, (_, s) in cases.items()}
    scanned.unpersist()


def test_scaled_values_and_classes(spark, tmp_path):
    a = np.arange(48, dtype=np.float32).reshape(2, 3, 4, 2)
    four = nifti.encode(a, AFFINE)
    (tmp_path / "p.nii").write_bytes(spoiled(four, (112, struct.pack("<2f", 2, 1))))
    (tmp_path / "l.nii").write_bytes(nifti.encode(a[..., 0], AFFINE))
    rows = nifti.voxels(nifti.slabs(spark, str(tmp_path), channels=True)).collect()
    assert len(rows) == 48 and all(r["val"] == 2 * a[r["x"], r["y"], r["z"], r["c"]] + 1 for r in rows)
    status = {r["path"][-5:]: r["status"] for r in nifti.statuses(nifti.scan(geometry.header_status(nifti.headers(spark, str(tmp_path))), True)).collect()}
    assert status == {"p.nii": "ok", "l.nii": "not_4d"}


# ---- text containers ----


def text_of(a, kind, **more):
    raw = a.astype(jnifti.NUMPY[kind]).tobytes()
    body = {"_ArrayType_": kind, "_ArraySize_": list(a.shape), "_ArrayZipType_": "zlib", "_ArrayZipData_": base64.b64encode(zlib.compress(raw)).decode()} | more
    return {"NIFTIHeader": {"Affine": AFFINE.tolist(), "Dim": list(a.shape)}, "NIFTIData": {k: v for k, v in body.items() if v is not None}}


def values(path):
    row = dict(zip([x.split()[0] for x in jnifti.HEADER.split(", ")], jnifti.read_header(str(path)), strict=True))
    return np.array(list(jnifti._planes(row))).reshape(row["array_size"])


@pytest.mark.parametrize("piece", [3, 100, 1 << 18])
def test_containers_in_any_order_and_pieces(tmp_path, monkeypatch, piece):
    monkeypatch.setattr(jnifti.Pull, "PIECE", piece)
    path, rng = tmp_path / "a.jnii", np.random.default_rng(4)
    for kind in jnifti.NUMPY:
        a = (rng.random((2, 3, 4)) * 100).astype(jnifti.NUMPY[kind])
        t = text_of(a, kind)
        t["NIFTIData"] = dict(reversed(t["NIFTIData"].items()))  # the data before its size and type
        t = {"Extra": {"deep": [1, {"x": "\\\"\u00e9"}]}, "NIFTIData": t["NIFTIData"], "NIFTIHeader": t["NIFTIHeader"], "Last": None}
        path.write_text(json.dumps(t).replace("/", "\\/"))
        assert np.array_equal(values(path), a)
        width = a.dtype.itemsize
        shuffled = np.frombuffer(a.tobytes(), "u1").reshape(-1, width).T.tobytes()
        path.write_text(json.dumps(text_of(a, kind, _ArrayShuffle_=width, _ArrayZipData_=base64.b64encode(zlib.compress(shuffled)).decode())))
        assert np.array_equal(values(path), a)
        path.write_text(json.dumps(text_of(a, kind, _ArrayZipData_=None, _ArrayData_=a.ravel().tolist()), indent=1))
        assert np.array_equal(values(path), a)
    path.write_text(json.dumps(text_of(a, kind, _ArrayZipData_=list(zlib.compress(a.tobytes())))))
    assert np.array_equal(values(path), a)
    t = text_of(a, kind)
    t["NIFTIHeader"]["Affine"] = {"_ArraySize_": [3, 4], "_ArrayData_": AFFINE.ravel().tolist(), "_ArrayType_": "single"}
    path.write_text(json.dumps(t))
    assert jnifti.read_header(str(path))[2] == AFFINE.tolist() and np.array_equal(values(path), a)


def test_every_damage_of_a_container_has_a_reason(spark, tmp_path):
    a = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    good = text_of(a, "int16")
    data = good["NIFTIData"]["_ArrayZipData_"]
    with_ = lambda **more: json.dumps(text_of(a, "int16", **more))
    text = json.dumps(good)
    cases = {
        "good": (text, "ok"),
        "blank": (" ", "bad_json"),
        "half": (text[: len(text) // 2], "bad_json"),
        "after": (text + " x", "bad_json"),
        "comma": (text.replace(", ", ",, ", 1), "bad_json"),
        "bytes": (text.replace("Dim", "\udcff").encode("utf-8", "surrogateescape"), "bad_json"),
        "list": ("[" + text + "]", "not_an_object"),
        "number": ("17", "not_an_object"),
        "deep": ('{"a": ' + "[" * 3000 + "]" * 3000 + "}", "too_deep"),
        "headless": (json.dumps({"NIFTIData": good["NIFTIData"]}), "no_header"),
        "dataless": (json.dumps({"NIFTIHeader": good["NIFTIHeader"], "NIFTIData": [1]}), "no_data"),
        "neither": (with_(_ArrayZipData_=None), "no_data"),
        "affine": (text.replace('"Affine": [[2.0', '"Affine": [["2"'), "bad_affine"),
        "typeless": (with_(_ArrayType_=None), "bad_array"),
        "sizeless": (with_(_ArraySize_=[2, "3", 4]), "bad_array"),
        "wide": (with_(_ArrayType_="int64"), "unsupported_type"),
        "flat": (with_(_ArraySize_=[6, 4]), "not_3d"),
        "none": (with_(_ArraySize_=[0, 3, 4]), "bad_extent"),
        "packing": (with_(_ArrayZipType_="lzma"), "unsupported_packing"),
        "shuffle": (with_(_ArrayShuffle_=4), "bad_shuffle"),
        "bits": (with_(_ArrayShuffle_=-2), "bad_shuffle"),
        "object": (with_(_ArrayZipData_={}), "bad_array"),
        "base64": (with_(_ArrayZipData_="*" + data[1:]), "bad_base64"),
        "padding": (with_(_ArrayZipData_=data + "A"), "bad_base64"),
        "zlib": (with_(_ArrayZipData_="AAAA" + data[4:]), "bad_zlib"),
        "stops": (with_(_ArrayZipData_=data[: len(data) // 8 * 4]), "bad_zlib"),
        "larger": (with_(_ArraySize_=[3, 3, 4]), "size_mismatch"),
        "smaller": (with_(_ArraySize_=[1, 3, 4]), "size_mismatch"),
        "fewer": (with_(_ArrayZipData_=None, _ArrayData_=[1, 2, 3]), "size_mismatch"),
        "words": (with_(_ArrayZipData_=None, _ArrayData_=["x"] * 24), "bad_number"),
    }
    for name, (raw, _) in cases.items():
        (tmp_path / f"{name}.jnii").write_bytes(raw if isinstance(raw, bytes) else raw.encode())
    name = lambda r: r["path"].rsplit("/", 1)[1][:-5]
    scanned = jnifti.scan(jnifti.headers(spark, str(tmp_path))).cache()
    assert {name(r): r["status"] for r in nifti.statuses(scanned).collect()} == {k: s for k, (_, s) in cases.items()}
    rows = jnifti.voxels(nifti.good_planes(scanned)).collect()
    assert len(rows) == 24 and all(r["val"] == a[r["x"], r["y"], r["z"]] for r in rows)
    scanned.unpersist()


def test_a_container_is_read_in_pieces(tmp_path):
    path = tmp_path / "large.jnii"
    before, after = jnifti.container((300, 400, 500), AFFINE, None, 1)
    z, left = zlib.compressobj(1), b""
    with open(path, "wb") as f:
        f.write(before)
        for i in range(300):
            left += z.compress(np.random.default_rng(i).integers(0, 256, 200_000, dtype=np.uint8).tobytes() if i < 60 else bytes(200_000))
            f.write(base64.b64encode(left[: len(left) // 3 * 3]))
            left = left[len(left) // 3 * 3 :]
        f.write(base64.b64encode(left + z.flush()) + after)
    tracemalloc.start()
    row = dict(zip([x.split()[0] for x in jnifti.HEADER.split(", ")], jnifti.read_header(str(path)), strict=True))
    n = sum(len(p) for p in jnifti._planes(row))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300 * 400 * 500 and peak < 24 << 20  # of 60 MB


# ---- writing ----


def written(spark, a, channels, vol=1, missing=0):
    rows = []
    for i in np.ndindex(*a.shape[:3]):
        if missing and sum(i) % missing == 0:
            a[i] = 0
            continue
        rows.append((vol, *map(int, i), *a.shape[:3], *AFFINE.ravel().tolist(), [float(v) for v in a[i]] if channels else int(a[i])))
    return spark.createDataFrame(rows, "vol long, i0 int, i1 int, i2 int, n0 int, n1 int, n2 int, " + ", ".join(f"{c} double" for c in geometry.AFFINE) + (", p array<double>" if channels else ", label int"))


@pytest.mark.parametrize("channels", [0, 3])
@pytest.mark.parametrize("missing", [0, 3])
def test_stitched_files_equal_whole_ones(spark, tmp_path, channels, missing):
    rng = np.random.default_rng(7)
    a = rng.random((4, 5, 6, 3)).astype(np.float32) if channels else rng.integers(0, 200, (4, 5, 6), dtype=np.uint8)
    if missing:
        a[2], a[:, :, 5] = 0, 0
    df = written(spark, a, channels, missing=missing)
    df = df.filter("i0 <> 2 and i2 <> 5") if missing else df
    df = df.unionByName(df.selectExpr("vol + 1 as vol", *df.columns[1:]))
    for suffix in (".nii", ".nii.gz"):
        paths = [r["path"] for r in nifti.export(df, str(tmp_path / "n"), suffix, channels).collect()]
        assert len(paths) == 2
        for p in paths:
            raw = open(p, "rb").read()
            assert (gzip.decompress(raw) if suffix.endswith("gz") else raw) == nifti.encode(a, AFFINE)
    for shuffle in (1, 4):
        for r in jnifti.export(df, str(tmp_path / "j"), {"0": {"Label": "x"}}, channels, shuffle).collect():
            t = json.load(open(r["path"]))
            raw = zlib.decompress(base64.b64decode(t["NIFTIData"]["_ArrayZipData_"], validate=True))
            if channels and shuffle == 4:
                assert t["NIFTIData"]["_ArrayShuffle_"] == 4
                raw = np.frombuffer(raw, "u1").reshape(4, -1).T.tobytes()
            assert raw == a.tobytes() and t["NIFTIHeader"]["_DataInfo_"] == {"LabelTable": {"0": {"Label": "x"}}}
            assert t["NIFTIHeader"]["Affine"] == AFFINE.tolist() and t["NIFTIData"]["_ArrayZipSize_"] == [1, a.size]
            assert np.array_equal(values(r["path"]), a)


def test_checksums_of_parts_give_that_of_the_whole():
    rng = np.random.default_rng(9)
    for n, m in ((0, 0), (1, 0), (0, 5), (70_000, 3), (5, 200_000)):
        a, b = rng.bytes(n), rng.bytes(m)
        assert jnifti.adler_joined(zlib.adler32(a), zlib.adler32(b), m) == zlib.adler32(a + b)


def test_a_file_appears_whole_or_not_at_all(tmp_path):
    path = str(tmp_path / "d" / "x.bin")
    with pytest.raises(RuntimeError), files.replacing(path) as f:
        f.write(b"half")
        raise RuntimeError
    assert list((tmp_path / "d").iterdir()) == []
    for body in (b"one", b"two"):
        with files.replacing(path) as f:
            f.write(body)
        assert open(path, "rb").read() == body and len(list((tmp_path / "d").iterdir())) == 1
