"""NIfTI-1 files: single-file and header-and-image magic, little-endian, three dimensions (or four, one float a class).

Files are read as streams: a header takes the first 348 bytes, however large or packed the file is, and planes leave one by one while the
file unpacks. A file that cannot be read gives a row with the reason and never ends a job. Files are written plane by plane: planes
are packed where they are, and one task joins a file's members in order.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators import geometry
from voxelith.sources.files import Damaged, Stream, listed, open_file, replacing

#: Element types by code.
NUMPY = {2: "u1", 4: "<i2", 8: "<i4", 16: "<f4", 64: "<f8", 256: "i1", 512: "<u2", 768: "<u4"}
HEADER = "path string, sizeof_hdr int, magic string, ndim int, n0 int, n1 int, n2 int, dim4 int, datatype int, bitpix int, vox_offset double, n_bytes long, scl_slope double, scl_inter double, qform_code int, sform_code int, qb double, qc double, qd double, o0 double, o1 double, o2 double, qfac double, p0 double, p1 double, p2 double, " + ", ".join(f"s{r}{c} double" for r in range(3) for c in range(4)) + ", problem string"
PLANES = "path string, c int, z int, ny int, nx int, data array<double>, status string"


def parse_header(path: str, raw: bytes, n_bytes: int | None = None, problem: str | None = None) -> tuple:
    """One row of HEADER from a file's first bytes; a short file gives zeros. n_bytes: the unpacked size, null if it is not known."""
    h = raw[:348].ljust(348, b"\0")
    dim = struct.unpack_from("<8h", h, 40)
    pix = struct.unpack_from("<8f", h, 76)
    slope, inter = struct.unpack_from("<2f", h, 112)
    q, s = struct.unpack_from("<2h", h, 252)
    quat = struct.unpack_from("<6f", h, 256)
    rows = struct.unpack_from("<12f", h, 280)
    magic = h[344:347].decode("latin-1").rstrip("\0")
    offset = struct.unpack_from("<f", h, 108)[0]
    offset = float(int(offset)) if math.isfinite(offset) else offset
    return (path, struct.unpack_from("<i", h)[0], magic, dim[0], dim[1], dim[2], dim[3], dim[4], *struct.unpack_from("<2h", h, 70), offset, n_bytes, slope, inter, q, s, *quat[:3], *quat[3:], pix[0], *pix[1:4], *rows, problem)


def read_header(path: str, whole: bool = False) -> tuple:
    """The row of a file, from its first bytes. With `whole` a packed file is unpacked to its end, piece by piece, which tells its
    size and damage behind the header; else its size is not known and such damage is not seen."""
    raw, size, problem = b"", None, None
    try:
        with open_file(path, "rb") as f:
            s = Stream(f)
            raw = s.read(348)
            if whole or not s.zipped:
                if s.zipped:
                    s.skip()
                    size = s.given
                else:
                    size = f.seek(0, 2)
            elif len(raw) < 348:
                size = len(raw)
    except Damaged as e:
        problem = str(e)
    except OSError:
        problem = "unreadable"
    return parse_header(path, raw, size, problem)


def headers(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """A row of HEADER for every file below `path`, good or not; geometry.header_status tells what to set aside. See read_header()."""
    return headers_of(listed(spark, path), whole)


def headers_of(files: DataFrame, whole: bool = False) -> DataFrame:
    """headers() of the files in `files` (path)."""
    names = [x.split()[0] for x in HEADER.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame([read_header(p, whole) for p in f["path"]], columns=names)
            yield out.astype({"n_bytes": "Int64"})

    return files.select("path").mapInPandas(run, HEADER)


def _planes(h: dict, channels: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(class, z, values) of a readable file, scaled by its header; Damaged where its data ends or breaks."""
    kind, nc = np.dtype(NUMPY[h["datatype"]]), h["dim4"] if channels else 1
    plane, slope, inter = h["n0"] * h["n1"], h["scl_slope"], h["scl_inter"]
    with open_file(h["path"], "rb") as f:
        s = Stream(f)
        s.skip(int(h["vox_offset"]) or 352)
        for k in range(nc * h["n2"]):
            raw = s.read(plane * kind.itemsize)
            if len(raw) < plane * kind.itemsize:
                raise Damaged("truncated")
            v = np.frombuffer(raw, kind).astype(np.float64)
            yield k // h["n2"], k % h["n2"], v * slope + inter if slope != 0 and (slope != 1 or inter != 0) else v
        if s.zipped:
            s.skip()
            if s.trailing:
                raise Damaged("trailing_bytes")


def scan(heads: DataFrame, channels: bool = False) -> DataFrame:
    """PLANES of the files in `heads` (rows of headers() with status): planes, and one row a file with its status and nothing else.

    A file that is not ok by its header gives that row only. Planes leave while a file is read, so a file found damaged at its end
    has planes as well; good_planes() takes them out. With `channels`, files of four dimensions are read, else those of three.
    """
    status = F.when((F.col("status") == "four_d") & F.lit(channels), "ok").when((F.col("status") == "ok") & F.lit(channels), "not_4d").otherwise(F.col("status"))
    names = ["path", "n0", "n1", "n2", "dim4", "datatype", "vox_offset", "scl_slope", "scl_inter"]
    schema = pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("c", "z", "ny", "nx")), ("data", pa.list_(pa.float64())), ("status", pa.string())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for h in b.to_pylist():
                end = h["status"]
                if end == "ok":
                    try:
                        for c, z, v in _planes(h, channels):
                            held.append((h["path"], c, z, h["n1"], h["n0"], v, None))
                            size += v.nbytes
                            if size > 4 << 20:
                                yield batch(held)
                                held, size = [], 0
                    except Damaged as e:
                        end = str(e)
                    except OSError:
                        end = "unreadable"
                held.append((h["path"], None, None, None, None, None, end))
        if held:
            yield batch(held)

    return heads.select(*names, status.alias("status")).mapInArrow(run, PLANES)


def statuses(scanned: DataFrame) -> DataFrame:
    """path, status: a row a file of what scan() gave."""
    return scanned.filter("status is not null").select("path", "status")


def good_planes(scanned: DataFrame) -> DataFrame:
    """path, c, z, ny, nx, data of the files that scan() read to their end without damage. Store `scanned` first, or it is made twice."""
    bad = statuses(scanned).filter("status not in ('ok', 'trailing_bytes')")
    return scanned.filter("status is null").drop("status").join(bad.select("path"), "path", "left_anti")


def slabs(spark: SparkSession, path: str, channels: bool = False) -> DataFrame:
    """path, c, z, ny, nx, data: one row for each plane of each file below `path` that is whole, so no row holds a volume.

    Every file is read to its end once for its size and damage, and again for its planes; see scan() for one reading.
    """
    heads = geometry.header_status(headers(spark, path, whole=True))
    return good_planes(scan(heads, channels))


def voxels(slabs_: DataFrame, *more: str) -> DataFrame:
    """path, c, z, y, x, val of slabs, and the columns `more` that slabs carry: a row a voxel, x fastest."""
    out = slabs_.select("path", "c", "z", "nx", *more, F.posexplode("data").alias("i", "val"))
    return out.select("path", "c", "z", F.floor(F.col("i") / F.col("nx")).cast("int").alias("y"), (F.col("i") % F.col("nx")).cast("int").alias("x"), "val", *more)


# ---- writing ----


def header_bytes(shape: tuple[int, ...], affine: np.ndarray, code: int | None = None) -> bytes:
    """The 352 bytes before the data: uint8 labels of three dimensions, or float32 of four, or elements of type `code`; affine 3 x 4."""
    code = code or (2 if len(shape) == 3 else 16)
    h = bytearray(352)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, len(shape), *shape, *([1] * (7 - len(shape))))
    struct.pack_into("<2h", h, 70, code, 8 * np.dtype(NUMPY[code]).itemsize)
    struct.pack_into("<8f", h, 76, -1.0, *np.sqrt((affine[:, :3] ** 2).sum(0)), *([1.0] * 4))
    struct.pack_into("<3f", h, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", h, 252, 0, 2)
    struct.pack_into("<12f", h, 280, *affine.ravel())
    h[344:348] = b"n+1\0"
    return bytes(h)


def encode(data: np.ndarray, affine: np.ndarray) -> bytes:
    """A file's bytes: uint8 labels (X, Y, Z) or float32 probabilities (X, Y, Z, C), first axis fastest."""
    return header_bytes(data.shape, affine) + data.astype("u1" if data.ndim == 3 else "<f4").tobytes(order="F")


def member(raw: bytes) -> bytes:
    """One member of a gzip file."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


#: What a file's first bytes are made of; planes carry it.
HEAD = ["n0", "n1", "n2", *geometry.AFFINE]


def packed(rows: DataFrame, plane: str, fast: Column, value: str) -> DataFrame:
    """vol, k (place along `plane`), HEAD, and arrays at and value: the voxels of each plane by place `fast`, packed by Spark's own functions.

    A plane without voxels has no row, and not all places of a plane need be there.
    """
    cells = F.array_sort(F.collect_list(F.struct(fast.cast("int").alias("at"), F.col(value).alias("value"))))
    out = rows.groupBy("vol", F.col(plane).cast("int").alias("k"), *HEAD).agg(cells.alias("cells"))
    return out.select("vol", "k", *HEAD, F.col("cells.at").alias("at"), F.col("cells.value").alias("value"))


def plane_values(row: dict, places: int, channels: int, kind: str = "u1") -> np.ndarray:
    """The plane (places,) of numbers of a kind, or (places, channels) of float32, zeros where no voxel is."""
    out = np.zeros((places, channels), np.float32) if channels else np.zeros(places, kind)
    out[np.asarray(row["at"], np.int64)] = np.asarray(row["value"]).reshape(-1, channels) if channels else row["value"]
    return out


def affine_of(row: dict) -> np.ndarray:
    return np.array([[row[f"a{r}{c}"] for c in range(4)] for r in range(3)], float)


def pressed(planes: DataFrame, bodies) -> DataFrame:
    """vol, part, k, HEAD, body: for each of packed()'s rows the pieces that `bodies(row)` makes of it, numbered by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                made = bodies(one.to_pylist()[0])
                again = one.take(pa.array([0] * len(made)))
                yield pa.RecordBatch.from_pydict({"vol": again["vol"], "part": pa.array(range(len(made)), pa.int32()), "k": again["k"], **{c: again[c] for c in HEAD}, "body": pa.array(made, pa.binary())})

    kinds = dict(planes.dtypes)
    return planes.mapInArrow(run, f"vol {kinds['vol']}, part int, k int, " + ", ".join(f"{c} {kinds[c]}" for c in HEAD) + ", body binary")


def stitched(pieces: DataFrame, folder: str, suffix: str, begin, put, end) -> DataFrame:
    """vol, path of the files written from `pieces` (vol, part, k, HEAD, body) in order of part and k.

    A task writes its volumes one after another and holds one piece at a time: `begin(row)` gives a state and the first bytes,
    `put(state, row)` those of each piece, `end(state)` the last ones. See files.replacing() for how a file appears.
    """
    rows = pieces.repartition("vol").sortWithinPartitions("vol", "part", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = ((b.slice(i, 1), b.slice(i, 1).to_pylist()[0]) for b in batches for i in range(b.num_rows))
        one, row = next(flat, (None, None))
        while row is not None:
            vol, named = row["vol"], one["vol"]
            path = f"{folder}/vol-{vol}{suffix}"
            with replacing(path) as out:
                state, first = begin(row)
                out.write(first)
                while row is not None and row["vol"] == vol:
                    out.write(put(state, row))
                    one, row = next(flat, (None, None))
                out.write(end(state))
            yield pa.RecordBatch.from_pydict({"vol": named, "path": pa.array([path])})

    return rows.mapInArrow(run, f"vol {dict(pieces.dtypes)['vol']}, path string")


def export(rows: DataFrame, folder: str, suffix: str = ".nii.gz", channels: int = 0, code: int = 2) -> DataFrame:
    """Write a file for each volume; vol, path of what was written.

    `rows` has vol, i0, i1, i2, n0, n1, n2 (the input's axes), the affine a00..a23, and label, or p (an array of
    `channels` numbers), or val for elements of another type `code` than uint8. Voxels that are missing are 0. Planes of constant i2 are packed and, for a suffix that ends in .gz, made
    gzip members of their own by all tasks; one task a file writes them one after another, so none holds a volume.
    """
    zipped, kind = suffix.lower().endswith(".gz"), NUMPY[code]

    def bodies(row: dict) -> list[bytes]:
        v = plane_values(row, row["n0"] * row["n1"], channels, kind)
        raw = [v[:, c].astype("<f4").tobytes() for c in range(channels)] or [v.tobytes()]
        return [member(x) for x in raw] if zipped else raw

    def begin(row: dict) -> tuple[dict, bytes]:
        shape = tuple(row[f"n{i}"] for i in range(3)) + ((channels,) if channels else ())
        raw, empty = header_bytes(shape, affine_of(row), None if channels else code), bytes(shape[0] * shape[1] * (4 if channels else np.dtype(kind).itemsize))
        return {"at": 0, "n2": shape[2], "all": shape[2] * max(1, channels), "empty": member(empty) if zipped else empty}, member(raw) if zipped else raw

    def put(state: dict, row: dict) -> bytes:
        place = row["part"] * state["n2"] + row["k"]
        gap, state["at"] = place - state["at"], place + 1
        return state["empty"] * gap + row["body"]

    planes = packed(rows, "i2", F.col("i1") * F.col("n0") + F.col("i0"), "p" if channels else "label" if code == 2 else "val")
    return stitched(pressed(planes, bodies), folder, suffix, begin, put, lambda state: state["empty"] * (state["all"] - state["at"]))
