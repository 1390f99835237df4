"""JNIfTI text files: a JSON container with a header and an annotated array, last dimension fastest, packed by zlib or plain.

A container is read as a stream, twice: once for everything but the array's data, which may stand before the size and type that explain
it, and once for that data, whose base64, zlib and numbers are decoded piece by piece. Planes of constant first index leave in order, so no
task holds a file or a volume. A file that cannot be read gives a row with the reason.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.sources.files import Damaged, listed, open_file
from voxelith.sources.nifti import affine_of, packed, plane_values, pressed, stitched

#: Element types by name.
NUMPY = {"uint8": "u1", "int8": "i1", "uint16": "<u2", "int16": "<i2", "uint32": "<u4", "int32": "<i4", "single": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
HEADER = "path string, dim array<bigint>, affine array<array<double>>, voxel_size array<double>, data_type string, bit_depth int, array_type string, array_size array<bigint>, zip_type string, shuffle int, payload string, status string"
PLANES = "path string, c int, x int, ny int, nz int, data array<double>, status string"

#: Bytes of a container besides its data, and levels of its values.
MOST_BYTES, MOST_LEVELS = 16 << 20, 64
_SPACE, _QUOTE, _TOKEN_END = re.compile(rb"[^ \t\r\n]"), re.compile(rb'["\\]'), re.compile(rb"[,\]}\s]")


class Pull:
    """JSON from a binary file handle, a value at a time. Values that are not wanted pass by; strings and arrays of numbers come in pieces."""

    PIECE = 1 << 18

    def __init__(self, handle) -> None:
        self.handle, self.buffer, self.at, self.kept = handle, b"", 0, 0

    def _more(self) -> bool:
        piece = self.handle.read(self.PIECE)
        self.buffer, self.at = self.buffer[self.at :] + piece, 0
        return bool(piece)

    def peek(self) -> bytes:
        """The next byte that is not white space, none at the end."""
        while True:
            m = _SPACE.search(self.buffer, self.at)
            if m:
                self.at = m.start()
                return self.buffer[self.at : self.at + 1]
            self.at = len(self.buffer)
            if not self._more():
                return b""

    def take(self, byte: bytes) -> None:
        if self.peek() != byte:
            raise Damaged("bad_json")
        self.at += 1

    def string(self) -> Iterator[bytes]:
        """The pieces of a string between its quotes, escapes as they are."""
        self.take(b'"')
        while True:
            m = _QUOTE.search(self.buffer, self.at)
            end = m.start() if m else len(self.buffer)
            if end > self.at:
                yield self.buffer[self.at : end]
            self.at = end
            if m is None or (m[0] == b"\\" and end + 2 > len(self.buffer)):
                if not self._more():
                    raise Damaged("bad_json")
            elif m[0] == b'"':
                self.at += 1
                return
            else:
                yield self.buffer[self.at : self.at + 2]
                self.at += 2

    def numbers(self) -> Iterator[np.ndarray]:
        """The numbers of a flat array, in pieces."""
        self.take(b"[")
        if self.peek() == b"]":
            self.at += 1
            return
        while True:
            end = self.buffer.find(b"]", self.at)
            cut = end if end >= 0 else self.buffer.rfind(b",", self.at)
            if cut > self.at:
                yield self._parsed(self.buffer[self.at : cut])
                self.at = cut + 1
            if end >= 0:
                if cut == self.at:
                    raise Damaged("bad_json")
                self.at = end + 1
                return
            if not self._more():
                raise Damaged("bad_json")

    @staticmethod
    def _parsed(text: bytes) -> np.ndarray:
        try:
            return np.array(json.loads(b"[" + text + b"]"), float)
        except (ValueError, TypeError):
            raise Damaged("bad_number") from None

    def keys(self) -> Iterator[str]:
        """The keys of an object; each one's value must be taken before the next."""
        self.take(b"{")
        if self.peek() == b"}":
            self.at += 1
            return
        while True:
            key = self.value()
            if not isinstance(key, str):
                raise Damaged("bad_json")
            self.take(b":")
            yield key
            if self.peek() == b"}":
                self.at += 1
                return
            self.take(b",")

    def items(self) -> Iterator[int]:
        self.take(b"[")
        if self.peek() == b"]":
            self.at += 1
            return
        for i in range(1 << 62):
            yield i
            if self.peek() == b"]":
                self.at += 1
                return
            self.take(b",")

    def value(self, keep: bool = True, level: int = 0):
        """The next value, or with `keep` False nothing, its bytes passing by."""
        if level > MOST_LEVELS:
            raise Damaged("too_deep")
        first = self.peek()
        if first == b"{":
            out = {}
            for k in self.keys():
                v = self.value(keep, level + 1)
                if keep:
                    out[k] = v
            return out
        if first == b"[":
            out = []
            for _ in self.items():
                v = self.value(keep, level + 1)
                if keep:
                    out.append(v)
            return out
        if first == b'"':
            text = []
            for piece in self.string():
                if keep:
                    self._count(len(piece))
                    text.append(piece)
            return self._loaded(b'"' + b"".join(text) + b'"')
        while (m := _TOKEN_END.search(self.buffer, self.at)) is None and len(self.buffer) - self.at < 64 and self._more():
            pass
        end = m.start() if m else len(self.buffer)
        token, self.at = self.buffer[self.at : end], end
        self._count(len(token) if keep else 0)
        return self._loaded(token)

    def _count(self, n: int) -> None:
        self.kept += n
        if self.kept > MOST_BYTES:
            raise Damaged("too_large")

    @staticmethod
    def _loaded(text: bytes):
        try:
            return json.loads(text)
        except ValueError:
            raise Damaged("bad_json") from None


_DATA = ("_ArrayZipData_", "_ArrayData_")


def skim(handle) -> tuple[dict | None, dict | None]:
    """(header, fields of the array) of a whole container; a field of data stands for its kind: string, array or other."""
    p, header, array = Pull(handle), None, None
    first = p.peek()
    if first != b"{":
        p.value(keep=False)
        raise Damaged("not_an_object" if not p.peek() else "bad_json")
    for key in p.keys():
        if key == "NIFTIHeader":
            header = p.value()
        elif key == "NIFTIData" and p.peek() == b"{":
            array = {}
            for field in p.keys():
                if field in _DATA:
                    array[field] = {b'"': "string", b"[": "array"}.get(p.peek(), "other")
                    if array[field] == "string":
                        for _ in p.string():
                            pass
                    elif array[field] == "array":
                        try:
                            for _ in p.numbers():
                                pass
                        except Damaged as e:
                            raise Damaged("bad_number" if str(e) == "bad_number" else "bad_json") from None
                    else:
                        p.value(keep=False)
                else:
                    array[field] = p.value()
        else:
            p.value(keep=False)
    if p.peek():
        raise Damaged("bad_json")
    return header, array


def _matrix(a) -> list[list[float]] | None:
    """3 or 4 rows of 4 numbers, nested or as an annotated array."""
    if isinstance(a, dict) and isinstance(a.get("_ArraySize_"), list) and isinstance(a.get("_ArrayData_"), list):
        flat, size = a["_ArrayData_"], a["_ArraySize_"]
        a = [flat[4 * r : 4 * r + 4] for r in range(size[0])] if size in ([3, 4], [4, 4]) and len(flat) == 4 * size[0] else None
    ok = isinstance(a, list) and len(a) in (3, 4) and all(isinstance(r, list) and len(r) == 4 and all(isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v) for v in r) for r in a)
    return [[float(v) for v in r] for r in a] if ok else None


def _sizes(v) -> list[int] | None:
    return v if isinstance(v, list) and all(isinstance(n, int) and not isinstance(n, bool) and abs(n) < 2**62 for n in v) else None


def judged(header, array) -> str:
    """ok, or the first reason not to read the data."""
    if not isinstance(header, dict):
        return "no_header"
    if not isinstance(array, dict):
        return "no_data"
    if _matrix(header.get("Affine")) is None:
        return "bad_affine"
    kind, size = array.get("_ArrayType_"), _sizes(array.get("_ArraySize_"))
    if not isinstance(kind, str) or size is None:
        return "bad_array"
    if kind not in NUMPY:
        return "unsupported_type"
    if len(size) not in (3, 4):
        return "not_3d"
    if any(n < 1 for n in size):
        return "bad_extent"
    if "_ArrayZipData_" in array:
        if array.get("_ArrayZipType_", "zlib") != "zlib":
            return "unsupported_packing"
        if array["_ArrayZipData_"] == "other":
            return "bad_array"
        shuffle = array.get("_ArrayShuffle_", 0)
        if not isinstance(shuffle, int) or isinstance(shuffle, bool) or shuffle not in (0, np.dtype(NUMPY[kind]).itemsize):
            return "bad_shuffle"
    elif array.get("_ArrayData_") != "array":
        return "no_data"
    return "ok"


def read_header(path: str) -> tuple:
    """One row of HEADER; the whole container is read, but none of its data kept."""
    header = array = None
    try:
        with open_file(path, "rb") as f:
            header, array = skim(f)
        status = judged(header, array)
    except Damaged as e:
        status = str(e)
    except OSError:
        status = "unreadable"
    h, a = header if isinstance(header, dict) else {}, array if isinstance(array, dict) else {}
    numbers = lambda v: [float(x) for x in v] if isinstance(v, list) and all(isinstance(x, int | float) for x in v) else None
    text = lambda v: v if isinstance(v, str) else None
    whole = lambda v: v if isinstance(v, int) and abs(v) < 2**31 else None
    payload = next((k for k in _DATA if k in a), None)
    return (path, _sizes(h.get("Dim")), _matrix(h.get("Affine")), numbers(h.get("VoxelSize")), text(h.get("DataType")), whole(h.get("BitDepth")), text(a.get("_ArrayType_")), _sizes(a.get("_ArraySize_")), text(a.get("_ArrayZipType_")), whole(a.get("_ArrayShuffle_")), f"{payload}:{a[payload]}" if payload else None, status)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """A row of HEADER for every file below `path`, good or not: status is ok or the reason that its container or fields give."""
    return headers_of(listed(spark, path))


def headers_of(files: DataFrame) -> DataFrame:
    """headers() of the files in `files` (path)."""
    names = [x.split()[0] for x in HEADER.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame([read_header(p) for p in f["path"]], columns=names, dtype=object)
            yield out.astype({"bit_depth": "Int32", "shuffle": "Int32"})

    return files.select("path").mapInPandas(run, HEADER)


class Payload:
    """The data of a container, decoded piece by piece: `read(n)` gives the next n bytes, fewer only at the end."""

    def __init__(self, path: str, payload: str, kind: np.dtype) -> None:
        self.handle = open_file(path, "rb")
        field, self.form = payload.split(":")
        self.pieces = self._inflated(self._bytes(field)) if field == "_ArrayZipData_" else (np.asarray(x, kind).tobytes() for x in self._place(field).numbers())
        self.held, self.at = b"", 0

    def close(self) -> None:
        self.handle.close()

    def _place(self, field: str) -> Pull:
        p = Pull(self.handle)
        for key in p.keys():
            if key == "NIFTIData":
                for name in p.keys():
                    if name == field:
                        return p
                    p.value(keep=False)
            p.value(keep=False)
        raise Damaged("no_data")

    def _bytes(self, field: str) -> Iterator[bytes]:
        p = self._place(field)
        if self.form == "array":
            for x in p.numbers():
                if ((x < 0) | (x > 255) | (x != np.floor(x))).any():
                    raise Damaged("bad_number")
                yield x.astype(np.uint8).tobytes()
            return
        left = b""
        for piece in p.string():
            left += json.loads(b'"' + piece + b'"').encode().translate(None, b" \t\r\n") if b"\\" in piece else piece.translate(None, b" \t\r\n")
            whole = len(left) // 4 * 4
            yield self._decoded(left[:whole])
            left = left[whole:]
        if left:
            raise Damaged("bad_base64")

    @staticmethod
    def _decoded(text: bytes) -> bytes:
        try:
            return base64.b64decode(text, validate=True)
        except binascii.Error:
            raise Damaged("bad_base64") from None

    @staticmethod
    def _inflated(packed_: Iterator[bytes]) -> Iterator[bytes]:
        z, most = zlib.decompressobj(), 1 << 22
        try:
            for piece in packed_:
                full = True
                while (piece or full) and not z.eof:
                    out = z.decompress(piece, most)
                    full, piece = len(out) == most, z.unconsumed_tail
                    yield out
        except zlib.error:
            raise Damaged("bad_zlib") from None
        if not z.eof:
            raise Damaged("bad_zlib")

    def read(self, n: int) -> bytes:
        out, left = [], n
        while left > 0:
            if self.at == len(self.held):
                self.held, self.at = next(self.pieces, None), 0
                if self.held is None:
                    self.held = b""
                    break
            piece = self.held[self.at : self.at + left]
            self.at += len(piece)
            left -= len(piece)
            out.append(piece)
        return b"".join(out)

    def skip(self, n: int) -> None:
        while n > 0 and (piece := self.read(min(n, 1 << 20))):
            n -= len(piece)


def _planes(h: dict) -> Iterator[np.ndarray]:
    """The values of each first index, in order; Damaged where the data ends, breaks or goes on too long.

    Shuffled data holds the first bytes of all elements, then the second ones: as many readers as an element has bytes go on side by side.
    """
    kind, size = np.dtype(NUMPY[h["array_type"]]), h["array_size"]
    plane, width = math.prod(size[1:]), kind.itemsize
    lanes = width if h["shuffle"] and width > 1 else 1
    readers = [Payload(h["path"], h["payload"], kind) for _ in range(lanes)]
    try:
        for j, r in enumerate(readers):
            r.skip(j * plane * size[0])
        for _ in range(size[0]):
            raw = [r.read(plane * width // lanes) for r in readers]
            if any(len(x) < plane * width // lanes for x in raw):
                raise Damaged("size_mismatch")
            joined = np.stack([np.frombuffer(x, "u1") for x in raw], 1).tobytes() if lanes > 1 else raw[0]
            yield np.frombuffer(joined, kind).astype(float)
        if readers[-1].read(1):
            raise Damaged("size_mismatch")
    finally:
        for r in readers:
            r.close()


def scan(heads: DataFrame) -> DataFrame:
    """PLANES of the files in `heads` (rows of headers()): planes of constant x, z fastest, and one row a file with its status and
    nothing else. nifti.statuses() and nifti.good_planes() tell them apart."""
    schema = pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("c", "x", "ny", "nz")), ("data", pa.list_(pa.float64())), ("status", pa.string())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for h in b.to_pylist():
                end = h["status"]
                if end == "ok":
                    ny, nz, nc = [*h["array_size"][1:], 1][:3]
                    try:
                        for x, v in enumerate(_planes(h)):
                            held += [(h["path"], c, x, ny, nz, part, None) for c, part in enumerate(v.reshape(-1, nc).T)]
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

    return heads.select("path", "array_type", "array_size", "shuffle", "payload", "status").mapInArrow(run, PLANES)


def voxels(planes: DataFrame) -> DataFrame:
    """path, c, z, y, x, val of planes of constant x: a row a voxel."""
    out = planes.select("path", "c", "x", "nz", F.posexplode("data").alias("i", "val"))
    return out.select("path", "c", (F.col("i") % F.col("nz")).cast("int").alias("z"), F.floor(F.col("i") / F.col("nz")).cast("int").alias("y"), "x", "val")


# ---- writing ----


def container(shape: tuple[int, ...], affine: np.ndarray, table: dict | None, shuffle: int, name: str | None = None) -> tuple[bytes, bytes]:
    """What a file has before and after its packed data, for labels (X, Y, Z) as uint8, probabilities (X, Y, Z, C) as single, or elements
    of the type `name`."""
    name = name or ("uint8" if len(shape) == 3 else "single")
    header = {"NIIHeaderSize": 348, "Dim": list(shape), "Affine": affine.tolist(), "VoxelSize": np.sqrt((affine[:, :3] ** 2).sum(0)).tolist(), "DataType": name, "BitDepth": 8 * np.dtype(NUMPY[name]).itemsize}
    if table:
        header["_DataInfo_"] = {"LabelTable": table}
    body = {"_ArrayType_": name, "_ArraySize_": list(shape), "_ArrayZipType_": "zlib", "_ArrayZipSize_": [1, math.prod(shape)]}
    if shuffle > 1:
        body["_ArrayShuffle_"] = shuffle
    body["_ArrayZipData_"] = ""
    text = json.dumps({"NIFTIHeader": header, "NIFTIData": body})
    return text[:-3].encode(), text[-3:].encode()


def adler_joined(a: int, b: int, size: int) -> int:
    """The Adler-32 sum of two texts on end from the sums of each; `size` is the second one's."""
    low_a, low_b, n = a & 0xFFFF, b & 0xFFFF, size % 65521
    low = (low_a + low_b - 1) % 65521
    high = ((a >> 16) + (b >> 16) + n * (low_a - 1)) % 65521
    return high << 16 | low


def block(raw: bytes) -> bytes:
    """Sum, size and deflate blocks of `raw` that end on a byte and refer to nothing before them."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return zlib.adler32(raw).to_bytes(4, "big") + len(raw).to_bytes(8, "big") + c.compress(raw) + c.flush(zlib.Z_FULL_FLUSH)


def export(rows: DataFrame, folder: str, table: dict | None = None, channels: int = 0, shuffle: int = 1, name: str = "uint8") -> DataFrame:
    """Write a file for each volume, as nifti.export() does; `table` is the label table that the header carries, `name` the type of
    scalars in val that are no labels.

    Planes of constant i0 are packed as deflate blocks of their own by all tasks (with a `shuffle` of an element's size: one for each
    byte of the elements), and the task that writes the file joins them to one zlib stream, whose checksum follows from theirs.
    """
    name = "single" if channels else name
    kind = NUMPY[name]
    width = np.dtype(kind).itemsize
    lanes = width if shuffle == width and shuffle > 1 else 1

    def parts(v: np.ndarray) -> list[bytes]:
        raw = v.astype(kind).reshape(-1).view("u1").reshape(-1, lanes if lanes > 1 else 1)
        return [block(np.ascontiguousarray(raw[:, j]).tobytes()) for j in range(lanes)]

    def begin(row: dict) -> tuple[dict, bytes]:
        shape = tuple(row[f"n{i}"] for i in range(3)) + ((channels,) if channels else ())
        before, after = container(shape, affine_of(row), table, lanes, name)
        empty = parts(plane_values({"at": [], "value": []}, shape[1] * shape[2], channels, kind))[0]
        state = {"at": 0, "n0": shape[0], "all": shape[0] * lanes, "empty": empty, "sum": 1, "left": b"\x78\x9c", "after": after}
        return state, before

    def text(state: dict, more: bytes) -> bytes:
        raw = state["left"] + more
        whole = len(raw) // 3 * 3
        state["left"] = raw[whole:]
        return base64.b64encode(raw[:whole])

    def joined(state: dict, body: bytes) -> bytes:
        state["sum"] = adler_joined(state["sum"], int.from_bytes(body[:4], "big"), int.from_bytes(body[4:12], "big"))
        return text(state, body[12:])

    def put(state: dict, row: dict) -> bytes:
        place = row["part"] * state["n0"] + row["k"]
        out = b"".join(joined(state, state["empty"]) for _ in range(place - state["at"]))
        state["at"] = place + 1
        return out + joined(state, row["body"])

    def end(state: dict) -> bytes:
        out = b"".join(joined(state, state["empty"]) for _ in range(state["all"] - state["at"]))
        out += text(state, b"\x03\x00" + state["sum"].to_bytes(4, "big"))
        return out + base64.b64encode(state["left"]) + state["after"]

    planes = packed(rows, "i0", F.col("i1") * F.col("n2") + F.col("i2"), "p" if channels else "label" if name == "uint8" else "val")
    return stitched(pressed(planes, lambda row: parts(plane_values(row, row["n1"] * row["n2"], channels, kind))), folder, ".jnii", begin, put, end)
