"""Files by path or URI, from any worker."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def open_file(uri: str, mode: str):
    """A binary file: local and mounted paths directly, other schemes through pyarrow's file systems."""
    path = _local(uri)
    if path is not None:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if mode == "wb" else system.open_input_file(path)


@contextmanager
def replacing(uri: str) -> Iterator:
    """A file to write that takes the place of `uri` only when all of it is there.

    It grows under a name of its own, so attempts of one task do not meet, and is renamed at the end; a failed attempt
    leaves nothing at `uri`.
    """
    draft = f"{uri}.{uuid.uuid4().hex}.part"
    out = open_file(draft, "wb")
    try:
        yield out
        out.close()
    except BaseException:
        out.close()
        _move(draft, None)
        raise
    _move(draft, uri)


def _move(draft: str, to: str | None) -> None:
    path = _local(draft)
    if path is not None:
        os.replace(path, _local(to)) if to else os.remove(path)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(draft)
    system.move(path, fs.FileSystem.from_uri(to)[1]) if to else system.delete_file(path)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path of every file below `path`, dealt by size; contents are not read. Spark's file sources pass over files of no bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("path not like '%.part'").select("path")


class Damaged(Exception):
    """A file that cannot be read on; the argument is the reason."""


class Stream:
    """The bytes of a file one after another, unpacked if it starts like gzip, whatever its name. Holds a few pieces, never the file.

    Members of gzip may follow each other, and zeros may follow the last one. `trailing` tells that something else follows it.
    """

    PIECE = 1 << 18

    def __init__(self, handle) -> None:
        self.handle, self.given, self.trailing, self.full = handle, 0, False, False
        self.raw = handle.read(self.PIECE)
        self.inflater = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None

    @property
    def zipped(self) -> bool:
        return self.inflater is not None

    def _some(self, most: int) -> bytes:
        """Between 1 and `most` bytes, or none at the end."""
        while True:
            if not self.raw:
                self.raw = self.handle.read(self.PIECE)
            if self.inflater is None:
                out, self.raw = self.raw[:most], self.raw[most:]
                return out
            if self.inflater.eof and not self._next_member():
                return b""
            if not self.raw and not self.full:
                raise Damaged("gzip_truncated")
            try:
                out = self.inflater.decompress(self.raw, most)
            except zlib.error:
                raise Damaged("gzip_damaged") from None
            self.full = len(out) == most  # then the inflater may hold more
            self.raw = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            if out:
                return out

    def _next_member(self) -> bool:
        while True:
            self.raw = self.raw.lstrip(b"\0")
            if self.raw:
                break
            self.raw = self.handle.read(self.PIECE)
            if not self.raw:
                return False
        if len(self.raw) == 1:
            self.raw += self.handle.read(self.PIECE)
        if self.raw[:2] != b"\x1f\x8b":
            self.trailing = True
            self.raw = b""
            while self.handle.read(self.PIECE):
                pass
            return False
        self.inflater = zlib.decompressobj(31)
        return True

    def read(self, n: int) -> bytes:
        """The next n bytes; fewer only at the end."""
        out, left = [], n
        while left > 0:
            piece = self._some(min(left, 1 << 22))
            if not piece:
                break
            out.append(piece)
            left -= len(piece)
        self.given += n - left
        return out[0] if len(out) == 1 else b"".join(out)

    def skip(self, n: int | None = None) -> None:
        """Pass over the next n bytes, or all that is left."""
        while n is None or n > 0:
            piece = self._some(1 << 20 if n is None else min(n, 1 << 20))
            if not piece:
                return
            self.given += len(piece)
            n = None if n is None else n - len(piece)
