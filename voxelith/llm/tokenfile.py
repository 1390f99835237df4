"""Token ids in seekable Zstandard files.

A file is a series of independent Zstandard frames with content checksums, then two skippable frames: an
index of the documents that each frame holds, and the seek table of the Zstandard seekable format (sizes and
the low half of XXH64 of each frame). A reader finds a document's frame from the file's end and decompresses
only that one. A frame holds whole documents:

    count u32 | bytes per id u32 | doc_id i64 x count | ids of each document u32 x count | ids

Documents are range-partitioned by id, so files follow each other in ascending order of ids.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.common import logical_cores, pieces, stored, text_buffers, word_hashes
from voxelith.session import new_path
from voxelith.sources.files import open_file

SEEK_MAGIC, SEEK_FOOTER, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5D
#: Bytes of ids after which a frame is closed.
FRAME = 1 << 20
#: Stands for a null doc_id in files.
NULL_ID = -(1 << 63)


# ---- format ----


class Writer:
    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.docs: list[tuple[int, np.ndarray]] = []
        self.held, self.frames, self.index = 0, [], []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.held += ids.nbytes
        if self.held >= FRAME:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if not self.docs:
            return
        width = max(x.itemsize for _, x in self.docs)
        raw = b"".join([struct.pack("<II", len(self.docs), width), np.array([d for d, _ in self.docs], "<i8").tobytes(), np.array([len(x) for _, x in self.docs], "<u4").tobytes(), *(x.astype(f"<u{width}", copy=False).tobytes() for _, x in self.docs)])
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF))
        self.index.append((self.docs[0][0], self.docs[-1][0], len(self.docs)))
        self.docs, self.held = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<qqI", *x) for x in self.index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_FOOTER or flags != 0x80:
            raise ValueError("no seek table with checksums at the file's end")
        table_at = end - 9 - 12 * n - 8
        file.seek(table_at)
        data = file.read(8 + 12 * n)
        if struct.unpack("<II", data[:8]) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("damaged seek table")
        self.frames = [struct.unpack_from("<III", data, 8 + 12 * i) for i in range(n)]
        file.seek(table_at - 20 * n - 8)
        data = file.read(8 + 20 * n)
        if struct.unpack("<II", data[:8]) != (INDEX_MAGIC, 20 * n):
            raise ValueError("damaged document index")
        self.index = [struct.unpack_from("<qqI", data, 8 + 20 * i) for i in range(n)]
        self.starts = np.concatenate([[0], np.cumsum([f[0] for f in self.frames])]).astype(np.int64)

    def frame(self, k: int) -> list[tuple[int, np.ndarray]]:
        """Documents of frame k; raises if its checksum does not hold."""
        import xxhash
        import zstandard

        packed, size, check = self.frames[k]
        self.file.seek(int(self.starts[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)
        if xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: checksum does not hold")
        n, width = struct.unpack_from("<II", raw)
        ids, lengths = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u4", n, 8 + 8 * n)
        values, ends = np.frombuffer(raw, f"<u{width}", offset=8 + 12 * n), np.cumsum(lengths, dtype=np.int64)
        return [(int(ids[i]), values[ends[i] - lengths[i] : ends[i]]) for i in range(n)]

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document with this doc_id; only frames that may hold it are read."""
        return [ids for k, (a, b, _) in enumerate(self.index) if a <= doc_id <= b or b == NULL_ID for d, ids in self.frame(k) if d == doc_id]


# ---- tokens ----


def _byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write each byte as a character: visible ones as themselves, the others from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in seen else next(rest)) for b in range(256)}


class WordTokenizer:
    """Encodes texts word by word and remembers words, for word_bpe files (lower-cased, byte-level, white space dropped).

    Their pre-tokenizer never joins characters across ASCII white space, or an ASCII letter with a mark that
    follows it, so the ids of a text are those of its pieces in a row; each distinct piece is encoded once
    while it is remembered. Pieces are told apart by 64-bit hashes of their bytes, A-Z lower-cased. A piece of
    ASCII and Latin-1 letters is one word to the tokenizer and goes to its BPE model directly; any other piece
    goes through the whole tokenizer, and so does a text that spells out an added token.
    """

    REMEMBERED = 600_000
    _LETTER = np.zeros(256, bool)
    _LETTER[[*range(65, 91), *range(97, 123)]] = True
    _MARK = np.zeros(256, bool)
    _MARK[list(b".,!?;:")] = True
    _PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    _BYTES = _byte_letters()

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.type = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, self.type)
        self.at = np.zeros(1 << 16, np.int32)  # of each remembered piece: where its ids end in the pool
        self.used = 0

    def _learn(self, hashes: list[int], texts: list[str], ascii_letters: list[bool]) -> None:
        """Encode pieces, given in lower case as far as A-Z goes, and remember them."""
        flat: list[int] = []
        ends = []
        model, whole = self.model.tokenize, self.tokenizer.encode
        for x, plain in zip(texts, ascii_letters, strict=True):
            if plain:
                flat += [t.id for t in model(x)]
            elif self._PLAIN.fullmatch(x):
                flat += [t.id for t in model(x.lower().encode().decode("latin-1").translate(self._BYTES))]
            else:
                flat += whole(x, add_special_tokens=False).ids
            ends.append(len(flat))
        n, m = len(self.known), len(flat)
        while self.used + m > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(ends) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.pool[self.used : self.used + m] = flat
        self.at[n + 1 : n + 1 + len(ends)] = self.used + np.array(ends)
        self.used += m
        self.known.update(zip(hashes, range(n, n + len(ends)), strict=True))

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """Ids of each text, with `end_id` after them."""
        for i, j in pieces(texts, 1 << 19):
            if len(self.known) > self.REMEMBERED:
                self.forget()
            part = texts[i:j]
            data, offsets = text_buffers(part)
            raw = data.tobytes()
            if any(x.encode() in raw for x in self.added):
                for x in part.to_pylist():
                    yield np.array([*self.tokenizer.encode(x or "", add_special_tokens=False).ids, end_id], self.type)
                continue
            cuts = np.flatnonzero(self._LETTER[data[:-1]] & self._MARK[data[1:]]) + 1
            words, at, first, last = word_hashes(data, offsets, cuts=cuts, ends=True)
            distinct, where, back = np.unique(words, return_index=True, return_inverse=True)
            keys = distinct.tolist()
            new = [k for k, h in enumerate(keys) if h not in self.known]
            if new:
                a, b = first[where[new]], last[where[new]]
                other = np.concatenate([[0], np.cumsum(~self._LETTER[data], dtype=np.int32)])
                low = raw.lower()
                self._learn([keys[k] for k in new], [low[x:y].decode() for x, y in zip(a.tolist(), b.tolist(), strict=True)], (other[a] == other[b]).tolist())
            slot = np.fromiter(map(self.known.__getitem__, keys), np.int32, len(keys))
            n = (self.at[slot + 1] - self.at[slot])[back]
            ends = np.cumsum(n, dtype=np.int32)
            ids = self.pool[np.repeat(self.at[slot][back] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
            bounds = np.concatenate([[0], ends])[at].tolist()
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                out = np.empty(y - x + 1, self.type)
                out[:-1], out[-1] = ids[x:y], end_id
                yield out


_tokenizers: dict[str, WordTokenizer] = {}


def write(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode every text and write the ids; the files' manifest: part, path, docs, tokens.

    `docs` has doc_id and text; `tokenizer` is a file of the tokenizers library that all workers can read.
    Null texts count as empty: they have the end id alone. Rows ascend by doc_id, null last; rows of one
    doc_id follow by a hash of their text, so a doc_id with very many rows is split over files. A task
    writes a file of its own; only files of tasks that the manifest lists count, so lost and repeated
    tasks do no harm.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = WordTokenizer(tokenizer)
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst"
        writer, n, tokens = None, 0, 0
        for b in batches:
            ids = b.column(0).fill_null(NULL_ID).to_pylist()
            for doc_id, x in zip(ids, _tokenizers[tokenizer].encode(b.column(1), end_id), strict=True):
                writer = writer or Writer(open_file(path, "wb"))
                writer.add(doc_id, x)
                n, tokens = n + 1, tokens + len(x)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([n], pa.int64()), pa.array([tokens], pa.int64())], ["part", "path", "docs", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by = [F.col("doc_id").asc_nulls_last(), F.col("text_key")]
    rows = rows.withColumns({"text_key": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*by, "row").sortWithinPartitions(*by)
    return stored(rows.select("doc_id", "text").mapInArrow(run, "part int, path string, docs long, tokens long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, read back frame by frame with checksums verified.

    start counts the ids of all documents before it; files are one row each in `manifest`.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = stored(manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("path", "start"), "files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open_file(path, "rb") as f:
                    reader = Reader(f)
                    for k in range(len(reader.frames)):
                        docs = reader.frame(k)
                        n = np.array([len(x) for _, x in docs], np.int64)
                        starts = start + np.cumsum(n) - n
                        start += int(n.sum())
                        crc = [zlib.crc32(x.astype("<u4").tobytes()) for _, x in docs]
                        ids = pa.array([None if d == NULL_ID else d for d, _ in docs], pa.int64())
                        yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(manifest.count(), 4 * logical_cores(manifest.sparkSession)))
    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
