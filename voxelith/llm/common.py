"""What the corpus operators share: shared tables, checked broadcasts and the word hash kernel."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.session import new_path

#: A word is a run of anything but these ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, label: str, codec: str = "zstd", rows: int = 0) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut and a lost executor loses nothing. A file has `rows` rows at most (0: any)."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", codec).option("maxRecordsPerFile", rows).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def gathered(df: DataFrame, label: str, codec: str = "zstd", per_core: int = 4) -> DataFrame:
    """stored(), written by at most `per_core` tasks for each core: a task takes several partitions one after another, so a chain of many
    small tables does not leave thousands of files behind."""
    return stored(df.coalesce(per_core * logical_cores(df.sparkSession)), label, codec)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote. Only for tables that no later result is computed from."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint if `df` has at most `max_rows` rows, which the executors count; else `df` as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


class Taken:
    """Stretches of a text that are taken, kept apart and in order, so that a look-up takes logarithmic time."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        """Whether nothing between start and end is taken."""
        i = bisect.bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start

    def add(self, start: int, end: int) -> None:
        """Take what is between start and end, together with the stretches that it overlaps."""
        lo, hi = bisect.bisect_right(self.ends, start), bisect.bisect_left(self.starts, end)
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [start], [end]


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def key128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5BD1E995), *cols)]


# ---- word hashes of an Arrow text column, without a Python loop over words ----

_rng = np.random.Generator(np.random.PCG64(20240229))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_CODE_LOWER = _CODE[_LOWER]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _PIECE + 1), _powers(_INVERSE, _PIECE + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, gap: np.ndarray = _IS_SPACE, cuts: np.ndarray | None = None, ends: bool = False) -> tuple[np.ndarray, ...]:
    """A 64-bit hash of each word (A-Z lower-cased), and the words before each text: text i has words [at[i], at[i + 1]).

    The hash is a polynomial over random codes of the bytes, taken from prefix sums piece by piece, so
    memory stays at a few times _PIECE however long a text is. `gap` tells which bytes part words, `cuts` has
    positions at which a word also ends; with `ends`, first and last byte + 1 of each word are returned too.
    """
    table = _CODE_LOWER if lower else _CODE
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if cuts is not None:
        edge[cuts] = True
    hashes, starts, stops, lo, n = [], [], [], 0, len(data)
    while lo < n:
        hi = min(n, lo + _PIECE)
        if hi < n:
            gaps = np.flatnonzero(gap[data[lo:hi]] | edge[lo:hi])
            hi = lo + int(gaps[-1]) if len(gaps) and gaps[-1] else hi
        if hi == lo + _PIECE and not (gap[data[hi - 1]] or edge[hi]):  # one word over a whole piece
            more = np.flatnonzero(gap[data[hi:]] | edge[hi:-1])
            hi = hi + int(more[0]) if len(more) else n
            word = data[lo:hi].tobytes()
            head = np.flatnonzero(~gap[data[lo:hi]])[:1] + lo
            hashes.append(np.array([hash_long(word.lower() if lower else word)], np.uint64))
            starts.append(head)
            stops.append(np.array([hi]))
            lo = hi
            continue
        piece = data[lo:hi]
        solid = ~gap[piece]
        before, after = np.empty_like(solid), np.empty_like(solid)
        before[0], before[1:] = False, solid[:-1]
        after[-1], after[:-1] = False, solid[1:]
        cut = edge[lo : hi + 1]
        s = np.flatnonzero(solid & (~before | cut[:-1]))
        e = np.flatnonzero(solid & (~after | cut[1:]))
        sums = np.cumsum(table[piece] * _UP[: len(piece)], dtype=np.uint64)
        h = sums[e].copy()
        h[s > 0] -= sums[s[s > 0] - 1]
        hashes.append(mix(h * _DOWN[s] + (e - s + 1).astype(np.uint64)))
        starts.append(s + lo)
        stops.append(e + lo + 1)
        lo = hi
    first = np.concatenate([np.zeros(0, np.int64), *starts])
    found = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.searchsorted(first, offsets)
    return (*found, first, np.concatenate([np.zeros(0, np.int64), *stops])) if ends else found


def hash_long(word: bytes) -> int:
    """For a word that fills a whole piece; such a word never equals a shorter one."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(word.strip(b" \t\n\r\x0b\x0c"), digest_size=8).digest(), "little")


_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(texts: pa.Array, k: int = 5):
    """For each text, its sorted distinct k-word shingles as 64-bit hashes (k at most 5).

    A text with fewer than k words has its whole sequence as one; a text without words has none.
    """
    for i, j in pieces(texts):
        words, at = word_hashes(*text_buffers(texts[i:j]))
        long = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for n in range(k):
            long += words[n : n + len(long)] * _STEP[n]
        long = mix(long)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= k:
                yield np.unique(long[a : b - k + 1])
            elif b > a:
                part = sum((int(w) * int(c) for w, c in zip(words[a:b], _STEP, strict=False)), int(b - a) * 0x2545F4914F6CDD1D) & (2**64 - 1)
                yield mix(np.array([part], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def pieces(texts: pa.Array, limit: int = 2 << 20):
    """Row ranges of a text column, each with about `limit` bytes, or one row if that has more."""
    _, offsets = text_buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def logical_cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
