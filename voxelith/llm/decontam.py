"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages, weighted by TF-IDF (document frequencies are counted over all
documents) and projected by a distributed randomised SVD. Windows of every document are compared with them
by cosine in that space; a window that comes near is checked word by word: the longest common subsequence
with the item must cover most of it, or half of it and the item's answer as well. The benchmark is a query
set: it is searched in blocks of bounded size, a few of them in one scan of all documents, so no task ever
holds more than SCAN blocks, and the documents are neither shuffled nor sampled.

The space is spanned by the benchmark's passages, not by the corpus: only the part of a window that lies in
the span of the queries can add to a cosine with one, while the window's whole weight stays in its norm. A
block has no more passages than the space has directions, so the projection loses nothing; what rounding or
an uneven block still leaves out of a passage is kept as its rest and added to the bound on its cosines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.common import _STEP, mix, pieces, small, stored, text_buffers, word_hashes

#: Bits of a word's feature; features, not words, are counted, so tables of them have a fixed size.
BITS = 17
#: Windows are made of blocks of UNIT words, start every quarter of their size, and have these sizes in words; an item is searched in
#: the smallest that holds it, longer ones in passages.
UNIT = 4
WINDOWS = (16, 32, 64)
#: Words in more than this share of the documents, and in more than COMMON_LEAST, weigh nothing, unless an item has fewer than THIN others.
COMMON, COMMON_LEAST, THIN = 0.05, 50, 4
PASSAGE, PASSAGE_STEP = 48, 32
#: Items with fewer words than this are no evidence of a leak inside a sentence: they are searched among whole lines only.
LEAST_WORDS = 5
#: Short items at most that are broadcast to the lines; beyond that, lines and items are shuffled.
SHORT_MAX = 1_000_000
RANK = 256
#: Passages of a block on average, with room up to RANK for uneven ones, and blocks searched in one scan of the documents.
BLOCK, SCAN = RANK * 3 // 4, 8
COSINE, STRONG, WEAK, ANSWER = 0.45, 0.7, 0.5, 0.7

_GAP = np.ones(256, bool)
_GAP[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = False
_GAP[128:] = False
_SHIFT = np.uint64(64 - BITS)


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Where characters of scripts without spaces (Thai, Lao, Myanmar, Khmer, kana and Han) begin and end in UTF-8."""
    b, nxt = data[:-1], data[1:]
    three = (b == 0xE0) & (nxt >= 0xB8) & (nxt <= 0xBB) | (b == 0xE1) & ((nxt >= 0x80) & (nxt <= 0x82) | (nxt >= 0x9E) & (nxt <= 0x9F)) | (b >= 0xE3) & (b <= 0xE9)
    four = (b == 0xF0) & (nxt >= 0xA0) & (nxt <= 0xAF)
    three, four = np.flatnonzero(three), np.flatnonzero(four)
    return np.concatenate([three, three + 3, four, four + 4])


def words_of(texts: pa.Array, ends: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of lower-cased words between ASCII punctuation and white space, and the words before each text. Each character of a
    script without spaces is a word. With `ends`, also each word's line: how many line ends stand before it."""
    data, offsets = text_buffers(texts)
    if data.max(initial=0) >= 128:  # capitals of Latin-1 letters in UTF-8
        low = np.zeros(len(data), bool)
        low[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data = np.where(low, data + 0x20, data).astype(np.uint8)
    cuts = _unspaced(data) if data.max(initial=0) >= 0xE0 else None
    found = word_hashes(data, offsets, gap=_GAP, cuts=cuts, ends=ends)
    return (*found[:2], np.searchsorted(np.flatnonzero(data == 10), found[2])) if ends else found


def feature(words: np.ndarray) -> np.ndarray:
    return (words >> _SHIFT).astype(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + N) / (1 + df)) of every feature, over all documents, negative for common words. What reaches the driver has 2 ** BITS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for i, j in pieces(b.column(0)):
                words, at = words_of(b.column(0)[i:j])
                f = feature(words)
                doc = np.repeat(np.arange(j - i), np.diff(at))
                counts += np.bincount(np.unique(doc * (1 << BITS) + f) & ((1 << BITS) - 1), minlength=1 << BITS)
                n += j - i
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *own], pa.int64()), pa.array([n, *counts[own]], pa.int64())], ["feature", "df"])

    table = docs.select("text").mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(1 << BITS)
    f, n = table.column("feature").to_numpy(), table.column("df").to_numpy()
    df[f[f >= 0]] = n[f >= 0]
    total = n[f < 0].sum() if (f < 0).any() else 0
    idf = np.log((1 + total) / (1 + df)) + 0.1
    return np.where(df > max(COMMON_LEAST, COMMON * total), -idf, idf)


@dataclass
class Block:
    """One block of the query set, as tasks get it."""

    item: np.ndarray  # of each passage
    size: np.ndarray  # its window
    words: list  # of each passage: hashes
    answers: list  # of each passage: hashes of its item's answer
    place: np.ndarray  # of each feature: its row in `vectors`, or -1
    vectors: np.ndarray  # features x rank, times the feature's weight
    latent: np.ndarray  # passages x rank, over the passage's norm
    idf: np.ndarray
    peaks: dict  # of each window size: a feature's largest part in one of its passages, times the feature's weight
    rest: np.ndarray | float = 0.0  # of each passage: the norm of what the space leaves out of it


def _answer(text: str) -> str:
    """What follows an answer mark, or the last third of the words."""
    marked = re.split(r"(?i)\banswer\s*[:=]", text)
    if len(marked) > 1 and marked[-1].strip():
        return marked[-1]
    w = text.split()
    return " ".join(w[-max(3, len(w) // 3) :])


def passages(benchmark: DataFrame) -> DataFrame:
    """(item_id, part, words, answer): passages of every item as hashes of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            words, at = words_of(b.column(1))
            answers, to = words_of(pa.array([_answer(x or "") for x in b.column(1).to_pylist()], pa.string()))
            for i, item in enumerate(b.column(0).to_pylist()):
                w, a = words[at[i] : at[i + 1]], answers[to[i] : to[i + 1]]
                if len(w) < LEAST_WORDS:
                    continue
                parts = [w] if len(w) <= WINDOWS[-1] else [w[s : s + PASSAGE] for s in range(0, len(w) - PASSAGE + PASSAGE_STEP, PASSAGE_STEP)]
                rows += [(item, k, p.view(np.int64), a.view(np.int64)) for k, p in enumerate(parts) if len(p) >= LEAST_WORDS]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["item_id", "part", "words", "answer"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, part int, words array<long>, answer array<long>")


def _rows(words: list, idf: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF in coordinate form: passage, column, weight; and each passage's norm."""
    f = [feature(w) for w in words]
    who = np.repeat(np.arange(len(f)), [len(x) for x in f])
    both, tf = np.unique(who * (1 << BITS) + (np.concatenate(f) if f else np.zeros(0, np.int64)), return_counts=True)
    weighs = place[both & ((1 << BITS) - 1)] >= 0
    both, tf = both[weighs], tf[weighs]
    who, col = both >> BITS, both & ((1 << BITS) - 1)
    weight = tf * idf[col]
    return who, place[col], weight, np.sqrt(np.bincount(who, weight**2, len(f)))


def _gram_times(parts: DataFrame, idf: np.ndarray, place: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A'A times `right` for the TF-IDF matrix A of `parts`: each task adds up its passages, Spark adds up the tasks' rows."""
    sc = parts.sparkSession.sparkContext
    held = sc.broadcast((idf, place, right.astype(np.float32)))
    rank = right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, place, right = held.value
        total = np.zeros(right.shape)
        for b in batches:
            words = [np.asarray(x.values.to_numpy(), np.int64).view(np.uint64) for x in b.column(0)]
            who, col, weight, norm = _rows(words, idf, place)
            weight = weight / np.maximum(norm[who], 1e-9)
            y = np.zeros((len(words), rank))
            for lo in range(0, len(who), 1 << 14):
                s = slice(lo, lo + (1 << 14))
                np.add.at(y, who[s], weight[s, None] * right[col[s]])
            for lo in range(0, len(who), 1 << 14):
                s = slice(lo, lo + (1 << 14))
                np.add.at(total, col[s], weight[s, None] * y[who[s]])
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, c]) for c in range(rank))], ["row", *(f"c{c}" for c in range(rank))])

    schema = "row long, " + ", ".join(f"c{c} double" for c in range(rank))
    table = parts.select("words").mapInArrow(run, schema).groupBy("row").agg(*(F.sum(f"c{c}").alias(f"c{c}") for c in range(rank))).toArrow()
    out = np.zeros(right.shape)
    if table.num_rows:
        out[table.column("row").to_numpy()] = np.column_stack([table.column(f"c{c}").to_numpy() for c in range(rank)])
    return out


def latent_space(parts: DataFrame, n: int, idf: np.ndarray, place: np.ndarray, features: int) -> np.ndarray:
    """The leading right singular vectors of the passages' TF-IDF matrix, features x rank, by randomised subspace iteration."""
    rank = min(RANK, n, features)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((features, min(features, rank + 8))))[0]
    for _ in range(2):
        q = np.linalg.qr(_gram_times(parts, idf, place, q))[0]
    small = q.T @ _gram_times(parts, idf, place, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(-values)[:rank]]


def _weights(parts: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Weights of the features: none for common ones, unless a passage of the query set has hardly any others."""
    held = parts.sparkSession.sparkContext.broadcast(idf > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, kept = held.value, np.zeros(1 << BITS, bool)
        for b in batches:
            for x in b.column(0):
                f = feature(np.asarray(x.values.to_numpy(), np.int64).view(np.uint64))
                if np.count_nonzero(rare[f]) < THIN:
                    kept[f] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(kept), pa.int64())], ["feature"])

    keep = idf > 0
    keep[parts.select("words").mapInArrow(run, "feature long").distinct().toArrow().column("feature").to_numpy()] = True
    return np.where(keep, np.abs(idf), 0.0)


def prepare(parts: DataFrame, idf: np.ndarray) -> Block | None:
    """The block of the passages `parts`; `idf` has the weights of the features."""
    rows = parts.toArrow()
    if not rows.num_rows:
        return None
    words = [np.asarray(x, np.int64).view(np.uint64) for x in rows.column("words").to_pylist()]
    answers = [np.asarray(x, np.int64).view(np.uint64) for x in rows.column("answer").to_pylist()]
    used = np.unique(np.concatenate([feature(w) for w in words]))
    used = used[idf[used] > 0]
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    vectors = latent_space(parts, len(words), idf, place, len(used))
    who, col, weight, norm = _rows(words, idf, place)
    latent = np.zeros((len(words), vectors.shape[1]))
    np.add.at(latent, who, weight[:, None] * vectors[col])
    latent /= norm[:, None]
    rest = np.sqrt(np.maximum(1 - (latent**2).sum(1), 0)) + 1e-5
    size = np.array([next((s for s in WINDOWS if len(w) <= s), WINDOWS[-1]) for w in words])
    peaks = {}
    for s in WINDOWS:
        own = size[who] == s
        peaks[s] = np.zeros(len(used))
        np.maximum.at(peaks[s], col[own], weight[own] / norm[who[own]] * idf[used[col[own]]])
    return Block(rows.column("item_id").to_numpy(), size, words, answers, place, (vectors * idf[used, None]).astype(np.float32), latent.astype(np.float32), idf, peaks, rest)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with one bit for each word of a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    v = every
    for y in b.tolist():
        if m := at.get(y):
            u = v & m
            v = (v + u | v - u) & every
    return len(a) - v.bit_count()


def _sliding(x: np.ndarray, m: int) -> np.ndarray:
    """Sums of m (a power of two) rows from each row on."""
    k = 1
    while k < m:
        y = x.copy()
        y[: len(x) - k] += x[k:]
        x, k = y, 2 * k
    return x


@dataclass
class Grid:
    """Words of texts in units, the same for every block of a query set."""

    f: np.ndarray  # of each word: its feature
    idf: np.ndarray  # of each word: its weight
    base: np.ndarray  # the first unit of each text
    unit: np.ndarray  # of each word
    text: np.ndarray  # of each unit
    k: np.ndarray  # of each unit: its place in its text
    full: np.ndarray  # of each unit: whether it has words
    all_sq: np.ndarray  # of each unit: sum of its words' squared weights


def grid_of(words: np.ndarray, at: np.ndarray, idf: np.ndarray) -> Grid:
    most = WINDOWS[-1] // UNIT
    f = feature(words)
    own = idf[f]
    lengths = np.diff(at)
    units = -(-lengths // UNIT)
    base = np.concatenate([[0], np.cumsum(units + most)])  # each text is followed by empty units, so windows do not reach the next
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    unit = base[text_of] + (np.arange(len(words)) - at[text_of]) // UNIT
    place = np.arange(base[-1])
    text = np.searchsorted(base, place, side="right") - 1
    k = place - base[text]
    return Grid(f, own, base, unit, text, k, k < units[text], np.bincount(unit, own**2, base[-1]))


def exact_cosine(window: np.ndarray, passage: np.ndarray, idf: np.ndarray) -> float:
    """TF-IDF cosine of two runs of features."""
    u, n = np.unique(window, return_counts=True)
    v, m = np.unique(passage, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    a, b = n * idf[u], m * idf[v]
    return float((a[i] * b[j]).sum() / max(np.sqrt((a**2).sum() * (b**2).sum()), 1e-9))


def windows_near(words: np.ndarray, at: np.ndarray, block: Block, grid: Grid | None = None) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, passage, first word, last word + 1, cosine) of windows at or above COSINE."""
    g = grid or grid_of(words, at, block.idf)
    f, base, text, k = g.f, g.base, g.text, g.k
    rest = np.broadcast_to(np.asarray(block.rest, float), len(block.words))
    row = block.place[f]
    known = np.flatnonzero(row >= 0)
    row, own = row[known], g.unit[known]
    for size in np.unique(block.size):
        m = int(size) // UNIT
        norm = np.sqrt(_sliding(g.all_sq, m))  # repeats make the true norm larger
        # no passage's cosine is above the sum of each word's largest part in any passage
        bound = _sliding(np.bincount(own, block.peaks[int(size)][row], base[-1]), m)
        close = np.flatnonzero((k % (m // 4) == 0) & g.full & (bound >= COSINE * norm) & (bound > 0))
        mine = np.flatnonzero(block.size == size)
        queries = block.latent[mine].T
        for lo in range(0, len(close), 1024):
            c = close[lo : lo + 1024]
            i, j = np.searchsorted(own, c), np.searchsorted(own, c + m)
            n = j - i
            take = np.repeat(i - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            vec = np.add.reduceat(block.vectors[row[take]], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
            high = np.maximum(vec @ queries, 0) / norm[c][:, None] + rest[mine]  # at least the cosine
            for w in np.flatnonzero((high >= COSINE).any(1)):
                start = int(at[text[c[w]]] + k[c[w]] * UNIT)
                end = int(min(start + size, at[text[c[w]] + 1]))
                for p in mine[high[w] >= COSINE]:
                    cosine = exact_cosine(f[start:end], feature(block.words[p]), block.idf)
                    if cosine >= COSINE:
                        yield int(text[c[w]]), int(p), start, end, cosine


def _run_hash(words: np.ndarray) -> int:
    """A signed hash of a short run of words."""
    h = sum((int(w) * int(c) for w, c in zip(words, _STEP, strict=False)), len(words) * 0x2545F4914F6CDD1D) & (2**64 - 1)
    return int(mix(np.array([h], np.uint64)).view(np.int64)[0])


def short_items(benchmark: DataFrame) -> DataFrame:
    """(run, item_id): a hash of the words of every item with fewer than LEAST_WORDS words, but at least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = words_of(b.column(1))
            own = [i for i in range(len(b)) if 0 < at[i + 1] - at[i] < LEAST_WORDS]
            yield pa.RecordBatch.from_arrays([pa.array([_run_hash(words[at[i] : at[i + 1]]) for i in own], pa.int64()), b.column(0).take(pa.array(own, pa.int64()))], ["run", "item_id"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "run long, item_id long")


def short_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, run) of every line with fewer than LEAST_WORDS words, but at least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column(2), 1 << 19):
                words, at, line = words_of(b.column(2)[i:j], ends=True)
                text = np.repeat(np.arange(j - i), np.diff(at))
                new = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])])) if len(words) else np.zeros(0, int)
                n = np.diff(np.append(new, len(words)))
                new, n = new[n < LEAST_WORDS], n[n < LEAST_WORDS]
                h = n.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
                for k in range(LEAST_WORDS - 1):
                    h[n > k] += words[new[n > k] + k] * _STEP[k]
                rows = pa.array(i + text[new])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(mix(h).view(np.int64))], ["doc_id", "text_key", "run"])

    return docs.mapInArrow(run, "doc_id long, text_key long, run long")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, cosine, overlap for each row of `docs` and item that it holds. text_key is xxhash64 of the text."""
    spark = docs.sparkSession
    idf = inverse_frequencies(docs)
    parts = passages(benchmark)
    parts = stored(parts, "passages")
    n = parts.count()
    blocks = 1 if n <= RANK else -(-n // BLOCK)
    weights = _weights(parts, idf)
    schema = "doc_id long, text_key long, item_id long, cosine double, overlap double"
    found = spark.createDataFrame([], schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    block = F.pmod(F.xxhash64("item_id", "part", "words"), F.lit(blocks))
    for lo in range(0, blocks, SCAN):
        own = [prepare(parts.filter(block == k).coalesce(1), weights) for k in range(lo, min(lo + SCAN, blocks))]
        own = [b for b in own if b is not None]
        if own:
            found = found.unionByName(rows.mapInArrow(_search(spark.sparkContext.broadcast(own)), schema))
    short = stored(short_items(benchmark).distinct(), "short-items")
    if short.head(1):
        met = short_lines(rows).join(small(short, SHORT_MAX), "run").select("doc_id", "text_key", "item_id").distinct()
        found = found.unionByName(met.withColumns({"cosine": F.lit(1.0), "overlap": F.lit(1.0)}))
    return found


def _search(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Block] = held.value
        for b in batches:
            out: dict[tuple[int, int], tuple[float, float]] = {}
            for i, j in pieces(b.column(2), 1 << 19):
                words, at = words_of(b.column(2)[i:j])
                grid = grid_of(words, at, blocks[0].idf)
                for block in blocks:
                    done: set[tuple[int, int]] = set()
                    for text, p, start, end, cosine in windows_near(words, at, block, grid):
                        if (text, p) in done:
                            continue
                        item, size = block.words[p], int(block.size[p])
                        region = words[max(at[text], start - size // 2) : min(at[text + 1], end + size // 2)]
                        overlap = common_subsequence(item, region) / len(item)
                        answer = block.answers[p]
                        if overlap >= STRONG or overlap >= WEAK and len(answer) and common_subsequence(answer, region) >= ANSWER * len(answer):
                            done.add((text, p))
                            key = (i + text, int(block.item[p]))
                            out[key] = max(out.get(key, (0.0, 0.0)), (overlap, cosine))
            at_rows = pa.array([r for r, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at_rows), b.column(1).take(at_rows), pa.array([x for _, x in out], pa.int64()), pa.array([c for _, c in out.values()], pa.float64()), pa.array([o for o, _ in out.values()], pa.float64())], ["doc_id", "text_key", "item_id", "cosine", "overlap"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, overlap: one row for each document and benchmark item that it holds.

    `docs` has doc_id and text, `benchmark` item_id and text. Null, empty and wordless texts hold nothing;
    an item of fewer than LEAST_WORDS words is held by a document with a line of just these words; items without
    words and null ones are not searched. Repeated rows of one doc_id give
    one row with the largest values. Empty tables give an empty result; extra columns are not read.
    """
    return hits(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("overlap").alias("overlap"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with all their columns. Rows with a null id are told apart by their text."""
    found = hits(docs, benchmark).select("doc_id", "text_key").distinct()
    d, x = docs.alias("d"), stored(found, "leaks").alias("x")
    return d.join(x, F.col("d.doc_id").cast("long").eqNullSafe(F.col("x.doc_id")) & (F.xxhash64("d.text") == F.col("x.text_key")), "left_anti")
