"""Nearest neighbours by inner product: lists of vectors, scanned dimension by dimension.

Vectors are dealt to the lists of centres that a bounded sample is grouped by. A query probes its most promising lists; how many is
measured on the data itself: for a bounded set of rows the true neighbours are found among all rows, and as many lists are probed as
hold the wanted share of those neighbours. Inside a list, vectors stand in blocks of columns of one random rotation. After each block
the squared distance over the columns seen so far is tested against the distance that a vector would need to enter the query's best:
under a random rotation the seen share of a squared distance has a beta distribution, so a candidate whose seen part is beyond the
upper quantile of that share is abandoned. The few that remain are scored in double precision on their original components.
The first lists of a query are scanned first; the worst of the best found there is the bar for all its other lists.

Only centres, sizes of lists and the bounded measurement reach the driver. Large lists, and lists that many queries probe, are cut
into blocks on either side, so that no task holds more than BLOCK vectors and BLOCK queries of one list at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.common import stored
from voxelith.llm.veccodes import usable

#: Vectors, and queries, of one list that meet in one task; vectors between two looks at a query's bar; queries scanned together.
BLOCK, STEP, TOGETHER = 8192, 1024, 128


@dataclass(frozen=True)
class Search:
    """`k` neighbours; `lists` at most, of about `sample` rows each for the fit; `measured` rows whose neighbours settle how many
    lists are probed, so that they hold the share `reach` of them; `miss`: chance that a test abandons a true neighbour; `columns`
    of the first block."""

    k: int = 20
    lists: int = 8192
    sample: int = 40
    rounds: int = 5
    measured: int = 256
    reach: float = 0.97
    miss: float = 0.001
    columns: int = 16
    seed: int = 11


# ---- kernels ----


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each row the number of the nearest centre."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((x[i : i + 2048] @ centres.T - half).argmax(1) for i in range(0, len(x), 2048))])


@lru_cache(8)
def rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, size])).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


@lru_cache(8)
def ends(size: int, columns: int, miss: float) -> list[tuple[int, float]]:
    """(columns seen, largest share of a squared distance that they hold but with the chance `miss`), block after block."""
    step, out = max(columns, size // 16), []
    for d in [*range(min(columns, size), size, step), size]:
        share = 1.0
        if d < size:
            t = (np.arange(20_000) + 0.5) / 20_000
            log = (d / 2 - 1) * np.log(t) + ((size - d) / 2 - 1) * np.log1p(-t)
            mass = np.cumsum(np.exp(log - log.max()))
            share = float(t[np.searchsorted(mass, (1 - miss) * mass[-1])]) + 5e-5
        out.append((d, share))
    return out


def best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each group, smaller identities first among equals."""
    order = np.lexsort((ident, -score, group))
    g = group[order]
    first = np.searchsorted(g, g)
    return order[np.arange(len(g)) - first < k]


def scan(q: np.ndarray, own: np.ndarray, bar: np.ndarray, x: np.ndarray, row: np.ndarray, ident: np.ndarray, s: Search, work: dict | None = None) -> tuple[np.ndarray, ...]:
    """(query, place in x, score) of the k best of `x` for each query, but its own row and what cannot reach its bar (-inf: no bar yet).

    `work`, if given, counts the pairs and the columns of pairs that were looked at.
    """
    size = q.shape[1]
    turn, blocks = rotation(size, s.seed), ends(size, s.columns, s.miss)
    qr, xr = q @ turn, x @ turn
    cuts = [d for d, _ in blocks]
    seen = lambda m: np.stack([(m[:, :d] ** 2).sum(1) for d in cuts])
    qq, xx = seen(qr), seen(xr)
    found = []
    for lo in range(0, len(q), TOGETHER):
        a = slice(lo, min(lo + TOGETHER, len(q)))
        n = a.stop - lo
        mine, limit = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), bar[a].copy()
        for at in range(0, len(x), STEP):
            b = slice(at, min(at + STEP, len(x)))
            scale = qq[-1, a][:, None] + xx[-1, b]
            need = scale * (1 + 1e-9) - 2 * limit[:, None]  # the squared distance that reaches the bar
            need[own[a][:, None] == row[b]] = -1.0
            inner, i, j = np.zeros(need.shape), None, None
            for t, (d, share) in enumerate(blocks):
                since = cuts[t - 1] if t else 0
                if i is None:
                    inner += qr[a, since:d] @ xr[b, since:d].T
                    alive = qq[t, a][:, None] + xx[t, b] - 2 * inner <= np.where(np.isinf(need), np.inf, need * share + 1e-9 * scale)
                    alive &= need >= 0
                    if work is not None:
                        work["columns"] = work.get("columns", 0) + alive.size * (d - since)
                    if t + 1 == len(blocks) or alive.sum() < 0.15 * alive.size:
                        i, j = np.nonzero(alive)
                        inner, need = inner[i, j], need[i, j]
                else:
                    inner = inner + np.einsum("ij,ij->i", qr[a, since:d][i], xr[b, since:d][j])
                    if work is not None:
                        work["columns"] += len(i) * (d - since)
                    ok = qq[t, a][i] + xx[t, b][j] - 2 * inner <= need * share + 1e-9 * (qq[-1, a][i] + xx[-1, b][j])
                    i, j, inner, need = i[ok], j[ok], inner[ok], need[ok]
            if work is not None:
                work["pairs"] = work.get("pairs", 0) + n * (b.stop - at)
            score = np.concatenate([np.zeros(0), *((q[a][i[c : c + 65536]] * x[b][j[c : c + 65536]]).sum(1) for c in range(0, len(i), 65536))])
            ok = score >= limit[i]
            mine = tuple(np.concatenate([u, v[ok]]) for u, v in zip(mine, (i, j + at, score), strict=True))
            top = best(mine[0], mine[2], ident[mine[1]], s.k)
            mine = tuple(m[top] for m in mine)
            full = np.bincount(mine[0], minlength=n) >= s.k
            last = np.searchsorted(mine[0], np.arange(n), side="right") - 1
            limit[full] = np.maximum(limit[full], mine[2][last[full]])
        found.append((mine[0] + lo, *mine[1:]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


# ---- index ----


def _centres(rows: DataFrame, count: int, lists: int, size: int, s: Search) -> np.ndarray:
    """Centres of `lists` groups of a sample of `rows` (v): k-means on the executors, where one list's part of the sample is a group."""
    share = min(1.0, 1.1 * s.sample * lists / count)
    sample = stored(rows.select("v", F.rand(s.seed).alias("draw")).filter(F.col("draw") < share), "nearest-sample")
    if share < 1 and sample.count() < lists:
        sample = stored(rows.select("v", F.rand(s.seed).alias("draw")), "nearest-sample")
    now = matrix(sample.orderBy("draw").limit(lists).select("v").toArrow()["v"].combine_chunks(), size)
    for _ in range(s.rounds):

        def assign(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_pydict({"v": b["v"], "list": pa.array(closest(matrix(b["v"], size), now), pa.int32())})

        def middle(t: pa.Table) -> pa.Table:
            c = np.sort(matrix(t["v"].combine_chunks(), size), axis=0).mean(0)  # sorted, so that reruns add up in the same order
            return pa.table({"list": t["list"][:1], "c": pa.array([c.tolist()], pa.list_(pa.float64()))})

        kind = dict(sample.dtypes)["v"]
        moved = sample.select("v").mapInArrow(assign, f"v {kind}, list int").groupBy("list").applyInArrow(middle, "list int, c array<double>").toArrow()
        now = now.copy()
        if moved.num_rows:
            now[moved["list"].to_numpy()] = matrix(moved["c"].combine_chunks(), size)
    return now


def _listed(rows: DataFrame, centres: np.ndarray, size: int) -> DataFrame:
    """rows (vec_id, v) with row, a number of its own, and list."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"row": b["row"], "vec_id": b["vec_id"], "v": b["v"], "list": pa.array(closest(matrix(b["v"], size), centres), pa.int32())})

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    return numbered.mapInArrow(run, f"row long, vec_id {kinds['vec_id']}, v {kinds['v']}, list int")


def _true_neighbours(index: DataFrame, probe: pa.Table, size: int, s: Search) -> DataFrame:
    """(q, list) of the k nearest rows of each measured one: brute force against the whole index, a few rows a task."""
    q, own = matrix(probe["v"].combine_chunks(), size), probe["row"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                row, lists = part["row"].to_numpy(), part["list"].to_numpy()
                score = q @ matrix(part["v"], size).T
                score[own[:, None] == row] = -np.inf
                j = np.argpartition(-score, min(s.k, len(row)) - 1, 1)[:, : s.k]
                i = np.repeat(np.arange(len(q)), j.shape[1])
                j = j.reshape(-1)
                kept = [np.concatenate([u, v]) for u, v in zip(kept, (i, score[i, j], row[j], lists[j]), strict=True)]
                top = best(kept[0], kept[1], kept[2], s.k)
                kept = [u[top] for u in kept]
        yield pa.RecordBatch.from_pydict({"q": pa.array(kept[0], pa.int32()), "score": pa.array(kept[1]), "row": pa.array(kept[2]), "list": pa.array(kept[3], pa.int32())})

    near = index.select("row", "v", "list").mapInArrow(run, "q int, score double, row long, list int").filter(F.col("score") > float("-inf"))
    return _top(near, "q", F.col("row"), s.k).select("q", "list")


def _top(rows: DataFrame, group: str, ident, k: int) -> DataFrame:
    """The k best of each group with their rank; tasks keep no more than k of a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), ident.asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _probes(index: DataFrame, centres: np.ndarray, size: int, s: Search) -> int:
    """Lists to probe, so that they hold the share `reach` of the true neighbours of the measured rows."""
    probe = index.orderBy(F.xxhash64("row", F.lit(s.seed))).limit(s.measured).select("row", "v").toArrow()
    near = _true_neighbours(index, probe, size, s).toArrow()
    if not near.num_rows:
        return 1
    order = np.argsort(-(matrix(probe["v"].combine_chunks(), size) @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)[near["q"].to_numpy(), near["list"].to_numpy()]
    return int(np.sort(place)[min(len(place) - 1, math.ceil(s.reach * len(place)) - 1)]) + 1


# ---- search ----


def _planned(queries: DataFrame, centres: np.ndarray, sizes: np.ndarray, probes: int, size: int, s: Search) -> DataFrame:
    """row, query_id, v, lists (to probe, most promising first), lead (how many of them come first) of each query.

    Lists are added until they hold k rows besides the query's own, whatever was measured.
    """
    kinds = dict(queries.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                order = np.argsort(-(matrix(part["v"], size) @ centres.T), axis=1, kind="stable")
                enough = (np.cumsum(sizes[order], axis=1) < s.k + 1).sum(1) + 1
                lead = np.minimum(np.maximum(enough, max(1, probes // 8)), len(sizes))
                upto = np.minimum(np.maximum(enough, probes), len(sizes))
                lists = pa.array([o[:n] for o, n in zip(order.astype(np.int32), upto, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict({"row": part["row"], "query_id": part["vec_id"], "v": part["v"], "lists": lists, "lead": pa.array(lead, pa.int32())})

    return queries.select("row", "vec_id", "v").mapInArrow(run, f"row long, query_id {kinds['vec_id']}, v {kinds['v']}, lists array<int>, lead int")


def _searched(index: DataFrame, pairs: DataFrame, sizes: np.ndarray, size: int, s: Search) -> DataFrame:
    """row, query_id, vec_id, score: for each pair (row, query_id, v, bar, list), the list's best that reach the bar."""
    spark = index.sparkSession
    asked = {r["list"]: r["n"] for r in pairs.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = [(int(i), math.ceil(int(sizes[i]) / BLOCK) or 1, math.ceil(n / BLOCK)) for i, n in asked.items()]
    cut = F.broadcast(spark.createDataFrame(cut, "list int, parts int, shares int"))  # a row a list
    range_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = index.join(cut, "list").select("list", F.pmod("row", "parts").cast("int").alias("part"), range_("shares").alias("share"), "row", "vec_id", "v")
    asks = pairs.join(cut, "list").select("list", range_("parts").alias("part"), F.pmod(F.xxhash64("row"), "shares").cast("int").alias("share"), "row", "query_id", "v", "bar")
    kinds = dict(index.dtypes)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        one = lambda t, c: t[c].combine_chunks()
        ids, asked_by = one(left, "vec_id"), one(right, "query_id")
        ident = ids.cast(pa.int64()).fill_null(2**63 - 1).to_numpy() if pa.types.is_integer(ids.type) else np.argsort(np.argsort(np.array(ids.fill_null("\U0010ffff").to_pylist())))
        bar = one(right, "bar").fill_null(-np.inf).to_numpy(zero_copy_only=False)
        i, j, score = scan(matrix(one(right, "v"), size), right["row"].to_numpy(), bar, matrix(one(left, "v"), size), left["row"].to_numpy(), ident, s)
        return pa.table({"row": right["row"].take(pa.array(i)), "query_id": asked_by.take(pa.array(i)), "vec_id": ids.take(pa.array(j)), "score": pa.array(score)})

    key = ["list", "part", "share"]
    return asks.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(lambda q, x: run(x, q), f"row long, query_id {kinds['vec_id']}, vec_id {kinds['vec_id']}, score double")


def neighbours(vectors: DataFrame, is_query, s: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `vectors` (vec_id, embedding) where the column `is_query` holds, its k nearest
    other rows by inner product, nearest first, equals by vec_id; all of them, if there are fewer.

    Vectors that are null, zero or hold nulls or components that are not finite take no part, nor do those of another size than the
    most frequent one (the larger of equals). Rows are told apart by where they stand, not by vec_id: of repeated rows each is a
    candidate of the others, and each that is a query has its own answer. A row with a null vec_id is a candidate and comes last
    among equals. No rows give no rows. Other columns are ignored. Which rows are found depends on the lists probed and on tests that
    may abandon a true neighbour (see Search); scores are those of the original components in double precision.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("v")).filter(usable(F.col("embedding")) & F.exists("embedding", lambda c: c != 0))
    kind = dict(rows.dtypes)["vec_id"]
    most = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("size").desc()).limit(1).collect()
    if not most:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    size, count = most[0]["size"], most[0]["n"]
    rows = rows.filter(F.size("v") == size)
    lists = max(1, min(s.lists, round(math.sqrt(count))))
    centres = _centres(rows, count, lists, size, s)
    index = stored(_listed(rows, centres, size), "nearest-index")
    sizes = np.zeros(len(centres), np.int64)
    for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["list"]] = r["n"]
    probes = _probes(index, centres, size, s)
    queries = stored(_planned(index.filter(is_query), centres, sizes, probes, size, s), "nearest-queries")
    none = F.lit(None).cast("double").alias("bar")
    first = queries.select("row", "query_id", "v", none, F.explode(F.slice("lists", F.lit(1), F.col("lead"))).alias("list"))
    ident = F.col("vec_id")
    hits = stored(_top(_searched(index, first, sizes, size, s), "row", ident, s.k).drop("rank"), "nearest-hits")
    bars = hits.groupBy("row").agg(F.when(F.count(F.lit(1)) >= s.k, F.min("score")).alias("bar"))
    rest = queries.join(bars, "row", "left").select("row", "query_id", "v", "bar", F.explode(F.slice("lists", F.col("lead") + 1, F.greatest(F.size("lists") - F.col("lead"), F.lit(0)))).alias("list"))
    both = hits.unionByName(_searched(index, rest, sizes, size, s))
    return _top(both, "row", ident, s.k).select("query_id", "rank", "vec_id", "score")
