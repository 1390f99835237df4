"""Product codes of vectors: integer k-means of each part by anchors-hierarchy metric trees.

Components become integers and a vector is cut into equal parts, each with a codebook of its own. Where rows are read, bounded blocks
of vectors are made into one metric tree for each part: anchors are picked far apart and take the points nearest to them, anchors are
merged upwards into ever larger balls and divided downwards by the same rule, and every ball caches its sum and count. The trees are
written once to the shared folder. A round walks down each tree with a list of the codebook's entries that can still be nearest to
some point of a ball; a ball hands its shortened list to its children, and as soon as one entry is left, that entry gets the cached
sum and count of the whole ball. Only points of the smallest balls that stay undecided are compared one by one, with the entries left.
Distances, sums and ties are integers, so the result is that of comparing everything with everything. What reaches the driver are the
sums of a round: parts x entries x components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.common import small, stored

#: Vectors of a block, and points of a ball that is not divided further.
BLOCK, LEAF = 4096, 64


@dataclass(frozen=True)
class Shape:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096

    def __post_init__(self) -> None:
        if not (self.parts > 0 and 0 < self.entries <= 256):
            raise ValueError("codes have at least one part and one byte for each, so at most 256 entries")


@dataclass
class Tree:
    """Balls over points in `order`: ball i holds the points lo[i] to hi[i] of that order, and has two children or none (-1)."""

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray


def _anchors(x: np.ndarray, count: int) -> np.ndarray:
    """For each point the number of its anchor, of at most `count`; each new anchor is the point farthest from its own."""
    d = np.sqrt(((x - x[0]) ** 2).sum(1))
    of = np.zeros(len(x), np.int64)
    places = [0]
    for new in range(1, count):
        far = int(d.argmax())
        if d[far] == 0:
            break
        apart = np.sqrt(((x[places] - x[far]) ** 2).sum(1))
        near = np.flatnonzero(2 * d > apart[of])  # the others are nearer to their anchor than half its distance from the new one
        mine = np.sqrt(((x[near] - x[far]) ** 2).sum(1))
        won = mine < d[near]
        d[near[won]], of[near[won]] = mine[won], new
        places.append(far)
    return np.unique(of, return_inverse=True)[1]


def _merged(centres: np.ndarray, radii: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls to be merged, in order; the result of the i-th merger is ball len(centres) + i."""
    n = len(centres)
    c, r, k = (np.concatenate([a, np.zeros((n - 1, *a.shape[1:]))]) for a in (centres, radii, counts.astype(float)))
    alive = np.arange(2 * n - 1) < n
    width = np.full((2 * n - 1, 2 * n - 1), np.inf)  # of the ball around two others, as twice its radius
    width[:n, :n] = np.sqrt(((centres[:, None] - centres) ** 2).sum(2)) + radii[:, None] + radii
    np.fill_diagonal(width, np.inf)
    out = []
    for new in range(n, 2 * n - 1):
        i, j = divmod(int(width.argmin()), 2 * n - 1)
        out.append((i, j))
        alive[[i, j]] = False
        width[[i, j]] = width[:, [i, j]] = np.inf
        k[new] = k[i] + k[j]
        c[new] = (c[i] * k[i] + c[j] * k[j]) / k[new]
        r[new] = max(math.dist(c[new], c[i]) + r[i], math.dist(c[new], c[j]) + r[j])
        at = np.flatnonzero(alive)
        width[new, at] = width[at, new] = np.sqrt(((c[at] - c[new]) ** 2).sum(1)) + r[at] + r[new]
        alive[new] = True
    return out


def grow(x: np.ndarray) -> Tree:
    """The tree of the points `x` (n, components), whole numbers as doubles; n at least 1."""
    order, nodes = [], []  # nodes: [lo, hi, left, right], children after their parent

    def divide(points: np.ndarray, node: int) -> None:
        """Make `node` the ball of `points`: a leaf, or anchors of them merged pair by pair."""
        own = x[points]
        of = _anchors(own, math.ceil(math.sqrt(len(points)))) if len(points) > LEAF else None
        if of is None or not of.any():
            nodes[node][:2] = len(order), len(order) + len(points)
            order.extend(points.tolist())
            return
        counts = np.bincount(of)
        by = np.argsort(of, kind="stable")
        groups = np.split(points[by], np.cumsum(counts)[:-1])
        centres = np.add.reduceat(own[by], np.cumsum(counts) - counts) / counts[:, None]
        radii = np.sqrt(np.maximum.reduceat(((own[by] - np.repeat(centres, counts, 0)) ** 2).sum(1), np.cumsum(counts) - counts))
        pairs = _merged(centres, radii, counts)

        def place(ball: int, node: int) -> None:
            if ball < len(groups):
                divide(groups[ball], node)
                return
            lo = len(order)
            for side, child in enumerate(pairs[ball - len(groups)], 2):
                nodes[node][side] = len(nodes)
                nodes.append([0, 0, -1, -1])
                place(child, nodes[node][side])
            nodes[node][:2] = lo, len(order)

        place(len(groups) + len(pairs) - 1, node)

    nodes.append([0, 0, -1, -1])
    divide(np.arange(len(x)), 0)
    order_, table = np.array(order, np.int32), np.array(nodes, np.int32)
    sorted_ = x[order_]
    upto = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(sorted_.astype(np.int64), 0)])
    lo, hi = table[:, 0], table[:, 1]
    total = upto[hi] - upto[lo]
    centre = total / (hi - lo)[:, None]
    radius = np.sqrt(np.array([((sorted_[a:b] - c) ** 2).sum(1).max() for a, b, c in zip(lo, hi, centre, strict=True)]))
    return Tree(order_, lo, hi, table[:, 2], table[:, 3], centre, radius, total)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and the range that each is in."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - (np.cumsum(n) - n)[of] + lo[of], of


def _nearest(points: np.ndarray, entries: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """For each point its nearest entry among those allowed to it, the lowest of equals."""
    p, e = np.nonzero(allowed)
    d = np.full(allowed.shape, np.iinfo(np.int64).max)
    d[p, e] = ((points[p] - entries[e]) ** 2).sum(1)
    return d.argmin(1)


def owners(tree: Tree, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Whole balls and single points with the entry nearest to them: (balls, their entries), (places in the order, their entries).

    `x` are the points in the tree's order, as integers. An entry leaves a ball's list if every point of the ball is nearer to the
    entry nearest to its centre: for entries a, b the difference of squared distances changes by at most 2 |a - b| radius inside the
    ball. Sums in doubles get a margin; equal entries beyond the first never own anything.
    """
    e = entries.astype(float)
    gap = np.sqrt(((e[:, None] - e) ** 2).sum(2))
    first = np.array([not (entries[:i] == entries[i]).all(1).any() for i in range(len(entries))])
    balls, lists = np.zeros(1, np.int64), first[None, :]
    own, single = [], []
    while len(balls):
        d = np.where(lists, ((tree.centre[balls][:, None] - e) ** 2).sum(2), np.inf)
        best = d.argmin(1)
        least = d[np.arange(len(balls)), best][:, None]
        reach = 2 * tree.radius[balls][:, None] * gap[best]
        lists = lists & (d - least <= reach + 1e-9 * (least + reach + 1))
        done = lists.sum(1) == 1
        own.append((balls[done], lists[done].argmax(1)))
        balls, lists = balls[~done], lists[~done]
        leaf = tree.left[balls] < 0
        if leaf.any():
            b, allowed = balls[leaf], lists[leaf]
            alike = tree.radius[b] == 0
            own.append((b[alike], _nearest(x[tree.lo[b[alike]]], entries, allowed[alike])))
            at, of = _spread(tree.lo[b[~alike]], tree.hi[b[~alike]])
            single.append((at, _nearest(x[at], entries, allowed[~alike][of])))
        balls, lists = balls[~leaf], lists[~leaf]
        balls, lists = np.concatenate([tree.left[balls], tree.right[balls]]), np.concatenate([lists, lists])
    none = np.zeros(0, np.int64)
    join = lambda pairs: tuple(np.concatenate([none, *c]) for c in zip(*pairs, strict=True)) if pairs else (none, none)
    return join(own), join(single)


def gathered(tree: Tree, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the points that each entry owns."""
    (balls, of), (at, one) = owners(tree, x, entries)
    total, count = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    np.add.at(total, of, tree.total[balls])
    np.add.at(count, of, (tree.hi - tree.lo)[balls])
    for k in np.unique(one):
        total[k] += x[at[one == k]].sum(0)
    return total, count + np.bincount(one, minlength=len(entries))


def assigned(tree: Tree, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entry of each point, in the tree's order."""
    (balls, of), (at, one) = owners(tree, x, entries)
    out = np.empty(len(x), np.int64)
    places, ball = _spread(tree.lo[balls], tree.hi[balls])
    out[places], out[at] = of[ball], one
    return out


# ---- Spark ----

_KINDS = dict(zip(Tree.__dataclass_fields__, (np.int32,) * 5 + (np.float64,) * 2 + (np.int64,), strict=True))


def usable(vector: Column, size: int | None = None) -> Column:
    """Whether a vector has only finite components, and `size` of them."""
    ok = vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(ok if size is None else ok & (F.size(vector) == size), F.lit(False))


def whole(flat: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * component), refusing what squared distances in 64 bits could not hold."""
    out = np.floor(flat.astype(float) * scale)
    if len(out) and np.abs(out).max() > limit:
        raise ValueError(f"a component times {scale} is beyond {limit}")
    return out


def largest(size: int) -> int:
    """The largest size of an integer component: squared distances over the vector stay below 2 to the 63."""
    return min(2**31 - 1, math.isqrt((2**63 - 1) // max(1, size)) // 2)


def planted(rows: DataFrame, size: int, shape: Shape) -> DataFrame:
    """The trees of `rows` (vec_id, v, label), a row for each block: ids, labels, integers, and a tree for each part."""
    width, limit = size // shape.parts, largest(size)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                x = whole(b["v"].flatten().to_numpy(zero_copy_only=False), shape.scale, limit).reshape(-1, size)
                trees = [grow(np.ascontiguousarray(x[:, i * width : (i + 1) * width])) for i in range(shape.parts)]
                one = {"ids": pa.array([b["vec_id"].to_pylist()], pa.list_(b["vec_id"].type)), "labels": pa.array([b["label"].to_pylist()], pa.list_(b["label"].type)), "x": [x.astype("<i4").tobytes()]}
                one["trees"] = [[{f: getattr(t, f).astype(k).tobytes() for f, k in _KINDS.items()} for t in trees]]
                kind = pa.list_(pa.struct([(f, pa.binary()) for f in _KINDS]))
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kind if k == "trees" else None) if isinstance(v, list) else v for k, v in one.items()})

    nodes = ", ".join(f"{f}: binary" for f in _KINDS)
    return rows.mapInArrow(run, f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, x binary, trees array<struct<{nodes}>>")


def _loaded(batch: pa.RecordBatch, row: int, size: int, shape: Shape) -> Iterator[tuple[int, Tree, np.ndarray]]:
    """(part, tree, its points in the tree's order) of a stored block."""
    x = np.frombuffer(batch["x"][row].as_py(), "<i4").reshape(-1, size).astype(np.int64)
    width = size // shape.parts
    for part, node in enumerate(batch["trees"][row].as_py()):
        t = Tree(**{f: np.frombuffer(node[f], k) for f, k in _KINDS.items()})
        t.centre, t.total = t.centre.reshape(-1, width), t.total.reshape(-1, width)
        yield part, t, x[t.order, part * width : (part + 1) * width]


def codebooks(trees: DataFrame, first: np.ndarray, size: int, shape: Shape) -> np.ndarray:
    """The entries (parts, entries, components) after all rounds, from `first`."""
    books = first
    for _ in range(shape.rounds):
        now = books

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total, count, any_ = np.zeros_like(now), np.zeros(now.shape[:2], np.int64), False
            for b in batches:
                for row in range(b.num_rows):
                    any_ = True
                    for part, tree, x in _loaded(b, row, size, shape):
                        t, c = gathered(tree, x, now[part])
                        total[part] += t
                        count[part] += c
            if any_:
                full = np.concatenate([total, count[..., None]], 2)
                at = np.arange(full.size)
                yield pa.RecordBatch.from_pydict({"at": pa.array(at), "n": pa.array(full.reshape(-1))})

        sums = trees.select("x", "trees").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
        full = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for r in sums:
            full.reshape(-1)[r["at"]] = r["n"]
        used = full[..., -1] > 0
        books = books.copy()
        books[used] = full[used][:, :-1] // full[used][:, -1:]
    return books


def compress(vectors: DataFrame, shape: Shape = Shape()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of each kept row of `vectors` (vec_id, embedding, label); the codebooks).

    Rows whose vector is null, or holds a null or a component that is not finite, are dropped, and so are vectors of another size than
    that of the first kept row; that size must be a multiple of the parts. Rows are in order of vec_id, nulls last, equal ids by their
    vectors; the first ones start the codebooks (all of them, if there are fewer than entries). A row is kept for each time that it
    occurs, and a null label or id is kept. No rows give no rows and empty codebooks. Components of more than largest() / scale are
    refused. Other columns are ignored. Blocks are made where rows are read, so nothing is shuffled but sums.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("v"), "label").filter(usable(F.col("embedding")) & (F.size("embedding") > 0))
    rows = rows.select("vec_id", "v", "label")
    order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    first = rows.select("vec_id", "v").orderBy(*order).limit(1).collect()
    kind = dict(vectors.dtypes)
    schema = f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"
    if not first:
        return vectors.sparkSession.createDataFrame([], schema), np.zeros((shape.parts, 0, 0), np.int64)
    size = len(first[0]["v"])
    if size % shape.parts:
        raise ValueError(f"vectors of {size} components can't be cut into {shape.parts} equal parts")
    rows = rows.filter(F.size("v") == size)
    seeds = np.array([r["v"] for r in rows.select("vec_id", "v").orderBy(*order).limit(shape.entries).collect()], float)
    width = size // shape.parts
    start = whole(seeds, shape.scale, largest(size)).astype(np.int64).reshape(-1, shape.parts, width).transpose(1, 0, 2)
    trees = stored(planted(rows, size, shape), "vector-trees")
    books = codebooks(trees, np.ascontiguousarray(start), size, shape)
    digits = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), "S2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                n = len(b["ids"][row])
                code, error = np.zeros((n, shape.parts), np.int64), np.zeros(n, np.int64)
                for part, tree, x in _loaded(b, row, size, shape):
                    own = assigned(tree, x, books[part])
                    code[tree.order, part] = own
                    error[tree.order] += ((x - books[part][own]) ** 2).sum(1)
                text = digits[code].view(f"S{2 * shape.parts}").reshape(-1).astype(str)
                yield pa.RecordBatch.from_pydict({"vec_id": b["ids"][row].values, "label": b["labels"][row].values, "code": pa.array(text), "error": pa.array(error)})

    return trees.mapInArrow(run, schema), books


def digest(books: np.ndarray) -> str:
    """sha256 of all components of all entries, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame, labels_at_once: int = 100_000) -> DataFrame:
    """`coded` (vec_id, label, code, error) with label_error: the sum of error over equal labels, nulls being equal.

    Sums are partly made before the shuffle, so a frequent label is no burden; they are broadcast only if there are few.
    """
    kept = stored(coded, "vector-codes")
    sums = kept.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error"))
    return kept.join(small(sums, labels_at_once), kept["label"].eqNullSafe(F.col("label_"))).drop("label_")
