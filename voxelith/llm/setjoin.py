"""N-gram Jaccard join by universe partitioning.

Each document is its set of word shingles. Sets fall into size bands; a band divides the universe of
shingle hashes into as many segments as its largest set has members. Two sets of Jaccard similarity t or
more differ in at most H(size) members, so all but H of a set's non-empty segments agree with those of any
similar set: a set that indexes any H + 1 of them meets every similar set, as long as all sets choose in one
global order. That order is by cost: segments whose content is frequent in the corpus come last. A set with
too few non-empty segments for this indexes every segment with its one-deletion neighbourhood instead,
which counts double. Indexing EXTRA more keys makes similar sets meet that many times more. Sets that meet
often enough are verified exactly on their shingles.

Equal sets are one node from the start. Within a segment's bucket, members are first compared with one
leader (rows grow with the bucket, not with its square). Components of these links leave only buckets that
hold several components. There each set takes a hub, the leader that it meets most often. Sets of one hub are
compared by their differences from it: what only one set has can only add to a distance, so it is taken off
both sides' bounds first, and what is left of edited copies of one text is so little that few of them meet.
Pairs of sets with different hubs are counted over the buckets, which hold all their meetings, and verified if
they meet as often as similar sets must. So no link between components is lost and no group of copies is expanded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.common import drop_stored, gathered, mix, pieces, shingle_sets, small
from voxelith.llm.components import connected_components

#: Bands hold sizes [BAND ** i, BAND ** (i + 1)).
BAND = 4
#: Entries at most of the table of frequent segments that tasks get; beyond that, only the more frequent ones count.
FREQUENT_MAX = 2_000_000
#: Keys indexed beyond H + 1, as a share of the set.
EXTRA = 0.06
#: Nodes at most of which a list is broadcast to filter sets before they are shuffled; beyond that the filter is a shuffled join.
LISTED_MAX = 2_000_000
#: A segment's content counts as frequent from this many sets on.
FREQUENT_MIN = 16


@dataclass(frozen=True)
class Similarity:
    """100 * intersection >= percent * union."""

    percent: int = 75

    def differs(self, n: int, larger: bool) -> int:
        """Most members by which a set of n members and a similar one differ; `larger`: n is the larger of the two."""
        p = self.percent
        return 2 * n * (100 - p) // (100 + p) if larger else n * (100 - p) // p

    def least(self, n: int) -> int:
        """The smallest size of a set similar to one of n members."""
        return -(-n * self.percent // 100)


def _band(n: int) -> int:
    b = 0
    while BAND ** (b + 1) <= n:
        b += 1
    return b


def _segments(members: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted members' non-empty segments of m, and where each begins."""
    seg = ((members >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    return seg[start], start


def _keys(sums: np.ndarray, seg: np.ndarray, m: int, salt: int = 0) -> np.ndarray:
    return mix(sums + seg * np.uint64(0x9FB21C651E98DF25) + np.uint64((m * 0xD1342543DE82EF95 + salt) & (2**64 - 1)))


def schemes(members: np.ndarray, sim: Similarity) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each band that the set takes part in: segments m, most differences H, the set's non-empty segments and their keys."""
    n = len(members)
    own = _band(n)
    mixed = mix(members)
    for band in {own, _band(sim.least(n))}:
        m = BAND ** (band + 1)
        seg, start = _segments(members, m)
        yield m, sim.differs(n, larger=band < own), seg, _keys(np.add.reduceat(mixed, start), seg, m)


def index_keys(members: np.ndarray, sim: Similarity, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The keys under which a set is indexed, and how many of them a similar set with no smaller count shares at least."""
    out, need = [], int(EXTRA * len(members)) + 1
    for m, most, seg, keys in schemes(members, sim):
        if len(keys) > most:
            need = min(need, len(keys) - most)
            cost = np.zeros(len(keys), np.uint64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
                cost = np.where(frequent[at] == keys, counts[at], np.uint64(0))
            out.append(keys[np.lexsort((keys, cost))[: most + int(EXTRA * len(members)) + 1]])
            continue
        need = 1  # every segment, whole and with each one member left out; empty segments too
        out.append(keys)
        mixed = mix(members)
        every = np.arange(m, dtype=np.uint64)
        sums = np.zeros(m, np.uint64)
        home = ((members >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        np.add.at(sums, home, mixed)
        out += [_keys(sums, every, m, 1), _keys(sums[home] - mixed, home, m, 1)]
    return np.unique(np.concatenate(out)), need


def _fingerprint(members: np.ndarray) -> int:
    """A 64-bit hash of the set, as a signed long."""
    if not len(members):
        return 0
    h = mix(np.array([np.add.reduce(mix(members)) ^ np.bitwise_xor.reduce(mix(members + np.uint64(0x2545F4914F6CDD1D))) + np.uint64(len(members))], np.uint64))
    return int(h.view(np.int64)[0])


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """A list column of one array of unsigned numbers a row."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate([np.zeros(0, np.uint64), *parts])))


def profile(docs: DataFrame, sim: Similarity, k: int) -> DataFrame:
    """Rows of kind 0: doc_id, text_key, n, node (hashes of the text and of the set) for every document; of kind 1: key, n for contents of segments that several of a task's sets share."""

    names = ["kind", "doc_id", "text_key", "n", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def shared() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            held.clear()
            keys, n = keys[n >= 3], n[n >= 3]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int8)), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int64()), pa.array(n.astype(np.int64)), _longs(keys)], names)

        for whole in batches:
            for i, j in pieces(whole.column(2)):
                b = whole.slice(i, j - i)
                sizes, nodes = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
                for r, members in enumerate(shingle_sets(b.column(2), k)):
                    sizes[r], nodes[r] = len(members), (node := _fingerprint(members))
                    if len(members) and node not in seen:
                        seen.add(node)
                        held += [keys for *_, keys in schemes(members, sim)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(b), np.int8)), b.column(0), b.column(1), pa.array(sizes), pa.array(nodes)], names)
                if sum(map(len, held)) > 2_000_000:
                    yield shared()
        yield shared()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "kind byte, doc_id long, text_key long, n long, node long")


def frequent_contents(profiles: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of contents that many sets share, and how many sets do. FREQUENT_MAX entries at most: the count from which one is
    listed rises until they fit. Whatever this leaves out only costs time: any order gives the same links."""
    counted = gathered(profiles.filter("kind = 1").groupBy(F.col("node").alias("key")).agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_MIN), "frequent")
    sizes = sorted(counted.groupBy(F.floor(F.log2("n")).alias("e")).count().collect(), key=lambda r: -r["e"])
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > FREQUENT_MAX:
            break
        least = r["e"]
    if least is None:
        drop_stored(counted)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rows = counted.filter(F.floor(F.log2("n")) >= least).toArrow()
    drop_stored(counted)
    keys, n = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], np.log2(n[order]).astype(np.uint64) + np.uint64(1)


def index_rows(docs: DataFrame, sim: Similarity, k: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, need, n, keys, hot) for each distinct set of a task; `hot` tells which keys are among the frequent ones."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys_of, counts = held.value
        for texts in (b.column(0).slice(i, j - i) for b in batches for i, j in pieces(b.column(0))):
            nodes, needs, sizes, keys = [], [], [], []
            for members in shingle_sets(texts, k):
                node = _fingerprint(members)
                if len(members) and node not in seen:
                    seen.add(node)
                    own, need = index_keys(members, sim, keys_of, counts)
                    nodes.append(node)
                    keys.append(own)
                    needs.append(need)
                    sizes.append(len(members))
            hot = np.isin(np.concatenate([np.zeros(0, np.uint64), *keys]), keys_of)
            listed = _lists(keys)
            flags = pa.ListArray.from_arrays(listed.offsets, pa.array(hot))
            names = ["node", "need", "n", "keys", "hot"]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(needs, pa.int32()), pa.array(sizes, pa.int32()), listed, flags], names)

    return docs.select("text").mapInArrow(run, "node long, need int, n int, keys array<long>, hot array<boolean>")


def member_rows(docs: DataFrame, k: int, nodes: DataFrame) -> DataFrame:
    """(node, members) of the sets in `nodes`: sorted hashes. Only these sets are shuffled while the list is short enough to broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for texts in (b.column(0).slice(i, j - i) for b in batches for i, j in pieces(b.column(0))):
            nodes, sets = [], []
            for members in shingle_sets(texts, k):
                node = _fingerprint(members)
                if len(members) and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(members)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(sets)], ["node", "members"])

    return docs.select("text").mapInArrow(run, "node long, members array<long>").join(small(nodes, LISTED_MAX), "node").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """Those of `pairs` (a, b) whose sets are similar enough, compared member by member."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    x, y = F.size("x"), F.size("y")
    both = pairs.join(left, "a").join(right, "b").filter(100 * F.least(x, y) >= sim.percent * F.greatest(x, y))
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= sim.percent * (x + y - common)).select("a", "b")


def _same_hub(members: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b) of sets of one hub that may be similar. `members`: node, hub, comp.

    Let D be a set's difference from its hub and R the part of it that other sets of the hub have too. Sets of
    p and q members are similar if they differ by at most c (p + q), c = (100 - percent) / (100 + percent), that
    is if R_a and R_b have at least (U_a + U_b) / 2 in common, U = |D| - c size. A set that is not similar to its
    hub ("far") has U > c hub; sets that are get into its component by the pair with it, so only pairs with a far
    set count. This bounds what any partner must share with a set from below, so partners meet in the rarest
    members of R, those that the bound lets differ and one more. Sizes and 256 bits of R decide at the join
    whether a pair can reach its bound; those that can are left for verification.
    """
    low, high = 100 - sim.percent, 100 + sim.percent
    own = members.join(sets.select("node", F.col("members").alias("m")), "node").join(sets.select(F.col("node").alias("hub"), F.col("members").alias("h")), "hub")
    d = F.concat(F.array_except("m", "h"), F.array_except("h", "m"))
    apart = own.select("node", "hub", "comp", F.size("m").alias("q"), F.size("h").alias("hub_size"), d.alias("d"))
    apart = gathered(apart.withColumn("u", F.expr(f"{high}L * size(d) - {low}L * q")).withColumn("far", F.expr(f"u > {low}L * hub_size")), "differences")
    each = apart.select("hub", "node", F.explode("d").alias("e"))
    counts = each.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    word = F.pmod(F.col("e"), F.lit(4))
    bits = [F.coalesce(F.bit_or(F.when(word == i, F.expr("shiftleft(1L, CAST(shiftrightunsigned(e, 2) & 63 AS INT))"))), F.lit(0).cast("long")).alias(f"b{i}") for i in range(4)]
    common = each.join(counts, ["hub", "e"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", "e"))).getField("e").alias("r"), F.count(F.lit(1)).alias("n"), *bits)
    held = apart.drop("d").join(common, "node")
    # what a partner shares at least: with the index side by a far partner's U, with the far side by a partner's largest size
    index_least = F.expr(f"floor((u + {low}L * hub_size) / {2 * high}D) + 1")
    probe_least = F.expr(f"greatest(1L, CAST(ceil((u - {low}L * floor(100 * q / {sim.percent}D)) / {high}D) AS LONG))")
    held = gathered(held.withColumns({"first": (F.col("n") - index_least + 1).cast("int"), "tried": F.when(F.col("far"), F.col("n") - probe_least + 1).otherwise(0).cast("int")}), "shared-differences")
    kept = ["node", "comp", "q", "u", "n", "b0", "b1", "b2", "b3"]
    side = lambda upto: held.filter(F.col(upto) > 0).select("hub", *kept, F.explode(F.slice("r", F.lit(1), F.col(upto))).alias("e"))
    x, y = side("tried").alias("x"), side("first").alias("y")
    lacks = lambda s, t: sum((F.bit_count(F.col(f"{s}.b{i}").bitwiseAND(F.bitwise_not(f"{t}.b{i}"))) for i in range(4)), F.lit(0))
    bound = F.col("x.u") + F.col("y.u")
    may = (2 * high * (F.col("x.n") - lacks("x", "y")) >= bound) & (2 * high * (F.col("y.n") - lacks("y", "x")) >= bound)
    sizes = 100 * F.least("x.q", "y.q") >= sim.percent * F.greatest("x.q", "y.q")
    pairs = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.comp") != F.col("y.comp")) & sizes & may)
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return pairs.unionByName(apart.filter("not far and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))


def _hubs(rows: DataFrame) -> DataFrame:
    """(node, hub) for every set of `rows`: the leader that it meets most often, followed while that one is itself often met by another."""
    led = rows.join(rows.groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("leader")), "key")
    met = led.groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    best = met.groupBy("node").agg(F.max_by(F.struct(F.col("leader").alias("hub"), (F.col("n") >= F.col("need")).alias("near")), F.struct("n", "leader")).alias("h"))
    hubs = gathered(best.select("node", "h.hub", "h.near"), "hubs")
    while True:  # a leader never has a smaller degree than those it leads, so this ends
        up = hubs.filter("near and node <> hub").select(F.col("node").alias("hub"), F.col("hub").alias("top"))
        nxt = gathered(hubs.join(small(up, LISTED_MAX), "hub", "left").select("node", F.coalesce("top", "hub").alias("hub"), "near", F.col("top").isNotNull().alias("moved")), "hubs")
        drop_stored(hubs)
        hubs = nxt
        if not hubs.filter("moved").head(1):
            return hubs.select("node", "hub")


def labelled(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id for every row; see similar_components()."""
    sim = Similarity(percent)
    profiles = gathered(profile(docs, sim, k), "profiles")
    frequent = frequent_contents(profiles)
    keyed = index_rows(docs, sim, k, frequent).select("node", "need", "n", F.explode(F.arrays_zip("keys", "hot")).alias("k")).select("k.keys", "k.hot", "node", "need", "n").withColumnRenamed("keys", "key")
    # frequent keys are known to have several sets; their rows are dealt out over all tasks
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))).otherwise(0)
    bucket = Window.partitionBy("key", salt)
    shared = keyed.withColumns({"lo": F.min("node").over(bucket), "hi": F.max("node").over(bucket), "least": F.min("need").over(bucket)}).filter("hot or lo <> hi")
    shared = gathered(shared.select("key", "hot", "node", "need", "n", "least").distinct(), "buckets")

    # sets that meet others too seldom to be similar to any are done
    hot_least = shared.filter("hot").groupBy("key").agg(F.min("least").alias("hot_least"))
    degrees = shared.join(small(hot_least, LISTED_MAX), "key", "left").groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.min(F.coalesce("hot_least", "least")).alias("least"))
    nodes = gathered(degrees.filter("degree >= least").select("node", "degree"), "nodes")
    rows = gathered(shared.join(small(nodes, LISTED_MAX), "node").select("key", "node", "need", "n", "degree"), "rows")
    sets = gathered(member_rows(docs, k, nodes.select("node")), "sets", "lz4")
    drop_stored(shared, nodes)

    # each set with the leader that it meets most often; a bucket's leader is the member that meets most sets, which of a group of
    # edited copies is the original
    leaders = rows.groupBy("key").agg(F.max(F.struct("degree", "node", "need")).alias("leader"))
    led = rows.join(leaders, "key").filter("leader.node <> node")
    met = led.groupBy(F.col("leader.node").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(F.least("need", "leader.need")).alias("need"))
    best = met.filter("2 * n >= need").groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")
    links = gathered(verified(best, sets, sim), "links")
    comps = connected_components(links)
    held = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    left = gathered(held.join(several, "key").select("key", "node", "need", "n", "degree", "comp"), "rows")
    drop_stored(rows)
    rows = left

    # what is left: pairs between components, by their hub or by the buckets that they share
    hubs = gathered(_hubs(rows), "hubs")
    rest = gathered(rows.join(small(hubs, LISTED_MAX), "node"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    sizes = 100 * F.least("x.n", "y.n") >= sim.percent * F.greatest("x.n", "y.n")
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.hub") < F.col("y.hub")) & (F.col("x.comp") != F.col("y.comp")) & sizes)
    cross = cross.groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(F.least("x.need", "y.need")).alias("need"))
    cross = cross.filter("n >= need").select("a", "b")
    same = _same_hub(rest.select("node", "hub", "comp").distinct(), sets, sim)
    pairs = gathered(cross.unionByName(same).distinct(), "pairs")
    comps = connected_components(links.unionByName(verified(pairs, sets, sim)))

    rows = profiles.filter("kind = 0").select("doc_id", "text_key", "n", "node")
    first = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    ids = first.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = ids.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_node = gathered(ids.join(least, "comp").select("node", "component_id"), "components-by-set")
    drop_stored(rest, sets, pairs)
    out = rows.join(by_node, "node", "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def similar_components(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text).

    Words are lower-cased (A-Z) runs between ASCII white space; the set is the distinct k-word shingles, a
    shorter text's whole sequence as one, nothing for null or wordless texts, which stay alone. Documents
    link when 100 * intersection >= percent * union; component_id is the smallest doc_id reachable by links.
    Rows are told apart by their sets: repeated rows are linked copies. A null doc_id counts as larger than
    any other and gets its component's smallest id, or null. An empty table gives an empty result; extra
    columns are not read.
    """
    return labelled(docs, percent, k).drop("text_key")


def one_of_each(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """One row of `docs` for each component, with all its columns: the one with the smallest doc_id, ties by a hash of the text.

    Texts without words are in no component and stay, but rows equal in doc_id and text stay once.
    """
    rows = gathered(labelled(docs, percent, k), "labelled")
    first = rows.filter("n_shingles > 0 and component_id is not null").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("m"))
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    gone = rows.filter("n_shingles > 0").join(first, "component_id").filter(key != F.col("m")).select("doc_id", "text_key").distinct()
    gone = gathered(gone.withColumnsRenamed({"doc_id": "gone_id", "text_key": "gone_key"}), "gone")
    again = gathered(rows.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).count().filter("count > 1").drop("count"), "repeated")
    # texts stay where they are while the lists of rows that go and of rows that are repeated can be broadcast
    same = F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_key") == F.col("gone_key"))
    kept = docs.withColumns({"own_id": F.col("doc_id").cast("long"), "own_key": F.xxhash64("text")}).join(small(gone, LISTED_MAX), same, "left_anti")
    if again.head(1):
        listed = small(again, LISTED_MAX)
        kept = kept.join(listed, same, "left_anti").unionByName(kept.join(listed, same, "left_semi").dropDuplicates(["own_id", "own_key"]))
    return kept.drop("own_id", "own_key")
