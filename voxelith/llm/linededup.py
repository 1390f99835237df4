"""Line deduplication within an edit bound, by deletion neighbourhoods.

Every line of at least MIN_CHARS characters is compared with every other: an equal line, or one within
MAX_EDITS (one) character edits, at an earlier place takes it out. Two strings within one edit share a
variant: each as it is, or with one character left out. Variants are hashed keys that an equi-join matches;
pairs are verified by edit distance.

Two strings within one edit also agree in one half: up to the middle before the edit, or from the middle
after it. So only lines that share a half with another line emit variants at all, and only of what lies
outside that half, keyed together with it; other variants could match nothing that the check would keep.
What lies there is cut into runs of WINDOW characters from both ends, whose hashes are chained: a variant is the
hashes of the whole runs before and after the character left out, and the few characters between them, so a line
of n characters costs n times WINDOW, not n times n. Equal lines are one row from the start, held by their
earliest place, so copies and very common lines add nothing to the joins. A line needs only the earliest place
among the lines near it, so no bucket is paired with itself: lines that lack a character at the same position all differ
in that one character, and each is compared with the earliest of them; a line as it is is compared with the earliest that
is longer by one, and those with it.

Everything here is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.common import drop_stored, key128, small, stored

MIN_CHARS, MAX_EDITS = 20, 1
#: Characters of a run; a variant's middle has less than two.
WINDOW = 128
#: Documents and removed lines at most whose lists are broadcast: some 20 MB.
CHANGED_MAX, REMOVED_MAX = 200_000, 4_000_000
#: Shared halves, and lines with an earlier place, at most that are broadcast.
HALVES_MAX, BOUNDS_MAX = 2_000_000, 500_000


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, line_no, line) of every line that takes part."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.filter(F.length("line") >= min_chars)


def place() -> Column:
    """Order of places: doc_id (null last), line number, a hash of the text for equal ids."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("line_no").alias("line_no"), F.col("text_key").alias("text_key"))


def halves(line: Column, n: Column) -> Column:
    """(side, cut, half): the halves of which a line within one edit shares one, cut at half of the shorter line's length from either end."""
    cuts = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")))

    def both(m: Column) -> Column:
        end = lambda side, part: F.struct(F.lit(side).alias("side"), m.alias("cut"), F.xxhash64(F.lit(side), m, part).alias("half"))
        return F.array(end("b", F.substring(line, F.lit(1), m)), end("a", F.substring(line, n - m + 1, m)))

    return F.flatten(F.transform(cuts, both))


def outside(line: Column, n: Column, h: Column) -> Column:
    """What of the line lies outside a half."""
    return F.when(h["side"] == "b", F.substring(line, h["cut"] + 1, n)).otherwise(F.substring(line, F.lit(1), n - h["cut"]))


def runs(text: Column) -> Column:
    """The text's runs of WINDOW characters, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0))


def chained(parts: Column, start: Column) -> Column:
    """`start`, and the hash of everything up to each run."""
    return F.aggregate(parts, F.array(start), lambda acc, x: F.array_append(acc, F.xxhash64(F.element_at(acc, -1), x)))


def variants(emitted: DataFrame) -> DataFrame:
    """(k1, k2, variant, at): keys of `rest` as it is (at 0) and with each one character left out (at its place), together with the half
    beside it. `emitted`: k1, k2, half, rest.

    With t whole runs before a character and u after it, a variant's key is (half, hash of the t, hash of the u, what is
    between them without the character). A text as it is meets a longer one's variants under the t and u of that one.
    """
    n, w = F.col("n"), F.lit(WINDOW)
    cut = emitted.withColumns({"n": F.length("rest"), "parts": runs(F.col("rest")), "ends": runs(F.reverse("rest"))})
    cut = cut.select("k1", "k2", "n", "parts", chained(F.col("parts"), F.col("half")).alias("before"), chained(F.col("ends"), F.lit(1).cast("long")).alias("after"))
    a = F.floor(n / w).cast("int")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), a), lambda t: F.array(F.struct(t.alias("t"), (a - t - 1).alias("u")), F.struct(t.alias("t"), (a - t).alias("u")))))
    part = lambda i: F.coalesce(F.get("parts", i), F.lit(""))
    first = lambda n, t, u: F.greatest(F.lit(1), n - w * (u + 1) - w * t + 1)
    last = lambda n, t, u: F.least(w, n - w * u - w * t)

    def between(p: Column) -> Column:
        t, u = p["t"], p["u"]
        middle = F.substring(F.concat(part(t), part(t + 1)), F.lit(1), F.greatest(F.lit(0), n - w * u - w * t))
        whole = first(n + 1, t, u) <= last(n + 1, t, u)
        return F.struct((t * w).alias("first"), middle.alias("m"), first(n, t, u).alias("lo"), last(n, t, u).alias("hi"), whole.alias("whole"), F.xxhash64(F.get("before", t), F.get("after", u), t, u).alias("base"))

    # only what lies between is copied for each pair of runs, not the runs themselves
    at = cut.select("k1", "k2", F.explode(F.transform(F.filter(pairs, lambda p: p["u"] >= 0), between)).alias("b")).select("k1", "k2", "b.*")
    at = at.filter("lo <= hi or whole")
    form = lambda key, i: F.struct(key.alias("variant"), i.cast("int").alias("at"))
    left_out = lambda i: form(F.xxhash64("base", F.concat(F.substring("m", F.lit(1), i - 1), F.substring("m", i + 1, F.lit(2 * WINDOW)))), F.col("first") + i)
    keys = F.when(F.col("lo") <= F.col("hi"), F.transform(F.sequence("lo", "hi"), left_out)).otherwise(F.array().cast("array<struct<variant:bigint,at:int>>"))
    keys = F.when(F.col("whole"), F.array_append(keys, form(F.xxhash64("base", "m"), F.lit(0)))).otherwise(keys)
    return at.select("k1", "k2", F.explode(keys).alias("key")).select("k1", "k2", "key.variant", "key.at")


def within_edits(x: Column, y: Column) -> Column:
    """Whether two lines are within MAX_EDITS edits. Equal runs at both ends of long lines, which don't change the distance, are taken off
    first: what is left of lines within the bound is short, and lines of which more is left are not."""

    def equal_runs(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda u, v: F.coalesce(u == v, F.lit(False)))
        at = F.array_position(same, F.lit(False))
        return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")

    n, m = F.length(x), F.length(y)
    p = equal_runs(runs(x), runs(y))
    q = F.least(equal_runs(runs(F.reverse(x)), runs(F.reverse(y))), F.floor((F.least(n, m) - p * WINDOW) / WINDOW).cast("int"))
    middle = lambda text, size: F.substring(F.array_join(F.slice(runs(text), p + 1, F.lit(4)), ""), F.lit(1), size - (p + q) * WINDOW)
    near = (F.greatest(n, m) - (p + q) * WINDOW <= 3 * WINDOW) & (F.levenshtein(middle(x, n), middle(y, m), MAX_EDITS) >= 0)
    return (F.abs(n - m) <= MAX_EDITS) & F.when(F.greatest(n, m) <= 4 * WINDOW, F.levenshtein(x, y, MAX_EDITS) >= 0).otherwise(near)


def _of_several(rows: DataFrame, key: str) -> DataFrame:
    """(key) of those keys that `rows` (k1, k2, key) have with more than one line."""
    ends = [f(k).alias(f"{n}{k}") for k in ("k1", "k2") for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy(key).agg(*ends).filter("lok1 <> hik1 or lok2 <> hik2").select(key)


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, removed): the line numbers that go, for each document that loses any."""
    keyed = lines_of(docs, min_chars).withColumns(dict(zip(("k1", "k2"), key128(F.col("line")), strict=True)))
    copied = keyed.groupBy("k1", "k2").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")

    # distinct lines that share a half with another one
    n = F.length("line")
    shared = keyed.select("k1", "k2", F.explode(F.transform(halves(F.col("line"), n), lambda h: h["half"])).alias("half"))
    shared = stored(_of_several(shared, "half"), "shared-halves")
    close = keyed.withColumn("part", F.explode(halves(F.col("line"), n))).join(small(shared, HALVES_MAX), F.col("part.half") == F.col("half"), "left_semi")
    close = stored(close.groupBy("k1", "k2").agg(F.min(place()).alias("first"), F.min("line").alias("line"), F.collect_set("part").alias("parts")), "close-lines")

    # equal variants, verified
    # the exchange also keeps the planner from computing `rest` again for each variant
    emitted = close.select("k1", "k2", "line", F.explode("parts").alias("part"))
    emitted = emitted.select("k1", "k2", F.col("part.half").alias("half"), outside(F.col("line"), F.length("line"), F.col("part")).alias("rest")).repartition("k1", "k2")
    emitted = stored(variants(emitted), "emitted")
    met = emitted.join(_of_several(emitted, "variant"), "variant", "left_semi")
    met = stored(met.join(close.select("k1", "k2", "first"), ["k1", "k2"]), "variants")
    best = F.min(F.struct("first", "k1", "k2"))
    beside = met.filter("at > 0").groupBy("variant", "at").agg(best.alias("y"))
    whole = met.groupBy("variant").agg(F.min(F.when(F.col("at") == 0, F.struct("first", "k1", "k2"))).alias("short"), F.min(F.when(F.col("at") > 0, F.struct("first", "k1", "k2"))).alias("long"))
    whole = whole.filter("short is not null and long is not null")
    aims = met.filter("at > 0").join(beside, ["variant", "at"]).select("k1", "k2", "y")
    aims = aims.unionByName(met.join(whole, "variant").select("k1", "k2", F.when(F.col("at") == 0, F.col("long")).otherwise(F.col("short")).alias("y")))
    pairs = aims.select(F.col("k1").alias("xk1"), F.col("k2").alias("xk2"), F.col("y.k1").alias("yk1"), F.col("y.k2").alias("yk2")).filter("xk1 <> yk1 or xk2 <> yk2").distinct()
    side = lambda s: close.select(F.col("k1").alias(f"{s}k1"), F.col("k2").alias(f"{s}k2"), F.col("line").alias(f"{s}_line"))
    near = pairs.join(side("x"), ["xk1", "xk2"]).join(side("y"), ["yk1", "yk2"])
    near = near.filter(within_edits(F.col("x_line"), F.col("y_line"))).select("xk1", "xk2", "yk1", "yk2")
    near = stored(near, "near-lines")
    places = close.select(F.col("k1").alias("yk1"), F.col("k2").alias("yk2"), F.col("first").alias("other"))
    earlier = near.join(places, ["yk1", "yk2"]).groupBy(F.col("xk1").alias("k1"), F.col("xk2").alias("k2")).agg(F.min("other").alias("first"))
    own = close.join(earlier.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "first")

    # lines with copies or near ones, and the earliest place that keeps them out
    bound = copied.unionByName(earlier).unionByName(own).groupBy("k1", "k2").agg(F.min("first").alias("earliest"))
    bound = stored(bound, "earliest")
    gone = keyed.select("doc_id", "text_key", "line_no", "k1", "k2").join(small(bound, BOUNDS_MAX), ["k1", "k2"]).filter(place() > F.col("earliest"))
    gone = stored(gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("removed")), "removed-lines")
    drop_stored(shared, close, emitted, met, near, bound)
    return gone


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` (doc_id, text) with text, n_lines and n_removed: each text without lines that have an earlier equal or nearly equal line.

    Lines end at \\n. A line of fewer than `min_chars` characters always stays (1 compares every line but empty ones). A line goes if a line equal to it
    or within MAX_EDITS character edits stands earlier: in a document of smaller doc_id (null last), or
    further up in its own; it goes even if that earlier line goes as well. Rows equal in doc_id and text
    are in the same place, so neither takes lines from the other. Null texts stay null with no lines, empty
    texts have one empty line. An empty table gives an empty result; other columns are dropped.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    gone = removed_lines(docs, min_chars).withColumnsRenamed({"doc_id": "g_id", "text_key": "g_key"})
    if (gone.agg(F.sum(F.size("removed"))).first()[0] or 0) <= REMOVED_MAX:
        gone = small(gone, CHANGED_MAX)
    out = rows.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("g_id")) & (F.col("text_key") == F.col("g_key")), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("removed"), i))
    return out.select(
        "doc_id",
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )
