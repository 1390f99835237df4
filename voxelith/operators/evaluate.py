"""Agreement of two label maps or two score tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.session import new_path


def confusion(pairs: DataFrame) -> DataFrame:
    """vol, ref, pred, n: joint counts; every report below is made from these few rows."""
    return pairs.groupBy("vol", "ref", "pred").agg(F.count(F.lit(1)).alias("n"))


def runs(labels: DataFrame, width: Column) -> DataFrame:
    """vol, z, runs: each plane of a label map (vol, z, y, x, label) as runs of equal labels, places counted as y * width + x.

    Places that are missing end a run. A null label is no voxel. Of a place given more than once the smallest label counts.
    """
    at = (F.col("y") * width + F.col("x")).cast("long")
    cells = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("label").cast("int").alias("label"))))
    rows = labels.filter("label is not null").groupBy("vol", "z").agg(cells.alias("c"))
    own = lambda s, i: (i == 0) | (F.try_element_at("c", i)["at"] < s["at"])
    rows = rows.withColumn("c", F.filter("c", own))
    new = lambda s, i: (i == 0) | (F.try_element_at("c", i)["at"] + 1 < s["at"]) | (F.try_element_at("c", i)["label"] != s["label"])
    marked = F.filter(F.transform("c", lambda s, i: F.struct(s["at"].alias("at"), s["label"].alias("label"), i.alias("i"), new(s, i).alias("new"))), lambda s: s["new"])
    rows = rows.withColumn("m", marked)
    length = lambda s, j: F.coalesce(F.try_element_at("m", j + 2)["i"], F.size("c")) - s["i"]
    return rows.select("vol", "z", F.transform("m", lambda s, j: F.struct(s["at"].alias("at"), length(s, j).cast("int").alias("n"), s["label"].alias("label"))).alias("runs"))


def compared(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """vol, ref, pred, n of two separate maps as runs(): joint counts, with a null where only one map has the voxel.

    Runs of a plane are joined by (vol, z) and merged run by run, so shuffles carry runs. The counts go into dice() and the
    other reports once voxels of one side are taken out or given a label.
    """
    kind = dict(ref.dtypes)["vol"]
    both = ref.select("vol", "z", F.col("runs").alias("a")).join(pred.select("vol", "z", F.col("runs").alias("b")), ["vol", "z"], "full")

    def sides(column):
        import numpy as np

        flat = column.flatten()
        ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy())
        at, n, label = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("at", "n", "label"))
        return [(at[i:j], n[i:j], label[i:j]) for i, j in zip(np.append(0, ends[:-1]), ends, strict=True)]

    def labels_of(side, cuts):
        """The side's label from each cut to the next, the least number where it has none."""
        import numpy as np

        at, n, label = side
        i = np.searchsorted(at, cuts[:-1], side="right") - 1
        return np.where((i >= 0) & (cuts[:-1] < at[i] + n[i]), label[i].astype(np.int64), np.iinfo(np.int64).min)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        none = np.iinfo(np.int64).min
        for b in batches:
            vols, refs, preds, counts = [], [], [], []
            for k, (x, y) in enumerate(zip(sides(b["a"]), sides(b["b"]), strict=True)):
                cuts = np.unique(np.concatenate([x[0], x[0] + x[1], y[0], y[0] + y[1]]))
                if len(cuts) < 2:
                    continue
                pair = np.stack([labels_of(s, cuts) if len(s[0]) else np.full(len(cuts) - 1, none) for s in (x, y)], 1)
                kinds, of = np.unique(pair, axis=0, return_inverse=True)
                n = np.bincount(of.reshape(-1), np.diff(cuts)).astype(np.int64)
                some = (kinds != none).any(1)
                vols += [k] * int(some.sum())
                refs.append(kinds[some, 0])
                preds.append(kinds[some, 1])
                counts.append(n[some])
            cat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
            label = lambda parts: pa.array(np.where(cat(parts) == none, 0, cat(parts)), pa.int32(), mask=cat(parts) == none)
            yield pa.RecordBatch.from_pydict({"vol": b["vol"].take(pa.array(vols, pa.int64())), "ref": label(refs), "pred": label(preds), "n": pa.array(cat(counts))})

    each = both.select("vol", "a", "b").mapInArrow(run, f"vol {kind}, ref int, pred int, n long")
    return each.groupBy("vol", "ref", "pred").agg(F.sum("n").alias("n"))


def dice(counts: DataFrame) -> DataFrame:
    """vol, label, n_ref, n_pred, n_both, dice over the union of labels; 1 where neither side has the label."""
    ref = counts.groupBy("vol", F.col("ref").alias("label")).agg(F.sum("n").alias("n_ref"), F.sum(F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0)).alias("n_both"))
    pred = counts.groupBy("vol", F.col("pred").alias("label")).agg(F.sum("n").alias("n_pred"))
    both = ref.join(pred, ["vol", "label"], "full").na.fill(0, ["n_ref", "n_pred", "n_both"])
    total = F.col("n_ref") + F.col("n_pred")
    return both.withColumn("dice", F.when(total > 0, 2.0 * F.col("n_both") / total).otherwise(1.0))


def agreement(counts: DataFrame) -> DataFrame:
    """vol, matches, voxels, agreement."""
    same = F.sum(F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0))
    return counts.groupBy("vol").agg(same.alias("matches"), F.sum("n").alias("voxels"), (same / F.sum("n")).alias("agreement"))


def verdict(dices: DataFrame, floor: float = 0.99) -> DataFrame:
    """vol, worst, verdict: pass if the worst Dice reaches the floor."""
    worst = F.min("dice")
    return dices.groupBy("vol").agg(worst.alias("worst"), F.when(worst >= floor, "PASS").otherwise("FAIL").alias("verdict"))


def mean_foreground(dices: DataFrame) -> DataFrame:
    """vol, mean_dice over labels other than 0."""
    return dices.filter("label <> 0").groupBy("vol").agg(F.avg("dice").alias("mean_dice"))


def shape_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """vol, same: whether both sides have the volume in the same extent. `a`, `b`: vol, nz, ny, nx."""
    both = a.alias("a").join(b.alias("b"), F.col("a.vol") == F.col("b.vol"), "full")
    equal = (F.col("a.nz") == F.col("b.nz")) & (F.col("a.ny") == F.col("b.ny")) & (F.col("a.nx") == F.col("b.nx"))
    return both.select(F.coalesce("a.vol", "b.vol").alias("vol"), F.coalesce(equal, F.lit(False)).alias("same"))


#: Values of a key that are sorted at once, and intervals that a key's values are counted in.
SORTED_MAX, INTERVALS = 10_000, 512


def exact_median(rows: DataFrame, key: str, value: str, most: int = SORTED_MAX) -> DataFrame:
    """key, median: the middle value of each key, the mean of the two middle ones of an even number; NaN counts as larger than all.

    Values are counted in intervals between a key's smallest and largest, and only the interval that holds the middle is counted anew, between
    the smallest and largest value in it, until it holds `most` values at most or one value only; those are sorted. So no task
    holds more than `most` values of a key. Intervals are even in the logarithm while they span more than a factor of four. Nulls
    are left out, and so are keys without values.
    """
    spark = rows.sparkSession
    data = rows.select(F.col(key).alias("key_"), F.col(value).cast("double").alias("v")).filter("v is not null")
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    wild = lambda c: F.count(F.when(c, 1))
    ends = data.groupBy("key_").agg(F.count(F.lit(1)).alias("n"), wild(F.col("v") == float("-inf")).alias("low"), wild(finite).alias("k"), wild(F.col("v") == float("inf")).alias("high"), F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi"))
    rank = F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    aims = ends.withColumn("rank", rank).withColumn("side", F.when(F.col("rank") * 2 < F.col("n") - 1, 0).otherwise(1)).distinct()
    inner = F.col("rank") - F.col("low")
    known = F.when(inner < 0, float("-inf")).when(inner < F.col("k"), F.when(F.col("lo") == F.col("hi"), F.col("lo"))).when(inner < F.col("k") + F.col("high"), float("inf")).otherwise(float("nan"))
    aims = aims.select("key_", "side", inner.alias("rank"), "k", "lo", "hi", known.alias("found"))

    def kept(df: DataFrame) -> DataFrame:
        path = new_path(spark, "medians")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    aims = kept(aims)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    while aims.filter(F.col("found").isNull() & (F.col("k") > most)).head(1):
        wide = aims.filter(F.col("found").isNull() & (F.col("k") > most)).select(F.col("key_").alias("of"), "side", "rank", "lo", "hi")
        near = data.join(wide, same("key_", "of")).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        low = lambda c: F.when(c > 0, F.ln(c)).otherwise(-746.0)
        steep = (F.col("lo") >= 0) & (F.col("hi") > 4 * F.col("lo"))
        place = F.when(steep, (low(F.col("v")) - low(F.col("lo"))) / (low(F.col("hi")) - low(F.col("lo")))).otherwise((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
        bin_ = F.least(F.floor(place * INTERVALS), F.lit(INTERVALS - 1)).alias("bin")
        counted = near.groupBy("of", "side", "rank", bin_).agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        bins = F.array_sort(F.collect_list(F.struct("bin", "k", "lo", "hi")))  # at most INTERVALS of them
        held = counted.groupBy("of", "side", "rank").agg(bins.alias("b"))
        walk = F.aggregate("b", F.struct(F.col("rank").alias("left"), F.lit(None).cast("struct<bin:bigint,k:bigint,lo:double,hi:double>").alias("at")), lambda a, x: F.when(a["at"].isNotNull(), a).when(a["left"] < x["k"], F.struct(a["left"].alias("left"), x.alias("at"))).otherwise(F.struct((a["left"] - x["k"]).alias("left"), a["at"].alias("at"))))
        step = held.select("of", "side", walk.alias("w")).select(F.col("of").alias("key_"), "side", F.col("w.left").alias("rank"), F.col("w.at.k").alias("k"), F.col("w.at.lo").alias("lo"), F.col("w.at.hi").alias("hi"))
        step = step.withColumn("found", F.when(F.col("lo") == F.col("hi"), F.col("lo")))
        aims = kept(aims.filter(F.col("found").isNotNull() | (F.col("k") <= most)).unionByName(step))
    few = aims.filter("found is null").select(F.col("key_").alias("of"), "side", "rank", "lo", "hi")
    last = data.join(few, same("key_", "of")).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    last = last.groupBy("of", "side", "rank").agg(F.sort_array(F.collect_list("v")).alias("vs")).select(F.col("of").alias("key_"), "side", F.expr("vs[CAST(rank AS INT)]").alias("found"))
    both = aims.filter("found is not null").select("key_", "side", "found").unionByName(last).groupBy("key_").agg(F.avg("found").alias("median"))
    return both.select(F.col("key_").alias(key), "median")


def parity(pairs: DataFrame, argmax) -> DataFrame:
    """case, max_diff, mean_diff, median_diff, agreement from rows (case, p, q) of two logits arrays; the median is exact."""
    diffs = pairs.select("case", F.explode(F.zip_with("p", "q", lambda a, b: F.abs(a - b))).alias("d"))
    d = diffs.groupBy("case").agg(F.max("d").alias("max_diff"), F.avg("d").alias("mean_diff"))
    same = pairs.groupBy("case").agg(F.avg((argmax(F.col("p")) == argmax(F.col("q"))).cast("double")).alias("agreement"))
    return d.join(exact_median(diffs, "case", "d"), "case").withColumnRenamed("median", "median_diff").join(same, "case").select("case", "max_diff", "mean_diff", "median_diff", "agreement")


def parity_verdict(agree: Column, most: Column, gate: Column | float) -> Column:
    """PASS, PARTIAL or FAIL from the agreement and the largest difference."""
    return F.when((agree >= 0.999) & (most < gate), "PASS").when(agree >= 0.99, "PARTIAL").otherwise("FAIL")


def class_counts(labels: DataFrame) -> DataFrame:
    """vol, label, n."""
    return labels.groupBy("vol", "label").agg(F.count(F.lit(1)).alias("n"))


def type_histogram(rows: DataFrame) -> DataFrame:
    """op_type, n, gate: FATAL for the three-dimensional convolutions, PARTIAL for other names that end in 3D, else PASS."""
    gate = F.when(F.col("op_type").rlike(r"(?i)(conv(olution)?3d$|convtranspose3d$|convolution3ddepthwise)"), "FATAL").when(F.col("op_type").rlike(r"^[A-Za-z]+3D$"), "PARTIAL").otherwise("PASS")
    return rows.groupBy("op_type").agg(F.count(F.lit(1)).alias("n")).withColumn("gate", gate)


def runtime_ratio(runs: DataFrame, base: str, other: str, fast: str) -> DataFrame:
    """base_ratio, side_fail, speedup, verdict from rows (op_type, wall): mean wall times of three back ends against each other."""
    mean = lambda t: F.avg(F.when(F.col("op_type") == t, F.col("wall")))
    r = runs.agg(mean(base).alias("b"), mean(other).alias("o"), mean(fast).alias("f")).select((F.col("o") / F.col("b")).alias("base_ratio"), (F.col("o") / F.col("f")).alias("speedup"))
    return r.select("base_ratio", (F.col("base_ratio") > 1.5).alias("side_fail"), "speedup", F.when(F.col("speedup") >= 5, "STRONG").when(F.col("speedup") >= 2, "MARGINAL").otherwise("FAIL").alias("verdict"))
