"""Headers and orientation. Every operator here is a projection, or a join with the one-row-a-volume header table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.functions.columns import pick

AFFINE = [f"a{r}{c}" for r in range(3) for c in range(4)]
#: Extents of a volume, the world axis of each of its axes, and their signs.
AXES = [f"{k}{i}" for k in "ndg" for i in range(3)]
#: Element types by format code: name, bits, Spark type that holds it.
DTYPES = ((2, "uint8", 8, "smallint"), (4, "int16", 16, "smallint"), (8, "int32", 32, "int"), (16, "float32", 32, "float"), (64, "float64", 64, "double"), (256, "int8", 8, "tinyint"), (512, "uint16", 16, "int"), (768, "uint32", 32, "bigint"))


def a(r: int, c: int) -> Column:
    return F.col(f"a{r}{c}")


def header_status(h: DataFrame) -> DataFrame:
    """`h` with `status`: ok, or the first reason to set the file aside. Compare n_bytes with what the header promises.

    The promised size is a double: any extents that a damaged header may hold fit, and whole sizes are exact up to 2 ** 53 bytes. A
    null n_bytes is a size that is not known and does not count against a file. A reader's own reason in `problem` comes first;
    scales and affine rows count where `h` has them.
    """
    wide = lambda c: F.col(c).cast("double")
    need = F.when(F.col("vox_offset") == 0, 352.0).otherwise(wide("vox_offset")) + wide("n0") * wide("n1") * wide("n2") * wide("bitpix") / 8
    codes = [d[0] for d in DTYPES]
    problem = F.col("problem") if "problem" in h.columns else F.lit(None).cast("string")
    odd = lambda cs: reduce(or_, (F.col(c).isNull() | F.isnan(wide(c)) | (F.abs(wide(c)) == float("inf")) for c in cs if c in h.columns), F.lit(False))
    rows = [f"s{r}{c}" for r in range(3) for c in range(4)]
    return h.withColumn(
        "status",
        F.when(problem.isNotNull(), problem)
        .when(F.col("n_bytes") < 348, "short_file")
        .when(F.col("sizeof_hdr") != 348, "bad_header_size")
        .when(~F.col("magic").isin("n+1", "ni1"), "bad_magic")
        .when(F.col("ndim") < 3, "not_3d")
        .when((F.col("ndim") > 3) & (F.col("dim4") > 1), "four_d")
        .when(~F.col("datatype").isin(codes), "unsupported_type")
        .when(odd(["vox_offset"]) | (F.col("vox_offset") < 0), "bad_offset")
        .when(F.col("n_bytes") < need, "truncated")
        .when((F.col("n0") < 1) | (F.col("n1") < 1) | (F.col("n2") < 1), "bad_extent")
        .when(odd(["scl_slope", "scl_inter"]), "bad_scale")
        .when((F.col("sform_code") > 0) & odd(rows) if "sform_code" in h.columns else F.lit(False), "bad_affine")
        .otherwise("ok"),
    )


def default_affine(h: DataFrame) -> DataFrame:
    """Identity rotation with the volume's centre at the origin, for arrays without a header."""
    one = {f"a{r}{c}": F.lit(1.0 if r == c else 0.0) for r in range(3) for c in range(3)}
    return h.withColumns(one | {f"a{r}3": -(F.col(f"n{r}") - 1) / 2.0 for r in range(3)})


def quaternion_affine(h: DataFrame, prefix: str = "") -> DataFrame:
    """Affine from qb, qc, qd, pixdims p0..p2, offsets o0..o2 and qfac, in columns `prefix`a00 and so on."""
    b, c, d = F.col("qb"), F.col("qc"), F.col("qd")
    rest = 1 - (b * b + c * c + d * d)
    norm = F.sqrt(b * b + c * c + d * d)
    tiny = rest < 1e-7
    h = h.withColumns({"qa_": F.when(tiny, 0.0).otherwise(F.sqrt(F.greatest(rest, F.lit(0.0)))), "qb_": F.when(tiny, b / norm).otherwise(b), "qc_": F.when(tiny, c / norm).otherwise(c), "qd_": F.when(tiny, d / norm).otherwise(d)})
    qa, b, c, d = (F.col(f"q{k}_") for k in "abcd")
    size = [F.when(F.col(f"p{i}") > 0, F.col(f"p{i}")).otherwise(1.0) for i in range(3)]
    size[2] = F.when(F.col("qfac") < 0, -size[2]).otherwise(size[2])
    r = [
        [qa * qa + b * b - c * c - d * d, 2 * (b * c - qa * d), 2 * (b * d + qa * c)],
        [2 * (b * c + qa * d), qa * qa + c * c - b * b - d * d, 2 * (c * d - qa * b)],
        [2 * (b * d - qa * c), 2 * (c * d + qa * b), qa * qa + d * d - b * b - c * c],
    ]
    cols = {f"{prefix}a{i}{j}": r[i][j] * size[j] for i in range(3) for j in range(3)} | {f"{prefix}a{i}3": F.col(f"o{i}") for i in range(3)}
    return h.withColumns(cols).drop("qa_", "qb_", "qc_", "qd_")


def select_affine(h: DataFrame) -> DataFrame:
    """The affine that a header gives: sform rows s00.. if sform_code > 0, else its quaternion if qform_code > 0, else the pixdims."""
    h = quaternion_affine(h, "q_")
    out = {}
    for i in range(3):
        for j in range(4):
            plain = F.col(f"p{i}") if i == j else F.lit(0.0)
            out[f"a{i}{j}"] = F.when(F.col("sform_code") > 0, F.col(f"s{i}{j}")).when(F.col("qform_code") > 0, F.col(f"q_a{i}{j}")).otherwise(plain)
    return h.withColumns(out).drop(*(f"q_{c}" for c in AFFINE))


def axes_to_canonical(h: DataFrame) -> DataFrame:
    """d0..d2 and g0..g2: for each input axis in order, the unused world axis with the largest entry (the first of equals), and its sign."""
    used: list[Column] = []
    for i in range(3):
        size = [F.when(_any(used, j), -1.0).otherwise(F.abs(a(j, i))) for j in range(3)]
        best = F.when((size[0] >= size[1]) & (size[0] >= size[2]), 0).when(size[1] >= size[2], 1).otherwise(2)
        h = h.withColumn(f"d{i}", best)
        h = h.withColumn(f"g{i}", F.when(pick([a(j, i) for j in range(3)], F.col(f"d{i}")) >= 0, 1).otherwise(-1))
        used.append(F.col(f"d{i}"))
    return h


def _any(used: list[Column], j: int) -> Column:
    out = F.lit(False)
    for u in used:
        out = out | (u == j)
    return out


def canonical_affine(h: DataFrame) -> DataFrame:
    """c00.. of the reoriented volume: columns moved and turned, the origin moved along turned axes. Needs d*, g* and n*."""
    out = {}
    for r in range(3):
        for j in range(3):
            out[f"c{r}{j}"] = sum((F.when(F.col(f"d{i}") == j, F.col(f"g{i}") * a(r, i)).otherwise(0.0) for i in range(1, 3)), F.when(F.col("d0") == j, F.col("g0") * a(r, 0)).otherwise(0.0))
        out[f"c{r}3"] = sum((F.when(F.col(f"g{i}") < 0, a(r, i) * (F.col(f"n{i}") - 1)).otherwise(0.0) for i in range(3)), a(r, 3))
    return h.withColumns(out)


def _with_axes(voxels: DataFrame, axes: DataFrame | None) -> DataFrame:
    """Voxels with AXES of their volume. Of both sides only the headers, one row a volume, are ever built into a table: Spark takes voxels
    exploded from headers or planes for no more than those, and would broadcast them."""
    return voxels if axes is None else voxels.join(axes.select("vol", *AXES).hint("shuffle_hash"), "vol")


def to_canonical(voxels: DataFrame, axes: DataFrame | None = None) -> DataFrame:
    """Voxels (vol, i0, i1, i2, ...) with canonical z, y, x. Without `axes` voxels carry AXES themselves and keep them: nothing is shuffled."""
    both = _with_axes(voxels, axes)
    turned = [F.when(F.col(f"g{i}") > 0, F.col(f"i{i}")).otherwise(F.col(f"n{i}") - 1 - F.col(f"i{i}")) for i in range(3)]
    axis = lambda j: F.when(F.col("d0") == j, turned[0]).when(F.col("d1") == j, turned[1]).otherwise(turned[2]).cast("int")
    return both.withColumns({"z": axis(2), "y": axis(1), "x": axis(0)}).select(*[c for c in voxels.columns if c not in ("i0", "i1", "i2")], "z", "y", "x")


def from_canonical(voxels: DataFrame, axes: DataFrame | None = None) -> DataFrame:
    """The inverse: canonical z, y, x back to i0, i1, i2 of the input's axes. `axes` as in to_canonical()."""
    both = _with_axes(voxels, axes)
    world = F.array("x", "y", "z")
    own = lambda i: F.element_at(world, F.col(f"d{i}") + 1)
    back = {f"i{i}": F.when(F.col(f"g{i}") > 0, own(i)).otherwise(F.col(f"n{i}") - 1 - own(i)).cast("int") for i in range(3)}
    return both.withColumns(back).select(*[c for c in voxels.columns if c not in ("z", "y", "x")], "i0", "i1", "i2")


def zooms(h: DataFrame) -> DataFrame:
    """Voxel sizes z0..z2: norms of the affine's columns, right for oblique scans too."""
    return h.withColumns({f"z{c}": F.sqrt(a(0, c) * a(0, c) + a(1, c) * a(1, c) + a(2, c) * a(2, c)) for c in range(3)})


def rescaled(v: Column, slope: Column, inter: Column) -> Column:
    """v * slope + inter where the slope is set and changes anything."""
    return F.when((slope != 0) & ((slope != 1) | (inter != 0)), v * slope + inter).otherwise(v)


def upsampled_affine(h: DataFrame, spacing: float) -> DataFrame:
    """u00..: columns scaled to `spacing`, the origin moved by half the change of a voxel. Needs z*."""
    scale = [F.lit(spacing) / F.col(f"z{i}") for i in range(3)]
    out = {f"u{r}{i}": a(r, i) * scale[i] for r in range(3) for i in range(3)}
    out |= {f"u{r}3": sum((a(r, i) * 0.5 * (scale[i] - 1) for i in range(3)), a(r, 3)) for r in range(3)}
    return h.withColumns(out)


def output_header(h: DataFrame, channels: bool = False) -> DataFrame:
    """vol, n0..n2, v0..v2 (column norms), data_type and bit_depth of an output file: labels, or one float a class."""
    z = zooms(h)
    return z.select("vol", "n0", "n1", "n2", *(F.col(f"z{i}").alias(f"v{i}") for i in range(3)), F.lit("single" if channels else "uint8").alias("data_type"), F.lit(32 if channels else 8).alias("bit_depth"))
