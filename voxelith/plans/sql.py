"""DuckDB texts of the catalog's queries. They share the views with it and nothing else: joins on taps and on
tile ranges stand where the operators use arrays."""

from __future__ import annotations

import re

from voxelith.plans.views import VIEWS

AIR = 5
BINS = (5, 0, 1, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0, 3, 4, 3, 4, 0)
_BINS = "(VALUES " + ", ".join(f"({c}, {b})" for c, b in enumerate(BINS)) + ") AS bins(c, bin)"

C: dict[str, str] = dict(VIEWS)
C["bbox"] = "SELECT vol, " + ", ".join(f"coalesce(min(CASE WHEN val <> 0 THEN {k} END), 0) AS {k}lo, coalesce(max(CASE WHEN val <> 0 THEN {k} END) + 1, max({k}) + 1) AS {k}hi" for k in "zyx") + " FROM vox GROUP BY vol"
C["cropped"] = "SELECT v.vol, z - zlo AS z, y - ylo AS y, x - xlo AS x, val FROM vox v JOIN bbox b ON v.vol = b.vol WHERE z >= zlo AND z < zhi AND y >= ylo AND y < yhi AND x >= xlo AND x < xhi"
C["zed"] = "SELECT c.vol, z, y, x, (val - m) / greatest(s, 1e-8) AS val FROM cropped c JOIN (SELECT vol, avg(val) AS m, stddev_pop(val) AS s FROM cropped GROUP BY vol) t ON c.vol = t.vol"
C["cshape"] = "SELECT b.vol, zhi - zlo AS nz, yhi - ylo AS ny, xhi - xlo AS nx, sz, sy, sx FROM bbox b JOIN volmeta m ON b.vol = m.vol"
C["fshape"] = "SELECT vol, nz, ny, nx, " + ", ".join(f"CAST(round(n{k} * s{k} / 0.75) AS INT) AS t{k}" for k in "zyx") + " FROM cshape"
C["mshape"] = "SELECT *, " + ", ".join(f"CAST(round(n{k} * s{k} / 0.75) AS INT) AS t{k}" for k in "zyx") + " FROM volmeta"
C["padded"] = """SELECT s.vol, gz.z, gy.y, gx.x, coalesce(val, 0) AS val FROM (
  SELECT vol, nz, ny, nx, greatest(nz, 8) AS pz, greatest(ny, 8) AS py, greatest(nx, 8) AS px FROM cshape) s
  CROSS JOIN LATERAL (SELECT unnest(range(pz)) AS z) gz CROSS JOIN LATERAL (SELECT unnest(range(py)) AS y) gy CROSS JOIN LATERAL (SELECT unnest(range(px)) AS x) gx
  LEFT JOIN cropped c ON c.vol = s.vol AND c.z + (pz - nz) // 2 = gz.z AND c.y + (py - ny) // 2 = gy.y AND c.x + (px - nx) // 2 = gx.x"""
C["hvox"] = "SELECT vol, i0, i1, i2, CAST(i0 + 10 * i1 + 100 * i2 AS DOUBLE) AS val FROM hdr, range(6) a(i0), range(5) b(i1), range(6) c(i2) WHERE i0 < n0 AND i1 < n1 AND i2 < n2"
C["axes"] = """SELECT *, 3 - d0 - d1 AS d2,
  CASE WHEN CASE d0 WHEN 0 THEN a00 WHEN 1 THEN a10 ELSE a20 END >= 0 THEN 1 ELSE -1 END AS g0,
  CASE WHEN CASE d1 WHEN 0 THEN a01 WHEN 1 THEN a11 ELSE a21 END >= 0 THEN 1 ELSE -1 END AS g1,
  CASE WHEN CASE 3 - d0 - d1 WHEN 0 THEN a02 WHEN 1 THEN a12 ELSE a22 END >= 0 THEN 1 ELSE -1 END AS g2
FROM (SELECT *, CASE d0 WHEN 0 THEN CASE WHEN abs(a11) >= abs(a21) THEN 1 ELSE 2 END WHEN 1 THEN CASE WHEN abs(a01) >= abs(a21) THEN 0 ELSE 2 END
                ELSE CASE WHEN abs(a01) >= abs(a11) THEN 0 ELSE 1 END END AS d1
  FROM (SELECT *, CASE WHEN abs(a00) >= abs(a10) AND abs(a00) >= abs(a20) THEN 0 WHEN abs(a10) >= abs(a20) THEN 1 ELSE 2 END AS d0 FROM hdr) p) q"""


def _axis(j: int) -> str:
    turned = [f"CASE WHEN g{i} > 0 THEN i{i} ELSE n{i} - 1 - i{i} END" for i in range(3)]
    return f"CASE WHEN d0 = {j} THEN {turned[0]} WHEN d1 = {j} THEN {turned[1]} ELSE {turned[2]} END"


C["ras"] = f"SELECT v.vol, {_axis(2)} AS z, {_axis(1)} AS y, {_axis(0)} AS x, val FROM hvox v JOIN axes a ON v.vol = a.vol"


def _weight(order: int) -> str:
    if order == 1:
        return "CASE tap WHEN 0 THEN 1 - f ELSE f END"
    return "CASE tap WHEN 0 THEN 0.5 * (-f + 2*f*f - f*f*f) WHEN 1 THEN 0.5 * (2 - 5*f*f + 3*f*f*f) WHEN 2 THEN 0.5 * (f + 4*f*f - 3*f*f*f) ELSE 0.5 * (f*f*f - f*f) END"


def tap_rows(shape: str, axis: str, order: int, n: str | None = None, t: str | None = None) -> str:
    """vol, k, tap, i, w of one axis of a shape table with n<axis> and t<axis>."""
    n, t, taps, first = n or f"n{axis}", t or f"t{axis}", 2 if order == 1 else 4, 0 if order == 1 else -1
    return f"""SELECT vol, k, tap, greatest(0, least(n - 1, i0 + tap + {first})) AS i, {_weight(order)} AS w
FROM (SELECT vol, {n} AS n, k, tap, CAST(floor((k + 0.5) * {n} / {t} - 0.5) AS INT) AS i0, ((k + 0.5) * {n} / {t} - 0.5) - floor((k + 0.5) * {n} / {t} - 0.5) AS f
      FROM {shape}, range(64) a(k), range({taps}) b(tap) WHERE k < {t}) q"""


def resampled(source: str, shape: str, order: int, value: str = "val", extra: str = "", n: str = "n", t: str = "t") -> str:
    """All three axes at once, by joins with the taps. `extra` lists further key columns."""
    e = f", {extra}" if extra else ""
    taps = {k: tap_rows(shape, k, order, f"{n}{k}", f"{t}{k}") for k in "zyx"}
    return f"""SELECT v.vol, tz.k AS z, ty.k AS y, tx.k AS x{e}, sum(tz.w * ty.w * tx.w * {value}) AS {value}
FROM {source} v JOIN ({taps['z']}) tz ON v.vol = tz.vol AND v.z = tz.i JOIN ({taps['y']}) ty ON v.vol = ty.vol AND v.y = ty.i JOIN ({taps['x']}) tx ON v.vol = tx.vol AND v.x = tx.i
GROUP BY v.vol, tz.k, ty.k, tx.k{e}"""


def start_rows(shape: str, axis: str, fixed: bool = False) -> str:
    """vol, i, b: tile starts of an axis with n<axis>, patch 8, ratio 0.5."""
    if fixed:
        return f"""SELECT vol, CAST(row_number() OVER (PARTITION BY vol ORDER BY b) - 1 AS INT) AS i, b FROM (
  SELECT vol, b FROM {shape}, range(0, 64, 4) r(b) WHERE b <= greatest(n{axis} - 8, 0)
  UNION SELECT vol, greatest(0, n{axis} - 8) FROM {shape} WHERE (greatest(n{axis} - 8, 0) // 4) * 4 + 8 < n{axis}) u"""
    return f"SELECT vol, CAST(i AS INT) AS i, CAST(CASE WHEN k = 0 THEN 0 ELSE round(i * (n{axis} - 8) / k) END AS INT) AS b FROM (SELECT vol, n{axis}, CAST(ceil((n{axis} - 8) / 4.0) AS INT) AS k FROM {shape}) s, range(32) r(i) WHERE i <= k AND n{axis} >= 8"


def tiled(source: str, shape: str, fixed: bool = False) -> str:
    """vol, tile_id, lz, ly, lx, z, y, x, val by range joins."""
    s = {k: start_rows(shape, k, fixed) for k in "zyx"}
    return f"""SELECT v.vol, (sz.i * cy.n + sy.i) * cx.n + sx.i AS tile_id, v.z - sz.b AS lz, v.y - sy.b AS ly, v.x - sx.b AS lx, v.z, v.y, v.x, val
FROM {source} v JOIN ({s['z']}) sz ON v.vol = sz.vol AND v.z >= sz.b AND v.z < sz.b + 8 JOIN ({s['y']}) sy ON v.vol = sy.vol AND v.y >= sy.b AND v.y < sy.b + 8
JOIN ({s['x']}) sx ON v.vol = sx.vol AND v.x >= sx.b AND v.x < sx.b + 8
JOIN (SELECT vol, count(*) AS n FROM ({s['y']}) q GROUP BY vol) cy ON v.vol = cy.vol JOIN (SELECT vol, count(*) AS n FROM ({s['x']}) q GROUP BY vol) cx ON v.vol = cx.vol"""


WEIGHT = "10 * exp(-0.5 * ((lz - 4) * (lz - 4) + (ly - 4) * (ly - 4) + (lx - 4) * (lx - 4)))"
C["fw"] = "SELECT fold, c, CAST(p.embedding[fold * 18 + c + 1] AS DOUBLE) AS w, CAST(q.embedding[fold * 18 + c + 1] AS DOUBLE) AS b FROM embeddings p, embeddings q, range(2) f(fold), range(3) g(c) WHERE p.vec_id = 0 AND q.vec_id = 1"


def scored(source: str) -> str:
    return f"SELECT t.*, fold, c, w * val + b + 0.01 * tile_id * (c % 3) AS v FROM ({source}) t, fw"


C["scores"] = scored(tiled("vox", "volmeta"))
C["scores_fixed"] = scored(tiled("vox", "volmeta", True))
C["lg"] = "SELECT vec_id, fold, c, CAST(embedding[fold * 18 + c + 1] AS DOUBLE) AS v FROM embeddings, range(3) f(fold), range(18) g(c)"
C["mean"] = "SELECT vec_id, c, avg(v) AS v FROM lg GROUP BY vec_id, c"
C["soft"] = "SELECT vec_id, c, exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY vec_id) AS v FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM mean) q"
C["merged"] = f"SELECT vec_id, bin AS c, sum(v) AS v FROM soft JOIN {_BINS} ON soft.c = bins.c GROUP BY vec_id, bin"
C["counts"] = "SELECT vol, ref, pred, count(*) AS n FROM lab GROUP BY vol, ref, pred"
C["dices"] = """SELECT coalesce(a.vol, b.vol) AS vol, coalesce(a.label, b.label) AS label, coalesce(n_ref, 0) AS n_ref, coalesce(n_pred, 0) AS n_pred, coalesce(n_both, 0) AS n_both,
  2.0 * coalesce(n_both, 0) / (coalesce(n_ref, 0) + coalesce(n_pred, 0)) AS dice
FROM (SELECT vol, ref AS label, count(*) AS n_ref, count(*) FILTER (WHERE ref = pred) AS n_both FROM lab GROUP BY vol, ref) a
FULL JOIN (SELECT vol, pred AS label, count(*) AS n_pred FROM lab GROUP BY vol, pred) b ON a.vol = b.vol AND a.label = b.label"""
C["parity"] = """SELECT kase, max(d) AS max_diff, avg(d) AS mean_diff, quantile_cont(d, 0.5) AS median_diff FROM pq GROUP BY kase"""
C["pq"] = "SELECT p.vec_id, p.vec_id % 5 AS kase, p.c, p.v AS p, p.v + r.v * 0.0005 * (p.vec_id % 5) AS q, abs(p.v - (p.v + r.v * 0.0005 * (p.vec_id % 5))) AS d FROM lg p JOIN lg r ON p.vec_id = r.vec_id AND p.c = r.c AND p.fold = 0 AND r.fold = 1"
C["agree"] = "SELECT kase, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS agreement FROM (SELECT vec_id, kase, arg_max(c, ROW(p, -c)) AS a, arg_max(c, ROW(q, -c)) AS b FROM pq GROUP BY vec_id, kase) s GROUP BY kase"

# the flagship's steps
C["fine"] = resampled("zed", "fshape", 3)
C["net"] = "SELECT vol, tz AS nz, ty AS ny, tx AS nx FROM fshape"
C["netpad"] = "SELECT vol, greatest(nz, 8) AS nz, greatest(ny, 8) AS ny, greatest(nx, 8) AS nx FROM net"
C["fpadded"] = """SELECT s.vol, gz.z, gy.y, gx.x, coalesce(val, 0) AS val FROM (SELECT p.vol, p.nz AS pz, p.ny AS py, p.nx AS px, n.nz, n.ny, n.nx FROM netpad p JOIN net n ON p.vol = n.vol) s
  CROSS JOIN LATERAL (SELECT unnest(range(pz)) AS z) gz CROSS JOIN LATERAL (SELECT unnest(range(py)) AS y) gy CROSS JOIN LATERAL (SELECT unnest(range(px)) AS x) gx
  LEFT JOIN fine c ON c.vol = s.vol AND c.z + (pz - nz) // 2 = gz.z AND c.y + (py - ny) // 2 = gy.y AND c.x + (px - nx) // 2 = gx.x"""
C["fscores"] = scored(tiled("fpadded", "netpad"))
C["fblend"] = f"SELECT vol, z, y, x, c, sum({WEIGHT} * v) / sum({WEIGHT}) AS v FROM fscores GROUP BY vol, z, y, x, c"
C["funpad"] = "SELECT b.vol, z - (p.nz - n.nz) // 2 AS z, y - (p.ny - n.ny) // 2 AS y, x - (p.nx - n.nx) // 2 AS x, c, v FROM fblend b JOIN net n ON b.vol = n.vol JOIN netpad p ON b.vol = p.vol WHERE z - (p.nz - n.nz) // 2 BETWEEN 0 AND n.nz - 1 AND y - (p.ny - n.ny) // 2 BETWEEN 0 AND n.ny - 1 AND x - (p.nx - n.nx) // 2 BETWEEN 0 AND n.nx - 1"
C["fback"] = resampled("funpad", "fshape", 1, "v", "c", "t", "n")
C["flabel"] = "SELECT vol, z, y, x, arg_max(c, ROW(round(v, 6), -c)) AS label FROM fback GROUP BY vol, z, y, x"


def _names() -> str:
    from voxelith.operators.classes import LABELS_18

    rows = ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in LABELS_18)
    return f"(VALUES {rows}) AS t(label, token, name, src_label, red, green, blue, alpha)"


_NEED = "CASE WHEN vox_offset = 0 THEN 352 ELSE vox_offset END + n0 * n1 * n2 * bitpix / 8"
_QN = "sqrt(qb*qb + qc*qc + qd*qd)"
C["quat"] = f"""SELECT *, CASE WHEN p0 > 0 THEN p0 ELSE 1 END AS z0, CASE WHEN p1 > 0 THEN p1 ELSE 1 END AS z1, CASE WHEN p2 > 0 THEN p2 ELSE 1 END * CASE WHEN qfac < 0 THEN -1 ELSE 1 END AS z2,
  CASE WHEN rest < 1e-7 THEN 0 ELSE sqrt(greatest(rest, 0)) END AS a, CASE WHEN rest < 1e-7 THEN qb / {_QN} ELSE qb END AS b, CASE WHEN rest < 1e-7 THEN qc / {_QN} ELSE qc END AS c, CASE WHEN rest < 1e-7 THEN qd / {_QN} ELSE qd END AS d
FROM (SELECT *, 1 - (qb*qb + qc*qc + qd*qd) AS rest FROM rawhdr) r"""
_Q = {"00": "(a*a+b*b-c*c-d*d)*z0", "01": "2*(b*c-a*d)*z1", "02": "2*(b*d+a*c)*z2", "03": "o0", "10": "2*(b*c+a*d)*z0", "11": "(a*a+c*c-b*b-d*d)*z1", "12": "2*(c*d-a*b)*z2", "13": "o1", "20": "2*(b*d-a*c)*z0", "21": "2*(c*d+a*b)*z1", "22": "(a*a+d*d-b*b-c*c)*z2", "23": "o2"}
_RC = [(r, c) for r in range(3) for c in range(4)]
_NORM = ["sqrt(" + " + ".join(f"a{r}{c}*a{r}{c}" for r in range(3)) + ")" for c in range(3)]
_TYPES = "(VALUES (2,'uint8',8),(4,'int16',16),(8,'int32',32),(16,'float32',32),(64,'float64',64),(256,'int8',8),(512,'uint16',16),(768,'uint32',32)) AS t(datatype, type_name, bits)"
_LABELS_IN_BOX = "(SELECT vol, z, y, x, CAST(floor(val) AS INT) % 18 AS label FROM cropped)"
_FULL = "volmeta m CROSS JOIN LATERAL (SELECT unnest(range(nz)) AS z) gz CROSS JOIN LATERAL (SELECT unnest(range(ny)) AS y) gy CROSS JOIN LATERAL (SELECT unnest(range(nx)) AS x) gx JOIN bbox b ON m.vol = b.vol"
_INNER = f"{_LABELS_IN_BOX} l ON l.vol = m.vol AND l.z + zlo = gz.z AND l.y + ylo = gy.y AND l.x + xlo = gx.x"


def _tier(p: int, k: str) -> str:
    return f"(CAST(ceil((greatest(n{k}, {p}) - {p}) / ({p} * 0.5)) AS INT) + 1)"


def queries() -> dict[str, str]:
    q = {
        "header_validate": f"SELECT vol, CASE WHEN n_bytes < 348 THEN 'short_file' WHEN sizeof_hdr <> 348 THEN 'bad_header_size' WHEN magic NOT IN ('n+1', 'ni1') THEN 'bad_magic' WHEN ndim < 3 THEN 'not_3d' WHEN ndim > 3 AND dim4 > 1 THEN 'four_d' WHEN datatype = 128 THEN 'unsupported_type' WHEN n_bytes < {_NEED} THEN 'truncated' ELSE 'ok' END AS status FROM rawhdr",
        "default_affine": "SELECT vol, " + ", ".join((f"-(n{r} - 1) / 2.0::DOUBLE" if c == 3 else "1.0::DOUBLE" if r == c else "0.0::DOUBLE") + f" AS a{r}{c}" for r, c in _RC) + " FROM hdr",
        "detect_format": r"SELECT job_id, CASE WHEN lower(path) LIKE '%.jnii' THEN 'jnii' WHEN lower(path) LIKE '%.bnii' THEN 'bnii' ELSE 'nii' END AS format, regexp_matches(lower(path), '\.(nii(\.gz)?|jnii|bnii)$') AS is_image FROM jobs",
        "linear_index": "SELECT vol, (z * 10 + y) * 15 + x AS i, z AS z2, y AS y2, x AS x2 FROM vox",
        "major_order": "SELECT vol, (z * 10 + y) * 15 + x AS row_major, (x * 10 + y) * 10 + z AS col_major, val FROM vox",
        "affine_quaternion": "SELECT vol, " + ", ".join(f"round({_Q[f'{r}{c}']}, 7) AS a{r}{c}" for r, c in _RC) + " FROM quat",
        "affine_select": "SELECT vol, " + ", ".join(f"round(CASE WHEN sform_code > 0 THEN {float((r + 1) * (c + 2))}::DOUBLE * (1 + vol % 4) WHEN qform_code > 0 THEN {_Q[f'{r}{c}']} ELSE {f'p{r}' if r == c else '0'} END, 7) AS a{r}{c}" for r, c in _RC) + " FROM quat",
        "axes_to_canonical": "SELECT vol, d0, d1, d2, g0, g1, g2 FROM axes",
        "reorient_to_ras": "SELECT * FROM ras",
        "reorient_from_ras": "SELECT vol, i0, i1, i2, val FROM hvox",
        "affine_canonical": "SELECT vol, " + ", ".join("round(" + " + ".join(f"CASE WHEN d{i} = {c} THEN g{i} * a{r}{i} ELSE 0 END" for i in range(3)) + f", 7) AS c{r}{c}" for r in range(3) for c in range(3)) + ", " + ", ".join(f"round(a{r}3 + " + " + ".join(f"CASE WHEN g{i} < 0 THEN a{r}{i} * (n{i} - 1) ELSE 0 END" for i in range(3)) + f", 7) AS c{r}3" for r in range(3)) + " FROM axes",
        "zooms": "SELECT vol, " + ", ".join(f"round({_NORM[c]}, 7) AS z{c}" for c in range(3)) + " FROM hdr",
        "rescale": "SELECT vol, CASE WHEN scl_slope <> 0 AND (scl_slope <> 1 OR scl_inter <> 0) THEN (vol % 7 + 0.5::DOUBLE) * scl_slope + scl_inter ELSE vol % 7 + 0.5::DOUBLE END AS val FROM rawhdr",
        "dtype_lookup": f"SELECT vol, r.datatype, type_name, bits FROM rawhdr r LEFT JOIN {_TYPES} ON r.datatype = t.datatype",
        "out_header": "SELECT vol, n0, n1, n2, " + ", ".join(f"round({_NORM[c]}, 7) AS v{c}" for c in range(3)) + ", 'uint8' AS data_type, 8 AS bit_depth FROM hdr",
        "nonzero_bbox": "SELECT * FROM bbox",
        "crop_nonzero": "SELECT * FROM cropped",
        "crop_moments": "SELECT b.vol, zlo, zhi, ylo, yhi, xlo, xhi, round(m, 7) AS mean_, round(s, 7) AS sd_ FROM bbox b JOIN (SELECT vol, avg(val) AS m, stddev_pop(val) AS s FROM cropped GROUP BY vol) t ON b.vol = t.vol",
        "zscore": "SELECT vol, z, y, x, round(val, 7) AS val FROM zed",
        "target_shape": "SELECT vol, tz, ty, tx FROM mshape",
        "pad_to_patch": "SELECT * FROM padded",
        "unpad": "SELECT * FROM cropped",
        "uncrop_labels": f"SELECT m.vol, gz.z, gy.y, gx.x, coalesce(label, {AIR}) AS label FROM {_FULL} LEFT JOIN {_INNER}",
        "uncrop_tpm": f"SELECT m.vol, gz.z, gy.y, gx.x, c, CASE WHEN label IS NULL THEN CASE WHEN c = {AIR} THEN 1.0 ELSE 0.0 END WHEN c = label % 6 THEN 0.75 ELSE 0.05 END AS p FROM {_FULL} LEFT JOIN {_INNER}, range(6) k(c)",
        "upsample_place": "SELECT f.vol, " + ", ".join(f"f.{k} + CAST(round({k}lo * s{k} / 0.75) AS INT) AS {k}" for k in "zyx") + f", round(val + 3e-9, 7) AS val FROM ({resampled('cropped', 'fshape', 1)}) f JOIN bbox b ON f.vol = b.vol JOIN mshape m ON f.vol = m.vol WHERE " + " AND ".join(f"f.{k} + CAST(round({k}lo * s{k} / 0.75) AS INT) < t{k}" for k in "zyx"),
        "upsample_affine": "SELECT vol, " + ", ".join(f"round(a{r}{c} * 0.75 / {_NORM[c]}, 7) AS u{r}{c}" for r in range(3) for c in range(3)) + ", " + ", ".join(f"round(a{r}3 + " + " + ".join(f"a{r}{c} * 0.5 * (0.75 / {_NORM[c]} - 1)" for c in range(3)) + f", 7) AS u{r}3" for r in range(3)) + " FROM hdr",
        "resample_taps": f"SELECT vol, 1 AS ord, k, tap, i, round(w, 7) AS w FROM ({tap_rows('mshape', 'x', 1)}) a UNION ALL SELECT vol, 3, k, tap, i, round(w, 7) FROM ({tap_rows('mshape', 'x', 3)}) b",
        "tile_starts": f"SELECT vol, i, b AS start FROM ({start_rows('volmeta', 'x')}) q",
        "tile_starts_fixed": f"SELECT vol, i, b AS start FROM ({start_rows('volmeta', 'x', True)}) q",
        "tile_grid": f"SELECT z.vol, (z.i * cy.n + y.i) * cx.n + x.i AS tile_id, z.b AS z0, y.b AS y0, x.b AS x0 FROM ({start_rows('volmeta', 'z')}) z JOIN ({start_rows('volmeta', 'y')}) y ON z.vol = y.vol JOIN ({start_rows('volmeta', 'x')}) x ON z.vol = x.vol JOIN (SELECT vol, count(*) AS n FROM ({start_rows('volmeta', 'y')}) q GROUP BY vol) cy ON z.vol = cy.vol JOIN (SELECT vol, count(*) AS n FROM ({start_rows('volmeta', 'x')}) q GROUP BY vol) cx ON z.vol = cx.vol",
        "tile_workload": " UNION ALL ".join(f"SELECT vol, {i} AS tier, CAST({_tier(z, 'z')} * {_tier(y, 'y')} * {_tier(x, 'x')} AS BIGINT) AS tiles FROM volmeta" for i, (z, y, x) in enumerate([(8, 8, 8), (6, 6, 8), (4, 4, 6)])),
        "tile_tasks": """SELECT vol, kz, tiles, CAST(floor((first_ + kz * tiles) * 16 / total) AS INT) AS task
FROM (SELECT *, coalesce(sum(n * tiles) OVER (ORDER BY vol % 64, vol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_, sum(n * tiles) OVER () AS total
      FROM (SELECT vol, CAST(ceil((n0 * (vol % 7 + 2) - 8) / 4.0) AS INT) + 1 AS n,
                   CAST((ceil((n1 * (vol % 11 + 2) - 8) / 4.0) + 1) * (ceil((n2 * (vol % 5 + 2) - 8) / 4.0) + 1) AS BIGINT) AS tiles FROM hdr) q) r, range(32) k(kz) WHERE kz < n""",
        "extract_tiles": tiled("vox", "volmeta"),
        "gaussian_weights": f"SELECT vol, tile_id, lz, ly, lx, round({WEIGHT}, 9) AS w FROM ({tiled('vox', 'volmeta')}) t",
        "score_tiles_bricks": "SELECT vol, tile_id, fold, z, y, x, c, round(v, 6) AS v FROM scores",
        "score_tiles_linear": "SELECT vol, tile_id, fold, z, y, x, c, round(v, 6) AS v FROM scores",
        "channel_check": "SELECT n = 3 AS ok, count(*) AS n FROM (SELECT count(DISTINCT c) AS n FROM scores GROUP BY vol, tile_id, fold, z, y, x) q GROUP BY 1",
        "blend_gaussian": f"SELECT vol, z, y, x, true AS complete, c, round(sum({WEIGHT} * v) / (sum({WEIGHT}) FILTER (WHERE fold = 0) * count(DISTINCT fold)), 6) AS v FROM scores GROUP BY vol, z, y, x, c",
        "blend_uniform": "SELECT vol, z, y, x, c, round(avg(v), 6) AS v FROM scores_fixed GROUP BY vol, z, y, x, c",
        "expand_folds": "SELECT job_id, CAST(pos - 1 AS INT) AS pos, CASE WHEN regexp_matches(item, '^[0-9]$') THEN 'fold_' || item || '_fp16.onnx' ELSE item END AS model FROM (SELECT job_id, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS pos FROM (SELECT job_id, list_filter(string_split(CASE folds WHEN 'all' THEN '0,1,2,3,4' WHEN '' THEN '0' ELSE folds END, ','), lambda s: s <> '') AS items FROM jobs) j) k",
        "ensemble_mean": "SELECT vec_id, c, round(v, 7) AS v FROM mean",
        "argmax_label": "SELECT vec_id, CAST(arg_max(c, ROW(round(v, 7), -c)) AS INT) AS label FROM mean GROUP BY vec_id",
        "softmax": "SELECT vec_id, c, round(v, 9) AS v FROM soft",
        "softmax_temperature": "SELECT vec_id, c, round(exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY vec_id), 9) AS v FROM (SELECT vec_id, c, v / 2.5 AS v, max(v / 2.5) OVER (PARTITION BY vec_id) AS m FROM mean) q",
        "merge_classes_tpm": "SELECT vec_id, c, round(v, 9) AS v FROM merged",
        "merge_classes_label": "SELECT vec_id, arg_max(c, ROW(v, -c)) AS label FROM merged GROUP BY vec_id",
        "remap_labels": f"SELECT vol, z, y, x, bin AS label FROM lab JOIN {_BINS} ON ref = c",
        "merge_vs_remap": f"SELECT merged, bin AS remapped, count(*) AS n FROM (SELECT vec_id, arg_max(c, ROW(v, -c)) AS merged FROM merged GROUP BY vec_id) m JOIN (SELECT vec_id, arg_max(c, ROW(v, -c)) AS label FROM mean GROUP BY vec_id) l ON m.vec_id = l.vec_id JOIN {_BINS} ON l.label = bins.c GROUP BY merged, bin",
        "label_names": f"SELECT vol, l.label, n, token, name, src_label, CAST(red AS DOUBLE) AS red, CAST(green AS DOUBLE) AS green, CAST(blue AS DOUBLE) AS blue, CAST(alpha AS DOUBLE) AS alpha FROM (SELECT vol, ref AS label, count(*) AS n FROM lab GROUP BY vol, ref) l LEFT JOIN {_names()} ON l.label = t.label",
        "nonfinite_guard": "SELECT fold, CAST(count(*) FILTER (WHERE vec_id % 11 = 0 OR vec_id % 13 = 0) AS BIGINT) AS bad_rows, bool_or(vec_id % 11 = 0 OR vec_id % 13 = 0) AS quarantine FROM embeddings, range(3) f(fold) GROUP BY fold",
        "tpm_sum_check": "SELECT count(*) AS n, max(round(abs(p - 1), 9)) AS worst, max(round(abs(m - 1), 9)) AS worst_merged, CAST(count(*) FILTER (WHERE a = b) AS BIGINT) AS same_label FROM (SELECT vec_id, sum(v) AS p, arg_max(c, ROW(v, -c)) AS a FROM soft GROUP BY vec_id) s JOIN (SELECT vec_id, sum(v) AS m FROM merged GROUP BY vec_id) t ON s.vec_id = t.vec_id JOIN (SELECT vec_id, arg_max(c, ROW(v, -c)) AS b FROM mean GROUP BY vec_id) u ON s.vec_id = u.vec_id",
        "confusion": "SELECT * FROM counts",
        "confusion_maps": """SELECT coalesce(a.vol, b.vol) AS vol, a.label AS ref, b.label AS pred, count(*) AS n
FROM (SELECT vol, z, y, x, CAST(floor(ref / 6) AS INT) AS label FROM lab WHERE NOT (vol % 4 = 3 AND z = 2) AND NOT (y = 4 AND x > 9)) a
FULL JOIN (SELECT vol, z, y, x, CAST(floor(pred / 6) AS INT) AS label FROM lab WHERE vol % 5 <> 4 AND NOT (vol % 3 = 1 AND x = 14)) b
  ON a.vol = b.vol AND a.z = b.z AND a.y = b.y AND a.x = b.x GROUP BY 1, 2, 3""",
        "dice_per_class": "SELECT vol, label, n_ref, n_pred, n_both, round(dice, 9) AS dice FROM dices",
        "voxel_agreement": "SELECT vol, count(*) FILTER (WHERE ref = pred) AS matches, count(*) AS voxels, round(avg(CASE WHEN ref = pred THEN 1.0 ELSE 0.0 END), 9) AS agreement FROM lab GROUP BY vol",
        "dice_verdict": "SELECT vol, round(min(dice), 9) AS worst, CASE WHEN min(dice) >= 0.87 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM dices GROUP BY vol",
        "mean_fg_dice": "SELECT vol, round(avg(dice), 9) AS mean_dice FROM dices WHERE label <> 0 GROUP BY vol",
        "shape_check": "SELECT vol, NOT (vol % 4 = 3 OR vol % 3 = 1) AS same FROM volmeta WHERE true",
        "logit_parity": "SELECT p.kase AS case, round(max_diff, 9) AS max_diff, round(mean_diff, 9) AS mean_diff, round(median_diff, 9) AS median_diff, round(agreement, 9) AS agreement FROM parity p JOIN agree a ON p.kase = a.kase",
        "parity_verdict": "SELECT p.kase AS case, g AS gate, CASE WHEN agreement >= 0.999 AND max_diff < t THEN 'PASS' WHEN agreement >= 0.99 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM parity p JOIN agree a ON p.kase = a.kase, (VALUES ('cpu', 1e-3), ('gpu', 1e-2)) AS v(g, t)",
        "class_counts": "SELECT vol, ref AS label, count(*) AS n FROM lab GROUP BY vol, ref",
        "type_histogram": "SELECT op_type, count(*) AS n, CASE WHEN regexp_matches(op_type, '(?i)(conv(olution)?3d$|convtranspose3d$|convolution3ddepthwise)') THEN 'FATAL' WHEN regexp_matches(op_type, '^[A-Za-z]+3D$') THEN 'PARTIAL' ELSE 'PASS' END AS gate FROM types GROUP BY op_type",
        "runtime_ratio": "SELECT round(o / b, 9) AS base_ratio, o / b > 1.5 AS side_fail, round(o / f, 9) AS speedup, CASE WHEN o / f >= 5 THEN 'STRONG' WHEN o / f >= 2 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM (SELECT avg(wall) FILTER (WHERE op_type = 'click') AS b, avg(wall) FILTER (WHERE op_type = 'view') AS o, avg(wall) FILTER (WHERE op_type = 'purchase') AS f FROM types) q",
        "ingest_nifti": "SELECT vol, z, y, x, CAST(ref AS DOUBLE) AS val FROM lab",
        "table_roundtrip": "SELECT vol, z, y, x, val FROM vox",
        "table_one_volume": "SELECT vol, z, y, x, val FROM vox WHERE vol = 3",
        "export_roundtrip": "SELECT vol, z, y, x, CAST(ref AS DOUBLE) AS val, 'ok' AS status, 1.0::DOUBLE AS p0, 1.0::DOUBLE AS p1, 1.0::DOUBLE AS p2 FROM lab",
        "export_tpm": "SELECT vol, c, z, y, x, CASE WHEN c = ref % 3 THEN 0.75::DOUBLE ELSE 0.125::DOUBLE END AS val FROM lab, range(3) k(c)",
        "ingest_jnii": "SELECT vol, 0 AS c, z, y, x, CAST(ref AS DOUBLE) AS val FROM lab",
        "export_jnii": "SELECT vol, c, z, y, x, CASE WHEN c = ref % 3 THEN 0.75::DOUBLE ELSE 0.125::DOUBLE END AS val FROM lab, range(3) k(c)",
        "ingest_quarantine": """SELECT vol, 'nii.gz' AS form, CASE vol % 7 WHEN 3 THEN 'bad_offset' WHEN 4 THEN 'bad_magic' ELSE 'ok' END AS header_status,
       CASE vol % 7 WHEN 1 THEN 'gzip_truncated' WHEN 2 THEN 'trailing_bytes' WHEN 3 THEN 'bad_offset' WHEN 4 THEN 'bad_magic' WHEN 5 THEN 'gzip_damaged' WHEN 6 THEN 'gzip_truncated' ELSE 'ok' END AS status,
       CASE WHEN vol % 7 IN (0, 2) THEN nz ELSE 0 END AS n_planes FROM volmeta
UNION ALL
SELECT vol, 'jnii', CASE vol % 8 WHEN 1 THEN 'bad_json' WHEN 2 THEN 'not_an_object' WHEN 6 THEN 'unsupported_packing' WHEN 7 THEN 'bad_affine' ELSE 'ok' END,
       CASE vol % 8 WHEN 1 THEN 'bad_json' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'bad_zlib' WHEN 4 THEN 'size_mismatch' WHEN 5 THEN 'bad_base64' WHEN 6 THEN 'unsupported_packing' WHEN 7 THEN 'bad_affine' ELSE 'ok' END,
       CASE WHEN vol % 8 = 0 THEN nx ELSE 0 END FROM volmeta""",
        "flagship_pipeline": "SELECT m.vol, coalesce(label, 0) AS label, count(*) AS n FROM volmeta m CROSS JOIN LATERAL (SELECT unnest(range(nz)) AS z) gz CROSS JOIN LATERAL (SELECT unnest(range(ny)) AS y) gy CROSS JOIN LATERAL (SELECT unnest(range(nx)) AS x) gx JOIN bbox b ON m.vol = b.vol LEFT JOIN flabel l ON l.vol = m.vol AND l.z + zlo = gz.z AND l.y + ylo = gy.y AND l.x + xlo = gx.x GROUP BY 1, 2",
    }
    q["compare_files"] = """SELECT m.vol, CASE m.vol % 9 WHEN 1 THEN 'missing_ref' WHEN 2 THEN 'missing_new' WHEN 3 THEN 'ref_gzip_truncated' WHEN 4 THEN 'other_shape'
         WHEN 5 THEN 'PASS' ELSE CASE WHEN w.worst >= 0.87 THEN 'PASS' ELSE 'FAIL' END END AS verdict,
       CASE WHEN m.vol % 9 NOT IN (1, 2, 3, 4) THEN CAST(t.voxels AS BIGINT) END AS voxels,
       CASE WHEN m.vol % 9 = 5 THEN CAST(t.voxels AS BIGINT) WHEN m.vol % 9 NOT IN (1, 2, 3, 4) THEN CAST(t.matches AS BIGINT) END AS matches,
       CASE WHEN m.vol % 9 = 5 THEN 1.0::DOUBLE WHEN m.vol % 9 NOT IN (1, 2, 3, 4) THEN round(CAST(t.matches AS DOUBLE) / t.voxels, 9) END AS agreement,
       CASE WHEN m.vol % 9 = 5 THEN 1.0::DOUBLE WHEN m.vol % 9 NOT IN (1, 2, 3, 4) THEN round(w.worst, 9) END AS worst
FROM volmeta m JOIN (SELECT vol, min(dice) AS worst FROM dices GROUP BY vol) w ON m.vol = w.vol
JOIN (SELECT vol, count(*) AS voxels, count(*) FILTER (WHERE ref = pred) AS matches FROM lab GROUP BY vol) t ON m.vol = t.vol"""
    q["segment_files"] = f"SELECT m.vol, 'ok' AS status, gz.z, gy.y, gx.x, coalesce(CAST(label AS INT), 0) AS label FROM {_FULL} LEFT JOIN flabel l ON l.vol = m.vol AND l.z + zlo = gz.z AND l.y + ylo = gy.y AND l.x + xlo = gx.x"
    q["uncrop_lines"], q["blend_slabs"] = q["uncrop_labels"], q["blend_gaussian"]
    small = "(SELECT vol, nz, ny, nx, 7 AS tz, 12 AS ty, 11 AS tx FROM volmeta)"
    for name, order in (("resample_linear", 1), ("resample_cubic", 3)):
        q[name] = f"SELECT vol, z, y, x, round(val + 3e-9, 7) AS val FROM ({resampled('vox', small, order)}) r"
    lv = "(SELECT vol, z, y, x, c, CASE c WHEN 0 THEN val WHEN 1 THEN 2 * val + x ELSE y END AS v FROM vox, range(3) k(c))"
    q["resample_logits"] = f"SELECT vol, z, y, x, c, round(v + 3e-9, 7) AS v FROM ({resampled(lv, small, 1, 'v', 'c')}) r"
    return q


def _with(text: str) -> str:
    """`text` with the named parts that it uses, each after those that it uses itself."""
    order: list[str] = []

    def need(t: str) -> None:
        for name in C:
            if name not in order and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b|\({name}\b", t):
                need(C[name])
                if name not in order:
                    order.append(name)

    need(text)
    return ("WITH " + ", ".join(f"{n} AS ({C[n]})" for n in order) + " " if order else "") + text


def query_texts() -> dict[str, str]:
    return {k: _with(v) for k, v in queries().items()}
