"""Fill-in-middle, vector codes and nearest neighbours against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from pyspark.sql import functions as F

from voxelith.llm import fillmiddle, nearest, veccodes

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def same_as_sql(spark, sf_dir, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    q = c.execute(__spark_entry__.oracle_sql()[name])
    own = [x[0] for x in q.description]
    assert sorted(own) == columns
    assert got == Counter(tuple(dict(zip(own, r, strict=True))[c] for c in columns) for r in q.fetchall())


# ---- fill in the middle ----


def cut_plainly(doc_id, text, rule):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in (rule.prefix, rule.suffix, rule.middle)) or h[2] % 100 >= rule.rate:
        return doc_id, n, "plain", None, None, t
    if h[3] % 100 < rule.spm:
        return doc_id, n, "spm", len(p), len(m), rule.suffix + s + rule.prefix + p + rule.middle + m
    return doc_id, n, "psm", len(p), len(m), rule.prefix + p + rule.suffix + s + rule.middle + m


TEXTS = [None, "", "\n", "\n\n\n", "one line", "one line\n", "a\nb\nc\nd", "é\n\U0001f600x\n\n y\r\n\x0b", "holds <P> inside", "<M>", "ends with <S", ">starts\nS>\nP>", "long\n" * 40_000, "x" * 3_000_000, "a\nb\nc\nd"]


@pytest.mark.parametrize("rule", [fillmiddle.Rule(), fillmiddle.Rule(seed=11, rate=50, spm=20, prefix="[[pre]]", suffix="[[suf]]", middle="[[mid]]")])
def test_fill_in_middle_equals_the_plain_rule_and_is_undone(spark, rule):
    rows = [(i, t, "<P>", None, 1) for i in range(4) for t in TEXTS] + [(100 * k + i, t, None, None, None) for k in range(1, 20) for i, t in enumerate(TEXTS[:12])]
    rows += [(None, "a\nb\nc", None, None, None)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as n", "'y' as form", "'z' as output", "5 as h1")
    out = fillmiddle.transform(docs, rule)
    got = Counter(tuple(r) for r in out.collect())
    assert got == Counter(cut_plainly(i, t, rule) for i, t, *_ in rows)
    back = out.select("doc_id", fillmiddle.restored(out["output"], out["form"], rule).alias("t")).collect()
    assert Counter((r[0], r[1]) for r in back) == Counter((i, t or "") for i, t, *_ in rows)
    if rule.seed == 7:
        assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing_and_bad_sentinels(spark, sf_dir):
    assert fillmiddle.transform(spark.createDataFrame([], DOC)).collect() == []
    with pytest.raises(ValueError):
        fillmiddle.Rule(prefix="<>", suffix="><", middle="m")
    with pytest.raises(ValueError):
        fillmiddle.Rule(middle="<P>")
    same_as_sql(spark, sf_dir, "op13_fill_in_middle")


def test_fill_in_middle_works_on_pieces_of_a_sliced_batch():
    texts = pa.array(["skip", "a\nb", "", "c\n"], pa.large_string()).slice(1)
    made = fillmiddle.arrange(texts, [np.array([1, 0, 0]), np.array([2, 0, 1]), np.array([0, 0, 0]), np.array([99, 0, 99])], fillmiddle.Rule())
    assert made["output"].to_pylist() == ["<P>a\n<S><M>b", "", "<P><S><M>c\n"]


# ---- vector codes ----

VEC = "vec_id long, embedding array<float>, label int"


def codes_plainly(rows, shape):
    """Rows of (vec_id, vector, label) -> {(vec_id, label, code, error): times}, codebooks; every part is compared with every entry."""
    ok = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(np.float32(v)) for v in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, [np.float32(v) for v in r[1]]))
    x = np.floor(np.array([np.float32(r[1]) for r in ok], float) * shape.scale).astype(np.int64).reshape(len(ok), shape.parts, -1)
    books = x[: shape.entries].transpose(1, 0, 2).copy()
    near = lambda: np.stack([((x[:, p, None] - books[p]) ** 2).sum(2).argmin(1) for p in range(shape.parts)], 1)
    for _ in range(shape.rounds):
        own = near()
        for p in range(shape.parts):
            for e in range(books.shape[1]):
                mine = x[own[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    own = near()
    error = sum(((x[:, p] - books[p][own[:, p]]) ** 2).sum(1) for p in range(shape.parts))
    return Counter((r[0], r[2], "".join(f"{c:02x}" for c in o), int(e)) for r, o, e in zip(ok, own.tolist(), error, strict=True)), books


def groups_of_vectors(rng, n, size, spread=0.05):
    centres = rng.normal(size=(12, size))
    return (centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, size))).astype(np.float32)


def test_metric_trees_own_whole_balls_and_change_nothing():
    rng = np.random.default_rng(3)
    for x in (np.floor(groups_of_vectors(rng, 3000, 8) * 4096).astype(float), rng.integers(-5, 6, (2000, 3)).astype(float), np.zeros((500, 4)), np.arange(7.0)[:, None], np.repeat(rng.integers(0, 9, (4, 5)), 400, 0).astype(float)):
        tree = veccodes.grow(x)
        assert sorted(tree.order.tolist()) == list(range(len(x)))
        inner = tree.left >= 0
        assert (tree.lo[tree.left[inner]] == tree.lo[inner]).all() and (tree.hi[tree.left[inner]] == tree.lo[tree.right[inner]]).all() and (tree.hi[tree.right[inner]] == tree.hi[inner]).all()
        whole = x[tree.order].astype(np.int64)
        entries = np.concatenate([whole[:: max(1, len(x) // 12)][:12], whole[:1], whole[:2] + 1])
        want = ((whole[:, None] - entries) ** 2).sum(2).argmin(1)
        assert (veccodes.assigned(tree, whole, entries) == want).all()
        total, count = veccodes.gathered(tree, whole, entries)
        assert (count == np.bincount(want, minlength=len(entries))).all()
        assert (total == np.stack([whole[want == e].sum(0) for e in range(len(entries))])).all()
    clear = veccodes.grow(np.floor(groups_of_vectors(rng, 4096, 8, 0.01) * 4096))
    points = np.floor(groups_of_vectors(rng, 4096, 8, 0.01) * 4096)
    clear = veccodes.grow(points)
    centres = np.unique(np.round(points / 400), axis=0)[:1] * 400
    (balls, _), (single, _) = veccodes.owners(clear, points[clear.order].astype(np.int64), np.stack([centres[0] + 40_000 * k for k in range(3)]).astype(np.int64))
    assert (clear.hi - clear.lo)[balls].sum() > 0.9 * len(points) and len(balls) < 200  # most points are never looked at


@pytest.mark.parametrize("block", [7, 4096])
def test_vector_codes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(veccodes, "BLOCK", block)
    rng = np.random.default_rng(block)
    v = groups_of_vectors(rng, 400, 16).tolist()
    rows = [(i * 3 - 50, x, None if i % 5 == 0 else i % 4) for i, x in enumerate(v)]
    rows += [(7, v[3], 1)] * 150 + [(None, v[4], None), (None, v[5], 2)] + [(-1000 + i % 2, v[0], 1) for i in range(6)]
    bad = [[float("nan")] * 16, [float("inf")] + v[0][1:], [None] + v[0][1:], None]
    rows += [(-5000 - i, b, 1) for i, b in enumerate(bad)]
    for shape in (veccodes.Shape(), veccodes.Shape(parts=4, entries=5, rounds=2, scale=100), veccodes.Shape(entries=256)):
        if shape.entries == 256 and block == 7:
            continue
        df = spark.createDataFrame(rows, VEC).selectExpr("*", "'a' as code", "1 as error", "2 as v")
        coded, books = veccodes.compress(df.repartition(5), shape)
        want, expected = codes_plainly(rows, shape)
        assert (books == expected).all()
        assert Counter(tuple(r) for r in coded.select("vec_id", "label", "code", "error").collect()) == want
    errors = {}
    for (_, label, _, e), times in want.items():
        errors[label] = errors.get(label, 0) + e * times
    for most in (100_000, 1):
        assert {(r["label"], r["label_error"]) for r in veccodes.with_label_errors(coded, most).collect()} == set(errors.items())


def test_vector_codes_of_little_and_too_much(spark, sf_dir):
    none, books = veccodes.compress(spark.createDataFrame([(1, None, 1), (2, [], 1)], VEC))
    assert none.collect() == [] and veccodes.with_label_errors(none).collect() == [] and veccodes.digest(books) == hashlib.sha256(b"").hexdigest()
    one, books = veccodes.compress(spark.createDataFrame([(1, [0.5] * 8, 1), (2, [1.0] * 16, 1)], VEC))
    assert [tuple(r) for r in one.collect()] == [(1, 1, "00" * 8, 0)] and books.shape == (8, 1, 1)
    with pytest.raises(ValueError):
        veccodes.compress(spark.createDataFrame([(1, [0.5] * 7, 1)], VEC))
    with pytest.raises(ValueError):
        veccodes.whole(np.array([1e12]), 4096, veccodes.largest(64))
    same_as_sql(spark, sf_dir, "op12_vector_codes")


# ---- nearest neighbours ----


def neighbours_plainly(x, q_at, ids, k):
    """For each query the (score, id) of its k nearest other rows, ties to smaller ids."""
    out = []
    for a in q_at:
        score = (x * x[a]).sum(1)
        order = sorted((b for b in range(len(x)) if b != a), key=lambda b: (-score[b], ids[b] is None, ids[b] or 0))[:k]
        out.append([(score[b], ids[b]) for b in order])
    return out


def recall_of(rows, x, ids, queries, k):
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append(r)
    hit = n = 0
    for a, want in zip(queries, neighbours_plainly(x, queries, ids, k), strict=True):
        mine = sorted(got[ids[a]], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(want) + 1))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        place = {i: p for p, i in enumerate(ids)}
        for r in mine:
            assert r["vec_id"] != ids[a] and abs(r["score"] - (x[place[r["vec_id"]]] * x[a]).sum()) < 1e-12
        hit += len({i for _, i in want} & {r["vec_id"] for r in mine})
        n += len(want)
    return hit / n


def test_scan_finds_the_best_and_abandons_the_rest_early(monkeypatch):
    monkeypatch.setattr(nearest, "STEP", 300)
    rng = np.random.default_rng(1)
    s = nearest.Search()
    for size in (5, 16, 64, 200):
        x = groups_of_vectors(rng, 4000, size, 0.3).astype(float) * rng.lognormal(0, 0.2, (4000, 1))
        q, work, row = x[:40], {}, np.arange(4000)
        i, j, score = nearest.scan(q, row[:40], np.full(40, -np.inf), x, row, row, s, work)
        want = neighbours_plainly(x, range(40), row.tolist(), s.k)
        hit = sum(len({b for _, b in w} & set(j[i == a].tolist())) for a, w in enumerate(want))
        assert hit >= 0.97 * 40 * s.k
        assert np.allclose(score, (q[i] * x[j]).sum(1), rtol=1e-13) and (np.bincount(i) == s.k).all()
        if size == 200:
            assert work["columns"] < 0.45 * work["pairs"] * size
        bar = np.array([w[-1][0] for w in want])
        i, j, _ = nearest.scan(q, row[:40], bar, x, row, row, s)
        assert len(j) <= 40 * s.k and sum(len({b for _, b in w} & set(j[i == a].tolist())) for a, w in enumerate(want)) >= 0.97 * 40 * s.k


def test_share_of_a_distance_in_the_first_columns():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200_000, 24)) ** 2
    for d, share in nearest.ends(24, 8, 0.01)[:-1]:
        assert abs((v[:, :d].sum(1) / v.sum(1) > share).mean() - 0.01) < 0.002
    assert nearest.ends(24, 8, 0.01)[-1] == (24, 1.0) and nearest.ends(3, 16, 0.01) == [(3, 1.0)]
    turn = nearest.rotation(24, 1)
    assert np.allclose(turn @ turn.T, np.eye(24))


@pytest.mark.parametrize("block", [60, 8192])
def test_neighbours_of_clustered_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = groups_of_vectors(rng, 1500, 24, 0.4)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[:400] = x[0]  # a hot vector: ties go to smaller ids
    ids = list(range(0, 3000, 2))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)], VEC).selectExpr("*", "1 as row", "'s' as list", "0.5 as score", "3 as rank", "4 as v")
    rows = nearest.neighbours(df.repartition(4), F.col("vec_id") % 20 == 0).collect()
    queries = [a for a, i in enumerate(ids) if i % 20 == 0]
    assert recall_of(rows, x.astype(float), ids, queries, 20) >= 0.9
    hot = sorted(i for i, v in zip(ids, x, strict=True) if (v == x[0]).all())
    one = next(i for i in hot if i % 20 == 0)
    assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == one] == [i for i in hot if i != one][:20]


def test_neighbours_of_odd_and_few_rows(spark):
    none = spark.createDataFrame([(20, None, 1), (40, [0.0, 0.0], 1), (60, [float("nan"), 1.0], 1), (80, [None, 1.0], 1), (100, [], 1)], VEC)
    query = F.col("vec_id") % 20 == 0
    assert nearest.neighbours(none, query).collect() == [] and nearest.neighbours(none.limit(0), query).collect() == []
    few = none.union(spark.createDataFrame([(20, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1)], VEC))
    got = sorted((tuple(r) for r in nearest.neighbours(few, query).collect()), key=lambda r: r[1])
    one = [(20, 1, 3, 2.0), (20, 2, 7, 1.0), (20, 3, 20, 1.0), (20, 4, None, 1.0)]
    assert got == sorted(one + one, key=lambda r: r[1])
    alone = nearest.neighbours(spark.createDataFrame([(20, [1.0, 0.0], 1)], VEC), query)
    assert alone.collect() == []


def test_recall_on_the_given_vectors(spark, sf_dir):
    rows = __spark_entry__.queries()["op11_nearest_neighbours"](spark, sf_dir).collect()
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in t], float), [r["vec_id"] for r in t]
    queries = [a for a, i in enumerate(ids) if i % 20 == 0]
    assert len(rows) == 20 * len(queries)
    assert recall_of(rows, x, ids, queries, 20) >= 0.9
