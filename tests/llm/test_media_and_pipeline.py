"""Image copies, and the pipeline stage by stage."""

from collections import Counter

import numpy as np
import pytest

from voxelith.llm import media, registry
from voxelith.llm.common import stored


def test_edited_copies_share_a_class_and_others_do_not(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(40)] + [(40, None), (41, [1.0]), (42, [0.0] * 64)]
    vectors.append((43, vectors[3][1]))  # equal pixels
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {r["image_id"]: r["class_id"] for r in media.copy_classes(media.rendered(df)).collect()}
    assert len(got) == 44 + 8 + 1 - 1
    for i in range(40):
        assert got[2 * i] == 2 * i
        if i % 5 == 0:
            assert got[2 * i + 1] == 2 * i
    assert got[86] == 6


def texture(rng, side, n=8):
    basis = np.cos(np.pi * (np.arange(side)[:, None] + 0.5) * np.arange(n) / side)
    a = basis @ rng.normal(size=(n, n)) @ basis.T
    return (a - a.min()) / (a.max() - a.min()) * 200 + 20


def image_table(spark, images):
    rows = [(i, a.shape[1], a.shape[0], np.clip(np.rint(a), 0, 255).astype(np.uint8).tobytes()) for i, a in images]
    return spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")


def recompressed(a, step):
    """8 x 8 cosine blocks, coefficients rounded to multiples of `step`."""
    basis = np.cos(np.pi * (np.arange(8)[:, None] + 0.5) * np.arange(8) / 8) * np.where(np.arange(8) == 0, 8**-0.5, 0.5)
    out = np.empty_like(a)
    for y in range(0, a.shape[0], 8):
        for x in range(0, a.shape[1], 8):
            c = basis.T @ a[y : y + 8, x : x + 8] @ basis
            out[y : y + 8, x : x + 8] = basis @ (np.rint(c / step) * step) @ basis.T
    return out


def test_tables_find_near_descriptors():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 64, (2000, 4), dtype=np.uint64)
    bits = np.unpackbits(a.view(np.uint8), axis=1, bitorder="little")
    for row in bits:
        row[rng.choice(256, media.NEAR_BITS, replace=False)] ^= 1
    b = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    for n in (10, 10**6, 10**12):
        drawn = media.tables(n)
        assert (media.keys_of(a, drawn) == media.keys_of(b, drawn)).any(1).mean() > media.TARGET - 0.03
    assert (media.keys_of(a, drawn) == media.keys_of(np.roll(a, 1, 0), drawn)).any(1).mean() < 0.001


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(6)
    images = []
    for i in range(60):
        a = texture(rng, 64)
        y, x = rng.integers(0, 12, 2)
        edits = [a[y : y + 52, x : x + 52], a * 1.1 + 5, a[y : y + 52, x : x + 52] * 0.8, np.rot90(a), media._resized(a, 0.8), a + rng.normal(0, 2, a.shape), recompressed(a, 12)]
        images += [(10 * i, a)] + [(10 * i + 1 + k, e) for k, e in enumerate(edits)]
    df = image_table(spark, images)
    got = {r["image_id"]: r["class_id"] for r in media.copy_classes(df).collect()}
    found = [media.describe(np.clip(np.rint(a), 0, 255).astype(np.uint8)) for _, a in images]
    pairs = [(m, n) for m in range(len(images)) for n in range(m) if images[m][0] // 10 == images[n][0] // 10]
    linked = [(m, n) for m, n in pairs if media.same_picture(found[n][0], found[m][0], found[n][1], found[m][1])]
    hit = sum(got[images[m][0]] == got[images[n][0]] for m, n in linked)
    copies = sum(got[i] == i // 10 * 10 for i, _ in images if i % 10)
    assert hit >= 0.9 * len(linked) and copies >= 0.9 * 420, (hit, len(linked), copies)
    joined = {i // 10 for i, _ in images if got[i] // 10 != i // 10}
    assert len(joined) <= 1, joined  # of 113,000 pairs of different pictures, three look alike at four places


def plainly_the_same(p, q, u, v):
    """The rule of a link for two images, one cell after another."""
    apart = np.bitwise_count(u[:, None, :] ^ v[None, :, :]).sum(2, dtype=np.int64)
    i, j = np.nonzero(apart <= media.MAX_BITS)
    if len(i) < media.CONSENSUS:
        return False
    a, b = p[i], q[j]
    scale, turn = b[:, 2] / a[:, 2], np.radians(b[:, 3] - a[:, 3])
    dy = (b[:, 0] - scale * (a[:, 0] * np.cos(turn) + a[:, 1] * np.sin(turn))) / media.SHIFT
    dx = (b[:, 1] - scale * (a[:, 1] * np.cos(turn) - a[:, 0] * np.sin(turn))) / media.SHIFT
    i, j = (np.floor(x[:, 0] / media.PLACE).astype(int) * 65536 + np.floor(x[:, 1] / media.PLACE).astype(int) for x in (a, b))
    kind = np.rint(2 * np.log2(scale)) * 64 + np.rint(np.degrees(turn) % 360 / media.TURN) % (360 // media.TURN)
    for sy in (0, 0.5):
        for sx in (0, 0.5):
            which = np.unique(np.column_stack([kind, np.floor(dy + sy), np.floor(dx + sx)]), axis=0, return_inverse=True)[1].ravel()
            for c in range(which.max() + 1):
                if min(len(np.unique(i[which == c])), len(np.unique(j[which == c]))) >= media.CONSENSUS:
                    return True
    return False


@pytest.mark.parametrize("held", [1, 1000, 1 << 20])
def test_blocks_have_the_pairs_that_meet_and_connect_what_all_pairs_connect(monkeypatch, held):
    """Against dictionaries of keys and the plain rule, whatever is held at a time."""
    rng = np.random.default_rng(9)
    images = []
    for _ in range(12):
        a = texture(rng, 64)
        images += [a, a * 1.1 + 5, a[3:60, 5:64], a + rng.normal(0, 2, a.shape)]
    images.append(np.full((64, 64), 7.0))  # no corners
    found = [media.describe(np.clip(np.rint(a), 0, 255).astype(np.uint8)) for a in images]
    drawn = media.tables(sum(len(w) for _, w in found))
    buckets = {}
    for m, (_, words) in enumerate(found):
        for i, row in enumerate(media.keys_of(words, drawn) if len(words) else []):
            for k in row:
                buckets.setdefault(k, set()).add((m, i))
    meetings = {}
    for members in buckets.values():
        for m, i in members:
            for n, j in members:
                if m < n:
                    meetings.setdefault((m, n), set()).add((i, j))
    expected = {k for k, v in meetings.items() if min(len({i for i, _ in v}), len({j for _, j in v})) >= media.MEETINGS}
    linked = {(m, n) for m, n in expected if plainly_the_same(found[m][0], found[n][0], found[m][1], found[n][1])}
    assert len(linked) > 40 and len(expected) > 1.2 * len(linked)

    for name in ("MEETINGS_HELD", "DESCRIPTORS_HELD", "MATCHES_HELD"):
        monkeypatch.setattr(media, name, held)
    cut = 20

    def block(lo, hi):
        part = found[lo:hi]
        return media.Block(np.arange(lo, hi), np.array([len(w) for _, w in part]), np.concatenate([p for p, _ in part]), np.concatenate([w for _, w in part]), drawn)

    parts = [(0, block(0, cut)), (cut, block(cut, len(images)))]
    got, links = [], []
    for k, (at, x) in enumerate(parts):
        for to, y in parts[k:]:
            got += [(a + at, b + to) for a, b in media.met(x, y)]
            links += [(a, b) for pair in media.copies(x, y) for a, b in zip(*pair, strict=True)]
    assert len(got) == len(set(got)) and set(got) == expected
    assert set(links) <= linked and classes(links, len(images)) == classes(linked, len(images))


def classes(links, n):
    own = list(range(n))
    for a, b in links:
        own = [own[a] if c == own[b] else c for c in own]
    return {frozenset(i for i in range(n) if own[i] == c) for c in own}


def test_a_group_of_copies_gives_no_link_for_every_two():
    rng = np.random.default_rng(12)
    a = texture(rng, 64)
    found = [media.describe(np.clip(np.rint(a + rng.normal(0, 1, a.shape)), 0, 255).astype(np.uint8)) for _ in range(60)]
    drawn = media.tables(3000)

    def block(lo, hi):
        part = found[lo:hi]
        return media.Block(np.arange(lo, hi), np.array([len(w) for _, w in part]), np.concatenate([p for p, _ in part]), np.concatenate([w for _, w in part]), drawn)

    x, y = block(0, 30), block(30, 60)
    links = [[pair for c in media.copies(*k) for pair in zip(*c, strict=True)] for k in ((x, x), (x, y), (y, y))]
    assert classes(sum(links, []), 60) == {frozenset(range(60))}
    assert len(media.met(x, y)) > 800 and max(map(len, links)) <= 59


def test_classes_do_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(10)
    images = []
    for i in range(15):
        a = texture(rng, 64)
        images += [(10 * i, a), (10 * i + 1, a * 1.1 + 5), (10 * i + 2, a[2:58, 4:60]), (10 * i + 3, a)]
    df = image_table(spark, images)
    one = sorted(tuple(r) for r in media.copy_classes(df).collect())
    assert one == [(i, i // 10 * 10) for i, _ in images]
    for corners, most in ((1, 2048), (200, 2048), (80_000, 3)):
        monkeypatch.setattr(media, "BLOCK_CORNERS", corners)
        monkeypatch.setattr(media, "BLOCK_IMAGES", most)
        packed = media.blocks(media.corners(df).filter("n > 0").dropDuplicates(["node"])).collect()
        assert len({r["block"] for r in packed}) == len(packed) >= 8 and sum(len(r["nodes"]) for r in packed) == 45
        assert all(r["corners"] == sum(r["n"]) and (r["corners"] <= corners or len(r["n"]) == 1) and len(r["n"]) <= most for r in packed)
    assert sorted(tuple(r) for r in media.copy_classes(df).collect()) == one


def test_pairs_of_images_that_look_alike_are_no_rows(spark, sf_dir):
    """194,000 meetings and 34,000 pairs to compare: none is shuffled, nor corners for each pair."""
    from pyspark import StorageLevel

    df = media.rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).persist(StorageLevel.DISK_ONLY)
    df.count()
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none)
    before = {(s.stageId(), s.attemptId()) for s in map(stages.apply, range(stages.size()))}
    out = media.copy_classes(df).collect()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none)
    total = sum(s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size())) if (s.stageId(), s.attemptId()) not in before)
    df.unpersist()
    assert len(out) == 600 and 0 < total < 5_000_000, total


def test_large_pictures_have_corners_everywhere():
    rng = np.random.default_rng(8)
    big = np.vstack([np.hstack([texture(rng, 128) * (0.3 if (r, c) == (1, 1) else 1) for c in range(3)]) for r in range(3)])
    at, words = media.describe(np.clip(big, 0, 255).astype(np.uint8))
    quiet = ((at[:, :2] > 136) & (at[:, :2] < 248)).all(1)
    assert quiet.sum() >= 8 and at[:, 2].max() > 3
    crop = np.clip(big, 0, 255).astype(np.uint8)[130:250, 130:250]
    assert media.same_picture(at, *[media.describe(crop)[k] for k in (0,)], words, media.describe(crop)[1])


def test_noisy_rescaled_and_recompressed_copies(spark):
    rng = np.random.default_rng(5)
    images = []
    for i in range(12):
        a = texture(rng, 64)
        images += [(10 * i, a), (10 * i + 1, a + rng.normal(0, 3, a.shape)), (10 * i + 2, media._resized(a, 0.75)), (10 * i + 3, recompressed(a, 16))]
    df = image_table(spark, images)
    got = {r["image_id"]: r["class_id"] for r in media.copy_classes(df).collect()}
    assert all(got[10 * i] == 10 * i for i in range(12))
    found = {k: sum(got[10 * i + k] == 10 * i for i in range(12)) for k in (1, 2, 3)}
    assert sum(found.values()) >= 0.9 * 36, found


def test_odd_images(spark):
    rows = [(1, 3, 3, bytes(9)), (2, 2, 2, b"abc"), (None, 3, 3, bytes(9)), (4, None, 1, b"a"), (5, 0, 0, b"")]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")
    got = Counter(tuple(r) for r in media.copy_classes(df).collect())
    assert got == Counter([(1, 1), (2, 2), (None, 1), (4, 4), (5, 5)])
    assert media.copy_classes(df.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        rows = docs.collect()
        ids = Counter(r["doc_id"] for r in rows)
        assert rows and all(kept[r["doc_id"]] == r["text"] for r in rows)
        assert max(ids.values()) == (2 if name == "mixing" else 1)
        kept = {r["doc_id"]: r["text"] for r in rows}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in out) == ids
    assert corpus_pipeline.run(spark, sf_dir).count() == len(out)


def odd_folder(spark, tmp_path, rows, more="1 as need, 's' as component_id, 2 as copies, 'x' as own_key, 0.5 as score, 3 as size"):
    """Tables for the pipeline with columns of names that stages use themselves."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *more.split(", "))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 60)] + [(None, 1, 0), (5, None, None), (7, 1, 1), (7, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, "which seven rivers cross the old northern province before they reach the sea answer: the Alder and six others"), (None, None), (2, ""), (3, None), (None, "ab cd")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in ("river", "stone", "light", "paper", "green", "north") for b in ("s", "ed", "ing", "less", "y", "er", "ful")]
    prose = lambda n: " ".join(rng.choice(words, n)) + ". "
    item = "which seven rivers cross the old northern province before they reach the sea answer: the Alder and six others"
    rows = []
    for i in range(60):
        good = i % 3 > 0
        rows.append((i, "".join(prose(12) for _ in range(6)) if good else "$$$ %% ## " * 40, "en", ["a", "b", None][i % 3], 5))
    rows += [(100, rows[1][1], None, None, None), (101, rows[1][1] + "more", "en", "a", 1), (rows[4][0], rows[4][1], "de", "b", 9), rows[4], rows[4]]
    rows += [(200, prose(20) + item + prose(20), "en", "a", 1), (None, prose(30), None, None, None), (None, prose(30), None, None, None), (300, None, None, None, None), (301, "", None, "c", None), (302, prose(60_000), "en", "c", None)]
    folder = odd_folder(spark, tmp_path / "t", rows)
    kept = Counter(r[0] for r in rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = Counter(r["doc_id"] for r in docs.collect())
        assert set(now) <= set(kept) and (name == "mixing" or all(now[k] <= kept[k] for k in now))
        if name == "near_duplicates":
            assert now[4] <= 1 and now[1] + now[100] + now[101] <= 1 and now[302] == kept[302]
        if name == "decontamination":
            assert now[200] == 0 and kept - now == Counter({200: kept[200]})
        kept = now
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in out) == kept
    place = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == place and r["n_tokens"] >= 1
        place += r["n_tokens"]


def test_pipeline_of_no_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert corpus_pipeline.run(spark, odd_folder(spark, tmp_path / "t", [])).collect() == []
    rows = [(None, None, None, None, None)] * 3
    out = corpus_pipeline.run(spark, odd_folder(spark, tmp_path / "u", rows)).collect()
    assert all(r["doc_id"] is None and r["n_tokens"] == 1 for r in out)


def test_queries_have_unique_operators():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES if k != "pipeline") == list(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES)
