"""Corpus operators against brute force on small inputs with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import io
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelith.llm import decontam, html_text, linededup, mixing, pii, quality, secrets, setjoin, tokenfile
from voxelith.llm.common import shingle_sets, word_hashes, text_buffers
from voxelith.llm.components import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)], DOC)


def words(rng, n, vocab=4000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


# ---- kernel ----


def test_word_hashes_tell_words_apart_and_only_words():
    texts = ["A b\tc", None, "", " a  B\x0bc d ", "x" * 3_000_000 + " tail", "é É"]
    hashes, at = word_hashes(*text_buffers(pa.array(texts)))
    split = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(at).tolist() == [len(x) for x in split]
    seen = {}
    for h, w in zip(hashes.tolist(), [w for x in split for w in x], strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# ---- components ----


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (7, 7)]
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    assert got == {x: find(x) for x in up}


# ---- 4: Jaccard join ----


def classes_by_force(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return out


def test_jaccard_components_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "one", "ONE", "a b c d", "a  B\nc d", "a b c d e", "a b c d e f", "b c d e f", " "]
    for n in (6, 9, 14, 25, 60, 300):
        base = words(rng, n)
        texts += [" ".join(base), " ".join(base).upper(), " ".join(base) + " tail"]
        texts += [" ".join(near(rng, base, c)) for c in (1, 1, 2, 3, 4) if c < n]
    hub = words(rng, 120)
    texts += [" ".join(near(rng, hub, rng.randrange(1, 5))) for _ in range(60)]  # edited copies of one text
    passage = words(rng, 60)
    texts += [" ".join(words(rng, 40) + passage + words(rng, 20)) for _ in range(40)]  # a passage that many share
    rows = list(enumerate(texts)) + [(3, "one"), (None, " ".join(hub)), (500, " ".join(passage))]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows]).withColumn("node", F.lit("clash")).withColumn("key", F.lit(1))
    got = Counter(tuple(r) for r in setjoin.similar_components(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == classes_by_force(rows)
    assert setjoin.similar_components(df.limit(0)).count() == 0


def test_many_edited_copies_of_one_text_equal_brute_force(spark):
    rng = random.Random(5)
    base = words(rng, 150)
    texts = []
    for _ in range(900):  # few edits of own words, and edits that many copies have in common
        w = near(rng, base, rng.randrange(0, 12))
        for at in rng.sample(range(0, 150, 25), rng.randrange(0, 4)):
            w[at] = f"shared{at}"
        texts.append(" ".join(w))
    sets = list(shingle_sets(pa.array(texts)))
    every = np.unique(np.concatenate(sets))
    has = np.zeros((len(sets), len(every)), np.float32)
    for i, s in enumerate(sets):
        has[i, np.searchsorted(every, s)] = 1
    both, sizes = has @ has.T, has.sum(1)
    links = np.argwhere(100 * both >= 75 * (sizes[:, None] + sizes[None, :] - both))
    least = np.arange(len(sets))
    while True:
        nxt = least.copy()
        np.minimum.at(nxt, links[:, 0], least[links[:, 1]])
        if (nxt == least).all():
            break
        least = nxt
    assert 10 < len(set(least.tolist())) < 890
    got = {r["doc_id"]: r["component_id"] for r in setjoin.similar_components(docs(spark, texts)).collect()}
    assert got == dict(enumerate(least.tolist()))


def test_similar_sets_share_as_many_keys_as_promised():
    rng = np.random.default_rng(0)
    sim, none = setjoin.Similarity(75), (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 11, 15, 16, 17, 20, 21, 40, 63, 64, 80, 90, 250, 256, 300]:
        for _ in range(12):
            a = rng.integers(1, 1 << 63, n, dtype=np.uint64)
            drop = int(rng.integers(0, max(1, n // 4 + 1)))
            b = np.concatenate([a[drop:], rng.integers(1, 1 << 63, int(rng.integers(0, max(1, n // 4 + 1))), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            if not len(b):
                continue
            common = len(np.intersect1d(a, b))
            if 100 * common >= 75 * (len(a) + len(b) - common):
                (x, p), (y, q) = setjoin.index_keys(a, sim, *none), setjoin.index_keys(b, sim, *none)
                assert len(np.intersect1d(x, y)) >= min(p, q)


def test_crowded_segments_fall_back_to_one_deletion():
    sim, none = setjoin.Similarity(75), (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    a = np.arange(1, 13, dtype=np.uint64)  # all in one segment
    for b in (a[:-1], a[1:], np.append(a, np.uint64(99))):
        (x, _), (y, _) = setjoin.index_keys(a, sim, *none), setjoin.index_keys(b, sim, *none)
        assert len(np.intersect1d(x, y))


def test_one_of_each_keeps_one_row_a_component(spark):
    t = " ".join(words(random.Random(2), 50))
    df = docs(spark, [t, t + " x", None, "", "", "alone here", t], [5, 4, 7, 8, 8, 9, 6])
    assert sorted((r["doc_id"], r["text"] or "") for r in setjoin.one_of_each(df).collect()) == [(4, t + " x"), (7, ""), (8, ""), (9, "alone here")]


# ---- 1: HTML ----


def test_main_text_of_pages(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/x>Home</a></nav><div class="ad">Buy it now, all of you</div>
    <article><h1>Head &amp; line</h1><p><b>First  para\ngraph with some words<br><p>Second &lt;one&gt; with &#233; more words in it<ul><li>item one<li>item two</ul>
    <aside>left out</aside><script>var x = "</p>"</script><form><input>no</form><section class="comments"><p>reader says</p></section></article>
    <footer>&copy; me</footer></body></html>"""
    want = "Head & line\nFirst para graph with some words\nSecond <one> with é more words in it\nitem one\nitem two"
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (None, "u", "<p>"), (5, "u", "just text &amp here"), (5, "u", "a < b <<i>c</i")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    texts = [r["text"] for r in html_text.extract_main_text(pages).orderBy("page_id").collect()]
    assert want in texts and texts.count("") == 3 and "just text & here" in texts and len(texts) == 6


def test_density_finds_text_without_semantic_tags():
    links = "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(30))
    body = "".join(f"<p>{'Some words of the story go on here and there. ' * 6}{i}</p>" for i in range(5))
    text = html_text.extract(f"<body><div><ul>{links}</ul></div><div><div>{body}</div></div><div>short note</div></body>")
    assert text.count("\n") == 4 and "link number" not in text and "short note" not in text


def test_long_and_broken_pages_end():
    assert html_text.extract("<div>" * 3000 + "deep") == "deep"
    assert html_text.extract("<!-- " + "x" * 100000) == "" and html_text.extract("<p>a</p>" + "<a '" * 2000).startswith("a")


def story(rng, n):
    return [" ".join(words(rng, rng.randrange(20, 60))) + "." for _ in range(n)]


def page_of(rng, kind):
    """A page of one of several layouts, and its main text's blocks."""
    para = lambda ts: "".join(f"<p>{t}</p>" for t in ts)
    text, title = story(rng, rng.randrange(4, 9)), " ".join(words(rng, 6))
    links = "".join(f"<li><a href=/{i}>{' '.join(words(rng, 3))}</a></li>" for i in range(rng.randrange(5, 30)))
    top = f"<nav><ul>{links}</ul></nav><div class='cookie-banner'>{' '.join(words(rng, 15))}</div>"
    end = f"<div class='comments-area'>{para(story(rng, 2))}</div><div id=sidebar><ul>{links}</ul></div><footer>{' '.join(words(rng, 10))}</footer>"
    if kind == 0:  # semantic
        return f"<body>{top}<article><h1>{title}</h1>{para(text)}</article>{end}", [title, *text]
    if kind == 1:  # no semantic elements
        return f"<body>{top}<div class=wrap><div class=left><ul>{links}</ul></div><div class=story><h1>{title}</h1><div>{para(text)}</div></div></div>{end}", [title, *text]
    if kind == 2:  # role=main in a wrapper with more
        return f"<body><div id=wrap><ul>{links}</ul><div role=main><h1>{title}</h1>{para(text)}</div><ul>{links}</ul></div>{end}", [title, *text]
    if kind == 3:  # one text over several articles
        half = len(text) // 2
        return f"<body>{top}<main><article><h1>{title}</h1>{para(text[:half])}</article><article>{para(text[half:])}</article></main>{end}", [title, *text]
    if kind == 4:  # text in main, teasers in articles
        teasers = "".join(f"<article><a href=/{i}>{' '.join(words(rng, 5))}</a></article>" for i in range(4))
        return f"<body>{top}<main><div><h1>{title}</h1>{para(text)}</div><section>{teasers}</section></main>{end}", [title, *text]
    if kind == 5:  # the whole body in a form
        return f"<body><form method=post><input name=v value=x>{top}<div class=content><h1>{title}</h1>{para(text)}<button>Go</button></div>{end}</form>", [title, *text]
    if kind >= 7:  # class names of a widespread blog system, on what holds the text
        outer, inner = [("<div id=page class='site no-sidebar'>", "<article class='post tag-cookies category-comments'>"), ("<div class='content has-sidebar'>", "<div class='entry comments-open'>"), ("<div class='wrap page-template-sidebar'>", "<div class=text>")][kind - 7]
        close = "</article>" if inner.startswith("<article") else "</div>"
        readers = "".join(f"<article class='comment even'><p>{t}</p></article>" for t in story(rng, 4))
        return f"<body>{top}{outer}{inner}<h1>{title}</h1>{para(text)}{close}<div id=comments class='comments-area'><h2>Comments</h2>{readers}</div></div>{end}", [title, *text]
    # names that only look like those of other parts, and a link list in the text
    marked = f"<p class='form-text'>{text[0]}</p><p class='social-history'>{text[1]}</p><div class='search-results'>{para(text[2:])}</div>"
    return f"<body>{top}<article><h1>{title}</h1>{marked}<ul>{links}</ul></article>{end}", [title, *text]


@pytest.mark.parametrize("kind", range(10))
def test_gold_pages(kind):
    rng = random.Random(kind)
    hit = found = there = 0
    for _ in range(15):
        page, gold = page_of(rng, kind)
        got, want = Counter(html_text.extract(page).split()), Counter(" ".join(gold).split())
        hit, found, there = hit + (got & want).total(), found + got.total(), there + want.total()
    assert hit >= 0.97 * there and hit >= 0.97 * found, (hit, found, there)


def test_sections_of_one_text_stay_together():
    rng = random.Random(2)
    word = lambda n: " ".join(words(rng, n))
    for tag, sizes in (("section", (200, 5, 70)), ("div", (60, 20, 40, 5)), ("section", (5, 300))):
        heads, texts = [word(3) for _ in sizes], [word(n) for n in sizes]
        parts = "".join(f"<{tag}><h2>{h}</h2><p>{t}</p></{tag}>" for h, t in zip(heads, texts, strict=True))
        want = [x for pair in zip(heads, texts, strict=True) for x in pair]
        for page in (f"<body><nav><a href=/>Home</a></nav><div class=w>{parts}</div><div>{word(4)}</div></body>", f"<body>{parts}</body>"):
            assert html_text.extract(page).split("\n") == want
    same = "<p>" + word(40) + "</p>"
    assert html_text.extract(f"<body><div><section>{same * 3}</section><section>{same}</section><section>{same * 2}</section></div></body>").count("\n") == 5


def test_names_are_a_vote_and_references_stay():
    rng = random.Random(3)
    text = ["Plain text of the page, " + t for t in story(rng, 5)]
    body = "".join(f"<p>{t}</p>" for t in text)
    for name in ("search", "widget", "newsletter-archive", "overlay content"):  # nothing else holds a text
        assert html_text.extract(f"<body><div class='{name}'>{body}</div><div>{' '.join(words(rng, 5))}</div></body>") == "\n".join(text)
    readers = "".join(f"<div class=comment><p>{t}</p></div>" for t in story(rng, 30))  # more than the text itself
    assert html_text.extract(f"<body><div><h1>T</h1>{body}</div><div class='comments-area'>{readers}</div></body>") == "\n".join(["T", *text])
    works = "".join(f"<li><a href=/{i}>Somebody {i}, A Treatise on the Extraction of Text, vol. {i}</a></li>" for i in range(6))
    assert html_text.extract(f"<body><article><h1>T</h1>{body}<h2>Works</h2><ul>{works}</ul></article></body>").count("Treatise") == 6
    deep = "<div class=sidebar>" * 5000 + body
    began = time.process_time()
    assert html_text.extract(deep) == "\n".join(text) and time.process_time() - began < 20


def test_density_decides_where_the_text_is():
    rng = random.Random(1)
    text = story(rng, 6)
    body = "".join(f"<p>{t}</p>" for t in text)
    page = f"<body><article><p>short teaser</p></article><div><div>{body}</div></div></body>"
    assert html_text.extract(page) == "\n".join(text)


def test_parser_is_linear():
    began = time.process_time()
    for page in ("<div>" * 100_000 + "x" + "</q>" * 100_000, "<b>" * 50_000 + "<p>x" * 50_000, "<p><table>" + "<b>x" * 50_000 + "</p>" * 50_000, "<span>" * 50_000 + "<li>x" * 50_000, "<b><i>x</b></i>" * 50_000):
        assert "x" in html_text.extract(page)
    assert time.process_time() - began < 60
    assert html_text.extract("<p>İ</p><SCRIPT>var a;</SCRIPT><p>kept</p>") == "İ\nkept"


# ---- 2: mixing ----


def mix_by_force(rows):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    order = sorted([s for s in size if s is not None]) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), list(order)
    while True:
        level = left / max(1, sum(weight[s] for s in open_))
        full = [s for s in open_ if level * weight[s] >= 2 * size[s]]
        if not full:
            return size, target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.remove(s)
        if not open_:
            return size, target


def test_mix_targets_and_totals(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 60))), rng.choice(["a", "a", "a", "a", "b", "ä", "z", None])) for i in range(800)]
    rows += [(None, None, "a"), (5, "again and again", "a"), (5, "again and again", "a"), (900, "", "empty")]
    df = docs(spark, [t for _, t, _ in rows], [i for i, _, _ in rows], [s for _, _, s in rows]).withColumn("copies", F.lit("clash")).withColumn("place", F.lit(1))
    out = mixing.mixed(df).collect()
    size, target = mix_by_force(rows)
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for r in out:
        assert r["size"] == len((r["text"] or "").encode().split()) and 0 <= r["copies"] <= 2
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        taken[r["source"]] += r["copies"] * r["size"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 120
    again = Counter(map(tuple, mixing.mixed(df).collect()))
    assert again == Counter(map(tuple, out)) and mixing.mixed(df.limit(0)).count() == 0


def test_empty_texts_of_a_capped_source_are_taken_twice_at_most(spark):
    rows = [(i, "" if i % 3 == 0 else "a b c", "small") for i in range(60)] + [(100 + i, "w " * 50, "large") for i in range(60)]
    out = mixing.mixed(docs(spark, [t for _, t, _ in rows], [i for i, _, _ in rows], [x for _, _, x in rows])).collect()
    assert max(r["copies"] for r in out) == 2 and {r["copies"] for r in out if r["source"] == "small"} == {2}


# ---- 5: token files ----


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


STRANGE = ["", None, "Don't STOP, it's they'll", "a<|endoftext|>b <|startoftext|>", "Ünïcode ÉCOLE naïve ß İstanbul ﬁ", "1234 5.6e7", "é ≠ a̸", "Σίσυφος ΟΔΟΣ", "x y z\x85w", "日本語 テキスト", "🙂👍🏽 ok", "word.Next,word;it's!'ll", "\x00\x01 a", "a" * 5000, "ſecret K", "<|END", "..,,!!", "l'été d'été"]


def test_word_by_word_equals_the_library(vocabulary):
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(vocabulary), tokenfile.WordTokenizer(vocabulary)
    rng = random.Random(4)
    chars = "abcXYZ'.,!?;:-<|> \t\néÉß̸́ 1239_中"
    texts = STRANGE + ["".join(rng.choice(chars) for _ in range(rng.randrange(80))) for _ in range(3000)]
    for got, x in zip(w.encode(pa.array(texts), 2), texts, strict=True):
        assert got.tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 2], x


def test_token_files_read_back(spark, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    rng = random.Random(6)
    rows = [(rng.randrange(60), " ".join(words(rng, rng.randrange(30)))) for _ in range(120)] + [(None, "no id"), *enumerate(STRANGE)]
    manifest = tokenfile.write(docs(spark, [x for _, x in rows], [i for i, _ in rows]), vocabulary)
    out = sorted(tokenfile.read(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted([i for i, _ in rows if i is not None]) + [None]
    start = 0
    for r in out:
        assert r["start"] == start
        start += r["n_tokens"]
    ids = lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == Counter((i, len(ids(x)), zlib.crc32(ids(x).tobytes())) for i, x in rows)
    assert tokenfile.read(tokenfile.write(docs(spark, ["x"]).limit(0), vocabulary)).count() == 0


def test_reader_takes_one_frame_and_finds_damage(monkeypatch):
    class Kept(io.BytesIO):
        def close(self):
            pass

    monkeypatch.setattr(tokenfile, "FRAME", 400)
    f = Kept()
    w = tokenfile.Writer(f)
    for i in range(100):
        w.add(i, np.arange(i, dtype=np.uint16))
    w.close()
    r = tokenfile.Reader(io.BytesIO(f.getvalue()))
    assert len(r.frames) > 10
    read = []
    frame = r.frame
    r.frame = lambda k: (read.append(k), frame(k))[1]
    assert r.get(57)[0].tolist() == list(range(57)) and len(read) == 1 and r.get(1000) == []
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.getvalue()), read_across_frames=True).read()
    assert len(whole) == sum(x[1] for x in r.frames)  # a plain Zstandard reader sees the same frames
    bad = bytearray(f.getvalue())
    bad[int(r.starts[3]) + 12] ^= 0xFF
    with pytest.raises(Exception):
        tokenfile.Reader(io.BytesIO(bytes(bad))).frame(3)
    assert len(tokenfile.Reader(io.BytesIO(bytes(bad))).frame(2)) > 0


# ---- 6: quality ----


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{d}/labels.parquet")
    out = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), known).join(known, "doc_id").filter("held_out").toPandas()
    assert len(out) > 500 and (out.predicted == out.quality).mean() > 0.985
    assert out[out.quality == 1].predicted.mean() > 0.99


def test_scores_equal_density_differences(spark):
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randrange(1, 90), 300)) + ("!" * rng.randrange(0, 9) + " 12 A#b") * (i % 2) for i in range(120)]
    df = docs(spark, texts)
    known = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.classify(df, known).collect()}
    x = quality.statistics(pa.array(texts))
    y = np.array([1 - i % 2 if zlib.crc32(str(i).encode()) % 4 != 2 else -1 for i in range(120)])
    n = [(y == c).sum() for c in (0, 1)]
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    logs = []
    for c in (0, 1):
        w = quality.TO_POOLED * min(1, 1000 / n[c])
        cov = (1 - w - quality.TO_DIAGONAL) * covs[c] + w * pooled + quality.TO_DIAGONAL * np.diag(np.diag(covs[c])) + quality.FLOOR * np.eye(len(pooled))
        d = x - x[y == c].mean(0)
        logs.append(np.log(n[c] / sum(n)) - np.linalg.slogdet(cov)[1] / 2 - (d @ np.linalg.inv(cov) * d).sum(1) / 2)
    z = logs[1] - logs[0]
    want = 1 / (1 + np.exp(-z / (1 + np.abs(z) / 30)))
    assert np.allclose([got[i] for i in range(120)], want, atol=1e-6)
    kept = {r["doc_id"] for r in quality.accepted(df.withColumn("digits", F.lit("clash")), known).collect()}
    assert kept == {i for i in range(120) if want[i] >= 0.7}


def test_scores_of_odd_rows_and_missing_labels(spark):
    df = docs(spark, [None, "", "same text", "same text", "x" * 2_000_000, "A " * 500_000], [1, 2, 3, 3, None, 6]).withColumn("label", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.classify(df, none).collect()
    assert len(out) == 6 and {r["score"] for r in out} == {0.5}
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2) for r in out)
    assert quality.classify(df.limit(0), none).count() == 0 and quality.accepted(df, none).count() == 0


# ---- 7: personal data ----

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def digits(s):
    return re.sub("[^0-9]", "", s)


CHECKS = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    pieces = ["a.b@c.de", "x@y", "@", "me@site.co.uk", "1.2.3.4", "256.1.1.1", "1.2.3", "4111 1111 1111 1111", "4111111111111112", "+1 (017) 555-7713", "+12", " ", "-", ".", "é", "w", "00000000000000", "1.2.3.4.5.6.7.8", "_d@e.f", "+49 30 1234567 8"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        want = [(k, *m.span()) for k, p in enumerate(PATTERNS.values()) for m in re.finditer(p, text) if CHECKS[pii.KINDS[k]](m[0])]
        assert pii.select(text, pii.Boosted())[0] == sorted(want), text


def test_trees_add_other_forms_and_leave_clean_texts(spark):
    rng = random.Random(8)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    texts = []
    for i in range(400):
        w = words(rng, 20)
        texts.append(" ".join([*w, f"mail u{i}@h{i % 9}.example.org", *w, f"+1 (0{i % 90 + 10}) 555-{rng.randrange(1000, 9999)}", *w, card(), str(rng.randrange(10**15, 10**16)), f"{rng.randrange(300, 999)}.1.2.3", f"10.0.{i % 250}.7"]))
    clean = [" ".join(words(rng, 50)) for _ in range(50)] + ["chapter 12 of 345 and 6.7.8", None, ""]
    model = pii.train(docs(spark, texts))
    assert model.threshold <= 1
    c = card()
    dotted = ".".join(c[i : i + 4] for i in range(0, 16, 4))
    text = f"write to jane (at) host.example.org or call (017) 555-7713, card {dotted} "
    found = {text[s:e] for _, s, e in pii.select(text, model)[1]}
    assert "jane (at) host.example.org" in found and "(017) 555-7713" in found
    out = pii.find(docs(spark, clean + texts[:5] + texts[:1]), model).collect()
    assert len(out) == len(clean) + 6
    assert all(not r["spans"] for r in out if r["doc_id"] < len(clean))
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in out)
    assert "[email]" in pii.redacted(texts[0], model) and "@" not in pii.redacted(texts[0], model)
    assert pii.find(docs(spark, ["x"]).limit(0)).count() == 0


def test_candidates_do_not_depend_on_unrelated_text():
    for text, own, kind in (("ask jane at example.com today", "jane at example.com", 0), ("from 2001:db8::a1:2 on", "2001:db8::a1:2", 1), ("at ::1 or", "::1", 1), ("fe80:: is", "fe80::", 1), ("1:2:3:4:5:6:7:8 x", "1:2:3:4:5:6:7:8", 1)):
        for more in ("", " a [at] b", " one dot two"):
            assert (kind, own) in {(k, (text + more)[s:e]) for k, s, e in pii.wider(text + more)}, text
    assert not [x for t in ("std::vector", "a :: b", "1:2:3:4::5:6:7:8", "12:30") for x in pii.wider(t)]


def test_trees_learn_plain_at_and_compressed_addresses(spark):
    rng = random.Random(9)
    texts = [" ".join([*words(rng, 20), f"mail u{i}@h{i % 9}.example.org", *words(rng, 20), f"server 10.{i % 200}.{i % 250}.7", *words(rng, 9), f"{rng.randrange(300, 999)}.1.2.3"]) for i in range(400)]
    model = pii.train(docs(spark, texts))
    text = "mail jane at host.example.org or server 2001:db8::a01:203 there. We were at home. The end."
    found = {text[s:e] for _, s, e in pii.select(text, model)[1]}
    assert {"jane at host.example.org", "2001:db8::a01:203"} <= found and len(found) == 2


def test_trees_find_forms_that_no_template_has(spark):
    rng = random.Random(10)
    texts = [" ".join([*words(rng, 20), f"mail u{i}@h{i % 9}.example.org", *words(rng, 9), f"tel +1 (0{i % 90 + 10}) 555-{rng.randrange(1000, 9999)}", *words(rng, 9), f"server 10.{i % 200}.{i % 250}.7", f"{rng.randrange(300, 999)}.1.2.3"]) for i in range(400)]
    model = pii.train(docs(spark, [*texts, *texts[:1] * 500]))
    found = Counter()
    for i in range(100):
        for kind, own in (("email", f"joe.w{i}{{at}}mail{i % 7}.example.net"), ("email", f"ann{i}(at)site.example.com"), ("phone", f"({rng.randrange(200, 999)}) 555.{rng.randrange(1000, 9999)}"), ("ip", f"2001:db8:7::{i + 17:x}")):
            text = " ".join([*words(rng, 12), "contact" if kind == "email" else "call" if kind == "phone" else "host", own, *words(rng, 12)])
            spans = pii.select(text, model)[1]
            found[kind, "hit"] += own in {text[s:e] for _, s, e in spans}
            found[kind, "all"] += 1
            found["extra"] += len([1 for _, s, e in spans if text[s:e] != own])
    for i in range(200):
        text = " ".join([*words(rng, 20), f"at {i % 12 + 1}:{i % 60:02} on page {i} of 345, version 1.{i % 9}.2, look at home. Then 12 34", *words(rng, 5)])
        found["clean"] += bool(pii.select(text, model)[1])
    for kind in ("email", "phone", "ip"):
        assert found[kind, "hit"] >= 0.9 * found[kind, "all"], found
    assert found["clean"] <= 2 and found["extra"] <= 8, found


def test_taken_stretches_equal_brute_force():
    from voxelith.llm.common import Taken

    rng = random.Random(11)
    for _ in range(200):
        taken, cells = Taken(), set()
        for _ in range(30):
            s = rng.randrange(60)
            e = s + rng.randrange(1, 12)
            assert taken.free(s, e) == (not cells & set(range(s, e)))
            if rng.random() < 0.6:
                taken.add(s, e)
                cells |= set(range(s, e))


def test_very_many_spans_and_failed_matches(spark):
    rng = random.Random(12)
    texts = [" ".join([*words(rng, 20), f"mail u{i}@h{i % 9}.example.org", *words(rng, 9), f"tel +1 (0{i % 90 + 10}) 555-{rng.randrange(1000, 9999)}", *words(rng, 9), f"server 10.{i % 200}.{i % 250}.7", f"{rng.randrange(300, 999)}.1.2.3 card 4111 1111 1111 1111"]) for i in range(400)]
    model = pii.train(docs(spark, texts))
    text = "call " + " ".join(f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}," for _ in range(20_000))
    began = time.process_time()
    assert len(pii.select(text, model)[1]) > 10_000
    assert time.process_time() - began < 20
    assert not [s for t in ("card 4111.1111.1111.1111", "host 999.1.2.3") for s in pii.select(t, model)[1] if s[0] == 1]
    for own in ("jane @ example.com", "jane AT example DOT com", "jane@ example.org"):
        assert (0, own) in {(k, t[s:e]) for t in [f"please write to {own} today"] for k, s, e in pii.wider(t)}
    found = [own in {t[s:e] for s, e in [x[1:] for x in pii.select(t, model)[1]]} for i in range(40) for own in (f"joe{i} @ mail{i % 5}.example.net", f"ann{i} AT site DOT example DOT com") for t in [" ".join([*words(rng, 9), "contact", own, *words(rng, 9)])]]
    assert sum(found) >= 0.9 * len(found)
    tokens = "-".join("eyJ" + "a" * 20 for _ in range(100_000))
    began = time.process_time()
    rule = next(r for r in secrets.RULES if r.kind == "web_token")
    assert rule.spans(tokens) == [] and time.process_time() - began < 10
    one = "x-eyJabcdefgh1.eyJabcdefgh2.signature_1 eyJabcdefgh.eyJabcdefgh.short eyJaaaaaaaaaa"
    assert [one[s:e] for s, e in rule.spans(one)] == ["eyJabcdefgh1.eyJabcdefgh2.signature_1"]


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + " " * 300_000, "@a" * 100_000):
        pii.select(text, pii.Boosted())


# ---- 8: lines ----


def lines_by_force(rows):
    def within(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        p = len(os.path.commonprefix([a, b]))
        return max(len(a), len(b)) - p - len(os.path.commonprefix([a[p:][::-1], b[p:][::-1]])) <= 1

    all_ = [((d is None, d or 0, n), x) for d, t in rows if t is not None for n, x in enumerate(t.split("\n")) if len(x) >= 20]
    first = {}
    for at, x in all_:
        first[x] = min(at, first.get(x, at))
    keep = {x: min(a for y, a in first.items() if within(x, y)) for x in first}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        ls = t.split("\n")
        kept = [x for n, x in enumerate(ls) if len(x) < 20 or (d is None, d or 0, n) <= keep[x]]
        out.append((d, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return Counter(out)


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(words(rng, 8)) + "é" for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "short\nshort"), (3, base[0] + "\n" + base[0])]
    for i in range(4, 60):
        ls = []
        for _ in range(rng.randrange(1, 6)):
            x = rng.choice(base)
            k = rng.randrange(len(x))
            ls.append(rng.choice([x, x[:k] + x[k + 1 :], x[:k] + "ü" + x[k:], x[:k] + "#" + x[k + 1 :], x[:k] + "##" + x[k:], " ".join(words(rng, 6))]))
        rows.append((i, "\n".join(ls)))
    rows += [(70, rows[10][1]), (None, rows[11][1])]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows]).withColumn("line", F.lit("clash"))
    assert Counter(tuple(r) for r in linededup.without_repeated_lines(df).collect()) == lines_by_force(rows)
    assert linededup.without_repeated_lines(df.limit(0)).count() == 0


def test_long_lines(spark):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    rows, w = [], linededup.WINDOW
    for n in (w, w + 1, 2 * w - 1, 2 * w, 2 * w + 1, 2 * w + 2, 4 * w - 1, 4 * w, 4 * w + 1, 6 * w + 60):
        x = text(n)
        for k in {0, 1, n // 2, n // 2 + 1, n - 1, w - 1, w % n, rng.randrange(n)}:
            for y in (x[:k] + x[k + 1 :], x[:k] + "ü" + x[k:], x[:k] + "#" + x[k + 1 :], x[:k] + "##" + x[k:], x):
                rows.append((len(rows), y))
    rng.shuffle(rows)
    got = Counter(tuple(r) for r in linededup.without_repeated_lines(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect())
    assert got == lines_by_force(rows)
    x = text(1_000_000)
    began = time.time()
    out = linededup.without_repeated_lines(docs(spark, [x, x[:600_000] + "#" + x[600_000:], x[:-2] + "##"])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {0: 0, 1: 1, 2: 0} and time.time() - began < 120


def test_lines_of_a_large_alphabet_meet_once(spark):
    """Lines that differ in one character all belong to one bucket; the work grows with their number, and all but the first go."""
    rows = [(i, f"chapter {chr(0x4E00 + i)} of the long old book") for i in range(6000)] + [(9000, "chapter  of the long old book"), (9001, "chapter zz of the long old book")]
    began = time.time()
    out = {r["doc_id"]: r["n_removed"] for r in linededup.without_repeated_lines(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    assert out[0] == 0 and all(out[i] == 1 for i in range(1, 6000)) and out[9000] == 1 and out[9001] == 0
    assert time.time() - began < 90


def test_short_lines_can_take_part(spark):
    rows = [(1, "ab\nabc\nx"), (2, "ab\nzz"), (3, "")]
    out = {r["doc_id"]: r["text"] for r in linededup.without_repeated_lines(docs(spark, [t for _, t in rows], [1, 2, 3]), min_chars=2).collect()}
    assert out == {1: "ab\nx", 2: "zz", 3: ""}


# ---- 9: secrets ----


def test_queries_are_mandatory_and_spans_equal_the_rules(spark):
    rng = random.Random(10)
    q = {r.kind: secrets.query(r.pattern) for r in secrets.RULES}
    assert q["hex"] == [] and q["access"] == [[frozenset({"aki", "kia"})]]
    pieces = ["password", "PassWd", "api_key", "APIKEY", "tokens", "Secret", "ſecret", '"', "'", " = ", ":", "=", "abc123", "x" * 7, "AKIA" + "Q7" * 9, "AKIA123", "0123456789abcdef" * 2, "deadbeef", "\n", "é", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "xoxb-" + "1" * 12, " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 10))) for _ in range(600)] + [None, "", "clean text here"]
    out = {r["doc_id"]: r["spans"] for r in secrets.find(docs(spark, texts).withColumn("rules", F.lit("clash"))).collect()}
    base = [("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(base) for m in re.finditer(p, t or "", re.ASCII) if ok(m))
        assert [(r["start"], r["kind"], r["end"]) for r in out[i] if r["base"]] == [(s, base[k][0], e) for s, k, e in want], t
        low = (t or "").lower()
        for r in secrets.RULES:
            if t and r.spans(t):
                assert all(any(all(g in low for g in grams) for grams in clause) for clause in q[r.kind])
    assert any(x["kind"] == "private_key" for x in out.values() for x in x) and not out[602]


# ---- 10: decontamination ----


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(11)
    items = [words(rng, rng.randrange(12, 58), 3000) for _ in range(60)] + [words(rng, 150, 3000)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, ""), (92, "two words"), (93, " ".join(items[0]))], "item_id long, text string")
    texts, want = [], set()
    for i, w in enumerate(items):
        edited = list(w)
        edited[len(w) // 3] = "other"
        loud = [x.upper() + "," for x in w]
        for form in (w, edited, loud):
            want.add((len(texts), i))
            texts.append(" ".join(words(rng, rng.randrange(0, 300), 3000) + form + words(rng, rng.randrange(0, 300), 3000)))
    n = len(texts)
    texts += [" ".join(words(rng, 200, 3000)) for _ in range(200)] + [None, "", "..."]
    df = docs(spark, texts)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()}
    twin = {(d, 93) for d, i in want if i == 0}
    assert got >= want | twin and {d for d, _ in got} <= set(range(n))
    left = {r["doc_id"] for r in decontam.without_leaks(df, bench).collect()}
    assert left == set(range(n, len(texts)))
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_unspaced_scripts_and_short_items(spark):
    rng = random.Random(13)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    items = [han(40) for _ in range(20)] + ["".join(chr(rng.randrange(0x0E01, 0x0E2E)) for _ in range(40)), "what is 2+2?", "Capital of France"]
    bench = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, "?!")], "item_id long, text string")
    edited = lambda x: x[:9] + han(1) + x[10:25] + x[26:]
    texts = [han(60) + edited(x) + han(60) for x in items[:20]] + [f"abc {items[20]} def", "Q:\nWhat is 2 + 2?\nfour", "the capital of france is", "capital of  France", None, ""]
    texts += [han(150) for _ in range(40)] + [" ".join(words(rng, 60)) for _ in range(60)]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(i, i) for i in range(22)} | {(23, 22)}
    assert len(decontam.words_of(pa.array(["ab 日本 语x"]))[0]) == 5


def test_recall_on_paraphrases(spark):
    rng = random.Random(14)
    items = [words(rng, rng.randrange(20, 46)) for _ in range(120)]

    def paraphrase(w):
        out = []
        for x in w:
            r = rng.random()
            out += [f"p{rng.randrange(999)}"] if r < 0.1 else [] if r < 0.18 else [x, f"q{rng.randrange(999)}"] if r < 0.24 else [x]
        return out

    texts = [" ".join(words(rng, 80) + paraphrase(w) + words(rng, 80)) for w in items] + [" ".join(words(rng, 200)) for _ in range(200)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(spark, texts), bench).collect()}
    assert len(got & {(i, i) for i in range(120)}) >= 0.9 * 120 and not got - {(i, i) for i in range(120)}


def test_window_search_equals_brute_force():
    rng = random.Random(12)
    parts = [words(rng, k, 400) for k in (9, 14, 20, 30, 40, 60)]
    texts = [" ".join(words(rng, 200, 400) + parts[i % 6] + words(rng, 90, 400)) for i in range(30)]
    idf = np.full(1 << decontam.BITS, 1.5)
    hashes = [decontam.words_of(pa.array([" ".join(p)]))[0] for p in parts]
    used = np.unique(np.concatenate([decontam.feature(h) for h in hashes]))
    place = np.full(1 << decontam.BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    who, col, weight, norm = decontam._rows(hashes, idf, place)
    a = np.zeros((6, len(used)))
    a[who, col] = weight / norm[who]
    size = np.array([next(s for s in decontam.WINDOWS if len(h) <= s) for h in hashes])
    v = np.linalg.svd(a, full_matrices=False)[2].T
    peaks = {s: np.max(np.where((size == s)[:, None], a, 0), 0) * 1.5 for s in decontam.WINDOWS}
    block = decontam.Block(np.arange(6), size, hashes, hashes, place, (v * 1.5).astype(np.float32), (a @ v).astype(np.float32), idf, peaks)
    w, at = decontam.words_of(pa.array(texts))
    got = {(t, p, s) for t, p, s, _, _ in decontam.windows_near(w, at, block)}
    want = set()
    for t in range(len(texts)):
        f = decontam.feature(w[at[t] : at[t + 1]])
        for p in range(6):
            step = size[p] // 4
            for s in range(0, len(f), step):
                win = Counter(f[s : s + size[p]].tolist())
                q = dict(zip(used[a[p] > 0].tolist(), a[p][a[p] > 0].tolist(), strict=True))
                cos = sum(win[x] * y for x, y in q.items() if x in win) / np.sqrt(sum(c * c for c in win.values()))
                if cos >= decontam.COSINE + 1e-5:
                    want.add((t, p, int(at[t]) + s))
    assert want <= got and len(got) <= len(want) + 3


def test_benchmark_above_the_rank_equals_brute_force(spark):
    rng = random.Random(21)
    items = [words(rng, rng.randrange(20, 60), 6000) for _ in range(1100)]
    texts = []
    for w in items[::11]:
        edited = list(w)
        edited[len(w) // 3] = edited[len(w) // 2] = f"other{len(texts)}"
        texts += [" ".join(words(rng, rng.randrange(0, 90), 6000) + form + words(rng, 40, 6000)) for form in (w, edited)]
    texts += [" ".join(words(rng, 100, 6000)) for _ in range(50)]
    df, bench = docs(spark, texts), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["cosine"] for r in decontam.contaminated(df, bench).collect()}
    assert set(got) >= {(2 * k + e, 11 * k) for k in range(100) for e in (0, 1)}

    idf = decontam.inverse_frequencies(df)
    assert (idf > 0).all()  # no common words here
    hashes = [decontam.words_of(pa.array([" ".join(w)]))[0] for w in items]
    used = np.unique(np.concatenate([decontam.feature(h) for h in hashes]))
    dense = np.zeros((len(items), len(used)))
    for i, h in enumerate(hashes):
        np.add.at(dense[i], np.searchsorted(used, decontam.feature(h)), 1)
    dense *= idf[used]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    size = np.array([next(s for s in decontam.WINDOWS if len(h) <= s) for h in hashes])
    want = set()
    for t, x in enumerate(texts):
        w = decontam.words_of(pa.array([x]))[0]
        for s in np.unique(size):
            for start in range(0, len(w), s // 4):
                f, n = np.unique(decontam.feature(w[start : start + s]), return_counts=True)
                v = np.zeros(len(used))
                known = np.isin(f, used)
                v[np.searchsorted(used, f[known])] = (n * idf[f])[known]
                cos = dense @ v / np.linalg.norm(n * idf[f])
                region = w[max(0, start - s // 2) : start + s + s // 2]
                for p in np.flatnonzero((cos >= decontam.COSINE) & (size == s)):
                    overlap = decontam.common_subsequence(hashes[p], region) / len(hashes[p])
                    answer = decontam.words_of(pa.array([decontam._answer(" ".join(items[p]))]))[0]
                    if overlap >= decontam.STRONG or overlap >= decontam.WEAK and decontam.common_subsequence(answer, region) >= decontam.ANSWER * len(answer):
                        want.add((t, int(p)))
    assert set(got) == want


def test_longest_common_subsequence():
    a, b = np.array([1, 2, 3, 4, 5, 1]), np.array([9, 2, 4, 3, 5, 1, 1])
    assert decontam.common_subsequence(a, b) == 4


def test_empty_hash_of_no_spans():
    assert pii.digest(pii.spans_text([])) == hashlib.sha256(b"").hexdigest()


def test_shingles_of_short_and_empty_texts():
    sets = list(shingle_sets(pa.array(["a b", "a b c d e", None, "", "b a", "A B"])))
    assert [len(s) for s in sets] == [1, 1, 0, 0, 1, 1] and sets[0] == sets[5] and sets[0] != sets[4]
