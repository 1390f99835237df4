"""Personal data: candidate spans, boosted trees, calibrated selection.

Fixed patterns give the base spans, which are always kept. Wider generators propose further spans, which may
overlap: numbers without a country code, spelled-out addresses, unusual separators, eight-group addresses.
Gradient-boosted trees score every candidate from its format and its surroundings; candidates above the
calibrated threshold that overlap no kept span are added, best first.

The trees learn from a bounded sample of the corpus itself (SAMPLE documents, taken by a hash of the text):
base spans and rewritten forms of them are the positive rows, candidates that fail their kind's check and
damaged rewritings are the negative ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.boosting import Boosted, fit
from voxelith.llm.common import Taken

KINDS = ("email", "ip", "card", "phone")
#: Documents at most from which the trees learn.
SAMPLE = 20_000

# Fixed patterns of the base spans.
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider generators.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?(?:[(\[{](?i:at)[)\]}]|\x20(?i:at)\x20)\x20?|\x20@\x20?|@\x20)[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[{](?i:dot)[)\]}]|\x20(?i:dot)\x20)\x20?[A-Za-z0-9-]{2,63}){1,4}")
_SPELLED_HINT = re.compile(r"[(\[{](?i:at)[)\]}]|\x20(?i:at)\x20|\x20@|@\x20")  # every match of _SPELLED has one
_SENTENCE_END = re.compile(r"\.\x20|\x20\.")
_SIX = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_SIX_SHORT = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])")
_DOTTED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{1,7}(?![0-9.])")
_HINTS = [re.compile(x) for x in (r"(?i:mail|contact|write|address)", r"(?i:\bip\b|server|host|addr|from)", r"(?i:card|visa|account|pay)", r"(?i:tel|phone|call|mobile|fax)")]

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        m = _AFTER_AT.match(text, at)
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def matches(text: str) -> Iterator[tuple[Span, bool]]:
    """Leftmost matches of the fixed patterns, and whether each passes its kind's check."""
    for s, e in _emails(text):
        yield (0, s, e), True
    if "." in text:
        for m in _IP.finditer(text):
            yield (1, *m.span()), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if len(d) >= 8:
            yield (2, *m.span()), 13 <= len(d) <= 19 and luhn(d)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield (3, *m.span()), 9 <= len(_digits(m[0])) <= 15


def wider(text: str) -> Iterator[Span]:
    """Candidates of the wider generators."""
    if _SPELLED_HINT.search(text):
        for m in _SPELLED.finditer(text):
            yield 0, *m.span()
    if text.count(":") >= 7:
        for m in _SIX.finditer(text):
            yield 1, *m.span()
    if "::" in text:
        for m in _SIX_SHORT.finditer(text):
            if 1 <= sum(map(bool, m[0].split(":"))) <= 7:
                yield 1, *m.span()
    for m in _DOTTED_CARD.finditer(text):
        yield 2, *m.span()
    for m in _NUMBER.finditer(text):
        yield 3, *m.span()


def features(text: str, span: Span) -> list[float]:
    """Format and surroundings of a candidate."""
    kind, s, e = span
    own, before, after = text[s:e], text[max(0, s - 40) : s], text[e : e + 10]
    d = _digits(own)
    parts = re.split(r"[^0-9]+", own)
    prev, nxt = before[-1:], after[:1]
    return [
        float(kind),
        float(len(own)),
        float(len(d)),
        float(luhn(d)) if d else 0.0,
        float(max((int(p[-9:]) for p in parts if p), default=0) <= 255),
        float(max(map(len, parts))),
        float(sum(not c.isalnum() for c in own)),
        float(len({c for c in own if not c.isalnum()})),
        float(own[:1] == "+"),
        float("@" in own),
        float(bool(_SPELLED_HINT.search(own))),
        float(sum(c.isalpha() for c in own)) / max(1, len(own)),
        float(prev == "" or prev.isspace()),
        float(prev.isalnum()),
        float(nxt == "" or nxt.isspace() or nxt in ".,;!?)"),
        float(bool(_HINTS[kind].search(before))),
        float(len(_digits(before[-10:]))),
        float(len(_digits(after))),
        float(len(own.rsplit(".", 1)[-1])) if kind == 0 else 0.0,
        float(bool(_SENTENCE_END.search(own))),
        float(own.count(":")),
    ]


def _examples(text: str) -> Iterator[tuple[list[float], int]]:
    """Labelled rows of a document: base spans, failed ones, and rewritten forms of either."""
    for span, good in matches(text):
        kind, s, e = span
        yield features(text, span), int(good)
        own = text[s:e]
        if kind == 0:
            forms = [own.replace("@", " (at) "), own.replace("@", " [at] ").replace(".", " [dot] "), own.replace("@", " at "), own.replace("@", " @ "), own.replace("@", " AT ").replace(".", " DOT ")]
        elif kind == 2:
            d = _digits(own)
            forms = [".".join(d[i : i + 4] for i in range(0, len(d), 4))]
        elif kind == 3:
            d = _digits(own)[-10:]
            forms = [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}"] if len(d) == 10 else []
        else:
            a, b, c, d = (int(p[-3:]) for p in own.split("."))
            forms = [f"2001:db8::{a << 8 | b:x}:{c << 8 | d:x}", f"fe80::{a:x}:{b:x}:{c:x}:{d:x}", f"2001:db8:{a:x}:{b:x}:0:0:{c:x}:{d:x}"] if good else []
        for form in forms:
            yield features(text[max(0, s - 60) : s] + form + text[e : e + 20], (kind, min(s, 60), min(s, 60) + len(form))), int(good)
        if kind == 0:  # the same words at the end of a sentence are not an address
            form = own.replace("@", " at ").replace(".", ". ")
            yield features(text[max(0, s - 60) : s] + form + text[e : e + 20], (kind, min(s, 60), min(s, 60) + len(form))), 0
        if kind == 1 and good:  # nor are marks of scope and times of day
            for form in ("::", f"{a % 16:x}::{b % 16:x}", f"{c % 24:02}::{d % 60:02}"):
                yield features(text[max(0, s - 60) : s] + form + text[e : e + 20], (kind, min(s, 60), min(s, 60) + len(form))), 0
        if kind == 3 and good:  # numbers of other lengths in the same place are not telephone numbers
            d = _digits(own)
            for form in (f"{d[:2]}.{d[2:5]}.{d[5:8]}", d[:4] + "-" + d[4:8] + "-" + d[:4]):
                yield features(text[max(0, s - 60) : s] + form + text[e : e + 20], (kind, min(s, 60), min(s, 60) + len(form))), 0


#: What every match of a fixed pattern has in it, in Java's syntax.
_SOME = r"@[A-Za-z0-9-]|\+[0-9]|[0-9]\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){7}"


def train(docs: DataFrame, sample: int = SAMPLE) -> Boosted:
    """Fit on at most about `sample` different texts of `docs` (text) that hold anything like personal data, chosen by a hash, and at
    most 4 x `sample` rows of them. Rows of one text are all learnt from or all kept for calibration."""
    width = len(features("", (0, 0, 0)))
    key = F.xxhash64("text")
    likely = docs.select("text").filter(F.col("text").rlike(_SOME))
    n = likely.agg(F.approx_count_distinct(key, 0.02)).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *r) for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True) for r in _examples(x.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["k", "label", "x"])

    # 62 bits, so that the smallest share of the largest corpus is not rounded to none
    chosen = likely.select(key.alias("k"), "text").filter(F.pmod("k", F.lit(1 << 62)) < int(min(1.0, sample / max(1, n)) * (1 << 62)))
    rows = chosen.dropDuplicates(["k"]).mapInArrow(run, "k long, label int, x array<double>")
    found = rows.orderBy(F.xxhash64("x"), "label", "k").limit(4 * sample).toArrow()
    if not found.num_rows:
        return Boosted()
    x = np.array(found.column("x").to_pylist()).reshape(-1, width)
    return fit(x, found.column("label").to_numpy(), found.column("k").to_numpy() % 3 == 2)


def select(text: str, model: Boosted) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the spans that the model adds; by kind, then start. A match that fails its kind's check is no candidate
    of any kind; a wider generator may still propose the same place."""
    base = [span for span, good in matches(text) if good]
    tried = list(wider(text))
    chosen, taken = list(base), Taken()
    for _, s, e in base:
        taken.add(s, e)
    if tried and model.threshold <= 1:
        p = model.probability(np.array([features(text, s) for s in tried]))
        for k in np.argsort(-p, kind="stable"):
            if p[k] < model.threshold:
                break
            if taken.free(*tried[k][1:]):
                chosen.append(tried[k])
                taken.add(*tried[k][1:])
    return sorted(base), sorted(chosen)


def spans_text(spans: list[Span], kinds=KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """doc_id, base and spans for every row of `docs` (doc_id, text): arrays of (kind, start, end), code points, end exclusive.

    `base` has the fixed patterns' spans, `spans` those and the model's; both by kind, then start. Null and
    empty texts have none, repeated rows the same ones. Without enough examples to learn from (an empty
    table, a corpus without such data) nothing is added to the base spans. Extra columns are not read.
    """
    model = model or train(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [select(x.as_py() or "", held.value) for x in b.column(1)]
            rows = [[[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in side] for side in pair] for pair in both]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)], ["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def redacted(text: str, model: Boosted) -> str:
    """The text with every selected span replaced by its kind in brackets."""
    out, at = [], 0
    for k, s, e in sorted(select(text, model)[1], key=lambda x: x[1:]):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
            at = e
    return "".join([*out, text[at:]])


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
