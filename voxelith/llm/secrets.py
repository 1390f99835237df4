"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what every match must contain.
The index lists, for each trigram that some query names, the documents whose lower-cased text has it; the
queries are answered by intersecting those postings with grouped counts. Only candidates are verified with
the rule; a rule without a mandatory trigram is run over every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as _c
from re import _parser as _p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.common import Taken, pieces, small, stored, text_buffers

#: Candidate rows at most that are broadcast; beyond that they are joined.
CANDIDATES_MAX = 1_000_000
#: Alternatives at most that a query spells out before it settles for what it has.
SPELLED_MAX = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the least length of a group (0: the match), and whether it is one of the base kinds."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost matches that do not overlap; those that are too short are dropped."""
        return [m.span() for m in re.finditer(self.pattern, text, re.ASCII) if m.end(self.group) - m.start(self.group) >= self.least]


#: Base kinds have fixed patterns. A run of 24 or more is the only match of [0-9a-f]+ that is not dropped.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]{24,}", 24, 0, True),
    Rule("private_key", r"-----BEGIN\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----"),
    Rule("code_host", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"\b[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("cloud_api", r"\bAIza[0-9A-Za-z_-]{35}"),
    # the second form takes a run that is no token as a whole, so that nothing is tried inside it again; its group 1 is empty and it is dropped
    Rule("web_token", r"\b(?:(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,})|eyJ[A-Za-z0-9_-]{8,}+)", 1, 1),
)


# ---- queries ----


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _strings(node) -> list[str] | None:
    """All strings that a part of a pattern can be, lower-cased, if they are few; else None."""
    op, arg = node
    if op is _c.LITERAL:
        return [chr(arg).lower()]
    if op is _c.IN:
        out = set()
        for kind, x in arg:
            if kind is _c.LITERAL:
                out.add(chr(x).lower())
            elif kind is _c.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return sorted(out) if len(out) <= 8 else None
    if op is _c.SUBPATTERN:
        return _all(list(arg[3]))
    if op is _c.BRANCH:
        sides = [_all(list(x)) for x in arg[1]]
        return None if any(s is None for s in sides) else sorted({x for s in sides for x in s})
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] <= 2:
        one = _all(list(arg[2]))
        return None if one is None else sorted({"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)})
    if op is _c.AT:
        return [""]
    return None


def _all(nodes: list) -> list[str] | None:
    out = [""]
    for node in nodes:
        s = _strings(node)
        if s is None or len(out) * len(s) > SPELLED_MAX:
            return None
        out = [a + b for a in out for b in s]
    return out


def query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of clauses, each an OR of trigram sets of which one must occur whole. Empty: nothing is mandatory."""
    clauses: list[list[frozenset[str]]] = []

    def settle(held: list[str]) -> None:
        sets = {_grams(x) for x in held}
        if sets and all(sets):
            clauses.append(sorted(sets, key=sorted))

    def walk(nodes: list) -> None:
        held = [""]
        for node in nodes:
            s = _strings(node)
            if s is not None and len(held) * len(s) <= SPELLED_MAX:
                held = [a + b for a in held for b in s]
                continue
            settle(held)
            held = s if s is not None else [""]
            op, arg = node
            if op is _c.SUBPATTERN:
                walk(list(arg[3]))
            elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] >= 1:
                walk(list(arg[2]))
        settle(held)

    walk(list(_p.parse(pattern)))
    return clauses


# ---- index ----


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(doc_id, text_key, gram): one row for each document and each of `grams` (positions in the list) in its lower-cased text."""
    codes = [int.from_bytes(g.encode(), "big") for g in grams]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.zeros(1 << 24, np.uint16)
        slot[codes] = np.arange(1, len(codes) + 1)
        lower = np.arange(256, dtype=np.uint32)
        lower[65:91] += 32
        for b in batches:
            rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in pieces(b.column(2)):
                data, offsets = text_buffers(b.column(2)[i:j])
                for lo in range(0, max(0, len(data) - 2), 1 << 20):
                    x = lower[data[lo : lo + (1 << 20) + 2]]
                    hit = slot[x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
                    at = np.flatnonzero(hit)
                    doc = np.searchsorted(offsets, at + lo, side="right") - 1
                    inside = at + lo + 3 <= offsets[doc + 1]
                    rows.append(i + doc[inside])
                    found.append(hit[at[inside]].astype(np.int64) - 1)
            both = np.unique(np.concatenate(rows) * 65536 + np.concatenate(found))
            doc = pa.array(both >> 16)
            yield pa.RecordBatch.from_arrays([b.column(0).take(doc), b.column(1).take(doc), pa.array((both & 65535).astype(np.int32))], ["doc_id", "text_key", "gram"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, gram int")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, text_key, rules): documents that answer the trigram query of some rule, with the rules' positions."""
    spark = docs.sparkSession
    terms, needs = [], []
    for r, rule in enumerate(rules):
        for c, clause in enumerate(query(rule.pattern)):
            for s, grams in enumerate(clause):
                terms += [(g, r, c, s, len(grams)) for g in sorted(grams)]
        needs.append((r, len(query(rule.pattern))))
    grams = sorted({t[0] for t in terms})
    at = {g: i for i, g in enumerate(grams)}
    term = F.broadcast(spark.createDataFrame([(at[g], r, c, s, n) for g, r, c, s, n in terms], "gram int, rule int, clause int, choice int, size int"))
    need = F.broadcast(spark.createDataFrame([x for x in needs if x[1]], "rule int, clauses int"))
    key = ["doc_id", "text_key"]
    whole = postings(docs, grams).join(term, "gram").groupBy(*key, "rule", "clause", "choice").agg(F.countDistinct("gram").alias("n"), F.first("size").alias("size")).filter("n = size")
    met = whole.groupBy(*key, "rule").agg(F.countDistinct("clause").alias("n")).join(need, "rule").filter("n = clauses")
    return met.groupBy(*key).agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans for every row of `docs` (doc_id, text): (kind, base, start, end) by start, then the rules' order; code points, end exclusive.

    Base kinds' spans all stay; a span of another kind that overlaps an earlier one in `rules` is left out.
    Null and empty texts have none; repeated rows have the same ones; extra columns are not read.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = stored(candidates(keyed, rules), "candidates")
    found = small(found.withColumnsRenamed({"doc_id": "c_id", "text_key": "c_key"}), CANDIDATES_MAX)
    both = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")), "left").select("doc_id", "text", "rules")
    full = [r for r, rule in enumerate(rules) if not query(rule.pattern)]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                spans: list[tuple[int, int, int]] = []
                taken = Taken()
                for r in sorted({*full, *(own or ())}) if x else ():
                    for s, e in rules[r].spans(x):
                        if rules[r].base or taken.free(s, e):
                            spans.append((s, r, e))
                            taken.add(s, e)
                out.append([{"kind": rules[r].kind, "base": rules[r].base, "start": s, "end": e} for s, r, e in sorted(spans)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return both.mapInArrow(run, "doc_id long, spans array<struct<kind:string,base:boolean,start:bigint,end:bigint>>")
