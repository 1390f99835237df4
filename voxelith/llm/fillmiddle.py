"""Fill-in-the-middle forms of whole texts.

A text is cut into units (lines with their line feed). Two cuts drawn from a hash of the document's id divide the units into
prefix, middle and suffix, and the three are joined behind sentinels. The work on units is a chain of Arrow kernels over a batch:
split into lists of units, flatten beside the parents' indices, number the units of each parent, keep those of one role, make lists
of them again, join each list, and join the pieces with their sentinels. No Python loop runs over texts or units.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.common import pieces


@dataclass(frozen=True)
class Rule:
    """How texts are cut: `seed` goes into the hash, `rate` of 100 texts are rearranged, `spm` of 100 of those begin with the suffix."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or not all(marks):
            raise ValueError("three different sentinels, none empty, are needed")
        for a in marks:
            for b in marks:
                if (a != b and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                    raise ValueError("sentinels must not overlap, or a text could not be told from its marks")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from sha256 of seed:id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All units of the texts one after another, each one's parent, and the units before each text (and in all)."""
    lists = pc.split_pattern(texts, "\n")
    flat, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    last = np.append(parent[1:] != parent[:-1], True) if len(parent) else np.zeros(0, bool)
    flat = pc.binary_join_element_wise(flat, pc.if_else(pa.array(last), "", "\n").cast(flat.type), pa.scalar("", flat.type))
    real = pc.greater(pc.binary_length(flat), 0)  # what follows a text's last line feed, if that is nothing, is no unit
    flat, parent = flat.filter(real), parent[real.to_numpy(zero_copy_only=False)]
    return flat, parent, np.searchsorted(parent, np.arange(len(texts) + 1))


def _joined(flat: pa.Array, parent: np.ndarray, keep: np.ndarray, n: int) -> pa.Array:
    """For each of n parents, its kept units as one string."""
    offsets = np.searchsorted(parent[keep], np.arange(n + 1))
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), flat.filter(pa.array(keep)))
    return pc.binary_join(lists, pa.scalar("", flat.type))


def arrange(texts: pa.Array, draw: list[np.ndarray], rule: Rule) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a batch of texts without nulls (large_string)."""
    flat, parent, at = _units(texts)
    size = len(texts)
    n = np.diff(at)
    ordinal = np.arange(len(parent)) - at[:-1][parent]
    cuts = np.stack([draw[0] % (n + 1), draw[1] % (n + 1)])
    low, high = cuts.min(0), cuts.max(0)
    role = (ordinal >= low[parent]).astype(int) + (ordinal >= high[parent])
    prefix, middle, suffix = (_joined(flat, parent, role == r, size) for r in range(3))
    marked = [pc.match_substring(texts, m) for m in (rule.prefix, rule.suffix, rule.middle)]
    plain = pc.or_(pc.or_(marked[0], marked[1]), pc.or_(marked[2], pc.equal(pc.binary_length(texts), 0)))
    plain = pc.or_(plain, pa.array(draw[2] % 100 >= rule.rate))
    spm = pa.array(draw[3] % 100 < rule.spm)
    kind = texts.type
    p, s, m, none = (pa.scalar(x, kind) for x in (rule.prefix, rule.suffix, rule.middle, ""))
    suffix_first = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    prefix_first = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    chars = lambda x: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64()))
    return {
        "n": pa.array(n, pa.int64()),
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_chars": chars(prefix),
        "middle_chars": chars(middle),
        "output": pc.if_else(plain, texts, pc.if_else(spm, suffix_first, prefix_first)),
    }


def transform(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each row of `docs` (doc_id, text; other columns are ignored).

    A null text is an empty one. Empty texts and texts that hold a sentinel stay plain: the output is the text and the lengths are
    null. Repeated ids are cut alike; equal rows give equal rows; no rows give none. Texts are never cut short: a batch is worked
    through in pieces of some 2 MB, or one text if that is longer, so memory is a few times the longest text. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b["text"]):
                part = b.slice(i, j - i)
                made = arrange(part["text"].cast(pa.large_string()).fill_null(""), [part[f"h{k}"].to_numpy() for k in range(1, 5)], rule)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], **{k: v.cast(pa.string()) if pa.types.is_large_string(v.type) else v for k, v in made.items()}})

    rows = docs.select("doc_id", "text", *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), rule.seed), 1)))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text that transform() made `output` of, from output and form alone."""
    body = F.substring(output, len(rule.prefix) + 1, 2**31 - 1)
    other = F.substring(output, len(rule.suffix) + 1, 2**31 - 1)
    before = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring_index(c, mark, -1)
    psm = F.concat(before(body, rule.suffix), after(output, rule.middle), before(after(output, rule.suffix), rule.middle))
    spm = F.concat(before(after(output, rule.prefix), rule.middle), after(output, rule.middle), before(other, rule.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
