"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of each text (byte classes, word repeats, lengths) are computed once in Arrow batches and stored
as a narrow table. Class means and covariances are plain Spark sums over all labelled training rows; only
those sums, whose size depends on the number of features alone, reach the driver. Covariances shrink
towards the pooled covariance and its diagonal; scores are differences of Gaussian log densities from
cached inverse Cholesky factors, evaluated as column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.common import drop_stored, pieces, stored, text_buffers, word_hashes

FEATURES = ("log_words", "log_word_bytes", "inner_upper", "symbols", "same_as_previous", "repeated_words", "digits", "punctuation", "log_line_bytes")
#: Shares of the pooled covariance and of its diagonal in each class's covariance; the floor of a variance.
TO_POOLED, TO_DIAGONAL, FLOOR = 0.2, 0.1, 1e-5


def _members(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL = _members("#$%&*|!<>{}[]~^\\=_+@`")
_PUNCTUATION = _members(".,;:'\"-()/?")
_DIGIT = _members("0123456789")
_UPPER = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SPACE = _members(" \t\n\r\x0b\x0c")
_LETTER = _UPPER | _members("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; null counts as empty."""
    out = []
    for i, j in pieces(texts):
        data, offsets = text_buffers(texts[i:j])
        words, at = word_hashes(data, offsets, lower=False)
        n = j - i
        counts = np.zeros((n, 256))
        inner = np.zeros(n)
        for r in range(n):
            for lo in range(offsets[r], offsets[r + 1], 1 << 20):
                part = data[lo : min(lo + (1 << 20), offsets[r + 1])]
                counts[r] += np.bincount(part, minlength=256)
                inner[r] += np.count_nonzero(_UPPER[part[1:]] & _LETTER[part[:-1]])
        same = np.concatenate([[0], np.cumsum(words[1:] == words[:-1])]) if len(words) else np.zeros(1)
        first, last = at[:-1], np.maximum(at[1:] - 1, at[:-1])
        repeats = np.where(at[1:] > at[:-1], same[np.minimum(last, len(same) - 1)] - same[np.minimum(first, len(same) - 1)], 0)
        distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], float)
        size, n_words = counts.sum(1), (at[1:] - at[:-1]).astype(float)
        share = lambda mask, total, k: np.sqrt(counts[:, mask].sum(1) / (total + k))
        out.append(
            np.column_stack(
                [
                    np.log1p(n_words),
                    np.log1p(counts[:, ~_SPACE].sum(1) / np.maximum(n_words, 1)),
                    np.sqrt(inner / (counts[:, _LETTER].sum(1) + 10)),
                    share(_SYMBOL, size, 10),
                    np.maximum(repeats - 1, 0) / (n_words + 20),
                    (n_words - distinct) / (n_words + 20),
                    share(_DIGIT, size, 10),
                    share(_PUNCTUATION, size, 10),
                    np.log1p(size / (counts[:, 10] + 1)),
                ]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def document_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` of `docs` and one double for each of FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x[:, k]) for k in range(len(FEATURES)))], [*keep, *FEATURES])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), *(f"{f} double" for f in FEATURES)])
    return docs.select(*keep, text_col).mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log terms of the two classes; `constant` replaces the score where a class has no rows."""

    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray
    constant: float | None = None

    def log_odds(self) -> Column:
        """log p(1|x) - log p(0|x) as a column over FEATURES."""
        sides = []
        for c in (0, 1):
            centred = [F.col(f) - float(m) for f, m in zip(FEATURES, self.means[c], strict=True)]
            total = F.lit(float(self.logs[c]))
            for i in range(len(FEATURES)):
                z = sum((centred[j] * float(self.factors[c][i][j]) for j in range(1, i + 1)), centred[0] * float(self.factors[c][i][0]))
                total = total - 0.5 * F.pow(z, 2)
            sides.append(total)
        return sides[1] - sides[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """score() of rows of FEATURES, for tasks."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        sides = [self.logs[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(1) for c in (0, 1)]
        z = sides[1] - sides[0]
        return 1 / (1 + np.exp(-z / (1 + np.abs(z) / 30)))

    def score(self) -> Column:
        """The log odds, bent so that far values stay apart in double precision, as a probability."""
        if self.constant is not None:
            return F.lit(self.constant)
        z = self.log_odds()
        return 1 / (1 + F.exp(-z / (1 + F.abs(z) / 30)))


def fit(stats: DataFrame, label_col: str = "label") -> Discriminant:
    """Fit on all rows of `stats` whose label is 0 or 1. Two aggregations, of one and two rows: the overall means, and sums of what
    lies around them, so that sums of very many rows keep their digits."""
    d = len(FEATURES)
    known = stored(stats.filter(F.col(label_col).isin(0, 1)).select(label_col, *FEATURES), "labelled-stats")
    middle = [x or 0.0 for x in known.agg(*(F.avg(f) for f in FEATURES)).first()]
    apart = [F.col(f) - m for f, m in zip(FEATURES, middle, strict=True)]
    terms = [F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(apart))]
    terms += [F.sum(apart[i] * apart[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    rows = {r[label_col]: r for r in known.groupBy(label_col).agg(*terms).collect()}
    drop_stored(known)
    n = np.array([rows[c]["n"] if c in rows else 0 for c in (0, 1)], float)
    if min(n) < 2:
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), float((n[1] + 1) / (n.sum() + 2)))
    means, covs = np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        means[c] = [rows[c][f"s{i}"] / n[c] for i in range(d)]
        for i in range(d):
            for j in range(i + 1):
                covs[c, i, j] = covs[c, j, i] = rows[c][f"p{i}_{j}"] / n[c] - means[c, i] * means[c, j]
        means[c] += middle
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    factors, logs = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        weight = TO_POOLED * min(1.0, 1000 / n[c])
        cov = (1 - weight - TO_DIAGONAL) * covs[c] + weight * pooled + TO_DIAGONAL * np.diag(np.diag(covs[c]))
        chol = np.linalg.cholesky(cov + np.eye(d) * FLOOR)
        factors[c] = np.linalg.inv(chol)
        logs[c] = np.log(n[c] / n.sum()) - np.log(np.diag(chol)).sum()
    return Discriminant(means, factors, logs)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id's text leaves 2 when divided by 4. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _fitted(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Discriminant]:
    stats = document_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"), ["doc_id", "text_key"])
    stats = stored(stats, "quality-stats")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("label"))
    return stats, fit(stats.filter(~held_out(F.col("doc_id"))).join(known, "doc_id"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text).

    Labels (doc_id, quality) are learnt from rows that held_out() leaves in; several labels of one id count
    as their rounded mean, null ids or labels are ignored. Null and empty texts get the score of an empty
    text; repeated rows are scored alike. Without labels of both classes, the score is the share of label 1
    (smoothed). An empty table gives an empty result. Extra columns are not read.
    """
    stats, model = _fitted(docs, labels)
    score = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().cast("double").alias("score"))
    return score.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` whose score reaches `threshold`, with all their columns. Texts are scored where they are read, so none is
    shuffled. Equal texts have equal scores; null ids are no reason to reject."""
    stats, model = _fitted(docs, labels)
    drop_stored(stats)
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.scores(statistics(b.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
