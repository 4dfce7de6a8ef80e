"""Toxicity: cumulative-link ordinal regression on sparse word features.

P(grade <= k) = logistic(threshold_k - w . x): one weight vector for all ordered thresholds,
which are kept in order by construction (each is the one before plus a positive step).
x holds log(1 + count) of each word. The result is the expected grade.

The labels are 0 and 1, so the grades of training rows are made from these rows: the rows
are cut into two halves; words' smoothed log odds of the label are estimated on one half
and each labelled row of the other half gets the mean evidence of its words. Rows with
label 1 above the median of these are grade 2, the others grade 1; label 0 is grade 0.
No list of words enters.

Training rows: labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most
``max_rows`` (20,000; those of the lowest hash of doc_id). All rows are scored.

Defined cases: a null or empty text has the severity of no features; with no training rows,
or one class only, all severities are 0; of repeated labels the lowest counts; repeated rows
are rows of their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_hashes
from .quality import held_out

MAX_ROWS, MIN_ROWS, GRADES, PENALTY, STEPS = 20_000, 5, 3, 3e-4, 300


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words and their counts."""
    return np.unique(word_hashes((text or "").encode("utf-8", "surrogatepass"), True, letters=True), return_counts=True)


@dataclass(frozen=True)
class Ordinal:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - linear[:, None]))

    def linear(self, text: str | None) -> float:
        if not len(self.words):
            return 0.0
        h = word_hashes((text or "").encode("utf-8", "surrogatepass"), True, letters=True)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        counts = np.bincount(at[self.words[at] == h], minlength=len(self.words))
        return float(np.log1p(counts) @ self.weights)


def _evidence(row: np.ndarray, col: np.ndarray, count: np.ndarray, y: np.ndarray, half: np.ndarray, n_col: int) -> np.ndarray:
    """Mean log odds of each row's words, estimated on the other half's rows."""
    out = np.zeros(len(y))
    for side in (0, 1):
        other = half[row] != side
        ones = np.bincount(col[other], y[row[other]], n_col)
        seen = np.bincount(col[other], minlength=n_col)
        base = max(y[half != side].mean(), 1e-3)
        odds = np.log((ones + 2 * base) / (seen - ones + 2 * (1 - base)) * (1 - base) / base)
        odds = np.where(np.abs(odds) > 1, odds, 0)  # words that tell nothing shouldn't dilute long texts' evidence
        total = np.bincount(row, count * np.maximum(odds[col], 0), len(y)) / np.maximum(np.bincount(row, count, len(y)), 1)
        out[half == side] = total[half == side]
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Ordinal:
    none = Ordinal(np.empty(0, np.uint64), np.empty(0), np.full(GRADES - 1, np.inf))
    if len(y) < 4 or y.min() == y.max():
        return none
    row = np.repeat(np.arange(len(rows)), [len(h) for h, _ in rows])
    words, col = np.unique(np.concatenate([h for h, _ in rows]), return_inverse=True)
    count = np.concatenate([c for _, c in rows]).astype(np.float64)
    half = np.arange(len(y)) % 2
    evidence = _evidence(row, col, count, y, half, len(words))
    grade = np.where(y == 0, 0, np.where(evidence > np.median(evidence[y == 1]), 2, 1))
    if len(np.unique(grade)) < GRADES:
        grade = np.where(y == 0, 0, 1 + np.arange(len(y)) % 2)  # evidence doesn't tell them apart
    often = np.bincount(col, minlength=len(words)) >= MIN_ROWS
    use = often[col]
    index = np.cumsum(often) - 1
    row, col, value = row[use], index[col[use]], np.log1p(count[use])
    words = words[often]
    w = np.zeros(len(words))
    share = np.array([(grade > k).mean() for k in range(GRADES - 1)])
    theta = -np.log(share / (1 - share))
    b, d = theta[0], np.log(np.maximum(np.diff(theta), 1e-3))  # thresholds: b, b + e^d, ...
    # diagonal preconditioning: a word of many rows has a steeper loss
    scale = np.bincount(col, value**2, len(words)) / len(y) + 1e-3
    z, last, t = w.copy(), w.copy(), 1.0
    for _ in range(STEPS):
        s = np.bincount(row, value * z[col], len(y))
        steps = np.exp(d)
        theta = b + np.concatenate(([0], np.cumsum(steps)))
        upper = np.concatenate((theta, [np.inf]))[grade]
        lower = np.concatenate(([-np.inf], theta))[grade]
        fu, fl = 1 / (1 + np.exp(-(upper - s))), 1 / (1 + np.exp(-(lower - s)))
        p = np.maximum(fu - fl, 1e-12)
        du, dl = fu * (1 - fu) / p, fl * (1 - fl) / p  # d log p / d upper, - d log p / d lower
        g_s = du - dl  # d loss / d s
        g_theta = np.array([(-(du * (grade == k)) + dl * (grade == k + 1)).mean() for k in range(GRADES - 1)])
        step = 0.5 / scale
        new = z - step * np.bincount(col, value * g_s[row], len(words)) / len(y)
        w = np.sign(new) * np.maximum(0, np.abs(new) - step * PENALTY)
        b -= 1.0 * g_theta.sum()
        d -= 1.0 * np.array([g_theta[k + 1 :].sum() for k in range(GRADES - 2)]) * steps
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, last, t = w + min(0.9, (t - 1) / u) * (w - last), w, u
    keep = np.abs(w) > 1e-6
    return Ordinal(words[keep], w[keep], b + np.concatenate(([0], np.cumsum(np.exp(d)))))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(x.as_py()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_label"), pa.array([h.view(np.int64) for h, _ in made], pa.list_(pa.int64())), pa.array([c for _, c in made], pa.list_(pa.int64()))],
            ["doc_id", "_label", "words", "counts"],
        )


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_rows: int = MAX_ROWS) -> Ordinal:
    own = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(target).cast("int").alias("_label"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows rows of two numbers are broadcast
    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(_featured, f"doc_id {kind}, _label int, words array<long>, counts array<long>").toArrow()
    order = np.lexsort((np.array([len(x) for x in found.column("words")]), found.column("doc_id").to_numpy()))
    rows = []
    for i in order:
        rows.append((found.column("words")[int(i)].values.to_numpy().view(np.uint64), found.column("counts")[int(i)].values.to_numpy()))
    return fit(rows, (found.column("_label").to_numpy()[order] > 0).astype(np.float64))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, severity (0 to 2), p_toxic (grade 1 or more), p_severe (grade 2), grade, toxic."""
    model = train(docs, labels, max_rows=max_rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.grades(np.array([model.linear(x.as_py()) for x in batch.column("text")], np.float64))
            severity = p.sum(axis=1)
            grade = (p >= 0.5).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(severity), pa.array(p[:, 0]), pa.array(p[:, -1]), pa.array(grade), pa.array((grade > 0).astype(np.int32))], ["doc_id", "severity", "p_toxic", "p_severe", "grade", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {dict(docs.dtypes)['doc_id']}, severity double, p_toxic double, p_severe double, grade int, toxic int")
