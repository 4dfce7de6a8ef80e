"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on resamples of labelled rows; each path from a root is a
conjunction of threshold conditions. A logistic model with an L1 penalty weighs the rules,
most of which get no weight, and what is left is compiled into one Spark column expression,
so that scoring is a projection without Python.

Training rows: labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most
``max_rows`` of them (those of the lowest hash of doc_id; 20,000 by default). Statistics
read the text alone, never labels, lang, source or doc_id.

Defined cases: a null text counts as empty, and an empty text has all statistics 0 and the
score that the rules give to these; with no training rows all scores are 0.5, with one
class only its share; of repeated labels of a document the lowest counts; repeated rows
are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS, TREES, DEPTH, BINS, PENALTY = 20_000, 24, 3, 24, 0.002
CUT = 0.3


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def statistics(text: Column) -> dict[str, Column]:
    """Names and expressions of a text's statistics; none is null."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(sign: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))) / n

    words = F.greatest(F.regexp_count(text, F.lit(r"[ \t\n\r\f]+")) + 1, F.lit(1)).cast("double")
    return {
        "log_length": F.log1p(F.length(text).cast("double")),
        "mean_word": F.length(text) / words,
        "capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / n,
        "letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / n,
        "digits": F.length(F.regexp_replace(text, r"[^0-9]+", "")) / n,
        "signs": F.length(F.regexp_replace(text, r"[^#$%&*@^~=<>_+/\\]+", "")) / n,
        "bars": share("|"),
        "bangs": share("!"),
        "lines": share("\n"),
        "stops": share(". "),
        "commas": share(","),
        "spaces": share(" "),
    }


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, is above, threshold), all of which must hold, and a weight."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self, values: dict[str, Column]) -> Column:
        hold = F.lit(True)
        for name, above, at in self.conditions:
            hold = hold & ((values[name] > at) if above else (values[name] <= at))
        return F.when(hold, self.weight).otherwise(0.0)


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[Rule, ...]

    def score(self, values: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + rule.column(values)
        return 1.0 / (1.0 + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, path: tuple, paths: set, rng: np.random.Generator) -> None:
    """Adds the paths of a tree over binned statistics x; conditions are (column, above, bin)."""
    if path:
        paths.add(tuple(sorted(path)))
    if depth == 0 or len(rows) < 20 or y[rows].min() == y[rows].max():
        return
    best, choice = 1e-9, None
    total, ones = len(rows), y[rows].sum()
    impurity = ones * (total - ones) / total
    for j in rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]:
        n = np.cumsum(np.bincount(x[rows, j], minlength=BINS))[:-1]
        p = np.cumsum(np.bincount(x[rows, j], y[rows], minlength=BINS))[:-1]
        ok = (n >= 5) & (total - n >= 5)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, impurity - p * (n - p) / n - (ones - p) * (total - n - ones + p) / (total - n), -1)
        k = int(gain.argmax())
        if gain[k] > best:
            best, choice = gain[k], (int(j), k)
    if choice is None:
        return
    j, k = choice
    above = x[rows, j] > k
    for side in (False, True):
        _grow(x, y, rows[above == side], depth - 1, (*path, (j, side, k)), paths, rng)


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient."""
    mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias, w = float(np.log(mean / (1 - mean))), np.zeros(a.shape[1])
    step = 4 * len(y) / (np.linalg.norm(a, 2) ** 2 + len(y))
    z, zb, t = w.copy(), bias, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(a @ z + zb))) - y
        new = z - step * (a.T @ g) / len(y)
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
        newb = zb - step * g.mean()
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / u * (new - w), newb + (t - 1) / u * (newb - bias)
        w, bias, t = new, newb, u
    return float(bias), w


def fit(names: list[str], x: np.ndarray, y: np.ndarray, seed: int = 7, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Model:
    if len(y) == 0:
        return Model(0.0, ())
    if y.min() == y.max():
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        return Model(float(np.log(mean / (1 - mean))), ())
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    paths: set = set()
    for _ in range(trees):
        _grow(binned, y, rng.integers(0, len(y), len(y)), depth, (), paths, rng)
    paths = sorted(paths)
    usable = [p for p in paths if all(k < len(edges[j]) for j, _, k in p)]
    a = np.stack([np.all([(binned[:, j] > k) == side for j, side, k in p], axis=0) for p in usable], axis=1).astype(np.float64) if usable else np.zeros((len(y), 0))
    if not a.shape[1]:
        return fit(names, x[:0], y[:0])
    bias, w = _lasso(a, y, penalty)
    rules = tuple(Rule(tuple((names[j], side, float(edges[j][k])) for j, side, k in p), float(v)) for p, v in zip(usable, w, strict=True) if abs(v) > 1e-6)
    return Model(bias, rules)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """The model of a bounded sample of labelled rows that are not held out."""
    own = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(target).alias("_label"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows rows of two numbers are broadcast
    values = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("_label", "doc_id", *(c.alias(n) for n, c in values.items())).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")  # whatever order the tasks end in
    return fit(list(values), rows[list(values)].to_numpy(np.float64), (rows["_label"] > 0).to_numpy(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The table with held_out, score and predicted."""
    model = train(docs, labels, max_rows=max_rows)
    values = statistics(F.col("text"))
    names = {n: f"_stat_{n}" for n in values}
    staged = docs.select("*", *(values[n].alias(a) for n, a in names.items()))
    scored = staged.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")), F.coalesce(held_out(), F.lit(False)).alias("held_out"), model.score({n: F.col(a) for n, a in names.items()}).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with the columns they had."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    # a filter would be pushed under the projection of the statistics and compute them again for each rule; a generator isn't
    kept = F.explode(F.when(F.col("predicted") == 1, F.array("row")))
    return score_quality(rows, labels).select(kept.alias("row")).select("row.*")
