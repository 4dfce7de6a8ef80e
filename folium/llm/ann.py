"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation.

Smallest Euclidean distance is largest inner product q . x - |x|^2 / 2, so vectors are
quantised for inner products and the exact -|x|^2 / 2 stands beside the code as one more
coordinate, for which a query has 1. The codebooks (16 words for each pair of dimensions,
so 4-bit codes) minimise, over a bounded sample, orth * |orthogonal residual|^2 + par * |parallel
residual|^2 with par > orth: errors along a vector hurt its large scores most. Codes are
assigned by coordinate descent on that loss, codebooks by its normal equations.

Vectors are centred on the sample's mean before that; distances don't change by it.

Every row is indexed: codes are packed two to a byte, in blocks of rows beside the original
vectors, |x|^2, |code|^2 and the length of the residual x - code. A scan adds table entries
of 256 values (two codes) for each byte. By the triangle inequality no row is nearer than
its code's distance less its residual, so every row whose bound is not above the k-th
smallest exact distance so far is compared exactly, on the original vectors in double
precision, the ``rerank`` best by score first. What is found is thus exact on any rows; the
codes decide only how many rows are compared. Where they say nothing all of them are, in
the memory of one block.

Defined cases: vectors null, zero, with null or non-finite components, or of another length
than most of the sample take no part; null ids neither; equal rows count once; ties go to
the smaller id; with fewer candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import working_folder, written

SAMPLE, WORDS, PARALLEL, ROUNDS = 8192, 16, 4.0, 6
BLOCK_BYTES, QUERIES, RERANK = 4 << 20, 2048, 300
#: What rounding may add to distances and to squares, as a share of the lengths involved.
SLACK, SLACK_SQUARED = 1e-12, 1e-11


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the rows that take part, repeats among them."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine)


def _units(x: np.ndarray) -> np.ndarray:
    """Directions; of a zero vector zero."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def assign(x: np.ndarray, books: np.ndarray, parallel: float, sweeps: int = 2) -> np.ndarray:
    """Codes (rows by subspaces) by coordinate descent on the anisotropic loss."""
    m, _, d = books.shape
    u = _units(x)
    xs, us = x.reshape(len(x), m, d), u.reshape(len(x), m, d)
    square = ((xs[:, :, None, :] - books[None]) ** 2).sum(-1)  # each subspace's |residual|^2 by word
    along = ((xs[:, :, None, :] - books[None]) * us[:, :, None, :]).sum(-1)  # its part along the vector
    codes = square.argmin(-1)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            loss = square[:, j] + (parallel - 1) * (rest[:, None] + along[:, j]) ** 2
            codes[:, j] = loss.argmin(1)
            total = rest + along[rows, j, codes[:, j]]
    return codes


def fit(x: np.ndarray, parallel: float = PARALLEL, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Codebooks, subspaces by words by dimensions; an odd last dimension is padded by the caller."""
    n, dim = x.shape
    d = 2
    m = dim // d
    rng = np.random.default_rng(seed)
    start = x[rng.integers(0, n, WORDS)] + 1e-3 * rng.standard_normal((WORDS, dim)) * x.std()
    books = start.reshape(WORDS, m, d).transpose(1, 0, 2).copy()
    u = _units(x)
    for r in range(rounds + 6):
        weight = 1.0 if r < 6 else parallel  # plain rounds first
        codes = assign(x, books, weight, 1)
        flat = codes + np.arange(m)[None, :] * WORDS
        if weight == 1.0:
            for k in range(d):
                sums = np.bincount(flat.ravel(), x.reshape(n, m, d)[:, :, k].ravel(), m * WORDS)
                counts = np.bincount(flat.ravel(), minlength=m * WORDS)
                books[:, :, k] = np.where(counts > 0, sums / np.maximum(counts, 1), books[:, :, k].ravel()).reshape(m, WORDS)
            continue
        # normal equations of sum |x - Cb|^2 + (parallel - 1) (u . (x - Cb))^2 over all codewords at once
        size = m * WORDS * d
        g = np.zeros((n, size))
        columns = flat[:, :, None] * d + np.arange(d)
        np.put_along_axis(g, columns.reshape(n, -1), u, 1)
        diagonal = np.bincount(columns.ravel(), minlength=size).astype(float)
        left = np.diag(diagonal + 1e-3) + (weight - 1) * (g.T @ g)
        right = np.bincount(columns.ravel(), x.ravel(), size) + 1e-3 * books.reshape(-1) + (weight - 1) * (g.T @ (u * x).sum(1))
        books = np.linalg.solve(left, right).reshape(m, WORDS, d)
    return books


def pack(codes: np.ndarray) -> np.ndarray:
    """Two 4-bit codes a byte; an odd number of subspaces is filled up with code 0."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)


def scan(q: np.ndarray, books: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """-2 q . code of each row of a block; packed is bytes by rows."""
    tables = -2 * (books * q.reshape(len(books), 1, -1)).sum(-1)
    if len(tables) % 2:
        tables = np.pad(tables, ((0, 1), (0, 0)))
    pairs = (tables[1::2, :, None] + tables[::2, None, :]).reshape(len(tables) // 2, 256)
    out = np.zeros(packed.shape[1])
    for table, column in zip(pairs, packed, strict=True):
        out += table[column]
    return out


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, 1))) if x.shape[1] % 2 else x


def _coded(books: np.ndarray, centre: np.ndarray, dim: int):
    every = max(1, BLOCK_BYTES // (8 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def block(ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            x = _even(v - centre)
            codes = np.concatenate([assign(x[i : i + 4096], books, PARALLEL) for i in range(0, len(x), 4096)])
            back = books[np.arange(len(books))[None, :], codes].reshape(x.shape)
            xx = (x**2).sum(1)
            bounds = np.stack([xx, (back**2).sum(1), np.sqrt(((x - back) ** 2).sum(1)) * (1 + SLACK) + np.sqrt(xx) * SLACK])
            packed = np.ascontiguousarray(pack(codes).T)
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()]) for a in (ids.astype(np.int64), packed, bounds, v)], ["ids", "codes", "bounds", "vectors"])

        for batch in batches:
            ids, v = batch.column("vec_id").to_numpy(), batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            at = 0
            while at < len(ids):
                upto = at + every - n
                parts.append((ids[at:upto], v[at:upto]))
                n += len(parts[-1][0])
                at = upto
                if n == every:
                    yield block(*map(np.concatenate, zip(*parts, strict=True)))
                    parts, n = [], 0
        if n:
            yield block(*map(np.concatenate, zip(*parts, strict=True)))

    return run


def _compared(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact distances, squares added from the first component to the last."""
    return np.sqrt(np.cumsum((vectors - q) ** 2, axis=1)[:, -1])


class _Best:
    """The k nearest rows so far of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.centred = _even(vectors - centre)
        self.found = [np.empty(0, np.int64)] * len(ids)
        self.score = [np.empty(0)] * len(ids)
        self.limit = np.full(len(ids), np.inf)

    def add(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        near = score <= self.limit[i]
        ids, score = np.concatenate([self.found[i], ids[near]]), np.concatenate([self.score[i], score[near]])
        if len(score) > self.k:
            near = score <= np.partition(score, self.k - 1)[self.k - 1]
            ids, score = ids[near], score[near]
        first = np.lexsort((ids, score))[: self.k]
        self.found[i], self.score[i] = ids[first], score[first]
        if len(first) == self.k:
            self.limit[i] = score[first[-1]]

    def rows(self) -> pa.RecordBatch:
        n = list(map(len, self.found))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate(self.found)), pa.array(np.concatenate(self.score))], ["query_id", "vec_id", "score"])


def _scanned(books: np.ndarray, centre: np.ndarray, dim: int, k: int, rerank: int):
    def search(best: _Best, i: int, ids: np.ndarray, packed: np.ndarray, bounds: np.ndarray, vectors: np.ndarray) -> None:
        q = best.centred[i]
        square = (q**2).sum()
        dots = scan(q, books, packed)
        coded = dots + bounds[1]
        coded += square
        coded -= SLACK_SQUARED * (square + bounds[1])
        least = np.sqrt(np.maximum(coded, 0))
        least -= bounds[2] + np.sqrt(square) * SLACK
        open_ = np.flatnonzero(~(least * (1 - SLACK) > best.limit[i]) & (ids != best.ids[i]))
        if len(open_) > rerank:
            order = np.argpartition(dots[open_] + bounds[0][open_], rerank)
            first, open_ = open_[order[:rerank]], open_[order[rerank:]]
            best.add(i, ids[first], _compared(best.vectors[i], vectors[first]))
            open_ = open_[~(least[open_] * (1 - SLACK) > best.limit[i])]
        if len(open_):
            best.add(i, ids[open_], _compared(best.vectors[i], vectors[open_]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests: dict[bytes, _Best] = {}
        for batch in batches:
            for r in range(len(batch)):
                ids, packed, bounds, vectors = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("ids", np.int64), ("codes", np.uint8), ("bounds", np.float64), ("vectors", np.float64)))
                key = batch.column("queries")[r].as_py()
                if key not in bests:
                    bests[key] = _Best(np.frombuffer(batch.column("qids")[r].as_py(), np.int64), np.frombuffer(key, np.float64).reshape(-1, dim), centre, k)
                for i in range(len(bests[key].ids)):
                    search(bests[key], i, ids, packed.reshape(-1, len(ids)), bounds.reshape(3, -1), vectors.reshape(-1, dim))
        for best in bests.values():
            yield best.rows()

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries: ids and vectors as bytes."""
    ids, vectors, n = [], [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).astype(np.int64).tobytes()]), pa.array([np.concatenate(vectors).astype(np.float64).tobytes()])], ["qids", "queries"])

    for batch in batches:
        for i in range(0, len(batch), QUERIES):
            part = batch.slice(i, QUERIES)
            ids.append(part.column("vec_id").to_numpy())
            vectors.append(part.column("v").flatten().to_numpy(zero_copy_only=False))
            n += len(part)
            if n >= QUERIES:
                yield block()
                ids, vectors, n = [], [], 0
    if n:
        yield block()


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, rerank: int = RERANK, sample: int = SAMPLE, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    folder = working_folder(spark)
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = written(usable(vectors, column).repartition(parts, "vec_id").dropDuplicates(["vec_id", "v"]), folder, "vectors")
    learned = [np.array(r["v"]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()]
    if not learned:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = Counter(map(len, learned)).most_common(1)[0][0]
    learned = np.stack([x for x in learned if len(x) == dim])
    centre = learned.mean(0)
    books = fit(_even(learned - centre))
    rows = rows.filter(F.size("v") == dim)
    index = written(rows.mapInArrow(_coded(books, centre, dim), "ids binary, codes binary, bounds binary, vectors binary"), folder, "index")
    queries = rows.filter(F.col("vec_id") % every == 0)
    # the stated query set, in blocks, against all blocks of codes: each pair of blocks is one unit of work
    few = max(1, math.ceil(queries.count() / QUERIES))
    blocks = written(queries.repartition(few).mapInArrow(_gathered, "qids binary, queries binary"), folder, "queries")
    found = index.crossJoin(blocks).mapInArrow(_scanned(books, centre, dim, k, rerank), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
