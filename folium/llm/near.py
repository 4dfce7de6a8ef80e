"""MinHash near-dedup with b-bit signatures, exact links and connected components.

Documents of equal sets are one class first. Of each class's set, 128 minima give 32 bands
of 4 rows for candidates (a pair of similarity 0.8 shares no band with a probability of
5e-8) and, of each minimum, the low 4 bits for a packed signature of eight 64-bit words.
The share of equal 4-bit groups, found by XOR and bit counts and corrected for chance
collisions (1/16), estimates the similarity; only candidates below 0.58, six standard
errors under 0.8, are dropped by it. All others are verified on the full sets.

Buckets are not expanded into all pairs. First every member is compared with its bucket's
smallest id (a star); then, in buckets whose members are not yet in one component, pairs
across components. Pairs within a component need no comparison: they can't change it.

Defined cases: null or empty texts have no set and are linked with nothing; fewer words
than a shingle has are one shingle; rows of one doc_id and text are not told apart, each
stays a row; a null doc_id has no component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, rolled, word_hashes, working_folder, written

BANDS, ROWS, BITS = 32, 4, 4
_RNG = np.random.default_rng(42)
_ODD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_P = np.uint64(0x100000001B3)
ESTIMATE = 0.58


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"), True)
    if not len(words):
        return words
    # the number of words is part of a shingle, so that short texts equal no others' parts
    return np.unique(mix(rolled(words, min(k, len(words))) + np.uint64(min(k, len(words)))))


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes, and the packed low bits of the minima."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        low = np.minimum(low, ((s[None, i : i + 512] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    bands = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        bands = mix(bands * _P + column)
    groups = (mix(low) & np.uint64(15)).reshape(8, 16)
    packed = (groups << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)
    return bands, packed


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, bands, bits = [], [], [], [], []
            for x in batch.column("text"):
                s = shingles(x.as_py(), k)
                n.append(len(s))
                h1.append(int(mix(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(mix(s * _P + np.uint64(77)).sum(dtype=np.uint64).view(np.int64)))
                a, b = signature(s) if len(s) else (s, s)
                bands.append(a.view(np.int64))
                bits.append(b.view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, longs), pa.array(bits, longs)], ["doc_id", "n", "h1", "h2", "bands", "bits"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([shingles(x.as_py(), k).view(np.int64) for x in part.column("text")], pa.list_(pa.int64()))], ["id", "s"])

    return run


def estimate(a: Column, b: Column) -> Column:
    """Similarity by the share of equal 4-bit groups, less chance collisions."""
    ones = F.lit(0x1111111111111111)

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        folded = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return F.bit_count(folded.bitwiseAND(ones))

    total = reduce(lambda p, q: p + q, (unequal(F.get(a, i), F.get(b, i)) for i in range(8)))
    share = 1 - total / F.lit(float(BANDS * ROWS))
    return (share - 2.0**-BITS) / (1 - 2.0**-BITS)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """id and root (the smallest id reachable) of all ids in edges (u, v), by alternating
    large and small stars; each round is written, and the loop ends when nothing changes."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    state, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = least.select("u", F.col("m").alias("v")).unionByName(large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), folder, f"star{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
        state, step = now, step + 1


def _verified(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (u, v), those whose full sets have the similarity."""
    a, b = (sigs.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")) for x in "uv")
    likely = pairs.join(a, "u").join(b, "v").filter(F.lit(100) * F.least("nu", "nv") >= F.lit(percent) * F.greatest("nu", "nv")).filter(estimate(F.col("bu"), F.col("bv")) >= ESTIMATE).select("u", "v", "nu", "nv")
    s, t = (sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in "uv")
    inter = F.size(F.array_intersect("su", "sv"))
    return likely.join(s, "u").join(t, "v").withColumn("i", inter).filter(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("nu") + F.col("nv") - F.col("i"))).select("u", "v")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row. Linked are documents with
    100 * intersection >= percent * union; percent must be 80 or more for the band's odds."""
    spark = docs.sparkSession
    folder = working_folder(spark)
    kind = dict(docs.dtypes)["doc_id"]
    sigs = written(docs.select("doc_id", "text").mapInArrow(_signed(words), f"doc_id {kind}, n long, h1 long, h2 long, bands array<long>, bits array<long>"), folder, "signatures")
    classes = written(sigs.filter("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), folder, "classes")
    reps = sigs.filter("n > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    banded = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("members")).filter("members > 1").drop("members")
    buckets = written(banded.join(shared, "key"), folder, "buckets")
    ids = buckets.select("id").distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
    sets = written(texts.mapInArrow(_sets(words), f"id {kind}, s array<long>"), folder, "sets")
    small = reps.select("doc_id", "n", "bits").join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    small = written(small, folder, "bits")
    stars = buckets.filter("id <> leader").select(F.col("id").alias("u"), F.col("leader").alias("v")).distinct()
    links = written(_verified(stars, small, sets, percent).distinct(), folder, "links")
    roots = written(components(links, folder + "/a"), folder, "roots")
    # buckets that hold several components: pairs across them, once
    labelled = buckets.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("c"))
    several = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    open_ = written(labelled.join(several, "key", "left_semi"), folder, "open")
    x, y = open_.select("key", F.col("id").alias("u"), F.col("c").alias("cu")), open_.select("key", F.col("id").alias("v"), F.col("c").alias("cv"))
    across = x.join(y, "key").filter("cu < cv").select("u", "v").distinct().join(stars.select(F.col("v").alias("u"), F.col("u").alias("v")).unionByName(stars), ["u", "v"], "left_anti")
    more = written(_verified(across, small, sets, percent), folder, "more")
    if more.limit(1).count():
        roots = components(links.unionByName(more), folder + "/b")
    found = sigs.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "rep"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with the columns it had."""
    gone = near_duplicates(docs, words, percent).filter("not kept and doc_id is not null").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
