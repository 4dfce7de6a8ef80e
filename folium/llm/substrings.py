"""Substring dedup with a log-structured fingerprint index.

A window is ``window`` consecutive words. The index holds fingerprints of k-word grams: in
each window the gram of the smallest hash is chosen (winnowing), so that equal windows
choose equal grams and the index has about one entry for fifteen words. Each batch's
fingerprints become an immutable sorted run; runs are merge-joined with a new batch, and
compacted into one when there are several. A window can repeat only if its gram does; such
windows are verified by hashes of their whole 35 words beside the gram's, 128 bits in all.

Counts go by map-side aggregation. Verification groups rows by gram and, for grams of more
than ``split`` occurrences, by a salt as well; groups are read as a stream that keeps one
entry for each distinct window. What windows a salted part has seen once is settled by a
second aggregation over the parts.

Defined cases: a null text has no words; texts shorter than a window stay whole; equal rows
repeat each other; an empty table gives an empty result; columns beside doc_id and text are
carried through by ``without_repeats`` and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rolled, word_bounds, word_hashes, working_folder, written

WINDOW, GRAM, SPLIT, RUNS, BATCHES = 35, 8, 20_000, 4, 2


def winnowed(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: the place of its gram of smallest hash, the first of equals; and all gram hashes."""
    grams = rolled(words, gram)
    n, span = len(words) - window + 1, window - gram + 1
    if n <= 0:
        return np.empty(0, np.int64), grams
    out = np.empty(n, np.int64)
    for i in range(0, n, 8192):  # bounded memory for long texts
        part = np.lib.stride_tricks.sliding_window_view(grams[i : i + 8192 + span - 1], span)[: n - i]
        out[i : i + len(part)] = part.argmin(axis=1) + np.arange(i, i + len(part))
    return out, grams


def _fingerprints(window: int, gram: int, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                keys, prints, at = [], [], []
                for rk, x in zip(part.column("rk").to_numpy(), part.column("text"), strict=True):
                    chosen, grams = winnowed(word_hashes((x.as_py() or "").encode("utf-8", "surrogatepass"), False), window, gram)
                    if len(chosen):
                        own = chosen[np.append(True, chosen[1:] != chosen[:-1])]
                        prints.append(grams[own].view(np.int64))
                        if places:
                            keys.append(np.full(len(own), rk))
                            at.append(own.astype(np.int32))
                if not prints:
                    continue
                arrays, names = [pa.array(np.concatenate(prints))], ["fp"]
                if places:
                    arrays, names = arrays + [pa.array(np.concatenate(keys)), pa.array(np.concatenate(at))], ["fp", "rk", "at"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


class FingerprintIndex:
    """Immutable runs (fp, n) in a folder, each sorted by fp within its files."""

    def __init__(self, spark: SparkSession, folder: str, window: int = WINDOW, gram: int = GRAM, max_runs: int = RUNS):
        self.spark, self.folder, self.window, self.gram, self.max_runs = spark, folder, window, gram, max_runs
        self.runs: list[str] = []
        self.made = 0

    def _write(self, counted: DataFrame) -> str:
        path = f"{self.folder}/run-{self.made:05d}"
        self.made += 1
        counted.sortWithinPartitions("fp").write.mode("overwrite").parquet(path)
        return path

    def merged(self) -> DataFrame:
        """fp and the number of its occurrences in all runs."""
        empty = self.spark.createDataFrame([], "fp long, n long")
        runs = [self.spark.read.schema("fp long, n long").parquet(p) for p in self.runs]
        if len(runs) == 1:
            return runs[0]
        total = empty
        for r in runs:
            total = total.unionByName(r)
        return total.groupBy("fp").agg(F.sum("n").alias("n"))

    def prints(self, docs: DataFrame, places: bool) -> DataFrame:
        return docs.select("rk", "text").mapInArrow(_fingerprints(self.window, self.gram, places), "fp long, rk long, at int" if places else "fp long")

    def append(self, docs: DataFrame) -> None:
        """A new run of the batch's fingerprints; compaction beyond ``max_runs``."""
        self.runs.append(self._write(self.prints(docs, False).groupBy("fp").agg(F.count("*").alias("n"))))
        if len(self.runs) > self.max_runs:
            self.compact()

    def compact(self) -> None:
        self.runs = [self._write(self.merged())]

    def repeated(self) -> DataFrame:
        return self.merged().filter("n > 1")


def _judge(window: int, gram: int):
    """Texts whose grams repeat: the windows that chose these grams, by gram. Other texts: nothing more."""
    schema = pa.list_(pa.struct([("fp", pa.int64()), ("n", pa.int64()), ("at", pa.int32()), ("h", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [i for i, n in enumerate(batch.schema.names) if n != "marks"]
            for start in range(0, len(batch), 128):
                part = batch.slice(start, 128)
                groups = []
                for x, marks in zip(part.column("text"), part.column("marks"), strict=True):
                    marks = marks.as_py()
                    if not marks:
                        groups.append(None)
                        continue
                    words = word_hashes((x.as_py() or "").encode("utf-8", "surrogatepass"), False)
                    chosen, grams = winnowed(words, window, gram)
                    whole = rolled(words, window, 5)
                    found = []
                    seen = set()
                    for m in marks:
                        if m["at"] in seen:
                            continue
                        seen.add(m["at"])
                        a, b = np.searchsorted(chosen, [m["at"], m["at"] + 1])
                        found.append({"fp": int(grams[m["at"]].view(np.int64)), "n": m["n"], "at": int(a), "h": whole[a:b].tobytes()})
                    groups.append(found)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in others] + [pa.array(groups, schema)], [batch.schema.names[i] for i in others] + ["groups"])

    return run


def _verify(split: int):
    """Rows by (fp, salt): which windows repeat. c 0: flagged places of a row; else what a salted part saw of window h."""
    names = ["rk", "ats", "fp", "h", "at", "c"]
    types = [pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hot, seen = None, False, {}

        def settle(out: list) -> None:
            if hot:
                for h, first in seen.items():
                    out.append((first[0], None, group[0], h, first[1], 1) if first else (None, None, group[0], h, None, 2))

        for batch in batches:
            out: list[tuple] = []
            for fp, salt, n, rk, at, packed in zip(*(batch.column(c).to_pylist() for c in ("fp", "salt", "n", "rk", "at", "h")), strict=True):
                if group != (fp, salt):
                    settle(out)
                    group, hot, seen = (fp, salt), n > split, {}
                flagged = []
                for i, h in enumerate(np.frombuffer(packed, np.int64).tolist()):
                    if h not in seen:
                        seen[h] = (rk, at + i)
                        continue
                    flagged.append(at + i)
                    if first := seen[h]:
                        seen[h] = None
                        if first[0] == rk:
                            flagged.append(first[1])
                        else:
                            out.append((first[0], [first[1]], None, None, None, 0))
                if flagged:
                    out.append((rk, flagged, None, None, None, 0))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        last: list[tuple] = []
        settle(last)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*last, strict=True), types, strict=True)], names)

    return run


def remove(text: str, starts: list[int] | None, window: int) -> tuple[str, int, int]:
    """The kept words joined by one space, all words, removed words."""
    data = text.encode("utf-8", "surrogatepass")
    b, first, last = word_bounds(data)
    n = len(first)
    gone = np.zeros(n + 1, np.int64)
    if starts:
        at = np.unique(np.asarray(starts, np.int64))
        gone[at] += 1
        np.add.at(gone, np.minimum(at + window, n), -1)
    keep = np.cumsum(gone[:n]) == 0
    kept = b" ".join([data[s:e] for s, e in zip(first[keep].tolist(), last[keep].tolist(), strict=True)])
    return kept.decode("utf-8", "surrogatepass"), n, int(n - keep.sum())


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [i for i, n in enumerate(batch.schema.names) if n not in ("text", "starts")]
            for start in range(0, len(batch), 128):
                part = batch.slice(start, 128)
                rows = [remove(x.as_py() or "", s.as_py(), window) for x, s in zip(part.column("text"), part.column("starts"), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in others] + [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], [batch.schema.names[i] for i in others] + ["kept", "n_words", "n_removed"]
                )

    return run


def _fields(df: DataFrame, *without: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in without)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, split: int = SPLIT, batches: int = BATCHES, digest: bool = False) -> DataFrame:
    """The table with kept (instead of text; its SHA-256 with ``digest``), n_words and n_removed.

    The words covered by a window that also starts elsewhere go, at all its places."""
    folder = working_folder(docs.sparkSession)
    keyed = docs.withColumn("rk", F.xxhash64("doc_id", "text"))
    index = FingerprintIndex(docs.sparkSession, folder + "/index", window, gram)
    for b in range(batches):
        index.append(keyed.filter(F.pmod("rk", F.lit(batches)) == b))
    repeated = written(index.repeated(), folder, "repeated")
    marks = index.prints(keyed, True).join(repeated, "fp").groupBy("rk").agg(F.collect_list(F.struct("at", "n")).alias("marks"))
    marked = keyed.join(marks, "rk", "left")
    judged = marked.mapInArrow(_judge(window, gram), _fields(marked, "marks") + ", groups array<struct<fp:long,n:long,at:int,h:binary>>")
    if digest:  # texts that stay whole are digested at once, only the others are kept
        empty = F.lit(None).cast("array<int>")
        whole = judged.withColumn("starts", empty)
        judged = whole.drop("starts").withColumn("done", F.col("groups").isNull())
        joined = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
        judged = judged.withColumn("sha", F.when(F.col("done"), F.sha2(joined, 256))).withColumn("words", F.when(F.col("done"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))).withColumn("text", F.when(~F.col("done"), F.col("text")))
    judged = written(judged, folder, "judged")
    rows = judged.filter("groups is not null").select("rk", F.explode("groups").alias("g")).select("rk", "g.*").withColumn("salt", F.pmod("rk", F.ceil(F.col("n") / split)))
    checked = rows.repartition("fp", "salt").sortWithinPartitions("fp", "salt").mapInArrow(_verify(split), "rk long, ats array<int>, fp long, h long, at int, c int")
    checked = written(checked, folder, "checked")
    parts = checked.filter("c > 0")
    several = parts.groupBy("fp", "h").agg(F.sum("c").alias("total")).filter("total > 1")
    late = parts.filter("c = 1").join(several, ["fp", "h"]).select("rk", F.array("at").alias("ats"))
    starts = checked.filter("c = 0").select("rk", "ats").unionByName(late).groupBy("rk").agg(F.flatten(F.collect_list("ats")).alias("starts"))
    touched = judged.filter("groups is not null").drop("groups", "done", "sha", "words").join(starts, "rk", "left").drop("rk")
    whole = judged.filter("groups is null")
    after = touched.mapInArrow(_remove(window), _fields(touched, "text", "starts") + ", kept string, n_words long, n_removed long")
    if digest:
        left = whole.select(*(c for c in docs.columns if c != "text"), F.col("sha").alias("kept"), F.col("words").alias("n_words"), F.lit(0).cast("long").alias("n_removed"))
        return after.withColumn("kept", F.sha2("kept", 256)).unionByName(left)
    text = F.coalesce("text", F.lit(""))
    left = whole.select(*(c for c in docs.columns if c != "text"), text.alias("kept"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"))
    return after.unionByName(left)


def substring_query(docs: DataFrame) -> DataFrame:
    """op7: words left of every whole text."""
    return without_repeats(docs.select("doc_id", "text"), digest=True).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their columns; a text with repeats is its kept words, others stay as they are."""
    others = [c for c in docs.columns if c != "text"]  # packed, so that names of the operator's own can't clash
    done = without_repeats(docs.select("doc_id", "text", F.struct(*others).alias("row"))).select("row.*", F.col("kept").alias("text"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)
