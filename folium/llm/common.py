"""What the operators of this subpackage share: tables, the working folder, hashing of words."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Words as most contracts have them: runs of anything but space and the ASCII line signs.
WORD = r"[^\x20\x09-\x0D]+"
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of letters: A-Z, a-z and all bytes of signs beyond ASCII.
_LETTER = np.array([x >= 128 or chr(x).isalpha() for x in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x100000001B3)
_POWERS = np.cumprod(np.full(4096, _BASE, np.uint64))


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def working_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share. Only where the
    session has no such setting (tests, single machine), a folder of this machine is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        root = "/tmp/folium-checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/folium-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The table, written as Parquet in the working folder and read again: cuts the lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64 bits: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(text: bytes, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes and each word's start and end; of runs of letters if asked for."""
    b = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = (_LETTER if letters else _IN_WORD)[b]
    edges = np.flatnonzero(np.diff(inside))
    return b, edges[::2], edges[1::2]


def word_hashes(text: bytes, lower: bool, letters: bool = False) -> np.ndarray:
    """A 64-bit hash of each word of a text; ``lower`` folds A-Z only."""
    b, start, end = word_bounds(text, letters)
    if not len(start):
        return np.empty(0, np.uint64)
    if lower:
        b = _LOWER[b]
    length = end - start
    longest = int(length.max())
    powers = _POWERS if longest < len(_POWERS) else np.cumprod(np.full(longest + 1, _BASE, np.uint64))
    # place of each byte from its word's start; bytes between words count nothing
    origin = np.repeat(start, np.diff(np.append(start, len(b))))
    place = np.arange(start[0], len(b)) - origin
    tail = b[start[0] :]
    inside = (_LETTER if letters else _IN_WORD)[tail]
    place[~inside] = 0
    value = (tail.astype(np.uint64) + np.uint64(1)) * powers[place]
    value[~inside] = 0
    return mix(np.add.reduceat(value, start - start[0]))


def rolled(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of k words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    total, done = None, 0
    power, run = words, 1  # run hashes of doubling length, composed by k's binary digits
    with np.errstate(over="ignore"):
        shift = base
        rest = k
        while rest:
            if rest & 1:
                part = power[done : done + n]
                total = part.copy() if total is None else total * shift + part
                done += run
            rest >>= 1
            if rest:
                power = power[:-run] * shift + power[run:] if run < len(power) else power[:0]
                shift = shift * shift
                run *= 2
        return mix(total)
