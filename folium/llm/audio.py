"""Media columns: texts as 8-bit audio, and audio features as fixed-shape Arrow tensors.

A payload is stored as a mono WAV file of unsigned 8-bit samples. Features are computed from
the stored bytes: polyphase resampling by 2/3 (integer taps, so exact), a Hann-windowed
log-mel filterbank over overlapping frames, and segments of speech-like energy by
hysteresis (on above the upper threshold, off only below the lower one). The log-mel
matrix is cut into chunks of 32 frames, each stored as an Arrow tensor message of the fixed
shape (32, 16), with its time span; the last one is filled up with the floor.

Defined cases: a null text is empty, and an empty payload is 576 bytes of 255; repeated rows
are rows of their own; an empty table gives an empty result; other columns are not looked
at. Equal payloads give equal bytes and features: nothing else enters the stored form. A
text's work takes memory in proportion to its length, a few bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, UP, DOWN, TAPS = 16_000, 2, 3, 24
WINDOW, HOP, MELS, FRAMES = 256, 128, 16, 32
UNIT, HEADER = 576, 44
FLOOR = -10.0
_SHIFT = 14


def wav(text: Column, unit: int = UNIT) -> Column:
    """The text's UTF-8 bytes, filled up with 255 to a positive multiple of ``unit``, as a WAV file."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(data)
    fill = F.when(n == 0, F.lit(unit)).otherwise(F.pmod(-n, F.lit(unit)))
    total = n + fill

    def little(x: Column) -> Column:
        h = F.lpad(F.hex(x.cast("long")), 8, "0")
        return F.unhex(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))))

    fmt = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data"
    return F.concat(F.lit(b"RIFF"), little(total + (HEADER - 8)), F.lit(fmt), little(total), data, F.unhex(F.repeat(F.lit("FF"), fill.cast("int"))))


def samples(media: bytes) -> memoryview:
    """The stored samples of a WAV file as ``wav`` writes it."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:16] != b"WAVEfmt ":
        raise ValueError("not a WAV file")
    (n,) = struct.unpack_from("<I", view, HEADER - 4)
    return view[HEADER : HEADER + n]


@cache
def _taps() -> np.ndarray:
    k = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    h = np.sinc(k / DOWN) * np.kaiser(TAPS * UP, 6.0)
    return np.round(h / h.sum() * UP * (1 << _SHIFT)).astype(np.int32)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase by UP / DOWN: output m is the dot product of one phase of the taps with the input at m DOWN / UP."""
    taps, n = _taps(), (len(x) * UP + DOWN - 1) // DOWN
    padded = np.concatenate((np.zeros(TAPS, np.int32), x.astype(np.int32), np.zeros(DOWN * 2, np.int32)))
    out = np.zeros(n, np.int32)
    for first in range(UP):
        phase, start = first * DOWN % UP, first * DOWN // UP + TAPS
        m = len(out[first::UP])
        total = np.zeros(m, np.int32)
        for k in range(TAPS):
            total += taps[phase + k * UP] * padded[start - k : start - k + DOWN * m : DOWN][:m]
        out[first::UP] = total
    return out


@cache
def _bank() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), MELS + 2) / 2595) - 1)
    at = np.arange(WINDOW // 2 + 1) * rate / WINDOW
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((at - low) / (mid - low), (high - at) / (high - mid))).T


def log_mel(y: np.ndarray) -> np.ndarray:
    """Frames by MELS, from resampled samples."""
    n = 1 + max(0, -(-(len(y) - WINDOW) // HOP))
    y = np.concatenate((y, np.zeros(WINDOW + HOP * (n - 1) - len(y), y.dtype))) if WINDOW + HOP * (n - 1) > len(y) else y
    frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP][:n]
    out = np.empty((n, MELS), np.float32)
    for i in range(0, n, 1024):  # bounded memory for long texts
        spectrum = np.fft.rfft(frames[i : i + 1024] * (np.hanning(WINDOW) / (128 << _SHIFT)))
        out[i : i + 1024] = np.log10(np.maximum((spectrum.real**2 + spectrum.imag**2) @ _bank(), 10**FLOOR))
    return out


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of frames of high energy, by hysteresis around the mean."""
    energy = mel.astype(np.float64).mean(axis=1)
    mean, spread = energy.mean(), energy.std()
    event = np.where(energy > mean + 0.25 * spread, 1, np.where(energy < mean - 0.25 * spread, 0, -1))
    last = np.maximum.accumulate(np.where(event >= 0, np.arange(len(event)), -1))
    on = np.zeros(len(event) + 2, np.int8)
    on[1:-1] = np.where(last >= 0, event[np.maximum(last, 0)], 0)
    edges = np.flatnonzero(np.diff(on))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _tensor(chunk: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(chunk)), sink)
    return sink.getvalue().to_pybytes()


def read_tensor(message: bytes) -> np.ndarray:
    return pa.ipc.read_tensor(pa.BufferReader(message)).to_numpy()


FEATURES = [
    ("payload_bytes", pa.int64(), "long"),
    ("payload_sha256", pa.string(), "string"),
    ("tail_crc32", pa.int64(), "long"),
    ("media_bytes", pa.int64(), "long"),
    ("media_sha256", pa.string(), "string"),
    ("feature", pa.string(), "string"),
    ("tensors", pa.list_(pa.binary()), "array<binary>"),
    ("spans", pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])), "array<struct<start_ms:long,end_ms:long>>"),
    ("segments", pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])), "array<struct<start_ms:long,end_ms:long>>"),
]
_FRAME_MS = 1000 * HOP * DOWN / (RATE * UP)


def _span(first: int, last: int) -> dict:
    return {"start_ms": round(first * _FRAME_MS), "end_ms": round(last * _FRAME_MS)}


def describe(media: bytes) -> dict:
    """The features of one stored file."""
    payload = samples(media)
    mel = log_mel(resample(np.frombuffer(payload, np.uint8).astype(np.int32) - 128))
    n = len(mel)
    filled = np.full((-(-n // FRAMES) * FRAMES, MELS), FLOOR, np.float32)
    filled[:n] = mel
    tensors = [_tensor(filled[i : i + FRAMES]) for i in range(0, len(filled), FRAMES)]
    runs = segments(mel)
    coarse = np.round(mel * 64).astype("<i2")
    means = ",".join(f"{x:.2f}" for x in mel.mean(axis=0, dtype=np.float64))
    feature = f"frames={n};chunks={len(tensors)};segments={len(runs)};active={sum(b - a for a, b in runs)};mean={means};mel={hashlib.md5(coarse.tobytes()).hexdigest()}"
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": feature,
        "tensors": tensors,
        "spans": [_span(i, min(i + FRAMES, n)) for i in range(0, n, FRAMES)],
        "segments": [_span(a, b) for a, b in runs],
    }


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [n for n, _, _ in FEATURES]
    for batch in batches:
        media = batch.column("media")
        keep = [i for i, n in enumerate(batch.schema.names) if n != "media"]
        for start in range(0, len(batch), 64):  # small batches out: tensors are large
            rows = [describe(x.as_py()) for x in media[start : start + 64]]
            part = batch.slice(start, len(rows))
            yield pa.RecordBatch.from_arrays([part.column(i) for i in keep] + [pa.array([r[n] for r in rows], t) for n, t, _ in FEATURES], [batch.schema.names[i] for i in keep] + names)


def audio_features(stored: DataFrame) -> DataFrame:
    """Of a table with a column ``media``: its other columns and the features."""
    others = [f for f in stored.schema.fields if f.name != "media"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [f"{n} {t}" for n, _, t in FEATURES])
    return stored.mapInArrow(_described, schema)


def audio_query(docs: DataFrame) -> DataFrame:
    """op2: payload digests and features of every whole text."""
    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), wav(F.col("text")).alias("media"))
    return audio_features(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
