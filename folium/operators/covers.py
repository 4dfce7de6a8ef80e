"""Covers: what is to be made, sizes, and pixel work on YCbCr planes (no codec is at hand)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of covers a device keeps; a fixed short list.
KINDS = ("full", "library_full", "library_list", "library_grid")


def wanted(books: DataFrame, kinds=KINDS) -> DataFrame:
    """Each book with each kind of cover: the list is fixed, so it is a literal, not a join."""
    return books.withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))


def missing(covers: DataFrame, existing: DataFrame, regenerate: bool = False) -> DataFrame:
    """Covers that don't exist yet, or all if they are to be made again."""
    return covers if regenerate else covers.join(existing.select("book", "kind"), ["book", "kind"], "left_anti")


def stretched(width: Column, ratio: float) -> tuple[Column, Column]:
    """Width, and the height that gives the ratio, cut to an integer."""
    return width, (F.lit(ratio) * width).cast("int")


def _planes(change):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for plane in ("y", "cb", "cr"):
                columns[plane] = pa.array([None if x.as_py() is None else change(plane, np.frombuffer(x.as_py(), np.uint8)).tobytes() for x in columns[plane]], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _schema(images: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields)


def gray(images: DataFrame) -> DataFrame:
    """Images (y, cb, cr) without colour: both colour planes 128."""
    return images.mapInArrow(_planes(lambda p, x: x if p == "y" else np.full_like(x, 128)), _schema(images))


def invert(images: DataFrame) -> DataFrame:
    """255 less each value of each plane."""
    return images.mapInArrow(_planes(lambda p, x: 255 - x), _schema(images))


def cover_summary(status: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.agg(F.count("*").alias("total"), *(count(s) for s in ("updated", "error", "skipped", "none")))
