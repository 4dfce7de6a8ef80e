"""Books as tables of entries: reading archives and folders, and writing archives.

An archive is read from ``binaryFile`` (files of up to 2 GB, which is Spark's bound for one
value); a worker holds one archive at a time. Writing holds one book's entries in one
task; a book that fails becomes a row with an error."""

from __future__ import annotations

import codecs
import io
import os
import posixpath
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENTRY = "book string, ord int, name string, method int, comment binary, modified string, external_attrs long, is_dir boolean, bytes binary, error string"
_NAMES = ["book", "ord", "name", "method", "comment", "modified", "external_attrs", "is_dir", "bytes", "error"]
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string()]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows: list[tuple] = []
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for i, e in enumerate(z.infolist()):
                        rows.append((path.as_py(), i, e.filename, e.compress_type, e.comment, "{:04}-{:02}-{:02} {:02}:{:02}:{:02}".format(*e.date_time), e.external_attr, e.is_dir(), b"" if e.is_dir() else z.read(e), None))
            except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError) as e:
                rows = [(path.as_py(), -1, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), _TYPES, strict=True)], _NAMES)


def find_books(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all books under a folder, by suffix without regard to case, in byte order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.filter(F.endswith(F.lower("path"), F.lit(".epub"))).select("path", "length").orderBy("path")


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """Entries of all books under a path, in the archive's order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.filter(F.endswith(F.lower("path"), F.lit(".epub"))).select("path", "content").mapInArrow(_unpacked, ENTRY)


def read_folder(spark: SparkSession, root: str, book: str) -> DataFrame:
    """The files under a folder as one book's entries, in path order; headers are made up: deflated, the mimetype entry stored."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "file:" + posixpath.normpath(root) + "/"
    named = files.select(F.regexp_replace("path", "^" + base.replace(".", r"\."), "").alias("name"), F.col("modificationTime").cast("string").alias("modified"), "content")
    at = F.row_number().over(Window.partitionBy("book").orderBy("name")) - 1
    return named.withColumn("book", F.lit(book)).select("book", at.cast("int").alias("ord"), "name", F.when(F.col("name") == "mimetype", 0).otherwise(8).alias("method"), F.lit(b"").alias("comment"), F.substring("modified", 1, 19).alias("modified"), F.lit(0).cast("long").alias("external_attrs"), F.lit(False).alias("is_dir"), F.col("content").alias("bytes"), F.lit(None).cast("string").alias("error"))


def decode(data: bytes, charset: str) -> str:
    """'' and utf-8 take the bytes as they are; 'auto' looks at marks and declarations; an unknown name is an error."""
    if charset.lower() in ("", "utf-8"):
        return data.decode("utf-8", "replace")
    if charset.lower() == "auto":
        for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
            if data.startswith(mark):
                return data.decode(name, "replace")
        import re

        found = re.search(rb"(?:charset|encoding)\s*=\s*[\"']?([A-Za-z0-9_\-]+)", data[:1024])
        try:
            return data.decode(found[1].decode() if found else "utf-8")
        except (LookupError, UnicodeDecodeError):
            return data.decode("windows-1252", "replace")
    return data.decode(codecs.lookup(charset).name, "replace")


def _writer(folder: str):
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["out"].iloc[0]
        path, temporary = os.path.join(folder, name), os.path.join(folder, f".{os.path.basename(name)}.{os.getpid()}.tmp")
        try:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(temporary, "wb") as f, zipfile.ZipFile(f, "w") as z:
                z.writestr(zipfile.ZipInfo("mimetype"), b"application/epub+zip", zipfile.ZIP_STORED)
                for r in rows.sort_values(["is_changed", "ord"]).itertuples():
                    if r.name == "mimetype":
                        continue
                    stamp = tuple(int(x) for x in (r.modified or "1980-01-01 00:00:00").replace(" ", "-").replace(":", "-").split("-"))
                    info = zipfile.ZipInfo(r.name, max(stamp, (1980, 1, 1, 0, 0, 0)))
                    info.comment, info.external_attr = r.comment or b"", int(r.external_attrs or 0)
                    z.writestr(info, r.bytes or b"", zipfile.ZIP_DEFLATED if r.is_changed or r.method != 0 else zipfile.ZIP_STORED)
                z.close()
                f.flush()
                os.fsync(f.fileno())
            os.replace(temporary, path)
            return pd.DataFrame({"out": [name], "status": ["converted"], "n_entries": [len(rows)], "error": [None]})
        except (OSError, ValueError, zipfile.LargeZipFile) as e:
            if os.path.exists(temporary):
                os.unlink(temporary)
            return pd.DataFrame({"out": [name], "status": ["error"], "n_entries": [0], "error": [f"{type(e).__name__}: {e}"]})

    return write


def write_archives(entries: DataFrame, folder: str) -> DataFrame:
    """One archive for each ``out``: mimetype first and stored, then copied entries in order,
    then changed ones (``is_changed``) in order. Written beside the target and renamed."""
    return entries.groupBy("out").applyInPandas(_writer(folder), "out string, status string, n_entries long, error string")


def _copier(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status = []
            for out, content in zip(batch.column("out"), batch.column("content"), strict=True):
                path = os.path.join(folder, out.as_py())
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(content.as_py())
                status.append("copied")
            yield pa.RecordBatch.from_arrays([batch.column("out"), pa.array(status, pa.string())], ["out", "status"])

    return run


def copy_files(files: DataFrame, folder: str) -> DataFrame:
    """Files (out, content) written unchanged."""
    return files.select("out", "content").mapInArrow(_copier(folder), "out string, status string")
