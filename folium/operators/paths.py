"""Path planning: from inputs and what lies under them to outputs, conflicts and skips.

``files`` has input (as given), is_dir (of the input), path (of the file) and rel (relative
to an input folder; the base name for a file). All rules are column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, has_suffix_fold, joined_path


@dataclass(frozen=True)
class PathOptions:
    inputs: tuple[str, ...] = (".epub",)
    preserve: tuple[str, ...] = ()
    exclude: tuple[str, ...] = (".out.epub",)
    target: str = ".out.epub"
    in_place: bool = False
    preserve_dirs: bool = True
    output: str | None = None
    output_is_dir: bool = False
    update: bool = False

    def __post_init__(self):
        for p in self.preserve:
            if p.lower() == self.target.lower() or p.lower() in {x.lower() for x in self.inputs}:
                raise ValueError(f"preserved suffix {p} is an input or the target")


def _any(path: Column, suffixes) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | has_suffix_fold(path, F.lit(s))
    return out


def _stem(path: Column, suffixes) -> Column:
    out = path
    for s in sorted(suffixes, key=len):
        out = F.when(has_suffix_fold(path, F.lit(s)), F.substring(path, F.lit(1), F.length(path) - len(s))).otherwise(out)
    return out


def plan(files: DataFrame, options: PathOptions = PathOptions()) -> DataFrame:
    """input, path, output, status: convert, copy, skip or error."""
    o = options
    files = files.dropDuplicates(["input", "path"])
    several = files.select("input").distinct().limit(2).count() > 1
    rel, is_dir = F.col("rel"), F.col("is_dir")
    excluded, known, kept = _any(rel, o.exclude), _any(rel, o.inputs), _any(rel, o.preserve)
    status = F.when(excluded, F.when(is_dir, "skip").otherwise("error")).when(known, "convert").when(kept, "copy").otherwise(F.when(is_dir, "skip").otherwise("error"))
    name = F.when(status == "convert", F.concat(_stem(rel, o.inputs), F.lit(o.target))).otherwise(rel)
    folder = F.regexp_replace("input", "/+$", "")
    if not o.preserve_dirs:
        name = base_name(name)
    if o.in_place:
        placed = F.when(is_dir, F.concat(folder, F.lit("/"), name)).otherwise(F.when(F.contains("path", F.lit("/")), F.concat(F.regexp_replace("path", "/[^/]*$", "/"), name)).otherwise(name))
    else:
        level = base_name(folder) if o.preserve_dirs or not several else F.lit("")
        under = F.when(level == "", name).otherwise(F.concat(level, F.lit("_converted/"), name))
        marked = F.when(status == "convert", F.concat(F.substring(name, F.lit(1), F.length(name) - len(o.target)), F.lit("_converted" + o.target))).otherwise(name)
        placed = F.when(is_dir, under).otherwise(marked)
    if o.output is not None:
        inside = joined_path(F.lit(o.output.rstrip("/") or "/"), name)
        if several:
            placed = F.when(is_dir, joined_path(F.lit(o.output), placed)).otherwise(inside)
        else:
            placed = F.when(is_dir | F.lit(o.output_is_dir or o.output.endswith("/")), inside).otherwise(F.lit(o.output))
    planned = files.select("input", "path", F.when(status.isin("convert", "copy"), placed).alias("output"), status.alias("status"))
    return planned.filter(~((F.col("status") == "copy") & F.col("output").eqNullSafe(F.col("path"))))


def conflicts(planned: DataFrame) -> DataFrame:
    """kind, name, n: a file reached by several inputs, or an output of several files."""
    live = planned.filter("output is not null")
    same_file = live.groupBy(F.col("path").alias("name")).agg(F.countDistinct("input").cast("long").alias("n")).filter("n > 1").select(F.lit("file").alias("kind"), "name", "n")
    same_target = live.groupBy(F.col("output").alias("name")).agg(F.countDistinct("path").cast("long").alias("n")).filter("n > 1").select(F.lit("output").alias("kind"), "name", "n")
    return same_file.unionByName(same_target)


def skip_existing(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """With ``update``: files whose output exists are skipped."""
    there = existing.select(F.col("path").alias("output")).distinct().withColumn("there", F.lit(True))
    return planned.join(there, "output", "left").withColumn("status", F.when(F.col("there"), "skip").otherwise(F.col("status"))).select("input", "path", "output", "status")


def route(output: Column, suffix: str) -> Column:
    """convert or copy, by the output's suffix; case counts here."""
    return F.when(F.endswith(output, F.lit(suffix)), "convert").otherwise("copy")


def looked_up(inputs: DataFrame, planned: DataFrame) -> DataFrame:
    """Every input file with its output; without one it is skipped."""
    return inputs.join(planned.select("path", "output", "status"), "path", "left").withColumn("status", F.coalesce("status", F.lit("skip")))


def status_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("n"))


def errors(status: DataFrame) -> DataFrame:
    return status.filter("status = 'error'").select("path", "status")
