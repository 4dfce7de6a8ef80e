"""Numbering of text fragments within paragraphs, over an event table.

Events are block starts ('blk'), images ('img') and text ('txt'), ordered by pos within a
document. One exchange by document serves all windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_space, sentences


def number_spans(events: DataFrame, doc: str = "doc_id") -> DataFrame:
    """para and seg of each img and txt event. A block start raises the paragraph of the next
    emitted event, several count once; an image is a paragraph of its own; white space
    counts nothing unless its parent is a paragraph (``in_p``)."""
    by_pos = Window.partitionBy(doc).orderBy("pos")
    emitted = (F.col("kind") == "img") | ((F.col("kind") == "txt") & (F.col("in_p") | ~is_space(F.col("text"))))
    counted = events.withColumn("b", F.sum(F.when(F.col("kind") == "blk", 1).otherwise(0)).over(by_pos)).filter(emitted)
    opened = (F.col("kind") == "img") | (F.col("b") > F.lag("b", 1, 0).over(by_pos))
    numbered = counted.withColumn("para", F.sum(F.when(opened, 1).otherwise(0)).over(by_pos))
    return numbered.withColumn("seg", F.row_number().over(Window.partitionBy(doc, "para").orderBy("pos"))).drop("b")


def line_events(docs: DataFrame) -> DataFrame:
    """Each line of a text as a block, with its sentences as text events."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    pieces = F.concat(
        F.array(F.struct(F.lit("blk").alias("kind"), F.lit("").alias("text"))),
        F.transform(sentences(F.col("content")), lambda s: F.struct(F.lit("txt").alias("kind"), s.alias("text"))),
    )
    flat = lines.select("doc_id", "line", F.posexplode(pieces).alias("at", "e"))
    return flat.select("doc_id", F.struct("line", "at").alias("pos"), "e.kind", "e.text", F.lit(False).alias("in_p"))
