"""Series metadata: extraction from packages and upsert into a catalog table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers as a strict parser takes them: no blanks, no type suffix.
_NUMBER = r"^[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def parse_number(text: Column) -> Column:
    """The number a text is; 0 where it is none. What is too large is infinite."""
    low = F.lower(F.regexp_replace(text, r"^[+-]", ""))
    sign = F.when(F.startswith(text, F.lit("-")), -1.0).otherwise(1.0)
    value = F.when(low.isin("inf", "infinity"), sign * F.lit(float("inf"))).when(low == "nan", F.lit(float("nan"))).otherwise(text.try_cast("double"))
    return F.when(text.rlike(_NUMBER), F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def number_text(x: Column) -> Column:
    """Shortest plain form of a positive number (1, 1.5), null unless it is above 0."""
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(F.isnan(x), None).when(x == float("inf"), F.lit("+Inf")).when(x > 0, plain)


def series_of(parsed: DataFrame) -> DataFrame:
    """book, series, series_index. The calibre:series meta comes first; if its content is empty,
    the first belongs-to-collection with its refinements. An index that was read with an
    empty series stays unless group-position replaces it; a collection that is no series clears both."""
    meta = lambda test: F.filter("meta", lambda m: (m["tag"] == "meta") & test(m))
    named = F.get(meta(lambda m: m["name"] == "calibre:series"), 0)
    index = F.get(meta(lambda m: m["name"] == "calibre:series_index"), 0)["content"]
    d = parsed.select("book", "meta", F.coalesce(named["content"], F.lit("")).alias("a"), F.when(named.isNotNull() & index.isNotNull(), parse_number(index)).otherwise(0.0).alias("i"))
    d = d.withColumn("c", F.get(meta(lambda m: m["property"] == "belongs-to-collection"), 0))
    d = d.withColumn("r", meta(lambda m: (F.coalesce(F.col("c.id"), F.lit("")) != "") & (m["refines"] == F.concat(F.lit("#"), F.col("c.id")))))
    last = lambda p: F.element_at(F.filter("r", lambda m: m["property"] == p), -1)["text"]
    d = d.withColumn("kind", F.coalesce(F.trim(last("collection-type")), F.lit(""))).withColumn("pos", F.trim(last("group-position")))
    use = (F.col("a") == "") & F.col("c").isNotNull()
    wrong = use & ~F.col("kind").isin("", "series")
    series = F.when(wrong, "").when(use, F.trim("c.text")).otherwise(F.col("a"))
    number = F.when(wrong, 0.0).when(use & F.col("pos").isNotNull(), parse_number(F.col("pos"))).otherwise(F.col("i"))
    return d.select("book", series.alias("series"), number.alias("series_index"))


def series_rows(series: DataFrame) -> DataFrame:
    """image_id (the book), series and series_number as they are written: null where there is nothing."""
    return series.select(F.col("book").alias("image_id"), F.nullif("series", F.lit("")).alias("series"), number_text(F.col("series_index")).alias("series_number"))


def latest(updates: DataFrame) -> DataFrame:
    """Of repeated image_id the row of the highest seq: combined before the exchange, not sorted."""
    return updates.groupBy("image_id").agg(F.max_by(F.struct("series", "series_number"), "seq").alias("x")).select("image_id", "x.series", "x.series_number")


def series_ids(content: DataFrame) -> DataFrame:
    """series and the id that store books of it have; the smallest, where there are several."""
    store = content.filter("work_id is not null and work_id <> '' and series_id is not null and series_id <> ''")
    return store.groupBy("series").agg(F.min("series_id").alias("known_id"))


def upsert_series(content: DataFrame, meta: DataFrame, updates: DataFrame, no_replace: bool = False, no_persist: bool = False) -> tuple[DataFrame, DataFrame]:
    """The catalog (image_id, work_id, series, series_number, series_id) and the pending table after the updates.

    An update without a series clears the catalog's unless ``no_replace``, under which only
    rows without a series are written; with ``no_persist`` applied rows leave the pending table."""
    pending = latest(meta.select("image_id", "series", "series_number", F.lit(-1).cast("long").alias("seq")).unionByName(updates.select("image_id", "series", "series_number", F.col("seq").cast("long").alias("seq"))))
    ids = series_ids(content)
    new = pending.select("image_id", F.col("series").alias("new_series"), F.col("series_number").alias("new_number"), F.lit(True).alias("hit")).join(ids.withColumnRenamed("series", "new_series"), "new_series", "left")
    applies = F.coalesce("hit", F.lit(False)) & (F.col("series").isNull() if no_replace else F.lit(True))
    joined = content.join(new, "image_id", "left").withColumn("apply", applies)
    after = joined.select(
        "image_id",
        "work_id",
        F.when(F.col("apply"), F.col("new_series")).otherwise(F.col("series")).alias("series"),
        F.when(F.col("apply"), F.col("new_number")).otherwise(F.col("series_number")).alias("series_number"),
        F.when(F.col("apply"), F.coalesce("known_id", "new_series")).otherwise(F.col("series_id")).alias("series_id"),
    )
    if no_persist:
        pending = pending.join(joined.filter("apply").select("image_id"), "image_id", "left_anti")
    return after, pending


def imported(content: DataFrame, pending: DataFrame, pattern: str, no_replace: bool = False) -> DataFrame:
    """What arriving catalog rows become: those whose id is like the pattern (ASCII case folded) take their pending series."""
    guard = F.col("image_id").ilike(pattern)
    theirs, others = content.filter(guard), content.filter(~guard | F.col("image_id").isNull())
    return upsert_series(theirs, pending, pending.limit(0).withColumn("seq", F.lit(0)), no_replace)[0].unionByName(others)


def deleted(pending: DataFrame, gone: DataFrame) -> DataFrame:
    """The pending table after catalog rows are deleted."""
    return pending.join(gone.select("image_id"), "image_id", "left_anti")


def series_summary(status: DataFrame) -> DataFrame:
    return status.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "updated").alias("updated"), F.count_if(F.col("status") == "error").alias("errored"), F.count_if(F.col("status") == "none").alias("no_metadata"))
