"""Helpers shared by the corpus operators: row packing, batch bounds and shared scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.scratch import dropped, scratch_root, written
from panelloom.session import ship

__all__ = ["ROW", "bound_batches", "dropped", "packed", "scratch_root", "table", "texts_of", "with_occurrence", "word_count", "written"]
ROW = "__row"


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Make ready for Python workers: bound an Arrow batch, so that long texts do not pile up, and ship the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``__row``, so that working columns never clash with the input's."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(ROW))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Number of maximal runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_occurrence(df: DataFrame, *equal: Column) -> DataFrame:
    """``df``, written, with ``occurrence``: numbers from 0 among the rows that agree in ``equal``, in any order.

    Rows are counted per task first.  A row that repeats a third of all rows is numbered within each partition
    of the table, from an offset, so no task numbers more than one partition's repeats; rows without an equal
    are not shuffled where Spark broadcasts the table of those that have one.
    """
    laid = written(df.withColumns({"__key": F.xxhash64(*equal), "__part": F.spark_partition_id()}), "rows")
    counts = laid.groupBy("__key", "__part").agg(F.count(F.lit(1)).alias("n"))
    all_parts = Window.partitionBy("__key")
    before = F.sum("n").over(all_parts.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    many = counts.select("__key", "__part", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("n").over(all_parts).alias("__n")).filter("__n > 1").drop("__n")
    many = written(many, "repeats")  # so that its true size is known before the rows are joined with it
    own = Window.partitionBy("__key", "__part").orderBy("__before")
    numbered = laid.join(many, ["__key", "__part"]).withColumn("occurrence", F.row_number().over(own) - 1 + F.col("__before")).drop("__before")
    alone = laid.join(many, ["__key", "__part"], "left_anti").withColumn("occurrence", F.lit(0).cast("long"))
    return alone.unionByName(numbered).drop("__key", "__part")


def texts_of(docs: DataFrame, chosen: DataFrame, value: str) -> DataFrame:
    """(doc_id, ``value``, text) for rows (of, ``value``) of ``chosen``, a bounded table of distinct ids, which is broadcast.

    One row per id, however often the documents repeat it: that of the text with the least hash.
    """
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("text"))).alias("least")
    return texts.groupBy("doc_id", value).agg(least).select("doc_id", value, "least.text")
