"""Helpers that several corpus operators share."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.text import let
from surveyloom.session import stage

__all__ = ["BLANKS", "WORD", "ascii_lower", "class_of", "let", "ranked", "row_hash", "stage", "unique_seed", "words"]

# Words are runs of anything but these blanks.
BLANKS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def class_of(digest: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), digest)


def unique_seed(rows: DataFrame, digest: str) -> int:
    """The first seed by which ``class_of`` gives no two digests of stored ``rows`` the same 64 bits, so that these stand for the digest exactly."""
    for seed in count():
        found = rows.where(F.col(digest).isNotNull()).groupBy(class_of(F.col(digest), seed).alias("c")).agg(F.min(digest).alias("lo"), F.max(digest).alias("hi"))
        if found.where("lo <> hi").isEmpty():
            return seed
    raise AssertionError


def row_hash(*cols: Column) -> Column:
    """Uniform number in [0, 1) from 52 bits of the MD5 of the columns' texts."""
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with its zero-based position in ``order``, without sorting all rows in one task.

    Rows are dealt by range and stored with the number of their range, so that a recomputed
    task can't move them; the rows before a range are the sum over one count a range.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return (
        dealt.withColumn("_inside", inside)
        .join(before, "_range")
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_range", "_inside", "_before")
    )
