"""Joins of rows with one-row-per-key facts that stay even when a key is hot."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.session import stage

# Rows of one key that a single task handles at most; a hotter key is split.
ROWS_PER_SPLIT = 1_000_000
# Largest lookup table that is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def attach_per_key(
    df: DataFrame,
    facts: DataFrame,
    key: list[str],
    count_col: str,
    spread_by: str,
    how: str = "left",
    rows_per_split: int = ROWS_PER_SPLIT,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Join ``facts`` (one row per key, with the row count of the key) to ``df``.

    Keys with more than ``rows_per_split`` rows are cut into that many salted parts on
    both sides. There are at most rows / rows_per_split such keys, so the list of them
    is small by construction and is broadcast; all other keys keep one part. Where
    ``df`` may hold hot keys that are not in ``facts``, ``sizes`` (key, count) names the
    counts of all keys.
    """
    parts = F.ceil(F.col(count_col) / F.lit(rows_per_split)).cast("int")
    counted = facts if sizes is None else sizes
    hot = counted.where(F.col(count_col) > rows_per_split).select(*key, parts.alias("_parts"))
    salted = (
        df.join(F.broadcast(hot), key, "left")
        .withColumn(
            "_salt",
            F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(
                F.pmod(F.xxhash64(spread_by), F.col("_parts")).cast("int")
            ),
        )
        .drop("_parts")
    )
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))))
    return salted.join(spread, [*key, "_salt"], how).drop("_salt")


def fits_broadcast(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored lookup table is small enough to broadcast; reads footers only."""
    return table.limit(max_rows + 1).count() <= max_rows


def lookup(
    df: DataFrame, table: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a lookup table with unique keys, broadcast only after counting it.

    ``table`` should be a stored table (the count then reads footers only). Beyond
    ``max_rows`` the join is left to Catalyst, where AQE splits skewed partitions.
    """
    if fits_broadcast(table, max_rows):
        table = F.broadcast(table)
    return df.join(table, on, how)


# Keys in the largest bitmap that ``split_by_keys`` broadcasts: 2^28 bits, 32 MB, whatever the tables' sizes.
MOST_BITS = 28
BITS_PER_KEY = 16


class Split(NamedTuple):
    """Rows that may have one of the keys, and rows that surely have none."""

    maybe: DataFrame
    never: DataFrame


def _bit(on: list[str], bits: int) -> Column:
    """Position of a row's key, counted from 1 as the bitmap functions do."""
    return F.pmod(F.xxhash64(*on), F.lit(1 << bits)) + 1


def split_by_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> Split:
    """Divide ``df`` by a hashed bitmap of the keys in ``keys``, so that a join only has to shuffle ``maybe``.

    ``keys`` should be stored, as it is counted first. The bitmap is built as an aggregate and has at
    most 2^MOST_BITS bits, so broadcasting it is bounded; with more keys than it can tell apart
    all rows are ``maybe``. Both parts read ``df``, and together they hold each row once.
    """
    count = keys.count()
    bits = max(15, min(MOST_BITS, (count * BITS_PER_KEY).bit_length()))
    if count > 1 << bits:
        return Split(df, df.where(F.lit(False)))
    at = keys.select(_bit(on, bits).alias("_at")).withColumn("_bucket", F.bitmap_bucket_number("_at"))
    # positions are dealt by bucket first: a partial bitmap of every task would be larger than its keys
    bitmap = at.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bitmap"))
    placed = df.withColumn("_at", _bit(on, bits)).withColumn("_bucket", F.bitmap_bucket_number("_at"))
    found = placed.join(F.broadcast(bitmap), "_bucket", "left")
    position = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bitmap", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("getbit(_byte, _place)") == 1, F.lit(False))
    told = found.withColumn("_byte", byte).withColumn("_place", (position % 8).cast("int"))
    part = lambda want: told.where(hit == want).select(*df.columns)
    return Split(part(True), part(False))


def rank_within(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``df`` with the zero-based position of each row in its group, ordered by ``order``, however many rows a group has.

    Rows are dealt by range of (group, order), so a hot group is spread over ranges, and stored with the number of their
    range; what lies before a range is the sum over one count per range. Null groups are one group.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(ranges, group, order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range")) - F.col("_n")
    offsets = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)) - 1
    placed = dealt.withColumn("_inside", inside)
    joined = placed.join(offsets, placed[group].eqNullSafe(offsets["_group"]) & (placed["_range"] == offsets["_of"]))
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name)
