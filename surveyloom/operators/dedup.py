"""Placeholder keys, newest record per key, duplicate profiles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.codes import is_placeholder_key, surrogate_key
from surveyloom.functions.temporal import parse_date
from surveyloom.operators.keyed import ROWS_PER_SPLIT, attach_per_key


class Split(NamedTuple):
    real: DataFrame
    placeholders: DataFrame


def split_placeholders(df: DataFrame, key: str) -> Split:
    """Set rows with placeholder keys aside; they are never deduplicated."""
    flag = is_placeholder_key(F.col(key))
    return Split(df.where(~flag), df.where(flag))


def placeholder_log(
    df: DataFrame, key: str, name: str, village: str, date: str, row_id: str = "row_id"
) -> DataFrame:
    """One row per quarantined record with a suggested key."""
    return split_placeholders(df, key).placeholders.select(
        F.col(row_id),
        F.col(name).alias("name"),
        F.col(village).alias("village"),
        F.col(key).alias("bad_key"),
        F.col(date).alias("submission_date"),
        surrogate_key(F.col(name), F.col(village), F.col(date)).alias("suggested_key"),
    )


def _recency(date: str | None, row_id: str, newest: bool) -> list[Column]:
    stamp = parse_date(F.col(date)) if date else F.lit(None).cast("timestamp")
    if newest:
        return [stamp.desc_nulls_last(), F.col(row_id).asc()]
    return [stamp.asc_nulls_first(), F.col(row_id).desc()]


def newest_per_key(
    df: DataFrame, key: str | list[str], date: str | None, row_id: str = "row_id", keep: str = "first"
) -> DataFrame:
    """Newest record per key: latest parsed date, unparseable dates last, then lowest row id.

    ``keep='last'`` takes the other end of the same order. The ``= 1`` filter lets Spark
    prune every map partition to one row per key before the shuffle, so a hot key costs
    one row per map task.
    """
    keys = [key] if isinstance(key, str) else key
    window = Window.partitionBy(*keys).orderBy(*_recency(date, row_id, keep == "first"))
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == 1).drop("_rank")


def deduplicate(
    df: DataFrame, key: str, date: str | None, row_id: str = "row_id", scope: list[str] | None = None, keep: str = "first"
) -> DataFrame:
    """Newest per real key, placeholder rows reattached untouched."""
    real, placeholders = split_placeholders(df, key)
    return newest_per_key(real, [*(scope or []), key], date, row_id, keep).unionByName(placeholders)


def merged(df: DataFrame, key: str, date: str | None, row_id: str = "row_id", scope: list[str] | None = None) -> DataFrame:
    """One row per key value, placeholder values included; null keys count as one value."""
    return newest_per_key(df, [*(scope or []), key], date, row_id)


def key_counts(df: DataFrame, key: str, scope: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(scope or []), key).agg(F.count(F.lit(1)).alias("n"))


def duplicate_members(
    df: DataFrame, key: str, row_id: str = "row_id", rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """All rows whose (real) key occurs more than once."""
    real = split_placeholders(df, key).real
    repeated = key_counts(real, key).where(F.col("n") > 1)
    return attach_per_key(real, repeated, [key], "n", row_id, "inner", rows_per_split).drop("n")


def later_occurrences(
    df: DataFrame, key: str, row_id: str = "row_id", rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """Second and later rows of each value in row order; null and '' values are ignored.

    A row is a later one when a lower row id holds the same value, so the first row id
    per value (a map-side combined minimum) replaces a ranking of all rows.
    """
    filled = df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    first = (
        filled.groupBy(key)
        .agg(F.min(row_id).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
    )
    return (
        attach_per_key(filled, first, [key], "_n", row_id, "inner", rows_per_split)
        .where(F.col(row_id) > F.col("_first"))
        .drop("_first", "_n")
    )


def duplicate_profile(df: DataFrame, key: str) -> DataFrame:
    counts = key_counts(split_placeholders(df, key).real, key).where(F.col("n") > 1)
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"),
        F.count(F.lit(1)).alias("keys_with_duplicates"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_per_key"),
        F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("avg_per_key"),
    )


def top_duplicated_keys(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    counts = key_counts(split_placeholders(df, key).real, key).where(F.col("n") > 1)
    return counts.orderBy(F.desc("n"), F.asc(key)).limit(k)


def dedup_summary(df: DataFrame, key: str, scope: list[str] | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """Original, placeholder, removed and final row counts without building the result; ``also`` counts rows by further conditions in the same pass."""
    flag, also = is_placeholder_key(F.col(key)), also or {}
    per_key = df.groupBy(*(scope or []), F.when(~flag, F.col(key)).alias("_key")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(m) for m, c in also.items()])
    real = F.col("_key").isNotNull()
    removed = F.coalesce(F.sum(F.when(real, F.col("n") - 1)), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return (
        per_key.groupBy(*(scope or []))
        .agg(
            total.alias("original_records"),
            F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("placeholder_records"),
            removed.alias("duplicates_removed"),
            *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in also],
        )
        .withColumn("unique_records", F.col("original_records") - F.col("placeholder_records") - F.col("duplicates_removed"))
        .withColumn("final_records", F.col("original_records") - F.col("duplicates_removed"))
        .withColumn(
            "duplication_rate_pct",
            F.round(F.col("duplicates_removed") / F.greatest(F.col("original_records"), F.lit(1)) * 100, 1),
        )
    )


def by_recency(df: DataFrame, date: str, row_id: str = "row_id") -> DataFrame:
    return df.orderBy(*_recency(date, row_id, newest=True))
