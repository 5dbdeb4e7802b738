"""Majority vote inside key groups."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.codes import is_placeholder_key
from surveyloom.functions.text import clean_val, strip
from surveyloom.operators.dedup import split_placeholders
from surveyloom.operators.keyed import ROWS_PER_SPLIT, attach_per_key
from surveyloom.session import stage

MIN_SHARE, STRONG_SHARE = 0.60, 0.80
WEAK_CONFIDENCE, STRONG_CONFIDENCE = 74, 82


def ballots(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, value, votes) of real keys; null cells do not vote, blank ones do."""
    return _tally(df, key, field).where(F.col("value").isNotNull())


def _tally(df: DataFrame, key: str, field: str) -> DataFrame:
    return (
        split_placeholders(df, key)
        .real.groupBy(key, F.lower(strip(F.col(field))).alias("value"))
        .agg(F.count(F.lit(1)).alias("votes"))
    )


def key_results(df: DataFrame, key: str, field: str) -> DataFrame:
    """One row per real key: its row count, the leading value, its votes, all votes, number of values.

    Two partial aggregations (per key and value, then per key) instead of a window: a key
    with very many rows or values is reduced on the map side and never gathered.
    """
    voted = F.col("value").isNotNull()
    top = F.max(F.when(voted, F.struct("votes", "value")))
    return (
        _tally(df, key, field)
        .groupBy(key)
        .agg(
            F.sum("votes").alias("key_rows"),
            top.alias("_top"),
            F.coalesce(F.sum(F.when(voted, F.col("votes"))), F.lit(0)).alias("total"),
            F.count("value").alias("distinct_values"),
        )
        .select(key, "key_rows", F.col("_top.value").alias("majority"), F.col("_top.votes").alias("votes"), "total", "distinct_values")
    )


def vote_shares(df: DataFrame, key: str, field: str, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Each value with its share of the votes of its key, and whether it leads."""
    counted = ballots(df, key, field)
    leading = F.max(F.struct("votes", "value"))
    totals = counted.groupBy(key).agg(
        F.sum("votes").alias("total"), F.count(F.lit(1)).alias("_values"), leading.alias("_top")
    )
    joined = attach_per_key(counted, totals, [key], "_values", "value", "inner", rows_per_split)
    return joined.select(
        key,
        "value",
        "votes",
        "total",
        F.round(F.col("votes") / F.col("total"), 6).alias("share"),
        (F.col("value") == F.col("_top.value")).alias("leads"),
    )


def _winners(results: DataFrame) -> DataFrame:
    share = F.col("votes") / F.col("total")
    return results.where((F.col("distinct_values") > 1) & (share >= MIN_SHARE)).withColumn(
        "confidence", F.when(share < STRONG_SHARE, WEAK_CONFIDENCE).otherwise(STRONG_CONFIDENCE)
    )


def majorities(df: DataFrame, key: str, field: str) -> DataFrame:
    """Keys with more than one value and a top share of at least MIN_SHARE."""
    return _winners(key_results(df, key, field)).drop("key_rows")


class Vote(NamedTuple):
    data: DataFrame
    changes: DataFrame


def majority_vote(
    df: DataFrame,
    key: str,
    field: str,
    name: str,
    guardian: str | None = None,
    row_id: str = "row_id",
    apply: bool = True,
    rows_per_split: int = ROWS_PER_SPLIT,
    scope: Sequence[str] = (),
) -> Vote:
    """Overwrite minority cells with the majority value of their key, per ``scope``, and log them.

    Placeholder rows take no part and do not pass through the join. Every real key that
    is hot is split there, whether or not it has a majority.
    """
    if scope:  # a key then is the scope and the key together
        joint = F.when(~is_placeholder_key(F.col(key)), F.to_json(F.array(*[F.col(c).cast("string") for c in (*scope, key)]))).otherwise(F.col(key))
        vote = majority_vote(df.withColumn("_scoped", joint), "_scoped", field, name, guardian, row_id, apply, rows_per_split)
        return Vote(vote.data.drop("_scoped"), vote.changes)
    real, placeholders = split_placeholders(df, key)
    results = stage(key_results(df, key, field), "vote")
    sizes = results.select(key, F.col("key_rows").alias("_rows"))
    winners = _winners(results).select(
        key, F.col("majority").alias("_majority"), F.col("confidence").alias("_confidence"), F.col("key_rows").alias("_rows")
    )
    rows = attach_per_key(real, winners, [key], "_rows", row_id, rows_per_split=rows_per_split, sizes=sizes).withColumn(
        "_minority", F.col("_majority").isNotNull() & (clean_val(F.col(field)) != F.col("_majority"))
    )
    changes = rows.where("_minority").select(
        F.col(row_id).alias("row_id"),
        F.col(name).alias("name"),
        (F.col(guardian) if guardian else F.lit(None).cast("string")).alias("guardian"),
        F.lit(field).alias("field"),
        clean_val(F.col(field)).alias("old_value"),
        F.col("_majority").alias("new_value"),
        F.col("_confidence").cast("int").alias("confidence"),
        F.lit("Majority Vote").alias("method"),
    )
    if not apply:
        return Vote(df, changes)
    voted = rows.withColumn(field, F.when(F.col("_minority"), F.col("_majority")).otherwise(F.col(field)))
    return Vote(voted.select(*df.columns).unionByName(placeholders), changes)
