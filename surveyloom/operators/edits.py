"""Reviewed cell edits, table comparison, integrity guard."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.keyed import fits_broadcast, split_by_keys
from surveyloom.session import stage


class Edited(NamedTuple):
    data: DataFrame
    applied: DataFrame


def apply_edits(df: DataFrame, edits: DataFrame, row_id: str = "row_id") -> Edited:
    """Overwrite cells from (row_id, field, value, seq).

    Unknown fields and rows are ignored and the latest edit of a cell wins. ``applied``
    counts the edits that hit an existing cell. ``df`` should be stored: where the edited rows are too
    many to broadcast, one pass takes the rows that surely have no edit and another the rest,
    so that only about as many rows are shuffled as are edited.
    """
    fields = [c for c in df.columns if c != row_id]
    known = edits.where(F.col("field").isin(*fields))
    last = known.groupBy(row_id, "field").agg(F.max_by("value", "seq").alias("value"))
    # At most one entry per column of the table, so the map stays as wide as a row.
    per_row = last.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_edits"))
    per_row = stage(per_row, "edits")
    if fits_broadcast(per_row):
        edited, untouched = df.join(F.broadcast(per_row), row_id, "left"), None
    else:
        maybe, untouched = split_by_keys(df, per_row.select(row_id), [row_id])
        edited = maybe.join(per_row, row_id, "left")
    data = edited.select(
        row_id,
        *[
            F.when(F.array_contains(F.map_keys("_edits"), c), F.try_element_at("_edits", F.lit(c)).cast(df.schema[c].dataType))
            .otherwise(F.col(c))
            .alias(c)
            for c in fields
        ],
    ).select(*df.columns)
    hit = edited.where(F.col("_edits").isNotNull()).select(row_id)
    applied = known.join(hit, row_id, "left_semi").agg(F.count(F.lit(1)).alias("applied"))
    return Edited(data if untouched is None else data.unionByName(untouched), applied)


def _row_digest(columns: Sequence[str]) -> Column:
    """128 bits of a row; nulls differ from empty texts."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def compare_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts, column differences and rows found on one side only, repeated rows counted as often as they occur.

    One shuffle, of row digests with their sign; equal digests are summed before it.
    """
    shared = [c for c in left.columns if c in right.columns]
    only_left = [c for c in left.columns if c not in right.columns]
    only_right = [c for c in right.columns if c not in left.columns]
    side = lambda df, sign: df.select((_row_digest(shared) if shared else F.unhex(F.lit("00"))).alias("digest"), F.lit(sign).alias("sign"))
    counted = side(left, 1).unionByName(side(right, -1)).groupBy("digest").agg(F.count_if(F.col("sign") > 0).alias("l"), F.count_if(F.col("sign") < 0).alias("r"))
    total = lambda of, name: F.coalesce(F.sum(of), F.lit(0)).alias(name)
    return counted.agg(
        total(F.col("l"), "left_rows"), total(F.col("r"), "right_rows"),
        total(F.greatest(F.col("l") - F.col("r"), F.lit(0)), "left_only_rows"), total(F.greatest(F.col("r") - F.col("l"), F.lit(0)), "right_only_rows"),
    ).withColumns(
        {
            "row_difference": F.abs(F.col("left_rows") - F.col("right_rows")),
            "columns_left_only": F.lit(",".join(sorted(only_left))),
            "columns_right_only": F.lit(",".join(sorted(only_right))),
        }
    )


def cell_differences(before: DataFrame, after: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """(row_id, column, old_value, new_value) of the cells that differ after trimming, nulls as ''."""

    def side(df: DataFrame, label: str) -> DataFrame:
        return df.select(row_id, *[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(f"{label}_{c}") for c in columns])

    joined = side(before, "old").join(side(after, "new"), row_id)
    cells = F.array(
        *[
            F.when(
                F.col(f"old_{c}") != F.col(f"new_{c}"),
                F.struct(F.lit(c).alias("column"), F.col(f"old_{c}").alias("old_value"), F.col(f"new_{c}").alias("new_value")),
            )
            for c in columns
        ]
    )
    return joined.select(F.col(row_id).alias("row_id"), F.inline(F.filter(cells, lambda x: x.isNotNull())))


def frozen_violations(before: DataFrame, after: DataFrame, frozen: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Rows whose frozen columns differ: a join of row hashes, so only two numbers per row are shuffled."""
    def hashed(df: DataFrame, label: str) -> DataFrame:
        return df.select(row_id, F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in frozen]).alias(label))

    joined = hashed(before, "_before").join(hashed(after, "_after"), row_id, "full")
    return joined.where(~F.col("_before").eqNullSafe(F.col("_after"))).select(row_id)


def assert_frozen(before: DataFrame, after: DataFrame, frozen: Sequence[str], row_id: str = "row_id") -> None:
    if frozen and not frozen_violations(before, after, frozen, row_id).isEmpty():
        raise RuntimeError(f"columns outside the selection were modified: {sorted(frozen)}")
