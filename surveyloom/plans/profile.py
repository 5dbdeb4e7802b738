"""Profile of a table on arrival: bounded sample, all rules, errors and warnings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from surveyloom.operators.rules import HOUSEHOLD_SCHEMA, FieldRule, issue_split, validate_table
from surveyloom.session import stage
from surveyloom.sources.inspect import file_heads, inspect_files
from surveyloom.sources.tables import PROFILE_ROWS, profile_rows


def profile(df: DataFrame, schema: Sequence[FieldRule] = HOUSEHOLD_SCHEMA, row_id: str = "row_id", rows: int | None = PROFILE_ROWS) -> DataFrame:
    """Issues of the first rows (``rows=None``: of all rows); never raises on bad data."""
    sample = df if rows is None else profile_rows(df, row_id, rows)
    return validate_table(sample, schema, row_id, evidence=False)


def profile_file(spark: SparkSession, path: str, schema: Sequence[FieldRule] = HOUSEHOLD_SCHEMA, rows: int = PROFILE_ROWS) -> DataFrame:
    """Issues of the first rows of a delimited file, of which no more is read than holds them; its header says which columns there are."""
    found = inspect_files(spark, [path], whole=False).first()
    sample = file_heads(spark, [path], [c for c in dict.fromkeys(found["columns"]) if c and c != "row_id"], rows).drop("source_path")
    return validate_table(stage(sample, "head"), schema, "row_id", evidence=False)


def profile_split(issues: DataFrame) -> DataFrame:
    return issue_split(issues)
