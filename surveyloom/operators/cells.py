"""Column-wise cleaning and validation with change logs, issue logs and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from surveyloom.functions.jobcard import CARD_FORMAT, check_card, validate_card
from surveyloom.functions.numeric import age_issue, land_issue
from surveyloom.functions.phone import validate_contact
from surveyloom.functions.temporal import date_issue
from surveyloom.functions.text import change_type, is_blank, is_lower, is_upper, let, name_format, proper_case, squeeze, strip

# Words that mark land and name columns.
LAND_KEYWORDS = ("land", "area", "plot", "survey")
NAME_KEYWORD = "name"


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def land_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(k in c.lower() for k in LAND_KEYWORDS)]


def name_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if NAME_KEYWORD in c.lower()]


def melt(df: DataFrame, row_id: str, columns: Sequence[str], value: str = "value") -> DataFrame:
    """(row_id, column, value): the listed columns in long form, in one pass."""
    if not columns:
        return df.sparkSession.createDataFrame([], f"row_id long, column string, {value} string")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(value)) for c in columns])
    return df.select(F.col(row_id).alias("row_id"), F.inline(cells))


def _rate(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, 1)


# ---- cell cleaning -------------------------------------------------------------------------


CLEANING_OPERATIONS = ("trim", "normalize_case", "handle_nulls")


def clean_cell(c: Column, operations: Sequence[str] = CLEANING_OPERATIONS) -> Column:
    """struct(cleaned, null_handled, trimmed, case_normalized)."""
    value, false = c, F.lit(False)
    null_handled = trimmed = cased = false
    if "trim" in operations:
        squeezed = squeeze(c)  # '' for a blank cell, so one pass over the text tells both
        null_handled = (c.isNull() | (squeezed == "")) if "handle_nulls" in operations else false
        trimmed = F.coalesce(~null_handled & (c != "") & (squeezed != c), false)
        value = F.coalesce(squeezed, F.lit("")) if "handle_nulls" in operations else squeezed
    elif "handle_nulls" in operations:
        null_handled = is_blank(c)
        value = F.when(null_handled, "").otherwise(c)
    if "normalize_case" in operations:
        low = F.lower(value)
        cased = F.coalesce(low != value, false)
        value = low
    return F.struct(
        value.alias("cleaned"), null_handled.alias("null_handled"), trimmed.alias("trimmed"), cased.alias("case_normalized")
    )


def clean_columns(df: DataFrame, columns: Sequence[str] | None = None, operations: Sequence[str] = CLEANING_OPERATIONS) -> DataFrame:
    present = [c for c in (columns if columns is not None else text_columns(df)) if c in df.columns]
    return df.withColumns({c: clean_cell(F.col(c), operations)["cleaned"] for c in present})


def cleaned_cells(df: DataFrame, row_id: str, columns: Sequence[str], operations: Sequence[str] = CLEANING_OPERATIONS) -> DataFrame:
    """Every cell with its cleaning result, in long form."""
    cell = F.col("_cell")
    operations_done = F.array_join(
        F.array(
            F.when(cell["null_handled"], "null_handled"),
            F.when(cell["trimmed"], "trimmed"),
            F.when(cell["case_normalized"], "case_normalized"),
        ),
        ",",
    )
    return (
        melt(df, row_id, columns, "original")
        .withColumn("_cell", clean_cell(F.col("original"), operations))
        .select("row_id", "column", "original", "_cell.*", operations_done.alias("operations"))
        .withColumn("changed", ~F.col("cleaned").eqNullSafe(F.col("original")))
    )


def cleaning_changes(cells: DataFrame) -> DataFrame:
    return cells.where("changed").select("row_id", "column", "original", "cleaned", "operations")


def cleaning_stats(cells: DataFrame) -> DataFrame:
    return cells.agg(
        F.count(F.lit(1)).alias("total_cells_processed"),
        F.count_if("changed").alias("cells_cleaned"),
        F.count_if("null_handled").alias("null_values_found"),
        F.count_if("trimmed").alias("whitespace_fixed"),
        F.count_if("case_normalized").alias("case_normalized"),
    )


# ---- names ---------------------------------------------------------------------------------


def formatted_name(c: Column, quick: bool = False) -> Column:
    return let(name_format(c, quick), lambda n: F.when(n["was_changed"], n["formatted"]).otherwise(c))


def format_names(df: DataFrame, columns: Sequence[str], quick: bool = False) -> DataFrame:
    """Proper-case the columns; blank and already proper cells keep their value."""
    return df.withColumns({c: formatted_name(F.col(c), quick) for c in columns if c in df.columns})


def name_changes(df: DataFrame, row_id: str, columns: Sequence[str], quick: bool = False) -> DataFrame:
    result = name_format(F.col("value"), quick)
    return (
        melt(df, row_id, [c for c in columns if c in df.columns])
        .withColumn("_r", result)
        .where("_r.was_changed")
        .select(
            "row_id",
            "column",
            F.col("_r.original").alias("original"),
            F.col("_r.formatted").alias("formatted"),
            change_type(F.col("value")).alias("change_type"),
        )
    )


def name_stats(df: DataFrame, row_id: str, columns: Sequence[str], quick: bool = True) -> DataFrame:
    """Processed and changed names, by change type."""
    return (
        melt(df, row_id, columns)
        .where(~is_blank(F.col("value")))
        .groupBy(change_type(F.col("value")).alias("change_type"))
        .agg(
            F.count(F.lit(1)).alias("processed"),
            F.count_if(name_format(F.col("value"), quick)["was_changed"]).alias("changed"),
        )
    )


def case_issues(df: DataFrame, row_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Names all in capitals or all in small letters, with the proper-case suggestion."""
    text = strip(F.col("value"))
    issue = F.when(is_upper(text), "All uppercase").when(is_lower(text), "All lowercase")
    return (
        melt(df, row_id, columns if columns is not None else name_columns(df))
        .where(F.length(text) > 2)
        .select("row_id", "column", text.alias("name"), issue.alias("issue"), proper_case(F.col("value")).alias("suggested"))
        .where(F.col("issue").isNotNull())
    )


# ---- phone numbers and cards ---------------------------------------------------------------


class Checked(NamedTuple):
    data: DataFrame
    corrections: DataFrame
    issues: DataFrame


def _checked(df: DataFrame, column: str, result: Column, row_id: str) -> Checked:
    rows = df.withColumn("_r", result)
    repaired = F.col("_r.is_valid") & F.col("_r.was_changed")
    data = rows.withColumn(column, F.when(repaired, F.col("_r.corrected")).otherwise(F.col(column))).drop("_r")
    corrections = rows.where(repaired).select(
        F.col(row_id).alias("row_id"),
        F.lit(column).alias("column"),
        F.col("_r.original").alias("original"),
        F.col("_r.corrected").alias("corrected"),
        F.col("_r.reason").alias("reason"),
    )
    issues = rows.where(~F.col("_r.is_valid") & (F.col("_r.original") != "")).select(
        F.col(row_id).alias("row_id"),
        F.lit(column).alias("column"),
        F.col("_r.original").alias("original"),
        F.col("_r.reason").alias("issue"),
    )
    return Checked(data, corrections, issues)


def correct_contacts(df: DataFrame, column: str, row_id: str = "row_id", quick: bool = False) -> Checked:
    return _checked(df, column, validate_contact(F.col(column), quick), row_id)


def correct_cards(df: DataFrame, column: str, row_id: str = "row_id") -> Checked:
    checked = _checked(df, column, validate_card(F.col(column)), row_id)
    return checked._replace(issues=checked.issues.withColumn("expected_format", F.lit(CARD_FORMAT)))


def card_issues_quick(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    result = check_card(F.col(column))
    return df.where(~result["is_valid"] & ~is_blank(F.col(column))).select(
        F.col(row_id).alias("row_id"), F.col(column).alias("card"), result["issue_type"].alias("issue_type")
    )


def _repair_stats(df: DataFrame, result: Column, blank: Column) -> DataFrame:
    stats = df.select(result.alias("_r"), blank.alias("_blank")).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if("_blank").alias("blank"),
        F.count_if(~F.col("_blank") & F.col("_r.is_valid")).alias("valid"),
        F.count_if(F.col("_r.is_valid") & F.col("_r.was_changed")).alias("auto_corrected"),
        F.count_if(~F.col("_blank") & ~F.col("_r.is_valid")).alias("invalid"),
    )
    return stats.withColumn("filled", F.col("total_records") - F.col("blank")).withColumn(
        "validation_rate_pct", _rate(F.col("valid"), F.col("filled"))
    )


def contact_stats(df: DataFrame, column: str, quick: bool = False) -> DataFrame:
    return _repair_stats(df, validate_contact(F.col(column), quick), is_blank(F.col(column)))


def card_stats(df: DataFrame, column: str) -> DataFrame:
    return _repair_stats(df, validate_card(F.col(column)), is_blank(F.col(column)))


def card_stats_quick(df: DataFrame, column: str) -> DataFrame:
    rows = df.select(check_card(F.col(column)).alias("_r"), is_blank(F.col(column)).alias("_blank"))
    filled = ~F.col("_blank")
    issue = F.col("_r.issue_type")
    return rows.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if("_blank").alias("blank"),
        F.count_if(filled & F.col("_r.is_valid")).alias("valid"),
        F.count_if(filled & ~F.col("_r.is_valid")).alias("invalid"),
        F.count_if(filled & (issue == "wrong_state")).alias("wrong_state"),
        F.count_if(filled & (issue == "wrong_format")).alias("wrong_format"),
    )


# ---- dates, ages, areas --------------------------------------------------------------------


def _issue_rows(df: DataFrame, row_id: str, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """(row_id, column, value, issue_type) of the cells with an issue, all columns in one pass."""
    if not checks:
        return df.sparkSession.createDataFrame([], "row_id long, column string, value string, issue_type string")
    found = F.array(
        *[
            F.when(
                issue.isNotNull(),
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), issue.alias("issue_type")),
            )
            for c, issue in checks
        ]
    )
    return df.select(F.col(row_id).alias("row_id"), F.inline(F.filter(found, lambda x: x.isNotNull())))


def date_age_checks(
    df: DataFrame, dates: Sequence[str], ages: Sequence[str], as_of: Column, min_age: float = 18, max_age: float = 100
) -> list[tuple[str, Column]]:
    checks = [(c, date_issue(F.col(c), as_of)) for c in dates if c in df.columns]
    return checks + [(c, age_issue(F.col(c), min_age, max_age)) for c in ages if c in df.columns]


def land_checks(
    df: DataFrame, columns: Sequence[str] | None = None, min_area: float = 0.01, max_area: float = 1000.0
) -> list[tuple[str, Column]]:
    chosen = columns if columns is not None else land_columns(df)
    return [(c, land_issue(F.col(c), min_area, max_area)) for c in chosen if c in df.columns]


def check_issues(df: DataFrame, checks: Sequence[tuple[str, Column]], row_id: str = "row_id") -> DataFrame:
    return _issue_rows(df, row_id, checks)


def check_stats(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Cells by outcome ('valid' or the issue type) over all checked columns."""
    if not checks:
        return df.sparkSession.createDataFrame([], "issue_type string, n long")
    outcome = F.explode(F.array(*[F.coalesce(issue, F.lit("valid")) for _, issue in checks]))
    return df.select(outcome.alias("issue_type")).groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
