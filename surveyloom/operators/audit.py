"""Run summaries, review flags and the audit tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.codes import VALID_CATEGORIES, VALID_GENDERS
from surveyloom.functions.temporal import parse_date
from surveyloom.functions.text import clean_val, is_blank
from surveyloom.operators.cells import union_all
from surveyloom.operators.dedup import newest_per_key
from surveyloom.operators.edits import cell_differences

LOW_CONFIDENCE = 75


def changes_of(changes: DataFrame, field: str) -> DataFrame:
    return changes.where(F.col("field") == field)


def low_confidence(changes: DataFrame, below: int = LOW_CONFIDENCE) -> DataFrame:
    return changes.where(F.col("confidence") < below)


def changes_by_field_and_method(changes: DataFrame) -> DataFrame:
    """(dimension, value, n) for both groupings in one aggregation."""
    grouped = (
        changes.groupingSets([["field"], ["method"]], "field", "method")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("field").alias("_g"))
    )
    return grouped.select(
        F.when(F.col("_g") == 0, "field").otherwise("method").alias("dimension"),
        F.when(F.col("_g") == 0, F.col("field")).otherwise(F.col("method")).alias("value"),
        "n",
    )


def spell_summary(spell_changes: DataFrame) -> DataFrame:
    return spell_changes.agg(
        F.count(F.lit(1)).alias("corrections"),
        F.countDistinct("row_id").alias("rows_touched"),
        F.count_if(F.col("status") == "corrected").alias("auto"),
        F.count_if(F.col("status") == "review").alias("review"),
    )


def bad_date(c: Column) -> Column:
    return ~is_blank(c) & parse_date(c).isNull()


def survey_date_issues(df: DataFrame, survey_date: str, name: str, village: str, fallback: str, row_id: str = "row_id") -> DataFrame:
    """Filled survey dates that are not dates."""
    c = F.col(survey_date)
    return df.where(bad_date(c)).select(
        F.col(row_id).alias("row_id"),
        F.col(name).alias("name"),
        F.col(village).alias("village"),
        c.alias("bad_value"),
        F.lit(f"Use '{fallback}' column value as fallback").alias("suggested_fix"),
    )


def invalid_codes(df: DataFrame, gender: str = "gender", category: str = "category") -> DataFrame:
    """(column, value, n): coded values left after cleaning that are not valid codes."""
    def bad(column: str, valid: Sequence[str]) -> DataFrame:
        value = clean_val(F.col(column))
        return (
            df.where(~value.isin(*valid, "", "nan"))
            .groupBy(value.alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(column).alias("column"), "value", "n")
        )

    parts = [bad(c, v) for c, v in ((gender, VALID_GENDERS), (category, VALID_CATEGORIES)) if c in df.columns]
    return union_all(parts)


def column_changes(before: Sequence[str], after: Sequence[str]) -> dict[str, list[str]]:
    return {"dropped": sorted(set(before) - set(after)), "added": sorted(set(after) - set(before))}


def output_checks(original: DataFrame, cleaned: DataFrame, removed: DataFrame, gender: str = "gender", category: str = "category") -> DataFrame:
    """(check, passed, n): record count, dropped and added columns, invalid codes left.

    ``removed`` is a one-row table with ``duplicates_removed``.
    """
    columns = column_changes(original.columns, cleaned.columns)
    counted = (
        original.agg(F.count(F.lit(1)).alias("a")).withColumn("_one", F.lit(1))
        .join(cleaned.agg(F.count(F.lit(1)).alias("b")).withColumn("_one", F.lit(1)), "_one")
        .join(removed.select(F.col("duplicates_removed").alias("r")).withColumn("_one", F.lit(1)), "_one")
        .select(
            F.lit("record_count").alias("check"),
            (F.col("a") - F.col("r") == F.col("b")).alias("passed"),
            (F.col("b") - F.col("a") + F.col("r")).alias("n"),
        )
    )
    spark = original.sparkSession
    structural = spark.createDataFrame(
        [(f"columns_{k}", not v, len(v)) for k, v in columns.items()], "check string, passed boolean, n long"
    )
    codes = (
        invalid_codes(cleaned, gender, category)
        .groupBy(F.concat(F.lit("invalid_"), F.col("column")).alias("check"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("check", F.lit(False).alias("passed"), "n")
    )
    return union_all([counted, structural, codes])


# Flag kinds; a later kind overwrites an earlier one on the same cell.
FLAG_ORDER = ("gender", "category", "spelling", "name", "contact", "job_card", "date", "missing")


def review_flags(
    original: DataFrame,
    cleaned: DataFrame,
    changes: DataFrame,
    spell_changes: DataFrame,
    date_issues: DataFrame,
    columns: Mapping[str, str],
    row_id: str = "row_id",
    scope: Sequence[str] = (),
) -> DataFrame:
    """(row_id, column, flag) of every cell to look at, plus duplicate rows with column null.

    ``columns`` maps the roles name, guardian, contact, job_card, survey_date, key, date,
    gender and category to column names; roles without a column are skipped.
    """
    def ranked(df: DataFrame, column, flag: str) -> DataFrame:
        return df.select(F.col("row_id"), column.alias("column"), F.lit(FLAG_ORDER.index(flag)).alias("_order"))

    have = {role: c for role, c in columns.items() if c in cleaned.columns}
    parts = [
        ranked(changes_of(changes, "gender"), F.lit(have.get("gender")), "gender"),
        ranked(changes_of(changes, "category"), F.lit(have.get("category")), "category"),
        ranked(spell_changes, F.col("column"), "spelling"),
    ]
    roles = {"name": "name", "guardian": "name", "contact": "contact", "job_card": "job_card"}
    compared = {have[r]: flag for r, flag in roles.items() if r in have}
    if compared:
        changed = cell_differences(original, cleaned, list(compared), row_id)
        parts += [
            ranked(changed.where(F.col("column").isin(*[c for c, f in compared.items() if f == flag])), F.col("column"), flag)
            for flag in dict.fromkeys(compared.values())
        ]
    if "survey_date" in have:
        kept = date_issues.join(cleaned.select(F.col(row_id).alias("row_id")), "row_id", "left_semi")
        parts.append(ranked(kept, F.lit(have["survey_date"]), "date"))
    for role in ("gender", "category"):
        if role in have:
            empty = cleaned.where(is_blank(F.col(have[role]))).select(F.col(row_id).alias("row_id"))
            parts.append(ranked(empty, F.lit(have[role]), "missing"))
    cells = (
        union_all(parts)
        .groupBy("row_id", "column")
        .agg(F.max("_order").alias("_order"))
        .select("row_id", "column", F.get(F.lit(list(FLAG_ORDER)), F.col("_order")).alias("flag"))
    )
    if "key" not in have:
        return cells
    return cells.unionByName(
        duplicate_rows(cleaned, have["key"], have.get("date"), row_id, scope).select(
            "row_id", F.lit(None).cast("string").alias("column"), F.lit("duplicate").alias("flag")
        )
    )


#: Columns of a row that its trail adds: the cells as they were, what was resolved, tokens corrected per name column, digest of frozen cells.
BEFORE, RESOLVED, SPELLED, FROZEN = "_before", "_resolved", "_spelled", "_frozen"


def trail_flags(trail: DataFrame, columns: Mapping[str, str], spelled: Mapping[str, str], row_id: str = "row_id", more: DataFrame | None = None) -> DataFrame:
    """(row_id, column, flag) of every cell to look at, each row by itself.

    ``trail`` holds the cleaned rows with their cells as they were (BEFORE, a struct), whether gender and category were
    resolved (RESOLVED, a struct of booleans), and counts of corrected tokens in the columns that ``spelled``
    maps name columns to. ``columns`` is as in ``review_flags``. ``more`` is a log (row_id, field) of further
    changes of gender and category, such as those of a vote.
    """
    have = {role: c for role, c in columns.items() if c in trail.columns}
    before = set(trail.schema[BEFORE].dataType.names)
    trimmed = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit(""))
    raised: dict[str, dict[str, Column]] = {}
    for role in ("gender", "category"):
        if role in have:
            raised.setdefault(have[role], {})["missing"] = is_blank(F.col(have[role]))
            if role in trail.schema[RESOLVED].dataType.names:
                raised[have[role]][role] = F.col(RESOLVED)[role]
    for name, count in spelled.items():
        raised.setdefault(name, {})["spelling"] = F.col(count) > 0
    for role, flag in {"name": "name", "guardian": "name", "contact": "contact", "job_card": "job_card"}.items():
        if role in have and have[role] in before:
            raised.setdefault(have[role], {})[flag] = trimmed(F.col(BEFORE)[have[role]]) != trimmed(F.col(have[role]))
    if "survey_date" in have:
        raised.setdefault(have["survey_date"], {})["date"] = bad_date(F.col(have["survey_date"]))

    def last(flags: dict[str, Column]) -> Column:
        """The latest kind that is raised."""
        out = F.lit(None).cast("int")
        for flag in FLAG_ORDER:
            if flag in flags:
                out = F.when(flags[flag], FLAG_ORDER.index(flag)).otherwise(out)
        return out

    cells = F.array(*[F.struct(F.lit(c).alias("column"), last(flags).alias("_order")) for c, flags in raised.items()])
    found = trail.select(F.col(row_id).alias("row_id"), F.inline(F.filter(cells, lambda x: x["_order"].isNotNull())))
    if more is not None:
        role = F.create_map(*[F.lit(x) for pair in have.items() for x in pair])
        voted = more.where(F.col("field").isin("gender", "category")).select("row_id", F.element_at(role, F.col("field")).alias("column"), F.when(F.col("field") == "gender", 0).otherwise(1).alias("_order"))
        found = found.unionByName(voted).groupBy("row_id", "column").agg(F.max("_order").alias("_order"))
    return found.select("row_id", "column", F.get(F.lit(list(FLAG_ORDER)), F.col("_order")).alias("flag"))


def duplicate_rows(df: DataFrame, key: str, date: str | None, row_id: str = "row_id", scope: Sequence[str] = ()) -> DataFrame:
    """Rows that do not survive into the merged table, by anti-join with the survivors."""
    kept = survivors(df, key, date, row_id, scope)
    return df.select(F.col(row_id).alias("row_id")).join(kept, "row_id", "left_anti")


def survivors(df: DataFrame, key: str, date: str | None, row_id: str = "row_id", scope: Sequence[str] = ()) -> DataFrame:
    """Row ids that survive into the merged table, per ``scope``; only key, date and scope are read."""
    slim = df.select(*dict.fromkeys([row_id, key, *scope] + ([date] if date else [])))
    return newest_per_key(slim, [*scope, key], date, row_id).select(F.col(row_id).alias("row_id"))


def run_history(runs: DataFrame, order: str = "created_at") -> DataFrame:
    """Newest run first."""
    return runs.orderBy(F.desc(order))


def numbered_changes(changes: DataFrame) -> DataFrame:
    """Changes with the spreadsheet row of their record (header plus one-based)."""
    return changes.withColumn("excel_row", F.col("row_id") + 2)

