"""The whole-table run: deduplicate, correct, format, spell-check, audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators import audit
from surveyloom.operators.cells import formatted_name, union_all
from surveyloom.operators.dedup import dedup_summary, deduplicate, merged, placeholder_log
from surveyloom.operators.infer import (
    CHANGE_COLUMNS,
    category_resolution,
    change_rows,
    gender_resolution,
    needs_category,
    with_category,
    with_gender,
)
from surveyloom.operators.lexicons import Lexicons
from surveyloom.operators.spelling import spell_check
from surveyloom.operators.vote import majority_vote
from surveyloom.plans.context import Context, Mode
from surveyloom.session import stage
from surveyloom.sources.sinks import snapshot, write_table

SPELL_COLUMNS = (
    "row_id", "column", "name_before", "name_after", "role", "original_token", "corrected_token",
    "confidence", "method", "status",
)
_CHANGE_SCHEMA = (
    "row_id long, name string, guardian string, field string, old_value string, new_value string, "
    "confidence int, method string"
)
_SPELL_SCHEMA = (
    "row_id long, column string, name_before string, name_after string, role string, original_token string, "
    "corrected_token string, confidence int, method string, status string"
)


@dataclass(frozen=True)
class SurveyConfig:
    row_id: str = "row_id"
    key: str = "Unique Key"
    name: str = "farmer_name"
    guardian: str = "father_spouse_name"
    date: str = "SubmissionDate"
    survey_date: str = "date_of_survey"
    village: str = "Village Name"
    district: str = "district"
    contact: str = "contact_number"
    job_card: str = "mgnrega"
    gender: str = "gender"
    category: str = "category"
    correct_fields: tuple[str, ...] = ("gender", "category")
    min_confidence: int = 75
    spell_enabled: bool = True
    spell_columns: tuple[str, ...] | None = None
    spell_min_confidence: int = 70
    spell_high_confidence: int = 80
    spell_max_distance: int = 2
    scope: tuple[str, ...] = ()
    lexicons: Lexicons = field(default_factory=Lexicons)

    def roles(self) -> dict[str, str]:
        return {
            "name": self.name, "guardian": self.guardian, "contact": self.contact, "job_card": self.job_card,
            "survey_date": self.survey_date, "key": self.key, "date": self.date, "gender": self.gender,
            "category": self.category,
        }


class SurveyRun(NamedTuple):
    original: DataFrame
    data: DataFrame
    changes: DataFrame
    spell_changes: DataFrame
    date_issues: DataFrame
    placeholders: DataFrame
    dedup: DataFrame
    guard: DataFrame | None
    #: The cleaned rows with what happened to them (see ``audit.trail_flags``), and the rows before names were formatted, stored.
    trail: DataFrame
    resolved: DataFrame
    spelled: dict[str, str]
    votes: DataFrame | None
    #: Rows per dedup scope with their counts, from one pass over the input.
    counts: DataFrame


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def _optional(df: DataFrame, column: str) -> str | None:
    return column if column in df.columns else None


def _digest(columns: Sequence[str]) -> Column:
    """Digest of cells; nulls differ from empty ones. The row carries it, so that the guard needs no join."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


def run_survey(df: DataFrame, config: SurveyConfig, context: Context = Context(), staged: bool = True) -> SurveyRun:
    """Plan the whole run. Steps whose column is missing or not allowed are left out of the plan.

    With ``staged`` the resolved rows, with their formatted names, are written once to the scratch folder; the
    cleaned table and every log are projections of that table.
    """
    c, lex = config, config.lexicons
    scope = list(c.scope)
    has = set(df.columns)
    date, guardian = _optional(df, c.date), _optional(df, c.guardian)

    keyed = c.key in has
    dedup_on = keyed and context.allow_rule("deduplicate")
    rows = deduplicate(df, c.key, date, c.row_id, scope) if dedup_on else df
    dated = {c.survey_date, c.name, c.village} <= has
    also = {"date_issues": audit.bad_date(F.col(c.survey_date)) if dated else F.lit(False)}
    counts = (
        dedup_summary(df, c.key, scope, also)
        if dedup_on
        else df.groupBy(*scope).agg(F.count(F.lit(1)).alias("original_records"), *[F.count_if(x).alias(m) for m, x in also.items()]).withColumns(
            {
                "placeholder_records": F.lit(0).cast("long"),
                "duplicates_removed": F.lit(0).cast("long"),
                "unique_records": F.col("original_records"),
                "final_records": F.col("original_records"),
                "duplication_rate_pct": F.lit(0.0),
            }
        )
    )
    removed = counts.drop(*also)
    kept_cells = [x for x in dict.fromkeys((c.name, c.guardian, c.contact, c.job_card)) if x in has]
    frozen = [x for x in df.columns if x != c.row_id and x not in (context.columns or frozenset())] if context.mode is Mode.SELECTIVE else []
    rows = rows.withColumns({
        audit.BEFORE: F.struct(*kept_cells) if kept_cells else F.struct(F.lit(None).cast("string").alias("_none")),
        **({audit.FROZEN: _digest(frozen)} if frozen else {}),
    })

    correcting = context.allow_rule("auto_correct") and c.name in has

    def corrects(field_name: str, column: str) -> bool:
        return (
            correcting
            and column in has
            and field_name in c.correct_fields
            and context.allow_column(column)
            and context.allow_rule(f"auto_correct_{field_name}")
        )

    resolved: list[tuple[str, str, str]] = []
    if corrects("gender", c.gender):
        rows = with_gender(rows, c.name, lex, "_guess")
        rows = rows.withColumn("_g", gender_resolution(F.col(c.gender), F.col("_guess"), c.min_confidence)).drop("_guess")
        resolved.append(("gender", c.gender, "_g"))
    if corrects("category", c.category):
        rows = with_category(
            rows, c.name, lex, _optional(df, c.district), "_guess", wanted=needs_category(F.col(c.category)), names_from=df
        )
        rows = rows.withColumn("_c", category_resolution(F.col(c.category), F.col("_guess"))).drop("_guess")
        resolved.append(("category", c.category, "_c"))
    name_cols = [n for n in (c.name, c.guardian) if n in has and context.allow_column(n)]
    formats = context.allow_rule("format_name") and name_cols and not context.dry_run
    if formats:  # stored along, as several passes read the formatted names
        rows = rows.withColumn("_named", F.struct(*[formatted_name(F.col(n)).alias(n) for n in name_cols]))
    if staged and resolved:
        rows = stage(rows, "resolved")
    logs = [
        change_rows(rows, name, F.col(column), F.col(r), c.row_id, c.name, guardian).select(*CHANGE_COLUMNS)
        for name, column, r in resolved
    ]
    happened = [F.col(f"{r}.method").isNotNull().alias(name) for name, _, r in resolved] or [F.lit(False).alias("_none")]
    rows = rows.withColumn(audit.RESOLVED, F.struct(*happened))
    if not context.dry_run:
        rows = rows.withColumns({column: F.col(f"{r}.value") for _, column, r in resolved}) if resolved else rows
    rows = rows.drop(*[r for _, _, r in resolved])
    votes = []

    # After deduplication no real key is left with two rows, so the vote has nothing to do.
    if correcting and keyed and not dedup_on:
        for name in c.correct_fields:
            column = {"gender": c.gender, "category": c.category}.get(name, name)
            if column in has and context.allow_column(column):
                vote = majority_vote(rows, c.key, column, c.name, guardian, c.row_id, apply=not context.dry_run, scope=scope)
                rows = vote.data
                votes.append(vote.changes.withColumn("field", F.lit(name)).select(*CHANGE_COLUMNS))
    logs += votes
    before_names = rows.drop("_named")
    if formats:
        rows = rows.withColumns({n: F.col("_named")[n] for n in name_cols}).drop("_named")

    spelled, spelled_in = [], {}
    if c.spell_enabled and context.allow_rule("spell_check"):
        for column in c.spell_columns or (c.name, c.guardian):
            if column in has and context.allow_column(column):
                check = spell_check(
                    rows, column, lex, c.row_id, c.spell_min_confidence, c.spell_high_confidence,
                    c.spell_max_distance, apply=not context.dry_run, count_as=f"{audit.SPELLED}_{len(spelled_in)}",
                )
                rows = check.data
                spelled_in[column] = f"{audit.SPELLED}_{len(spelled_in)}"
                spelled.append(check.changes.select(*SPELL_COLUMNS))

    guard = rows.where(~F.col(audit.FROZEN).eqNullSafe(_digest(frozen))).select(c.row_id) if frozen else None
    if context.mode is Mode.SELECTIVE and not frozen:
        guard = rows.where(F.lit(False)).select(c.row_id)
    return SurveyRun(
        original=df,
        data=rows.select(*df.columns),
        changes=union_all(logs) if logs else _empty(df, _CHANGE_SCHEMA),
        spell_changes=union_all(spelled) if spelled else _empty(df, _SPELL_SCHEMA),
        date_issues=(
            audit.survey_date_issues(df, c.survey_date, c.name, c.village, c.date, c.row_id)
            if dated
            else _empty(df, "row_id long, name string, village string, bad_value string, suggested_fix string")
        ),
        placeholders=(
            placeholder_log(df, c.key, c.name, c.village, c.date, c.row_id)
            if {c.key, c.name, c.village, c.date} <= has
            else _empty(df, "row_id long, name string, village string, bad_key string, submission_date string, suggested_key string")
        ),
        dedup=removed,
        guard=guard,
        trail=rows,
        resolved=before_names,
        spelled=spelled_in,
        votes=union_all(votes) if votes else None,
        counts=counts,
    )


def with_stored_trail(run: SurveyRun) -> SurveyRun:
    """The run with its trail stored, of which cleaned rows, review and summary are projections."""
    trail = stage(run.trail, "trail")
    return run._replace(trail=trail, data=trail.select(*run.data.columns))


def merged_table(run: SurveyRun, config: SurveyConfig, context: Context = Context()) -> DataFrame:
    """One row per key; a dry run merges nothing."""
    if context.dry_run or config.key not in run.data.columns:
        return run.data
    return merged(run.data, config.key, _optional(run.data, config.date), config.row_id, list(config.scope))


def review_table(run: SurveyRun, config: SurveyConfig) -> DataFrame:
    """Cells and rows to look at: cells are told by their own row's trail, only duplicates need a shuffle (of keys, dates and ids)."""
    roles = config.roles()
    cells = audit.trail_flags(run.trail, roles, run.spelled, config.row_id, run.votes)
    if config.key not in run.data.columns:
        return cells
    duplicates = audit.duplicate_rows(run.resolved, config.key, _optional(run.data, config.date), config.row_id, config.scope)
    return cells.unionByName(duplicates.select("row_id", F.lit(None).cast("string").alias("column"), F.lit("duplicate").alias("flag")))


def run_summary(run: SurveyRun) -> DataFrame:
    """One row with the counts of the run: one pass over the input, one over the cleaned rows, and one over votes where there were any."""
    summed = lambda cols: [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in cols]
    totals = run.counts.agg(*summed(("original_records", "placeholder_records", "date_issues", "duplicates_removed")))
    fields = [f for f in run.trail.schema[audit.RESOLVED].dataType.names if f != "_none"]
    resolved = sum((F.col(audit.RESOLVED)[f].cast("long") for f in fields), F.lit(0).cast("long"))
    corrected = sum((F.col(count).cast("long") for count in run.spelled.values()), F.lit(0).cast("long"))
    done = run.trail.agg(F.coalesce(F.sum(resolved), F.lit(0)).alias("r"), F.coalesce(F.sum(corrected), F.lit(0)).alias("spell_corrections"), F.count(F.lit(1)).alias("final_records"))
    parts = [totals, done] + ([run.votes.agg(F.count(F.lit(1)).alias("v"))] if run.votes is not None else [])
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    value = lambda m: F.coalesce(F.max(m), F.lit(0))
    auto = value("r") + value("v") if run.votes is not None else value("r")
    counted = ("original_records", "placeholder_records", "date_issues", "duplicates_removed")
    wide = rows.agg(*[value(m).alias(m) for m in counted], auto.alias("auto_corrections"), *[value(m).alias(m) for m in ("spell_corrections", "final_records")])
    return wide.withColumn("records_after_dedup", F.col("original_records") - F.col("duplicates_removed")).withColumn(
        "reduction_pct",
        F.round((1 - F.col("final_records") / F.greatest(F.col("original_records"), F.lit(1))) * 100, 1),
    )


def audit_tables(run: SurveyRun, stored: bool = False) -> dict[str, DataFrame]:
    """The nine audit tables; ``stored`` tells that the run's changes are read from storage."""
    changes = audit.numbered_changes(run.changes) if stored else stage(audit.numbered_changes(run.changes), "changes")
    return {
        "summary": run_summary(run),
        "all_changes": changes,
        "gender_changes": audit.changes_of(changes, "gender"),
        "category_changes": audit.changes_of(changes, "category"),
        "review_needed": audit.low_confidence(changes),
        "duplicate_summary": run.dedup,
        "date_issues": run.date_issues,
        "placeholder_ids": run.placeholders,
        "name_corrections": run.spell_changes,
    }


def write_run(
    run: SurveyRun, config: SurveyConfig, path: str, context: Context = Context(), fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> dict[str, str]:
    """Write every output of a run below ``path``.

    The trail is stored, the cleaned table and the two logs are written first and read back, so the merged,
    review and audit tables start from stored data.
    """
    spark = run.data.sparkSession
    out = {"snapshot": snapshot(run.original, f"{path}/snapshot")}
    if run.guard is not None and not run.guard.isEmpty():
        raise RuntimeError("columns outside the selection were modified")

    def put(label: str, df: DataFrame, f: str = fmt) -> None:
        out[label] = write_table(df, f"{path}/{label}", f, partition_by=partition_by if label in ("cleaned", "merged") else ())

    def stored(label: str, df: DataFrame) -> DataFrame:
        # A Parquet output is its own stored table; other formats get one beside it.
        native = fmt == "parquet"
        where = f"{path}/{label}" if native else f"{path}/_stored/{label}"
        write_table(df, where, partition_by=partition_by if native and label == "cleaned" else ())
        table = spark.read.schema(df.schema).parquet(where).select(*df.columns)
        if native:
            out[label] = where
        else:
            put(label, table)
        return table

    run = with_stored_trail(run)
    run = run._replace(
        data=stored("cleaned", run.data),
        changes=stored("changes", run.changes),
        spell_changes=stored("spell_changes", run.spell_changes),
    )
    put("merged", merged_table(run, config, context))
    put("review", review_table(run, config))
    for label, table in audit_tables(run, stored=True).items():
        put(f"report/{label}", table)
    put("suggestions/changes", run.changes, "json")
    put("suggestions/spell_changes", run.spell_changes, "json")
    return out
