"""Single-purpose steps, alone or chained in a fixed order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators import cells
from surveyloom.operators.dedup import dedup_summary, deduplicate
from surveyloom.operators.infer import fill_gender_quick
from surveyloom.session import stage


@dataclass(frozen=True)
class EngineConfig:
    row_id: str = "row_id"
    key: str = "Unique Key"
    name: str = "farmer_name"
    guardian: str = "father_spouse_name"
    gender: str = "gender"
    contact: str = "contact_number"
    job_card: str = "mgnrega"
    date: str = "SubmissionDate"
    dates: tuple[str, ...] = ("date_of_survey", "SubmissionDate")
    ages: tuple[str, ...] = ("age",)
    min_age: float = 18
    max_age: float = 100
    min_land_area: float = 0.01
    max_land_area: float = 1000.0
    min_confidence: int = 75
    land_columns: tuple[str, ...] | None = None
    cleaning_columns: tuple[str, ...] | None = None
    as_of: str | None = None

    def now(self) -> Column:
        return F.lit(self.as_of).cast("timestamp") if self.as_of else F.current_timestamp()


class StepResult(NamedTuple):
    data: DataFrame
    stats: DataFrame


def _long(stats: DataFrame, engine: str) -> DataFrame:
    """One-row statistics as (engine, metric, n)."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("n")) for c in stats.columns if not c.endswith("_pct")]
    )
    return stats.select(F.lit(engine).alias("engine"), F.inline(pairs))


def cleaning(df: DataFrame, c: EngineConfig) -> StepResult:
    columns = list(c.cleaning_columns) if c.cleaning_columns else cells.text_columns(df)
    operations = ("trim", "handle_nulls")
    stats = cells.cleaning_stats(cells.cleaned_cells(df, c.row_id, columns, operations))
    return StepResult(cells.clean_columns(df, columns, operations), _long(stats, "cleaning"))


def name_formatting(df: DataFrame, c: EngineConfig, columns: Sequence[str] | None = None) -> StepResult:
    chosen = [n for n in (columns or (c.name, c.guardian)) if n in df.columns]
    stats = cells.name_stats(df, c.row_id, chosen, quick=True)
    long = stats.select(F.col("change_type").alias("metric"), F.col("changed").alias("n")).where(F.col("n") > 0).unionByName(
        stats.agg(F.sum("processed").alias("total_processed"), F.sum("changed").alias("total_changed")).select(
            F.inline(
                F.array(
                    *[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0)).alias("n")) for m in ("total_processed", "total_changed")]
                )
            )
        )
    )
    return StepResult(
        cells.format_names(df, chosen, quick=True), long.select(F.lit("name_formatting").alias("engine"), "metric", "n")
    )


def contact_validation(df: DataFrame, c: EngineConfig) -> StepResult:
    stats = cells.contact_stats(df, c.contact, quick=True).withColumnRenamed("auto_corrected", "corrected")
    return StepResult(cells.correct_contacts(df, c.contact, c.row_id, quick=True).data, _long(stats, "contact_validation"))


def duplicate_removal(df: DataFrame, c: EngineConfig) -> StepResult:
    date = c.date if c.date in df.columns else None
    return StepResult(deduplicate(df, c.key, date, c.row_id), _long(dedup_summary(df, c.key), "duplicate_removal"))


def gender_stats(filled: DataFrame) -> DataFrame:
    """Counts by outcome, from ``fill_gender_quick``."""
    o = F.col("_outcome")
    return filled.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(o == "already_filled").alias("already_filled"),
        F.count_if(o.startswith("tier")).alias("inferred"),
        F.count_if(o == "tier1_direct").alias("tier1_direct"),
        F.count_if(o == "tier2_guardian").alias("tier2_guardian"),
        F.count_if(o == "tier3_suffix").alias("tier3_suffix"),
        F.count_if(o == "cannot_determine").alias("cannot_determine"),
    )


def gender_inference(df: DataFrame, c: EngineConfig) -> StepResult:
    for column in (c.gender, c.guardian, c.name):
        if column not in df.columns:
            df = df.withColumn(column, F.lit("") if column == c.gender else F.lit(None).cast("string"))
    filled = stage(fill_gender_quick(df, c.name, c.guardian, c.gender, c.min_confidence), "gender")  # for the data and for the counts
    return StepResult(filled.drop("_outcome", "_confidence"), _long(gender_stats(filled), "gender_inference"))


def mgnrega_validation(df: DataFrame, c: EngineConfig) -> StepResult:
    return StepResult(df, _long(cells.card_stats_quick(df, c.job_card), "mgnrega_validation"))


def _checked(df: DataFrame, checks, engine: str) -> StepResult:
    return StepResult(df, cells.check_stats(df, checks).select(F.lit(engine).alias("engine"), F.col("issue_type").alias("metric"), "n"))


def date_validation(df: DataFrame, c: EngineConfig) -> StepResult:
    return _checked(df, cells.date_age_checks(df, c.dates, c.ages, c.now(), c.min_age, c.max_age), "date_validation")


def land_validation(df: DataFrame, c: EngineConfig) -> StepResult:
    return _checked(df, cells.land_checks(df, c.land_columns, c.min_land_area, c.max_land_area), "land_validation")


# The engines in their running order; the first four of QUICK run alone on request.
ENGINES: dict[str, Callable[[DataFrame, EngineConfig], StepResult]] = {
    "cleaning": cleaning,
    "name_formatting": name_formatting,
    "contact_validation": contact_validation,
    "duplicate_removal": duplicate_removal,
    "gender_inference": gender_inference,
    "mgnrega_validation": mgnrega_validation,
    "date_validation": date_validation,
    "land_validation": land_validation,
}
QUICK = ("name_formatting", "contact_validation", "duplicate_removal", "gender_inference")
CHANGE_METRICS = ("total_changed", "cells_cleaned", "inferred", "corrected")
_NEEDS = {"contact_validation": "contact", "duplicate_removal": "key", "mgnrega_validation": "job_card"}


def run_engines(df: DataFrame, config: EngineConfig, engines: Sequence[str] | None = None) -> StepResult:
    """Chosen engines in the fixed order; an engine whose column is missing is left out.

    The rows are stored before duplicates go and, with the outcome of each row, after genders are filled in; later engines
    and their counts start from there, so the chain is computed once however many engines there are.
    """
    unknown = set(engines or ()) - set(ENGINES)
    if unknown:
        raise ValueError(f"unknown engines: {sorted(unknown)}")
    data, stats = df, []
    for name, step in ENGINES.items():
        if engines is not None and name not in engines:
            continue
        if name in _NEEDS and getattr(config, _NEEDS[name]) not in data.columns:
            continue
        if name == "duplicate_removal" and stats:
            data = stage(data, "engines")
        result = step(data, config)
        data = result.data
        stats.append(result.stats.select("engine", "metric", "n"))
    return StepResult(data, cells.union_all(stats))


def run_quick(df: DataFrame, engine: str, config: EngineConfig, columns: Sequence[str] | None = None) -> StepResult:
    if engine not in QUICK:
        raise ValueError(f"engine must be one of {QUICK}")
    if engine == "name_formatting":
        return name_formatting(df, config, columns or (config.name,))
    return ENGINES[engine](df, config)


def total_changes(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("metric").isin(*CHANGE_METRICS)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_changes"))

