"""Many files in one job."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.cells import union_all
from surveyloom.plans.context import Context
from surveyloom.plans.survey import SurveyConfig, SurveyRun, run_survey
from surveyloom.sources.tables import base_name

METRICS = (
    "original_records", "final_records", "duplicates_removed", "auto_corrections", "spell_corrections",
    "date_issues", "placeholder_records",
)


def identity(df: DataFrame) -> str:
    """What tells files apart: their full path where the reader gave it, else their name."""
    return "source_path" if "source_path" in df.columns else "source_file"


def run_batch(df: DataFrame, config: SurveyConfig, context: Context = Context(), source_file: str | None = None) -> SurveyRun:
    """All files at once: keys are compared only inside their file, and no file is looped over."""
    return run_survey(df, replace(config, scope=(source_file or identity(df),)), context)


def file_summary(run: SurveyRun, row_id: str = "row_id", source_file: str | None = None, outcomes: DataFrame | None = None) -> DataFrame:
    """One row of metrics per file.

    Files are told apart by source_path where the rows have it, so base names may repeat; the result
    then has both. With the ``outcomes`` (source_path, source_file, status, error) of the reader every file
    has a row with its own status, also empty, missing and unreadable ones; without, all rows are of
    files that were read.

    Log entries find their file by row id (unique, so evenly spread) and are counted
    together with the rows themselves in a single aggregation.
    """
    file = source_file or identity(run.original)

    def entries(df: DataFrame, metric: str) -> DataFrame:
        return df.select(F.col("row_id"), F.lit(metric).alias("metric"))

    logs = union_all(
        [
            entries(run.changes, "auto_corrections"),
            entries(run.spell_changes, "spell_corrections"),
            entries(run.date_issues, "date_issues"),
        ]
    )
    files = run.original.select(F.col(row_id).alias("row_id"), F.col(file).alias("file"))
    counted = logs.groupBy("row_id", "metric").agg(F.count(F.lit(1)).alias("n")).join(files, "row_id").select("file", "metric", "n")
    kept = run.dedup.select(
        F.col(file).alias("file"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).alias("n"))
                    for m in ("original_records", "final_records", "duplicates_removed", "placeholder_records")
                ]
            )
        ),
    )
    summary = (
        counted.unionByName(kept)
        .groupBy("file")
        .agg(*[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).alias(m) for m in METRICS])
    )
    names = [base_name("file").alias("source_file"), F.col("file").alias("source_path")] if file == "source_path" else [F.col("file").alias("source_file")]
    if outcomes is None:
        return summary.select(*names, *METRICS, F.lit("success").alias("status"))
    listed = outcomes.withColumn("file", F.col(file)).join(summary, "file", "left")
    return listed.select(*names, *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in METRICS], "status", "error")


def batch_totals(summary: DataFrame) -> DataFrame:
    """Files and their grand total ('TOTAL') over the successful ones; files are named by their path where the summary has it."""
    file = identity(summary)
    return (
        summary.where(F.col("status") == "success")
        .select(F.col(file).alias("source_file"), *METRICS)
        .rollup("source_file")
        .agg(F.count(F.lit(1)).alias("files"), *[F.sum(m).alias(m) for m in METRICS], F.grouping("source_file").alias("_g"))
        .withColumn("source_file", F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("source_file")))
        .drop("_g")
    )
