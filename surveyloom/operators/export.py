"""Mapping a cleaned table to an export schema, with compliance checks.

A format is anything with ``name``, ``mapping()`` and ``compliance(df)``; the shared
``export`` turns the mapping into one ``select``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.codes import export_category, export_gender
from surveyloom.functions.numeric import to_float
from surveyloom.functions.phone import clean_mobile
from surveyloom.functions.temporal import format_ddmmyyyy
from surveyloom.functions.text import strip, title_case
from surveyloom.operators.cells import union_all

TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "title_case": title_case,
    "uppercase": lambda c: F.upper(strip(c)),
    "clean_mobile": clean_mobile,
    "standardize_gender": export_gender,
    "standardize_category": export_category,
    "format_date_ddmmyyyy": format_ddmmyyyy,
    "to_float": to_float,
    "validate_format": lambda c: c,
}


@dataclass(frozen=True)
class FieldMapping:
    source: str
    target: str
    transform: str | None = None
    required: bool = False


# The beneficiary export schema.
BENEFICIARY_MAPPING = (
    FieldMapping("farmer_name", "beneficiary_name", "title_case", True),
    FieldMapping("father_spouse_name", "guardian_name", "title_case", True),
    FieldMapping("aadhaar_number", "uid", None, True),
    FieldMapping("mobile_no", "contact_number", "clean_mobile"),
    FieldMapping("gender", "gender", "standardize_gender", True),
    FieldMapping("category", "social_category", "standardize_category", True),
    FieldMapping("date_of_birth", "dob", "format_date_ddmmyyyy"),
    FieldMapping("village", "village_name", "title_case", True),
    FieldMapping("block", "block_name", "title_case", True),
    FieldMapping("district", "district_name", "title_case", True),
    FieldMapping("state", "state_name", "title_case", True),
    FieldMapping("bank_account", "account_no"),
    FieldMapping("ifsc_code", "ifsc", "uppercase"),
    FieldMapping("land_area", "land_area_ha", "to_float"),
    FieldMapping("mgnrega_id", "mgnrega_job_card", "validate_format"),
)
EXPORT_GENDERS = ("male", "female", "transgender", "other", "m", "f", "t")
MISSING_WARNING_SHARE, SAMPLES = 0.1, 3

ISSUE_SCHEMA = "field string, issue_type string, severity string, row_count long"


class ExportFormat(Protocol):
    name: str

    def mapping(self) -> Sequence[FieldMapping]: ...

    def compliance(self, df: DataFrame) -> DataFrame: ...


def map_fields(df: DataFrame, mapping: Sequence[FieldMapping], keep: Sequence[str] = ()) -> DataFrame:
    """Renamed and transformed columns; unmapped ones are dropped, missing required ones become null."""
    out: list[Column] = [F.col(c) for c in keep]
    for m in mapping:
        if m.source in df.columns:
            transform = TRANSFORMS[m.transform] if m.transform else (lambda c: c)
            out.append(transform(F.col(m.source)).alias(m.target))
        elif m.required:
            out.append(F.lit(None).cast("string").alias(m.target))
    return df.select(*out)


def mapping_counts(columns: Sequence[str], mapping: Sequence[FieldMapping]) -> tuple[int, int]:
    mapped = sum(m.source in columns for m in mapping)
    return mapped, len(mapping) - mapped


def mapping_table(spark: SparkSession, mapping: Sequence[FieldMapping]) -> DataFrame:
    """The mapping itself as a table."""
    return spark.createDataFrame(
        [(m.source, m.target, m.required, m.transform) for m in mapping],
        "source string, target string, required boolean, transform string",
    )


def missing_columns(df: DataFrame, mapping: Sequence[FieldMapping]) -> DataFrame:
    rows = [(m.target, "missing_column", "critical", 0) for m in mapping if m.required and m.target not in df.columns]
    return df.sparkSession.createDataFrame(rows, ISSUE_SCHEMA)


def _bad_uid() -> Column:
    return F.col("uid").isNotNull() & ~strip(F.col("uid")).rlike("^[0-9]{12}$")


def _bad_gender() -> Column:
    return F.col("gender").isNotNull() & ~strip(F.lower("gender")).isin(*EXPORT_GENDERS)


def compliance_issues(df: DataFrame, mapping: Sequence[FieldMapping]) -> DataFrame:
    """(field, issue_type, severity, row_count), all conditional counts in one pass."""
    required = [m.target for m in mapping if m.required and m.target in df.columns]
    checks: list[tuple[str, str, Column]] = [(t, "missing_values", F.col(t).isNull()) for t in required]
    if "uid" in df.columns:
        checks.append(("uid", "invalid_format", _bad_uid()))
    if "gender" in df.columns:
        checks.append(("gender", "invalid_format", _bad_gender()))
    if not checks:
        return missing_columns(df, mapping)
    counts = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(c).alias(f"_{i}") for i, (_, _, c) in enumerate(checks)])

    def severity(field: str, kind: str, n: Column) -> Column:
        if kind == "missing_values":
            return F.when(n < F.col("_all") * MISSING_WARNING_SHARE, "warning").otherwise("critical")
        return F.lit("critical" if field == "uid" else "warning")

    rows = F.array(
        *[
            F.struct(
                F.lit(field).alias("field"),
                F.lit(kind).alias("issue_type"),
                severity(field, kind, F.col(f"_{i}")).alias("severity"),
                F.col(f"_{i}").alias("row_count"),
            )
            for i, (field, kind, _) in enumerate(checks)
        ]
    )
    found = counts.select(F.inline(rows)).where(F.col("row_count") > 0)
    return union_all([missing_columns(df, mapping), found])


def uid_samples(df: DataFrame, row_id: str = "row_id", limit: int = SAMPLES) -> DataFrame:
    """First bad ids by row: a top-k over all rows."""
    return df.where(_bad_uid()).orderBy(row_id).limit(limit).select(row_id, "uid")


class BeneficiaryFormat:
    name = "beneficiary"

    def mapping(self) -> Sequence[FieldMapping]:
        return BENEFICIARY_MAPPING

    def compliance(self, df: DataFrame) -> DataFrame:
        return compliance_issues(df, self.mapping())


class Export(NamedTuple):
    data: DataFrame
    issues: DataFrame
    summary: DataFrame


def export(df: DataFrame, fmt: ExportFormat, keep: Sequence[str] = ()) -> Export:
    """Mapped table, compliance issues, and one summary row."""
    data = map_fields(df, fmt.mapping(), keep)
    issues = fmt.compliance(data)
    mapped, unmapped = mapping_counts(df.columns, fmt.mapping())
    tally = issues.agg(
        F.count(F.lit(1)).alias("_issues"), F.count_if(F.col("severity") == "critical").alias("_critical")
    ).withColumn("_one", F.lit(1))
    records = data.agg(F.count(F.lit(1)).alias("records_out")).withColumn("_one", F.lit(1))
    summary = records.join(tally, "_one").select(
        F.lit(fmt.name).alias("format_name"),
        F.col("records_out").alias("records_in"),
        "records_out",
        F.lit(mapped).alias("fields_mapped"),
        F.lit(unmapped).alias("fields_unmapped"),
        (F.col("_issues") + mapped).alias("compliance_checks"),
        (F.lit(mapped) - F.col("_critical")).alias("compliance_passed"),
    )
    return Export(data, issues, summary)

