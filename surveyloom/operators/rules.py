"""Checks of a table against a declared field schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.functions.numeric import to_float
from surveyloom.functions.similarity import sequence_ratio
from surveyloom.functions.temporal import parse_date
from surveyloom.functions.text import contains_pii, is_blank
from surveyloom.operators.cells import melt, union_all
from surveyloom.operators.dedup import later_occurrences
from surveyloom.session import stage


@dataclass(frozen=True)
class FieldRule:
    name: str
    kind: str  # string | integer | decimal | date | enum
    required: bool = False
    section: str = ""
    pattern: str | None = None
    allowed: tuple[str, ...] = ()
    max_length: int | None = None
    pii: bool = False
    code: bool = False


# The declared household schema.
SOCIAL_CATEGORIES = (
    "SC", "ST", "OBC", "GENERAL", "MINORITY", "OTHER", "PVTG", "SBC", "NT", "EBC", "VJNT",
    "SCHEDULED CASTE", "SCHEDULED TRIBE", "OTHER BACKWARD CLASS", "GENERAL CATEGORY",
    "MINORITY COMMUNITY", "OTHER", "PARTICULARLY VULNERABLE TRIBAL GROUP", "SPECIAL BACKWARD CLASS", "NOTIFIED",
)
SOCIAL_CATEGORIES_SHORT = ("SC", "ST", "OBC", "GENERAL", "MINORITY")
IRRIGATION_SOURCES = ("CANAL", "TUBEWELL", "WELL", "TANK", "RAINFED", "OTHER")
YES_NO = ("YES", "NO")
HOUSEHOLD_SCHEMA = (
    FieldRule("household_id", "string", True, "baseline", pattern=r"^HH[A-Z]{2}[0-9]{8}$"),
    FieldRule("family_head_name", "string", True, "baseline", max_length=100, pii=True),
    FieldRule("social_category", "enum", True, "baseline", allowed=SOCIAL_CATEGORIES),
    FieldRule("state_code", "integer", True, "geo", code=True),
    FieldRule("district_code", "integer", True, "geo", code=True),
    FieldRule("block_code", "integer", True, "geo", code=True),
    FieldRule("gp_code", "integer", True, "geo", code=True),
    FieldRule("village_code", "integer", True, "geo", code=True),
    FieldRule("latitude", "decimal", True, "geo"),
    FieldRule("longitude", "decimal", True, "geo"),
    FieldRule("location_accuracy", "decimal", False, "geo"),
    FieldRule("land_holding_acres", "decimal", False, "farm"),
    FieldRule("irrigation_source", "enum", False, "farm", allowed=IRRIGATION_SOURCES),
    FieldRule("primary_crop", "string", False, "farm", max_length=50),
    FieldRule("cattle_count", "integer", False, "livestock"),
    FieldRule("goat_count", "integer", False, "livestock"),
    FieldRule("poultry_count", "integer", False, "livestock"),
    FieldRule("bank_account_number", "string", False, "financial", pattern=r"^[0-9]{9,18}$", max_length=20, pii=True),
    FieldRule("ifsc_code", "string", False, "financial", pattern=r"^[A-Z]{4}0[A-Z0-9]{6}$"),
    FieldRule("shg_member", "enum", True, "financial", allowed=YES_NO),
    FieldRule("shg_name", "string", False, "financial", max_length=100),
    FieldRule("mahila_kisan", "enum", False, "intervention", allowed=YES_NO),
    FieldRule("krishi_sakhi_trained", "enum", False, "intervention", allowed=YES_NO),
    FieldRule("mobile_number", "string", False, "contact", pattern=r"^[6-9][0-9]{9}$", pii=True),
    FieldRule("aadhaar_number", "string", False, "identity", pattern=r"^[0-9]{12}$", pii=True),
)
REQUIRED_SECTIONS = ("baseline", "geo")
ROW_SAMPLE, VALUE_SAMPLE, DISTINCT_SAMPLE, PII_SAMPLE = 20, 3, 5, 200


@dataclass(frozen=True)
class RowRule:
    """A predicate over one row; ``value`` is the offending cell, ``evidence`` how it is sampled."""

    type: str
    severity: str
    field: str
    broken: Column
    value: Column | None = None
    evidence: str = "rows"  # rows | none
    distinct_values: bool = False

    @property
    def key(self) -> str:
        return f"{self.type}:{self.field}"


def field_rules(df: DataFrame, schema: Sequence[FieldRule]) -> list[RowRule]:
    rules: list[RowRule] = []
    for spec in schema:
        if spec.name not in df.columns:
            continue
        c = F.col(spec.name)
        if spec.required:
            rules.append(RowRule("NULL_IN_REQUIRED_FIELD", "HIGH", spec.name, is_blank(c)))
        if spec.kind in ("integer", "decimal"):
            rules.append(RowRule("TYPE_MISMATCH", "MEDIUM", spec.name, c.isNotNull() & to_float(c).isNull()))
        if spec.kind == "date":
            bad = ~is_blank(c) & parse_date(c, day_first=True).isNull()
            rules.append(RowRule("INVALID_DATE_FORMAT", "MEDIUM", spec.name, bad, c))
        if spec.pattern and spec.kind == "string":
            bad = c.isNotNull() & (c != "") & ~c.rlike(spec.pattern)
            rules.append(RowRule("PATTERN_MISMATCH", "HIGH", spec.name, bad, c))
        if spec.allowed:
            bad = c.isNotNull() & (c != "") & ~c.isin(*spec.allowed)
            rules.append(RowRule("INVALID_ENUM_VALUE", "MEDIUM", spec.name, bad, c, distinct_values=True))
        if spec.max_length:
            rules.append(RowRule("MAX_LENGTH_EXCEEDED", "LOW", spec.name, F.length(c) > spec.max_length, evidence="none"))
    return rules


def cross_field_rules(df: DataFrame) -> list[RowRule]:
    rules = []
    columns = set(df.columns)
    if {"shg_member", "shg_name"} <= columns:
        bad = (F.col("shg_member") == "YES") & is_blank(F.col("shg_name"))
        rules.append(RowRule("BUSINESS_RULE_VIOLATION", "MEDIUM", "shg_name", bad))
    if {"land_holding_acres", "irrigation_source"} <= columns:
        bad = (to_float(F.col("land_holding_acres")) > 0) & F.col("irrigation_source").isNull()
        rules.append(RowRule("DATA_INCONSISTENCY", "LOW", "irrigation_source", bad))
    return rules


def code_rules(df: DataFrame, schema: Sequence[FieldRule]) -> list[RowRule]:
    rules = []
    for spec in schema:
        if spec.code and spec.name in df.columns:
            number = to_float(F.col(spec.name))
            rules.append(RowRule("INVALID_LGD_CODE_TYPE", "HIGH", spec.name, F.col(spec.name).isNotNull() & number.isNull()))
            rules.append(RowRule("INVALID_LGD_CODE_RANGE", "MEDIUM", spec.name, number <= 0))
    return rules


def spillover_rules(df: DataFrame, schema: Sequence[FieldRule], row_id: str, anchored: bool = False) -> list[RowRule]:
    """Twelve-digit ids in columns not declared as personal."""
    personal = {s.name for s in schema if s.pii}
    return [
        RowRule("PII_SPILLOVER", "MEDIUM", c, contains_pii(F.col(c).cast("string"), "aadhaar", anchored), evidence="none")
        for c in df.columns
        if c not in personal and c != row_id
    ]


def pii_columns(df: DataFrame, schema: Sequence[FieldRule]) -> list[str]:
    personal = {s.name for s in schema if s.pii}
    return [c for c in df.columns if c in personal]


def issue_counts(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """(type, severity, field, n): one pass with one conditional count per rule, then turned into rows."""
    if not rules:
        return df.sparkSession.createDataFrame([], "type string, severity string, field string, n long")
    counts = df.agg(*[F.count_if(r.broken).alias(f"_{i}") for i, r in enumerate(rules)])
    rows = F.array(
        *[
            F.struct(
                F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity"), F.lit(r.field).alias("field"),
                F.col(f"_{i}").alias("n"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return counts.select(F.inline(rows)).where(F.col("n") > 0)


def violations(df: DataFrame, rules: Sequence[RowRule], row_id: str) -> DataFrame:
    """(type, field, row_id, value): one row per broken rule and row."""
    if not rules:
        return df.sparkSession.createDataFrame(
            [], "row_id long, type string, field string, value string, distinct_values boolean"
        )
    hits = F.array(
        *[
            F.when(
                r.broken,
                F.struct(
                    F.lit(r.type).alias("type"),
                    F.lit(r.field).alias("field"),
                    (r.value.cast("string") if r.value is not None else F.lit(None).cast("string")).alias("value"),
                    F.lit(r.distinct_values).alias("distinct_values"),
                ),
            )
            for r in rules
        ]
    )
    return df.select(F.col(row_id).alias("row_id"), F.inline(F.filter(hits, lambda h: h.isNotNull())))


def issue_rows(found: DataFrame, limit: int = ROW_SAMPLE) -> DataFrame:
    """First ``limit`` row ids per rule; the rank filter prunes on the map side."""
    order = Window.partitionBy("type", "field").orderBy("row_id")
    return (
        found.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= limit)
        .groupBy("type", "field")
        .agg(F.sort_array(F.collect_list("row_id")).alias("rows"))
    )


def issue_values(found: DataFrame, limit: int = VALUE_SAMPLE, distinct_limit: int = DISTINCT_SAMPLE) -> DataFrame:
    """First bad values per rule: by row for patterns and dates, distinct values for enums."""
    with_value = found.where(F.col("value").isNotNull())
    plain = with_value.where(~F.col("distinct_values")).select("type", "field", "value", "row_id", F.lit(limit).alias("_limit"))
    unique = (
        with_value.where(F.col("distinct_values"))
        .groupBy("type", "field", "value")
        .agg(F.min("row_id").alias("row_id"))
        .withColumn("_limit", F.lit(distinct_limit))
    )
    order = Window.partitionBy("type", "field").orderBy("row_id")
    top = max(limit, distinct_limit)
    return (
        plain.unionByName(unique)
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= top)
        .where(F.col("_rank") <= F.col("_limit"))
        .groupBy("type", "field")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "value"))), lambda s: s["value"]).alias("samples"))
    )


def column_issues(
    spark: SparkSession, columns: Sequence[str], schema: Sequence[FieldRule], encryption_enabled: bool = False
) -> DataFrame:
    """Issues that only need the column names: missing sections and fields, undeclared codes, unencrypted PII."""
    present = set(columns)
    rows: list[tuple[str, str, str]] = []
    sections = {s.section for s in schema if s.name in present}
    missing = [s for s in sorted(REQUIRED_SECTIONS) if s not in sections]
    if missing:
        rows.append(("INCOMPLETE_SCHEMA", "HIGH", ""))
    rows += [("MISSING_REQUIRED_FIELD", "CRITICAL", s.name) for s in schema if s.required and s.name not in present]
    if not any(s.code and s.name in present for s in schema):
        rows.append(("LGD_VALIDATION_SKIPPED", "INFO", ""))
    personal = {s.name for s in schema if s.pii}
    exposed = [c for c in columns if c in personal]
    if exposed and not encryption_enabled:
        rows.append(("PII_COMPLIANCE", "MEDIUM", ", ".join(exposed)))
    return spark.createDataFrame([(*r, 0) for r in rows], "type string, severity string, field string, n long")


def spillover_sampled(df: DataFrame, schema: Sequence[FieldRule], row_id: str, sample_rows: int = PII_SAMPLE) -> DataFrame:
    """Spillover over the first non-null values per column only, anchored at the value start."""
    personal = {s.name for s in schema if s.pii}
    columns = [c for c in df.columns if c not in personal and c != row_id]
    order = Window.partitionBy("column").orderBy("row_id")
    sample = (
        melt(df, row_id, columns)
        .where(F.col("value").isNotNull())
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= sample_rows)
    )
    hits = sample.where(contains_pii(F.col("value"), "aadhaar", anchored=True))
    return hits.groupBy(F.col("column").alias("field")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("PII_SPILLOVER").alias("type"), F.lit("MEDIUM").alias("severity"), "field", "n"
    )


#: Least ratio above which a listed value is suggested for a bad one.
SUGGESTED_ABOVE = 0.6


def suggestions(issues: DataFrame, schema: Sequence[FieldRule], min_ratio: float = SUGGESTED_ABOVE) -> DataFrame:
    """(type, field, suggestion, suggested_from) for the enum and pattern issues of ``issues`` (type, field, samples).

    The first bad value of an issue is compared with the values that its field allows: the nearest one is
    suggested (of equal ones the first listed), else all of them, joined by ``|``; a field without a list has
    its pattern. There are no more rows than rules, whatever the table.
    """
    spark = issues.sparkSession
    fields = [(s.name, "|".join(s.allowed) if s.allowed else None, s.pattern or None) for s in schema if s.allowed or s.pattern]
    listed = [(s.name, i, a) for s in schema for i, a in enumerate(dict.fromkeys(s.allowed or ()))]
    asked = issues.where(F.col("type").isin("INVALID_ENUM_VALUE", "PATTERN_MISMATCH")).select("type", "field", F.get("samples", F.lit(0)).alias("value"))
    options = spark.createDataFrame(listed, "field string, place int, allowed string")
    scored = asked.join(F.broadcast(options), "field").withColumn("ratio", sequence_ratio(F.lower("allowed"), F.lower("value")))
    near = scored.groupBy("type", "field").agg(F.max(F.struct("ratio", (-F.col("place")).alias("place"), "allowed")).alias("top"))
    near = near.where(F.col("top.ratio") > min_ratio).select("type", "field", F.col("top.allowed").alias("nearest"))
    known = spark.createDataFrame(fields, "field string, listed string, pattern string")
    told = asked.join(F.broadcast(known), "field").join(F.broadcast(near), ["type", "field"], "left")
    return told.select(
        "type", "field", F.coalesce("nearest", "listed", "pattern").alias("suggestion"),
        F.when(F.col("nearest").isNotNull(), "nearest").when(F.col("listed").isNotNull(), "list").otherwise("pattern").alias("suggested_from"),
    )


def validate_table(
    df: DataFrame,
    schema: Sequence[FieldRule] = HOUSEHOLD_SCHEMA,
    row_id: str = "row_id",
    unique_field: str = "aadhaar_number",
    encryption_enabled: bool = False,
    pii_sample_rows: int | None = None,
    evidence: bool = True,
) -> DataFrame:
    """All issues: (type, severity, field, n, rows, samples, suggestion, suggested_from).

    Two passes however many rules there are: one aggregation for the counts, one ranked
    pass for the bounded evidence, from which ``suggestions`` are derived.
    """
    spark = df.sparkSession
    rules = field_rules(df, schema) + cross_field_rules(df) + code_rules(df, schema)
    counted = rules + ([] if pii_sample_rows else spillover_rules(df, schema, row_id))
    parts = [column_issues(spark, df.columns, schema, encryption_enabled), issue_counts(df, counted)]
    if pii_sample_rows:
        parts.append(spillover_sampled(df, schema, row_id, pii_sample_rows))
    found = violations(df, [r for r in rules if r.evidence == "rows"], row_id)
    if unique_field in df.columns:
        repeats = later_occurrences(df, unique_field, row_id)
        parts.append(
            repeats.agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 0)
            .select(F.lit("DUPLICATE_AADHAAR").alias("type"), F.lit("CRITICAL").alias("severity"), F.lit(unique_field).alias("field"), "n")
        )
        found = found.unionByName(
            repeats.select(
                F.col(row_id).alias("row_id"),
                F.lit("DUPLICATE_AADHAAR").alias("type"),
                F.lit(unique_field).alias("field"),
                F.lit(None).cast("string").alias("value"),
                F.lit(False).alias("distinct_values"),
            )
        )
    issues = union_all(parts)
    if not evidence:
        return issues
    values = stage(issue_values(found), "samples")  # a row per rule at most
    return (
        issues.join(F.broadcast(issue_rows(found)), ["type", "field"], "left")
        .join(F.broadcast(values), ["type", "field"], "left")
        .join(F.broadcast(suggestions(values, schema)), ["type", "field"], "left")
    )


def issue_split(issues: DataFrame) -> DataFrame:
    """Errors (CRITICAL, HIGH) and warnings (the rest) with issue and row counts."""
    kind = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").otherwise("warning")
    return issues.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("issues"), F.sum("n").alias("row_hits"))


def code_tuple_check(columns: Sequence[str]) -> Column:
    """struct(is_valid, first_bad): every code of the tuple must be a positive integer."""
    chain = None
    for c in columns:
        code = F.col(c).cast("string")
        bad = F.coalesce(~code.rlike(r"^\s*\+?[0-9]+\s*$") | (F.trim(code).try_cast("bigint") <= 0), F.lit(True))
        chain = F.when(bad, c) if chain is None else chain.when(bad, c)
    return F.struct(chain.isNull().alias("is_valid"), chain.alias("first_bad"))


def nearest_allowed(bad: DataFrame, value: str, allowed: Sequence[str], min_ratio: float = 0.6) -> DataFrame:
    """Suggestion for each distinct bad value: the first allowed value with the highest ratio, if above ``min_ratio``."""
    spark = bad.sparkSession
    unique = tuple(dict.fromkeys(allowed))
    options = spark.createDataFrame([(i, a) for i, a in enumerate(unique)], "_place int, allowed string")
    scored = (
        bad.select(F.col(value).alias("value")).distinct()
        .withColumn("allowed", F.explode(F.lit(list(unique))))
        .join(F.broadcast(options), "allowed")
        .withColumn("ratio", sequence_ratio(F.lower("allowed"), F.lower("value")))
    )
    best = scored.groupBy("value").agg(F.max(F.struct("ratio", (-F.col("_place")).alias("_neg"), "allowed")).alias("_top"))
    return best.select(
        "value",
        F.when(F.col("_top.ratio") > min_ratio, F.col("_top.allowed")).alias("suggestion"),
        F.round("_top.ratio", 6).alias("ratio"),
    )
