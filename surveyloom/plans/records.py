"""Record batches: validate and infer field by field, with nested details per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.jobcard import validate_card
from surveyloom.functions.phone import validate_contact
from surveyloom.functions.text import clean_val, name_format
from surveyloom.operators.infer import with_category, with_gender
from surveyloom.operators.lexicons import Lexicons
from surveyloom.plans.context import Context

SKIPPED = "Skipped by execution context"


def _detail(field: str, original: Column, corrected: Column, changed: Column, valid: Column, reason: Column) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        original.alias("original"),
        corrected.alias("corrected"),
        changed.alias("was_changed"),
        valid.alias("is_valid"),
        reason.alias("reason"),
    )


def _skipped(field: str) -> Column:
    return _detail(field, F.col(field), F.col(field), F.lit(False), F.lit(True), F.lit(SKIPPED))


def process_records(
    df: DataFrame,
    lexicons: Lexicons,
    context: Context = Context(),
    name: str = "farmer_name",
    contact: str = "contact_number",
    card: str = "mgnrega_card",
    gender: str = "gender",
    category: str = "category",
) -> DataFrame:
    """Input columns with their new values plus ``validations``, ``inferences`` and three flags."""
    write = not context.dry_run
    rows = df.withColumns({gender: clean_val(F.col(gender)), category: clean_val(F.col(category))})

    def allowed(rule: str, column: str) -> bool:
        return context.allow_rule(rule) and context.allow_column(column)

    details, values = [], {}
    checks = (
        ("format_name", name, name_format(F.col(name))),
        ("validate_contact", contact, validate_contact(F.col(contact))),
        ("validate_mgnrega", card, validate_card(F.col(card))),
    )
    active = [(rule, column) for rule, column, _ in checks if allowed(rule, column)]
    rows = rows.withColumns({f"_{rule}": result for rule, column, result in checks if (rule, column) in active})
    for rule, column, _ in checks:
        if (rule, column) not in active:
            details.append(_skipped(column))
            continue
        result = F.col(f"_{rule}")
        if rule == "format_name":
            fixed, valid, reason = result["formatted"], F.lit(True), F.when(result["was_changed"], "formatted").otherwise("unchanged")
        else:
            fixed, valid, reason = result["corrected"], result["is_valid"], result["reason"]
        details.append(_detail(column, result["original"], fixed, result["was_changed"], valid, reason))
        if write:
            values[column] = F.when(valid & result["was_changed"], fixed).otherwise(F.col(column))
    rows = rows.withColumn("validations", F.array(*details))

    guesses = []
    if allowed("infer_gender", gender):
        rows = with_gender(rows, name, lexicons, "_gender")
        guesses.append((gender, "_gender"))
    if allowed("infer_category", category):
        rows = with_category(rows, name, lexicons, out="_category", wanted=F.col(category) == "")
        guesses.append((category, "_category"))
    inferred = [
        F.when(
            F.col(column) == "",
            F.struct(
                F.lit(column).alias("field"), F.col(f"{guess}.value").alias("value"), F.col(f"{guess}.confidence").alias("confidence"),
                F.col(f"{guess}.tier").alias("tier"), F.col(f"{guess}.label").alias("label"),
            ),
        )
        for column, guess in guesses
    ]
    empty = F.array().cast("array<struct<field:string,value:string,confidence:int,tier:int,label:string>>")
    rows = rows.withColumn("inferences", F.filter(F.array(*inferred), lambda x: x.isNotNull()) if inferred else empty)
    if write:
        for column, guess in guesses:
            values[column] = F.when(F.col(column) == "", F.col(f"{guess}.value")).otherwise(F.col(column))
    rows = rows.withColumns(values) if values else rows
    return rows.withColumns(
        {
            "has_corrections": F.exists("validations", lambda v: v["was_changed"]),
            "has_invalid_fields": F.exists("validations", lambda v: ~v["is_valid"]),
            "has_inferences": F.size("inferences") > 0,
        }
    ).drop("_gender", "_category", *[f"_{rule}" for rule, _ in active])


def record_counters(processed: DataFrame) -> DataFrame:
    def determined(field: str) -> Column:
        return F.count_if(F.exists("inferences", lambda i: (i["field"] == field) & (i["value"] != "")))

    return processed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("has_corrections").alias("corrected"),
        F.count_if("has_invalid_fields").alias("invalid"),
        determined("gender").alias("inferred_gender"),
        determined("category").alias("inferred_category"),
    )
