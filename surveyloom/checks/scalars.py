"""Checks of the scalar functions (FN) and the row-wise corrections built on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.checks import sql as S
from surveyloom.checks.fixtures import derived, fixture, table
from surveyloom.checks.registry import check
from surveyloom.functions import codes, jobcard, numeric, phone, similarity, temporal, text
from surveyloom.operators import cells
from surveyloom.operators.rules import SOCIAL_CATEGORIES, nearest_allowed
from surveyloom.sources.manifest import checksum
from surveyloom.sources.tables import spread

AS_OF = "2026-01-01 00:00:00"
Pair = tuple[Callable[[], Column], str]


def scalar(key: str, source: str, /, **columns: Pair) -> None:
    """A check that computes the named expressions for every row of a derived table."""
    body = ", ".join(f"{expr} AS {name}" for name, (_, expr) in columns.items())

    def query(spark, sf_dir) -> DataFrame:
        return fixture(spark, sf_dir, source).select("row_id", *[build().alias(name) for name, (build, _) in columns.items()])

    check(key, f"WITH {derived(source)} SELECT row_id, {body} FROM {source}")(query)


def _c(name: str) -> Column:
    return F.col(name)


scalar(
    "fn_1_clean_val", "survey",
    key=(lambda: text.clean_val(_c("unique_key")), S.clean("unique_key")),
    district=(lambda: text.clean_val(_c("district")), S.clean("district")),
)
scalar(
    "fn_2_null_handling", "survey",
    cleaned=(lambda: cells.clean_cell(_c("category"), ["handle_nulls"])["cleaned"], f"CASE WHEN {S.blank('category')} THEN '' ELSE category END"),
    is_null=(lambda: cells.clean_cell(_c("category"), ["handle_nulls"])["null_handled"], S.blank("category")),
)
scalar(
    "fn_3_whitespace", "survey",
    cleaned=(lambda: cells.clean_cell(_c("person_name"), ["trim"])["cleaned"], S.squeeze("person_name")),
    trimmed=(lambda: cells.clean_cell(_c("person_name"), ["trim"])["trimmed"], f"{S.squeeze('person_name')} <> person_name"),
)
scalar(
    "fn_4_lower_case", "survey",
    cleaned=(lambda: cells.clean_cell(_c("person_name"), ["normalize_case"])["cleaned"], "lower(person_name)"),
    changed=(lambda: cells.clean_cell(_c("person_name"), ["normalize_case"])["case_normalized"], "lower(person_name) <> person_name"),
)
scalar(
    "fn_5_first_last_token", "survey",
    first_token=(lambda: text.first_token(_c("person_name")), S.first("person_name")),
    last_token=(lambda: text.last_token(_c("person_name")), S.last("person_name")),
    guardian_first=(lambda: text.first_token(_c("guardian_name")), S.first("guardian_name")),
)
scalar(
    "fn_6_extract_first", "survey",
    person=(lambda: text.extract_first(_c("person_name")), S.extract_first("person_name")),
    guardian=(lambda: text.extract_first(_c("guardian_name")), S.extract_first("guardian_name")),
)
scalar("fn_7_proper_case", "survey", name=(lambda: text.proper_case(_c("person_name")), S.proper("person_name")))
scalar("fn_8_proper_case_quick", "survey", name=(lambda: text.proper_case(_c("person_name"), quick=True), S.proper_quick("person_name")))
scalar(
    "fn_9_change_type", "survey",
    person=(lambda: text.change_type(_c("person_name")), S.change_type("person_name")),
    category=(lambda: F.when(~text.is_blank(_c("category")), text.change_type(_c("category"))), f"CASE WHEN NOT {S.blank('category')} THEN {S.change_type('category')} END"),
)
scalar("fn_11_title_case", "survey", name=(lambda: text.title_case(_c("person_name")), S.title("person_name")))
scalar("fn_12_upper_trim", "survey", district=(lambda: F.upper(text.strip(_c("district"))), "upper(trim(district))"))
scalar("fn_13_clean_mobile", "survey", mobile=(lambda: phone.clean_mobile(_c("contact_number")), "right(regexp_replace(contact_number, '[^0-9]', '', 'g'), 10)"))
scalar("fn_14_gender_code", "survey", code=(lambda: codes.normalise_gender(_c("gender")), S.norm_gender("gender")))
scalar("fn_15_category_code", "survey", code=(lambda: codes.normalise_category(_c("category")), S.norm_category("category")))
scalar(
    "fn_16_export_gender", "survey",
    label=(
        lambda: codes.export_gender(_c("gender")),
        "CASE lower(trim(gender)) WHEN 'm' THEN 'Male' WHEN 'male' THEN 'Male' WHEN 'f' THEN 'Female' WHEN 'female' THEN 'Female' "
        "WHEN 't' THEN 'Transgender' WHEN 'transgender' THEN 'Transgender' WHEN 'other' THEN 'Other' ELSE gender END",
    ),
)
scalar(
    "fn_17_export_category", "survey",
    label=(
        lambda: codes.export_category(_c("category")),
        "CASE lower(trim(category)) WHEN 'sc' THEN 'SC' WHEN 'st' THEN 'ST' WHEN 'obc' THEN 'OBC' WHEN 'general' THEN 'General' "
        "WHEN 'gen' THEN 'General' WHEN 'nt' THEN 'NT' WHEN 'sbc' THEN 'SBC' ELSE category END",
    ),
)
scalar(
    "fn_18_surrogate_key", "survey",
    key=(
        lambda: codes.surrogate_key(_c("person_name"), _c("village"), _c("submission_date")),
        S.surrogate("person_name", "village", "submission_date"),
    ),
)
scalar(
    "fn_19_phonetic_key", "survey",
    first_key=(lambda: text.phonetic_key(text.first_token(_c("person_name"))), S.phonetic(S.first("person_name"))),
    last_key=(lambda: text.phonetic_key(text.last_token(_c("person_name"))), S.phonetic(S.last("person_name"))),
)
_A, _B = S.first("person_name"), S.last("person_name")
scalar(
    "fn_20_edit_distance", "survey",
    distance=(
        lambda: similarity.edit_distance(text.first_token(_c("person_name")), text.last_token(_c("person_name"))).cast("long"),
        f"CASE WHEN abs(length({_A}) - length({_B})) > 3 THEN abs(length({_A}) - length({_B})) ELSE levenshtein({_A}, {_B}) END",
    ),
)


@check(
    "fn_21_sequence_ratio",
    f"""WITH RECURSIVE {derived('survey')}, toks AS (SELECT DISTINCT {_A} AS a, {_B} AS b FROM survey),
 {S.ratio('SELECT a, b FROM toks UNION SELECT b, a FROM toks')}
 SELECT t.a, t.b, round(x.ratio, 9) AS forward, round(y.ratio, 9) AS backward FROM toks t
 JOIN ratios x ON x.a = t.a AND x.b = t.b JOIN ratios y ON y.a = t.b AND y.b = t.a""",
)
def sequence_ratio(spark, sf_dir):
    pairs = fixture(spark, sf_dir, "survey").select(
        text.first_token(_c("person_name")).alias("a"), text.last_token(_c("person_name")).alias("b")
    ).distinct()
    return pairs.select(
        "a", "b",
        F.round(similarity.sequence_ratio("a", "b"), 9).alias("forward"),
        F.round(similarity.sequence_ratio("b", "a"), 9).alias("backward"),
    )


_CONF = "CAST(row_id % 101 AS INTEGER)"
scalar(
    "fn_22_confidence_label", "survey",
    label=(lambda: codes.confidence_label((_c("row_id") % 101).cast("int")), S.label(_CONF)),
)
scalar(
    "fn_23_confidence_band", "survey",
    band=(
        lambda: codes.confidence_band((_c("row_id") % 101).cast("int")),
        f"CASE WHEN {_CONF} >= 90 THEN 'green' WHEN {_CONF} >= 75 THEN 'yellow' WHEN {_CONF} >= 60 THEN 'orange' ELSE 'red' END",
    ),
)
scalar(
    "fn_24_review_id_and_flags", "survey",
    review_id=(
        lambda: codes.review_id(_c("row_id"), _c("person_name")),
        f"CASE WHEN {S.extract_first('person_name')} = '' THEN '' ELSE 'GREV-' || (row_id + 2) || '-' || {S.extract_first('person_name')} END",
    ),
    flags=(
        lambda: codes.code_list((text.is_blank(_c("gender")), "blank_gender"), (text.is_blank(_c("category")), "blank_category")),
        f"concat_ws(', ', CASE WHEN {S.blank('gender')} THEN 'blank_gender' END, CASE WHEN {S.blank('category')} THEN 'blank_category' END)",
    ),
)


def _repair(key: str, ctes: str, name: str, build: Callable[[], Column]) -> None:
    @check(key, f"WITH {derived('survey')}, {ctes} SELECT * FROM {name}")
    def query(spark, sf_dir):
        return fixture(spark, sf_dir, "survey").select("row_id", build().alias("_r")).select("row_id", "_r.*")


_repair("fn_25_contact", S.contact("survey", "contact_number"), "contact", lambda: phone.validate_contact(_c("contact_number")))
_repair(
    "fn_26_contact_quick", S.contact("survey", "contact_number", quick=True), "contact",
    lambda: phone.validate_contact(_c("contact_number"), quick=True),
)
_repair("fn_27_job_card", S.card("survey", "job_card"), "card", lambda: jobcard.validate_card(_c("job_card")))


@check(
    "fn_28_card_diagnosis",
    f"WITH {derived('survey')}, {S.card('survey', 'job_card')} SELECT row_id, reason FROM card WHERE NOT is_valid",
)
def card_diagnosis(spark, sf_dir):
    rows = fixture(spark, sf_dir, "survey").where(~jobcard.validate_card(_c("job_card"))["is_valid"])
    return rows.select("row_id", jobcard.diagnose(F.upper(text.strip(_c("job_card")))).alias("reason"))


scalar(
    "fn_29_card_quick", "survey",
    is_valid=(lambda: jobcard.check_card(_c("job_card"))["is_valid"], f"({S.card_quick('job_card')}) IS NULL"),
    issue_type=(lambda: jobcard.check_card(_c("job_card"))["issue_type"], S.card_quick("job_card")),
)


def _stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _sql_stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


scalar(
    "fn_30_parse_date", "survey",
    submitted=(lambda: _stamp(temporal.parse_date(_c("submission_date"))), _sql_stamp(S.date("submission_date"))),
    surveyed=(lambda: _stamp(temporal.parse_date(_c("survey_date"))), _sql_stamp(S.date("survey_date"))),
)
scalar(
    "fn_31_parse_date_day_first", "survey",
    surveyed=(lambda: _stamp(temporal.parse_date(_c("survey_date"), day_first=True)), _sql_stamp(S.date("survey_date", day_first=True))),
)
scalar(
    "fn_32_date_validity", "survey",
    issue=(lambda: temporal.date_issue(_c("survey_date"), F.lit(AS_OF).cast("timestamp")), S.date_issue("survey_date", AS_OF)),
)
scalar("fn_33_age_validity", "survey", issue=(lambda: numeric.age_issue(_c("age")), S.age_issue("age")))
scalar("fn_34_land_validity", "survey", issue=(lambda: numeric.land_issue(_c("land_area")), S.land_issue("land_area")))
scalar("fn_35_to_float", "survey", area=(lambda: numeric.to_float(_c("land_area")), S.number("land_area")))
scalar(
    "fn_36_format_date", "survey",
    day=(lambda: temporal.format_ddmmyyyy(_c("survey_date")), f"strftime({S.date('survey_date')}, '%d/%m/%Y')"),
)


@check(
    "fn_37_pii_patterns",
    "SELECT doc_id, "
    + ", ".join(f"regexp_matches(text, {S.q(p)}) AS {k}, len(regexp_extract_all(text, {S.q(p)})) AS n_{k}" for k, p in text.PII_PATTERNS.items())
    + " FROM documents",
)
def pii_patterns(spark, sf_dir):
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    counts = [text.pii_hits(_c("text"), k).cast("long").alias(f"n_{k}") for k in text.PII_PATTERNS]
    flags = [(_c(f"n_{k}") > 0).alias(k) for k in text.PII_PATTERNS]
    return documents.select("doc_id", *counts).select("*", *flags)


@check("fn_38_checksum", "SELECT doc_id, 'sha256:' || left(sha256(text), 16) AS checksum FROM documents")
def file_checksum(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", checksum(_c("text").cast("binary")).alias("checksum"))


@check(
    "fn_39_nearest_allowed",
    f"""WITH RECURSIVE {derived('household')}, bad AS (SELECT DISTINCT social_category AS value FROM household
   WHERE social_category <> '' AND social_category NOT IN {S.in_list(SOCIAL_CATEGORIES)}),
 opts AS {S.values(list(enumerate(dict.fromkeys(SOCIAL_CATEGORIES))), 'place, allowed')},
 {S.ratio('SELECT lower(allowed) AS a, lower(value) AS b FROM bad, opts')}
 SELECT value, CASE WHEN ratio > 0.6 THEN allowed END AS suggestion, round(ratio, 6) AS ratio FROM bad, opts JOIN ratios ON a = lower(allowed) AND b = lower(value)
 QUALIFY row_number() OVER (PARTITION BY value ORDER BY ratio DESC, place) = 1""",
)
def nearest_allowed_value(spark, sf_dir):
    household = fixture(spark, sf_dir, "household")
    bad = household.where((_c("social_category") != "") & ~_c("social_category").isin(*SOCIAL_CATEGORIES))
    return nearest_allowed(bad, "social_category", SOCIAL_CATEGORIES)


def _melted(columns, value: str, where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT row_id, '{c}' AS \"column\", {c} AS {value} FROM survey WHERE {where}" for c in columns)


_NAMES = ("person_name", "guardian_name")


@check(
    "fn_10_case_issues",
    f"""WITH {derived('survey')}, m AS ({_melted(_NAMES, 'v')}) SELECT row_id, "column", trim(v) AS name,
 CASE WHEN trim(v) = upper(trim(v)) THEN 'All uppercase' ELSE 'All lowercase' END AS issue, {S.proper('v')} AS suggested
 FROM m WHERE length(trim(v)) > 2 AND (trim(v) = upper(trim(v))) <> (trim(v) = lower(trim(v)))""",
)
def case_issues(spark, sf_dir):
    return cells.case_issues(fixture(spark, sf_dir, "survey"), "row_id", _NAMES)


@check(
    "inf_10_name_formatting",
    f"""WITH {derived('survey')}, m AS ({_melted(_NAMES, 'v')}) SELECT row_id, "column", trim(v) AS original, {S.proper('v')} AS formatted,
 {S.change_type('v')} AS change_type FROM m WHERE NOT {S.blank('v')} AND {S.proper('v')} <> trim(v)""",
)
def name_formatting(spark, sf_dir):
    return cells.name_changes(fixture(spark, sf_dir, "survey"), "row_id", _NAMES)


@check(
    "prj_5_name_columns",
    f"""WITH {derived('survey')}, m AS ({_melted(_NAMES, 'v')}) SELECT "column",
 count(*) FILTER (trim(v) = upper(trim(v)) AND trim(v) <> lower(trim(v))) AS all_upper, count(*) FILTER (trim(v) = lower(trim(v)) AND trim(v) <> upper(trim(v))) AS all_lower
 FROM m WHERE length(trim(v)) > 2 GROUP BY "column" """,
)
def name_column_choice(spark, sf_dir):
    issues = cells.case_issues(fixture(spark, sf_dir, "survey"), "row_id")
    return issues.groupBy("column").agg(
        F.count_if(_c("issue") == "All uppercase").alias("all_upper"), F.count_if(_c("issue") == "All lowercase").alias("all_lower")
    )


def _checked(key: str, ctes: str, name: str, run, extra: str = "") -> None:
    sql = f"""WITH {derived('survey')}, {ctes}
 SELECT row_id, 'corrected' AS kind, original, corrected, reason FROM {name} WHERE is_valid AND was_changed
 UNION ALL SELECT row_id, 'issue', original, NULL, reason FROM {name} WHERE NOT is_valid AND original <> ''"""

    @check(key, sql)
    def query(spark, sf_dir):
        result = run(fixture(spark, sf_dir, "survey"))
        corrected = result.corrections.select("row_id", F.lit("corrected").alias("kind"), "original", "corrected", "reason")
        return corrected.unionByName(
            result.issues.select(
                "row_id", F.lit("issue").alias("kind"), "original", F.lit(None).cast("string").alias("corrected"), _c("issue").alias("reason")
            )
        )


_checked("inf_11_contacts", S.contact("survey", "contact_number"), "contact", lambda df: cells.correct_contacts(df, "contact_number"))
_checked("inf_12_job_cards", S.card("survey", "job_card"), "card", lambda df: cells.correct_cards(df, "job_card"))

_CLEANED = ("person_name", "guardian_name", "category", "district")
_CELL = f"""cell AS (SELECT row_id, "column", v AS original, CASE WHEN {S.blank('v')} THEN '' ELSE lower({S.squeeze('v')}) END AS cleaned,
 {S.blank('v')} AS n, coalesce(NOT {S.blank('v')} AND {S.squeeze('v')} <> v, false) AS t, coalesce(NOT {S.blank('v')} AND lower({S.squeeze('v')}) <> {S.squeeze('v')}, false) AS k FROM m)"""


@check(
    "inf_13_cell_cleaning",
    f"""WITH {derived('survey')}, m AS ({_melted(_CLEANED, 'v')}), {_CELL} SELECT row_id, "column", original, cleaned,
 concat_ws(',', CASE WHEN n THEN 'null_handled' END, CASE WHEN t THEN 'trimmed' END, CASE WHEN k THEN 'case_normalized' END) AS operations
 FROM cell WHERE original IS DISTINCT FROM cleaned""",
)
def cell_cleaning(spark, sf_dir):
    return cells.cleaning_changes(cells.cleaned_cells(fixture(spark, sf_dir, "survey"), "row_id", _CLEANED))


@check(
    "agg_11_cleaning_stats",
    f"""WITH {derived('survey')}, m AS ({_melted(_CLEANED, 'v')}), {_CELL} SELECT count(*) AS total_cells_processed,
 count(*) FILTER (original IS DISTINCT FROM cleaned) AS cells_cleaned, count(*) FILTER (n) AS null_values_found,
 count(*) FILTER (t) AS whitespace_fixed, count(*) FILTER (k) AS case_normalized FROM cell""",
)
def cleaning_stats(spark, sf_dir):
    return cells.cleaning_stats(cells.cleaned_cells(fixture(spark, sf_dir, "survey"), "row_id", _CLEANED))


@check(
    "prj_3_text_columns",
    f"""WITH m AS (SELECT 'c_name' AS "column", c_name AS v FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer)
 SELECT "column", count(*) AS n, count(*) FILTER (lower({S.squeeze('v')}) <> v) AS changed FROM m GROUP BY "column" """,
)
def text_column_choice(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    found = cells.cleaned_cells(customer, "c_custkey", cells.text_columns(customer))
    return found.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"))


@check(
    "agg_12_name_stats",
    f"""WITH {derived('survey')}, m AS ({_melted(_NAMES, 'v')}) SELECT {S.change_type('v')} AS change_type, count(*) AS processed,
 count(*) FILTER ({S.proper_quick('v')} <> trim(v)) AS changed FROM m WHERE NOT {S.blank('v')} GROUP BY 1""",
)
def name_stats(spark, sf_dir):
    return cells.name_stats(fixture(spark, sf_dir, "survey"), "row_id", _NAMES)


def _stats_sql(name: str) -> str:
    return f"""SELECT count(*) AS total_records, count(*) FILTER (original = '') AS blank, count(*) FILTER (original <> '' AND is_valid) AS valid,
 count(*) FILTER (is_valid AND was_changed) AS auto_corrected, count(*) FILTER (original <> '' AND NOT is_valid) AS invalid,
 count(*) FILTER (original <> '') AS filled,
 round(count(*) FILTER (original <> '' AND is_valid)::DOUBLE / greatest(count(*) FILTER (original <> ''), 1) * 100, 1) AS validation_rate_pct FROM {name}"""


@check("agg_9_contact_stats", f"WITH {derived('survey')}, {S.contact('survey', 'contact_number')} {_stats_sql('contact')}")
def contact_stats(spark, sf_dir):
    return cells.contact_stats(fixture(spark, sf_dir, "survey"), "contact_number")


@check("agg_9_contact_stats_quick", f"WITH {derived('survey')}, {S.contact('survey', 'contact_number', quick=True)} {_stats_sql('contact')}")
def contact_stats_quick(spark, sf_dir):
    return cells.contact_stats(fixture(spark, sf_dir, "survey"), "contact_number", quick=True)


@check("agg_10_card_stats", f"WITH {derived('survey')}, {S.card('survey', 'job_card')} {_stats_sql('card')}")
def card_stats(spark, sf_dir):
    return cells.card_stats(fixture(spark, sf_dir, "survey"), "job_card")


@check(
    "agg_10_card_stats_quick",
    f"""WITH {derived('survey')}, k AS (SELECT {S.blank('job_card')} AS b, {S.card_quick('job_card')} AS i FROM survey) SELECT count(*) AS total_processed,
 count(*) FILTER (b) AS blank, count(*) FILTER (NOT b AND i IS NULL) AS valid, count(*) FILTER (NOT b AND i IS NOT NULL) AS invalid,
 count(*) FILTER (NOT b AND i = 'wrong_state') AS wrong_state, count(*) FILTER (NOT b AND i = 'wrong_format') AS wrong_format FROM k""",
)
def card_stats_quick(spark, sf_dir):
    return cells.card_stats_quick(fixture(spark, sf_dir, "survey"), "job_card")


def _issues_sql(checks: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT row_id, '{c}' AS \"column\", {c} AS value, {issue} AS issue_type FROM survey WHERE ({issue}) IS NOT NULL" for c, issue in checks
    )


def _counts_sql(checks: list[tuple[str, str]]) -> str:
    body = " UNION ALL ".join(f"SELECT coalesce({issue}, 'valid') AS issue_type FROM survey" for _, issue in checks)
    return f"SELECT issue_type, count(*) AS n FROM ({body}) GROUP BY issue_type"


_DATE_SQL = [
    ("survey_date", S.date_issue("survey_date", AS_OF)), ("submission_date", S.date_issue("submission_date", AS_OF)), ("age", S.age_issue("age")),
]


def _date_checks(df):
    return cells.date_age_checks(df, ["survey_date", "submission_date"], ["age"], F.lit(AS_OF).cast("timestamp"))


@check("inf_14_date_age_issues", f"WITH {derived('survey')} {_issues_sql(_DATE_SQL)}")
def date_age_issues(spark, sf_dir):
    survey = fixture(spark, sf_dir, "survey")
    return cells.check_issues(survey, _date_checks(survey))


@check("agg_13_date_age_counts", f"WITH {derived('survey')} {_counts_sql(_DATE_SQL)}")
def date_age_counts(spark, sf_dir):
    survey = fixture(spark, sf_dir, "survey")
    return cells.check_stats(survey, _date_checks(survey))


_LAND_SQL = [("land_area", S.land_issue("land_area"))]


@check("inf_15_land_issues", f"WITH {derived('survey')} {_issues_sql(_LAND_SQL)}")
def land_issues(spark, sf_dir):
    survey = fixture(spark, sf_dir, "survey")
    return cells.check_issues(survey, cells.land_checks(survey, ["land_area"]))


@check("agg_14_land_counts", f"WITH {derived('survey')} {_counts_sql(_LAND_SQL)}")
def land_counts(spark, sf_dir):
    survey = fixture(spark, sf_dir, "survey")
    return cells.check_stats(survey, cells.land_checks(survey, ["land_area"]))


_AUTO_LAND = [("survey_date", S.land_issue("survey_date")), *_LAND_SQL]


@check(
    "prj_4_land_columns",
    f'WITH {derived("survey")} SELECT "column", count(*) AS n FROM ({_issues_sql(_AUTO_LAND)}) GROUP BY "column"',
)
def land_column_choice(spark, sf_dir):
    survey = fixture(spark, sf_dir, "survey")
    return cells.check_issues(survey, cells.land_checks(survey)).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
