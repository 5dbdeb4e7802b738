"""Checks of schema rules, export and file lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.checks import sql as S
from surveyloom.checks.fixtures import derived, fixture, table
from surveyloom.checks.registry import check
from surveyloom.operators import export, lifecycle, rules
from surveyloom.operators.rules import HOUSEHOLD_SCHEMA, SOCIAL_CATEGORIES, SOCIAL_CATEGORIES_SHORT
from surveyloom.plans.profile import profile
from surveyloom.session import scratch_path
from surveyloom.sources.inspect import file_heads, inspect_files
from surveyloom.sources.manifest import checksum
from surveyloom.sources.sinks import write_texts
from surveyloom.sources.tables import list_files, spread

HOUSEHOLD = derived("household")


def household(spark, sf_dir):
    return fixture(spark, sf_dir, "household")


# ---- schema rules --------------------------------------------------------------------------

_PRESENT = (
    "household_id", "family_head_name", "social_category", "state_code", "district_code", "latitude", "land_holding_acres",
    "irrigation_source", "ifsc_code", "shg_member", "shg_name", "mobile_number", "aadhaar_number",
)


def _num(c: str) -> str:
    return f"try_cast(trim({c}) AS DOUBLE)"


def _predicates() -> list[tuple[str, str, str, str]]:
    """(type, severity, field, SQL condition) of the row rules that apply to the fixture."""
    out = [
        ("NULL_IN_REQUIRED_FIELD", "HIGH", f, S.blank(f))
        for f in ("household_id", "family_head_name", "social_category", "state_code", "district_code", "latitude", "shg_member")
    ]
    out += [
        ("TYPE_MISMATCH", "MEDIUM", f, f"{f} IS NOT NULL AND {_num(f)} IS NULL")
        for f in ("state_code", "district_code", "latitude", "land_holding_acres")
    ]
    patterns = {
        "household_id": "HH[A-Z]{2}[0-9]{8}", "ifsc_code": "[A-Z]{4}0[A-Z0-9]{6}", "mobile_number": "[6-9][0-9]{9}", "aadhaar_number": "[0-9]{12}",
    }
    out += [("PATTERN_MISMATCH", "HIGH", f, f"{f} <> '' AND NOT regexp_full_match({f}, '{p}')") for f, p in patterns.items()]
    enums = {
        "social_category": SOCIAL_CATEGORIES, "irrigation_source": ("CANAL", "TUBEWELL", "WELL", "TANK", "RAINFED", "OTHER"), "shg_member": ("YES", "NO"),
    }
    out += [("INVALID_ENUM_VALUE", "MEDIUM", f, f"{f} <> '' AND {f} NOT IN {S.in_list(v)}") for f, v in enums.items()]
    out += [("MAX_LENGTH_EXCEEDED", "LOW", f, f"length({f}) > 100") for f in ("family_head_name", "shg_name")]
    out += [
        ("BUSINESS_RULE_VIOLATION", "MEDIUM", "shg_name", f"shg_member = 'YES' AND {S.blank('shg_name')}"),
        ("DATA_INCONSISTENCY", "LOW", "irrigation_source", f"{_num('land_holding_acres')} > 0 AND irrigation_source IS NULL"),
    ]
    for f in ("state_code", "district_code"):
        out += [
            ("INVALID_LGD_CODE_TYPE", "HIGH", f, f"{f} IS NOT NULL AND {_num(f)} IS NULL"),
            ("INVALID_LGD_CODE_RANGE", "MEDIUM", f, f"{_num(f)} <= 0"),
        ]
    return out


_SPILL = [
    ("PII_SPILLOVER", "MEDIUM", f, rf"regexp_matches({f}, '\b[0-9]{{12}}\b')")
    for f in (
        "household_id", "social_category", "state_code", "district_code", "latitude", "land_holding_acres", "irrigation_source", "ifsc_code",
        "shg_member", "shg_name", "remarks",
    )
]
_DUPLICATES = """SELECT 'DUPLICATE_AADHAAR' AS type, 'CRITICAL' AS severity, 'aadhaar_number' AS field, count(*) AS n FROM (SELECT row_id FROM household
 WHERE aadhaar_number <> '' QUALIFY row_number() OVER (PARTITION BY aadhaar_number ORDER BY row_id) > 1) HAVING count(*) > 0"""


def _counts(items) -> str:
    return " UNION ALL ".join(
        f"SELECT {S.q(t)} AS type, {S.q(s)} AS severity, {S.q(f)} AS field, count(*) AS n FROM household WHERE {c} HAVING count(*) > 0" for t, s, f, c in items
    )


def _all_rules(df):
    schema = HOUSEHOLD_SCHEMA
    return rules.field_rules(df, schema) + rules.cross_field_rules(df) + rules.code_rules(df, schema) + rules.spillover_rules(df, schema, "row_id")


_RULE_KEYS = {
    "val_3_null_in_required": "NULL_IN_REQUIRED_FIELD",
    "val_4_type_mismatch": "TYPE_MISMATCH",
    "val_6_pattern_mismatch": "PATTERN_MISMATCH",
    "val_7_enum_values": "INVALID_ENUM_VALUE",
    "val_8_max_length": "MAX_LENGTH_EXCEEDED",
    "val_9_group_member_without_group": "BUSINESS_RULE_VIOLATION",
    "val_11_land_without_irrigation": "DATA_INCONSISTENCY",
    "val_12_code_type": "INVALID_LGD_CODE_TYPE",
    "val_13_code_range": "INVALID_LGD_CODE_RANGE",
    "val_17_pii_spillover": "PII_SPILLOVER",
}


def _by_type(kind: str):
    def query(spark, sf_dir):
        df = household(spark, sf_dir)
        return rules.issue_counts(df, [r for r in _all_rules(df) if r.type == kind])

    return query


for _key, _type in _RULE_KEYS.items():
    check(_key, f"WITH {HOUSEHOLD} {_counts([p for p in _predicates() + _SPILL if p[0] == _type])}")(_by_type(_type))


@check("agg_24_nulls_per_required_field", f"WITH {HOUSEHOLD} {_counts([p for p in _predicates() if p[0] == 'NULL_IN_REQUIRED_FIELD'])}")
def nulls_per_required(spark, sf_dir):
    df = household(spark, sf_dir)
    return rules.issue_counts(df, [r for r in rules.field_rules(df, HOUSEHOLD_SCHEMA) if r.type == "NULL_IN_REQUIRED_FIELD"])


_DATE_FIELD = (rules.FieldRule("survey_date", "date"), rules.FieldRule("submission_date", "date"))


@check(
    "val_5_date_format",
    f"WITH {derived('survey')} "
    + " UNION ALL ".join(
        f"SELECT 'INVALID_DATE_FORMAT' AS type, 'MEDIUM' AS severity, '{f}' AS field, count(*) AS n FROM survey WHERE NOT {S.blank(f)} AND {S.date(f, day_first=True)} IS NULL HAVING count(*) > 0"
        for f in ("survey_date", "submission_date")
    ),
)
def date_format(spark, sf_dir):
    df = fixture(spark, sf_dir, "survey")
    return rules.issue_counts(df, rules.field_rules(df, _DATE_FIELD))


@check("val_10_duplicate_id", f"WITH {HOUSEHOLD} {_DUPLICATES}")
def duplicate_id(spark, sf_dir):
    issues = rules.validate_table(household(spark, sf_dir), evidence=False)
    return issues.where(F.col("type") == "DUPLICATE_AADHAAR")


def _column_sql(name: str, present) -> str:
    have = set(present)
    sections = {s.section for s in HOUSEHOLD_SCHEMA if s.name in have}
    rows = [("INCOMPLETE_SCHEMA", "HIGH", "")] if {"baseline", "geo"} - sections else []
    rows += [("MISSING_REQUIRED_FIELD", "CRITICAL", s.name) for s in HOUSEHOLD_SCHEMA if s.required and s.name not in have]
    if not any(s.code and s.name in have for s in HOUSEHOLD_SCHEMA):
        rows.append(("LGD_VALIDATION_SKIPPED", "INFO", ""))
    exposed = [c for c in present if c in ("family_head_name", "bank_account_number", "mobile_number", "aadhaar_number")]
    if exposed:
        rows.append(("PII_COMPLIANCE", "MEDIUM", ", ".join(exposed)))
    return " UNION ALL ".join(
        f"SELECT {S.q(t)} AS type, {S.q(s)} AS severity, {S.q(f)} AS field, '{name}' AS table_name, (SELECT count(*) FROM {name}) AS table_rows" for t, s, f in rows
    )


@check(
    "val_1_2_14_16_18_column_rules",
    f"WITH {derived('household', 'survey')} {_column_sql('household', _PRESENT)} UNION ALL {_column_sql('survey', ())}",
)
def column_rules(spark, sf_dir):
    parts = []
    for name in ("household", "survey"):
        df = fixture(spark, sf_dir, name)
        size = df.agg(F.count(F.lit(1)).alias("table_rows")).withColumn("table_name", F.lit(name))
        issues = rules.column_issues(spark, df.columns, HOUSEHOLD_SCHEMA).withColumn("table_name", F.lit(name)).drop("n")
        parts.append(issues.join(size, "table_name"))
    return parts[0].unionByName(parts[1])


_ALL = f"{_counts(_predicates() + _SPILL)} UNION ALL {_DUPLICATES}"
_COLUMN_ROWS = f"SELECT type, severity, field, 0::BIGINT AS n FROM ({_column_sql('household', _PRESENT)})"


@check("agg_27_errors_and_warnings", f"""WITH {HOUSEHOLD}, i AS ({_ALL} UNION ALL {_COLUMN_ROWS}) SELECT CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' ELSE 'warning' END AS kind,
 count(*) AS issues, sum(n)::BIGINT AS row_hits FROM i GROUP BY 1""")
def errors_and_warnings(spark, sf_dir):
    return rules.issue_split(rules.validate_table(household(spark, sf_dir), evidence=False))


@check("set_2_all_issues", f"WITH {HOUSEHOLD} {_ALL} UNION ALL {_COLUMN_ROWS}")
def all_issues(spark, sf_dir):
    return rules.validate_table(household(spark, sf_dir), evidence=False)


_FOUND = " UNION ALL ".join(f"SELECT {S.q(t)} AS type, {S.q(f)} AS field, row_id FROM household WHERE {c}" for t, _, f, c in _predicates() if t != "MAX_LENGTH_EXCEEDED")


@check(
    "agg_25_first_rows",
    f"""WITH {HOUSEHOLD}, f AS ({_FOUND}) SELECT type, field, string_agg(row_id, ',' ORDER BY row_id) AS rows FROM (SELECT * FROM f
 QUALIFY row_number() OVER (PARTITION BY type, field ORDER BY row_id) <= 20) GROUP BY ALL""",
)
def first_rows(spark, sf_dir):
    df = household(spark, sf_dir)
    found = rules.violations(df, [r for r in _all_rules(df) if r.evidence == "rows"], "row_id")
    return rules.issue_rows(found).select("type", "field", F.array_join("rows", ",").alias("rows"))


_VALUES = " UNION ALL ".join(
    f"SELECT {S.q(t)} AS type, {S.q(f)} AS field, {f} AS value, min(row_id) AS row_id, {5 if t == 'INVALID_ENUM_VALUE' else 3} AS k FROM household WHERE {c} GROUP BY {f}{'' if t == 'INVALID_ENUM_VALUE' else ', row_id'}"
    for t, _, f, c in _predicates() if t in ("PATTERN_MISMATCH", "INVALID_ENUM_VALUE")
)


@check(
    "ord_6_sample_values",
    f"""WITH {HOUSEHOLD}, v AS ({_VALUES}) SELECT type, field, string_agg(value, '|' ORDER BY row_id) AS samples FROM (SELECT * FROM v
 QUALIFY row_number() OVER (PARTITION BY type, field ORDER BY row_id) <= k) GROUP BY ALL""",
)
def sample_values(spark, sf_dir):
    df = household(spark, sf_dir)
    found = rules.violations(df, [r for r in _all_rules(df) if r.evidence == "rows"], "row_id")
    return rules.issue_values(found).select("type", "field", F.array_join("samples", "|").alias("samples"))


_ALLOWED = [(s.name, i, a) for s in rules.HOUSEHOLD_SCHEMA for i, a in enumerate(dict.fromkeys(s.allowed or ()))]


@check(
    "fn_39_suggestions",
    f"""WITH RECURSIVE {HOUSEHOLD}, v AS ({_VALUES}), asked AS (SELECT type, field, arg_min(value, row_id) AS value FROM v GROUP BY ALL),
 opts AS {S.values(_ALLOWED, 'field, place, allowed')},
 {S.ratio('SELECT lower(allowed) AS a, lower(value) AS b FROM asked JOIN opts USING (field)')},
 near AS (SELECT type, field, allowed FROM asked JOIN opts USING (field) JOIN ratios ON a = lower(allowed) AND b = lower(value) WHERE ratio > 0.6
  QUALIFY row_number() OVER (PARTITION BY type, field ORDER BY ratio DESC, place) = 1),
 lists AS (SELECT field, string_agg(allowed, '|' ORDER BY place) AS listed FROM opts GROUP BY field),
 patterns AS {S.values([(s.name, s.pattern) for s in rules.HOUSEHOLD_SCHEMA if s.pattern], 'field, pattern')}
 SELECT type, field, coalesce(near.allowed, listed, pattern) AS suggestion,
  CASE WHEN near.allowed IS NOT NULL THEN 'nearest' WHEN listed IS NOT NULL THEN 'list' ELSE 'pattern' END AS suggested_from
 FROM asked LEFT JOIN near USING (type, field) LEFT JOIN lists USING (field) LEFT JOIN patterns USING (field)""",
)
def suggested_corrections(spark, sf_dir):
    issues = rules.validate_table(household(spark, sf_dir))
    return issues.where(F.col("suggestion").isNotNull()).select("type", "field", "suggestion", "suggested_from")


@check(
    "val_15_code_tuple",
    f"""WITH {HOUSEHOLD}, c AS (SELECT row_id, CASE WHEN coalesce(try_cast(state_code AS BIGINT), 0) <= 0 THEN 'state_code'
 WHEN coalesce(try_cast(district_code AS BIGINT), 0) <= 0 THEN 'district_code' END AS first_bad FROM household) SELECT row_id, first_bad IS NULL AS is_valid, first_bad FROM c""",
)
def code_tuple(spark, sf_dir):
    df = household(spark, sf_dir)
    return df.select("row_id", rules.code_tuple_check(["state_code", "district_code"]).alias("c")).select("row_id", "c.*")


@check(
    "val_7_enum_short_list",
    f"WITH {HOUSEHOLD} SELECT row_id, social_category FROM household WHERE social_category <> '' AND social_category NOT IN {S.in_list(SOCIAL_CATEGORIES_SHORT)}",
)
def enum_short_list(spark, sf_dir):
    df = household(spark, sf_dir)
    spec = rules.FieldRule("social_category", "enum", True, "baseline", allowed=SOCIAL_CATEGORIES_SHORT)
    rule = next(r for r in rules.field_rules(df, [spec]) if r.type == "INVALID_ENUM_VALUE")
    return df.where(rule.broken).select("row_id", "social_category")


_SAMPLED = " UNION ALL ".join(
    rf"""SELECT 'PII_SPILLOVER' AS type, 'MEDIUM' AS severity, '{f}' AS field, count(*) AS n FROM (SELECT {f} FROM household WHERE {f} IS NOT NULL ORDER BY row_id LIMIT 200)
 WHERE regexp_matches({f}, '^\b[0-9]{{12}}\b') HAVING count(*) > 0"""
    for _, _, f, _ in _SPILL
)


@check("val_17_pii_spillover_sampled", f"WITH {HOUSEHOLD} {_SAMPLED}")
def spillover_sampled(spark, sf_dir):
    return rules.spillover_sampled(household(spark, sf_dir), HOUSEHOLD_SCHEMA, "row_id")


_HEAD = f"{HOUSEHOLD.replace('household AS (', 'whole AS (', 1)}, household AS (SELECT * FROM whole ORDER BY row_id LIMIT 500)"


@check("flow_14_profile_on_arrival", f"WITH {_HEAD} {_ALL} UNION ALL {_COLUMN_ROWS}")
def profile_on_arrival(spark, sf_dir):
    return profile(household(spark, sf_dir))


def _household_files(spark, sf_dir) -> list[str]:
    """Three files of the household table, one of them packed, each in the order of row_id."""
    root, paths = scratch_path(spark, "households"), []
    for k, (codec, suffix) in enumerate((("none", ".csv"), ("gzip", ".csv.gz"), ("none", ".csv"))):
        part = household(spark, sf_dir).where(F.col("row_id") % 3 == k).repartitionByRange(1, "row_id").sortWithinPartitions("row_id")
        part.withColumnRenamed("row_id", "source_row").write.options(header=True, escape='"', compression=codec, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{root}/{k}")
        paths += [p for p in list_files(spark, f"{root}/{k}") if p.endswith(suffix)]
    return paths


@check(
    "src_3_file_heads",
    f"""WITH {HOUSEHOLD} SELECT CAST(row_id AS VARCHAR) AS source_row, nullif(household_id, '') AS household_id, latitude, (row_number() OVER w - 1)::BIGINT AS row_id FROM household
 WINDOW w AS (PARTITION BY row_id % 3 ORDER BY row_id) QUALIFY row_number() OVER w <= 40""",
)
def heads_of_files(spark, sf_dir):
    return file_heads(spark, _household_files(spark, sf_dir), ["source_row", "household_id", "latitude"], 40).drop("source_path")


# ---- export --------------------------------------------------------------------------------

_EXPORT_SOURCE = """SELECT row_id, person_name AS farmer_name, guardian_name AS father_spouse_name, national_id AS aadhaar_number, contact_number AS mobile_no, gender, category,
 survey_date AS date_of_birth, village, district, land_area, job_card AS mgnrega_id FROM survey"""
_GENDER_LABEL = (
    "CASE lower(trim(gender)) WHEN 'm' THEN 'Male' WHEN 'male' THEN 'Male' WHEN 'f' THEN 'Female' WHEN 'female' THEN 'Female' "
    "WHEN 't' THEN 'Transgender' WHEN 'transgender' THEN 'Transgender' WHEN 'other' THEN 'Other' ELSE gender END"
)
_CATEGORY_LABEL = (
    "CASE lower(trim(category)) WHEN 'sc' THEN 'SC' WHEN 'st' THEN 'ST' WHEN 'obc' THEN 'OBC' WHEN 'general' THEN 'General' "
    "WHEN 'gen' THEN 'General' WHEN 'nt' THEN 'NT' WHEN 'sbc' THEN 'SBC' ELSE category END"
)
_EXPORTED = f"""{derived('survey')}, src AS ({_EXPORT_SOURCE}), exported AS (SELECT row_id, {S.title('farmer_name')} AS beneficiary_name, {S.title('father_spouse_name')} AS guardian_name,
 aadhaar_number AS uid, right(regexp_replace(mobile_no, '[^0-9]', '', 'g'), 10) AS contact_number, {_GENDER_LABEL} AS gender, {_CATEGORY_LABEL} AS social_category,
 strftime({S.date('date_of_birth')}, '%d/%m/%Y') AS dob, {S.title('village')} AS village_name, NULL::VARCHAR AS block_name, {S.title('district')} AS district_name, NULL::VARCHAR AS state_name,
 try_cast(land_area AS DOUBLE) AS land_area_ha, mgnrega_id AS mgnrega_job_card FROM src)"""


def export_source(spark, sf_dir):
    s = fixture(spark, sf_dir, "survey")
    return s.select(
        "row_id", F.col("person_name").alias("farmer_name"), F.col("guardian_name").alias("father_spouse_name"),
        F.col("national_id").alias("aadhaar_number"), F.col("contact_number").alias("mobile_no"), "gender", "category",
        F.col("survey_date").alias("date_of_birth"), "village", "district", "land_area", F.col("job_card").alias("mgnrega_id"),
    )


FORMAT = export.BeneficiaryFormat()


@check("prj_1_field_mapping", f"WITH {_EXPORTED} SELECT * FROM exported")
def field_mapping(spark, sf_dir):
    return export.map_fields(export_source(spark, sf_dir), FORMAT.mapping(), keep=["row_id"])


@check(
    "prj_2_missing_required",
    f"WITH {_EXPORTED} SELECT 11::INTEGER AS mapped, 4::INTEGER AS unmapped, count(*) FILTER (block_name IS NULL) AS null_block, count(*) FILTER (state_name IS NULL) AS null_state FROM exported",
)
def missing_required(spark, sf_dir):
    df = export_source(spark, sf_dir)
    mapped, unmapped = export.mapping_counts(df.columns, FORMAT.mapping())
    return export.map_fields(df, FORMAT.mapping()).agg(
        F.lit(mapped).alias("mapped"), F.lit(unmapped).alias("unmapped"),
        F.count_if(F.col("block_name").isNull()).alias("null_block"), F.count_if(F.col("state_name").isNull()).alias("null_state"),
    )


_TARGETS = [m for m in FORMAT.mapping() if m.source not in ("bank_account", "ifsc_code")]


@check(
    "prj_7_mapping_table",
    f"WITH {_EXPORTED} "
    + " UNION ALL ".join(
        f"SELECT {S.q(m.source)} AS source, {S.q(m.target)} AS target, {str(m.required).lower()} AS required, {S.q(m.transform) if m.transform else 'NULL'} AS transform, count({m.target}) AS filled FROM exported"
        for m in _TARGETS
    ),
)
def mapping_table(spark, sf_dir):
    data = export.map_fields(export_source(spark, sf_dir), FORMAT.mapping())
    filled = data.agg(*[F.count(c).alias(c) for c in data.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("filled")) for c in data.columns])
    return export.mapping_table(spark, FORMAT.mapping()).join(F.broadcast(filled.select(F.inline(cells))), "target")


_REQUIRED = [m.target for m in FORMAT.mapping() if m.required]
_COMPLIANCE = " UNION ALL ".join(
    [
        f"""SELECT '{f}' AS field, 'missing_values' AS issue_type, CASE WHEN count(*) FILTER ({f} IS NULL) < count(*) * 0.1 THEN 'warning' ELSE 'critical' END AS severity,
 count(*) FILTER ({f} IS NULL) AS row_count FROM exported HAVING count(*) FILTER ({f} IS NULL) > 0"""
        for f in _REQUIRED
    ]
    + [
        "SELECT 'uid', 'invalid_format', 'critical', count(*) FROM exported WHERE NOT regexp_full_match(trim(uid), '[0-9]{12}') HAVING count(*) > 0",
        "SELECT 'gender', 'invalid_format', 'warning', count(*) FROM exported WHERE trim(lower(gender)) NOT IN ('male','female','transgender','other','m','f','t') HAVING count(*) > 0",
    ]
)


@check("val_23_24_25_export_compliance", f"WITH {_EXPORTED} {_COMPLIANCE}")
def export_compliance(spark, sf_dir):
    return export.export(export_source(spark, sf_dir), FORMAT).issues


@check(
    "val_22_missing_column",
    "WITH " + _EXPORTED + " SELECT field, 'missing_column' AS issue_type, 'critical' AS severity, 0::BIGINT AS row_count, (SELECT count(*) FROM src) AS table_rows FROM "
    + S.values([(t,) for t in _REQUIRED if t != "gender"], "field"),
)
def missing_column(spark, sf_dir):
    df = export_source(spark, sf_dir)
    size = df.agg(F.count(F.lit(1)).alias("table_rows")).withColumn("_one", F.lit(1))
    return export.missing_columns(df, FORMAT.mapping()).withColumn("_one", F.lit(1)).join(size, "_one").drop("_one")


@check("val_24_uid_samples", f"WITH {_EXPORTED} SELECT row_id, uid FROM exported WHERE NOT regexp_full_match(trim(uid), '[0-9]{{12}}') ORDER BY row_id LIMIT 3")
def uid_samples(spark, sf_dir):
    return export.uid_samples(export.map_fields(export_source(spark, sf_dir), FORMAT.mapping(), keep=["row_id"]))


@check(
    "flow_11_export",
    f"""WITH {_EXPORTED}, i AS ({_COMPLIANCE}), n AS (SELECT count(*) AS n FROM exported) SELECT 'beneficiary' AS format_name, n AS records_in, n AS records_out, 11::INTEGER AS fields_mapped,
 4::INTEGER AS fields_unmapped, (SELECT count(*) FROM i) + 11 AS compliance_checks, 11 - (SELECT count(*) FROM i WHERE severity = 'critical') AS compliance_passed FROM n""",
)
def export_summary(spark, sf_dir):
    return export.export(export_source(spark, sf_dir), FORMAT).summary


# ---- file lifecycle ------------------------------------------------------------------------

EVENTS = f"RECURSIVE {derived('file_events')}, {S.file_states()}"
_REGISTRY = """reg AS (SELECT file_name, arg_max(to_status, seq) AS status, min(seq) AS uploaded_seq, min("at") AS uploaded_at,
 CASE WHEN arg_max(action, seq) <> 'upload' THEN arg_max(actor, seq) END AS reviewed_by, CASE WHEN arg_max(action, seq) <> 'upload' THEN arg_max("at", seq) END AS reviewed_at,
 count(*) AS n_events FROM states WHERE is_legal GROUP BY file_name)"""


def states(spark, sf_dir):
    return lifecycle.apply_events(fixture(spark, sf_dir, "file_events"))


def registry(spark, sf_dir):
    return lifecycle.registry(states(spark, sf_dir))


@check("w_8_transition_legality", f"WITH {EVENTS} SELECT file_name, seq, action, from_status, to_status, is_legal FROM states")
def transition_legality(spark, sf_dir):
    return states(spark, sf_dir).select("file_name", "seq", "action", "from_status", "to_status", "is_legal")


@check("lif_2_transition_rules", f"WITH {EVENTS} SELECT action, from_status, to_status, is_legal, count(*) AS n FROM states GROUP BY ALL")
def transition_rules(spark, sf_dir):
    return states(spark, sf_dir).groupBy("action", "from_status", "to_status", "is_legal").agg(F.count(F.lit(1)).alias("n"))


@check("w_7_current_state", f"WITH {EVENTS}, {_REGISTRY} SELECT file_name, status, uploaded_seq, n_events FROM reg")
def current_state(spark, sf_dir):
    return registry(spark, sf_dir).select("file_name", "status", "uploaded_seq", "n_events")


_AT = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


@check(
    "lif_3_registry",
    f"WITH {EVENTS}, {_REGISTRY} SELECT file_name, status, {_AT.format(c='uploaded_at')}, reviewed_by, {_AT.format(c='reviewed_at')} FROM reg",
)
def full_registry(spark, sf_dir):
    return registry(spark, sf_dir).select(
        "file_name", "status", F.date_format("uploaded_at", "yyyy-MM-dd HH:mm:ss").alias("uploaded_at"), "reviewed_by",
        F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss").alias("reviewed_at"),
    )


@check(
    "flt_6_files_by_status",
    f"""WITH {EVENTS}, {_REGISTRY} SELECT 'waiting' AS list, file_name, status FROM reg WHERE status IN ('pending', 'held')
 UNION ALL SELECT 'rejected', file_name, status FROM reg WHERE status = 'rejected'""",
)
def files_by_status(spark, sf_dir):
    registered = registry(spark, sf_dir).select("file_name", "status")
    waiting = lifecycle.pending(registered, include_held=True)
    rejected = lifecycle.with_status(registered, "rejected")
    return waiting.select(F.lit("waiting").alias("list"), "*").unionByName(rejected.select(F.lit("rejected").alias("list"), "*"))


@check("ord_3_oldest_first", f"WITH {EVENTS}, {_REGISTRY} SELECT file_name, {_AT.format(c='uploaded_at')} FROM reg ORDER BY reg.uploaded_at, file_name")
def oldest_first(spark, sf_dir):
    ordered = lifecycle.oldest_first(registry(spark, sf_dir))
    return ordered.select("file_name", F.date_format("uploaded_at", "yyyy-MM-dd HH:mm:ss").alias("uploaded_at"))


@check(
    "agg_22_status_counts",
    f"WITH {EVENTS}, {_REGISTRY} SELECT count(*) AS total, "
    + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in lifecycle.STATES[1:])
    + """, count(*) FILTER (status IN ('approved', 'promoted')) AS in_verified, count(*) FILTER (status IN ('rejected', 'revoked')) AS in_unverified,
 count(*) FILTER (status IN ('pending', 'held')) AS needs_review FROM reg""",
)
def status_counts(spark, sf_dir):
    return lifecycle.status_counts(registry(spark, sf_dir))


@check("lif_4_audit_history", f"WITH {EVENTS} SELECT file_name, seq, action, actor AS by, from_status, to_status FROM states WHERE is_legal")
def audit_history(spark, sf_dir):
    return lifecycle.audit_history(states(spark, sf_dir)).drop("at")


@check(
    "lif_5_tiers",
    f"""WITH {EVENTS}, {_REGISTRY} SELECT file_name, CASE WHEN status IN ('approved', 'promoted') THEN 'verified' ELSE 'unverified' END AS tier FROM reg
 WHERE status IN ('approved', 'promoted', 'rejected', 'revoked')""",
)
def tiers(spark, sf_dir):
    return lifecycle.tiers(registry(spark, sf_dir))


# Uploads are the documents; a labelled document is registered already, a toxic one with other content.
_UPLOADS = """uploads AS (SELECT 'doc_' || doc_id || '.csv' AS file_name, 'sha256:' || left(sha256(text || chr(10)), 16) AS checksum FROM documents),
 registered AS (SELECT 'doc_' || doc_id || '.csv' AS file_name, CASE WHEN toxic = 1 THEN 'other' ELSE 'sha256:' || left(sha256(text || chr(10)), 16) END AS checksum
  FROM documents JOIN labels USING (doc_id))"""


@check(
    "lif_1_register_uploads",
    f"""WITH {_UPLOADS} SELECT u.file_name, u.checksum, CASE WHEN r.file_name IS NOT NULL THEN replace(u.file_name, '.csv', '_20260101_000000.csv') ELSE u.file_name END AS stored_name
 FROM uploads u LEFT JOIN registered r USING (file_name) WHERE r.checksum IS NULL OR r.checksum <> u.checksum""",
)
def register_uploads(spark, sf_dir):
    uploads, registered = uploads_and_registered(spark, sf_dir)
    stamped = uploads.withColumn("uploaded_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return lifecycle.new_uploads(stamped, registered).select("file_name", "checksum", "stored_name")


def uploads_and_registered(spark, sf_dir):
    """Uploads are files, one per document, hashed where they lie; some are registered, a few of these with other content."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("file_name")
    written = write_texts(spread(documents, "doc_id").select(name, "text"), scratch_path(spark, "uploads"))
    found = F.regexp_extract("path", r"(doc_-?[0-9]+\.csv)(?:/[^/]*)?$", 1).alias("file_name")
    uploads = inspect_files(spark, written, checksums=True).select(found, "checksum")
    labelled = documents.join(table(spark, sf_dir, "labels"), "doc_id")
    known = checksum(F.concat("text", F.lit("\n")).cast("binary"))
    return uploads, labelled.select(name, F.when(F.col("toxic") == 1, "other").otherwise(known).alias("checksum"))
