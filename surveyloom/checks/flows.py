"""Checks of sources, sinks, whole runs and streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from surveyloom.checks import sql as S
from surveyloom.checks.fixtures import derived, fixture
from surveyloom.checks.quality import _EXPORTED, FORMAT, export_source, uploads_and_registered
from surveyloom.checks.registry import check
from surveyloom.checks.scalars import AS_OF
from surveyloom.checks.tables import _CHANGES, _LIB, DATE, EVIDENCE, GUARDIAN, KEY, NAME, REAL, SURVEY, evidence
from surveyloom.operators import audit, export, library
from surveyloom.plans import batch, engines, learning, records
from surveyloom.plans.context import Context
from surveyloom.plans.survey import SurveyConfig, audit_tables, merged_table, review_table, run_summary, run_survey, write_run
from surveyloom.session import scratch_path, stage
from surveyloom.sources import manifest, sinks, tables
from surveyloom.streaming import folder

CONFIG = SurveyConfig(
    key=KEY, name=NAME, guardian=GUARDIAN, date=DATE, survey_date="survey_date", village="village", district="district",
    contact="contact_number", job_card="job_card", spell_columns=(NAME,),
)
SLIM = ("row_id", KEY, DATE, NAME, "gender", "category")


def survey(spark, sf_dir):
    return fixture(spark, sf_dir, "survey")


# ---- sources -------------------------------------------------------------------------------

_TEXT = ("row_id", KEY, DATE, NAME, GUARDIAN, "gender", "district")
_TEXT_SQL = f"WITH {SURVEY} SELECT CAST(row_id AS VARCHAR) AS row_id, unique_key, submission_date, person_name, guardian_name, nullif(gender, '') AS gender, district FROM survey"


def _delimited(spark, sf_dir, fmt: str) -> str:
    path = scratch_path(spark, f"survey-{fmt}")
    return sinks.write_table(survey(spark, sf_dir).select(*_TEXT), path, fmt)


@check("src_1_csv_scan", _TEXT_SQL)
def csv_scan(spark, sf_dir):
    return tables.read_csv(spark, _delimited(spark, sf_dir, "csv"), _TEXT)


@check("src_2_tsv_scan", _TEXT_SQL)
def tsv_scan(spark, sf_dir):
    return tables.read_tsv(spark, _delimited(spark, sf_dir, "tsv"), _TEXT)


@check(
    "src_3_profile_scan",
    f"WITH {derived('household')} SELECT row_id, household_id, state_code, district_code, latitude FROM household ORDER BY row_id LIMIT 500",
)
def profile_scan(spark, sf_dir):
    df = fixture(spark, sf_dir, "household").select("row_id", "household_id", "state_code", "district_code", "latitude")
    return tables.profile_rows(df)


def _mixed_folder(spark, sf_dir) -> str:
    """A folder with the same rows split over comma- and tab-separated files."""
    path = scratch_path(spark, "survey-folder")
    df = survey(spark, sf_dir).select(*_TEXT)
    comma = F.col("district").isNotNull()
    sinks.write_table(df.where(comma), path, "csv")
    sinks.write_table(df.where(~comma), path, "tsv", mode="append")
    return path


@check("src_4_folder_scan", _TEXT_SQL.replace("district FROM", "district, CASE WHEN district IS NULL THEN 'tsv' ELSE 'csv' END AS kind FROM"))
def folder_scan(spark, sf_dir):
    found = tables.read_folder(spark, _mixed_folder(spark, sf_dir), _TEXT)
    return found.select(*_TEXT, F.element_at(F.split("source_file", r"\."), -1).alias("kind"))


@check("src_5_file_batch", _TEXT_SQL.replace("district FROM", "district, true AS is_tagged, false AS is_corrupt FROM"))
def file_batch(spark, sf_dir):
    root = _mixed_folder(spark, sf_dir)
    paths = [r[0] for r in spark.read.format("binaryFile").load(root).select("path").collect()]
    found = tables.read_files(spark, [*paths, f"{root}/missing.csv", f"{root}/notes.docx"], _TEXT)
    return found.select(
        *_TEXT, F.col("source_file").isNotNull().alias("is_tagged"), F.col(tables.CORRUPT).isNotNull().alias("is_corrupt")
    )


_SEEN = """uploads AS (SELECT 'doc_' || doc_id || '.csv' AS file_name, 'sha256:' || left(sha256(text || chr(10)), 16) AS checksum FROM documents),
 registered AS (SELECT 'doc_' || doc_id || '.csv' AS file_name, CASE WHEN toxic = 1 THEN 'other' ELSE 'sha256:' || left(sha256(text || chr(10)), 16) END AS known FROM documents JOIN labels USING (doc_id))"""


@check(
    "src_6_unseen_files",
    f"""WITH {_SEEN} SELECT file_name, checksum, CASE WHEN known IS NULL THEN 'NEW' WHEN known <> checksum THEN 'MODIFIED' ELSE 'UNCHANGED' END AS status
 FROM uploads LEFT JOIN registered USING (file_name)""",
)
def unseen_files(spark, sf_dir):
    return manifest.file_status(*uploads_and_registered(spark, sf_dir))


_RECORDS = f"""recs AS (SELECT row_id, coalesce(person_name, '') AS farmer_name, coalesce(guardian_name, '') AS father_or_spouse, coalesce(contact_number, '') AS contact_number,
 coalesce(job_card, '') AS mgnrega_card, coalesce(gender, '') AS gender, coalesce(category, '') AS category FROM survey)"""


def _records(spark, sf_dir):
    return survey(spark, sf_dir).select(
        "row_id", *[
            F.coalesce(F.col(c), F.lit("")).alias(n)
            for n, c in zip(tables.RECORD_FIELDS, (NAME, GUARDIAN, "contact_number", "job_card", "gender", "category"))
        ],
    )


@check("src_7_record_batch", f"WITH {SURVEY}, {_RECORDS} SELECT farmer_name, father_or_spouse, contact_number, mgnrega_card, gender, category FROM recs")
def record_batch(spark, sf_dir):
    path = sinks.write_table(
        survey(spark, sf_dir).select(
            F.col(NAME).alias("farmer_name"), F.col(GUARDIAN).alias("father_or_spouse"), "contact_number",
            F.col("job_card").alias("mgnrega_card"), "gender", "category",
        ),
        scratch_path(spark, "records"), "json",
    )
    return tables.read_records(spark, path)


@check(
    "src_9_library_load",
    f"WITH {EVIDENCE}, {_LIB} SELECT 'strict' AS layer, name, gender FROM strict UNION ALL SELECT 'prob', name, gender FROM prob",
)
def library_load(spark, sf_dir):
    counts = evidence(spark, sf_dir)
    strict_path = sinks.write_library(library.strict_library(counts), scratch_path(spark, "strict"))
    prob_path = sinks.write_library(library.prob_candidates(counts), scratch_path(spark, "prob"))
    strict, prob = tables.load_library(spark, strict_path, prob_path)
    return strict.select(F.lit("strict").alias("layer"), "name", "gender").unionByName(
        prob.select(F.lit("prob").alias("layer"), "name", "gender")
    )


# ---- sinks ---------------------------------------------------------------------------------

_RUNS: dict[tuple[str, str], dict[str, str]] = {}


def _written_run(spark, sf_dir) -> dict[str, str]:
    """Output paths of one whole run, written once per application and input."""
    where = (spark.sparkContext.applicationId, sf_dir)
    if where not in _RUNS:
        run = run_survey(stage(survey(spark, sf_dir), "survey"), CONFIG)
        _RUNS[where] = write_run(run, CONFIG, scratch_path(spark, "run"))
    return _RUNS[where]


_DEDUPED = f"survey AS (SELECT * FROM {S.newest('raw', KEY, DATE, REAL)} UNION ALL SELECT * FROM raw WHERE {S.placeholder(KEY)})"
_RAW = SURVEY.replace("survey AS (", "raw AS (", 1)
_FORMATTED = f"formatted AS (SELECT row_id, CASE WHEN {S.blank(NAME)} THEN person_name ELSE {S.proper(NAME)} END AS person_name FROM survey)"
_RUN = f"RECURSIVE {_RAW}, {_DEDUPED}, {_CHANGES}, {_FORMATTED}, {S.spelling('formatted', NAME)}"
_SPELL_LOG = """SELECT t.row_id, 'person_name' AS "column", t.name AS name_before, r.fixed AS name_after, t.role, t.original AS original_token, f.corrected AS corrected_token,
 f.confidence, f.method, f.status FROM spell_tokens t JOIN spell_fix f ON f.vocab = t.vocab AND f.token = t.token JOIN spell_rebuilt r ON r.row_id = t.row_id"""
_RESULT = """SELECT s.row_id, s.unique_key, s.submission_date, coalesce(r.fixed, s.person_name) AS person_name, g.new_value AS gender, c.new_value AS category
 FROM survey s LEFT JOIN spell_rebuilt r USING (row_id) JOIN fix_gender g USING (row_id) JOIN fix_category c USING (row_id)"""


@check("flow_2_table_run", f"WITH {_RUN} {_RESULT}")
def table_run(spark, sf_dir):
    return run_survey(survey(spark, sf_dir), CONFIG).data.select(*SLIM)


@check("flow_2_table_run_changes", f"WITH {_RUN} SELECT * FROM log")
def table_run_changes(spark, sf_dir):
    changes = run_survey(survey(spark, sf_dir), CONFIG).changes
    return changes.select("row_id", "field", "old_value", "new_value", "confidence", "method")


@check("flow_2_table_run_spelling", f"WITH {_RUN} {_SPELL_LOG}")
def table_run_spelling(spark, sf_dir):
    return run_survey(survey(spark, sf_dir), CONFIG).spell_changes


@check("snk_1_cleaned_table", f"WITH {_RUN} {_RESULT}")
def cleaned_table(spark, sf_dir):
    return spark.read.parquet(_written_run(spark, sf_dir)["cleaned"]).select(*SLIM)


@check("snk_2_merged_table", f"WITH {_RUN}, res AS ({_RESULT}) {S.newest('res', KEY, DATE)[1:-1]}")
def merged_output(spark, sf_dir):
    return spark.read.parquet(_written_run(spark, sf_dir)["merged"]).select(*SLIM)


_FLAGS = f"""flagged AS (
 SELECT row_id, field AS "column", CASE field WHEN 'gender' THEN 0 ELSE 1 END AS o, field AS flag FROM log
 UNION ALL SELECT row_id, 'person_name', 2, 'spelling' FROM spell_tokens t JOIN spell_fix f ON f.vocab = t.vocab AND f.token = t.token
 UNION ALL SELECT row_id, 'person_name', 3, 'name' FROM raw JOIN res USING (row_id) WHERE coalesce(trim(raw.person_name), '') <> coalesce(trim(res.person_name), '')
 UNION ALL SELECT row_id, 'guardian_name', 3, 'name' FROM survey WHERE NOT {S.blank(GUARDIAN)} AND {S.proper(GUARDIAN)} <> trim(guardian_name)
 UNION ALL SELECT row_id, 'survey_date', 6, 'date' FROM survey WHERE NOT {S.blank('survey_date')} AND {S.date('survey_date')} IS NULL
 UNION ALL SELECT row_id, 'gender', 7, 'missing' FROM res WHERE {S.blank('gender')}
 UNION ALL SELECT row_id, 'category', 7, 'missing' FROM res WHERE {S.blank('category')})"""
_FLAG_ROWS = f"""SELECT row_id, "column", arg_max(flag, o) AS flag FROM flagged GROUP BY ALL UNION ALL SELECT row_id, NULL, 'duplicate' FROM res
 WHERE row_id NOT IN (SELECT row_id FROM {S.newest('res', KEY, DATE)})"""


@check("flow_6_review_flags", f"WITH {_RUN}, res AS ({_RESULT}), {_FLAGS} {_FLAG_ROWS}")
def review_flags(spark, sf_dir):
    return review_table(run_survey(survey(spark, sf_dir), CONFIG), CONFIG)


@check("snk_3_review_table", f"WITH {_RUN}, res AS ({_RESULT}), {_FLAGS} {_FLAG_ROWS}")
def review_output(spark, sf_dir):
    return spark.read.parquet(_written_run(spark, sf_dir)["review"])


_DATE_ISSUES = f"SELECT row_id FROM raw WHERE NOT {S.blank('survey_date')} AND {S.date('survey_date')} IS NULL"
_NINE = f"""SELECT 'summary' AS table_name, 1::BIGINT AS n UNION ALL SELECT 'all_changes', count(*) FROM log UNION ALL SELECT 'gender_changes', count(*) FROM log WHERE field = 'gender'
 UNION ALL SELECT 'category_changes', count(*) FROM log WHERE field = 'category' UNION ALL SELECT 'review_needed', count(*) FROM log WHERE confidence < 75
 UNION ALL SELECT 'duplicate_summary', 1 UNION ALL SELECT 'date_issues', count(*) FROM ({_DATE_ISSUES}) UNION ALL SELECT 'placeholder_ids', count(*) FROM raw WHERE {S.placeholder(KEY)}
 UNION ALL SELECT 'name_corrections', count(*) FROM ({_SPELL_LOG})"""


def _sizes(frames):
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@check("flow_7_audit_tables", f"WITH {_RUN} {_NINE}")
def audit_table_sizes(spark, sf_dir):
    return _sizes(audit_tables(run_survey(survey(spark, sf_dir), CONFIG)))


@check("snk_4_audit_report", f"WITH {_RUN} {_NINE}")
def audit_report(spark, sf_dir):
    written = _written_run(spark, sf_dir)
    return _sizes({k.removeprefix("report/"): spark.read.parquet(p) for k, p in written.items() if k.startswith("report/")})


@check("snk_5_suggestions", f"WITH {_RUN} SELECT row_id, field, new_value FROM log UNION ALL SELECT row_id, 'person_name', corrected_token FROM ({_SPELL_LOG})")
def suggestions(spark, sf_dir):
    written = _written_run(spark, sf_dir)
    changes = spark.read.schema("row_id long, field string, new_value string").json(written["suggestions/changes"])
    spelled = spark.read.schema("row_id long, `column` string, corrected_token string").json(written["suggestions/spell_changes"])
    return changes.unionByName(
        spelled.select("row_id", F.col("column").alias("field"), F.col("corrected_token").alias("new_value"))
    )


@check("snk_6_raw_snapshot", f"WITH {SURVEY} SELECT * FROM survey")
def raw_snapshot(spark, sf_dir):
    return spark.read.parquet(_written_run(spark, sf_dir)["snapshot"])


@check("snk_7_export_table", f"WITH {_EXPORTED} SELECT * FROM exported")
def export_output(spark, sf_dir):
    mapped = export.map_fields(export_source(spark, sf_dir), FORMAT.mapping(), keep=["row_id"])
    # A column that is null throughout keeps its declared type in Parquet.
    return spark.read.parquet(sinks.write_table(mapped, scratch_path(spark, "export")))


@check(
    "snk_8_libraries",
    f"""WITH {EVIDENCE}, {_LIB} SELECT 'strict' AS library, name FROM strict UNION ALL SELECT 'ambiguous', name FROM ambiguous UNION ALL SELECT 'prob', name FROM prob""",
)
def library_output(spark, sf_dir):
    counts = evidence(spark, sf_dir)
    built = library.build_libraries(counts, counts)
    parts = []
    for name in ("strict", "ambiguous", "prob"):
        path = sinks.write_library(getattr(built, name), scratch_path(spark, name))
        parts.append(spark.read.parquet(path).select(F.lit(name).alias("library"), "name"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check(
    "snk_9_manifest",
    f"WITH {_SEEN} SELECT file_name, checksum FROM uploads",
)
def manifest_update(spark, sf_dir):
    uploads, registered = uploads_and_registered(spark, sf_dir)
    read = manifest.unseen(uploads, registered).drop("status")
    return manifest.updated_manifest(registered, read)


@check("agg_4_run_summary", f"""WITH {_RUN}, n AS (SELECT count(*) AS original_records, count(*) FILTER ({S.placeholder(KEY)}) AS placeholder_records FROM raw), f AS (SELECT count(*) AS final_records FROM survey)
 SELECT original_records, placeholder_records, (SELECT count(*) FROM ({_DATE_ISSUES})) AS date_issues, original_records - final_records AS duplicates_removed, (SELECT count(*) FROM log) AS auto_corrections,
 (SELECT count(*) FROM ({_SPELL_LOG})) AS spell_corrections, final_records, final_records AS records_after_dedup, round((1 - final_records / original_records) * 100, 1) AS reduction_pct FROM n, f""")
def summary_of_run(spark, sf_dir):
    return run_summary(run_survey(survey(spark, sf_dir), CONFIG))


@check(
    "val_20_survey_dates",
    f"""WITH {SURVEY} SELECT row_id, person_name AS name, village, survey_date AS bad_value, 'Use ''submission_date'' column value as fallback' AS suggested_fix
 FROM survey WHERE NOT {S.blank('survey_date')} AND {S.date('survey_date')} IS NULL""",
)
def survey_dates(spark, sf_dir):
    return audit.survey_date_issues(survey(spark, sf_dir), "survey_date", NAME, "village", DATE)


# ---- modes ---------------------------------------------------------------------------------


@check(
    "flow_8_selective_mode",
    f"WITH RECURSIVE {_RAW}, {_DEDUPED}, {S.gender('survey', NAME)}, {S.gender_fix('survey')} SELECT s.row_id, s.unique_key, s.submission_date, s.person_name, g.new_value AS gender, s.category FROM survey s JOIN fix_gender g USING (row_id)",
)
def selective_mode(spark, sf_dir):
    context = Context.selective(["gender"], ["deduplicate", "auto_correct", "auto_correct_gender"])
    run = run_survey(survey(spark, sf_dir), CONFIG, context)
    return run.data.select(*SLIM)


@check("flow_8_selective_guard", f"WITH {SURVEY} SELECT count(*) - count(*) AS violations FROM survey")
def selective_guard(spark, sf_dir):
    context = Context.selective(["gender"], ["deduplicate", "auto_correct", "auto_correct_gender"])
    return run_survey(survey(spark, sf_dir), CONFIG, context).guard.agg(F.count(F.lit(1)).alias("violations"))


@check(
    "flow_9_dry_run",
    f"WITH {_RUN}, c AS (SELECT row_id, count(*) AS n_changes FROM log GROUP BY row_id) SELECT s.row_id, s.unique_key, s.submission_date, s.person_name, s.gender, s.category, coalesce(n_changes, 0) AS n_changes FROM survey s LEFT JOIN c USING (row_id)",
)
def dry_run(spark, sf_dir):
    run = run_survey(survey(spark, sf_dir), CONFIG, Context.advisory())
    logged = run.changes.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_changes"))
    return run.data.select(*SLIM).join(logged, "row_id", "left").fillna(0, ["n_changes"])


# ---- records, engines, batches, learning ---------------------------------------------------

_PROCESSED = f"""{_RECORDS}, {S.contact('recs', 'contact_number')}, {S.card('recs', 'mgnrega_card')}, {S.gender('recs', 'farmer_name')},
 {S.category('recs', 'farmer_name')}, done AS (SELECT row_id, CASE WHEN {S.blank('farmer_name')} THEN farmer_name ELSE {S.proper('farmer_name')} END AS farmer_name,
  CASE WHEN k.is_valid AND k.was_changed THEN k.corrected ELSE contact_number END AS contact_number, CASE WHEN j.is_valid AND j.was_changed THEN j.corrected ELSE mgnrega_card END AS mgnrega_card,
  CASE WHEN {S.clean('gender')} = '' THEN g.value ELSE {S.clean('gender')} END AS gender, CASE WHEN {S.clean('category')} = '' THEN c.value ELSE {S.clean('category')} END AS category,
  {S.proper('farmer_name')} <> trim(farmer_name) OR k.was_changed OR (j.is_valid AND j.was_changed) AS has_corrections, NOT k.is_valid OR NOT j.is_valid AS has_invalid_fields,
  {S.clean('gender')} = '' OR {S.clean('category')} = '' AS has_inferences, {S.clean('gender')} = '' AND g.value <> '' AS gender_inferred, {S.clean('category')} = '' AND c.value <> '' AS category_inferred
  FROM recs JOIN contact k USING (row_id) JOIN card j USING (row_id) JOIN guess_gender g USING (row_id) JOIN guess_category c USING (row_id))"""


@check(
    "flow_1_records",
    f"WITH RECURSIVE {SURVEY}, {_PROCESSED} SELECT row_id, farmer_name, contact_number, mgnrega_card, gender, category, has_corrections, has_invalid_fields, has_inferences FROM done",
)
def process_records(spark, sf_dir):
    done = records.process_records(_records(spark, sf_dir), CONFIG.lexicons)
    return done.drop("father_or_spouse", "validations", "inferences")


@check(
    "agg_8_record_counters",
    f"""WITH RECURSIVE {SURVEY}, {_PROCESSED} SELECT count(*) AS total, count(*) FILTER (has_corrections) AS corrected, count(*) FILTER (has_invalid_fields) AS invalid,
 count(*) FILTER (gender_inferred) AS inferred_gender, count(*) FILTER (category_inferred) AS inferred_category FROM done""",
)
def record_counters(spark, sf_dir):
    return records.record_counters(records.process_records(_records(spark, sf_dir), CONFIG.lexicons))


ENGINE = engines.EngineConfig(
    key=KEY, name=NAME, guardian=GUARDIAN, contact="contact_number", job_card="job_card", date=DATE, dates=("survey_date", DATE),
    land_columns=("land_area",), as_of=AS_OF,
)
_TRIMMED = ", ".join(
    f"CASE WHEN {S.blank(c)} THEN '' ELSE {S.squeeze(c)} END AS {c}"
    for c in (KEY, DATE, NAME, GUARDIAN, "gender", "contact_number", "job_card", "survey_date", "age", "land_area")
)
_STEP1 = f"trimmed AS (SELECT row_id, {_TRIMMED} FROM survey)"
_STEP2 = f"""named AS (SELECT * REPLACE ({S.proper_quick(NAME)} AS person_name, {S.proper_quick(GUARDIAN)} AS guardian_name) FROM trimmed),
 {S.contact('named', 'contact_number', quick=True)}, dialled AS (SELECT n.* REPLACE (CASE WHEN k.is_valid AND k.was_changed THEN k.corrected ELSE contact_number END AS contact_number) FROM named n JOIN contact k USING (row_id)),
 unique_rows AS (SELECT * FROM {S.newest('dialled', KEY, DATE, REAL)} UNION ALL SELECT * FROM dialled WHERE {S.placeholder(KEY)})"""
_QUICK = {p: S.quick_gender(NAME, GUARDIAN, p) for p in ("value", "confidence")}
_FILLED = "lower(trim(gender)) IN ('male', 'female', 'others')"
_ENGINES = f"{SURVEY}, {_STEP1}, {_STEP2}, engine_out AS (SELECT * REPLACE (CASE WHEN NOT {_FILLED} AND {_QUICK['confidence']} >= 75 THEN {_QUICK['value']} ELSE gender END AS gender) FROM unique_rows)"


@check("flow_3_engines", f"WITH {_ENGINES} SELECT row_id, unique_key, person_name, guardian_name, gender, contact_number FROM engine_out")
def all_engines(spark, sf_dir):
    return engines.run_engines(survey(spark, sf_dir), ENGINE).data.select("row_id", KEY, NAME, GUARDIAN, "gender", "contact_number")


_TEXTS = (
    KEY, DATE, NAME, GUARDIAN, "gender", "vote_gender", "category", "district", "village", "contact_number", "job_card", "survey_date", "age", "land_area",
    "national_id", "source_file",
)
_CELLS_CHANGED = " + ".join(f"count(*) FILTER ({c} IS DISTINCT FROM CASE WHEN {S.blank(c)} THEN '' ELSE {S.squeeze(c)} END)" for c in _TEXTS)


@check(
    "agg_26_total_changes",
    f"""WITH {_ENGINES} SELECT (SELECT {_CELLS_CHANGED} FROM survey) + (SELECT count(*) FILTER ({S.proper_quick(NAME)} <> person_name) + count(*) FILTER ({S.proper_quick(GUARDIAN)} <> guardian_name) FROM trimmed)
 + (SELECT count(*) FROM contact WHERE is_valid AND was_changed) + (SELECT count(*) FROM unique_rows WHERE NOT {_FILLED} AND {_QUICK['confidence']} >= 75) AS total_changes""",
)
def total_changes(spark, sf_dir):
    return engines.total_changes(engines.run_engines(stage(survey(spark, sf_dir), "survey"), ENGINE).stats)


@check(
    "flow_4_quick_step",
    f"""WITH {SURVEY}, {S.contact('survey', 'contact_number', quick=True)} SELECT row_id, CASE WHEN is_valid AND was_changed THEN corrected ELSE contact_number END AS contact_number FROM survey JOIN contact USING (row_id)""",
)
def quick_step(spark, sf_dir):
    return engines.run_quick(survey(spark, sf_dir), "contact_validation", ENGINE).data.select("row_id", "contact_number")


_PER_FILE = f"survey AS (SELECT * FROM {S.newest('raw', 'source_file, unique_key', DATE, REAL)} UNION ALL SELECT * FROM raw WHERE {S.placeholder(KEY)})"
_BATCH = f"RECURSIVE {_RAW}, {_PER_FILE}, {_CHANGES}, {_FORMATTED}, {S.spelling('formatted', NAME)}"


@check("flow_5_file_batch", f"WITH {_BATCH} {_RESULT}")
def many_files(spark, sf_dir):
    return batch.run_batch(survey(spark, sf_dir), CONFIG).data.select(*SLIM)


def _count_by_file(rows: str, name: str) -> str:
    return f"(SELECT count(*) FROM ({rows}) x JOIN raw r USING (row_id) WHERE r.source_file = f.source_file) AS {name}"


_FILES = f"""file_counts AS (SELECT f.source_file, (SELECT count(*) FROM raw r WHERE r.source_file = f.source_file) AS original_records,
 (SELECT count(*) FROM survey s WHERE s.source_file = f.source_file) AS final_records,
 {_count_by_file('SELECT row_id FROM log', 'auto_corrections')}, {_count_by_file(f'SELECT row_id FROM ({_SPELL_LOG})', 'spell_corrections')},
 {_count_by_file(_DATE_ISSUES, 'date_issues')}, (SELECT count(*) FROM raw r WHERE r.source_file = f.source_file AND {S.placeholder(KEY)}) AS placeholder_records, 'success' AS status
 FROM (SELECT DISTINCT source_file FROM raw) f), files AS (SELECT *, original_records - final_records AS duplicates_removed FROM file_counts)"""


@check("agg_6_file_summary", f"WITH {_BATCH}, {_FILES} SELECT * FROM files")
def file_summary(spark, sf_dir):
    return batch.file_summary(batch.run_batch(survey(spark, sf_dir), CONFIG))


_TOTAL = ", ".join(f"sum({m})::BIGINT AS {m}" for m in batch.METRICS)


@check(
    "agg_7_batch_totals",
    f"WITH {_BATCH}, {_FILES} SELECT source_file, count(*) AS files, {_TOTAL} FROM files GROUP BY source_file UNION ALL SELECT 'TOTAL', count(*), {_TOTAL} FROM files",
)
def batch_totals(spark, sf_dir):
    return batch.batch_totals(batch.file_summary(batch.run_batch(survey(spark, sf_dir), CONFIG)))


@check(
    "snk_11_batch_summary",
    f"WITH {_BATCH}, {_FILES} SELECT * FROM files",
)
def batch_summary_output(spark, sf_dir):
    summary = batch.file_summary(batch.run_batch(survey(spark, sf_dir), CONFIG))
    return spark.read.parquet(sinks.write_table(summary, scratch_path(spark, "batch-summary")))


@check(
    "ord_4_run_history",
    f"WITH {derived('file_events')} SELECT seq, file_name, strftime(at, '%Y-%m-%d %H:%M:%S') AS created_at FROM file_events ORDER BY at DESC".replace("(at,", '("at",').replace("BY at", 'BY "at"'),
)
def run_history(spark, sf_dir):
    runs = fixture(spark, sf_dir, "file_events").withColumnRenamed("at", "created_at")
    return audit.run_history(runs).select("seq", "file_name", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def _tiers(spark, sf_dir) -> learning.Tier:
    rows = fixture(spark, sf_dir, "evidence")
    files = rows.groupBy(F.col("source_file").alias("file_name")).agg(
        F.concat(F.lit("rows:"), F.count(F.lit(1)).cast("string")).alias("checksum")
    )
    return learning.Tier(rows, files)


def _rebuilt(spark, sf_dir) -> str:
    """Libraries built in two steps: all files but one first, then the rest."""
    root = scratch_path(spark, "libraries")
    tier = _tiers(spark, sf_dir)
    first = learning.Tier(tier.rows, tier.files.where(F.col("file_name") != "f0.csv"))
    for step in (first, tier):
        learning.rebuild(spark, root, step, step, name="first_raw", gender="gender_raw")
    return root


@check(
    "flow_12_library_rebuild",
    f"WITH {EVIDENCE}, {_LIB} SELECT 'strict' AS library, name, gender, count AS n FROM strict UNION ALL SELECT 'prob', name, gender, total FROM prob UNION ALL SELECT 'ambiguous', name, reason, total FROM ambiguous",
)
def library_rebuild(spark, sf_dir):
    root = _rebuilt(spark, sf_dir)
    strict, prob, ambiguous = (learning.library_table(spark, root, t) for t in ("strict", "prob", "ambiguous"))
    return (
        strict.select(F.lit("strict").alias("library"), "name", "gender", F.col("count").alias("n"))
        .unionByName(prob.select(F.lit("prob").alias("library"), "name", "gender", F.col("total").alias("n")))
        .unionByName(ambiguous.select(F.lit("ambiguous").alias("library"), "name", F.col("reason").alias("gender"), F.col("total").alias("n")))
    )


@check(
    "flow_12_library_releases",
    f"""WITH {EVIDENCE}, {_LIB}, e AS (SELECT name, sum(male) AS m, sum(female) AS f FROM per_file WHERE source_file <> 'f0.csv' GROUP BY name)
 SELECT 1 AS release, name, CASE WHEN m > 0 THEN 'male' ELSE 'female' END AS gender, (m + f)::BIGINT AS n FROM e WHERE (m = 0 OR f = 0) AND m + f >= 2
 UNION ALL SELECT 2, name, gender, count FROM strict""",
)
def library_releases(spark, sf_dir):
    """The strict library before and after the second step, both still readable; a rebuild without news and one that is lost release nothing."""
    root = _rebuilt(spark, sf_dir)
    tier = _tiers(spark, sf_dir)
    assert learning.rebuild(spark, root, tier, tier, name="first_raw", gender="gender_raw")["status"] == "no_changes"
    lost = learning.rebuild(spark, root, tier, tier, full=True, name="first_raw", gender="no_such_column")
    assert (lost["status"], lost["version"]) == ("partial", 2)
    each = [learning.library_table(spark, root, "strict", n).select(F.lit(n).alias("release"), "name", "gender", F.col("count").alias("n")) for n in (1, 2)]
    return each[0].unionByName(each[1])


@check(
    "flow_13_library_status",
    f"""WITH {EVIDENCE} SELECT tier, source_file AS file_name, CASE WHEN source_file = 'f0.csv' THEN 'NEW' ELSE 'MODIFIED' END AS status
 FROM (SELECT DISTINCT source_file FROM evidence) CROSS JOIN (VALUES ('verified'), ('unverified')) t(tier) WHERE source_file <> 'f1.csv'""",
)
def library_status(spark, sf_dir):
    root = scratch_path(spark, "libraries")
    tier = _tiers(spark, sf_dir)
    first = learning.Tier(tier.rows, tier.files.where(F.col("file_name") != "f0.csv"))
    learning.rebuild(spark, root, first, first, name="first_raw", gender="gender_raw")
    changed = tier.files.withColumn(
        "checksum", F.when(F.col("file_name") == "f2.csv", F.lit("edited")).otherwise(F.col("checksum"))
    )
    return learning.library_status(spark, root, changed, changed)


@check(
    "agg_21_library_growth",
    f"""WITH {EVIDENCE}, {_LIB}, e AS (SELECT name, sum(male) AS m, sum(female) AS f FROM per_file WHERE source_file <> 'f0.csv' GROUP BY name),
 b AS (SELECT 'strict' AS library, count(*) AS before FROM e WHERE (m = 0 OR f = 0) AND m + f >= 2), a AS (SELECT 'strict' AS library, count(*) AS after FROM strict)
 SELECT library, before, after, greatest(after - before, 0) AS added FROM a JOIN b USING (library)""",
)
def library_growth(spark, sf_dir):
    counts = evidence(spark, sf_dir)
    none = library.prob_candidates(counts).limit(0)
    before = library.library_sizes(library.strict_library(counts.where(F.col("source_file") != "f0.csv")), none)
    return library.growth(before, library.library_sizes(library.strict_library(counts), none))


@check("udf_1_export_format_contract", f"WITH {_EXPORTED} SELECT count(*) AS rows, count(land_area_ha) AS areas FROM exported")
def export_contract(spark, sf_dir):
    class AreasOnly:
        name = "areas"

        def mapping(self):
            return [m for m in FORMAT.mapping() if m.target == "land_area_ha"]

        def compliance(self, df):
            return export.compliance_issues(df, self.mapping())

    return export.export(export_source(spark, sf_dir), AreasOnly()).data.agg(
        F.count(F.lit(1)).alias("rows"), F.count("land_area_ha").alias("areas")
    )


@check(
    "udf_2_named_transforms",
    f"WITH {SURVEY} SELECT row_id, upper(trim(category)) AS uppercase, right(regexp_replace(contact_number, '[^0-9]', '', 'g'), 10) AS clean_mobile, {S.title(NAME)} AS title_case, job_card AS validate_format FROM survey",
)
def named_transforms(spark, sf_dir):
    t = export.TRANSFORMS
    return survey(spark, sf_dir).select(
        "row_id",
        t["uppercase"](F.col("category")).alias("uppercase"),
        t["clean_mobile"](F.col("contact_number")).alias("clean_mobile"),
        t["title_case"](F.col(NAME)).alias("title_case"),
        t["validate_format"](F.col("job_card")).alias("validate_format"),
    )


# ---- streams -------------------------------------------------------------------------------


@check("src_10_folder_stream", _TEXT_SQL)
def folder_stream(spark, sf_dir):
    stream = folder.folder_stream(spark, _delimited(spark, sf_dir, "csv"), _TEXT)
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    query = stream.select(*_TEXT).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _streamed_files(spark, sf_dir, files_per_batch: int):
    path = scratch_path(spark, "stream-in")
    sinks.write_table(survey(spark, sf_dir).select(*_TEXT).repartition(4, "row_id"), path, "csv")
    return folder.folder_stream(spark, path, _TEXT, files_per_batch=files_per_batch)


_NEWEST = f"WITH {SURVEY} {S.newest('survey', KEY, DATE, columns='row_id, unique_key, submission_date, person_name')[1:-1]}"


@check("str_5_newest_per_key_stream", _NEWEST)
def newest_stream(spark, sf_dir):
    stream = _streamed_files(spark, sf_dir, 1).withColumn("row_id", F.col("row_id").try_cast("long"))
    checkpoint = scratch_path(spark, "state")
    folder.newest_per_key_stream(stream, KEY, DATE, checkpoint).awaitTermination()
    return folder.current_state(spark, checkpoint).select("row_id", KEY, DATE, NAME)


@check("str_3_poll_interval", _NEWEST)
def poll_interval(spark, sf_dir):
    """The same state from a query that polls the folder until it is stopped."""
    stream = _streamed_files(spark, sf_dir, 2).withColumn("row_id", F.col("row_id").try_cast("long"))
    checkpoint = scratch_path(spark, "state")
    query = folder.newest_per_key_stream(stream, KEY, DATE, checkpoint, every="1 second")
    query.processAllAvailable()
    query.stop()
    return folder.current_state(spark, checkpoint).select("row_id", KEY, DATE, NAME)


# Folders of files by every rule of the run: key, both names spelled, dates, contacts.
_FILE_COLUMNS = ("source_row", KEY, DATE, NAME, GUARDIAN, "gender", "category", "district", "village", "contact_number", "job_card", "survey_date")
_EVERY_RULE = replace(CONFIG, spell_columns=None)
# Blank cells of a delimited file arrive as nulls.
_AS_FILES = _RAW.replace("raw AS (", "written AS (", 1) + ", raw AS (SELECT * REPLACE (nullif(gender, '') AS gender, nullif(category, '') AS category, nullif(survey_date, '') AS survey_date) FROM written)"
_FILE_BATCH = f"RECURSIVE {_AS_FILES}, {_PER_FILE}, {_CHANGES}, {_FORMATTED}, {S.spelling('formatted', NAME)}"
_FILE_RESULT = f"WITH {_FILE_BATCH} {_RESULT}"


def _put(spark, sf_dir, path: str, files: range, packed: bool = False) -> None:
    """One file per source file of the survey table; every second one has another order of columns and one more."""
    rows = survey(spark, sf_dir).withColumn("source_row", F.col("row_id").cast("string"))
    for k in files:
        columns = [*reversed(_FILE_COLUMNS), "vote_gender"] if k % 2 else _FILE_COLUMNS
        one = rows.where(F.col("source_file") == f"file_{k}.csv")
        sinks.write_file(one, f"{path}/file_{k}.csv{'.gz' if packed else ''}", columns, "row_id")


def _move(spark, source: str, target: str) -> None:
    """Move the one data file of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = [f for f in tables.list_files(spark, source)]
    place = path(target)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place.getParent())
    fs.delete(place, False)
    fs.rename(path(found[0]), place)


_BY_PATH = " UNION ALL ".join(
    f"SELECT '{k}' AS folder, '{name}' AS source_file, 'success' AS status, count(*) AS n FROM survey WHERE source_file = 'file_{k}.csv'"
    for k, name in enumerate(("data.csv", "data.csv", "data.CSV", "data.csv.gz"))
)


@check(
    "src_5_files_by_path",
    f"WITH {SURVEY} {_BY_PATH} UNION ALL SELECT '4', 'data.csv', 'empty', 0 UNION ALL SELECT '5', 'data.csv.gz', 'failed', 0 UNION ALL SELECT '6', 'data.csv', 'missing', 0",
)
def files_by_path(spark, sf_dir):
    """Files of one name in several folders, with other orders of columns, packed, empty, broken and missing; rows are counted per full path."""
    path = scratch_path(spark, "files")
    for k, name in enumerate(("data.csv", "data.csv", "data.CSV", "data.csv.gz")):
        _put(spark, sf_dir, f"{path}-{k}", range(k, k + 1), packed=name.endswith("gz"))
        _move(spark, f"{path}-{k}", f"{path}/{k}/{name}")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/4/data.csv")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place).close()
    sinks.write_table(spark.range(1).select(F.lit("not gzip").alias("x")), f"{path}-5", "csv")
    _move(spark, f"{path}-5", f"{path}/5/data.csv.gz")
    names = [*(f"{path}/{k}/data.csv" for k in (0, 1, 4, 6)), f"{path}/2/data.CSV", *(f"{path}/{k}/data.csv.gz" for k in (3, 5))]
    files = tables.read_file_set(spark, names, _FILE_COLUMNS)
    counts = files.rows.where(F.col("source_row").isNotNull()).groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    folder_name = F.element_at(F.split("source_path", "/"), -2).alias("folder")
    return files.outcomes.join(counts, "source_path", "left").select(folder_name, "source_file", "status", F.coalesce("n", F.lit(0)).alias("n"))


def _poll(spark, path: str, out: str, checkpoint: str, files_per_batch: int = 2) -> None:
    stream = folder.arrivals(spark, path, files_per_batch=files_per_batch)
    folder.process_folder(stream, _EVERY_RULE, out, checkpoint, columns=_FILE_COLUMNS).awaitTermination()


def _cleaned(spark, out: str):
    rows = spark.read.parquet(f"{out}/cleaned")
    return rows.select(F.col("source_row").cast("long").alias("row_id"), KEY, DATE, NAME, "gender", "category")


@check("str_1_continuous_folder", _FILE_RESULT)
def continuous_folder(spark, sf_dir):
    path, out, checkpoint = (scratch_path(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    _put(spark, sf_dir, path, range(4))
    _poll(spark, path, out, checkpoint)
    return _cleaned(spark, out)


@check("str_2_each_file_once", _FILE_RESULT)
def each_file_once(spark, sf_dir):
    """Two polls, the second with a copy of a known file under another name; a namesake in a folder of its own is another file."""
    path, out, checkpoint = (scratch_path(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    for k in range(3):
        _put(spark, sf_dir, f"{path}-{k}", range(k, k + 1))
        _move(spark, f"{path}-{k}", f"{path}/{k}/data.CSV")
    _poll(spark, f"{path}/*", out, checkpoint)
    _put(spark, sf_dir, f"{path}-copy", range(1, 2))
    _move(spark, f"{path}-copy", f"{path}/2/copy.csv")
    _put(spark, sf_dir, f"{path}-3", range(3, 4))
    _move(spark, f"{path}-3", f"{path}/1/data2.csv")
    _poll(spark, f"{path}/*", out, checkpoint)
    return _cleaned(spark, out)


@check("str_4_failed_batch_replayed", _FILE_RESULT)
def failed_batch_replayed(spark, sf_dir):
    """An unreadable file is listed and read on a later poll, once it is repaired in place and without arriving anew."""
    path, out, checkpoint = (scratch_path(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    _put(spark, sf_dir, path, range(3))
    sinks.write_table(spark.range(1).select(F.lit("not gzip").alias("x")), f"{path}-broken", "csv")
    _move(spark, f"{path}-broken", f"{path}/last.csv.gz")
    _poll(spark, path, out, checkpoint)
    _poll(spark, path, out, checkpoint)
    tries = folder.ledger(spark, out).collect()
    assert [(r["status"], r["attempts"]) for r in tries] == [("failed", 2)], tries
    _put(spark, sf_dir, f"{path}-whole", range(3, 4), packed=True)
    _move(spark, f"{path}-whole", f"{path}/last.csv.gz")
    _poll(spark, path, out, checkpoint)
    assert [r["status"] for r in folder.ledger(spark, out).collect()] == ["success"]
    return _cleaned(spark, out)


@check("snk_10_archive", _TEXT_SQL)
def archive(spark, sf_dir):
    """Processed files move to an archive folder; the rows are complete either way."""
    path = _delimited(spark, sf_dir, "csv")
    stream = folder.folder_stream(spark, path, _TEXT, archive=scratch_path(spark, "archive"))
    out, checkpoint = scratch_path(spark, "archive-out"), scratch_path(spark, "archive-checkpoint")
    writer = stream.select(*_TEXT).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@check("flow_5_merged_and_cleaned_sizes", f"WITH {_RUN}, res AS ({_RESULT}) SELECT 'cleaned' AS table_name, count(*) AS n FROM res UNION ALL SELECT 'merged', count(*) FROM {S.newest('res', KEY, DATE)}")
def merged_and_cleaned(spark, sf_dir):
    run = run_survey(survey(spark, sf_dir), CONFIG)
    return _sizes({"cleaned": run.data, "merged": merged_table(run, CONFIG)})

