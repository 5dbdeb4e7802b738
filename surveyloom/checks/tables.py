"""Checks of whole-table operators: keys, windows, votes, joins, inference, spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.checks import sql as S
from surveyloom.checks.fixtures import derived, fixture, table
from surveyloom.checks.registry import check
from surveyloom.functions.codes import VALID_CATEGORIES, VALID_GENDERS, confidence_label
from surveyloom.functions.text import clean_val, first_token, is_blank, last_token
from surveyloom.operators import audit, dedup, edits, infer, library, spelling, vote
from surveyloom.operators.cells import correct_cards, correct_contacts, format_names
from surveyloom.operators.keyed import lookup
from surveyloom.operators.lexicons import Lexicons
from surveyloom.plans.engines import gender_stats

LEX = Lexicons()
KEY, DATE, NAME, GUARDIAN = "unique_key", "submission_date", "person_name", "guardian_name"
REAL = f"NOT ({S.placeholder(KEY)})"
SURVEY = derived("survey")


def survey(spark, sf_dir):
    return fixture(spark, sf_dir, "survey")


# ---- keys and duplicates -------------------------------------------------------------------


@check("flt_1_placeholder_keys", f"WITH {SURVEY} SELECT row_id, unique_key FROM survey WHERE {S.placeholder(KEY)}")
def placeholder_keys(spark, sf_dir):
    return dedup.split_placeholders(survey(spark, sf_dir), KEY).placeholders.select("row_id", KEY)


@check(
    "val_21_placeholder_log",
    f"""WITH {SURVEY} SELECT row_id, person_name AS name, village, unique_key AS bad_key, submission_date,
 {S.surrogate(NAME, 'village', DATE)} AS suggested_key FROM survey WHERE {S.placeholder(KEY)}""",
)
def placeholder_log(spark, sf_dir):
    return dedup.placeholder_log(survey(spark, sf_dir), KEY, NAME, "village", DATE)


_COLS = "row_id, unique_key, submission_date, person_name"


@check("w_1_newest_per_key", f"WITH {SURVEY} {S.newest('survey', KEY, DATE, REAL, _COLS)[1:-1]}")
def newest_per_key(spark, sf_dir):
    real = dedup.split_placeholders(survey(spark, sf_dir), KEY).real
    return dedup.newest_per_key(real, KEY, DATE).select("row_id", KEY, DATE, NAME)


@check("w_2_merged", f"WITH {SURVEY} {S.newest('survey', KEY, DATE, 'true', _COLS)[1:-1]}")
def merged(spark, sf_dir):
    return dedup.merged(survey(spark, sf_dir), KEY, DATE).select("row_id", KEY, DATE, NAME)


@check("w_3_oldest_per_key", f"WITH {SURVEY} {S.newest('survey', KEY, DATE, REAL, _COLS, last=True)[1:-1]}")
def oldest_per_key(spark, sf_dir):
    real = dedup.split_placeholders(survey(spark, sf_dir), KEY).real
    return dedup.newest_per_key(real, KEY, DATE, keep="last").select("row_id", KEY, DATE, NAME)


@check(
    "w_4_duplicate_members",
    f"WITH {SURVEY} SELECT row_id, unique_key FROM survey WHERE {REAL} QUALIFY count(*) OVER (PARTITION BY unique_key) > 1",
)
def duplicate_members(spark, sf_dir):
    return dedup.duplicate_members(survey(spark, sf_dir).select("row_id", KEY), KEY).select("row_id", KEY)


@check(
    "w_5_later_occurrences",
    f"""WITH {derived('household')} SELECT row_id, aadhaar_number FROM household WHERE aadhaar_number <> ''
 QUALIFY row_number() OVER (PARTITION BY aadhaar_number ORDER BY row_id) > 1""",
)
def later_occurrences(spark, sf_dir):
    return dedup.later_occurrences(fixture(spark, sf_dir, "household"), "aadhaar_number").select("row_id", "aadhaar_number")


@check(
    "agg_1_duplicate_profile",
    f"""WITH {SURVEY}, c AS (SELECT count(*) AS n FROM survey WHERE {REAL} GROUP BY unique_key HAVING count(*) > 1)
 SELECT coalesce(sum(n), 0)::BIGINT AS duplicate_rows, count(*) AS keys_with_duplicates, max(n) AS max_per_key, round(avg(n), 6) AS avg_per_key FROM c""",
)
def duplicate_profile(spark, sf_dir):
    return dedup.duplicate_profile(survey(spark, sf_dir), KEY)


@check(
    "ord_2_top_duplicated_keys",
    f"WITH {SURVEY} SELECT unique_key, count(*) AS n FROM survey WHERE {REAL} GROUP BY unique_key HAVING count(*) > 1 ORDER BY n DESC, unique_key LIMIT 10",
)
def top_duplicated_keys(spark, sf_dir):
    return dedup.top_duplicated_keys(survey(spark, sf_dir), KEY)


@check("ord_1_by_recency", f"WITH {SURVEY} SELECT row_id, submission_date FROM survey ORDER BY {S.date(DATE)} DESC NULLS LAST, row_id")
def by_recency(spark, sf_dir):
    return dedup.by_recency(survey(spark, sf_dir).select("row_id", DATE), DATE)


_DEDUPED = f"{S.newest('survey', KEY, DATE, REAL)[1:-1]}"


@check(
    "set_1_reattach_placeholders",
    f"WITH {SURVEY} SELECT row_id, unique_key FROM {S.newest('survey', KEY, DATE, REAL)} UNION ALL SELECT row_id, unique_key FROM survey WHERE {S.placeholder(KEY)}",
)
def reattach(spark, sf_dir):
    return dedup.deduplicate(survey(spark, sf_dir), KEY, DATE).select("row_id", KEY)


_SUMMARY = f"""SELECT count(*) AS original_records, count(*) FILTER ({S.placeholder(KEY)}) AS placeholder_records,
 count(*) FILTER ({REAL}) - count(DISTINCT unique_key) FILTER ({REAL}) AS duplicates_removed, count(DISTINCT unique_key) FILTER ({REAL}) AS unique_records FROM survey"""


@check(
    "agg_5_duplicate_summary",
    f"""WITH {SURVEY}, s AS ({_SUMMARY}) SELECT *, original_records - duplicates_removed AS final_records,
 round(duplicates_removed / original_records * 100, 1) AS duplication_rate_pct FROM s""",
)
def dedup_summary(spark, sf_dir):
    return dedup.dedup_summary(survey(spark, sf_dir), KEY)


# ---- votes ---------------------------------------------------------------------------------

_VOTE = S.vote("survey", KEY, "vote_gender")


@check("agg_2_majorities", f"WITH {SURVEY}, {_VOTE} SELECT key AS unique_key, value AS majority, votes, total, n_values AS distinct_values, CASE WHEN votes / total < 0.8 THEN 74 ELSE 82 END AS confidence FROM majority")
def majorities(spark, sf_dir):
    return vote.majorities(survey(spark, sf_dir), KEY, "vote_gender")


@check("w_6_vote_shares", f"WITH {SURVEY}, {_VOTE} SELECT key AS unique_key, value, votes, total, round(votes / total, 6) AS share, row_number() OVER (PARTITION BY key ORDER BY votes DESC, value DESC) = 1 AS leads FROM ballot")
def vote_shares(spark, sf_dir):
    return vote.vote_shares(survey(spark, sf_dir), KEY, "vote_gender")


@check(
    "inf_9_majority_vote",
    f"""WITH {SURVEY}, {_VOTE} SELECT row_id, person_name AS name, guardian_name AS guardian, 'vote_gender' AS field, {S.clean('vote_gender')} AS old_value, value AS new_value,
 CASE WHEN votes / total < 0.8 THEN 74 ELSE 82 END AS confidence, 'Majority Vote' AS method FROM survey JOIN majority ON key = unique_key WHERE {S.clean('vote_gender')} <> value""",
)
def majority_vote(spark, sf_dir):
    return vote.majority_vote(survey(spark, sf_dir), KEY, "vote_gender", NAME, GUARDIAN).changes


@check(
    "inf_9_majority_vote_data",
    f"""WITH {SURVEY}, {_VOTE} SELECT row_id, CASE WHEN value IS NOT NULL AND {S.clean('vote_gender')} <> value THEN value ELSE vote_gender END AS vote_gender
 FROM survey LEFT JOIN majority ON key = unique_key""",
)
def majority_vote_data(spark, sf_dir):
    return vote.majority_vote(survey(spark, sf_dir), KEY, "vote_gender", NAME).data.select("row_id", "vote_gender")


# ---- inference -----------------------------------------------------------------------------

_GENDER = S.gender("survey", NAME)


@check("inf_1_gender", f"WITH {SURVEY}, {_GENDER} SELECT row_id, value, confidence, tier, {S.label('confidence')} AS label FROM guess_gender")
def gender(spark, sf_dir):
    return infer.with_gender(survey(spark, sf_dir), NAME, LEX, "g").select("row_id", "g.*")


@check("jn_1_exact_name", f"WITH {SURVEY}, {_GENDER} SELECT row_id, value AS gender FROM guess_gender WHERE tier = 1")
def exact_name(spark, sf_dir):
    rows = infer.with_gender(survey(spark, sf_dir), NAME, LEX, "g")
    return rows.where(F.col("g.tier") == 1).select("row_id", F.col("g.value").alias("gender"))


@check(
    "jn_2_name_suffix",
    f"""WITH {SURVEY}, t AS (SELECT row_id, {S.first(NAME)} AS tok FROM survey) SELECT row_id,
 {S.suffix_case('tok', LEX.female_suffixes, LEX.male_suffixes, 'gender')} AS gender, {S.suffix_case('tok', LEX.female_suffixes, LEX.male_suffixes, 'suffix')} AS suffix FROM t""",
)
def name_suffix(spark, sf_dir):
    rows = survey(spark, sf_dir).withColumn("tok", first_token(F.col(NAME)))
    female, male = LEX.female_suffixes, LEX.male_suffixes
    return rows.select(
        "row_id",
        infer.gender_by_suffix(F.col("tok"), female, male).alias("gender"),
        F.coalesce(infer.first_suffix(F.col("tok"), female), infer.first_suffix(F.col("tok"), male)).alias("suffix"),
    )


_QUICK = {p: S.quick_gender(NAME, GUARDIAN, p) for p in ("value", "confidence", "tier")}


@check(
    "jn_3_guardian_cross_reference",
    f"WITH {SURVEY} SELECT row_id, {_QUICK['value']} AS value, {_QUICK['confidence']} AS confidence FROM survey WHERE {_QUICK['tier']} = 2",
)
def guardian_cross_reference(spark, sf_dir):
    rows = survey(spark, sf_dir).withColumn("g", infer.quick_gender(F.col(NAME), F.col(GUARDIAN)))
    return rows.where(F.col("g.tier") == 2).select("row_id", "g.value", "g.confidence")


_FILLED = f"({S.clean('gender')} IN ('male', 'female', 'others'))"
_OUTCOME = f"""outcome AS (SELECT row_id, gender, CASE WHEN {_FILLED} THEN 'already_filled' WHEN conf < 75 THEN 'cannot_determine'
 WHEN tier = 1 THEN 'tier1_direct' ELSE 'tier2_guardian' END AS outcome, value, conf FROM (SELECT row_id, gender, {_QUICK['value']} AS value, {_QUICK['confidence']} AS conf, {_QUICK['tier']} AS tier FROM survey))"""


@check(
    "inf_2_gender_quick",
    f"WITH {SURVEY}, {_OUTCOME} SELECT row_id, outcome, CASE WHEN outcome LIKE 'tier%' THEN value ELSE gender END AS gender, CASE WHEN outcome LIKE 'tier%' THEN conf END AS confidence FROM outcome",
)
def gender_quick(spark, sf_dir):
    filled = infer.fill_gender_quick(survey(spark, sf_dir), NAME, GUARDIAN, "gender")
    return filled.select("row_id", F.col("_outcome").alias("outcome"), "gender", F.col("_confidence").alias("confidence"))


@check(
    "agg_15_gender_stats",
    f"""WITH {SURVEY}, {_OUTCOME} SELECT count(*) AS total_processed, count(*) FILTER (outcome = 'already_filled') AS already_filled,
 count(*) FILTER (outcome LIKE 'tier%') AS inferred, count(*) FILTER (outcome = 'tier1_direct') AS tier1_direct, count(*) FILTER (outcome = 'tier2_guardian') AS tier2_guardian,
 count(*) FILTER (outcome = 'tier3_suffix') AS tier3_suffix, count(*) FILTER (outcome = 'cannot_determine') AS cannot_determine FROM outcome""",
)
def gender_counts(spark, sf_dir):
    return gender_stats(infer.fill_gender_quick(survey(spark, sf_dir), NAME, GUARDIAN, "gender"))


@check(
    "flt_5_rows_to_infer",
    f"WITH {SURVEY} SELECT row_id, gender FROM survey WHERE NOT {_FILLED}",
)
def rows_to_infer(spark, sf_dir):
    return survey(spark, sf_dir).where(~clean_val(F.col("gender")).isin(*VALID_GENDERS)).select("row_id", "gender")


_CATEGORY = S.category("survey", NAME, "district")
_CATEGORY_PLAIN = S.category("survey", NAME, "district", fuzzy=False)


@check("inf_3_category", f"WITH RECURSIVE {SURVEY}, {_CATEGORY} SELECT row_id, value, confidence, tier, {S.label('confidence')} AS label FROM guess_category")
def category(spark, sf_dir):
    return infer.with_category(survey(spark, sf_dir), NAME, LEX, "district", "c").select("row_id", "c.*")


def _plain_tier(tier: int):
    def query(spark, sf_dir):
        rows = infer.with_category(survey(spark, sf_dir), NAME, LEX, "district", "c", fuzzy=False)
        return rows.where(F.col("c.tier") == tier).select("row_id", "c.value", "c.confidence")

    return query


for _key, _tier in (("jn_4_exact_surname", 1), ("jn_7_any_token", 3), ("jn_8_district_prior", 4)):
    check(_key, f"WITH RECURSIVE {SURVEY}, {_CATEGORY_PLAIN} SELECT row_id, value, confidence FROM guess_category WHERE tier = {_tier}")(_plain_tier(_tier))


@check(
    "jn_5_ambiguous_surname",
    f"WITH {SURVEY}, {S.lex_surname()} SELECT lex_surname AS surname, lex_category AS category, lex_ambiguous AS is_ambiguous, count(*) AS n FROM survey JOIN lex_surname ON lex_surname = {S.last(NAME)} GROUP BY ALL",
)
def ambiguous_surname(spark, sf_dir):
    names = survey(spark, sf_dir).select(last_token(F.col(NAME)).alias("surname"))
    return names.join(F.broadcast(LEX.surname_table(spark)), "surname").groupBy("surname", "category", "is_ambiguous").agg(F.count(F.lit(1)).alias("n"))


@check(
    "jn_6_fuzzy_surname",
    f"WITH RECURSIVE {SURVEY}, {S.lex_surname()}, {S.near_surnames(f'SELECT {S.last(NAME)} AS token FROM survey')} SELECT token, surname, round(ratio, 9) AS ratio, category FROM near_surname",
)
def fuzzy_surname(spark, sf_dir):
    distinct = survey(spark, sf_dir).select(last_token(F.col(NAME)).alias("token")).distinct()
    return infer.nearest_surnames(distinct, LEX).select("token", "surname", F.round("ratio", 9).alias("ratio"), "category")


@check(
    "inf_4_category_single_tier",
    f"WITH {SURVEY}, {S.lex_surname()} SELECT row_id, coalesce(lex_category, '') AS value, CASE WHEN lex_category IS NULL THEN 0 ELSE 62 END AS confidence FROM survey LEFT JOIN lex_surname ON lex_surname = {S.last(NAME)}",
)
def category_single_tier(spark, sf_dir):
    return infer.with_category_single_tier(survey(spark, sf_dir), NAME, LEX, "c").select("row_id", "c.value", "c.confidence")


@check("inf_5_gender_correction", f"WITH {SURVEY}, {_GENDER}, {S.gender_fix('survey')} SELECT row_id, new_value AS value, confidence, method FROM fix_gender")
def gender_correction(spark, sf_dir):
    rows = infer.with_gender(survey(spark, sf_dir), NAME, LEX, "g")
    return rows.withColumn("r", infer.gender_resolution(F.col("gender"), F.col("g"))).select("row_id", "r.*")


_NEEDS = f"{S.norm_category('category')} NOT IN {S.in_list(VALID_CATEGORIES)}"
_CATEGORY_WANTED = S.category("survey", NAME, "district", where=_NEEDS)


@check(
    "inf_6_category_correction",
    f"WITH RECURSIVE {SURVEY}, {_CATEGORY_WANTED}, {S.category_fix('survey')} SELECT row_id, new_value AS value, confidence, method FROM fix_category",
)
def category_correction(spark, sf_dir):
    rows = infer.with_category(
        survey(spark, sf_dir), NAME, LEX, "district", "c", wanted=infer.needs_category(F.col("category"))
    )
    return rows.withColumn("r", infer.category_resolution(F.col("category"), F.col("c"))).select("row_id", "r.*")


_REVIEW = f"""rv AS (SELECT row_id, person_name, {S.extract_first(NAME)} AS first_name, {S.clean('gender')} AS cur, value, confidence, tier, gender FROM survey JOIN guess_gender USING (row_id)),
 rf AS (SELECT *, value <> '' AND value <> cur AS differs, concat_ws(', ', CASE WHEN cur = '' THEN 'blank_gender' END,
  CASE WHEN value <> '' AND cur <> '' AND value <> cur AND confidence >= 80 THEN 'strict_mismatch' END, CASE WHEN value <> '' AND cur <> '' AND value <> cur AND confidence < 80 THEN 'probable_mismatch' END) AS flags,
  CASE WHEN first_name = '' THEN '' ELSE 'GREV-' || (row_id + 2) || '-' || first_name END AS review_id FROM rv)"""


@check(
    "inf_7_gender_review",
    f"""WITH {SURVEY}, {_GENDER}, {_REVIEW} SELECT row_id, first_name, cur AS current_gender, value AS gender, confidence,
 'Tier ' || tier || ': ' || {S.label('confidence')} AS method, flags AS review_flags, 'corrected' AS kind FROM rf WHERE differs AND confidence >= 80""",
)
def gender_review(spark, sf_dir):
    review = infer.review_gender(survey(spark, sf_dir), NAME, "gender", LEX)
    columns = ["row_id", "first_name", "current_gender", "gender", "confidence", "method", "review_flags"]
    return review.corrections.select(*columns, F.lit("corrected").alias("kind")).unionByName(
        review.suggestions.select(*columns, F.lit("suggested").alias("kind"))
    )


@check(
    "prj_6_audit_columns",
    f"""WITH {SURVEY}, {_GENDER}, {_REVIEW} SELECT row_id, CASE WHEN differs AND confidence >= 80 THEN value ELSE gender END AS gender, flags AS "__REVIEW_FLAGS__",
 review_id AS "__REVIEW_ID__", '' AS "__SUGGESTED_GENDER__" FROM rf""",
)
def audit_columns(spark, sf_dir):
    data = infer.review_gender(survey(spark, sf_dir), NAME, "gender", LEX).data
    return data.select("row_id", "gender", "__REVIEW_FLAGS__", "__REVIEW_ID__", "__SUGGESTED_GENDER__")


# ---- change logs ---------------------------------------------------------------------------

_CHANGES = f"""{_GENDER}, {S.gender_fix('survey')}, {_CATEGORY_WANTED}, {S.category_fix('survey')},
 log AS (SELECT row_id, 'gender' AS field, old_value, new_value, confidence, method FROM fix_gender WHERE method IS NOT NULL
  UNION ALL SELECT row_id, 'category', old_value, new_value, confidence, method FROM fix_category WHERE method IS NOT NULL)"""


def change_log(spark, sf_dir):
    rows = infer.with_gender(survey(spark, sf_dir), NAME, LEX, "g")
    rows = rows.withColumn("_g", infer.gender_resolution(F.col("gender"), F.col("g")))
    rows = infer.with_category(rows, NAME, LEX, "district", "c", wanted=infer.needs_category(F.col("category")))
    rows = rows.withColumn("_c", infer.category_resolution(F.col("category"), F.col("c")))
    return infer.change_rows(rows, "gender", F.col("gender"), F.col("_g"), "row_id", NAME, GUARDIAN).unionByName(
        infer.change_rows(rows, "category", F.col("category"), F.col("_c"), "row_id", NAME, GUARDIAN)
    )


_LOG = ("row_id", "field", "old_value", "new_value", "confidence", "method")


@check("flt_2_low_confidence", f"WITH RECURSIVE {SURVEY}, {_CHANGES} SELECT * FROM log WHERE confidence < 75")
def low_confidence(spark, sf_dir):
    return audit.low_confidence(change_log(spark, sf_dir)).select(*_LOG)


@check("flt_3_changes_of_field", f"WITH RECURSIVE {SURVEY}, {_CHANGES} SELECT * FROM log WHERE field = 'category'")
def changes_of_field(spark, sf_dir):
    return audit.changes_of(change_log(spark, sf_dir), "category").select(*_LOG)


@check(
    "agg_3_changes_by_field_and_method",
    f"WITH RECURSIVE {SURVEY}, {_CHANGES} SELECT 'field' AS dimension, field AS value, count(*) AS n FROM log GROUP BY field UNION ALL SELECT 'method', method, count(*) FROM log GROUP BY method",
)
def changes_by(spark, sf_dir):
    return audit.changes_by_field_and_method(change_log(spark, sf_dir))


@check(
    "flt_4_blank_cells",
    f"""WITH {SURVEY} SELECT row_id, 'gender' AS "column" FROM survey WHERE {S.blank('gender')} UNION ALL SELECT row_id, 'category' FROM survey WHERE {S.blank('category')}""",
)
def blank_cells(spark, sf_dir):
    cells = F.array(*[F.when(is_blank(F.col(c)), F.lit(c)) for c in ("gender", "category")])
    return survey(spark, sf_dir).select("row_id", F.explode(F.array_compact(cells)).alias("column"))


@check(
    "agg_23_invalid_codes",
    f"""WITH {SURVEY}, v AS (SELECT 'gender' AS "column", {S.clean('gender')} AS value FROM survey WHERE {S.clean('gender')} NOT IN ('male','female','others','','nan')
  UNION ALL SELECT 'category', {S.clean('category')} FROM survey WHERE {S.clean('category')} NOT IN ('obc','st','sc','gen','sbc','pvtg','','nan')) SELECT "column", value, count(*) AS n FROM v GROUP BY ALL""",
)
def invalid_codes(spark, sf_dir):
    return audit.invalid_codes(survey(spark, sf_dir))


@check(
    "val_19_output_checks",
    f"""WITH {SURVEY}, s AS ({_SUMMARY}), f AS (SELECT * FROM {S.newest('survey', KEY, DATE, REAL)} UNION ALL SELECT * FROM survey WHERE {S.placeholder(KEY)})
 SELECT 'record_count' AS "check", original_records - duplicates_removed = (SELECT count(*) FROM f) AS passed, (SELECT count(*) FROM f) - original_records + duplicates_removed AS n FROM s
 UNION ALL SELECT 'columns_dropped', false, 1 UNION ALL SELECT 'columns_added', true, 0
 UNION ALL SELECT 'invalid_gender', false, count(DISTINCT {S.clean('gender')}) FROM f WHERE {S.clean('gender')} NOT IN ('male','female','others','','nan')
 UNION ALL SELECT 'invalid_category', false, count(DISTINCT {S.clean('category')}) FROM f WHERE {S.clean('category')} NOT IN ('obc','st','sc','gen','sbc','pvtg','','nan')""",
)
def output_checks(spark, sf_dir):
    df = survey(spark, sf_dir)
    cleaned = dedup.deduplicate(df, KEY, DATE).drop("village")
    return audit.output_checks(df, cleaned, dedup.dedup_summary(df, KEY))


@check(
    "set_3_column_changes",
    """SELECT 'dropped' AS kind, 'o_orderpriority' AS "column", count(o_orderpriority) AS filled FROM orders""",
)
def set_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kept = orders.drop("o_orderpriority")
    changed = [(kind, c) for kind, names in audit.column_changes(orders.columns, kept.columns).items() for c in names]
    counts = orders.agg(*[F.count(c).alias(c) for _, c in changed])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column"), F.col(c).alias("filled")) for k, c in changed])
    return counts.select(F.inline(rows))


# ---- comparisons and edits -----------------------------------------------------------------

_CLEANED = f"""{S.contact('survey', 'contact_number')}, {S.card('survey', 'job_card')}, cleaned AS (SELECT s.row_id,
 CASE WHEN {S.blank(NAME)} THEN person_name ELSE {S.proper(NAME)} END AS person_name, CASE WHEN k.is_valid AND k.was_changed THEN k.corrected ELSE contact_number END AS contact_number,
 CASE WHEN j.is_valid AND j.was_changed THEN j.corrected ELSE job_card END AS job_card FROM survey s JOIN contact k USING (row_id) JOIN card j USING (row_id))"""


@check(
    "jn_14_cell_differences",
    f"WITH {SURVEY}, {_CLEANED} "
    + " UNION ALL ".join(
        f"""SELECT row_id, '{c}' AS "column", coalesce(trim(a.{c}), '') AS old_value, coalesce(trim(b.{c}), '') AS new_value FROM survey a JOIN cleaned b USING (row_id)
 WHERE coalesce(trim(a.{c}), '') <> coalesce(trim(b.{c}), '')"""
        for c in (NAME, "contact_number", "job_card")
    ),
)
def cell_differences(spark, sf_dir):
    before = survey(spark, sf_dir)
    after = correct_cards(correct_contacts(format_names(before, [NAME]), "contact_number").data, "job_card").data
    return edits.cell_differences(before, after, [NAME, "contact_number", "job_card"])


@check(
    "jn_15_survivors",
    f"WITH {SURVEY}, m AS {S.newest('survey', KEY, DATE)} SELECT row_id, row_id IN (SELECT row_id FROM m) AS survives FROM survey",
)
def survivors(spark, sf_dir):
    df = survey(spark, sf_dir)
    kept = audit.survivors(df, KEY, DATE).withColumn("survives", F.lit(True))
    return df.select("row_id").join(kept, "row_id", "left").select("row_id", F.coalesce("survives", F.lit(False)).alias("survives"))


@check("jn_16_frozen_columns", f"WITH {SURVEY} SELECT row_id FROM survey WHERE trim(district) <> district")
def frozen_columns(spark, sf_dir):
    before = survey(spark, sf_dir)
    after = before.withColumns({"gender": F.lower("gender"), "district": F.trim("district")})
    return edits.frozen_violations(before, after, [c for c in before.columns if c not in ("row_id", "gender")])


@check(
    "jn_17_apply_edits",
    f"""WITH {derived('survey', 'edits')} SELECT row_id, CASE WHEN e.field = 'gender' THEN e.value ELSE gender END AS gender, CASE WHEN e.field = 'category' THEN e.value ELSE category END AS category
 FROM survey LEFT JOIN edits e USING (row_id)""",
)
def apply_edits(spark, sf_dir):
    return edits.apply_edits(survey(spark, sf_dir), fixture(spark, sf_dir, "edits")).data.select("row_id", "gender", "category")


@check("flow_10_review_loop", f"WITH {derived('survey', 'edits')} SELECT count(*) AS applied FROM edits JOIN survey USING (row_id) WHERE field IN ('gender', 'category')")
def applied_edits(spark, sf_dir):
    return edits.apply_edits(survey(spark, sf_dir), fixture(spark, sf_dir, "edits")).applied


@check(
    "jn_18_compare_tables",
    f"""WITH {SURVEY}, r AS {S.newest('survey', KEY, DATE)}, c AS (SELECT (SELECT count(*) FROM survey) AS a, (SELECT count(*) FROM r) AS b) SELECT a AS left_rows, b AS right_rows,
 a - b AS left_only_rows, 0::BIGINT AS right_only_rows, a - b AS row_difference, 'village' AS columns_left_only, 'checked' AS columns_right_only FROM c""",
)
def compare_tables(spark, sf_dir):
    df = survey(spark, sf_dir)
    return edits.compare_tables(df, dedup.merged(df, KEY, DATE).drop("village").withColumn("checked", F.lit(True)))


# ---- spelling ------------------------------------------------------------------------------

_SPELL = S.spelling("survey", NAME)


def _unknown(spark, sf_dir):
    return spelling.unknown_tokens(spelling.name_tokens(survey(spark, sf_dir), NAME), LEX)


@check("jn_9_phonetic_candidates", f"WITH RECURSIVE {SURVEY}, {_SPELL} SELECT vocab, token, word, distance::INTEGER AS distance FROM spell_phon WHERE distance <= 2")
def phonetic_candidates(spark, sf_dir):
    return spelling.phonetic_candidates(_unknown(spark, sf_dir), LEX)


@check("jn_10_similar_candidates", f"WITH RECURSIVE {SURVEY}, {_SPELL} SELECT vocab, token, word, distance::INTEGER AS distance FROM spell_sim WHERE distance <= 2")
def similar_candidates(spark, sf_dir):
    return spelling.similar_candidates(_unknown(spark, sf_dir), LEX)


@check(
    "ord_5_best_candidate",
    f"WITH RECURSIVE {SURVEY}, {_SPELL} SELECT vocab, token, corrected, confidence, method, status FROM spell_fix",
)
def best_candidate(spark, sf_dir):
    return spelling.token_corrections(_unknown(spark, sf_dir), LEX)


_SPELL_LOG = """SELECT t.row_id, 'person_name' AS "column", t.name AS name_before, r.fixed AS name_after, t.role, t.original AS original_token, f.corrected AS corrected_token,
 f.confidence, f.method, f.status FROM spell_tokens t JOIN spell_fix f ON f.vocab = t.vocab AND f.token = t.token JOIN spell_rebuilt r ON r.row_id = t.row_id"""


@check("inf_8_spelling", f"WITH RECURSIVE {SURVEY}, {_SPELL} {_SPELL_LOG}")
def spelling_changes(spark, sf_dir):
    return spelling.spell_check(survey(spark, sf_dir), NAME, LEX).changes


@check("inf_8_spelling_data", f"WITH RECURSIVE {SURVEY}, {_SPELL} SELECT row_id, fixed AS person_name FROM spell_rebuilt")
def spelling_data(spark, sf_dir):
    return spelling.spell_check(survey(spark, sf_dir), NAME, LEX).data.select("row_id", NAME)


@check(
    "agg_16_spell_summary",
    f"""WITH RECURSIVE {SURVEY}, {_SPELL}, l AS ({_SPELL_LOG}) SELECT count(*) AS corrections, count(DISTINCT row_id) AS rows_touched,
 count(*) FILTER (status = 'corrected') AS auto, count(*) FILTER (status = 'review') AS review FROM l""",
)
def spell_summary(spark, sf_dir):
    return audit.spell_summary(spelling.spell_check(survey(spark, sf_dir), NAME, LEX).changes)


@check(
    "set_4_vocabulary",
    f"""WITH {SURVEY}, {S.lex_vocab()}, t AS (SELECT 'given' AS vocab, {S.first(NAME)} AS token FROM survey UNION ALL SELECT 'surname', {S.last(NAME)} FROM survey)
 SELECT vocab, token IN (SELECT word FROM lex_vocab v WHERE v.vocab = t.vocab) AS known, count(*) AS n FROM t GROUP BY ALL""",
)
def vocabulary(spark, sf_dir):
    df = survey(spark, sf_dir)
    tokens = df.select(F.lit("given").alias("vocab"), first_token(F.col(NAME)).alias("word")).unionByName(
        df.select(F.lit("surname").alias("vocab"), last_token(F.col(NAME)).alias("word"))
    )
    known = LEX.spelling_vocabulary(spark).withColumn("known", F.lit(True))
    joined = tokens.join(F.broadcast(known), ["vocab", "word"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return joined.groupBy("vocab", "known").agg(F.count(F.lit(1)).alias("n"))


# ---- libraries -----------------------------------------------------------------------------

EVIDENCE = derived("evidence")
_LIB = S.evidence_ctes()


def evidence(spark, sf_dir):
    return library.evidence_counts(library.name_gender_pairs(fixture(spark, sf_dir, "evidence"), "first_raw", "gender_raw"))


@check("src_8_name_gender_pairs", f"WITH {EVIDENCE}, {_LIB} SELECT * FROM pairs")
def pairs(spark, sf_dir):
    return library.name_gender_pairs(fixture(spark, sf_dir, "evidence"), "first_raw", "gender_raw")


@check("agg_17_evidence_counts", f"WITH {EVIDENCE}, {_LIB} SELECT * FROM per_file")
def evidence_counts(spark, sf_dir):
    return evidence(spark, sf_dir)


@check("agg_18_conflicts", f"WITH {EVIDENCE}, {_LIB} SELECT * FROM ambiguous")
def conflicts(spark, sf_dir):
    return library.ambiguous_names(evidence(spark, sf_dir))


@check("agg_18_strict_library", f"WITH {EVIDENCE}, {_LIB} SELECT * FROM strict")
def strict_library(spark, sf_dir):
    return library.strict_library(evidence(spark, sf_dir))


@check("agg_19_dominant_gender", f"WITH {EVIDENCE}, {_LIB} SELECT * FROM prob0")
def dominant_gender(spark, sf_dir):
    return library.prob_candidates(evidence(spark, sf_dir))


@check("agg_20_source_files", f"WITH {EVIDENCE}, {_LIB} SELECT DISTINCT name, source_file FROM per_file")
def source_files(spark, sf_dir):
    return library.name_sources(evidence(spark, sf_dir))


@check(
    "agg_21_library_sizes",
    f"""WITH {EVIDENCE}, {_LIB}, u AS (SELECT 'strict' AS library, gender FROM strict UNION ALL SELECT 'prob', gender FROM prob) SELECT library, count(*) AS entries,
 count(*) FILTER (gender = 'male') AS male, count(*) FILTER (gender = 'female') AS female FROM u GROUP BY library""",
)
def library_sizes(spark, sf_dir):
    counts = evidence(spark, sf_dir)
    strict = library.strict_library(counts)
    return library.library_sizes(strict, library.without_strict(library.prob_candidates(counts), strict))


@check(
    "jn_12_strict_excluded_and_promoted",
    f"""WITH {EVIDENCE}, {_LIB} SELECT name, 'prob' AS kind FROM prob UNION ALL SELECT name, 'promoted' FROM prob0 WHERE name IN (SELECT name FROM strict)""",
)
def strict_excluded(spark, sf_dir):
    counts = evidence(spark, sf_dir)
    built = library.build_libraries(counts, counts)
    return built.prob.select("name", F.lit("prob").alias("kind")).unionByName(built.promoted.withColumn("kind", F.lit("promoted")))


_EARLIER = """earlier AS (SELECT name FROM (SELECT name, sum(male) AS m, sum(female) AS f FROM per_file WHERE source_file <> 'f0.csv' GROUP BY name) WHERE (m = 0 OR f = 0) AND m + f >= 2)"""


@check("jn_13_demoted", f"WITH {EVIDENCE}, {_LIB}, {_EARLIER} SELECT name, name NOT IN (SELECT name FROM ambiguous) AS kept FROM earlier")
def demoted(spark, sf_dir):
    counts = evidence(spark, sf_dir)
    earlier = library.strict_library(counts.where(F.col("source_file") != "f0.csv"))
    kept = library.demote(earlier, library.ambiguous_names(counts)).select("name", F.lit(True).alias("kept"))
    return earlier.select("name").join(kept, "name", "left").select("name", F.coalesce("kept", F.lit(False)).alias("kept"))


@check(
    "jn_11_library_lookup",
    f"""WITH {EVIDENCE}, {_LIB}, l AS (SELECT name, gender, 95 AS confidence, 'strict' AS layer FROM strict UNION ALL SELECT name, gender, floor(confidence * 80)::INTEGER, 'prob' FROM prob)
 SELECT e.first_raw, l.gender, l.confidence, l.layer, count(*) AS n FROM evidence e LEFT JOIN l ON l.name = {S.first('first_raw')} GROUP BY ALL""",
)
def library_lookup(spark, sf_dir):
    counts = evidence(spark, sf_dir)
    table_ = library.lookup_table(library.strict_library(counts), library.prob_candidates(counts))
    rows = fixture(spark, sf_dir, "evidence").withColumn("name", first_token(F.col("first_raw")))
    return lookup(rows, table_, ["name"]).groupBy("first_raw", "gender", "confidence", "layer").agg(F.count(F.lit(1)).alias("n"))


@check(
    "inf_1_gender_with_library",
    f"""WITH {EVIDENCE}, {_LIB}, {S.lex_first()}, l AS (SELECT name, gender, 95 AS confidence FROM strict UNION ALL SELECT name, gender, floor(confidence * 80)::INTEGER FROM prob),
 g AS (SELECT first_raw, CASE WHEN lex_gender IS NOT NULL THEN 1 WHEN l.gender IS NOT NULL THEN 3 ELSE 0 END AS tier, coalesce(lex_gender, l.gender, '') AS value,
  CASE WHEN lex_gender IS NOT NULL THEN 95 ELSE coalesce(l.confidence, 0) END AS confidence FROM evidence LEFT JOIN lex_first ON lex_name = {S.first('first_raw')} LEFT JOIN l ON l.name = {S.first('first_raw')})
 SELECT first_raw, value, confidence, tier, {S.label('confidence')} AS label, count(*) AS n FROM g GROUP BY ALL""",
)
def gender_with_library(spark, sf_dir):
    counts = evidence(spark, sf_dir)
    table_ = library.lookup_table(library.strict_library(counts), library.prob_candidates(counts))
    rows = infer.with_gender(fixture(spark, sf_dir, "evidence"), "first_raw", LEX, "g", table_)
    return rows.groupBy("first_raw", "g.value", "g.confidence", "g.tier", "g.label").agg(F.count(F.lit(1)).alias("n"))


@check(
    "flt_5_labels_by_row",
    f"WITH {SURVEY}, {_GENDER} SELECT {S.label('confidence')} AS label, {_FILLED} AS filled, count(*) AS n FROM survey JOIN guess_gender USING (row_id) GROUP BY ALL",
)
def labels_by_row(spark, sf_dir):
    rows = infer.with_gender(survey(spark, sf_dir), NAME, LEX, "g")
    return rows.groupBy(
        confidence_label(F.col("g.confidence")).alias("label"), clean_val(F.col("gender")).isin(*VALID_GENDERS).alias("filled")
    ).agg(F.count(F.lit(1)).alias("n"))

