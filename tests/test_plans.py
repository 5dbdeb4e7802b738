"""Runs: modes, audit, engines, records, learning."""

import functools
import os

import pytest
from pyspark.sql import functions as F

from surveyloom.operators import library
from surveyloom.plans import batch, engines, learning, records
from surveyloom.plans.context import Context
from surveyloom.sources import sinks, versions
from surveyloom.plans import survey as survey_plan
from surveyloom.plans.survey import SurveyConfig, audit_tables, merged_table, review_table, run_summary, run_survey, with_stored_trail, write_run

COLUMNS = ["row_id", "Unique Key", "farmer_name", "father_spouse_name", "SubmissionDate", "date_of_survey", "district", "Village Name", "gender", "category", "contact_number", "mgnrega"]
ROWS = [
    (0, "UK1", "RAMESH meshram", "Sita Devi", "2024-01-01", "2024-01-01", "pune", "A", "M", "OBC", "9876543210", None),
    (1, "UK1", "RAMESH meshram", "Sita Devi", "2024-02-01", "bad", "pune", "A", "female", "obc", "9876543210", None),
    (2, "UK2", "sunitta mesharam", None, "2024-02-01", None, "pune", "A", None, None, "98765", None),
    (3, "test", "Xyz Zzz", None, "2024-02-01", "2024-01-01", "Gadchiroli", "B", "Other", "gENERAL", None, None),
    (4, "UK3", "Xyz madavi Zzz", None, None, "2024-01-01", "Gadchiroli", "B", "others", "zz", None, None),
    (5, "UK4", "Asha PATIL", None, None, "2024-01-01", "x", "B", "female", "", None, None),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "row_id long, " + ", ".join(f"`{c}` string" for c in COLUMNS[1:]))


def test_global_run(df):
    run = run_survey(df, SurveyConfig())
    data = {r["row_id"]: r for r in run.data.collect()}
    assert set(data) == {1, 2, 3, 4, 5}
    assert data[1]["gender"] == "male" and data[1]["category"] == "obc" and data[1]["farmer_name"] == "Ramesh Meshram"
    assert data[2]["farmer_name"] == "Sunita Meshram" and data[2]["category"] == "sc"
    assert data[3]["gender"] == "other" and data[3]["category"] == "gENERAL"
    assert data[4]["category"] == "st" and data[5]["category"] == "gen"
    changes = {(r["row_id"], r["field"]): (r["new_value"], r["confidence"], r["method"]) for r in run.changes.collect()}
    assert changes == {
        (1, "gender"): ("male", 95, "Name Analysis"),
        (2, "category"): ("sc", 74, "Surname Heuristic"),
        (4, "category"): ("st", 68, "Surname Heuristic"),
        (5, "category"): ("gen", 62, "Surname Heuristic"),
    }
    assert [r["row_id"] for r in run.date_issues.collect()] == [1]
    assert run.placeholders.first()["suggested_key"] == "SURR_xyz_zzz__b__2024-02-01"
    summary = run_summary(run).first()
    assert (summary["original_records"], summary["duplicates_removed"], summary["final_records"], summary["auto_corrections"]) == (6, 1, 5, 4)
    assert set(audit_tables(run)) == {
        "summary", "all_changes", "gender_changes", "category_changes", "review_needed", "duplicate_summary", "date_issues",
        "placeholder_ids", "name_corrections",
    }
    flags = {(r["row_id"], r["column"]): r["flag"] for r in review_table(run, SurveyConfig()).collect()}
    assert flags[1, "gender"] == "gender" and flags[2, "gender"] == "missing" and flags[1, "date_of_survey"] == "date"


def test_dry_run_changes_nothing(df):
    context = Context.advisory(rules=["auto_correct", "auto_correct_gender", "auto_correct_category", "format_name", "spell_check"])
    run = run_survey(df, SurveyConfig(), context)
    assert run.data.exceptAll(df).count() == 0 and run.data.count() == df.count()
    assert run.changes.count() > 0 and run.spell_changes.count() > 0
    assert merged_table(run, SurveyConfig(), context).count() == df.count()


def test_selective_run_touches_only_the_selection(df):
    context = Context.selective(["gender"], ["auto_correct", "auto_correct_gender", "format_name", "spell_check"])
    run = run_survey(df, SurveyConfig(), context)
    assert run.guard.count() == 0
    others = [c for c in COLUMNS if c != "gender"]
    assert run.data.select(others).exceptAll(df.select(others)).count() == 0
    assert {r["field"] for r in run.changes.collect()} == {"gender"}


def test_rules_off_means_no_plan_steps(df):
    run = run_survey(df, SurveyConfig(), Context.selective([], []))
    assert run.data.exceptAll(df).count() == 0 and run.changes.count() == 0


def test_missing_columns_skip_their_steps(df):
    run = run_survey(df.select("row_id", "farmer_name"), SurveyConfig())
    assert run.data.count() == 6 and run.changes.count() == 0 and run.date_issues.count() == 0


def test_majority_vote_runs_only_without_dedup(spark):
    rows = [(i, "K", "Xyz Zzz", "male" if i < 4 else "female", "x") for i in range(5)]
    df = spark.createDataFrame(rows, "row_id long, `Unique Key` string, farmer_name string, gender string, SubmissionDate string")
    run = run_survey(df, SurveyConfig(), Context.selective(["gender"], ["auto_correct"]))
    assert [(r["row_id"], r["new_value"], r["confidence"], r["method"]) for r in run.changes.collect()] == [(4, "male", 82, "Majority Vote")]
    assert {r["gender"] for r in run.data.collect()} == {"male"}


def test_written_outputs(spark, df, tmp_path):
    run = run_survey(df, SurveyConfig())
    out = write_run(run, SurveyConfig(), str(tmp_path / "run"))
    assert spark.read.parquet(out["cleaned"]).count() == 5
    assert spark.read.parquet(out["merged"]).count() == 5
    assert spark.read.parquet(out["snapshot"]).exceptAll(df).count() == 0
    assert spark.read.json(out["suggestions/changes"]).count() == 4
    out = write_run(run, SurveyConfig(), str(tmp_path / "csv"), fmt="csv", partition_by=["district"])
    assert spark.read.option("header", True).csv(out["cleaned"]).count() == 5
    out = write_run(run, SurveyConfig(), str(tmp_path / "parts"), partition_by=["district"])
    assert spark.read.parquet(out["merged"]).where("district = 'pune'").count() == 2


def test_file_batch_keeps_files_apart(spark, df):
    both = df.withColumn("source_file", F.lit("a.csv")).unionByName(
        df.withColumn("source_file", F.lit("b.csv")).withColumn("row_id", F.col("row_id") + 100)
    )
    run = batch.run_batch(both, SurveyConfig(scope=()))
    summary = {r["source_file"]: r for r in batch.file_summary(run).collect()}
    assert {f: (r["original_records"], r["final_records"], r["auto_corrections"]) for f, r in summary.items()} == {"a.csv": (6, 5, 4), "b.csv": (6, 5, 4)}
    total = batch.batch_totals(batch.file_summary(run)).where("source_file = 'TOTAL'").first()
    assert (total["files"], total["original_records"], total["duplicates_removed"]) == (2, 12, 2)


def test_record_details(spark):
    rows = [("RAMESH kumar", "", "+91 9876543210", "", "", ""), ("Zz Qq", "", "123", "bad", "M", "SC")]
    df = spark.createDataFrame(rows, "farmer_name string, father_or_spouse string, contact_number string, mgnrega_card string, gender string, category string")
    first, second = records.process_records(df, SurveyConfig().lexicons).collect()
    assert (first["farmer_name"], first["contact_number"], first["gender"]) == ("Ramesh Kumar", "9876543210", "male")
    assert [v["field"] for v in first["validations"]] == ["farmer_name", "contact_number", "mgnrega_card"]
    assert [(i["field"], i["value"], i["tier"]) for i in first["inferences"]] == [("gender", "male", 1), ("category", "", 0)]
    assert second["has_invalid_fields"] and not second["has_inferences"] and second["gender"] == "m"
    skipped = records.process_records(df, SurveyConfig().lexicons, Context.selective([], []))
    assert {v["reason"] for r in skipped.collect() for v in r["validations"]} == {records.SKIPPED}
    dry = records.process_records(df, SurveyConfig().lexicons, Context.advisory()).first()
    assert dry["farmer_name"] == "RAMESH kumar" and dry["has_corrections"]


def test_quick_gender_table(spark):
    cases = [
        ("Jijabai Patil", "", "female", 95), ("Ramesh Kumar", "", "male", 95), ("Parbata Rathod", "", "male", 95),
        ("Sunderbai Kamble", "", "", 72), ("Shamrao Patil", "", "male", 95), ("Unknown Person", "Sita Devi", "male", 82),
    ]
    df = spark.createDataFrame([(i, n, g, "") for i, (n, g, _, _) in enumerate(cases)], "row_id int, farmer_name string, father_spouse_name string, gender string")
    step = engines.gender_inference(df, engines.EngineConfig())
    assert [r["gender"] for r in step.data.orderBy("row_id").collect()] == [c[2] for c in cases]
    loose = engines.gender_inference(df, engines.EngineConfig(min_confidence=70))
    assert loose.data.where("row_id = 3").first()["gender"] == "female"


def test_engine_choice(spark, df):
    with pytest.raises(ValueError):
        engines.run_engines(df, engines.EngineConfig(), ["nope"])
    only = engines.run_engines(df, engines.EngineConfig(), ["duplicate_removal"])
    assert only.data.count() == 5
    assert {r["engine"] for r in only.stats.collect()} == {"duplicate_removal"}


@pytest.mark.parametrize("context", [Context(), Context.advisory(), Context.selective(["gender", "farmer_name"], ["auto_correct", "auto_correct_gender", "format_name", "spell_check"])])
def test_trail_tells_what_a_comparison_of_tables_tells(spark, df, context):
    from surveyloom.operators import audit

    config = SurveyConfig()
    rows = df.unionByName(df.withColumn("row_id", F.col("row_id") + 10).withColumn("gender", F.when(F.col("row_id") % 2 == 0, "male")))
    run = run_survey(rows, config, context)
    compared = audit.review_flags(run.original, run.data, run.changes, run.spell_changes, run.date_issues, config.roles(), "row_id")
    told = review_table(run, config)
    key = lambda r: (r["row_id"], str(r["column"]), r["flag"])
    assert sorted(map(key, told.collect())) == sorted(map(key, compared.collect())) and told.count() > 5
    summary = run_summary(run).first()
    assert summary["auto_corrections"] == run.changes.count() and summary["spell_corrections"] == run.spell_changes.count()
    assert summary["date_issues"] == run.date_issues.count() and summary["final_records"] == run.data.count() and summary["original_records"] == 12
    assert (run.guard is None) == (context.columns is None) and (run.guard is None or run.guard.count() == 0)


def evidence_rows(spark, files):
    rows = [(n, g, f) for f, pairs in files.items() for n, g in pairs]
    data = spark.createDataFrame(rows, "farmer_name string, gender string, source_file string")
    sums = spark.createDataFrame([(f, str(sorted(p))) for f, p in files.items()], "file_name string, checksum string")
    return learning.Tier(data, sums)


def test_incremental_rebuild_equals_full(spark, tmp_path):
    verified = {"a.csv": [("Asha x", "Female"), ("Asha y", "female"), ("Ravi", "male")], "b.csv": [("ravi", "Male"), ("Kiran", "male"), ("kiran", "female")]}
    noisy = {"n.csv": [("neel", "male")] * 19 + [("neel", "female")] + [("asha", "female")] * 3}
    root, fresh = str(tmp_path / "step"), str(tmp_path / "full")
    learning.rebuild(spark, root, evidence_rows(spark, {"a.csv": verified["a.csv"]}), evidence_rows(spark, noisy))
    # A changed file replaces what it had contributed before.
    verified["a.csv"] = [("Asha x", "Female"), ("Asha y", "female")]
    report = learning.rebuild(spark, root, evidence_rows(spark, verified), evidence_rows(spark, noisy))
    assert report["status"] == "success" and report["new_verified"] == 2 and report["new_unverified"] == 0
    learning.rebuild(spark, fresh, evidence_rows(spark, verified), evidence_rows(spark, noisy), full=True)
    for name in ("strict", "ambiguous", "prob"):
        a, b = learning.library_table(spark, root, name), learning.library_table(spark, fresh, name)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert [r["name"] for r in learning.library_table(spark, root, "strict").collect()] == ["asha"]
    prob = learning.library_table(spark, root, "prob").collect()
    assert [(r["name"], r["confidence"]) for r in prob] == [("neel", 0.95)]
    assert learning.rebuild(spark, root, evidence_rows(spark, verified), evidence_rows(spark, noisy), dry_run=True)["new_verified"] == 0
    files = evidence_rows(spark, {**verified, "c.csv": []}).files
    status = learning.library_status(spark, root, files, evidence_rows(spark, noisy).files).collect()
    assert [(r["tier"], r["file_name"], r["status"]) for r in status] == [("verified", "c.csv", "NEW")]


def test_pairs_need_their_columns(spark):
    with pytest.raises(ValueError):
        library.name_gender_pairs(spark.range(1), "farmer_name", "gender")


def test_failing_tier_is_reported(spark, tmp_path):
    good = evidence_rows(spark, {"n.csv": [("neel", "male")] * 3})
    bad = learning.Tier(good.rows.drop("gender"), good.files)
    report = learning.rebuild(spark, str(tmp_path / "p"), bad, good)
    assert report["status"] == "partial" and report["strict_error"] and report["prob_entries"] == 1


class Lost(BaseException):
    """Ends a rebuild as a lost driver does."""


def test_rebuild_lost_after_any_write_leaves_the_old_state(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lib")
    old, new = {"a.csv": [("asha", "female")] * 2}, {"a.csv": [("asha", "female")] * 2, "b.csv": [("ravi", "male")] * 3}
    noisy = {"n.csv": [("neel", "male")] * 4}
    learning.rebuild(spark, root, evidence_rows(spark, old), evidence_rows(spark, noisy))

    def seen():
        names = {t: sorted(learning.library_table(spark, root, t).collect()) for t in ("strict", "prob", "ambiguous")}
        status = learning.library_status(spark, root, evidence_rows(spark, new).files, evidence_rows(spark, noisy).files)
        return names, sorted(status.collect())

    before = seen()
    for last in range(10):  # 9 tables and the commit
        left = [last]

        def lose(*args, left=left, do=None, **kw):
            if not left[0]:
                raise Lost
            left[0] -= 1
            return do(*args, **kw)

        with monkeypatch.context() as m:
            for module, name in ((learning, "write_table"), (learning, "write_library"), (versions, "commit")):
                m.setattr(module, name, functools.partial(lose, do=getattr(module, name)))
            with pytest.raises(Lost):
                learning.rebuild(spark, root, evidence_rows(spark, new), evidence_rows(spark, {**noisy, "m.csv": [("x", "male")]}))
        assert seen() == before
    assert learning.rebuild(spark, root, evidence_rows(spark, new), evidence_rows(spark, noisy))["version"] == 2
    assert [r["name"] for r in learning.library_table(spark, root, "strict").orderBy("name").collect()] == ["asha", "ravi"]
    assert [r["name"] for r in learning.library_table(spark, root, "strict", 1).collect()] == ["asha"]


def test_releases_conflict_and_are_swept(spark, tmp_path):
    root = str(tmp_path / "set")
    put = lambda base, n: versions.commit(spark, base, {"t": sinks.write_table(spark.range(n), f"{root}/v-{n}").removeprefix(f"{root}/")})
    one = put(versions.latest(spark, root), 1)
    two = put(one, 2)
    with pytest.raises(versions.Conflict):
        put(one, 3)
    three = put(two, 4)
    assert versions.latest(spark, root) == three and versions.numbers(spark, root) == [1, 2, 3]
    assert versions.sweep(spark, root, keep=2) == ["v-1"] and versions.numbers(spark, root) == [2, 3]
    assert os.path.exists(f"{root}/v-3") and versions.sweep(spark, root, keep=2, orphan_hours=-1) == ["v-3"]
    assert versions.read(spark, two, "t", "id long").count() == 2 and versions.read(spark, three, "none", "id long").count() == 0


def test_votes_and_flags_stay_within_a_file(spark):
    from surveyloom.operators import audit, vote

    rows = [(i, "k1", f, v, "n") for i, (f, v) in enumerate([("a", "female"), ("a", "female"), ("a", "female"), ("a", "male"), ("b", "male"), ("c", None)])]
    df = spark.createDataFrame(rows, "row_id long, k string, f string, v string, n string")
    whole, each = vote.majority_vote(df, "k", "v", "n"), vote.majority_vote(df, "k", "v", "n", scope=("f",))
    assert {r["row_id"] for r in whole.changes.collect()} >= {3, 4}
    assert {r["row_id"] for r in each.changes.collect()} == {3}
    assert {r["row_id"]: r["v"] for r in each.data.collect()}[4] == "male"
    assert each.data.columns == df.columns
    once = df.where("row_id in (0, 4, 5)")
    assert audit.duplicate_rows(once, "k", None).count() == 2
    assert audit.duplicate_rows(once, "k", None, scope=("f",)).count() == 0


def test_file_summary_lists_every_file(spark, df):
    run = batch.run_batch(df.withColumn("source_file", F.lit("a.csv")), SurveyConfig())
    states = spark.createDataFrame([("a.csv", "success", None), ("b.csv", "failed", "why"), ("c.csv", "empty", None)], "source_file string, status string, error string")
    summary = batch.file_summary(run, outcomes=states)
    assert {r["source_file"]: (r["original_records"], r["status"], r["error"]) for r in summary.collect()} == {
        "a.csv": (6, "success", None), "b.csv": (0, "failed", "why"), "c.csv": (0, "empty", None),
    }
    total = batch.batch_totals(summary).where("source_file = 'TOTAL'").first()
    assert (total["files"], total["original_records"]) == (1, 6)


def test_outputs_are_projections_of_a_stored_trail(df, tmp_path, monkeypatch):
    """Formatted names are stored with the resolved rows and a written run corrects the names once; each output once did both anew."""
    staged = {}
    monkeypatch.setattr(survey_plan, "stage", lambda d, label, real=survey_plan.stage: staged.setdefault(label, []).append(real(d, label)) or staged[label][-1])
    run = run_survey(df, SurveyConfig())
    assert "_named" in staged["resolved"][0].columns and "_named" not in run.data.columns + run.resolved.columns
    kept = with_stored_trail(run)
    assert "Join" not in kept.data._jdf.queryExecution().executedPlan().toString()
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(kept.data) == rows(run.data) and rows(review_table(kept, SurveyConfig())) == rows(review_table(run, SurveyConfig()))
    staged.clear()
    out = write_run(run, SurveyConfig(), str(tmp_path / "once"))
    assert list(staged) == ["trail"]
    assert rows(df.sparkSession.read.parquet(out["cleaned"]).select(*run.data.columns)) == rows(run.data)
