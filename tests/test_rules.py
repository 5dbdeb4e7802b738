"""Schema rules, export, sources."""

import bz2
import csv
import gzip
import hashlib
import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from surveyloom.operators import export, rules
from surveyloom.plans import batch
from surveyloom.plans.profile import profile, profile_file
from surveyloom.plans.survey import SurveyConfig
from surveyloom.sources import inspect, manifest, sinks, tables

GOOD = {
    "household_id": "HHMH00000001", "family_head_name": "Asha", "social_category": "SC", "state_code": "27", "district_code": "505", "block_code": "1",
    "gp_code": "1", "village_code": "1", "latitude": "20.1", "longitude": "79.2", "location_accuracy": "5", "land_holding_acres": "1", "irrigation_source": "WELL",
    "primary_crop": "rice", "cattle_count": "1", "goat_count": "1", "poultry_count": "1", "bank_account_number": "123456789", "ifsc_code": "ABCD0123456",
    "shg_member": "YES", "shg_name": "Group", "mahila_kisan": "NO", "krishi_sakhi_trained": "NO", "mobile_number": "9876543210",
}


def household(spark, *faults):
    rows = []
    for i, fault in enumerate(({}, *faults)):
        row = {**GOOD, "aadhaar_number": f"{100000000000 + i}", **fault}
        rows.append((i, *row.values()))
    names = [*GOOD, "aadhaar_number"]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{n} string" for n in names))


def found(issues):
    return {(r["type"], r["field"]): r for r in issues.collect()}


def test_clean_table_has_only_the_pii_note(spark):
    assert set(found(rules.validate_table(household(spark)))) == {
        ("PII_COMPLIANCE", "family_head_name, bank_account_number, mobile_number, aadhaar_number")
    }
    assert not found(rules.validate_table(household(spark), encryption_enabled=True))


def test_one_fault_per_rule(spark):
    faults = [
        {"household_id": "hh1"}, {"family_head_name": "x" * 101}, {"social_category": "Genral"}, {"state_code": "MH"}, {"district_code": "0"}, {"latitude": "north"},
        {"land_holding_acres": "2", "irrigation_source": None}, {"shg_name": " "}, {"shg_member": ""}, {"mobile_number": "5123456789"},
        {"aadhaar_number": "100000000000"}, {"primary_crop": "100000000123"}, {"ifsc_code": "abcd0123456"},
    ]
    issues = found(rules.validate_table(household(spark, *faults), encryption_enabled=True))
    assert set(issues) == {
        ("PATTERN_MISMATCH", "household_id"), ("MAX_LENGTH_EXCEEDED", "family_head_name"), ("INVALID_ENUM_VALUE", "social_category"),
        ("TYPE_MISMATCH", "state_code"), ("INVALID_LGD_CODE_TYPE", "state_code"), ("INVALID_LGD_CODE_RANGE", "district_code"), ("TYPE_MISMATCH", "latitude"),
        ("DATA_INCONSISTENCY", "irrigation_source"), ("BUSINESS_RULE_VIOLATION", "shg_name"), ("NULL_IN_REQUIRED_FIELD", "shg_member"),
        ("PATTERN_MISMATCH", "mobile_number"), ("DUPLICATE_AADHAAR", "aadhaar_number"), ("PII_SPILLOVER", "primary_crop"), ("PATTERN_MISMATCH", "ifsc_code"),
    }
    assert all(r["n"] == 1 for r in issues.values())
    assert issues["PATTERN_MISMATCH", "household_id"]["samples"] == ["hh1"]
    assert issues["DUPLICATE_AADHAAR", "aadhaar_number"]["rows"] == [11]
    assert issues["INVALID_ENUM_VALUE", "social_category"]["severity"] == "MEDIUM"


def test_evidence_is_bounded_and_ordered(spark):
    df = household(spark, *[{"household_id": f"bad{i % 40}", "social_category": f"c{i % 9}"} for i in range(60)])
    issues = found(rules.validate_table(df))
    pattern = issues["PATTERN_MISMATCH", "household_id"]
    assert pattern["n"] == 60 and pattern["rows"] == list(range(1, 21)) and pattern["samples"] == ["bad0", "bad1", "bad2"]
    assert issues["INVALID_ENUM_VALUE", "social_category"]["samples"] == ["c0", "c1", "c2", "c3", "c4"]


def test_missing_columns(spark):
    df = spark.createDataFrame([(1, "x")], "row_id long, note string")
    issues = found(profile(df))
    kinds = {t for t, _ in issues}
    assert kinds == {"INCOMPLETE_SCHEMA", "MISSING_REQUIRED_FIELD", "LGD_VALIDATION_SKIPPED"}
    assert sum(t == "MISSING_REQUIRED_FIELD" for t, _ in issues) == sum(s.required for s in rules.HOUSEHOLD_SCHEMA)


def test_code_tuple(spark):
    df = spark.createDataFrame([("27", "5"), ("0", "5"), ("x", "5"), ("27", None), (" +3 ", "5")], "state_code string, district_code string")
    out = df.select(rules.code_tuple_check(["state_code", "district_code"]).alias("c")).select("c.*").collect()
    assert [r["first_bad"] for r in out] == [None, "state_code", "state_code", "district_code", None]


def test_export_keeps_nulls(spark):
    df = spark.createDataFrame(
        [(1, "asha o'neil", None, "123456789012", "f"), (2, None, "x", "12", "zz")],
        "row_id long, farmer_name string, father_spouse_name string, aadhaar_number string, gender string",
    )
    out = export.export(df, export.BeneficiaryFormat(), keep=["row_id"])
    rows = out.data.orderBy("row_id").collect()
    assert rows[0]["beneficiary_name"] == "Asha O'Neil" and rows[1]["beneficiary_name"] is None and rows[0]["gender"] == "Female" and rows[1]["gender"] == "zz"
    issues = {(r["field"], r["issue_type"]): r["severity"] for r in out.issues.collect()}
    assert issues["uid", "invalid_format"] == "critical" and issues["gender", "invalid_format"] == "warning" and issues["state_name", "missing_values"] == "critical"
    summary = out.summary.first()
    assert (summary["records_in"], summary["fields_mapped"], summary["fields_unmapped"]) == (2, 4, 11)


def test_delimited_round_trip_and_row_ids(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i:04d}", " a,b\t\"q\" ", None) for i in range(500)], "k string, v string, w string").repartition(5)
    for fmt, read in (("csv", tables.read_csv), ("tsv", tables.read_tsv)):
        path = sinks.write_table(df, str(tmp_path / fmt), fmt)
        assert read(spark, path, ["k", "v", "w"]).exceptAll(df).count() == 0
        assert read(spark, path).columns == ["k", "v", "w"]
    numbered = tables.with_row_ids(tables.read_csv(spark, str(tmp_path / "csv"), ["k", "v", "w"]))
    ids = sorted(r["row_id"] for r in numbered.collect())
    assert ids == list(range(500))


def test_broken_lines_do_not_stop_the_batch(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y,extra\n")
    (tmp_path / "b.tsv").write_text("k\tv\n3\tz\n")
    (tmp_path / "c.docx").write_text("no")
    found_rows = tables.read_files(spark, [str(tmp_path / n) for n in ("a.csv", "b.tsv", "c.docx", "missing.csv")], ["k", "v"]).collect()
    assert sorted((r["k"], r["source_file"], r[tables.CORRUPT] is not None) for r in found_rows) == [
        ("1", "a.csv", False), ("2", "a.csv", True), ("3", "b.tsv", False),
    ]
    sums = manifest.folder_checksums(spark, str(tmp_path))
    assert sorted(r["file_name"] for r in sums.collect()) == ["a.csv", "b.tsv"]


def test_missing_library_is_empty_and_a_broken_one_an_error(spark, tmp_path):
    strict, prob = tables.load_library(spark, str(tmp_path / "none"), str(tmp_path / "none2"))
    assert strict.count() == 0 and prob.count() == 0
    (tmp_path / "broken.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        tables.load_library(spark, str(tmp_path / "none"), str(tmp_path / "broken.parquet"))


def test_columns_are_found_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n")
    (tmp_path / "b.CSV").write_text("extra,v,other,k\ne,\"y\nz\",o,2\n")
    (tmp_path / "c.Tsv").write_text("\ufeffk\tw\n3\tq\n")
    (tmp_path / "d.txt").write_text("k,v\n9,9\n")
    (tmp_path / "e.csv").write_text("")
    rows = tables.read_folder(spark, str(tmp_path), ["k", "v"], multiLine="true")
    assert sorted((r["k"], r["v"], r["source_file"]) for r in rows.collect()) == [("1", "x", "a.csv"), ("2", "y\nz", "b.CSV"), ("3", None, "c.Tsv")]
    both = tables.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.CSV")], ["v", "k"], multiLine="true")
    assert sorted((r["k"], r["v"]) for r in both.collect()) == [("1", "x"), ("2", "y\nz")]


def test_broken_files_are_reported_and_not_cut_short(spark, tmp_path):
    packed = gzip.compress(("k,v\n" + "".join(f"{i},{i * 7919 % 10007}\n" for i in range(50_000))).encode())
    (tmp_path / "cut.csv.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "whole.csv.gz").write_bytes(gzip.compress(b"k,v\n1,2\n"))
    (tmp_path / "empty.csv").write_text("")
    paths = [str(tmp_path / n) for n in ("cut.csv.gz", "whole.csv.gz", "empty.csv", "gone.csv")]
    files = tables.read_file_set(spark, paths, ["k", "v"])
    assert [(r["k"], r["source_file"]) for r in files.rows.collect()] == [("1", "whole.csv.gz")]
    states = {r["source_file"]: r for r in files.outcomes.collect()}
    assert {k: r["status"] for k, r in states.items()} == {"cut.csv.gz": "failed", "whole.csv.gz": "success", "empty.csv": "empty", "gone.csv": "missing"}
    assert states["cut.csv.gz"]["error"] and states["whole.csv.gz"]["error"] is None


def test_broken_files_take_no_namesakes_with_them(spark, tmp_path):
    packed = gzip.compress(("k,v\n" + "".join(f"{i},{i * 7919 % 10007}\n" for i in range(50_000))).encode())
    cut, whole = packed[: len(packed) // 2], gzip.compress(b"k,v\n1,2\n")
    placed = {"1.csv.gz": whole, "11.csv.gz": cut, "a/data.csv.gz": whole, "b/data.csv.gz": cut, "b/two w\u00f6rds.csv.gz": cut, "a/w\u00f6 x.csv.gz": whole}
    for name, content in placed.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    files = tables.read_file_set(spark, [str(tmp_path / n) for n in placed], ["k", "v"])
    ends = sorted(r["source_path"].rsplit(tmp_path.name + "/", 1)[1] for r in files.rows.collect())
    assert ends == ["1.csv.gz", "a/data.csv.gz", "a/w\u00f6 x.csv.gz"]
    states = sorted((r["source_file"], r["status"]) for r in files.outcomes.collect())
    assert states == sorted((n.rsplit("/", 1)[-1], "failed" if c is cut else "success") for n, c in placed.items())


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for name, text in {"a/data.csv": "k,v\n1,\"x\ny\"\n1,z\n", "b/data.csv": "v,k\nq,1\n", "c d/da+ta%20.CSV": "k,v\n2,w\n", "b/empty.csv": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "b" / "two.csv.bz2").write_bytes(bz2.compress(b"k,v\n5,a\n") + bz2.compress(b"6,b\n"))
    paths = [str(p) for p in tmp_path.rglob("*.*")] + [f"{tmp_path}/b/none.csv", f"file:{tmp_path}/a/data.csv"]
    files = tables.read_file_set(spark, paths, ["k", "v"])
    own = lambda p: p.removeprefix(f"{tmp_path}/")
    assert sorted((own(r.source_path), r.source_file, r.k, r.v) for r in files.rows.collect()) == [
        ("a/data.csv", "data.csv", "1", "x\ny"), ("a/data.csv", "data.csv", "1", "z"), ("b/data.csv", "data.csv", "1", "q"),
        ("b/two.csv.bz2", "two.csv.bz2", "5", "a"), ("b/two.csv.bz2", "two.csv.bz2", "6", "b"), ("c d/da+ta%20.CSV", "da+ta%20.CSV", "2", "w"),
    ]
    run = batch.run_batch(tables.with_row_ids(files.rows.withColumn("d", F.lit("2024-01-01"))), SurveyConfig(key="k", date="d", name="v", guardian="v", spell_enabled=False))
    summary = {own(r.source_path): (r.source_file, r.original_records, r.final_records, r.status) for r in batch.file_summary(run, outcomes=files.outcomes).collect()}
    assert summary == {
        "a/data.csv": ("data.csv", 2, 1, "success"), "b/data.csv": ("data.csv", 1, 1, "success"), "b/two.csv.bz2": ("two.csv.bz2", 2, 2, "success"),
        "c d/da+ta%20.CSV": ("da+ta%20.CSV", 1, 1, "success"), "b/empty.csv": ("empty.csv", 0, 0, "empty"), "b/none.csv": ("none.csv", 0, 0, "missing"),
    }


def test_digests_and_headers_come_from_streams():
    rng = random.Random(2)
    raw = b'"h\n1",b\n' + bytes(rng.randrange(32, 127) for _ in range(5000)).replace(b'"', b"'") + b"\n"
    for name, data in (("x.csv", raw), ("x.csv.gz", gzip.compress(raw)), ("x.csv.deflate", zlib.compress(raw)), ("x.csv.bz2", bz2.compress(raw)), ("x.csv.zst", zstandard.compress(raw))):
        for size in (1, 7, 10_000):
            pieces = (data[i : i + size] for i in range(0, len(data), size))
            path, status, error, columns, multi, checksum, length = inspect.facts(name, pieces, True)
            assert (status, error, columns, multi, length) == ("success", None, ["h\n1", "b"], True, len(data))
            assert checksum == "sha256:" + hashlib.sha256(data).hexdigest()[:16]
        if name != "x.csv":
            cut = data[:-6]
            path, status, error, *_, checksum, length = inspect.facts(name, iter([cut[:50], cut[50:]]), True)
            assert status == "failed" and error and checksum == "sha256:" + hashlib.sha256(cut).hexdigest()[:16]
    assert inspect.facts("e.tsv", iter([]), True)[1] == "empty"
    assert inspect.facts("e.tsv", iter([b"\xef\xbb\xbfa\tb\r\n1\t2"]), False)[3:6] == (["a", "b"], False, None)


def test_file_systems_without_a_client_are_read_through_spark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.csv.gz").write_bytes(b"no gzip")
    got = inspect._through_spark(spark, [f"{tmp_path}/{n}" for n in ("a.csv", "b.csv.gz", "c.csv")], True)
    assert sorted((r.path.rsplit("/")[-1], r.status, r.columns) for r in got.collect()) == [("a.csv", "success", ["k", "v"]), ("b.csv.gz", "failed", []), ("c.csv", "missing", [])]


def test_heads_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v,k\n" + "".join(f'{i},"x\ny {i}",z\n' for i in range(50_000)))
    (tmp_path / "b.tsv.gz").write_bytes(gzip.compress("\ufeffv\tk\n\né\t1\n\t2\nq".encode()))
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv.gz").write_bytes(b"no")
    got = inspect.file_heads(spark, [str(tmp_path / n) for n in ("a.csv", "b.tsv.gz", "c.csv", "d.csv.gz", "none.csv")], ["k", "v", "w"], 3)
    rows = sorted((r.source_path.rsplit("/")[-1], r.row_id, r.k, r.v, r.w) for r in got.collect())
    assert rows == [("a.csv", i, str(i), f"x\ny {i}", None) for i in range(3)] + [("b.tsv.gz", 0, "1", "é", None), ("b.tsv.gz", 1, "2", None, None), ("b.tsv.gz", 2, None, "q", None)]
    read = []
    pieces = (read.append(1) or b"k,v\n" + b"1,2\n" * 100 for _ in range(1000))
    assert len(inspect.head("x.csv", pieces, ["v"], 5)) == 5 and len(read) < 3
    assert inspect.inspect_files(spark, [str(tmp_path / "a.csv")], whole=False).first()["columns"] == ["k", "v", "k"]


def test_profile_of_a_file_is_that_of_its_first_rows(spark, tmp_path):
    rows = [dict(GOOD, social_category="zz" if i % 2 else "SC", latitude="north" if i == 700 else "20.1", aadhaar_number=str(100000000000 + i)) for i in range(900)]
    names = list(rows[0])
    (tmp_path / "h.csv").write_text(",".join(names) + "\n" + "\n".join(",".join(r[n] for n in names) for r in rows) + "\n")
    table = spark.createDataFrame([dict(r, row_id=i) for i, r in enumerate(rows)]).select("row_id", *names)
    key = lambda r: (r["type"], r["severity"], r["field"], r["n"])
    got = sorted(map(key, profile_file(spark, str(tmp_path / "h.csv")).collect()))
    assert got == sorted(map(key, profile(table).collect())) and ("INVALID_ENUM_VALUE", "MEDIUM", "social_category", 250) in got
    assert not [r for r in got if r[0] == "TYPE_MISMATCH"]


def test_issues_carry_suggestions(spark):
    rows = [dict(GOOD, row_id=i, social_category=c, irrigation_source=w, ifsc_code=b) for i, (c, w, b) in enumerate([("Genral", "qqq", "x1"), ("zzz", "WELL", None), ("SC", "WEL", "")])]
    df = spark.createDataFrame(rows)
    got = {(r.type, r.field): (r.suggestion, r.suggested_from) for r in rules.validate_table(df).collect()}
    assert got["INVALID_ENUM_VALUE", "social_category"] == ("GENERAL", "nearest")
    assert got["INVALID_ENUM_VALUE", "irrigation_source"] == ("|".join(a for s in rules.HOUSEHOLD_SCHEMA if s.name == "irrigation_source" for a in s.allowed), "list")
    assert got["PATTERN_MISMATCH", "ifsc_code"] == (next(s.pattern for s in rules.HOUSEHOLD_SCHEMA if s.name == "ifsc_code"), "pattern")
    assert all(v == (None, None) for k, v in got.items() if k[0] not in ("INVALID_ENUM_VALUE", "PATTERN_MISMATCH"))
    clean = rules.validate_table(spark.createDataFrame([dict(GOOD, row_id=1)]))
    assert clean.where("suggestion is not null").count() == 0


def test_nearest_allowed(spark):
    df = spark.createDataFrame([("Genral",), ("qqq",), ("minorty",)], "v string")
    out = {r["value"]: r["suggestion"] for r in rules.nearest_allowed(df, "v", rules.SOCIAL_CATEGORIES).collect()}
    assert out == {"Genral": "GENERAL", "qqq": None, "minorty": "MINORITY"}
    assert df.where(F.col("v") == "qqq").count() == 1


def test_many_files_stay_out_of_the_driver(spark, tmp_path, monkeypatch):
    """Texts become files by the tasks and a stored table of paths is inspected; both once passed every path through the driver."""
    texts = ["one", "", None, 'a "quoted\nline"', "é" * 5] * 500
    files = spark.createDataFrame([(f"doc_{i % 2400}.csv", t) for i, t in enumerate(texts)], "file_name string, text string").repartition(3)
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", None)
        written = sinks.write_texts(files, f"{tmp_path}/texts")
        found = inspect.inspect_files(spark, written.unionByName(written.limit(5)), checksums=True).collect()
    digest = lambda t: "sha256:" + hashlib.sha256(((t or "") + "\n").encode()).hexdigest()[:16]
    expected = sorted((f"doc_{i % 2400}.csv", digest(t), len((t or "").encode()) + 1) for i, t in enumerate(texts))
    assert sorted((r["path"].rsplit("/", 1)[1], r["checksum"], r["length"]) for r in found) == expected
    monkeypatch.setattr(sinks, "has_client", lambda path: False)
    by_spark = sinks.write_texts(files.dropDuplicates(["file_name"]).limit(20), f"{tmp_path}/by-spark")
    assert by_spark.where("path LIKE '%/file\\_name=doc\\_%.csv/%'").count() == 20


@pytest.mark.parametrize("ending", ["csv", "csv.gz"])
def test_one_file_from_many_tasks(spark, tmp_path, ending):
    """A file of any size is sorted and written by many tasks; one task once sorted it all."""
    rows = [(i, "x,\"y\"" if i % 7 == 0 else f" v{i}", None if i % 5 == 0 else "é") for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, a string, b string").repartition(5)
    path = sinks.write_file(df, f"file://{tmp_path}/in/data.{ending}", ["b", "a"], "k")
    data = (tmp_path / "in" / f"data.{ending}").read_bytes()
    lines = list(csv.reader((gzip.decompress(data) if ending.endswith("gz") else data).decode().splitlines()))
    assert lines == [["b", "a"], *([b or "", a] for _, a, b in rows)]
    sinks.write_file(df.where("k < 2"), path, ["a"], "k")
    files = tables.read_file_set(spark, [path], ["a", "b"])
    assert [r["status"] for r in files.outcomes.collect()] == ["success"]
    assert sorted((r["a"], r["b"]) for r in files.rows.collect()) == [(" v1", None), ("x,\"y\"", None)]
