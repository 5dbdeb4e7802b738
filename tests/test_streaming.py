"""Streams against batch results."""

import gzip
import shutil
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from surveyloom.operators.dedup import newest_per_key
from surveyloom.plans.context import Context
from surveyloom.plans.survey import SurveyConfig
from surveyloom.streaming import folder

COLUMNS = ["k", "d", "farmer_name", "gender"]


def put(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join([",".join(COLUMNS), *[",".join(r) for r in rows]]) + "\n")


def test_newest_per_key_over_batches(spark, tmp_path):
    source, point = tmp_path / "in", str(tmp_path / "point")
    put(source, "a.csv", [("1", "2024-01-01", "old", "m"), ("2", "2024-05-01", "keep", "m"), ("", "2024-01-01", "nokey", "m")])

    def run():
        stream = folder.folder_stream(spark, str(source), COLUMNS, files_per_batch=1)
        folder.newest_per_key_stream(stream, "k", "d", point, row_id="farmer_name").awaitTermination()

    run()
    put(source, "b.csv", [("1", "2024-03-01", "new", "m"), ("2", "bad", "late", "m"), ("3", "2024-01-01", "other", "f"), ("", "2024-02-01", "none", "")])
    run()
    run()
    state = folder.current_state(spark, point)
    assert sorted((r["k"] or "", r["farmer_name"]) for r in state.collect()) == [("", "none"), ("1", "new"), ("2", "keep"), ("3", "other")]
    whole = spark.read.option("header", True).csv(str(source))
    assert sorted(r["farmer_name"] for r in newest_per_key(whole, "k", "d", "farmer_name").collect()) == ["keep", "new", "none", "other"]


def test_each_content_once(spark, tmp_path):
    source, out, point = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "point")
    config = SurveyConfig(key="k", date="d", spell_enabled=False, correct_fields=("gender",))
    context = Context.selective(["gender"], ["auto_correct", "auto_correct_gender"])

    def run():
        stream = folder.folder_stream(spark, str(source), COLUMNS)
        folder.process_folder(stream, config, out, point, context=context).awaitTermination()

    put(source, "a file.csv", [("1", "2024-01-01", "Ramesh x", ""), ("2", "2024-01-01", "Asha", "f")])
    put(source, "copy.csv", [("1", "2024-01-01", "Ramesh x", ""), ("2", "2024-01-01", "Asha", "f")])
    run()
    run()
    assert spark.read.parquet(f"{out}/cleaned").count() == 2
    put(source, "again.csv", [("1", "2024-01-01", "Ramesh x", ""), ("2", "2024-01-01", "Asha", "f")])
    put(source, "b.csv", [("3", "2024-01-01", "Sunita", "male")])
    run()
    rows = spark.read.parquet(f"{out}/cleaned").collect()
    assert sorted((r["k"], r["gender"]) for r in rows) == [("1", "male"), ("2", "female"), ("3", "female")]


def test_files_are_processed_alone_whatever_the_batch(spark, tmp_path):
    source = tmp_path / "in"
    put(source, "a.csv", [("1", "2024-01-01", "Asha", "f"), ("1", "2024-02-01", "Asha", "f")])
    (source / "b.CSV").write_text("gender,extra,farmer_name,d,k\nfemale,x,Sunita,2024-03-01,1\n")
    (source / "c.tsv").write_text("k\td\tfarmer_name\tgender\n1\t2024-01-05\tRekha\tf\n")
    (source / "broken.csv.gz").write_bytes(b"\x1f\x8b\x08\x00no gzip at all")
    (source / "notes.txt").write_text("k,d\n9,9\n")
    config = SurveyConfig(key="k", date="d", correct_fields=("gender",))
    found = {}
    for n in (1, 1000):
        out = str(tmp_path / f"out{n}")
        stream = folder.arrivals(spark, str(source), files_per_batch=n)
        folder.process_folder(stream, config, out, str(tmp_path / f"point{n}"), columns=COLUMNS).awaitTermination()
        rows = spark.read.parquet(f"{out}/cleaned").collect()
        assert len({r["row_id"] for r in rows}) == len(rows)
        found[n] = sorted((r["source_file"], r["k"], r["farmer_name"], r["gender"]) for r in rows)
        assert spark.read.parquet(f"{out}/review").where("flag = 'duplicate'").count() == 0
        states = {r["source_file"]: r["status"] for r in spark.read.parquet(f"{out}/outcomes").collect()}
        assert states == {"a.csv": "success", "b.CSV": "success", "c.tsv": "success", "broken.csv.gz": "failed"}
        assert spark.read.parquet(f"{out}/manifest").count() == 3
    assert found[1] == found[1000] == [("a.csv", "1", "Asha", "female"), ("b.CSV", "1", "Sunita", "female"), ("c.tsv", "1", "Rekha", "female")]


def test_unreadable_files_are_tried_again_without_arriving_anew(spark, tmp_path):
    source, out, point = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "point")
    config = SurveyConfig(key="k", date="d", correct_fields=("gender",))
    put(source, "a.csv", [("1", "2024-01-01", "Asha", "f")])
    (source / "late.csv.gz").write_bytes(b"\x1f\x8b\x08\x00no gzip")

    def poll(**more):
        folder.process_folder(folder.arrivals(spark, str(source)), config, out, point, columns=COLUMNS, **more).awaitTermination()
        return sorted((r["source_file"], r["k"]) for r in spark.read.parquet(f"{out}/cleaned").collect()), [(r.status, r.attempts) for r in folder.ledger(spark, out).collect()]

    assert poll() == ([("a.csv", "1")], [("failed", 1)])
    assert poll(retry_seconds=3600) == ([("a.csv", "1")], [("failed", 2)])
    (source / "late.csv.gz").write_bytes(gzip.compress(b"k,d,farmer_name,gender\n7,2024-01-01,Ravi,m\n"))
    assert poll() == ([("a.csv", "1")], [("failed", 2)])  # not due for an hour
    ledger = spark.read.parquet(f"{out}/ledger").withColumn("next_try", F.col("next_try") - F.expr("interval 2 hours"))
    rows = ledger.collect()
    shutil.rmtree(f"{out}/ledger")
    spark.createDataFrame(rows, ledger.schema).write.partitionBy("batch_id").parquet(f"{out}/ledger")
    assert poll() == ([("a.csv", "1"), ("late.csv.gz", "7")], [("success", 3)])
    assert poll() == ([("a.csv", "1"), ("late.csv.gz", "7")], [("success", 3)])


def test_a_polling_query_reads_repaired_files(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    config = SurveyConfig(key="k", date="d", spell_enabled=False, correct_fields=("gender",))
    context = Context.selective(["gender"], ["auto_correct", "auto_correct_gender"])
    put(source, "a.csv", [("1", "2024-01-01", "Asha", "f")])
    (source / "late.csv.gz").write_bytes(b"no gzip")
    query = folder.process_folder(folder.arrivals(spark, str(source)), config, out, str(tmp_path / "point"), every="1 second", context=context, columns=COLUMNS)

    def within(seconds, done):
        end = time.time() + seconds
        while time.time() < end and query.isActive and not done():
            time.sleep(0.5)
        assert done(), query.exception()

    states = lambda: [r.status for r in folder.ledger(spark, out).collect()]
    try:
        within(120, lambda: states() == ["failed"])
        (source / "late.csv.gz").write_bytes(gzip.compress(b"k,d,farmer_name,gender\n7,2024-01-01,Ravi,m\n"))
        within(120, lambda: states() == ["success"])
    finally:
        query.stop()
    assert sorted(r["k"] for r in spark.read.parquet(f"{out}/cleaned").collect()) == ["1", "7"]


def test_a_lost_batch_is_replayed_whole(spark, tmp_path, monkeypatch):
    source, out, point = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "point")
    config = SurveyConfig(key="k", date="d", spell_enabled=False, correct_fields=("gender",))
    put(source, "a.csv", [("1", "2024-01-01", "Asha", "f")])
    (source / "late.csv.gz").write_bytes(b"no gzip")
    poll = lambda: folder.process_folder(folder.arrivals(spark, str(source)), config, out, point, columns=COLUMNS).awaitTermination()
    real, left = folder.write_table, [4]

    def lose(*args, **kw):
        left[0] -= 1
        if left[0] < 0:
            raise RuntimeError("lost")
        return real(*args, **kw)

    with monkeypatch.context() as m:
        m.setattr(folder, "write_table", lose)
        with pytest.raises(StreamingQueryException):
            poll()
    poll()
    assert spark.read.parquet(f"{out}/cleaned").count() == 1 and spark.read.parquet(f"{out}/manifest").count() == 1
    assert [(r.status, r.attempts) for r in folder.ledger(spark, out).collect()] == [("failed", 1)]
