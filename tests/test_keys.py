"""Deduplication, votes, hot keys, edits, lifecycle."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from surveyloom import session
from surveyloom.operators import dedup, edits, keyed, lifecycle, vote
from surveyloom.operators.keyed import attach_per_key, lookup


def test_dedup_unit_table(spark):
    rows = [
        (0, "UK001", "a", "2024-01-10"), (1, "UK001", "b", "2024-01-15"), (2, "UK002", "c", "2024-02-01"), (3, "UK002", "d", "2024-02-20"),
        (4, "UK002", "e", "bad"), (5, "V1", "f", "2024-01-01"), (6, "UK003", "g", None), (7, None, "h", "2024-01-01"), (8, "V1", "i", None),
    ]
    df = spark.createDataFrame(rows, "row_id long, k string, n string, d string")
    kept = sorted(r["row_id"] for r in dedup.deduplicate(df, "k", "d").collect())
    assert kept == [1, 3, 5, 6, 7, 8]
    assert sorted(r["row_id"] for r in dedup.merged(df, "k", "d").collect()) == [1, 3, 5, 6, 7]
    stats = dedup.dedup_summary(df, "k").first()
    assert (stats["original_records"], stats["placeholder_records"], stats["duplicates_removed"], stats["final_records"]) == (9, 3, 3, 6)
    assert stats["duplicates_removed"] + len(kept) == len(rows)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows, the null key another part."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        k = "hot" if i % 3 == 0 else (None if i % 10 == 1 else f"k{rng.randrange(300)}")
        rows.append((i, k, rng.choice(["x", "x", "x", "y", None, ""])))
    return spark.createDataFrame(rows, "row_id long, k string, v string")


def test_hot_keys_are_split_and_complete(spark, skewed):
    facts = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    joined = attach_per_key(skewed, facts, ["k"], "n", "row_id", rows_per_split=50)
    plain = skewed.join(facts, "k", "left")
    assert joined.select(plain.columns).exceptAll(plain).count() == 0
    assert joined.count() == skewed.count()


def test_members_and_later_occurrences_with_hot_key(skewed):
    rows = [(r["row_id"], r["k"]) for r in skewed.collect()]
    real = [(i, k) for i, k in rows if k is not None]
    counts, first = {}, {}
    for i, k in real:
        counts[k] = counts.get(k, 0) + 1
        first.setdefault(k, i)
    members = {r["row_id"] for r in dedup.duplicate_members(skewed, "k", rows_per_split=40).collect()}
    assert members == {i for i, k in real if counts[k] > 1}
    later = {r["row_id"] for r in dedup.later_occurrences(skewed, "k", rows_per_split=40).collect()}
    assert later == {i for i, k in real if i > first[k]}


def test_majority_vote_with_hot_key(skewed):
    result = vote.majority_vote(skewed.withColumn("n", F.lit("name")), "k", "v", "n", rows_per_split=40)
    groups = {}
    for r in skewed.collect():
        if r["k"] is not None:
            groups.setdefault(r["k"], []).append((r["row_id"], r["v"]))
    expected = {}
    for cells in groups.values():
        values = [v.strip().lower() for _, v in cells if v is not None]
        if len(set(values)) <= 1:
            continue
        top = max(set(values), key=values.count)
        if values.count(top) / len(values) < 0.6:
            continue
        expected.update({i: top for i, v in cells if (v or "").strip().lower() != top})
    changes = {r["row_id"]: r["new_value"] for r in result.changes.collect()}
    assert changes == expected and expected
    before = {r["row_id"]: r["v"] for r in skewed.collect()}
    after = {r["row_id"]: r["v"] for r in result.data.collect()}
    assert after == {i: expected.get(i, v) for i, v in before.items()}


def test_lookup_without_broadcast_gives_the_same(spark, skewed):
    table = skewed.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    big = lookup(skewed, table, ["k"], max_rows=3)
    assert big.exceptAll(lookup(skewed, table, ["k"])).count() == 0


def test_apply_edits(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "row_id long, v string, n int")
    changes = spark.createDataFrame(
        [(1, "v", "x", 1), (1, "v", "y", 2), (2, "n", "7", 1), (9, "v", "z", 1), (1, "nope", "q", 1)], "row_id long, field string, value string, seq long"
    )
    result = edits.apply_edits(df, changes)
    assert sorted(map(tuple, result.data.collect())) == [(1, "y", 5), (2, "b", 7)]
    assert result.applied.first()["applied"] == 3


def test_frozen_guard(spark):
    a = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "row_id long, v string, w string")
    edits.assert_frozen(a, a, ["v", "w"])
    with pytest.raises(RuntimeError):
        edits.assert_frozen(a, a.withColumn("w", F.coalesce("w", F.lit(""))), ["v", "w"])


@pytest.mark.parametrize("chunk", [2, 7, 512])
def test_lifecycle_equals_a_fold(spark, chunk):
    rng = random.Random(3)
    actions = ["upload", "approve", "reject", "hold", "promote", "revoke", "other"]
    files = ["hot.csv"] * 200 + [None] * 40 + [f"f{rng.randrange(30)}.csv" for _ in range(160)]
    rng.shuffle(files)
    events = [(f, 40 * i**4 + i, rng.choice(actions)) for i, f in enumerate(files)]  # sparse, up to 10^12
    df = spark.createDataFrame(events, "file_name string, seq long, action string")
    table = {(a, s): t for a, s, t in lifecycle.TRANSITIONS}
    state, expected = {}, {}
    for f, seq, action in events:
        at = state.get(f, "none")
        to = table.get((action, at), at)
        expected[f, seq] = (at, to, to != at)
        state[f] = to
    out = lifecycle.apply_events(df, chunk=chunk).collect()
    assert {(r["file_name"], r["seq"]): (r["from_status"], r["to_status"], r["is_legal"]) for r in out} == expected


def test_new_uploads(spark):
    registered = spark.createDataFrame([("a.csv", "1"), ("b.csv", "2")], "file_name string, checksum string")
    uploads = spark.createDataFrame(
        [("a.csv", "1", 10), ("a.csv", "9", 20), ("c.csv", "3", 30), ("c.csv", "3", 31), ("c.csv", "4", 40), ("d", "5", 50)],
        "file_name string, checksum string, s long",
    ).withColumn("uploaded_at", F.timestamp_seconds("s"))
    out = sorted((r["file_name"], r["checksum"], r["stored_name"]) for r in lifecycle.new_uploads(uploads, registered).collect())
    assert out == [
        ("a.csv", "9", "a_19700101_000020.csv"), ("c.csv", "3", "c.csv"), ("c.csv", "4", "c_19700101_000040.csv"), ("d", "5", "d"),
    ]


@pytest.mark.parametrize("n", [0, 1, 400, 30_000])
def test_split_by_keys_loses_no_row(spark, n):
    rows = spark.range(40_000).select(F.when(F.col("id") % 100 > 0, F.col("id")).alias("k"), (F.col("id") % 7).cast("string").alias("s"))
    keys = spark.range(n).select((F.col("id") * 5).alias("k"), (F.col("id") * 5 % 7).cast("string").alias("s"))
    maybe, never = keyed.split_by_keys(rows, keys, ["k", "s"])
    assert maybe.columns == never.columns == rows.columns
    assert maybe.unionByName(never).exceptAll(rows).isEmpty() and maybe.count() + never.count() == 40_000
    assert never.join(keys, ["k", "s"], "left_semi").isEmpty()
    assert maybe.count() < min(n, 8000) + 4000


def test_staged_tables_are_dropped(spark):
    with session.staged_paths() as outer:
        with session.staged_paths() as made:
            table = session.stage(spark.range(5), "numbers")
        assert table.count() == 5 and len(made) == 1 and outer == made
    session.drop_staged(spark, made)
    session.drop_staged(spark, made)
    assert not os.path.exists(made[0].removeprefix("file:"))


def test_edits_of_many_rows_bypass_the_shuffle(spark, monkeypatch):
    rows = [(i, f"a{i}", i % 5 or None) for i in range(3000)]
    changes = [(i * 7, f, f"new{i}", s) for i in range(400) for f, s in (("name", 1), ("name", 0), ("n", 3), ("unknown", 1))] + [(99_999, "name", "x", 1)]
    changes = [(r, f, "8" if f == "n" else v, s) for r, f, v, s in changes]
    df = spark.createDataFrame(rows, "row_id long, name string, n int")
    log = spark.createDataFrame(changes, "row_id long, field string, value string, seq long")
    near = edits.apply_edits(df, log)
    want = sorted(near.data.collect())
    monkeypatch.setattr(edits, "fits_broadcast", lambda table: False)
    far = edits.apply_edits(df, log)
    assert sorted(far.data.collect()) == want and want[7] == (7, "new1", 8) and want[8] == rows[8]
    assert near.applied.first()[0] == far.applied.first()[0] == 1200


def test_compare_tables_counts_repeated_rows(spark):
    rng = random.Random(8)
    make = lambda n: [(rng.choice([None, "", "a", "b"]), rng.choice([None, 1, 2])) for _ in range(n)]
    left, right = make(300), make(260)
    got = edits.compare_tables(spark.createDataFrame(left, "a string, b int").withColumn("l", F.lit(1)), spark.createDataFrame(right, "a string, b int")).first()
    one, two = Counter(left), Counter(right)
    assert (got.left_rows, got.right_rows, got.left_only_rows, got.right_only_rows) == (300, 260, sum((one - two).values()), sum((two - one).values()))
    assert (got.columns_left_only, got.columns_right_only, got.row_difference) == ("l", "", 40)
    empty = edits.compare_tables(spark.createDataFrame([], "a string"), spark.createDataFrame([], "b string")).first()
    assert (empty.left_rows, empty.left_only_rows) == (0, 0)
