"""The pipeline: its contract, and its result against the stages in plain Python."""

import collections
import hashlib
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from surveyloom import session
from surveyloom.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_stages_keep_the_columns_and_their_decisions(spark, tmp_path):
    docs = queries.documents(spark, SF).cache()
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    tables = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        tables[name] = docs.collect()
    good, single, masked, mixed = (tables[n] for n, _ in corpus_pipeline.STAGES[:-1])
    judged = {r.doc_id: r.kept for r in queries.op7_quality_rules(spark, SF).collect()}
    assert {r.doc_id for r in good} == {i for i, k in judged.items() if k}
    # near-duplicates by all pairs
    sets = {}
    for r in good:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in single) == sorted(i for i in sets if find(i) == i)
    # secrets
    assert sorted(r.doc_id for r in masked) == sorted(r.doc_id for r in single)
    for r in masked:
        assert not re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r.text)
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id].text or "[SECRET]" in r.text)
    # mixture
    size = {r.doc_id: len(WORD.findall(r.text)) for r in masked}
    copies = collections.Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 3
    total = sum(copies[i] * size[i] for i in copies)
    assert 0.5 * sum(size.values()) < total < 1.5 * sum(size.values())
    # tokens
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    text = {r.doc_id: r.text for r in masked}
    assert collections.Counter(r.doc_id for r in final) == copies
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and r.n_tokens * 4 == len(r.ids) for r in final)


def test_staged_tables_of_earlier_stages_are_dropped(spark, tmp_path):
    docs, made = queries.documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES:
        with session.staged_paths() as paths:
            out = stage(spark, docs, SF)
        assert not any(os.path.exists(p.removeprefix("file:")) for p in made)
        out.write.parquet(f"{tmp_path}/{name}")
        docs, made = spark.read.parquet(f"{tmp_path}/{name}"), paths


def test_pipeline_of_odd_rows(spark, tmp_path):
    rng = random.Random(12)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(90)) + "."
    texts = [prose() for _ in range(6)]
    rows = [(i, t, "en", s, 1) for i, (t, s) in enumerate(zip(texts, ["a", "a", "b", None, "b", "c"]))]
    rows += [(0, texts[0], "en", "a", 1), (0, prose(), "en", "a", 1), (None, prose(), None, None, None), (None, texts[1], "en", "a", 1), (9, None, "en", "a", 0), (10, "", None, "c", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit("x") for c in ("row", "_row", "f", "kept", "ids", "rate", "_id", "base", "tokens", "size", "_at")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    digests = {hashlib.sha256(t.encode()).hexdigest() for t in (r[1] for r in rows) if t}
    assert got and all(r.decoded_sha256 in digests for r in got)
    copies = collections.Counter((r.doc_id, r.decoded_sha256) for r in got)
    assert max(copies.values()) <= 3 and not any(i in (9, 10) for i, _ in copies)
    assert len([k for k in copies if k[1] == hashlib.sha256(texts[1].encode()).hexdigest()]) <= 1  # of two copies the one with an id
    again = collections.Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert again == copies


def test_pipeline_of_nothing(spark, tmp_path):
    queries.documents(spark, SF).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = driver.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert sorted(([r[c] for c in columns] for r in df.collect()), key=repr) == sorted(([r[names.index(c)] for c in columns] for r in result.fetchall()), key=repr)


def test_registered_names():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
    assert "pipeline" in driver.queries() and [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
