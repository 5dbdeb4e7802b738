"""Toxicity: decoder against exhaustive search, counts against Python, held-out accuracy, odd inputs."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.01"
INSULTS = ["idiot", "moron", "stupid", "loser"]
HIDDEN = ["1d10t", "i.d.i.o.t", "i d i o t", "idiiiot", "m0r0n", "m o r o n", "$tupid", "stuuupid", "l0s3r", "l-o-s-e-r"]


def prose(rng, n):
    return [rng.choice(["the", "river", "stone", "market", "lamp", "window", "garden", "of", "and", "paper", "candle", "train"]) for _ in range(n)]


def corpus(n=700):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(rng, rng.randrange(10, 60)), rng.random() < 0.25
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS if i % 5 < 3 else HIDDEN))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def cost():
    return toxicity.costs(toxicity.letter_counts(r[1] for r in corpus()[0]).astype(float))


def test_letter_counts(cost):
    counts = toxicity.letter_counts(iter(["Ab a", None, "", "ß!", "日b"])).reshape((toxicity.SIZE,) * 3)
    code = toxicity._CODE | {"_": 0, "日": toxicity.OTHER}
    want = ["__a", "_ab", "ab_", "__a", "_a_", "__ß", "_ß_", "__日", "_日b", "日b_"]
    assert counts.sum() == len(want)
    for w in set(want):
        assert counts[tuple(code[c] for c in w)] == want.count(w)
    assert np.allclose(np.exp(-cost.astype(float)).sum(axis=-1)[0, 0], 1)


def price(cost, token, readings):
    total, a, b = 0.0, 0, 0
    for x, channel in readings:
        total += channel
        if x == "":
            continue
        code = toxicity._CODE.get(x, toxicity.OTHER) if x != " " else 0
        if code or b:
            total += float(cost[a, b, code])
        a, b = (b, code) if code else (0, 0)
    return total + (float(cost[a, b, 0]) if b else 0.0)


def test_viterbi_finds_the_cheapest_reading(cost):
    restorer = toxicity.Restorer(cost)
    for token in ["1d10t", "m00n", "a.b1", "$s$", "t@*p", "i d i", "aaab", "x-1"]:
        options = [restorer._options(token, i) for i in range(len(token))]
        paths = list(itertools.product(*options))
        best = min(price(cost, token, p) for p in paths)
        got = restorer.decode(token).split()
        cheapest = {tuple("".join(x for x, _ in p).split()) for p in paths if price(cost, token, p) < best + 1e-3}
        assert tuple(got) in cheapest


def test_disguises_are_undone(cost):
    restorer = toxicity.Restorer(cost)
    for hidden in HIDDEN:
        first = {"1": "i", "$": "s"}.get(hidden[0], hidden[0])
        assert sorted(restorer.words(f"the {hidden} lamp")) == sorted(["the", "lamp", next(w for w in INSULTS if w[0] == first)])
    assert restorer.words("The river, (of) 2019!!! Paper") == ["the", "river", "of", "paper"]
    assert restorer.words(None) == restorer.words("") == restorer.words(" \n") == restorer.words("12 345 $$") == []
    long = restorer.words("1d10t " * 20_000 + "a1" * 20_000)
    assert long.count("idiot") == 20_000


def test_held_out_documents(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("toxic", "draw", "score", "f", "held_out", "_at", "_bucket")}).repartition(4)
    got = toxicity.judge(docs, spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("x"))).collect()
    toxic = dict((i, t) for i, _, t in labels)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [(toxic[r.doc_id], r.predicted) for r in got if r.held_out]
    assert sum(a == b for a, b in out) / len(out) > 0.97


def test_labels_of_held_out_documents_are_not_read(spark):
    rows, labels = corpus(300)
    flipped = [(i, q, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, q, t in labels]
    one = {r.doc_id: r.score for r in toxicity.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    two = {r.doc_id: r.score for r in toxicity.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame(flipped, LABELS)).collect()}
    assert one == two


def test_odd_inputs(spark):
    rows, labels = corpus(200)
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "...", "en", "s", 0), (None, "the idiot moron", "en", "s", 0), (3, rows[3][1], "en", "s", 0)]
    labels += [(1000, None, 1), (1001, 0, None), (None, 0, 1), (3, 0, labels[3][2]), (99_999, 1, 1)]
    got = toxicity.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {True}
    assert len({r.score for r in got if r.doc_id in (1000, 1001, 1002)}) == 1 and len({r.score for r in got if r.doc_id == 3}) == 1
    empty_docs, empty_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert toxicity.judge(empty_docs, empty_labels).collect() == []
    assert {r.predicted for r in toxicity.judge(spark.createDataFrame(rows, DOCS), empty_labels).collect()} == {0}


def test_registered_query(spark):
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    toxic = [got[r.doc_id].score for r in labels if r.toxic]
    clean = [got[r.doc_id].score for r in labels if not r.toxic]
    above = np.mean([a > b for a in toxic for b in clean])
    assert above > 0.85 and np.mean([s >= 0.5 for s in clean]) < 0.05
