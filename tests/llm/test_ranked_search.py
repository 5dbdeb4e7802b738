"""Ranked search against the plain formula, its bounds, and its odd inputs."""

import collections
import math
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from surveyloom.llm import queries, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(i, collections.Counter(split(t))) for i, t in docs if split(t)]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, ts in asked.items():
        scores = []
        for i, c in counted:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def prose(rng, n, vocabulary):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), vocabulary)}" for _ in range(n))


def corpus(seed, n=600):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randrange(3, 40), 5000)) for i in range(30)]
    docs = [(i, prose(rng, rng.randrange(1, 120), 5000) + (" " + rng.choice(items)[1] if rng.random() < 0.2 else "")) for i in range(n)]
    return docs, items


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "ids", "item", "score", "rank")}).repartition(3)
    b = spark.createDataFrame(items, "item_id int, text string").withColumns({c: F.lit("x") for c in ("n", "doc_id", "score")})
    got = ranked_search.rank(d, b, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def test_against_the_formula(spark, monkeypatch):
    docs, items = corpus(1)
    docs += [(7000, docs[3][1]), (6000, docs[3][1]), (8000, None), (8001, ""), (8002, "... --"), (8003, "W1 w1\x00Été ÉTÉ été_ 日本"), (None, items[0][1])]
    items += [(100, None), (101, ""), (102, "?!"), (103, "unknown"), (104, "ÉTÉ W1"), (104, "日本 w1")]
    assert run(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 7)  # several blocks
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a b")], []) == [] and run(spark, [(1, None)], [(1, None)]) == []
    assert run(spark, [(1, "a b")], [(1, "a")]) == brute([(1, "a b")], [(1, "a")])


def test_repeated_rows_and_one_long_text(spark):
    rng = random.Random(4)
    docs = [(1, "w1 w2"), (1, "w1 w2"), (2, prose(rng, 200_000, 30_000)), (3, "w2 " * 50_000)]
    items = [(1, "w1 w2"), (2, prose(rng, 3000, 30_000))]
    assert run(spark, docs, items) == brute(docs, items)


def tree_of(rng, clusters, each, width):
    start, ids, values = [0], [], []
    for c in range(clusters):
        shared = rng.choice(width, 20, replace=False)
        for _ in range(each):
            mine = np.unique(np.concatenate([shared[: rng.integers(15, 21)], rng.choice(width, 2)]))
            ids.append(mine.astype(np.int32))
            values.append(rng.integers(5 * 10**8, 10**9, len(mine)))
            start.append(start[-1] + len(mine))
    return ranked_search.Tree(np.array(start), np.concatenate(ids), np.concatenate(values), width)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    tree = tree_of(rng, 20, 120, 600)
    held = np.zeros((600, 8), np.uint8)
    for item in range(8):
        row = rng.integers(0, 2400)
        held[tree.ids[tree.start[row] : tree.start[row + 1]], item] = 1
    dense = np.zeros((2400, 600), np.int64)
    for r in range(2400):
        dense[r, tree.ids[tree.start[r] : tree.start[r + 1]]] = tree.values[tree.start[r] : tree.start[r + 1]]
    exact = dense @ held.astype(np.int64)
    for node, (_, _, _, rows, _) in enumerate(tree.nodes):
        assert (tree.bounds(node, held, np.arange(8)) >= exact[rows].max(axis=0)).all()
    docs = np.arange(2400)
    best = ranked_search.Best(np.zeros(8, np.int64), 10)
    assert ranked_search.search(tree, docs, held, best) < exact.size / 4
    for item in range(8):
        order = np.lexsort((docs, -exact[:, item]))[:10]
        assert list(best.docs[item]) == list(order) and list(best.scores[item]) == list(exact[order, item])


def test_sums_beyond_doubles_are_exact():
    start, ids = np.array([0, 2, 4]), np.array([0, 1, 0, 1], np.int32)
    tree = ranked_search.Tree(start, ids, np.array([2**53, 1, 2**53, 2]), 2)
    _, scores = tree.scores(tree.root, np.ones((2, 1), np.uint8), np.array([0]))
    assert scores.ravel().tolist() == [2**53 + 1, 2**53 + 2]


def test_registered_query_and_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got = sorted(map(tuple, queries.op11_ranked_search(spark, SF).collect()))
    assert got == sorted(con.sql(queries.ORACLES["op11_ranked_search"]).fetchall()) and got
