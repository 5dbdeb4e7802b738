"""Whitening against exact fractions and numpy, and its odd inputs."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.001"


def to_x(vector):
    return [int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in vector]


def brute(vectors):
    x = [to_x(v) for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    v = [[sum((Fraction(r[i]) - Fraction(s[i], n)) * (Fraction(r[j]) - Fraction(s[j], n)) for r in x) / n for j in range(d)] for i in range(d)]
    return x, n, s, np.array([[float(c) for c in row] for row in v])


def test_cross_products_are_exact():
    rng = np.random.default_rng(5)
    for top in (1, 2, 1000, 2**30, 2**62):
        x = rng.integers(-top, top, (131, 5))
        x[:, 2] = 7
        sums, cross = whitening.block_sums(x)
        z = x.astype(object) - whitening.ORIGIN
        assert list(sums) == list(z.sum(axis=0))
        for i in range(5):
            for j in range(i, 5):
                assert cross[i, j] == (z[:, i] * z[:, j]).sum()
        assert all(sum(limb << (whitening.LIMB * place) for place, limb in whitening._limbs(int(v))) == v for v in cross.ravel())


def test_whitening_against_fractions(spark):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 0.2) * (k + 1) + rng.random() for k in range(11)] for _ in range(400)]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(5, vectors[5], 0), (None, vectors[7], 0)]
    odd = [(900, None, 0), (901, [], 0), (902, [float("nan")] * 11, 0), (903, [1.0] * 10 + [None], 0), (904, [float("inf")] + [0.0] * 10, 0), (905, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5).withColumns({c: F.lit("x") for c in ("whitened", "n", "i", "place", "deviation")})
    got = whitening.whiten(df).collect()
    x, n, s, v = brute([r[1] for r in rows])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u.T[::-1][:8]
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    assert len(got) == 8 * len(rows) and len(by_id[5]) == 16 and len(by_id[None]) == 8
    sign = None
    for i in range(400):
        if i == 5:
            continue
        mine = sorted(by_id[i], key=lambda r: r.component)
        want = (np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(x[i], s)]) @ u.T) / np.sqrt(e)
        white = np.array([r.whitened for r in mine])
        sign = np.sign(white * want) if sign is None else sign
        assert np.allclose(white, want * sign, rtol=1e-9, atol=1e-9)
        assert {r.n for r in mine} == {n} and {int(r.deviation) for r in mine} == {sum((n * a - b) ** 2 for a, b in zip(x[i], s))}
        assert np.allclose([r.explained for r in mine], e / np.trace(v), rtol=1e-9)
        assert mine[0].identity_error < 1e-9


def test_odd_vectors(spark):
    one = lambda vs: whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vs)], SCHEMA)).collect()
    assert one([]) == [] and one([None, []]) == []
    assert one([[1.0, 2.0]]) == [] and one([[1.0, 2.0]] * 5) == []
    two = one([[1.0, 2.0], [3.0, 2.0]])
    assert [(r.component, abs(round(r.whitened, 9)), r.explained) for r in two] == [(1, 1.0, 1.0)] * 2
    ties = one([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]])
    assert len(ties) == 8 and all(abs(r.explained - 0.5) < 1e-12 for r in ties)
    far = one([[1e30, 0.0], [-1e30, 1.0], [5.0, -300.0]])
    assert far and all(np.isfinite(r.whitened) for r in far)


def test_long_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(a) for a in rng.normal(size=300)], 0) for i in range(320)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).where("vec_id = 3").collect()
    assert len(got) == 8 and got[0].identity_error < 1e-9


def test_registered_query(spark):
    got = queries.op13_embedding_whitening(spark, SF)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([to_x(r.embedding) for r in rows])
    e = np.linalg.eigvalsh(np.cov(x.T.astype(float), bias=True))[::-1]
    out = got.collect()
    assert len(out) == 8 * len(rows) and max(r.identity_error for r in out) < 1e-9
    share = {r.component: r.explained for r in out}
    assert [share[k + 1] for k in range(8)] == pytest.approx(list(e[:8] / e.sum()))
