"""Secret scan, mixing, quality rules and URL filter against plain Python, and their odd inputs."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from surveyloom.llm import mixing, quality_rules, queries, secret_scan, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
ODD = ["", None, " \t\n", "a", "a b", "a b c a b c", "x " * 400, "token = abc", "token=token: abcdefgh", "api_key: 'Zx9-_=.'", "AKIA" + "A" * 15, "AKIA" + "B" * 16,
       "é" * 3 + "password=hunter22 secret==abcdefg", "f" * 24 + "g" + "0" * 23, "PassWD :  \"abcdef", "\u017fecret=abcdefgh", "line\nline\nline two\n\nline\r\n", "漢字 " * 60]


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("size", "kept", "f", "row", "_row", "base", "n_words", "rate", "url")}) if extra else df


def random_texts(n=150, seed=5):
    rng = random.Random(seed)
    bits = ["token", "=", ":", "secret ", "password=", "deadbeef01", "AKIA", "Z9", " ", "\n", "'", "é", "a", "the", ".", "$", "api-key", "api_key", "0123456789abcdef" * 2, "\t", "{", "🙂"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def base_of(text):
    text = text or ""
    kinds = (("assign", r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
             ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24))
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m))


@pytest.mark.parametrize("extra", [False, True])
def test_secrets_against_regular_expressions(spark, extra):
    texts = ODD + random_texts()
    got = {r.doc_id: r for r in secret_scan.find(docs(spark, texts, extra)).collect()}
    for i, t in enumerate(texts):
        spans = base_of(t)
        joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in spans) for k in range(3)], t
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert set(joined.split(",")) <= set(got[i].spans.split(",")) or not joined


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(alphabet) for _ in range(64)) for _ in range(20)]
    syllables = ["the", "ing", "er", "tion", "on", "an", "re"]
    plain = ["".join(rng.choice(syllables) for _ in range(20)) for _ in range(200)]
    got = {r.doc_id: r.spans for r in secret_scan.find(docs(spark, [f"so {k} it" for k in keys] + [f"so {w} it" for w in plain])).collect()}
    assert sum(got[i] == "random:3:67" for i in range(20)) >= 18
    assert not any(got[i] for i in range(20, 220))


def test_redaction(spark):
    df = docs(spark, ["a password=hunter22 b", None, "", "clean"], True)
    out = secret_scan.redact_documents(df)
    assert out.columns == df.columns
    assert [(r.text, r.n_chars) for r in out.orderBy("doc_id").collect()] == [("a [SECRET] b", 12), (None, None), ("", 0), ("clean", 5)]


def rule_base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + d for v in at.values() if len(v) > 1 for i in v for d in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_rule_counts_against_python(spark):
    rng = random.Random(9)
    few, many = ["a", "b", "c"], [f"w{i}" for i in range(40)]
    texts = ODD + random_texts(60) + [" ".join(rng.choice(few) for _ in range(rng.randrange(200))) for _ in range(20)]
    texts += [" ".join(rng.choice(many) for _ in range(3000)) for _ in range(3)]  # many repeated windows: the sorted path
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, texts, True)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = rule_base(t)
        assert [got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words] == want, t
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i].base_failed and got[i].kept)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_posterior_agrees_with_labels(spark, sf):
    judged = queries.op7_quality_rules(spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = judged.select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.05 * len(bad)


def test_filtered_documents_keep_their_columns(spark):
    df = docs(spark, ODD + ["Some plain words make a sentence that ends here. " * 3 + " ".join(f"word{i}" for i in range(150)) + "."], True)
    out = quality_rules.filter_documents(df)
    assert out.columns == df.columns
    assert [r.doc_id for r in out.collect()] == [len(ODD)]


def targets_of(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {s for s in sizes if not sizes[s]}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= over


def test_mixture_against_python(spark):
    rng = random.Random(1)
    texts = ["w " * rng.randrange(0, 90) for _ in range(900)] + [None, ""]
    rows = [(i, t, "en", rng.choice(["a", "a", "a", "a", "b", "é", "Z", None, "lone"]) if i % 50 else "tiny", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_counts(df).collect()
    again = mixing.mix_counts(df.repartition(7)).collect()
    assert sorted(got) == sorted(again)
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = targets_of(sizes)
    source = {r[0]: r[3] for r in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    largest = collections.Counter()
    for r in got:
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    assert all(abs(taken[s] - want[s]) <= max(1, largest[s]) for s in taken)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    counted = {s: 0 for s in sizes}
    for r in mixed.collect():
        counted[r.source] += len(WORD.findall(r.text or ""))
    assert counted == {**counted, **taken}


def test_small_sources_of_unequal_documents_meet_their_targets(spark):
    rng = random.Random(9)
    rows, largest = [], {}
    for s in range(40):
        for _ in range(rng.randrange(3, 40)):
            n = int(rng.paretovariate(0.8) * 20) % 20_000
            largest[s] = max(largest.get(s, 0), n)
            rows.append((len(rows), "w " * n, "en", f"s{s:02d}", 0))
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("size", "rate", "target", "draw", "_h", "_row", "_key", "_copy")})
    taken, want = {}, {}
    for r in mixing.mix_counts(df).collect():
        s = int(rows[r.doc_id][3][1:])
        taken[s], want[s] = taken.get(s, 0) + r.taken, r.target
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in taken)
    assert sum(abs(taken[s] - want[s]) for s in taken) < 0.05 * sum(want.values())  # three documents can miss by a third
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.agg(F.sum(F.regexp_count("text", F.lit("w")))).first()[0] == sum(taken.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_of_the_tables_meet_their_targets(spark, sf):
    path = f"/root/testdata/{sf}"
    got = queries.op3_mix_sources(spark, path).join(queries.documents(spark, path).select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect():
        assert abs(r.taken - r.target) <= r.largest


def test_draws_have_the_probability_of_the_fraction(spark):
    ids = spark.range(20_000)
    for k in (0, 7, 31):
        got = ids.agg(F.avg(mixing.copies(F.lit(1.3), F.col("id"), F.lit(k))).alias("x")).first().x
        assert abs(got - 1.3) < 0.015


def test_mixture_of_nothing(spark):
    assert mixing.mix_counts(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [None, ""])).count() == 0
    assert [r.target for r in mixing.mix_counts(docs(spark, [None, ""])).collect()] == [0.0, 0.0]


def test_urls(spark):
    urls = ["http://Example.ORG/en/12", "http://a.example.org/es/", "http://xexample.org/es/1", "x.org/en", None, "", "://", "http://org", "ftp://com/de/?q", "http://b.com/dex", "http://m.com/fr/1#x",
            "http://example.org:80/en/1", "a://b://c/fr/"]
    want = ["example.org/en/1", "example.org/es/", "org/", None, None, None, None, None, "com/de/", None, "com/fr/", None, None]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 2)], "page_id long, url string, html string").withColumn("host", F.lit(1))
    rules = spark.createDataFrame(queries.URL_RULES, "action string, host string, path string")
    got = {r.page_id: r for r in url_filter.judge(df, rules).collect()}
    assert len(got) == 2 * len(urls)
    assert [got[i].rule for i in range(len(urls))] == want
    assert got[0].verdict == "block" and got[1].verdict == "block" and got[2].verdict == "allow" and got[4].host == "" and got[9].verdict == "allow"
    assert {r.verdict for r in url_filter.judge(df, rules.limit(0), "block").collect()} == {"block"}
    assert url_filter.judge(df.limit(0), rules).count() == 0


@pytest.mark.parametrize("name", ["op1_secret_scan", "op3_mix_sources", "op7_quality_rules", "op9_url_filter"])
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
