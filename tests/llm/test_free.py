"""Near-dedup, substring dedup, tokens, license scan, page extraction and vector search against brute force, and their odd inputs."""

import base64
import collections
import hashlib
import html
import os
import random
import re
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from surveyloom.llm import components, html_extract, licenses, near_dedup, queries, recompress, substring_dedup, tokens, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in ("digest", "n", "keys", "class", "row", "kept", "_id", "_row", "ids", "start", "host", "names")}) if extra else df


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_rows(seed=2):
    """Groups of copies at several distances, chains, short texts and odd ones."""
    rng = random.Random(seed)
    texts = [None, "", " \t", "a", "A", "a b", "A  B", "a b c", "b a c"]
    for _ in range(25):
        base = prose(rng, rng.randrange(20, 160))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(1, 9)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(30)}"
            texts.append("\n".join(copy) if rng.random() < 0.5 else " ".join(copy).upper())
            base = copy if rng.random() < 0.3 else base
    rng.shuffle(texts)
    return list(enumerate(texts))


def near_brute(rows, size, percent):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("size, percent, extra", [(3, 85, True), (5, 80, False)])
def test_near_duplicates_against_all_pairs(spark, size, percent, extra):
    rows = near_rows()
    got = {r[0]: tuple(r[1:]) for r in near_dedup.near_duplicates(frame(spark, rows, extra), size, percent).collect()}
    assert got == near_brute(rows, size, percent)


def test_copies_that_are_close_to_a_hub_or_to_each_other_only(spark):
    rng = random.Random(8)
    hub = prose(rng, 120, 10**6)
    rows = [(10_000, " ".join(hub))]
    for i in range(300):  # most are further than the threshold from each other
        copy = list(hub)
        for k in rng.sample(range(120), rng.randrange(1, 12)):
            copy[k] = f"own{i}-{k % 3}"
        rows.append((i, " ".join(copy)))
    rows += [(20_000 + i, f"the same line here {i}") for i in range(200)]
    got = {r[0]: tuple(r[1:]) for r in near_dedup.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == near_brute(rows, 3, 85)


def test_one_of_each_with_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, long + " tail"), (3, "other text"), (3, "quite another one"), (None, "alone"), (None, None), (7, None)]
    df = frame(spark, rows, True)
    out = near_dedup.one_of_each(df)
    assert out.columns == df.columns
    kept = collections.Counter(r.doc_id for r in out.collect())
    assert kept[1] == 1 and kept[2] == 0 and kept[3] == 1 and kept[7] == 1 and kept[None] >= 1
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_one_row_each_decides_by_row(spark):
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, long + " tail"), (2, "a clean text of its own"), (3, "other text"), (3, "quite another one"), (7, None), (7, None)]
    rows += [(None, other), (None, other), (None, other + " tail"), (None, "alone"), (9, "copied with and without an id"), (None, "copied with and without an id")]
    want = [(1, long), (2, "a clean text of its own"), (3, "other text"), (3, "quite another one"), (7, None), (9, "copied with and without an id"), (None, "alone")]
    df = frame(spark, rows, True)
    out = near_dedup.one_row_each(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    linked = [x for x in got if x[1] in (other, other + " tail")]
    assert len(linked) == 1 and sorted((x for x in got if x not in linked), key=repr) == sorted(want, key=repr)
    assert sorted(near_dedup.one_row_each(df.repartition(3)).collect(), key=repr) == sorted(out.collect(), key=repr)
    assert near_dedup.one_row_each(df.limit(0)).count() == 0


def test_texts_that_hang_together_by_a_null_id(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (None, " ".join(words[:90])), (2, " ".join(words[:81]))]
    assert near_brute([(1, rows[0][1]), (2, rows[2][1])], 5, 85)[2][1] == 2  # not near each other
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows), 5, 85).collect()}
    assert got == {1: 1, 2: 1, None: 1}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000 + rng.randrange(40), 5000 + rng.randrange(40)) for _ in range(30)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def repeat_rows(seed=6):
    rng = random.Random(seed)
    passages = [prose(rng, rng.randrange(45, 120)) for _ in range(8)]
    texts = [None, "", " ".join(["same"] * 49), " ".join(["same"] * 50), " ".join(["same"] * 300), " ".join(["a", "b"] * 80), " ".join(["b", "a"] * 40)]
    for _ in range(60):
        words = prose(rng, rng.randrange(5, 90))
        for p in rng.sample(passages, rng.randrange(3)):
            cut = rng.randrange(0, 12)
            words += p[cut:] + prose(rng, rng.randrange(4))
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    texts += texts[10:20]
    rng.shuffle(texts)
    return list(enumerate(texts))


def repeat_brute(rows, size=50):
    first, words = {}, {}
    for i, t in rows:
        w = words[i] = WORD.findall(t or "")
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed, extra", [(6, True), (7, False)])
def test_repeats_against_all_windows(spark, seed, extra):
    rows = repeat_rows(seed)
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.remove_repeats(frame(spark, rows, extra)).collect()}
    assert got == repeat_brute(rows)


def test_repeats_with_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, text), (6, "x " + text), (None, text), (5, "y " * 70)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == [(-1, 60, 60), (5, 60, 0), (5, 60, 0), (5, 70, 0), (6, 61, 60)]
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_symbols_that_depend_on_a_stretch_are_in_every_text_that_has_it():
    rng = np.random.default_rng(3)
    for trial in range(60):
        alphabet = rng.integers(1, 1 << 62, 3 if trial % 3 == 0 else 200, np.uint64)
        core = rng.choice(alphabet, 60)
        found = []
        for _ in range(2):
            before, after = rng.choice(alphabet, rng.integers(0, 30)), rng.choice(alphabet, rng.integers(0, 30))
            words = np.concatenate(([recompress.BORDER], before, core, after, [recompress.BORDER])).astype(np.uint64)
            s, start = recompress.compress(words), 1 + len(before)
            inside = (s.dlo >= start) & (s.dhi <= start + len(core))
            found.append(({(int(n), int(a)) for n, a in zip(s.name[inside], s.lo[inside] - start)}, {(int(n), int(a)) for n, a in zip(s.name, s.lo - start)}))
        assert found[0][0] <= found[1][1] and found[1][0] <= found[0][1]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(1 << 15, 1 << 10), (64, 24), (40, 8)])
def test_tokens_against_the_library(spark, library, chunk, overlap):
    rng = random.Random(chunk)
    bits = ["the", " we're", "'ll", "\n\n", "   ", "\t", "é", "漢字", "🙂", "12345", "...", "<|endoftext|>", " x", "it's", "a" * 70, " " * 90, " ", "'", "r", "e"]
    texts = [None, "", "a", "'", " "] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 120))) for _ in range(120)]
    df = frame(spark, list(enumerate(texts)), True)
    encoded = tokens.encode_documents(df, RANKS, public_tokenizers.PATTERN, chunk, overlap)
    got = {r.doc_id: (bytes(r.ids), bytes(r.bytes)) for r in tokens.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i] == (b"".join(x.to_bytes(4, "little") for x in ids), (t or "").encode()), repr(t)
    assert tokens.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    both = {r.doc_id: (bytes(r.ids), bytes(r.bytes)) for r in tokens.encode_documents(df, RANKS, public_tokenizers.PATTERN, chunk, overlap, decoded=True).collect()}
    assert both == got
    twice = tokens.round_trip(df.limit(5).union(df.limit(5)), RANKS, public_tokenizers.PATTERN)
    assert twice.count() == 10


def license_index(spark):
    return licenses.build_index(spark.createDataFrame(licenses.TEMPLATES, "name string, text string"))


def test_license_matches_with_edits_and_repeats(spark):
    index = license_index(spark)
    mit = dict(licenses.TEMPLATES)["MIT"].split()
    edited = mit[:40] + ["added", "words"] + mit[40:90] + mit[93:]
    text = "Intro. " + " ".join(edited) + " End. " + "All rights reserved. " * 300
    found = licenses.scan_text(index, text)
    names = collections.Counter(m[0] for m in found)
    assert names["MIT"] == 1 and names["All-rights-reserved"] == 300
    (match,) = [m for m in found if m[0] == "MIT"]
    assert text[match[1] : match[2]] == " ".join(edited)[:-1] and match[6] > 0.97
    assert licenses.scan_text(index, "permission is granted to rights of all sorts") == []


def test_license_lines_against_plain_search(spark):
    rng = random.Random(2)
    lines = licenses.TEMPLATES[:5]
    rows = []
    for i in range(80):
        parts = [" ".join(prose(rng, rng.randrange(30))) + "." for _ in range(3)]
        parts[1:1] = [rng.choice(lines)[1] for _ in range(rng.randrange(3))]
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "...")]
    df = frame(spark, rows, True)
    templates = spark.createDataFrame([*lines, (None, "x y z"), ("nothing", None), ("blank", "?")], "name string, text string")
    got = sorted((r.doc_id, r.template, r.start) for r in licenses.scan(df, templates).collect())
    assert got == sorted((i, n, m.start()) for i, t in rows for n, s in lines for m in re.finditer(re.escape(s.rstrip(".")), t or ""))
    assert licenses.scan(df.limit(0), templates).count() == 0 and licenses.scan(df, templates.limit(0)).count() == 0


def test_license_near_misses_versions_and_full_texts(spark):
    index = licenses.build_index(licenses.known_templates(spark))
    named = lambda text: [m[0] for m in licenses.scan_text(index, text)]
    for text, want in (
        ("Released under the BSD License.", ["BSD-name"]), ("Released under the FOO License.", []), ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0-name0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0-line"]), ("Licensed under CC BY-XX 4.0.", []), ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1-name0"]),
        ("Licensed under the Apache License, Version 7.3.", []), ("Released under the MIT License.", ["MIT-line"]), ("# SPDX-License-Identifier: MPL-2.0 and more words", ["SPDX-MPL-2.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0-name0"]),
    ):
        assert named("Some words first. " + text + " And words after it.") == want, text
    templates = dict(licenses.TEMPLATES)
    for name, text in templates.items():
        assert named(text) == [name] or text in {t for n, t in templates.items() if n != name}, name
    gpl = templates["GPL-2.0-notice"]
    assert named(gpl.replace("version 2", "version 9")) == [] and named(gpl.replace("GNU General", "FOO General")) == []
    for name in licenses.TEXTS:
        text = open(os.path.join(os.path.dirname(licenses.__file__), "license_texts", f"{name}.txt")).read()
        assert [n for n in named("Before. " + text + " After.") if "full" in n] == [f"{name}-full-text"]
        if name in ("GPL-3", "MPL-2.0"):
            words = text.split()
            edited = words[:300] + [w + "x" if i % 9 == 0 else w for i, w in enumerate(words[300:])]
            edited[600:650] = []
            assert named(" ".join(edited) + " Middle. " + text).count(f"{name}-full-text") == 2


def article_of(source):
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_pages_against_their_articles(spark):
    source = {r.page_id: r.html for r in queries.pages(spark, SF).collect()}
    got = queries.op5_html_extract(spark, SF).collect()
    assert len(got) == len(source)
    assert all(r.text == article_of(source[r.page_id]) and r.n_chars == len(r.text) for r in got)


PAGE = """<html><head><title>T</title></head><body class="page"><header><h1>Site</h1></header><div id="wrap" class="wrap-{n}"><div class="cookie-notice">We use
cookies</div><aside>side</aside><div class="content"><h2>Real &amp; title</h2><p>Para  one is\nlong enough &lt;b&gt; yes.<p>Two <i>it</i>alic.<ul><li>x<li>y</ul><form><input>f</form>
<div class="comments"><p>first! and a very long comment that says more than the article does, over and over, over and over</p></div></div><div class=sidebar>links <a href=1>aaa</a></div></div>
<script>if (a < b) "<p>no</p>"</script><!-- <p>no</p> --><footer>f</footer>"""


def test_extraction_rules_and_odd_pages(spark):
    want = "Real & title\nPara one is long enough <b> yes.\nTwo italic.\nx\ny"
    rows = [(1, "http://a.b/1", PAGE.format(n=1)), (2, "http://a.b/2", PAGE.format(n=22)), (3, None, None), (4, "bad", ""), (5, "http://c/", "plain &eacute; text"), (5, "http://c/", "plain &eacute; text"),
            (6, "http://a.b/3", "<body><p>other layout of enough text</body>"), (7, "http://d/", "<p a='>'>x</p><p"), (None, "http://d/", "<div><nav>only menu</nav></div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "path": F.lit(2), "text": F.lit(3)})
    got = [(r.page_id, r.text) for r in html_extract.extract(df).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, want), (2, want), (3, ""), (4, ""), (5, "plain é text"), (5, "plain é text"), (6, "other layout of enough text"), (7, "x"), (None, "")], key=repr
    )
    assert html_extract.extract(df.limit(0)).count() == 0


def words(n, mark="w"):
    return " ".join(f"{mark}{i}" for i in range(n))


@pytest.mark.parametrize("inner", [
    "<article><h1>{a}</h1><div class=lead>{b}</div><div class=text><p>{c}</p></div></article>",
    "<div class=content><p>{a}</p><p>{b}</p><div class=more><p>{c}</p></div></div>",
    "<div class=post><section class=one><p>{a}</p></section><section class=two><p>{b}</p></section><section class=three><p>{c}</p></section></div>",
    "<main><h1>{a}</h1><article><p>{b}</p><div class=text><p>{c}</p></div></article></main>",
    "<div class=page><table><tr><td class=x>{a}</td><td class=y>{b}</td><td class=z>{c}</td></tr></table></div>",
    "<div class=post><p>{a}</p><p>{b}</p><blockquote><p>{c}</p></blockquote></div>",
    "<div class=post><h1>{a}</h1><div class=in><p>{b}</p><div class=text><p>{c}</p></div></div></div>",
])
def test_pages_keep_leads_sections_and_quotes(spark, inner):
    a, b, c = words(8, "a"), words(8, "b"), words(200, "c")
    page = "<html><body><nav>menu</nav>{}<div><a href=1>one other page</a> <a href=2>and one more page</a></div><div>(c) 2020</div></body></html>".format(inner.format(a=a, b=b, c=c))
    df = spark.createDataFrame([(1, "http://x.y/1", page), (2, "http://x.y/2", page)], "page_id long, url string, html string")
    assert [r.text for r in html_extract.extract(df).collect()] == ["\n".join((a, b, c))] * 2


def test_pages_add_to_the_path_of_their_host_and_leave_what_is_outside_the_article(spark):
    c = words(100, "c")
    plain = f"<body><article><div class=text><p>{c}</p></div></article><div class=bio>{words(30, 'bio')}</div></body>"
    lead = f"<body><article><p>{words(9, 'lead')}</p><div class=text><p>{c}</p></div></article></body>"
    df = spark.createDataFrame([(1, "http://x/1", plain), (2, "http://x/2", plain), (3, "http://x/3", lead)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == {1: c, 2: c, 3: words(9, "lead") + "\n" + c}


@pytest.mark.parametrize("start", ["<article>", "<div class=text>", "<img src=1>", "", "</head>", "<body>", "</head><body>", "<iframe src=1></iframe>"])
def test_head_ends_where_something_else_begins(start):
    page = html_extract.parse(f"<!DOCTYPE html><html><head> <meta charset=utf-8><title>T</title>\n<style>p</style><noscript>n</noscript><!-- c -->\n{start}{words(9)}<p>more")
    assert html_extract.text_at(page, html_extract.best_path(page)) == words(9) + "\nmore"


@pytest.mark.parametrize("dims, n", [(64, 300), (40, 60)])
def test_nearest_codes_against_all_pairs(spark, dims, n):
    rng = random.Random(dims)
    rows = []
    for i in range(n):
        v = [rng.uniform(-1, 1) for _ in range(dims)]
        rows.append((i, [abs(x) for x in v] if i % 4 == 0 else v))  # many equal codes
    odd = [(1001, None), (1002, []), (1003, [1.0] * 8), (None, [0.5] * dims)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"code": F.lit(1), "q": F.lit(2), "n": F.lit(3)})
    asked = df.where("vec_id % 20 = 0 or vec_id > 1000")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in vectors.nearest(df, asked, 5).collect())
    code = {i: int("".join("1" if x > 0 else "0" for x in v), 2) for i, v in rows}
    want = sorted((i, r + 1, j, d) for i in code if i % 20 == 0 for r, (d, j) in enumerate(sorted(((code[i] ^ code[j]).bit_count(), j) for j in code if j != i)[:5]))
    assert got == want


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, r"\s+(?!\S)|[^\s]+|\s+"])
def test_tokens_are_cut_right_for_any_ranks(spark, tmp_path, pattern):
    """Ranks with tokens of white space, texts of runs of it, and chunks so small that every place is a cut."""
    blanks = [b"\n\n", b"  ", b" \n", b"\n\n\n", b" a", b"ab", b"'s", b"   "]
    ranks = {bytes([i]): i for i in range(256)} | {b: 256 + i for i, b in enumerate(blanks)}
    path = f"{tmp_path}/ranks"
    with open(path, "wb") as out:
        out.writelines(base64.b64encode(t) + b" " + str(r).encode() + b"\n" for t, r in ranks.items())
    whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(11)
    texts = ["".join(rng.choice(["\n", "\n\n", " ", "  ", "a", "b", "ab", "'s", "é", "1"]) for _ in range(rng.randrange(20, 120))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokens.encode_documents(df, path, pattern, chunk=24, overlap=14).collect()}
    assert got == {i: whole.encode_ordinary(t) for i, t in enumerate(texts)}


BODY = "<p>" + "several plain words of the article " * 8 + "</p>"
TEXT = ("several plain words of the article " * 8).strip()


def read_page(source):
    page = html_extract.parse(source)
    return html_extract.text_at(page, html_extract.best_path(page)) or html_extract.text_at(page, None)


@pytest.mark.parametrize(
    "source, want",
    [
        (f"<div class='sidebar-layout'><article>{BODY}</article></div>", [TEXT]),
        (f"<body><div class='container no-sidebar has-comments'>{BODY}</div>", [TEXT]),
        (f"<body><div class='header'>Site</div><div id='page-search'><div class='text'>{BODY}{BODY}</div></div>", [TEXT] * 2),
        (f"<body><form action=x><input name=state><div id=content>{BODY * 3}</div><div class=comments>{BODY * 9}</div><input type=submit></form>", [TEXT] * 3),
        (f"<article>{BODY}<div class='search-results'>{BODY}</div><div class=share>{BODY}</div><div class=notice>a small notice</div><form>sign up <input></form></article>", [TEXT] * 2),
        (f"<article>{BODY}</article><div class=comments>{BODY * 6}</div><div class=sidebar>{BODY[:80]}</p></div>", [TEXT]),
        (f"<article>{BODY}<div class=widget>" + f"<a href=x>{TEXT}</a>" * 3 + "</div></article>", [TEXT]),
        ("<body><div class=comments>nothing but this</div></body>", ["nothing but this"]),
        ("<form><div><p>a</p></div></form>", ["a"]),
        (f"<article><p>one <span class=hidden>not this</span> line</p>{BODY}</article>", ["one line", TEXT]),
        ("<div class=nav></div>", [""]),
    ],
)
def test_marks_do_not_empty_pages(source, want):
    assert read_page(source).split("\n") == want


def test_deep_pages_are_read_in_linear_time():
    for source, n in (("<div>x" * 20_000, 20_000), ("<div class=a>x</b></i>" * 20_000, 20_000), ("<form><div class=sidebar>x" * 20_000, 10_001), ("<span>x</zz>" * 20_000 + "<p>y" * 20_000, 20_001)):
        tracemalloc.start()
        start = time.perf_counter()
        assert len(read_page(source).split("\n")) == n
        assert time.perf_counter() - start < 30 and tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()


def test_very_long_pages(spark):
    page = "<body><div class=menu>no</div><article>" + BODY * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "http://x.y/1", page), (1, "http://x.y/1", page)], "page_id long, url string, html string")
    assert [r.n_chars for r in html_extract.extract(df).collect()] == [20_000 * (len(TEXT) + 1) - 1] * 2


@pytest.mark.parametrize("name", ["op2_near_dedup", "op4_nearest_codes", "op5_html_extract", "op6_substring_dedup", "op8_token_round_trip", "op10_license_scan"])
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
