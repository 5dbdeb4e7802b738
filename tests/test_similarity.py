"""Fuzzy matching against brute force with the standard library."""

import random
import re
from difflib import SequenceMatcher, get_close_matches

from surveyloom.functions.text import PHONETIC_REWRITES
from surveyloom.operators import infer, spelling
from surveyloom.operators.lexicons import Lexicons

LEX = Lexicons()


def variants(words, n, seed):
    """Words with random edits, so that many lie near a threshold."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        letters = list(rng.choice(words))
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(letters) + 1)
            kind = rng.random()
            if kind < 0.4:
                letters.insert(i, rng.choice("abdehiklmnorstuy"))
            elif letters and kind < 0.8:
                letters.pop(min(i, len(letters) - 1))
            elif letters:
                letters[min(i, len(letters) - 1)] = rng.choice("abdehiklmnorstuy")
        if letters:
            out.add("".join(letters))
    return sorted(out)


def test_nearest_surnames_equals_close_matches(spark):
    surnames = list(LEX.surname_categories())
    tokens = variants(surnames, 400, 1) + ["ab", "mesharam", "kambal", "zzgrp"]
    expected = {}
    for t in tokens:
        near = [s for s in surnames if abs(len(s) - len(t)) <= 1]
        best = get_close_matches(t, near, n=1, cutoff=0.83) if len(t) >= 3 else []
        if best:
            expected[t] = (best[0], round(SequenceMatcher(None, t, best[0]).ratio(), 12))
    df = spark.createDataFrame([(t,) for t in tokens], "token string").distinct()
    found = {r["token"]: (r["surname"], round(r["ratio"], 12)) for r in infer.nearest_surnames(df, LEX).collect()}
    assert found == expected
    assert len(expected) > 50


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def phonetic(word):
    for pattern, replacement in PHONETIC_REWRITES:
        word = re.sub(pattern, replacement, word)
    return word


def brute(token, vocab):
    """Best correction of an unknown token: (word, confidence, source), or None."""
    options = []
    same = [w for w in vocab if phonetic(w) == phonetic(token)]
    if same:
        top = min(same, key=lambda w: (levenshtein(token, w), w))
        d = levenshtein(token, top)
        if d <= 2:
            r = SequenceMatcher(None, token, top).ratio()
            options.append((int(r * 92) if d <= 1 else max(70, int(r * 88)), 1, top, "phonetic"))
    close = get_close_matches(token, vocab, n=3, cutoff=0.75)
    if close:
        d = levenshtein(token, close[0])
        if d <= 2:
            r = SequenceMatcher(None, token, close[0]).ratio()
            options.append((int(r * 88) if d <= 1 else int(r * 76), 0, close[0], "fuzzy"))
    best = max(options, default=None)
    return (best[2].capitalize(), best[0], best[3]) if best and best[0] >= 70 else None


def test_token_corrections_equal_brute_force(spark):
    words = LEX.spelling_words()
    given = [w for v, w in words if v == "given"]
    family = [w for v, w in words if v == "surname"]
    known, protected = set(words), set(LEX.protected_names)
    tokens = [("given", t) for t in variants(given, 300, 2)] + [("surname", t) for t in variants(family, 300, 3)]
    tokens = [(v, t) for v, t in tokens if len(t) > 2]
    expected = {}
    for v, t in tokens:
        if (v, t) in known or t in protected:
            continue
        fix = brute(t, given if v == "given" else family)
        if fix:
            expected[v, t] = fix
    checked = spark.createDataFrame(tokens, "vocab string, token string")
    rows = spelling.token_corrections(spelling.unknown_tokens(checked, LEX), LEX).collect()
    found = {(r["vocab"], r["token"]): (r["corrected"], r["confidence"], r["method"].split("(")[0]) for r in rows}
    assert found == expected
    assert len(expected) > 100


def test_spell_check_paths_agree(spark):
    names = [
        "sunitta patill", "Sunita", "ramesh kumarr x yz 123 meshramm", "", None, "  vijey   gajanann Kamblee ", "a b c d e f sunitta",
        "govinda Patil", "12345 ramesh",
    ]
    df = spark.createDataFrame(list(enumerate(names)), "row_id long, name string")
    one = spelling.spell_check(df, "name", LEX, inline=True)
    two = spelling.spell_check(df, "name", LEX, inline=False)
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(one.data.collect()) == key(two.data.collect())
    assert key(one.changes.collect()) == key(two.changes.collect())
    data = {r["row_id"]: r["name"] for r in one.data.collect()}
    assert data[0] == "Sunita Patil" and data[3] == "" and data[4] is None and data[7] == "govinda Patil"
    assert data[5].split()[-1] == "Kamble"
    assert spelling.spell_check(df, "name", LEX, apply=False).data.exceptAll(df).count() == 0
