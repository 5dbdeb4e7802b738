"""Quality rules as weak supervision: rules vote or abstain, and a label model weighs them.

Every rule votes +1 (good), -1 (bad) or 0 (abstains). Expectation-maximisation over the
counts of vote patterns estimates how often each rule gives each vote on good and on bad
documents, abstaining included, as most rules know junk but not its absence. A document is
kept if its posterior probability of being good is high enough.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import WORD, let, stage, words

ROUNDS = 25
#: Starting and prior probabilities of the votes (bad, abstain, good) on good and on bad documents,
#: and the share of all documents that the prior weighs.
ON_GOOD, ON_BAD = (0.02, 0.58, 0.40), (0.30, 0.50, 0.20)
WEIGHT = 0.02
LOWEST = 0.001
PRIOR = 0.9
FEW_REPEATS = 32
#: Signs in a row, or one that stands alone.
MARKS = "[^\\p{L}\\p{N}\\s]{2,}|(?<=\\s)[^\\p{L}\\p{N}\\s](?=\\s)"


class Model(NamedTuple):
    prior: float
    good: dict[str, tuple[float, float, float]]
    bad: dict[str, tuple[float, float, float]]


def repeated_words(w: Column) -> Column:
    """Words of the array ``w`` in three-word windows that occur twice or more in it, the first included.

    Windows are compared by 64-bit hashes. The repeated hashes come from one sort of plain
    numbers; where they are few, positions are looked up, otherwise hashes are sorted with them.
    """

    def covered(starts: Column) -> Column:
        step = lambda acc, p: F.struct((acc.n + p + 3 - F.greatest(p, acc.end)).alias("n"), (p + 3).alias("end"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc.n)

    def by_sort(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, j, d: F.get(s, j + d).h == F.get(s, j).h
        twice = let(pairs, lambda s: F.filter(s, lambda x, j: F.coalesce(same(s, j, -1), F.lit(False)) | F.coalesce(same(s, j, 1), F.lit(False))))
        return F.sort_array(F.transform(twice, lambda x: x.i))

    def count(h: Column) -> Column:
        repeated = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
        looked_up = lambda d: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
        return let(repeated, lambda d: F.when(F.size(d) == 0, 0).otherwise(covered(F.when(F.size(d) <= FEW_REPEATS, looked_up(d)).otherwise(by_sort(h)))))

    windows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, 0).otherwise(let(windows, count)).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """The base counts of every document, and what the rules need, as a column ``f``; other columns stay.

    Null and empty texts have no words: all counts are 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    packed = docs.withColumn("f", let(words(F.col("text")), lambda w: let(
        F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD))),
        lambda lines: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            (F.length(text) - F.length(F.regexp_replace(text, "\\p{L}+", ""))).cast("long").alias("n_letters"),
            (F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}+", ""))).cast("long").alias("n_upper"),
            F.regexp_count(text, F.lit(MARKS)).cast("long").alias("n_marks"),
            F.size(F.filter(lines, lambda line: F.rlike(line, F.lit("[.!?:;…\"'”»)]\\s*$")))).cast("long").alias("n_closed"),
        ),
    )))
    return packed


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(f: Column) -> dict[str, Column]:
    """One vote per rule from the features."""
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    never = F.lit(False)
    return {
        "words": _vote(f.n_words < 50, f.n_words >= 100),
        "symbols": _vote(part(f.n_symbols, f.word_chars) > 0.1, never),
        "marks": _vote(part(f.n_marks, f.n_words) > 0.3, part(f.n_marks, f.n_words) < 0.1),
        "letters": _vote(part(f.n_letters, f.word_chars) < 0.8, part(f.n_letters, f.word_chars) > 0.9),
        "capitals": _vote(part(f.n_upper, f.word_chars) > 0.5, never),
        "repeats": _vote(part(f.n_repeat_words, f.n_words) > 0.3, never),
        "lines": _vote(part(f.n_dup_lines, f.n_lines) > 0.3, (f.n_lines >= 3) & (f.n_dup_lines == 0)),
        "distinct": _vote(part(f.n_distinct, f.n_words) < 0.1, never),
        "length": _vote((part(f.word_chars, f.n_words) < 2.5) | (part(f.word_chars, f.n_words) > 12), never),
        "closed": _vote((f.n_lines > 0) & (f.n_closed == 0), part(f.n_closed, f.n_lines) >= 0.5),
    }


def base_failed(f: Column) -> Column:
    return (f.n_words < 50) | (100 * f.n_repeat_words > 50 * f.n_words)


def posterior(model: Model, v: dict[str, Column]) -> Column:
    """Probability of good, given all votes."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for name, vote in v.items():
        minus, zero, plus = (math.log(g / b) for g, b in zip(model.good[name], model.bad[name]))
        odds = odds + F.when(vote == 1, plus).when(vote == -1, minus).otherwise(zero)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(f_rows: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over vote patterns of rows with a column ``f`` that pass the base rules.

    Patterns number 3 to the power of the rules at most, whatever the rows; a round is one
    aggregation of them to one row of sums. An empty table leaves the starting values. A rule's
    vote for bad counts at least as much on bad documents as on good ones, so the classes can't swap.
    """
    names = list(votes(F.col("f")))
    rows = f_rows.where(~base_failed(F.col("f"))).select(*[v.alias(k) for k, v in votes(F.col("f")).items()])
    patterns = stage(rows.groupBy(*names).agg(F.count("*").alias("_n")).coalesce(1), "votes")
    model = Model(PRIOR, dict.fromkeys(names, ON_GOOD), dict.fromkeys(names, ON_BAD))
    for _ in range(rounds):
        rated = patterns.withColumn("_p", posterior(model, {k: F.col(k) for k in names}))
        good, bad = F.col("_n") * F.col("_p"), F.col("_n") * (1 - F.col("_p"))
        part = lambda k, v, weight: F.sum(F.when(F.col(k) == v, weight).otherwise(0.0))
        sums = rated.agg(
            F.sum("_n").alias("n"), F.sum(good).alias("good"), F.sum(bad).alias("bad"),
            *[part(k, v, w).alias(f"{k}{v}{c}") for k in names for v in (-1, 0, 1) for c, w in (("g", good), ("b", bad))],
        ).first()
        if not sums["n"]:
            break
        weight = max(1.0, WEIGHT * sums["n"])

        def share(k: str, c: str, total: float, prior: tuple) -> tuple:
            raw = [max(LOWEST, (sums[f"{k}{v}{c}"] + weight * q) / (total + weight)) for v, q in zip((-1, 0, 1), prior)]
            return tuple(x / sum(raw) for x in raw)

        on_good = {k: share(k, "g", sums["good"], ON_GOOD) for k in names}
        on_bad = {k: share(k, "b", sums["bad"], ON_BAD) for k in names}
        on_bad = {k: v if v[0] >= on_good[k][0] else on_good[k] for k, v in on_bad.items()}
        prior = (sums["good"] + weight * PRIOR) / (sums["n"] + weight)
        moved = max(abs(prior - model.prior), *(abs(a - b) for k in names for a, b in zip(on_bad[k] + on_good[k], model.bad[k] + model.good[k])))
        model = Model(prior, on_good, on_bad)
        if moved < 1e-5:
            break
    return model


def kept(f: Column, model: Model, least: float = 0.5) -> Column:
    return ~base_failed(f) & (posterior(model, votes(f)) >= least)


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, base verdict, posterior and verdict per document.

    Documents without words fail the base rules. Each row is judged by its own text, so
    repeated rows and ids get the same verdict; other columns are not read.
    """
    rows = stage(features(docs.select("doc_id", "text")).select("doc_id", "f"), "features")
    model = fit(rows)
    f = F.col("f")
    return rows.select(
        "doc_id", *[f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(f).alias("base_failed"), kept(f, model).alias("kept"), F.round(posterior(model, votes(f)), 4).alias("posterior"),
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    packed = stage(features(docs.select("text", F.struct(*docs.columns).alias("row"))).select("row", "f"), "judged")
    return packed.where(kept(F.col("f"), fit(packed))).select("row.*")
