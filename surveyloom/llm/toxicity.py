"""Toxicity of texts restored by a noisy-channel decoder.

A character model (counts of three successive letters of all texts) and a channel (which letters a
digit or sign may stand for, what may be dropped or repeated) span a lattice over every token that
looks disguised: 1d10t, i.d.i.o.t, i d i o t, idiiiot. The Viterbi path is the restored text. Its words
and their beginnings are scored by a logistic model over those that tell the labels apart best.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import stage
from surveyloom.operators.keyed import split_by_keys

FOLDS = 5
#: Beginnings of words that are features, besides whole words.
STEMS = (3, 4, 5, 6)
FEATURES = 512
#: Labelled rows, drawn by a hash of the id, that the weights of the features are fitted on.
FIT_ROWS = 20_000
RIDGE = 1.0
CACHE = 1 << 18
PIECE = 1 << 20
# The alphabet of the character model, and the letters that other characters may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}
# Costs of the channel, in nats.
LOOK, ANY_LOOK, REPEAT, DOUBLE, DROP, DROP_LOOK, DROP_BLANK, BREAK, BREAK_EDGE = 1.0, 2.5, 0.5, 7.0, 1.5, 7.0, 1.0, 5.0, 3.0

_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
OTHER = len(LETTERS) + 1
SIZE = OTHER + 1
_EDGE = ".,;:!?%&#*()[]{}<>\"'`´’‘“”«»|/\\-_=+~^"
_RUNS = re.compile(r"([^\w\s])\1\1+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")


def _code_table() -> np.ndarray:
    """Class of each code point below U+0180, letters of other scripts being one class; the last entry is for all above."""
    table = np.zeros(0x181, np.int64)
    for point in range(0x180):
        low = chr(point).lower()
        table[point] = _CODE.get(low, OTHER if low.isalpha() else 0)
    table[0x180] = OTHER
    return table


def letter_counts(texts: Iterator[str | None]) -> np.ndarray:
    """Counts of three successive classes within words, 0 being what is around them."""
    table, out, held, size = _code_table(), np.zeros(SIZE**3, np.int64), [], 0

    def flush() -> None:
        nonlocal out, held, size
        points = np.frombuffer(("  " + "  ".join(held) + "  ").encode("utf-32-le", "replace"), np.uint32)
        code = table[np.minimum(points, 0x180)]
        before, here, after = code[:-2], code[1:-1], code[2:]
        used = (here > 0) | (after > 0)
        out += np.bincount(((np.where(here > 0, before, 0) * SIZE + here) * SIZE + after)[used], minlength=SIZE**3)
        held, size = [], 0

    for text in texts:
        if text:
            held.append(text)
            size += len(text)
            if size >= PIECE:
                flush()
    if held:
        flush()
    return out


def character_model(docs: DataFrame) -> np.ndarray:
    """Cost -ln p(c | a, b) of classes over all texts; a table of SIZE^3, whatever the input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = letter_counts(t for b in batches for t in b["text"])
        held = np.flatnonzero(total)
        yield pd.DataFrame({"at": held.astype(np.int32), "n": total[held]})

    found = docs.select("text").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3)
    counts[found["at"].to_numpy(np.int64)] = found["n"]
    return costs(counts)


def costs(counts: np.ndarray) -> np.ndarray:
    """Interpolated costs from counts of (a, b, c), those of shorter contexts being sums of them."""
    tri = counts.reshape(SIZE, SIZE, SIZE)
    two, one = tri.sum(axis=0), tri.sum(axis=(0, 1))
    share = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), 1)
    p = 0.75 * share(tri) + 0.18 * share(two)[None] + 0.06 * share(one)[None, None] + 0.01 / SIZE
    return -np.log(p).astype(np.float32)


def _looks(low: str) -> tuple[bool, bool]:
    """Whether any character comes three times in a row, and whether three single characters stand between blanks."""
    points = np.frombuffer(f" {low} ".encode("utf-32-le", "replace"), np.uint32)
    same = points[1:] == points[:-1]
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    return bool((same[1:] & same[:-1]).any()), bool((blank[:-6] & blank[2:-4] & blank[4:-2] & blank[6:]).any())


class Restorer:
    """Viterbi decoder of tokens; results are kept for tokens met before."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.ravel().tolist()
        self.known: dict[str, tuple[str, ...]] = {}

    def words(self, text: str | None) -> list[str]:
        """The words of the restored text, lower-cased, those spelled with blanks first. Tokens of letters alone stay as they are."""
        low = (text or "").lower()
        out: list[str] = []
        runs, spaced = _looks(low)
        if runs:
            low = _RUNS.sub(" ", low)
        if spaced:
            for run in _SPACED.findall(low):
                out += self.restored(run)
            low = _SPACED.sub(" ", low)
        plain = not (runs and _TRIPLE.search(low))
        for token in low.split():
            if token.isalpha() and plain:
                out.append(token)
                continue
            tail = token.rstrip(_EDGE)
            bare = tail.lstrip(_EDGE)
            if bare.isalpha() and bare == tail and (plain or not _TRIPLE.search(bare)):
                out.append(bare)
            elif any(map(str.isalpha, bare)):
                out += self.restored(tail)
        return out

    def restored(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[token] = tuple(self.decode(token).split())
        return found

    @staticmethod
    def _options(token: str, i: int) -> list[tuple[str, float]]:
        """Readings of a character: letters, a break (a blank) or nothing, with their costs."""
        c = token[i]
        run = token[max(0, i - 2) : i + 3].count(c * 3) > 0  # part of three or more in a row
        again = [("", REPEAT if run else DOUBLE)] if i and token[i - 1] == c else []
        if c.isalpha():
            return [(c, 0.0), *again]
        if c.isspace():
            return [(" ", 0.0), ("", DROP_BLANK)]
        edge = i == len(token) - 1
        looks = LOOKS.get(c, "")
        cost = LOOK if len(looks) < 3 else ANY_LOOK
        blank = BREAK if looks and not edge else BREAK_EDGE
        return [*((x, cost) for x in looks), (" ", blank), ("", DROP_LOOK if looks else DROP), *again]

    def decode(self, token: str) -> str:
        """The cheapest reading under channel and character model; linear in the token's length."""
        cost, end = self.cost, (0, 0)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {end: (0.0, None)}
        for i in range(len(token)):
            options = [(x, _CODE.get(x, OTHER) if x not in " " else 0, c) for x, c in self._options(token, i)]
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (so_far, path) in states.items():
                for x, code, channel in options:
                    if not x:
                        state, total, way = (a, b), so_far + channel, path
                    elif code:
                        state, total, way = (b, code), so_far + channel + cost[(a * SIZE + b) * SIZE + code], (path, x)
                    else:  # a break ends the word, if there is one
                        state, total = end, so_far + channel + (cost[(a * SIZE + b) * SIZE] if b else 0.0)
                        way = (path, " ") if b else path
                    best = step.get(state)
                    if best is None or total < best[0]:
                        step[state] = (total, way)
            states = step
        _, path = min(((t + (cost[(a * SIZE + b) * SIZE] if b else 0.0), p) for (a, b), (t, p) in states.items()), key=lambda x: x[0])
        letters = []
        while path:
            path, x = path
            letters.append(x)
        return "".join(reversed(letters))


def beginnings(words: set[str]) -> set[str]:
    """The features of a text: its distinct words and their beginnings."""
    return words.union(*({w[:k] for w in words} for k in STEMS))


class Model(NamedTuple):
    cost: np.ndarray
    features: list[str]
    weights: np.ndarray  # one per feature, the last for none


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, draw) of the documents that may be learned from; several labels of an id are toxic if one is.

    Only texts that may have a label are shuffled.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marks = stage(marks.where(fold(F.col("doc_id")) != 0), "marks")
    asked, _ = split_by_keys(docs.select("doc_id", "text").where(fold(F.col("doc_id")) != 0), marks.select("doc_id"), ["doc_id"])
    return asked.join(marks.hint("merge"), "doc_id").select("text", "toxic", (F.xxhash64("doc_id", F.lit(17)) / F.lit(2.0**63)).alias("draw"))


def _telling(learn: DataFrame, cost: np.ndarray, clean: int, toxic: int) -> list[str]:
    """The FEATURES features by which the labels differ most (likelihood ratio), from counts over all learnable documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, held = Restorer(cost), (Counter(), Counter())

        def out() -> pd.DataFrame:
            keys = list(held[0].keys() | held[1].keys())
            sides = [np.array([h[k] for k in keys], np.int32) for h in held]
            for h in held:
                h.clear()
            return pd.DataFrame({"f": keys, "clean": sides[0], "toxic": sides[1]})

        for b in batches:
            for text, side in zip(b["text"], b["toxic"]):
                held[side].update(beginnings(set(restorer.words(text))))
                if len(held[0]) + len(held[1]) > 2 * CACHE:
                    yield out()
        yield out()

    counted = learn.select("text", "toxic").mapInPandas(run, "f string, clean int, toxic int")
    counted = counted.groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = {"clean": float(clean), "toxic": float(toxic)}
    seen = F.col("clean") + F.col("toxic")
    term = lambda held, of, share: F.when(held > 0, held * F.log(held / (F.lit(of) * share))).otherwise(0.0)
    everyone = max(clean + toxic, 1)
    ratio = sum(
        (term(F.col(k), n[k], seen / everyone) + term(n[k] - F.col(k), n[k], 1 - seen / everyone) for k in ("clean", "toxic")), F.lit(0.0)
    )
    best = counted.withColumn("ratio", ratio).where("ratio > 5").orderBy(F.desc("ratio"), "f").limit(FEATURES)
    return [r["f"] for r in best.collect()]


class _Places(dict):
    """Places of a word's features in the model, forgotten when there are too many."""

    def __init__(self, features: list[str]):
        super().__init__()
        self.at = {f: i for i, f in enumerate(features)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        names = {word, *(word[:k] for k in STEMS)}
        found = self[word] = tuple(self.at[f] for f in names if f in self.at)
        return found


def _values(words: list[str], places: _Places) -> dict[int, float]:
    """Feature values of a text: logarithms of counts, and of counts a thousand words."""
    found: dict[int, int] = {}
    for word in words:
        for at in places[word]:
            found[at] = found.get(at, 0) + 1
    return {at: math.log1p(n) + math.log1p(1000.0 * n / len(words)) for at, n in found.items()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Newton's method for ridge logistic regression, the last weight being free and for a column of ones."""
    x = np.hstack([x, np.ones((len(x), 1))])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Character model from all texts, features from all learnable documents, weights from about ``fit_rows`` of them at most.

    Without labels of both kinds every score is the share of toxic ones (0 without any).
    """
    cost = character_model(docs)
    learn = stage(_labelled(docs, labels), "learn")
    size = learn.agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    both = size["clean"] > 0 and size["toxic"] > 0
    features = _telling(learn, cost, size["clean"], size["toxic"]) if both else []
    if not both:
        return Model(cost, features, np.array([30.0 if size["toxic"] else -30.0]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, places = Restorer(cost), _Places(features)
        for b in batches:
            rows = [_values(restorer.words(t), places) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "at": [list(r) for r in rows], "value": [list(r.values()) for r in rows]})

    # rows of one id share their draw; the fraction of draws is that of the rows wanted
    part = min(1.0, fit_rows / (size["clean"] + size["toxic"]))
    sample = learn.where(F.col("draw") <= 2 * part - 1)
    found = sample.mapInPandas(run, "toxic int, at array<int>, value array<double>").toPandas()
    x = np.zeros((len(found), len(features)))
    for row, (at, value) in enumerate(zip(found["at"], found["value"])):
        x[row, np.asarray(at, np.int64)] = value
    y = found["toxic"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        share = size["toxic"] / (size["clean"] + size["toxic"])
        return Model(cost, [], np.array([math.log(share / (1 - share))]))
    return Model(cost, features, logistic(x, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    weights = model.weights.tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, places = Restorer(model.cost), _Places(model.features)
        for b in batches:
            totals = [sum(weights[at] * v for at, v in _values(restorer.words(t), places).items()) + weights[-1] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": 1 / (1 + np.exp(-np.clip(totals, -30, 30)))}).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")


def restore(docs: DataFrame, cost: np.ndarray) -> DataFrame:
    """(doc_id, restored): the words of each text, decoded and joined by blanks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(cost)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "restored": [" ".join(restorer.words(t)) for t in b["text"]]}).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, restored string")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Only doc_id and text of ``docs`` and doc_id and toxic of ``labels`` are read, and only rows whose
    CRC-32 of the id leaves a remainder are learned from. A null id is held out. Null, empty and
    wordless texts get the score of a text without features; repeated rows count and are scored each;
    texts are read whole, in time that grows with their length.
    """
    found = score(docs, fit(docs, labels))
    return found.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
