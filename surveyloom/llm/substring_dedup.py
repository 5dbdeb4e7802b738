"""Substring deduplication: passages of at least ``window`` words that a smaller doc_id also has.

Recompression (recompress.py) gives every document its symbols of the last round. A symbol that
depends only on words within a window is in every document that has this window. So a window is
unique if one of its symbols occurs in one text only; the others, and windows without such a symbol,
are verified by their own hashes, and each keeps the smallest doc_id that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import class_of, stage, unique_seed
from surveyloom.llm.recompress import BORDER, Names, compress, window_hashes

WINDOW = 50
SHORTEST = 3
#: Words that are compressed at a time, to bound a task's memory.
AT_ONCE = 1 << 18


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()  # at ASCII blanks only


def _groups(texts: pd.Series) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(position of the first, words of each) for stretches of texts."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        words = _split(text)
        if held and size + len(words) > AT_ONCE:
            yield first, held
            first, held, size = i, [], 0
        held.append(words)
        size += len(words)
    if held:
        yield first, held


def _joined(texts: list[list[bytes]], names: Names) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words with borders around each text, and the place of each text's first word."""
    counts = np.array([len(w) for w in texts], np.int64)
    starts = np.cumsum(counts + 1) - counts
    out = np.full(int(counts.sum()) + len(texts) + 1, BORDER, np.uint64)
    for words, at in zip(texts, starts):
        if words:
            out[at : at + len(words)] = np.fromiter(map(names.__getitem__, words), np.uint64, len(words))
    return out, starts


def _own(b: pd.DataFrame) -> Iterator[tuple]:
    """Words and the other values of each row whose text is the one of its class; rows with the same doc_id can have others."""
    for row in b.itertuples(index=False):
        words = _split(row.text)
        if xxhash.xxh3_128_digest(b" ".join(words)) == row.digest:
            yield words, row


def symbols(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, digest, n, sha, names, since, until) per document: symbols that depend on words [since, until) of the text only, within one window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names()
        for b in batches:
            for first, texts in _groups(b["text"]):
                plain = [b" ".join(w) for w in texts]
                long = [i for i, w in enumerate(texts) if len(w) >= window]
                found = {}
                if long:
                    words, starts = _joined([texts[i] for i in long], names)
                    s = compress(words)
                    owner = np.searchsorted(starts, s.lo, "right") - 1
                    ends = starts + np.array([len(texts[i]) for i in long])
                    good = (s.dlo >= starts[owner]) & (s.dhi <= ends[owner]) & (s.dhi - s.dlo <= window) & (s.hi - s.lo >= SHORTEST)
                    owner, name = owner[good], s.name[good].view(np.int64)
                    since, until = (s.dlo[good] - starts[owner]).astype(np.int32), (s.dhi[good] - starts[owner]).astype(np.int32)
                    cut = np.searchsorted(owner, np.arange(len(long) + 1))
                    found = {i: (name[a:z], since[a:z], until[a:z]) for i, a, z in zip(long, cut, cut[1:])}
                none = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32))
                mine = [found.get(i, none) for i in range(len(texts))]
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].iloc[first : first + len(texts)].astype("Int64").to_numpy(),
                    "digest": [xxhash.xxh3_128_digest(p) for p in plain], "n": [len(w) for w in texts], "sha": [hashlib.sha256(p).hexdigest() for p in plain],
                    "names": [m[0] for m in mine], "since": [m[1] for m in mine], "until": [m[2] for m in mine],
                })

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, digest binary, n long, sha string, names array<long>, since array<int>, until array<int>")


def _open_windows(n: int, names: np.ndarray, since: np.ndarray, until: np.ndarray, shared: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [from, to) of window starts that no unshared symbol shows to be unique."""
    total = n - window + 1
    unshared = ~np.isin(names, shared)
    a, z = np.maximum(until[unshared] - window, 0), np.minimum(since[unshared], total - 1) + 1
    change = np.zeros(total + 1, np.int64)
    ok = a < z
    np.add.at(change, a[ok], 1)
    np.add.at(change, z[ok], -1)
    free = np.concatenate(([0], (np.cumsum(change[:-1]) == 0).astype(np.int8), [0]))
    step = np.diff(free)
    return np.flatnonzero(step == 1).astype(np.int32), np.flatnonzero(step == -1).astype(np.int32)


def open_windows(rows: DataFrame, window: int) -> DataFrame:
    """(class, digest, doc_id, starts, ends): the texts with windows to verify, one of each class, and where these start."""
    keys = rows.where(F.size("names") > 0).select("class", F.explode(F.array_distinct("names")).alias("name"))
    shared = keys.groupBy("name").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("name")
    shared = stage(shared, "shared")
    own = keys.join(shared, "name").groupBy("class").agg(F.collect_set("name").alias("shared"))
    alike = ("digest", "n", "names", "since", "until")
    classes = rows.groupBy("class").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in alike])
    marked = classes.join(own, "class", "left").select("class", "doc_id", *alike, F.coalesce("shared", F.array().cast("array<long>")).alias("shared"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for own, digest, doc_id, n, names, since, until, known in zip(*(b[c] for c in ("class", "digest", "doc_id", "n", "names", "since", "until", "shared"))):
                a, z = _open_windows(n, names, since, until, known, window)
                if len(a):
                    out.append((own, digest, doc_id, a, z))
            yield pd.DataFrame(out, columns=["class", "digest", "doc_id", "starts", "ends"]).astype({"class": "int64", "doc_id": "int64"})

    return marked.mapInPandas(run, "class long, digest binary, doc_id long, starts array<int>, ends array<int>")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(h1, h2, class, doc_id, start) of each window to verify; of equal ones in a text all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names()
        for b in batches:
            for words, row in _own(b.rename(columns={"class": "own"})):
                h1, h2 = window_hashes(np.fromiter(map(names.__getitem__, words), np.uint64, len(words)), window)
                at = np.concatenate([np.arange(a, z) for a, z in zip(row.starts, row.ends)])
                yield pd.DataFrame({"h1": h1[at].view(np.int64), "h2": (h2[at] >> np.uint64(32)).astype(np.uint32).view(np.int32), "class": row.own, "doc_id": row.doc_id, "start": at.astype(np.int32)})

    return texts.mapInPandas(run, "h1 long, h2 int, class long, doc_id long, start int")


def _kept_words(texts: DataFrame, window: int) -> DataFrame:
    """(class, n_removed, sha) of texts with the starts of their repeated windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for words, row in _own(b.rename(columns={"class": "own"})):
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, row.repeated, 1)
                np.add.at(change, row.repeated + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone) if not g)
                out.append((row.own, int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["class", "n_removed", "kept_sha"])

    return texts.mapInPandas(run, "class long, n_removed long, kept_sha string")


#: Stands for a null doc_id.
LAST = 2**63 - 1


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per document.

    Null and empty texts have no words; texts shorter than a window lose none. Rows with one doc_id
    don't count as earlier than each other, and a null doc_id counts as the largest. All windows
    are judged on the input. The stored tables hold symbols, not texts; texts are read again only where
    windows have to be verified.
    """
    identified = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text")
    stored = stage(symbols(identified, window), "symbols")
    rows = stored.withColumn("class", class_of(F.col("digest"), unique_seed(stored, "digest")))
    long = rows.where(F.col("n") >= window)
    asked = stage(open_windows(long, window), "open")
    texts = stage(identified.join(asked, "doc_id"), "texts")
    checked = stage(_windows(texts, window), "windows")
    first = checked.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = stage(first.select("h1", "h2", "first"), "first")  # stored, so that the join can split windows that many texts have
    repeated = checked.join(first, ["h1", "h2"]).where("first < doc_id").groupBy("class").agg(F.array_sort(F.collect_list("start")).alias("repeated"))
    changed = stage(_kept_words(texts.join(repeated, "class").select("class", "digest", "text", "repeated"), window), "changed").dropDuplicates(["class"])

    small = long.groupBy("class").agg(F.min("doc_id").alias("least")).join(changed.select("class", "n_removed", "kept_sha"), "class", "left")
    final = rows.select("doc_id", "class", "n", "sha").join(stage(small, "small"), "class", "left")
    copy = F.col("least") < F.col("doc_id")
    return final.select(
        F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )
