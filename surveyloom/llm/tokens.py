"""Byte-level BPE encoding by overlapping chunks, and decoding.

Long texts are cut into overlapping chunks that are pre-tokenised by different tasks. Pre-tokens
depend only on where they start and on the characters up to a little after their end. So where two
chunks have a boundary in common, they agree from there on: texts are cut at such places. As the last
pre-token of a piece can depend on what follows it, pieces are pre-tokenised with LOOK characters more
and encoded pre-token by pre-token up to their end. A text with an overlap that has no common boundary, such
as one very long word, is cut again into larger chunks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import stage

CHUNK = 1 << 16
OVERLAP = 1 << 10
#: Characters after a pre-token that can change it: a contraction has up to three characters.
LOOK = 4
GROWTH = 8
#: Takes any text as one pre-token.
WHOLE = r"(?s:.+)"
#: Texts that a worker turns into arrays at a time.
AT_ONCE = 128


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 token and rank a line), once per worker; without special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _compiled(pattern: str):
    return regex.compile(pattern)


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens of ``text``."""
    return [m.end() for m in _compiled(pattern).finditer(text)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a worker holds little besides the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def encode_piece(path: str, pattern: str, text: str, size: int) -> list[int]:
    """Ids of the first ``size`` characters of ``text``, which end at a boundary; what follows is only looked at."""
    piece, own = text[:size], encoding(path, pattern)
    if size == len(text):
        return own.encode_ordinary(piece)
    ends = [e for e in boundaries(text, pattern) if e <= size]
    if ends == boundaries(piece, pattern):
        return own.encode_ordinary(piece)
    single = encoding(path, WHOLE)
    return [i for start, end in zip([0, *ends], ends) for i in single.encode_ordinary(text[start:end])]


def _with_ids(rows: DataFrame, path: str, pattern: str, kept: str, decoded: bool, sized: bool = False) -> DataFrame:
    """``rows`` with ids in the place of the last column, text, and with the bytes that they decode to where asked; ``sized`` rows have the length of the piece before its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        for b in _slices(batches):
            texts, left = b.column("text").to_pylist(), -2 if sized else -1
            if sized:
                ids = [encode_piece(path, pattern, t, n) for t, n in zip(texts, b.column("size").to_pylist())]
            else:
                ids = [own.encode_ordinary(t) for t in texts]
            out = [*b.columns[:left], pa.array([np.array(i, "<u4").tobytes() for i in ids], pa.binary())]
            if decoded:
                out.append(pa.array([own.decode_bytes(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names[:left], "ids", "bytes"][: len(out)])

    return rows.mapInArrow(run, f"{kept}, ids binary" + ", bytes binary" * decoded)


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): token ids as little-endian unsigned 32-bit integers, one row per document; with ``decoded`` also the bytes they stand for.

    Null texts are empty and have no ids; repeated rows and ids stay separate rows; other columns
    are not read. ``path`` must be readable by every executor. Texts of up to ``chunk`` characters
    are one chunk and are not shuffled; of the others only cuts and ids are, and the pieces.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk)

    direct = _with_ids(short, path, pattern, "doc_id long", decoded)

    step = chunk - overlap
    long = rows.where(F.length("text") > chunk)
    starts = F.sequence(F.lit(0), F.length("text") - 1 - overlap, F.lit(step))
    chunks = stage(
        long.withColumn("row", F.expr("uuid()"))
        .withColumn("starts", starts)
        .select("row", "doc_id", F.posexplode("starts").alias("no", "start"), F.size("starts").alias("n"), "text")
        .select("row", "doc_id", "no", "n", "start", F.expr(f"substring(text, start + 1, {chunk})").alias("text")),
        "chunks",
    )

    def pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Boundaries in the overlaps, each with the lower of the two chunk numbers."""
        for b in batches:
            out = []
            for row, no, n, start, text in zip(b["row"], b["no"], b["n"], b["start"], b["text"]):
                ends = boundaries(text, pattern)
                if no > 0:
                    out += [(row, no - 1, start + e, 1) for e in ends if e <= overlap]
                if no < n - 1:
                    out += [(row, no, start + e, 0) for e in ends if step <= e <= len(text) - LOOK]
            yield pd.DataFrame(out, columns=["row", "no", "at", "side"])

    # the first place that both chunks of an overlap have as a boundary
    ends = chunks.repartition("row", "no").select("row", "no", "n", "start", "text").mapInPandas(pretokenise, "row string, no int, at int, side int")
    common = ends.groupBy("row", "no", "at").agg(F.countDistinct("side").alias("sides")).where("sides = 2")
    cuts = stage(common.groupBy("row", "no").agg(F.min("at").alias("at")), "cuts")

    # every chunk is right from the cut before it on only if all cuts of its text are there
    whole = chunks.select("row", "n").distinct().join(cuts.groupBy("row").agg(F.count("*").alias("cuts")), "row", "left")
    failed = stage(whole.where(F.coalesce("cuts", F.lit(0)) < F.col("n") - 1).select("row"), "uncut")
    here, before = cuts.select("row", "no", F.col("at").alias("until")), cuts.select("row", (F.col("no") + 1).alias("no"), F.col("at").alias("since"))
    placed = chunks.join(failed, "row", "left_anti").join(here, ["row", "no"], "left").join(before, ["row", "no"], "left")
    begin = F.coalesce(F.col("since"), F.col("start")) - F.col("start")
    size = F.coalesce(F.col("until") - F.col("start"), F.length("text")) - begin
    pieces = placed.select("row", "doc_id", "no", size.cast("int").alias("size"), F.substring(F.col("text"), begin + 1, size + LOOK).alias("text"))

    encoded = _with_ids(pieces, path, pattern, "row string, doc_id long, no int", decoded, sized=True)
    # the ids of a document are one value in the result, so its pieces meet in one row
    values = ["ids", "bytes"] if decoded else ["ids"]
    joined = lambda v: F.aggregate(F.array_sort(F.collect_list(F.struct("no", v))), F.lit(b""), lambda acc, x: F.concat(acc, x[v])).alias(v)
    out = direct.unionByName(encoded.groupBy("row", "doc_id").agg(*[joined(v) for v in values]).select("doc_id", *values))
    if failed.isEmpty():
        return out
    parts = F.array_sort(F.collect_list(F.struct("no", F.when(F.col("no") < F.col("n") - 1, F.substring(F.col("text"), F.lit(1), F.lit(step))).otherwise(F.col("text")).alias("text"))))
    again = chunks.join(failed, "row", "left_semi").groupBy("row", "doc_id").agg(F.array_join(F.transform(parts, lambda x: x.text), "").alias("text"))
    return out.unionByName(encode_documents(again, path, pattern, GROWTH * chunk, GROWTH * overlap, decoded))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes): the raw bytes of the tokens, concatenated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        for b in _slices(batches):
            raw = [own.decode_bytes(np.frombuffer(i, "<u4").tolist()) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(raw, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per document."""
    decoded = encode_documents(docs, path, pattern, decoded=True)
    return decoded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )
