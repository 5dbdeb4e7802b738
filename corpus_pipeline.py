"""A training-data pipeline: quality, near-duplicates, secrets, mixture, token round trip.

Each stage takes and returns whole tables; all but the last return the columns of ``documents``:

1. quality rules: documents that fail the base rules or the label model go;
2. near-duplicates (five-word shingles, similarity of 0.8): of each group a row of the smallest doc_id stays;
3. secret scan: secrets in the texts are replaced by a mask;
4. mixture: every document as often as its source's repetition rate says;
5. tokens: ids of every text, with the digest of what they decode to.

Tables that a stage has staged are dropped when the next one starts, as its input is stored by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import mixing, near_dedup, quality_rules, secret_scan, tokens
from surveyloom.session import drop_staged, stage, staged_paths

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
#: Per application, the staged tables that the result of the last stage still reads.
_read_by_last: dict[str, list[str]] = {}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(apply: Stage) -> Stage:
    @wraps(apply)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        drop_staged(spark, _read_by_last.pop(app, []))
        with staged_paths() as made:
            out = apply(spark, docs, sf_dir)
        _read_by_last[app] = made
        return out

    return run_stage


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


@_stage
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_row_each(docs, size=5, percent=80)


@_stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_documents(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@_stage
def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    decoded = tokens.encode_documents(docs, RANKS, PATTERN, decoded=True)
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", keep_one_of_each),
    ("secret scan", mask_secrets),
    ("mixture", mix_sources),
    ("tokens", to_tokens),
]

#: Shingle hashes and token merges have no SQL form; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``; each stage's table is stored and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, apply in STAGES[:-1]:
        with staged_paths() as made:
            docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_staged(spark, before)  # the input of this stage
        before = made[-1:]
    out = STAGES[-1][1](spark, docs, sf_dir)
    _read_by_last.pop(spark.sparkContext.applicationId, None)  # what the result reads stays, whatever runs next
    return out
