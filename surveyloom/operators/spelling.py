"""Spelling correction of names, token by token."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.similarity import edit_distance, may_reach, sequence_ratio
from surveyloom.functions.text import capitalize, phonetic_key, tokens
from surveyloom.operators.keyed import fits_broadcast, lookup
from surveyloom.operators.lexicons import Lexicons, by_length, local_table
from surveyloom.session import stage

FUZZY_CUTOFF = 0.75
MIN_TOKEN = 3


def name_tokens(df: DataFrame, name: str, row_id: str = "row_id") -> DataFrame:
    """(row_id, pos, role, original, token, vocab) for every token worth checking."""
    words = tokens(F.col(name))
    exploded = df.select(F.col(row_id), F.size(words).alias("_n"), F.posexplode(words).alias("pos", "original"))
    role = (
        F.when(F.col("pos") == 0, "first")
        .when((F.col("pos") == F.col("_n") - 1) & (F.col("_n") > 1), "surname")
        .otherwise("middle")
    )
    return (
        exploded.where((F.length("original") >= MIN_TOKEN) & ~F.col("original").rlike("^[0-9]+$"))
        .withColumn("role", role)
        .withColumn("token", F.lower("original"))
        .withColumn("vocab", F.when(F.col("role") == "surname", "surname").otherwise("given"))
        .drop("_n")
    )


def unknown_tokens(checked: DataFrame, lexicons: Lexicons) -> DataFrame:
    """Distinct (vocab, token) that are neither in their vocabulary nor protected."""
    spark = checked.sparkSession
    known = lexicons.spelling_vocabulary(spark).withColumnRenamed("word", "token")
    protected = local_table(spark, {"token": list(lexicons.protected_names)}, "token string")
    return (
        checked.select("vocab", "token")
        .distinct()
        .join(F.broadcast(known), ["vocab", "token"], "left_anti")
        .join(F.broadcast(protected), "token", "left_anti")
        .select("vocab", "token")
    )


def phonetic_candidates(unknown: DataFrame, lexicons: Lexicons, max_distance: int = 2) -> DataFrame:
    """Per token the word with the same phonetic key at the smallest edit distance, then the smaller name."""
    vocabulary = lexicons.spelling_vocabulary(unknown.sparkSession).withColumn("_key", phonetic_key(F.col("word")))
    return (
        unknown.withColumn("_key", phonetic_key(F.col("token")))
        .join(F.broadcast(vocabulary), ["vocab", "_key"])
        .groupBy("vocab", "token")
        .agg(F.min(F.struct(edit_distance(F.col("token"), F.col("word")).alias("distance"), F.col("word"))).alias("_top"))
        .select("vocab", "token", F.col("_top.word").alias("word"), F.col("_top.distance").alias("distance"))
        .where(F.col("distance") <= max_distance)
    )


def similar_candidates(
    unknown: DataFrame, lexicons: Lexicons, cutoff: float = FUZZY_CUTOFF, max_distance: int = 2
) -> DataFrame:
    """Per token the word with the highest sequence ratio (equal ratios: the greater string)."""
    vocabulary = by_length(unknown.sparkSession, lexicons.spelling_words(), cutoff)
    return (
        unknown.withColumn("token_length", F.length("token"))
        .join(F.broadcast(vocabulary), ["vocab", "token_length"])
        .where(may_reach(F.col("token"), F.col("word"), cutoff))
        .withColumn("_score", sequence_ratio("word", "token"))
        .where(F.col("_score") >= cutoff)
        .groupBy("vocab", "token")
        .agg(F.max(F.struct("_score", "word")).alias("_top"))
        .select("vocab", "token", F.col("_top.word").alias("word"))
        .withColumn("distance", edit_distance(F.col("token"), F.col("word")))
        .where(F.col("distance") <= max_distance)
    )


def token_corrections(
    unknown: DataFrame, lexicons: Lexicons, min_confidence: int = 70, high_confidence: int = 80, max_distance: int = 2
) -> DataFrame:
    """(vocab, token, corrected, confidence, method, status) for tokens with an accepted correction."""
    near = F.col("distance") <= 1
    phonetic = (
        phonetic_candidates(unknown, lexicons, max_distance)
        .withColumn("_ratio", sequence_ratio("token", "word"))
        .withColumn(
            "confidence",
            F.when(near, (F.col("_ratio") * 92).cast("int")).otherwise(
                F.greatest(F.lit(70), (F.col("_ratio") * 88).cast("int"))
            ),
        )
        .withColumn("_source", F.lit("phonetic"))
        .withColumn("_first", F.lit(1))
    )
    similar = (
        similar_candidates(unknown, lexicons, max_distance=max_distance)
        .withColumn("_ratio", sequence_ratio("token", "word"))
        .withColumn(
            "confidence",
            F.when(near, (F.col("_ratio") * 88).cast("int")).otherwise((F.col("_ratio") * 76).cast("int")),
        )
        .withColumn("_source", F.lit("fuzzy"))
        .withColumn("_first", F.lit(0))
    )
    best = (
        phonetic.unionByName(similar)
        .groupBy("vocab", "token")
        .agg(F.max(F.struct("confidence", "_first", "word", "distance", "_source")).alias("_top"))
    )
    return best.where(F.col("_top.confidence") >= min_confidence).select(
        "vocab",
        "token",
        capitalize(F.col("_top.word")).alias("corrected"),
        F.col("_top.confidence").alias("confidence"),
        F.concat(F.col("_top._source"), F.lit("(edit="), F.col("_top.distance").cast("string"), F.lit(")")).alias("method"),
        F.when(F.col("_top.confidence") >= high_confidence, "corrected").otherwise("review").alias("status"),
    )


class SpellCheck(NamedTuple):
    data: DataFrame
    changes: DataFrame


# Token places corrected by broadcast joins inside the row: first, two middle ones, last.
# Names with more tokens take the exploded path.
INLINE_TOKENS = 4
_LOG = ("role", "original_token", "corrected_token", "confidence", "method", "status")


def _inline_path(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """``_fixed`` (array of corrections) by one broadcast join per token place; no row is shuffled."""
    n, words = F.size("_words"), F.col("_words")
    places = (
        ("first", "given", n > 0, F.lit(0)),
        ("middle", "given", n > 2, F.lit(1)),
        ("middle", "given", n > 3, F.lit(2)),
        ("surname", "surname", n > 1, n - 1),
    )
    found = []
    for i, (role, vocab, exists, position) in enumerate(places):
        token = F.when(exists, F.get(words, position))
        table = fixes.where(F.col("vocab") == vocab).select(
            F.col("token").alias(f"_token{i}"),
            F.struct("corrected", "confidence", "method", "status").alias(f"_fix{i}"),
        )
        rows = rows.withColumn(f"_token{i}", F.lower(token)).join(F.broadcast(table), f"_token{i}", "left")
        fix = F.col(f"_fix{i}")
        found.append(
            F.when(
                fix.isNotNull(),
                F.struct(
                    position.cast("int").alias("pos"),
                    F.lit(role).alias("role"),
                    F.get(words, position).alias("original_token"),
                    fix["corrected"].alias("corrected_token"),
                    fix["confidence"].alias("confidence"),
                    fix["method"].alias("method"),
                    fix["status"].alias("status"),
                ),
            )
        )
    drop = [f"_token{i}" for i in range(len(places))] + [f"_fix{i}" for i in range(len(places))]
    return rows.withColumn("_fixed", F.filter(F.array(*found), lambda x: x.isNotNull())).drop(*drop)


def _exploded_path(rows: DataFrame, checked: DataFrame, fixes: DataFrame, row_id: str) -> DataFrame:
    """``_fixed`` for names of any length: corrected tokens are gathered per row id and joined back."""
    per_row = (
        lookup(checked, fixes, ["vocab", "token"], how="inner")
        .groupBy(row_id)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "pos", "role", F.col("original").alias("original_token"), F.col("corrected").alias("corrected_token"),
                        "confidence", "method", "status",
                    )
                )
            ).alias("_fixed")
        )
    )
    return rows.join(per_row, row_id, "left")


def spell_check(
    df: DataFrame,
    name: str,
    lexicons: Lexicons,
    row_id: str = "row_id",
    min_confidence: int = 70,
    high_confidence: int = 80,
    max_distance: int = 2,
    apply: bool = True,
    inline: bool | None = None,
    count_as: str | None = None,
) -> SpellCheck:
    """Correct the tokens of one name column; with ``count_as`` the data say in a column of that name how many tokens had a correction.

    Only distinct unknown tokens are compared with the vocabulary. The accepted
    corrections form a small table; while it fits a broadcast, names of up to
    INLINE_TOKENS tokens are corrected in place and only longer names are exploded.
    """
    checked = name_tokens(df, name, row_id)
    fixes = stage(
        token_corrections(unknown_tokens(checked, lexicons), lexicons, min_confidence, high_confidence, max_distance),
        "token-corrections",
    )
    rows = df.withColumn("_words", tokens(F.col(name)))
    if inline if inline is not None else fits_broadcast(fixes):
        longer = F.size("_words") > INLINE_TOKENS
        long_names = df.where(F.size(tokens(F.col(name))) > INLINE_TOKENS)
        fixed = _inline_path(rows.where(~longer), fixes).unionByName(
            _exploded_path(rows.where(longer), name_tokens(long_names, name, row_id), fixes, row_id)
        )
    else:
        fixed = _exploded_path(rows, checked, fixes, row_id)

    # Rebuild the name from its tokens with the corrected ones put in place.
    by_place = F.map_from_entries(F.transform("_fixed", lambda f: F.struct(f["pos"], f["corrected_token"])))
    rebuilt = F.transform("_words", lambda t, i: F.coalesce(F.try_element_at(by_place, i), t))
    untouched = F.col("_fixed").isNull() | (F.size("_fixed") == 0)
    after = (
        F.when(F.size("_words") == 0, F.col(name))
        .when(untouched, F.array_join("_words", " "))
        .otherwise(F.array_join(rebuilt, " "))
    )
    fixed = fixed.withColumn("_after", after)
    log = fixed.where(~untouched).select(
        F.col(row_id).alias("row_id"),
        F.lit(name).alias("column"),
        F.col(name).alias("name_before"),
        F.col("_after").alias("name_after"),
        F.inline("_fixed"),
    ).select("row_id", "column", "name_before", "name_after", *_LOG)
    counted = [F.coalesce(F.size("_fixed"), F.lit(0)).alias(count_as)] if count_as else []
    if apply:
        data = fixed.withColumn(name, F.col("_after")).select(*df.columns, *counted)
    else:
        data = fixed.select(*df.columns, *counted) if counted else df
    return SpellCheck(data, log)
