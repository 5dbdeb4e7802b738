"""Learning name libraries from reviewed ("verified") and noisy ("unverified") files.

Evidence is kept as counts per (name, source file). A re-read file replaces its own
counts, so an incremental rebuild equals a full one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.text import clean_val, extract_first

STRICT_MIN, PROB_MIN, PROB_SHARE = 2, 3, 0.95


def name_gender_pairs(df: DataFrame, name: str, gender: str, source_file: str = "source_file") -> DataFrame:
    """(name, gender, source_file) of usable rows."""
    missing = [c for c in (name, gender) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns}")
    return df.select(
        extract_first(F.col(name)).alias("name"), clean_val(F.col(gender)).alias("gender"), F.col(source_file).alias("source_file")
    ).where((F.col("name") != "") & F.col("gender").isin("male", "female"))


def pair_counts(df: DataFrame, name: str, gender: str, source_file: str = "source_file") -> DataFrame:
    """Rows and usable pairs per file."""
    usable = (extract_first(F.col(name)) != "") & clean_val(F.col(gender)).isin("male", "female")
    return df.groupBy(source_file).agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(usable).alias("pair_count"))


def evidence_counts(pairs: DataFrame) -> DataFrame:
    """(name, source_file, male, female)."""
    return pairs.groupBy("name", "source_file").agg(
        F.count_if(F.col("gender") == "male").alias("male"), F.count_if(F.col("gender") == "female").alias("female")
    )


def replace_evidence(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored counts without the files read again, plus the fresh counts."""
    return stored.join(fresh.select("source_file").distinct(), "source_file", "left_anti").unionByName(fresh)


def name_totals(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("name").agg(
        F.sum("male").alias("male_count"),
        F.sum("female").alias("female_count"),
        F.max((F.col("male") > 0) & (F.col("female") > 0)).alias("in_file_conflict"),
        F.count(F.lit(1)).alias("n_files"),
    ).withColumn("total", F.col("male_count") + F.col("female_count"))


def ambiguous_names(evidence: DataFrame) -> DataFrame:
    """Names seen with both genders, inside a file or across files."""
    both = (F.col("male_count") > 0) & (F.col("female_count") > 0)
    return name_totals(evidence).where(both).select(
        "name", "male_count", "female_count", "total", "n_files",
        F.when(F.col("in_file_conflict"), "in_file_conflict").otherwise("cross_file_conflict").alias("reason"),
    )


def strict_library(evidence: DataFrame, min_occurrences: int = STRICT_MIN) -> DataFrame:
    """Names of one gender only, seen often enough."""
    single = (F.col("male_count") == 0) | (F.col("female_count") == 0)
    return name_totals(evidence).where(single & (F.col("total") >= min_occurrences)).select(
        "name",
        F.when(F.col("male_count") > 0, "male").otherwise("female").alias("gender"),
        F.col("total").alias("count"),
        "n_files",
    )


def prob_candidates(evidence: DataFrame, min_share: float = PROB_SHARE, min_occurrences: int = PROB_MIN) -> DataFrame:
    """Names whose dominant gender holds at least ``min_share`` of the sightings."""
    male_share, female_share = F.col("male_count") / F.col("total"), F.col("female_count") / F.col("total")
    return (
        name_totals(evidence)
        .where(F.col("total") >= min_occurrences)
        .withColumn("gender", F.when(male_share >= min_share, "male").when(female_share >= min_share, "female"))
        .where(F.col("gender").isNotNull())
        .select(
            "name",
            "gender",
            F.round(F.greatest(male_share, female_share), 4).alias("confidence"),
            "male_count",
            "female_count",
            "total",
            "n_files",
        )
    )


def without_strict(prob: DataFrame, strict: DataFrame) -> DataFrame:
    """The strict library always wins."""
    return prob.join(strict.select("name"), "name", "left_anti")


def promoted(prob: DataFrame, strict: DataFrame) -> DataFrame:
    """Names that move from the probable to the strict library."""
    return prob.join(strict.select("name"), "name", "left_semi").select("name")


def demote(strict: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """A stored strict library without the names that have become ambiguous."""
    return strict.join(ambiguous.select("name"), "name", "left_anti")


def name_sources(evidence: DataFrame) -> DataFrame:
    """(name, source_file): the source files of each name in long form, so no set is ever gathered."""
    return evidence.select("name", "source_file").distinct()


def lookup_table(strict: DataFrame, prob: DataFrame, strict_confidence: int = 95, prob_scale: int = 80) -> DataFrame:
    """(name, gender, confidence, layer): strict before probable, for ``infer.with_gender(library=...)``.

    A probable name gets its share of sightings times ``prob_scale`` as confidence, so that with
    the usual thresholds it is suggested rather than written. Store the table before looking up in it.
    """
    return strict.select(
        "name", "gender", F.lit(strict_confidence).alias("confidence"), F.lit("strict").alias("layer")
    ).unionByName(
        without_strict(prob, strict).select(
            "name", "gender", F.floor(F.col("confidence") * prob_scale).cast("int").alias("confidence"), F.lit("prob").alias("layer")
        )
    )


def library_sizes(strict: DataFrame, prob: DataFrame) -> DataFrame:
    """Entries by library and gender."""
    both = strict.select(F.lit("strict").alias("library"), "gender").unionByName(
        prob.select(F.lit("prob").alias("library"), "gender")
    )
    return both.groupBy("library").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("gender") == "male").alias("male"),
        F.count_if(F.col("gender") == "female").alias("female"),
    )


def growth(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entries by library before and after a rebuild (inputs from ``library_sizes``)."""
    old = before.select("library", F.col("entries").alias("before"))
    new = after.select("library", F.col("entries").alias("after"))
    return (
        new.join(old, "library", "full")
        .select("library", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
        .withColumn("added", F.greatest(F.col("after") - F.col("before"), F.lit(0)))
    )


class Libraries(NamedTuple):
    strict: DataFrame
    ambiguous: DataFrame
    prob: DataFrame
    promoted: DataFrame


def build_libraries(verified: DataFrame, unverified: DataFrame) -> Libraries:
    """Both libraries from the evidence of both tiers; the probable one sees the new strict one."""
    strict = strict_library(verified)
    candidates = prob_candidates(unverified)
    return Libraries(strict, ambiguous_names(verified), without_strict(candidates, strict), promoted(candidates, strict))
