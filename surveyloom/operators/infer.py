"""Gender and category inference from names, and the corrections built on it."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.codes import (
    VALID_CATEGORIES,
    VALID_GENDERS,
    code_list,
    confidence_label,
    normalise_category,
    normalise_gender,
    review_id,
)
from surveyloom.functions.similarity import may_reach, sequence_ratio
from surveyloom.functions.text import clean_val, extract_first, first_token, last_token, let, strip, tokens
from surveyloom.operators.keyed import lookup
from surveyloom.operators.lexicons import (
    QUICK_FEMALE_NAMES,
    QUICK_FEMALE_SUFFIXES,
    QUICK_MALE_NAMES,
    QUICK_MALE_SUFFIXES,
    Lexicons,
    by_length,
)
from surveyloom.session import stage

# Confidences by tier.
EXACT_NAME, NAME_SUFFIX = 95, 82
QUICK_GUARDIAN, QUICK_SUFFIX = 82, 72
SURNAME_CLEAR, SURNAME_AMBIGUOUS, SURNAME_FUZZY, ANY_TOKEN, DISTRICT_PRIOR = 88, 62, 74, 68, 55
SINGLE_TIER = 62
FUZZY_CUTOFF, FUZZY_MAX_GAP, FUZZY_MIN_LENGTH = 0.83, 1, 3
CATEGORY_MIN_CONFIDENCE = 60
NORMALISATION = 99


def _result(value, confidence, tier) -> Column:
    return F.struct(
        F.lit(value).alias("value"), F.lit(confidence).cast("int").alias("confidence"), F.lit(tier).cast("int").alias("tier")
    )


def _labelled(best: Column) -> Column:
    return let(
        F.coalesce(best, _result("", 0, 0)),
        lambda r: F.struct(
            r["value"].alias("value"),
            r["confidence"].alias("confidence"),
            r["tier"].alias("tier"),
            confidence_label(r["confidence"]).alias("label"),
        ),
    )


def gender_by_suffix(token: Column, female: Sequence[str], male: Sequence[str]) -> Column:
    """Gender of a name by its ending; the ending must leave a stem, female endings come first."""

    def ends(endings: Sequence[str]) -> Column:
        return token.rlike(".(" + "|".join(re.escape(e) for e in endings) + ")$")

    return F.when(ends(female), "female").when(ends(male), "male")


def first_suffix(token: Column, endings: Sequence[str]) -> Column:
    """The first ending in list order that leaves a stem."""
    hits = [F.when(token.endswith(e) & (F.length(token) > len(e)), e) for e in endings]
    return F.coalesce(*hits)


def with_gender(df: DataFrame, name: str, lexicons: Lexicons, out: str = "gender_guess", library: DataFrame | None = None) -> DataFrame:
    """Add struct(value, confidence, tier, label): exact first name, then suffix.

    ``library`` (name, gender, confidence) adds a learned tier between the two. It is
    broadcast only after its size is checked.
    """
    spark = df.sparkSession
    first = first_token(F.col(name))
    rows = df.withColumn("_first", first).join(
        F.broadcast(lexicons.first_names(spark, "_first", "_exact")), "_first", "left"
    )
    tiers = [F.when(F.col("_exact").isNotNull(), _result(F.col("_exact"), EXACT_NAME, 1))]
    extra = ["_first", "_exact"]
    if library is not None:
        learned = library.select(
            F.col("name").alias("_first"), F.col("gender").alias("_lib"), F.col("confidence").cast("int").alias("_lib_conf")
        )
        rows = lookup(rows, learned, ["_first"])
        tiers.append(F.when(F.col("_lib").isNotNull(), _result(F.col("_lib"), F.col("_lib_conf"), 3)))
        extra += ["_lib", "_lib_conf"]
    suffix = gender_by_suffix(F.col("_first"), lexicons.female_suffixes, lexicons.male_suffixes)
    tiers.append(F.when(suffix.isNotNull(), _result(suffix, NAME_SUFFIX, 2)))
    return rows.withColumn(out, _labelled(F.coalesce(*tiers))).drop(*extra)


def quick_gender(name: Column, guardian: Column) -> Column:
    """struct(value, confidence, tier) of the quick engine; its lists are short enough for IN sets."""
    def tiers(t: Column) -> Column:
        suffix = gender_by_suffix(t["first"], QUICK_FEMALE_SUFFIXES, QUICK_MALE_SUFFIXES)
        return F.coalesce(
            F.when(t["first"].isin(*QUICK_FEMALE_NAMES), _result("female", EXACT_NAME, 1)),
            F.when(t["first"].isin(*QUICK_MALE_NAMES), _result("male", EXACT_NAME, 1)),
            F.when(t["other"].isin(*QUICK_FEMALE_NAMES), _result("male", QUICK_GUARDIAN, 2)),
            F.when(suffix.isNotNull(), _result(suffix, QUICK_SUFFIX, 3)),
            _result("", 0, 0),
        )

    return let(F.struct(first_token(name).alias("first"), first_token(guardian).alias("other")), tiers)


def fill_gender_quick(df: DataFrame, name: str, guardian: str, gender: str, min_confidence: int = 75) -> DataFrame:
    """Fill rows without a valid gender; adds ``_outcome`` (already_filled, tier name, cannot_determine)."""
    rows = df.withColumn("_guess", quick_gender(F.col(name), F.col(guardian)))
    guess = F.col("_guess")
    filled = clean_val(F.col(gender)).isin(*VALID_GENDERS)
    apply = ~filled & (guess["value"] != "") & (guess["confidence"] >= min_confidence)
    outcome = (
        F.when(filled, "already_filled")
        .when(~apply, "cannot_determine")
        .when(guess["tier"] == 1, "tier1_direct")
        .when(guess["tier"] == 2, "tier2_guardian")
        .otherwise("tier3_suffix")
    )
    return rows.withColumns(
        {
            "_outcome": outcome,
            "_confidence": F.when(apply, guess["confidence"]),
            gender: F.when(apply, guess["value"]).otherwise(F.col(gender)),
        }
    ).drop("_guess")


def nearest_surnames(
    words: DataFrame, lexicons: Lexicons, cutoff: float = FUZZY_CUTOFF, max_gap: int = FUZZY_MAX_GAP
) -> DataFrame:
    """Best fuzzy surname for each distinct ``token``: (token, surname, ratio, category, is_ambiguous).

    Tokens meet only vocabulary words of a fitting length (equi-join on length), an edit
    distance bound inside the join drops nearly all of those, and the sequence ratio is
    computed for the rest. Equal ratios go to the greater string.
    """
    spark = words.sparkSession
    vocabulary = by_length(spark, [("surname", s) for s in lexicons.surname_categories()], cutoff, max_gap)
    pairs = (
        words.where(F.length("token") >= FUZZY_MIN_LENGTH)
        .withColumn("token_length", F.length("token"))
        .join(F.broadcast(vocabulary), "token_length")
        .where(may_reach(F.col("token"), F.col("word"), cutoff))
        .withColumn("_score", sequence_ratio("word", "token"))
        .where(F.col("_score") >= cutoff)
    )
    best = pairs.groupBy("token").agg(F.max(F.struct("_score", "word")).alias("_best"))
    return (
        best.select("token", F.col("_best.word").alias("surname"))
        .withColumn("ratio", sequence_ratio("token", "surname"))
        .join(F.broadcast(lexicons.surname_table(spark)), "surname")
    )


def with_category(
    df: DataFrame,
    name: str,
    lexicons: Lexicons,
    district: str | None = None,
    out: str = "category_guess",
    fuzzy: bool = True,
    wanted: Column | None = None,
    names_from: DataFrame | None = None,
) -> DataFrame:
    """Add struct(value, confidence, tier, label) by surname, fuzzy surname, any token, district.

    ``wanted`` restricts the fuzzy tier to rows whose result will be used. The distinct
    surnames for it are read from ``names_from`` (any table holding at least the same
    names, such as the stored input), so that only those columns are scanned for them.
    """
    spark = df.sparkSession
    names = df.withColumn("_words", tokens(clean_val(F.col(name))))
    rows = names.withColumn("_surname", F.try_element_at("_words", F.lit(-1))).join(
        F.broadcast(lexicons.surname_table(spark, "_t1_").withColumnRenamed("_t1_surname", "_surname")), "_surname", "left"
    )
    exact = F.when(
        F.col("_t1_category").isNotNull(),
        _result(
            F.col("_t1_category"), F.when(F.col("_t1_is_ambiguous"), SURNAME_AMBIGUOUS).otherwise(SURNAME_CLEAR), 1
        ),
    )
    tiers, extra = [exact], ["_words", "_surname", "_t1_category", "_t1_is_ambiguous"]

    open_row = F.col("_t1_category").isNull()
    if fuzzy:
        source = names_from if names_from is not None else df
        surnames = (source if wanted is None else source.where(wanted)).select(last_token(F.col(name)).alias("token"))
        known = lexicons.surname_table(spark).select(F.col("surname").alias("token"))
        unresolved = surnames.distinct().join(F.broadcast(known), "token", "left_anti")
        near = stage(nearest_surnames(unresolved, lexicons), "nearest-surnames").select(
            F.col("token").alias("_surname"), F.col("category").alias("_t2_category")
        )
        rows = lookup(rows, near, ["_surname"])
        tiers.append(F.when(F.col("_t2_category").isNotNull(), _result(F.col("_t2_category"), SURNAME_FUZZY, 2)))
        extra.append("_t2_category")
        open_row = open_row & F.col("_t2_category").isNull()

    # Leftmost known token before the last one; a hit is found inside the row, without exploding it.
    vocabulary = ", ".join("'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'" for s in lexicons.surname_categories())
    hit = F.expr(f"get(filter(slice(_words, 1, greatest(size(_words) - 1, 0)), t -> t IN ({vocabulary})), 0)")
    rows = rows.withColumn("_t3_surname", F.when(open_row, hit)).join(
        F.broadcast(lexicons.surname_table(spark, "_t3_").drop("_t3_is_ambiguous")), "_t3_surname", "left"
    )
    tiers.append(F.when(F.col("_t3_category").isNotNull(), _result(F.col("_t3_category"), ANY_TOKEN, 3)))
    extra += ["_t3_surname", "_t3_category"]

    if district:
        belt = clean_val(F.col(district)).isin(*lexicons.districts) & F.col("_surname").isNotNull()
        tiers.append(F.when(belt, _result(lexicons.district_category, DISTRICT_PRIOR, 4)))
    return rows.withColumn(out, _labelled(F.coalesce(*tiers))).drop(*extra)


def with_category_single_tier(df: DataFrame, name: str, lexicons: Lexicons, out: str = "category_guess") -> DataFrame:
    """Exact surname only, one flat confidence."""
    table = lexicons.surname_table(df.sparkSession, "_s_").drop("_s_is_ambiguous")
    rows = df.withColumn("_s_surname", last_token(F.col(name))).join(F.broadcast(table), "_s_surname", "left")
    best = F.when(F.col("_s_category").isNotNull(), _result(F.col("_s_category"), SINGLE_TIER, 1))
    return rows.withColumn(out, _labelled(best)).drop("_s_surname", "_s_category")


def gender_resolution(gender: Column, guess: Column, min_confidence: int = 75) -> Column:
    """struct(value, confidence, method): what the gender cell becomes; null method means no logged change."""

    def decide(n: Column) -> Column:
        raw, norm, guessed = n["raw"], n["norm"], n["guess"]
        predicted = (guessed["value"] != "") & (guessed["confidence"] >= min_confidence) & (guessed["value"] != norm)
        standardised = norm.isin(*VALID_GENDERS) & (norm != raw)
        value = F.when(predicted, guessed["value"]).otherwise(norm)
        logged = (predicted | standardised) & (value != raw)
        return F.struct(
            F.when((value != "") & (value != raw), value).otherwise(n["cell"]).alias("value"),
            F.when(logged, F.when(predicted, guessed["confidence"]).otherwise(F.lit(NORMALISATION))).alias("confidence"),
            F.when(logged, F.when(predicted, "Name Analysis").otherwise("Normalisation")).alias("method"),
        )

    return let(_facts(gender, normalise_gender(gender), guess), decide)


def _facts(cell: Column, norm: Column, guess: Column) -> Column:
    return F.struct(
        cell.alias("cell"), F.coalesce(strip(cell), F.lit("")).alias("raw"), norm.alias("norm"), guess.alias("guess")
    )


def needs_category(category: Column) -> Column:
    return ~normalise_category(category).isin(*VALID_CATEGORIES)


def category_resolution(category: Column, guess: Column) -> Column:
    def decide(n: Column) -> Column:
        raw, norm, guessed = n["raw"], n["norm"], n["guess"]
        valid = norm.isin(*VALID_CATEGORIES)
        standardised = valid & (norm != raw)
        inferred = (
            ~valid
            & (guessed["value"] != "")
            & (guessed["confidence"] >= CATEGORY_MIN_CONFIDENCE)
            & (guessed["value"] != raw)
        )
        return F.struct(
            F.when(standardised, norm).when(inferred, guessed["value"]).otherwise(n["cell"]).alias("value"),
            F.when(standardised, F.lit(NORMALISATION)).when(inferred, guessed["confidence"]).alias("confidence"),
            F.when(standardised, "Normalisation").when(inferred, "Surname Heuristic").alias("method"),
        )

    return let(_facts(category, normalise_category(category), guess), decide)


CHANGE_COLUMNS = ("row_id", "name", "guardian", "field", "old_value", "new_value", "confidence", "method")


def change_rows(df: DataFrame, field: str, before: Column, resolution: Column, row_id: str, name: str, guardian: str | None) -> DataFrame:
    """Long-form log of the cells a resolution changed."""
    return df.where(resolution["method"].isNotNull()).select(
        F.col(row_id).alias("row_id"),
        F.col(name).alias("name"),
        (F.col(guardian) if guardian else F.lit(None).cast("string")).alias("guardian"),
        F.lit(field).alias("field"),
        clean_val(before).alias("old_value"),
        resolution["value"].alias("new_value"),
        resolution["confidence"].cast("int").alias("confidence"),
        resolution["method"].alias("method"),
    )


class GenderReview(NamedTuple):
    data: DataFrame
    corrections: DataFrame
    suggestions: DataFrame


def review_gender(
    df: DataFrame,
    name: str,
    gender: str,
    lexicons: Lexicons,
    row_id: str = "row_id",
    correct_at: int = 80,
    suggest_at: int = 60,
    library: DataFrame | None = None,
) -> GenderReview:
    """Correct confident mismatches, suggest the rest, and flag both."""
    rows = with_gender(df, name, lexicons, "_guess", library)
    current = clean_val(F.col(gender))
    guess = F.col("_guess")
    known = guess["value"] != ""
    mismatch = known & (current != "") & (guess["value"] != current)
    sure = guess["confidence"] >= correct_at
    flags = code_list(
        (current == "", "blank_gender"),
        (mismatch & sure, "strict_mismatch"),
        (mismatch & ~sure, "probable_mismatch"),
    )
    differs = known & (guess["value"] != current)
    marked = rows.withColumns(
        {
            "_current": current,
            "_first": extract_first(F.col(name)),
            "_action": F.when(differs & sure, "correct").when(differs & (guess["confidence"] >= suggest_at), "suggest"),
            "__REVIEW_FLAGS__": flags,
            "__REVIEW_ID__": review_id(F.col(row_id), F.col(name)),
        }
    )
    corrected = F.col("_action") == "correct"
    suggested = F.col("_action") == "suggest"
    data = marked.withColumns(
        {
            gender: F.when(corrected, guess["value"]).otherwise(F.col(gender)),
            "__SUGGESTED_GENDER__": F.when(suggested, guess["value"]).otherwise(F.lit("")),
        }
    ).drop("_guess", "_current", "_first", "_action")
    shared = [
        F.col(row_id).alias("row_id"),
        F.col(name).alias("name"),
        F.col("_first").alias("first_name"),
        F.col("_current").alias("current_gender"),
        guess["value"].alias("gender"),
        guess["confidence"].alias("confidence"),
        F.concat(F.lit("Tier "), guess["tier"].cast("string"), F.lit(": "), guess["label"]).alias("method"),
        F.col("__REVIEW_FLAGS__").alias("review_flags"),
    ]
    return GenderReview(
        data,
        marked.where(corrected).select(*shared),
        marked.where(suggested).select(*shared, F.col("__REVIEW_ID__").alias("review_id")),
    )


