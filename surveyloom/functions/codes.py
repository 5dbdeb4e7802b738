"""Coded attributes, labels and keys derived from other columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom.functions.text import clean_val, extract_first, strip

# Placeholder keys, valid codes, accepted spellings (case matters) and export labels.
PLACEHOLDER_KEYS = ("v1", "version 1", "version1", "test", "null", "none", "na", "n/a", "")
VALID_GENDERS = ("male", "female", "others")
VALID_CATEGORIES = ("obc", "st", "sc", "gen", "sbc", "pvtg")
GENDER_SPELLINGS = {
    "male": ("male", "m", "Male", "MALE", "M"),
    "female": ("female", "f", "Female", "FEMALE", "F"),
    "others": ("others", "other", "Others"),
}
CATEGORY_SPELLINGS = {
    "obc": ("obc", "OBC", "Obc"),
    "st": ("st", "ST", "St"),
    "sc": ("sc", "SC", "Sc"),
    "gen": ("gen", "GEN", "general", "General", "GENERAL"),
    "sbc": ("sbc", "SBC"),
    "pvtg": ("pvtg", "PVTG"),
}
EXPORT_GENDER_LABELS = {
    "m": "Male", "male": "Male", "f": "Female", "female": "Female",
    "t": "Transgender", "transgender": "Transgender", "other": "Other",
}
EXPORT_CATEGORY_LABELS = {
    "sc": "SC", "st": "ST", "obc": "OBC", "general": "General",
    "gen": "General", "nt": "NT", "sbc": "SBC",
}


def is_placeholder_key(c: Column) -> Column:
    return clean_val(c).isin(*PLACEHOLDER_KEYS)


def _by_spelling(c: Column, spellings: dict[str, tuple[str, ...]]) -> Column:
    raw = F.coalesce(strip(c), F.lit(""))
    (code, accepted), *rest = spellings.items()
    chain = F.when(raw.isin(*accepted), code)
    for code, accepted in rest:
        chain = chain.when(raw.isin(*accepted), code)
    return chain.otherwise(F.lower(raw))


def normalise_gender(c: Column) -> Column:
    return _by_spelling(c, GENDER_SPELLINGS)


def normalise_category(c: Column) -> Column:
    return _by_spelling(c, CATEGORY_SPELLINGS)


def _label(c: Column, labels: dict[str, str]) -> Column:
    low = F.lower(strip(c))
    (code, label), *rest = labels.items()
    chain = F.when(low == code, label)
    for code, label in rest:
        chain = chain.when(low == code, label)
    return chain.otherwise(c)


def export_gender(c: Column) -> Column:
    return _label(c, EXPORT_GENDER_LABELS)


def export_category(c: Column) -> Column:
    return _label(c, EXPORT_CATEGORY_LABELS)


def surrogate_key(name: Column, village: Column, date: Column) -> Column:
    def slug(c: Column) -> Column:
        return F.replace(clean_val(c), F.lit(" "), F.lit("_"))

    return F.concat(
        F.lit("SURR_"), slug(name), F.lit("__"), slug(village), F.lit("__"), F.left(slug(date), F.lit(10))
    )


def confidence_label(c: Column) -> Column:
    return F.when(c >= 90, "High").when(c >= 75, "Medium").when(c >= 60, "Low").otherwise("Undetermined")


def confidence_band(c: Column) -> Column:
    return (
        F.when(c.isNull(), "white").when(c >= 90, "green").when(c >= 75, "yellow").when(c >= 60, "orange").otherwise("red")
    )


def review_id(row_id: Column, name: Column) -> Column:
    first = extract_first(name)
    return F.when(first == "", "").otherwise(
        F.concat(F.lit("GREV-"), (row_id + 2).cast("string"), F.lit("-"), first)
    )


def code_list(*flags: tuple[Column, str]) -> Column:
    """Comma-separated codes of the conditions that hold."""
    return F.array_join(F.array(*[F.when(cond, code) for cond, code in flags]), ", ")
