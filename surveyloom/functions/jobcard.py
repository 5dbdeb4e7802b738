"""Job-card numbers of the form MH-DD-BBB-GGG-NNN/NNNNNN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom.functions.text import let, strip

# The canonical card and its prefix up to the household number.
CARD_FORMAT = "MH-DD-BBB-GGG-NNN/NNNNNN"
_HOUSEHOLD = r"MH-[0-9]{2}-[0-9]{3}-[0-9]{3}-[0-9]{3}"
_CANONICAL = "^" + _HOUSEHOLD + r"/[0-9]{6}$"
_MEMBER = "^(" + _HOUSEHOLD + r")([-/])([0-9]{1,6})$"


def _repair(card: Column) -> Column:
    """struct(fixed, how); both null when no repair applies."""
    digits = F.regexp_replace(card, "[^0-9]", "")
    tight = F.regexp_replace(F.regexp_replace(card, r"\s*-\s*", "-"), r"\s*/\s*", "/")

    def repair(value: Column, how: Column | str) -> Column:
        return F.struct(value.alias("fixed"), (F.lit(how) if isinstance(how, str) else how).alias("how"))

    rebuilt = F.regexp_replace(digits, r"^(.{2})(.{3})(.{3})(.{3})(.{6})$", r"MH-$1-$2-$3-$4/$5")
    padded = F.concat(
        F.regexp_extract(card, _MEMBER, 1), F.lit("/"), F.lpad(F.regexp_extract(card, _MEMBER, 3), 6, "0")
    )
    separator = F.when(F.regexp_extract(card, _MEMBER, 2) == "-", "dash_to_slash").otherwise("zero_padded")
    return (
        F.when(~card.rlike("[A-Z]") & (F.length(digits) == 17), repair(rebuilt, "separators_inserted"))
        .when(card.rlike(_MEMBER), repair(padded, separator))
        .when(tight.rlike(_CANONICAL), repair(tight, "spaces_removed"))
    )


def diagnose(card: Column) -> Column:
    """First segment of an upper-cased card that breaks the format."""
    parts = F.split(card, "-")
    last = parts.getItem(4)
    household = F.split(last, "/", 2).getItem(0)
    member = F.split(last, "/", 2).getItem(1)

    def segment(index: int, size: int, label: str) -> tuple[Column, str]:
        return ~parts.getItem(index).rlike("^[0-9]{%d}$" % size), label

    chain = F.when(~card.startswith("MH"), "state_code").when(F.size(parts) != 5, "part_count")
    for condition, label in (segment(1, 2, "district"), segment(2, 3, "block"), segment(3, 3, "village")):
        chain = chain.when(condition, label)
    return (
        chain.when(~last.contains("/"), "member_separator")
        .when(~household.rlike("^[0-9]{3}$"), "household")
        .when(~member.rlike("^[0-9]{6}$"), "member")
        .otherwise("format")
    )


def validate_card(c: Column) -> Column:
    """struct(original, corrected, is_valid, was_changed, reason); a blank card is allowed."""

    def judged(original: Column) -> Column:
        card = F.upper(original)

        def outcome(corrected: Column, valid: bool, reason: Column | str) -> Column:
            return F.struct(
                original.alias("original"),
                corrected.alias("corrected"),
                F.lit(valid).alias("is_valid"),
                (F.lit(valid) & (corrected != original)).alias("was_changed"),
                (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
            )

        repaired = let(
            _repair(card),
            lambda r: F.when(r.isNotNull(), outcome(r["fixed"], True, r["how"])).otherwise(
                outcome(original, False, diagnose(card))
            ),
        )
        return (
            F.when(original == "", outcome(original, True, "blank"))
            .when(card.rlike(_CANONICAL), outcome(card, True, F.when(card == original, "valid").otherwise("uppercased")))
            .otherwise(repaired)
        )

    return let(F.coalesce(strip(c), F.lit("")), judged)


def check_card(c: Column) -> Column:
    """Quick check without repair: struct(is_valid, issue_type)."""
    card = F.upper(strip(c))
    issue = (
        F.when(c.isNull() | (c == ""), F.lit(None))
        .when(card.rlike(_CANONICAL), F.lit(None))
        .when(~card.startswith("MH"), "wrong_state")
        .otherwise("wrong_format")
    )
    return F.struct(issue.isNull().alias("is_valid"), issue.alias("issue_type"))
