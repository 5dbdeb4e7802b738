"""Ten-digit mobile numbers: repair and validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom.functions.text import let, strip

_MOBILE = "^[6-9]"
_SCIENTIFIC = r"^[0-9](\.[0-9]+)?[eE]\+?[0-9]{1,2}$"


def _plain_digits(text: Column) -> Column:
    """Numbers that went through a spreadsheet: drop '.0', expand 9.87654321e9."""
    expanded = text.try_cast("decimal(38,0)").cast("string")
    return F.when(text.rlike(_SCIENTIFIC), F.coalesce(expanded, text)).otherwise(
        F.regexp_replace(text, r"^([0-9]+)\.0+$", "$1")
    )


def clean_mobile(c: Column) -> Column:
    """Digits only, the last ten of them."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits)


def validate_contact(c: Column, quick: bool = False) -> Column:
    """struct(original, corrected, is_valid, was_changed, reason).

    The full variant accepts one separator after the country prefix and, of more than
    ten digits, prefers the first ten; the quick variant prefers the last ten.
    """
    separator = "" if quick else r"[\s\-]?"

    def digits_of(raw: Column) -> Column:
        body = _plain_digits(raw)
        for prefix in (r"^\+91" + separator, "^91" + separator, "^0+"):
            body = F.regexp_replace(body, prefix, "")
        return F.regexp_replace(body, "[^0-9]", "")

    def judged(n: Column) -> Column:
        digits, size = n["digits"], F.length(n["digits"])
        head, tail = F.substring(digits, 1, 10), F.substring(digits, -10, 10)
        windows = [(tail, "last_10"), (head, "first_10")] if quick else [(head, "first_10"), (tail, "last_10")]
        reason = (
            F.when(n["raw"] == "", "blank")
            .when(size == 0, "no_digits")
            .when(size < 10, "too_short")
            .when(size == 10, F.when(digits.rlike(_MOBILE), "valid").otherwise("bad_start"))
            .when(windows[0][0].rlike(_MOBILE), windows[0][1])
            .when(windows[1][0].rlike(_MOBILE), windows[1][1])
            .otherwise("too_long")
        )
        return F.struct(n["raw"].alias("raw"), digits.alias("digits"), reason.alias("reason"))

    def result(n: Column) -> Column:
        corrected = (
            F.when(n["reason"] == "first_10", F.substring(n["digits"], 1, 10))
            .when(n["reason"] == "last_10", F.substring(n["digits"], -10, 10))
            .otherwise(n["digits"])
        )
        valid = n["reason"].isin("valid", "first_10", "last_10")
        return F.struct(
            n["raw"].alias("original"),
            corrected.alias("corrected"),
            valid.alias("is_valid"),
            (valid & (corrected != n["raw"])).alias("was_changed"),
            n["reason"].alias("reason"),
        )

    cleaned = let(F.coalesce(strip(c), F.lit("")), lambda raw: F.struct(raw.alias("raw"), digits_of(raw).alias("digits")))
    return let(let(cleaned, judged), result)
