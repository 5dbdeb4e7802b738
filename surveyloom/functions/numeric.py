"""Numeric text: safe parsing, land-area and age checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom.functions.text import let, strip

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_float(c: Column) -> Column:
    """Number or null; never fails, also with ANSI casts on."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def land_issue(c: Column, min_area: float = 0.01, max_area: float = 1000.0) -> Column:
    """Issue type of a land area, null when it is valid or missing."""
    return let(
        to_float(c),
        lambda area: F.when(c.isNull(), F.lit(None))
        .when(area.isNull(), "non_numeric")
        .when(area < 0, "negative")
        .when(area == 0, "zero")
        .when(area < min_area, "too_small")
        .when(area > max_area, "too_large"),
    )


def age_issue(c: Column, min_age: float = 18, max_age: float = 100) -> Column:
    return let(
        to_float(c),
        lambda age: F.when(c.isNull(), F.lit(None))
        .when(age.isNull(), "invalid_format")
        .when(age < min_age, "below_min")
        .when(age > max_age, "above_max"),
    )
