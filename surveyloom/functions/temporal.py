"""Lenient date parsing without failing casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom.functions.text import let, strip

_ISO = r"^[0-9]{4}([-/][0-9]{1,2}([-/][0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}.*)?)?)?$"
_PARTS = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})(.*)$"
_SHORT_YEAR = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2})$"
_COMPACT = r"^[0-9]{8}$"
_DAY_NAME = r"^[0-9]{1,2}[- ][A-Za-z]{3}[- ,] ?[0-9]{4}$"
_NAME_DAY = r"^[A-Za-z]{3} [0-9]{1,2},? [0-9]{4}$"
_MONTHS = r"(?i)\b(?:(Jan)uary|(Feb)ruary|(Mar)ch|(Apr)il|(Jun)e|(Jul)y|(Aug)ust|(Sep)t(?:ember)?|(Oct)ober|(Nov)ember|(Dec)ember)\b"
_CLOCK = r"^(.*[0-9A-Za-z])[ ,]+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))? ?([AaPp])[Mm]$|^(.*[A-Za-z].*[0-9]{4}),? ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?$"


def _date_part(text: Column, day_first: bool) -> Column:
    iso = F.regexp_replace(text, "/", "-").try_cast("timestamp")
    named = F.initcap(F.regexp_replace(F.regexp_replace(text, "[-,]", " "), " +", " "))

    def numbers(pattern: str, year: str) -> Column:
        month_day = F.regexp_replace(text, pattern, f"{year}-$1-$2$4").try_cast("timestamp")
        day_month = F.regexp_replace(text, pattern, f"{year}-$2-$1$4").try_cast("timestamp")
        return F.coalesce(day_month, month_day) if day_first else F.coalesce(month_day, day_month)

    # two digits of a year are of the century that puts them before 2069
    short = text.rlike("[0-6][0-9]$")
    short_year = F.when(short, numbers(_SHORT_YEAR[:-1] + "()$", "20$3")).otherwise(numbers(_SHORT_YEAR[:-1] + "()$", "19$3"))
    return (
        F.when(text.rlike(_ISO), iso)
        .when(text.rlike(_PARTS), numbers(_PARTS, "$3"))
        .when(text.rlike(_SHORT_YEAR), short_year)
        .when(text.rlike(_COMPACT), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        .when(text.rlike(_DAY_NAME), F.try_to_timestamp(named, F.lit("d MMM yyyy")))
        .when(text.rlike(_NAME_DAY), F.try_to_timestamp(named, F.lit("MMM d yyyy")))
    )


def parse_date(c: Column, day_first: bool = False) -> Column:
    """Timestamp or null.

    The shape decides the format, so no parse attempt fails with an exception inside
    the task. Year-first text is read as such; of two leading numbers the month (or,
    with ``day_first``, the day) is tried first and the other order second. Month names may be
    whole or cut to three letters; a time may be of 12 or 24 hours.
    """

    def part(text: Column, *groups: int) -> Column:
        return F.concat(*[F.coalesce(F.regexp_extract(text, _CLOCK, g), F.lit("")) for g in groups])

    def timed(text: Column) -> Column:
        hour, letter = part(text, 2, 7).try_cast("int"), F.lower(part(text, 5))
        hours = F.when(letter == "", hour).when(hour.between(1, 12), hour % 12 + F.when(letter == "p", 12).otherwise(0))
        minutes, seconds = part(text, 3, 8).try_cast("int"), F.coalesce(part(text, 4, 9).try_cast("int"), F.lit(0))
        valid = (hours < 24) & (minutes < 60) & (seconds < 60)
        day = let(part(text, 1, 6), lambda d: _date_part(d, day_first))
        return F.when(valid, F.timestamp_seconds(F.unix_timestamp(day) + hours * 3600 + minutes * 60 + seconds))

    text = F.regexp_replace(strip(c), _MONTHS, "$1$2$3$4$5$6$7$8$9$10$11")
    return let(text, lambda t: F.when(t.rlike(_CLOCK), timed(t)).otherwise(_date_part(t, day_first)))


def format_ddmmyyyy(c: Column) -> Column:
    return F.date_format(parse_date(c), "dd/MM/yyyy")


def date_issue(c: Column, as_of: Column) -> Column:
    """'invalid_format', 'future_date' or null; missing dates are accepted."""
    return let(
        parse_date(c),
        lambda ts: F.when(c.isNull(), F.lit(None)).when(ts.isNull(), "invalid_format").when(ts > as_of, "future_date"),
    )
