"""Unit tables of the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from surveyloom.functions import codes, jobcard, numeric, phone, temporal, text
from surveyloom.operators import cells


def apply(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_proper_case(spark):
    cases = {
        None: "",
        "": "",
        "Vitthal More": "Vitthal More",
        "VITTHAL more": "Vitthal More",
        "anne-lise roy": "Anne-Lise Roy",
        "l'amour": "L'Amour",
        "mckay": "McKay",
        "maclean  roy": "MacLean Roy",
        "mac3x mac": "Mac3x Mac",
        "eva von der leyde": "Eva von der Leyde",
        "von de-la x": "Von de-La X",
    }
    out = apply(spark, list(cases), text.name_format)
    assert [r["formatted"] for r in out] == list(cases.values())
    assert [r["was_changed"] for r in out] == [k not in (None, "", "Vitthal More") and v != k for k, v in cases.items()]


def test_proper_case_quick(spark):
    cases = {"  two   gaps ": "Two Gaps", "eva von der leyde": "Eva Von Der Leyde", "mac3x": "Mac3x", "l'mckay-de": "L'McKay-De", "anne-lise roy": "Anne-Lise Roy"}
    out = apply(spark, list(cases), lambda c: text.name_format(c, quick=True))
    assert [r["formatted"] for r in out] == list(cases.values())


def test_title_case_matches_python(spark):
    values = ["o'connor", "ram2dev kumar", "éric lévy", "a-b c", "X"]
    assert apply(spark, values, text.title_case) == [v.title() for v in values]


def test_whitespace_matches_python(spark):
    values = [" a b　", "\ta\n b \r", "\x1ca\x1fb", "plain"]
    assert apply(spark, values, text.squeeze) == [" ".join(v.split()) for v in values]
    assert apply(spark, values, text.strip) == [v.strip() for v in values]


def test_tokens(spark):
    values = ["  Sunita  Bai Patil ", "", None, "A. Kumar", "Ram2 x", "'Asha', y"]
    assert apply(spark, values, text.first_token) == ["sunita", "", "", "a.", "ram2", "'asha',"]
    assert apply(spark, values, text.last_token) == ["patil", "", "", "kumar", "x", "y"]
    assert apply(spark, values, text.extract_first) == ["sunita", "", "", "", "", "asha"]
    assert apply(spark, values, text.tokens) == [["Sunita", "Bai", "Patil"], [], [], ["A.", "Kumar"], ["Ram2", "x"], ["'Asha',", "y"]]


# one input per branch of the rule: (raw, corrected, valid, changed)
CONTACT_CASES = [
    (None, "", False, False),
    ("no phone", "", False, False),
    ("7012456093", "7012456093", True, False),
    ("(701) 245-6093", "7012456093", True, True),
    ("007012456093", "7012456093", True, True),
    ("+917012456093", "7012456093", True, True),
    ("7012456093.0", "7012456093", True, True),
    ("7.012456093E9", "7012456093", True, True),
    ("2012456093", "2012456093", False, False),
    ("70124", "70124", False, False),
    ("33007012456093", "7012456093", True, True),
]


def test_contact(spark):
    out = apply(spark, [c[0] for c in CONTACT_CASES], phone.validate_contact)
    assert [(r["corrected"], r["is_valid"], r["was_changed"]) for r in out] == [c[1:] for c in CONTACT_CASES]


def test_contact_quick(spark):
    cases = {
        "": ("", False), "7012456093": ("7012456093", True), "701-245-6093": ("7012456093", True), "+91 70124 56093": ("7012456093", True),
        "07012456093": ("7012456093", True), "1012456093": ("1012456093", False), "701245": ("701245", False), "37012456093": ("7012456093", True),
    }
    out = apply(spark, list(cases), lambda c: phone.validate_contact(c, quick=True))
    assert [(r["corrected"], r["is_valid"]) for r in out] == list(cases.values())


# one input per branch of the rule: (raw, corrected, valid, reason)
CARD_CASES = [
    (None, None, True, "blank"),
    ("MH-31-114-062-009/000387", None, True, "valid"),
    ("Mh-31-114-062-009/000387", "MH-31-114-062-009/000387", True, "uppercased"),
    ("MH-31-114-062-009-000387", "MH-31-114-062-009/000387", True, "dash_to_slash"),
    (" MH-31 -114-062-009/000387", "MH-31-114-062-009/000387", True, "spaces_removed"),
    ("31114062009000387", "MH-31-114-062-009/000387", True, "separators_inserted"),
    ("MH-31-114-062-009/387", "MH-31-114-062-009/000387", True, "zero_padded"),
    ("KA-31-114-062-009/000387", None, False, "state_code"),
    ("MH-311-114-062-009/000387", None, False, "district"),
    ("MH-31-1140-062-009/000387", None, False, "block"),
    ("MH-31-114-06-009/000387", None, False, "village"),
    ("MH-31-114-062-009-1/000387", None, False, "part_count"),
    ("MH-31-114-062-009", None, False, "member_separator"),
    ("MH-31-114-062-09/000387", None, False, "household"),
    ("MH-31-114-062-009/3870000", None, False, "member"),
]


def test_job_card(spark):
    out = apply(spark, [c[0] for c in CARD_CASES], jobcard.validate_card)
    assert [(r["corrected"], r["is_valid"], r["reason"]) for r in out] == [(c[0] or '' if c[1] is None else c[1], *c[2:]) for c in CARD_CASES]


def test_job_card_quick(spark):
    values = ["MH-31-114-062-009/000387", "KA-31-114-062-009/000387", "MH-3-114-062-009/000387", "", None]
    out = apply(spark, values, jobcard.check_card)
    assert [r["issue_type"] for r in out] == [None, "wrong_state", "wrong_format", None, None]


@pytest.mark.parametrize(
    "value, month_first, day_first",
    [
        ("2024-01-15", (2024, 1, 15), (2024, 1, 15)),
        ("2024-1-5 10:30:00", (2024, 1, 5), (2024, 1, 5)),
        ("15/01/2024", (2024, 1, 15), (2024, 1, 15)),
        ("05/01/2024", (2024, 5, 1), (2024, 1, 5)),
        ("05-01-2024", (2024, 5, 1), (2024, 1, 5)),
        ("3 Feb 2024", (2024, 2, 3), (2024, 2, 3)),
        ("feb 3, 2024", (2024, 2, 3), (2024, 2, 3)),
        ("2024", (2024, 1, 1), (2024, 1, 1)),
        ("9 September 2023", (2023, 9, 9), (2023, 9, 9)),
        ("May 4, 2023 11:05 PM", (2023, 5, 4), (2023, 5, 4)),
        ("20230504", (2023, 5, 4), (2023, 5, 4)),
        ("19/11/23", (2023, 11, 19), (2023, 11, 19)),
        ("03/04/99", (1999, 3, 4), (1999, 4, 3)),
        ("May 4, 2023 13:05 PM", None, None),
        ("31/31/2024", None, None),
        ("12:30", None, None),
        ("invalid", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_parse_date(spark, value, month_first, day_first):
    for flag, expected in ((False, month_first), (True, day_first)):
        (out,) = apply(spark, [value], lambda c: temporal.parse_date(c, day_first=flag))
        assert (out and (out.year, out.month, out.day)) == expected


def test_clock_times(spark):
    out = apply(spark, ["May 4, 2023 11:05:09 PM", "04/05/2023 12:30 am", "4 June 2023 07:15"], temporal.parse_date)
    assert [str(t) for t in out] == ["2023-05-04 23:05:09", "2023-04-05 00:30:00", "2023-06-04 07:15:00"]


def test_date_age_land_issues(spark):
    as_of = F.lit(datetime.datetime(2026, 1, 1))
    assert apply(spark, ["2024-01-15", "2030-01-15", "invalid", None], lambda c: temporal.date_issue(c, as_of)) == [
        None, "future_date", "invalid_format", None,
    ]
    assert apply(spark, ["25", "15", "105", "abc", None, "1d"], numeric.age_issue) == [
        None, "below_min", "above_max", "invalid_format", None, "invalid_format",
    ]
    assert apply(spark, ["5.5", "-2", "0", "1500", "abc", None, "0.005", " 1e2 "], numeric.land_issue) == [
        None, "negative", "zero", "too_large", "non_numeric", None, "too_small", None,
    ]


def test_code_spellings(spark):
    assert apply(spark, ["M", "FEMALE", "Other", "other", " Male ", None, "x"], codes.normalise_gender) == [
        "male", "female", "other", "others", "male", "", "x",
    ]
    assert apply(spark, ["OBC", "General", "gENERAL", "Sbc", None], codes.normalise_category) == ["obc", "gen", "general", "sbc", ""]


def test_cell_cleaning_is_idempotent(spark):
    df = spark.createDataFrame([(1, "  A  B "), (2, None), (3, " "), (4, "plain"), (5, "ALL CAPS")], "row_id int, v string")
    once = cells.clean_columns(df, ["v"])
    assert [r["v"] for r in once.orderBy("row_id").collect()] == ["a b", "", "", "plain", "all caps"]
    assert cells.clean_columns(once, ["v"]).exceptAll(once).count() == 0
    stats = cells.cleaning_stats(cells.cleaned_cells(df, "row_id", ["v"])).first()
    assert (stats["cells_cleaned"], stats["null_values_found"], stats["whitespace_fixed"], stats["case_normalized"]) == (4, 2, 1, 2)


def test_repairs_are_idempotent(spark):
    contacts = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CONTACT_CASES)], "row_id int, v string")
    once = cells.correct_contacts(contacts, "v").data
    assert cells.correct_contacts(once, "v").corrections.count() == 0
    cards = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CARD_CASES)], "row_id int, v string")
    assert cells.correct_cards(cells.correct_cards(cards, "v").data, "v").corrections.count() == 0


def test_cells_are_cleaned_in_one_pass(spark):
    """Blank and squeezed are told by one rewrite of the cell; each was once a trim of its own by a set of 29 characters."""
    values = [None, "", " ", "\u3000\x1f", "a", " a", "a\u00a0\u2009b ", "a b", "\ta  b\n", "o'c-d"]
    build = lambda c: cells.clean_cell(c, ("trim", "handle_nulls"))
    got = [(r["cleaned"], r["null_handled"], r["trimmed"]) for r in apply(spark, values, build)]
    words = [" ".join((v or "").split()) for v in values]
    assert got == [(w, w == "", w != "" and w != v) for v, w in zip(values, words)]
    plan = spark.createDataFrame([("a",)], "v string").repartition(1).select(build(F.col("v"))["cleaned"].alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("regexp_replace("), plan.count("btrim(")) == (1, 0), plan
    assert apply(spark, ["MCKAY o'MACx", "a-mcb", "mac"], lambda c: text.proper_case(c, quick=True)) == ["McKay O'MacX", "A-McB", "Mac"]
