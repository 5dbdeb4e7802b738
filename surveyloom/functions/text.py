"""Column builders for text: whitespace, tokens, proper case, phonetic keys, personal-data patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters treated as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACES = "[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"

# Name particles that stay in lower case unless they open the name.
LOWERCASE_PARTICLES = (
    "van", "von", "de", "da", "di", "del", "della", "des",
    "den", "der", "el", "al", "bin", "binti", "ap", "du",
)

# Ordered rewrites that reduce a token to its phonetic key.
PHONETIC_REWRITES = (
    ("ee", "i"),
    ("oo", "u"),
    ("ae$", "ai"),
    ("ey$", "ay"),
    ("er$", "ar"),
    ("or$", "ar"),
    ("kh", "k"),
    ("gh", "g"),
    ("aa", "a"),
    ("sh", "s"),
    (r"\bv", "w"),
    ("[aeiou]+$", ""),
)

# Personal-data patterns.
PII_PATTERNS = {
    "aadhaar": r"\b[0-9]{12}\b",
    "mobile": r"\b[6-9][0-9]{9}\b",
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "bank_account": r"\b[0-9]{9,18}\b",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clean_val(c: Column) -> Column:
    """Null becomes '', otherwise stripped lower case."""
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def squeeze(c: Column) -> Column:
    """Strip and collapse every run of white space to one space, which leaves plain spaces alone to be trimmed."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def tokens(c: Column) -> Column:
    """White-space separated tokens; blank gives an empty array."""
    text = squeeze(F.coalesce(c, F.lit("")))
    return F.filter(F.split(text, " "), lambda t: t != "")


def first_token(c: Column) -> Column:
    return F.split(squeeze(clean_val(c)), " ").getItem(0)


def last_token(c: Column) -> Column:
    return F.element_at(F.split(squeeze(clean_val(c)), " "), -1)


def extract_first(c: Column) -> Column:
    """Lower-case first token without edge punctuation; '' unless three or more plain letters."""
    token = F.btrim(first_token(c), F.lit(".,;:-'\""))
    return F.when(token.rlike("^[a-z]{3,}$"), token).otherwise(F.lit(""))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def _prefixed(word: Column, prefix: str, size: int) -> Column:
    return F.concat(
        F.lit(prefix),
        F.upper(F.substring(word, size + 1, 1)),
        F.lower(F.substr(word, F.lit(size + 2))),
    )


def _scottish(word: Column, letters_only: bool) -> Column:
    """Capitalise one segment, giving Mc/Mac names their second capital."""
    low = F.lower(word)
    mac = low.startswith("mac") & (F.length(word) > 3)
    if letters_only:
        mac = mac & F.substring(word, 4, 1).rlike(r"^\p{L}$")
    return (
        F.when(low.startswith("mc") & (F.length(word) > 2), _prefixed(word, "Mc", 2))
        .when(mac, _prefixed(word, "Mac", 3))
        .otherwise(capitalize(word))
    )


def _segment(word: Column, opens_name: Column) -> Column:
    low = F.lower(word)
    return F.when(~opens_name & low.isin(*LOWERCASE_PARTICLES), low).otherwise(_scottish(word, letters_only=True))


def _full_word(word: Column, index: Column) -> Column:
    opens = index == 0
    hyphenated = F.array_join(
        F.transform(F.split(word, "-"), lambda p, j: _segment(p, opens & (j == 0))), "-"
    )
    with_apostrophe = F.array_join(F.transform(F.split(word, "'"), capitalize), "'")
    return (
        F.when(word.contains("-"), hyphenated)
        .when(word.contains("'"), with_apostrophe)
        .otherwise(_segment(word, opens))
    )


def _quick_word(word: Column) -> Column:
    def plain(p: Column) -> Column:
        return F.array_join(F.transform(F.split(p, "'"), lambda q: _scottish(q, letters_only=False)), "'")

    joined = word.contains("-") | word.contains("'")
    return F.when(joined, F.array_join(F.transform(F.split(word, "-"), plain), "-")).otherwise(_scottish(word, letters_only=False))


def proper_case(c: Column, quick: bool = False) -> Column:
    """Proper case for personal names; the quick variant knows no particles."""
    words = F.split(squeeze(c), " ")
    cased = F.transform(words, _quick_word) if quick else F.transform(words, _full_word)
    return F.array_join(cased, " ")


def name_format(c: Column, quick: bool = False) -> Column:
    """struct(original, formatted, was_changed); null and blank give ''."""
    original = F.coalesce(strip(c), F.lit(""))
    formatted = F.when(original == "", F.lit("")).otherwise(proper_case(c, quick))
    return let(
        F.struct(original.alias("original"), formatted.alias("formatted")),
        lambda n: F.struct(
            n["original"].alias("original"),
            n["formatted"].alias("formatted"),
            (n["formatted"] != n["original"]).alias("was_changed"),
        ),
    )


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def is_lower(c: Column) -> Column:
    return (c == F.lower(c)) & (c != F.upper(c))


def change_type(c: Column) -> Column:
    """Which kind of repair a stripped name needs; the first that applies."""
    s = strip(c)
    return (
        F.when(is_upper(s), "uppercase_fixed")
        .when(is_lower(s), "lowercase_fixed")
        .when(s.contains("  "), "whitespace_fixed")
        .when(s.contains("'"), "apostrophe_fixed")
        .when(s.contains("-"), "hyphen_fixed")
        .otherwise("mixed_case_fixed")
    )


def title_case(c: Column) -> Column:
    """Capital after every character that is not a cased letter."""
    parts = F.split(strip(c), r"(?<=[^\p{Lu}\p{Ll}\p{Lt}])")
    return F.array_join(F.transform(parts, capitalize), "")


def phonetic_key(c: Column) -> Column:
    key = F.lower(c)
    for pattern, replacement in PHONETIC_REWRITES:
        key = F.regexp_replace(key, pattern, replacement)
    return key


def contains_pii(c: Column, kind: str, anchored: bool = False) -> Column:
    pattern = PII_PATTERNS[kind]
    return c.rlike("^" + pattern if anchored else pattern)


def pii_hits(c: Column, kind: str) -> Column:
    return F.regexp_count(c, F.lit(PII_PATTERNS[kind]))
