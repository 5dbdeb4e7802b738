"""Reference results in DuckDB SQL: expressions and common table expressions.

These are written from the rules, not from the Spark code: regular SQL over whole
tables, including a recursive form of the sequence ratio.
"""

from __future__ import annotations

from surveyloom.functions.codes import PLACEHOLDER_KEYS
from surveyloom.functions.text import LOWERCASE_PARTICLES, PHONETIC_REWRITES
from surveyloom.operators.lexicons import (
    QUICK_FEMALE_NAMES,
    QUICK_FEMALE_SUFFIXES,
    QUICK_MALE_NAMES,
    QUICK_MALE_SUFFIXES,
    Lexicons,
)

LEX = Lexicons()


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def values(rows, columns: str) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        return q(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({columns}))"


# ---- scalar expressions --------------------------------------------------------------------


def clean(x: str) -> str:
    return f"coalesce(lower(trim({x})), '')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR trim({x}) = '')"


def squeeze(x: str) -> str:
    return rf"regexp_replace(trim({x}), '\s+', ' ', 'g')"


def first(x: str) -> str:
    return f"split_part({squeeze(clean(x))}, ' ', 1)"


def last(x: str) -> str:
    return f"list_extract(string_split({squeeze(clean(x))}, ' '), -1)"


def words(x: str) -> str:
    return f"list_filter(string_split({squeeze(clean(x))}, ' '), lambda t: t <> '')"


def extract_first(x: str) -> str:
    token = f"trim({first(x)}, '.,;:-''\"')"
    return f"CASE WHEN regexp_full_match({token}, '[a-z]{{3,}}') THEN {token} ELSE '' END"


def placeholder(x: str) -> str:
    return f"{clean(x)} IN {in_list(PLACEHOLDER_KEYS)}"


def cap(x: str) -> str:
    return f"upper(substr({x}, 1, 1)) || lower(substr({x}, 2))"


def _mc(p: str, letters_only: bool) -> str:
    mac = "^mac[a-z]" if letters_only else "^mac."
    return (
        f"WHEN regexp_matches(lower({p}), '^mc.') THEN 'Mc' || upper(substr({p}, 3, 1)) || lower(substr({p}, 4)) "
        f"WHEN regexp_matches(lower({p}), '{mac}') THEN 'Mac' || upper(substr({p}, 4, 1)) || lower(substr({p}, 5)) "
        f"ELSE {cap(p)}"
    )


def proper(x: str) -> str:
    def seg(p: str, opens: str) -> str:
        return f"CASE WHEN NOT ({opens}) AND lower({p}) IN {in_list(LOWERCASE_PARTICLES)} THEN lower({p}) {_mc(p, True)} END"

    hyphen = f"array_to_string(list_transform(string_split(w, '-'), lambda p, j: {seg('p', 'i = 1 AND j = 1')}), '-')"
    apostrophe = f"array_to_string(list_transform(string_split(w, ''''), lambda p: {cap('p')}), '''')"
    return (
        f"array_to_string(list_transform(string_split({squeeze(x)}, ' '), lambda w, i: CASE WHEN contains(w, '-') THEN {hyphen} "
        f"WHEN contains(w, '''') THEN {apostrophe} ELSE {seg('w', 'i = 1')} END), ' ')"
    )


def proper_quick(x: str) -> str:
    part = f"array_to_string(list_transform(string_split(h, ''''), lambda p: CASE {_mc('p', False)} END), '''')"
    return (
        f"array_to_string(list_transform(string_split({squeeze(x)}, ' '), lambda w: "
        f"array_to_string(list_transform(string_split(w, '-'), lambda h: {part}), '-')), ' ')"
    )


def change_type(x: str) -> str:
    s = f"trim({x})"
    return (
        f"CASE WHEN {s} = upper({s}) AND {s} <> lower({s}) THEN 'uppercase_fixed' "
        f"WHEN {s} = lower({s}) AND {s} <> upper({s}) THEN 'lowercase_fixed' "
        f"WHEN contains({s}, '  ') THEN 'whitespace_fixed' WHEN contains({s}, '''') THEN 'apostrophe_fixed' "
        f"WHEN contains({s}, '-') THEN 'hyphen_fixed' ELSE 'mixed_case_fixed' END"
    )


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(trim({x}), '[A-Za-z]+|[^A-Za-z]+'), "
        f"lambda p: {cap('p')}), '')"
    )


def phonetic(x: str) -> str:
    out = f"lower({x})"
    for pattern, replacement in PHONETIC_REWRITES:
        out = f"regexp_replace({out}, {q(pattern)}, {q(replacement)}, 'g')"
    return out


def number(x: str) -> str:
    return f"try_cast(trim({x}) AS DOUBLE)"


def date(x: str, day_first: bool = False) -> str:
    orders = ["%d/%m/%Y", "%m/%d/%Y"] if day_first else ["%m/%d/%Y", "%d/%m/%Y"]
    return "coalesce(" + ", ".join(f"try_strptime(trim({x}), '{f}')" for f in ("%Y-%m-%d", *orders)) + ")"


def norm_gender(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    return (
        f"CASE WHEN {t} IN ('male','m','Male','MALE','M') THEN 'male' WHEN {t} IN ('female','f','Female','FEMALE','F') THEN 'female' "
        f"WHEN {t} IN ('others','other','Others') THEN 'others' ELSE lower({t}) END"
    )


def norm_category(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    return (
        f"CASE WHEN {t} IN ('obc','OBC','Obc') THEN 'obc' WHEN {t} IN ('st','ST','St') THEN 'st' WHEN {t} IN ('sc','SC','Sc') THEN 'sc' "
        f"WHEN {t} IN ('gen','GEN','general','General','GENERAL') THEN 'gen' WHEN {t} IN ('sbc','SBC') THEN 'sbc' "
        f"WHEN {t} IN ('pvtg','PVTG') THEN 'pvtg' ELSE lower({t}) END"
    )


def label(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'High' WHEN {x} >= 75 THEN 'Medium' WHEN {x} >= 60 THEN 'Low' ELSE 'Undetermined' END"


def surrogate(name: str, village: str, day: str) -> str:
    def slug(x: str) -> str:
        return f"replace({clean(x)}, ' ', '_')"

    return f"'SURR_' || {slug(name)} || '__' || {slug(village)} || '__' || left({slug(day)}, 10)"


def date_issue(x: str, as_of: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {date(x)} IS NULL THEN 'invalid_format' WHEN {date(x)} > TIMESTAMP '{as_of}' THEN 'future_date' END"


def age_issue(x: str) -> str:
    n = number(x)
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {n} IS NULL THEN 'invalid_format' WHEN {n} < 18 THEN 'below_min' WHEN {n} > 100 THEN 'above_max' END"


def land_issue(x: str) -> str:
    n = number(x)
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {n} IS NULL THEN 'non_numeric' WHEN {n} < 0 THEN 'negative' WHEN {n} = 0 THEN 'zero' "
        f"WHEN {n} < 0.01 THEN 'too_small' WHEN {n} > 1000 THEN 'too_large' END"
    )


def suffix_case(token: str, female, male, part: str) -> str:
    whens = [
        f"WHEN ends_with({token}, {q(s)}) AND length({token}) > {len(s)} THEN {q(g if part == 'gender' else s)}"
        for g, endings in (("female", female), ("male", male))
        for s in endings
    ]
    return "CASE " + " ".join(whens) + " END"


# ---- common table expressions --------------------------------------------------------------


def contact(source: str, column: str, quick: bool = False) -> str:
    """contact(row_id, original, corrected, is_valid, was_changed, reason)."""
    sep = "" if quick else r"[\s\-]?"
    order = [("right(d, 10)", "last_10"), ("left(d, 10)", "first_10")]
    if not quick:
        order.reverse()
    return rf"""contact_raw AS (SELECT row_id, coalesce(trim({column}), '') AS raw FROM {source}),
 contact_digits AS (SELECT row_id, raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\+91{sep}', ''),
   '^91{sep}', ''), '^0+', ''), '[^0-9]', '', 'g') AS d FROM contact_raw),
 contact_reason AS (SELECT *, CASE WHEN raw = '' THEN 'blank' WHEN d = '' THEN 'no_digits' WHEN length(d) < 10 THEN 'too_short'
   WHEN length(d) = 10 THEN CASE WHEN left(d, 1) IN ('6','7','8','9') THEN 'valid' ELSE 'bad_start' END
   WHEN left({order[0][0]}, 1) IN ('6','7','8','9') THEN '{order[0][1]}' WHEN left({order[1][0]}, 1) IN ('6','7','8','9') THEN '{order[1][1]}'
   ELSE 'too_long' END AS reason FROM contact_digits),
 contact_fixed AS (SELECT *, CASE reason WHEN 'first_10' THEN left(d, 10) WHEN 'last_10' THEN right(d, 10) ELSE d END AS corrected,
   reason IN ('valid', 'first_10', 'last_10') AS is_valid FROM contact_reason),
 contact AS (SELECT row_id, raw AS original, corrected, is_valid, is_valid AND corrected <> raw AS was_changed, reason FROM contact_fixed)"""


def card(source: str, column: str) -> str:
    """card(row_id, original, corrected, is_valid, was_changed, reason)."""
    house = "MH-[0-9]{2}-[0-9]{3}-[0-9]{3}-[0-9]{3}"
    return rf"""card_raw AS (SELECT row_id, coalesce(trim({column}), '') AS raw, upper(coalesce(trim({column}), '')) AS c FROM {source}),
 card_parts AS (SELECT *, regexp_replace(c, '[^0-9]', '', 'g') AS digits, string_split(c, '-') AS p,
   regexp_replace(regexp_replace(c, '\s*-\s*', '-', 'g'), '\s*/\s*', '/', 'g') AS tight FROM card_raw),
 card_how AS (SELECT *, CASE WHEN raw = '' THEN 'blank'
   WHEN regexp_full_match(c, '{house}/[0-9]{{6}}') THEN CASE WHEN c = raw THEN 'valid' ELSE 'uppercased' END
   WHEN NOT regexp_matches(c, '[A-Z]') AND length(digits) = 17 THEN 'separators_inserted'
   WHEN regexp_full_match(c, '{house}-[0-9]{{1,6}}') THEN 'dash_to_slash'
   WHEN regexp_full_match(c, '{house}/[0-9]{{1,5}}') THEN 'zero_padded'
   WHEN regexp_full_match(tight, '{house}/[0-9]{{6}}') THEN 'spaces_removed'
   WHEN NOT starts_with(c, 'MH') THEN 'state_code' WHEN len(p) <> 5 THEN 'part_count'
   WHEN NOT regexp_full_match(p[2], '[0-9]{{2}}') THEN 'district' WHEN NOT regexp_full_match(p[3], '[0-9]{{3}}') THEN 'block'
   WHEN NOT regexp_full_match(p[4], '[0-9]{{3}}') THEN 'village' WHEN NOT contains(p[5], '/') THEN 'member_separator'
   WHEN NOT regexp_full_match(split_part(p[5], '/', 1), '[0-9]{{3}}') THEN 'household'
   WHEN NOT regexp_full_match(substr(p[5], strpos(p[5], '/') + 1), '[0-9]{{6}}') THEN 'member' ELSE 'format' END AS reason FROM card_parts),
 card_fixed AS (SELECT *, CASE WHEN reason = 'uppercased' THEN c
   WHEN reason = 'separators_inserted' THEN concat('MH-', digits[1:2], '-', digits[3:5], '-', digits[6:8], '-', digits[9:11], '/', digits[12:17])
   WHEN reason IN ('dash_to_slash', 'zero_padded') THEN left(c, 17) || '/' || lpad(substr(c, 19), 6, '0')
   WHEN reason = 'spaces_removed' THEN tight ELSE raw END AS corrected FROM card_how),
 card AS (SELECT row_id, raw AS original, corrected, reason IN ('blank', 'valid', 'uppercased', 'separators_inserted', 'dash_to_slash',
   'zero_padded', 'spaces_removed') AS is_valid, corrected <> raw AS was_changed, reason FROM card_fixed)"""


def card_quick(x: str) -> str:
    c = f"upper(trim({x}))"
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL "
        f"WHEN regexp_full_match({c}, 'MH-[0-9]{{2}}-[0-9]{{3}}-[0-9]{{3}}-[0-9]{{3}}/[0-9]{{6}}') THEN NULL "
        f"WHEN NOT starts_with({c}, 'MH') THEN 'wrong_state' ELSE 'wrong_format' END"
    )


def lex_first() -> str:
    return f"lex_first AS {values(LEX.first_name_genders().items(), 'lex_name, lex_gender')}"


def lex_surname() -> str:
    ambiguous = set(LEX.ambiguous_surnames)
    rows = [(s, c, s in ambiguous) for s, c in LEX.surname_categories().items()]
    return f"lex_surname AS {values(rows, 'lex_surname, lex_category, lex_ambiguous')}"


def lex_vocab() -> str:
    return f"lex_vocab AS {values(LEX.spelling_words(), 'vocab, word')}"


def gender(source: str, column: str) -> str:
    """guess_gender(row_id, value, confidence, tier)."""
    token = "tok"
    return f"""{lex_first()}, gender_tok AS (SELECT row_id, {first(column)} AS tok FROM {source}),
 gender_tier AS (SELECT row_id, lex_gender AS exact, {suffix_case(token, LEX.female_suffixes, LEX.male_suffixes, 'gender')} AS by_suffix
   FROM gender_tok LEFT JOIN lex_first ON tok = lex_name),
 guess_gender AS (SELECT row_id, coalesce(exact, by_suffix, '') AS value,
   CASE WHEN exact IS NOT NULL THEN 95 WHEN by_suffix IS NOT NULL THEN 82 ELSE 0 END AS confidence,
   CASE WHEN exact IS NOT NULL THEN 1 WHEN by_suffix IS NOT NULL THEN 2 ELSE 0 END AS tier FROM gender_tier)"""


def quick_gender(name: str, guardian: str, part: str) -> str:
    f, g = first(name), first(guardian)
    suffix = suffix_case(f, QUICK_FEMALE_SUFFIXES, QUICK_MALE_SUFFIXES, "gender")
    out = {
        "value": ("'female'", "'male'", "'male'", suffix, "''"),
        "confidence": ("95", "95", "82", "72", "0"),
        "tier": ("1", "1", "2", "3", "0"),
    }[part]
    return (
        f"CASE WHEN {f} IN {in_list(QUICK_FEMALE_NAMES)} THEN {out[0]} WHEN {f} IN {in_list(QUICK_MALE_NAMES)} THEN {out[1]} "
        f"WHEN {g} IN {in_list(QUICK_FEMALE_NAMES)} THEN {out[2]} WHEN ({suffix}) IS NOT NULL THEN {out[3]} ELSE {out[4]} END"
    )


def ratio(pairs: str, name: str = "ratio") -> str:
    """{name}s(a, b, ratio): the sequence ratio of distinct pairs; needs WITH RECURSIVE."""

    def longest(alo: str, ahi: str, blo: str, bhi: str) -> str:
        return (
            f"list_max(flatten(list_transform(range({alo}, {ahi}), lambda i: list_transform(range({blo}, {bhi}), lambda j: "
            f"{{'k': len(list_filter(range(1, least({ahi} - i, {bhi} - j) + 1), lambda k: substr(a, i + 1, k) = substr(b, j + 1, k))), "
            f"'i': -i, 'j': -j}}))))"
        )

    return f"""{name}_pairs AS (SELECT DISTINCT a, b FROM ({pairs})),
 {name}_blocks AS (SELECT a, b, 0::BIGINT AS alo, length(a)::BIGINT AS ahi, 0::BIGINT AS blo, length(b)::BIGINT AS bhi,
   {longest('0', 'length(a)', '0', 'length(b)')} AS m FROM {name}_pairs
  UNION ALL SELECT a, b, alo, ahi, blo, bhi, {longest('alo', 'ahi', 'blo', 'bhi')} AS m FROM (
   SELECT a, b, p.alo AS alo, p.ahi AS ahi, p.blo AS blo, p.bhi AS bhi FROM (SELECT a, b, unnest([
     {{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j}}, {{'alo': m.k - m.i, 'ahi': ahi, 'blo': m.k - m.j, 'bhi': bhi}}]) AS p
    FROM {name}_blocks WHERE m.k > 0)) WHERE alo < ahi AND blo < bhi),
 {name}s AS (SELECT p.a, p.b, 2.0::DOUBLE * coalesce(sum(s.m.k), 0)::DOUBLE / (length(p.a) + length(p.b)) AS ratio
   FROM {name}_pairs p LEFT JOIN {name}_blocks s ON s.a = p.a AND s.b = p.b GROUP BY p.a, p.b)"""


def near_surnames(tokens: str) -> str:
    """near_surname(token, surname, ratio, category); ``tokens`` is a query with column token. Needs lex_surname."""
    pairs = (
        f"SELECT lex_surname AS a, token AS b FROM (SELECT DISTINCT token FROM ({tokens}) WHERE length(token) >= 3) "
        "JOIN lex_surname ON abs(length(lex_surname) - length(token)) <= 1"
    )
    return f"""{ratio(pairs, 'near')},
 near_top AS (SELECT b AS token, a AS surname FROM nears WHERE ratio >= 0.83 QUALIFY row_number() OVER (PARTITION BY b ORDER BY ratio DESC, a DESC) = 1),
 {ratio('SELECT token AS a, surname AS b FROM near_top', 'back')},
 near_surname AS (SELECT token, surname, ratio, lex_category AS category FROM near_top JOIN backs ON a = token AND b = surname JOIN lex_surname ON lex_surname = surname)"""


def category(source: str, column: str, district: str | None = None, fuzzy: bool = True, where: str = "true") -> str:
    """guess_category(row_id, value, confidence, tier); needs WITH RECURSIVE."""
    belt = f"{clean(district)} IN {in_list(LEX.districts)}" if district else "false"
    base = f"""{lex_surname()}, category_tok AS (SELECT row_id, {words(column)} AS w, {belt} AS belt FROM {source} WHERE {where}),
 category_t1 AS (SELECT row_id, w, belt, w[-1] AS surname, lex_category AS c1, lex_ambiguous AS amb FROM category_tok LEFT JOIN lex_surname ON lex_surname = w[-1])"""
    if fuzzy:
        base += f""", {near_surnames("SELECT surname AS token FROM category_t1 WHERE c1 IS NULL")},
 category_t2 AS (SELECT t.*, n.category AS c2 FROM category_t1 t LEFT JOIN near_surname n ON n.token = t.surname AND t.c1 IS NULL)"""
    else:
        base += ", category_t2 AS (SELECT *, NULL::VARCHAR AS c2 FROM category_t1)"
    return (
        base
        + """, category_any AS (SELECT row_id, arg_min(lex_category, pos) AS c3 FROM (SELECT row_id, unnest(w[:-2]) AS tok, generate_subscripts(w[:-2], 1) AS pos
   FROM category_t2 WHERE c1 IS NULL AND c2 IS NULL AND len(w) > 1) JOIN lex_surname ON lex_surname = tok GROUP BY row_id),
 guess_category AS (SELECT t.row_id, coalesce(c1, c2, c3, CASE WHEN belt AND len(w) > 0 THEN 'st' END, '') AS value,
   CASE WHEN c1 IS NOT NULL THEN CASE WHEN amb THEN 62 ELSE 88 END WHEN c2 IS NOT NULL THEN 74 WHEN c3 IS NOT NULL THEN 68 WHEN belt AND len(w) > 0 THEN 55 ELSE 0 END AS confidence,
   CASE WHEN c1 IS NOT NULL THEN 1 WHEN c2 IS NOT NULL THEN 2 WHEN c3 IS NOT NULL THEN 3 WHEN belt AND len(w) > 0 THEN 4 ELSE 0 END AS tier
   FROM category_t2 t LEFT JOIN category_any USING (row_id))"""
    )


def gender_fix(source: str, column: str = "gender") -> str:
    """fix_gender(row_id, old, new_value, confidence, method); needs guess_gender."""
    return f"""fix_gender_raw AS (SELECT row_id, {column} AS cell, trim(coalesce({column}, '')) AS raw, {norm_gender(column)} AS norm, value, confidence
   FROM {source} JOIN guess_gender USING (row_id)),
 fix_gender_new AS (SELECT *, value <> '' AND confidence >= 75 AND value <> norm AS predicted,
   norm IN ('male', 'female', 'others') AND norm <> raw AS standard FROM fix_gender_raw),
 fix_gender AS (SELECT row_id, lower(raw) AS old_value,
   CASE WHEN (CASE WHEN predicted THEN value ELSE norm END) NOT IN ('', raw) THEN CASE WHEN predicted THEN value ELSE norm END ELSE cell END AS new_value,
   CASE WHEN (CASE WHEN predicted THEN value ELSE norm END) = raw THEN NULL WHEN predicted THEN confidence WHEN standard THEN 99 END AS confidence,
   CASE WHEN (CASE WHEN predicted THEN value ELSE norm END) = raw THEN NULL WHEN predicted THEN 'Name Analysis' WHEN standard THEN 'Normalisation' END AS method FROM fix_gender_new)"""


def category_fix(source: str, column: str = "category") -> str:
    """fix_category(row_id, old_value, new_value, confidence, method); needs guess_category."""
    return f"""fix_category_raw AS (SELECT row_id, {column} AS cell, trim(coalesce({column}, '')) AS raw, {norm_category(column)} AS norm, value, confidence
   FROM {source} LEFT JOIN guess_category USING (row_id)),
 fix_category AS (SELECT row_id, lower(raw) AS old_value,
   CASE WHEN norm IN ('obc','st','sc','gen','sbc','pvtg') THEN CASE WHEN norm <> raw THEN norm ELSE cell END
     WHEN coalesce(value, '') <> '' AND confidence >= 60 AND value <> raw THEN value ELSE cell END AS new_value,
   CASE WHEN norm IN ('obc','st','sc','gen','sbc','pvtg') THEN CASE WHEN norm <> raw THEN 99 END
     WHEN coalesce(value, '') <> '' AND confidence >= 60 AND value <> raw THEN confidence END AS confidence,
   CASE WHEN norm IN ('obc','st','sc','gen','sbc','pvtg') THEN CASE WHEN norm <> raw THEN 'Normalisation' END
     WHEN coalesce(value, '') <> '' AND confidence >= 60 AND value <> raw THEN 'Surname Heuristic' END AS method FROM fix_category_raw)"""


def newest(source: str, keys: str, date_column: str, where: str = "true", columns: str = "*", last: bool = False) -> str:
    order = f"{date(date_column)} DESC NULLS LAST, row_id" if not last else f"{date(date_column)} ASC NULLS FIRST, row_id DESC"
    return f"(SELECT {columns} FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1)"


def vote(source: str, key: str, field: str) -> str:
    """ballot(key, value, votes, total, n_values, place) and majority(key, value, votes, total, n_values)."""
    return f"""ballot0 AS (SELECT {key} AS key, lower(trim({field})) AS value, count(*) AS votes FROM {source}
   WHERE NOT ({placeholder(key)}) AND {field} IS NOT NULL GROUP BY ALL),
 ballot AS (SELECT *, (sum(votes) OVER (PARTITION BY key))::BIGINT AS total, count(*) OVER (PARTITION BY key) AS n_values,
   row_number() OVER (PARTITION BY key ORDER BY votes DESC, value) AS place FROM ballot0),
 majority AS (SELECT key, value, votes, total, n_values FROM ballot WHERE place = 1 AND n_values > 1 AND votes / total >= 0.6)"""


def spelling(source: str, column: str, min_conf: int = 70, high: int = 80) -> str:
    """spell_tokens and spell_fix(vocab, token, word, distance, confidence, method, status); needs WITH RECURSIVE."""
    dist = "CASE WHEN abs(length(token) - length(word)) > 3 THEN abs(length(token) - length(word)) ELSE levenshtein(token, word) END"
    return f"""{lex_vocab()},
 spell_split AS (SELECT row_id, {column} AS name, string_split({squeeze(column)}, ' ') AS w FROM {source} WHERE NOT {blank(column)}),
 spell_tokens AS (SELECT row_id, name, pos, original, lower(original) AS token,
   CASE WHEN pos = 0 THEN 'first' WHEN pos = n - 1 AND n > 1 THEN 'surname' ELSE 'middle' END AS role,
   CASE WHEN pos = n - 1 AND n > 1 THEN 'surname' ELSE 'given' END AS vocab FROM (
    SELECT row_id, name, len(w) AS n, unnest(w) AS original, generate_subscripts(w, 1) - 1 AS pos FROM spell_split)
   WHERE length(original) > 2 AND NOT regexp_full_match(original, '[0-9]+')),
 spell_open AS (SELECT DISTINCT vocab, token FROM spell_tokens t WHERE token NOT IN {in_list(LEX.protected_names)}
   AND NOT EXISTS (SELECT 1 FROM lex_vocab v WHERE v.vocab = t.vocab AND v.word = t.token)),
 spell_phon AS (SELECT vocab, token, word, {dist} AS distance FROM spell_open JOIN lex_vocab USING (vocab)
   WHERE {phonetic('token')} = {phonetic('word')} QUALIFY row_number() OVER (PARTITION BY vocab, token ORDER BY {dist}, word) = 1),
 {ratio("SELECT word AS a, token AS b FROM spell_open JOIN lex_vocab USING (vocab)", 'fuzz')},
 spell_sim AS (SELECT vocab, token, word, {dist} AS distance FROM spell_open JOIN lex_vocab USING (vocab) JOIN fuzzs ON a = word AND b = token
   WHERE ratio >= 0.75 QUALIFY row_number() OVER (PARTITION BY vocab, token ORDER BY ratio DESC, word DESC) = 1),
 spell_cand AS (SELECT *, 'phonetic' AS source, 1 AS pref FROM spell_phon WHERE distance <= 2
   UNION ALL SELECT *, 'fuzzy', 0 FROM spell_sim WHERE distance <= 2),
 {ratio('SELECT token AS a, word AS b FROM spell_cand', 'fwd')},
 spell_conf AS (SELECT c.*, CAST(floor(CASE WHEN source = 'phonetic' AND distance <= 1 THEN ratio * 92
   WHEN source = 'phonetic' THEN greatest(70, floor(ratio * 88)) WHEN distance <= 1 THEN ratio * 88 ELSE ratio * 76 END) AS INTEGER) AS confidence
   FROM spell_cand c JOIN fwds ON a = token AND b = word),
 spell_fix AS (SELECT vocab, token, {cap('word')} AS corrected, distance, confidence, source || '(edit=' || distance || ')' AS method,
   CASE WHEN confidence >= {high} THEN 'corrected' ELSE 'review' END AS status FROM spell_conf WHERE confidence >= {min_conf}
   QUALIFY row_number() OVER (PARTITION BY vocab, token ORDER BY confidence DESC, pref DESC) = 1),
 spell_names AS (SELECT s.row_id, any_value(s.name) AS name, any_value(array_to_string(s.w, ' ')) AS joined FROM spell_split s GROUP BY s.row_id),
 spell_rebuilt AS (SELECT row_id, string_agg(coalesce(f.corrected, x.original), ' ' ORDER BY pos) AS fixed FROM (
    SELECT row_id, unnest(w) AS original, generate_subscripts(w, 1) - 1 AS pos, len(w) AS n FROM spell_split) x
   LEFT JOIN spell_fix f ON f.token = lower(x.original) AND length(x.original) > 2 AND NOT regexp_full_match(x.original, '[0-9]+')
     AND f.vocab = CASE WHEN pos = n - 1 AND n > 1 THEN 'surname' ELSE 'given' END GROUP BY row_id)"""


def file_states() -> str:
    """states(file_name, seq, action, actor, at, from_status, to_status, is_legal): each file folded in order; needs file_events."""
    def nxt(state: str, action: str) -> str:
        return (
            f"CASE WHEN {action} = 'upload' AND {state} = 'none' THEN 'pending' WHEN {action} = 'approve' AND {state} IN ('pending','held') THEN 'approved' "
            f"WHEN {action} = 'reject' AND {state} IN ('pending','held') THEN 'rejected' WHEN {action} = 'hold' AND {state} = 'pending' THEN 'held' "
            f"WHEN {action} = 'promote' AND {state} IN ('rejected','revoked') THEN 'promoted' WHEN {action} = 'revoke' AND {state} IN ('approved','promoted') THEN 'revoked' "
            f"ELSE {state} END"
        )

    return f"""event_rank AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY seq) AS n FROM file_events),
 event_walk AS (SELECT file_name, seq, n, 'none' AS from_status, {nxt("'none'", 'action')} AS to_status FROM event_rank WHERE n = 1
   UNION ALL SELECT r.file_name, r.seq, r.n, w.to_status, {nxt('w.to_status', 'r.action')} FROM event_walk w JOIN event_rank r
     ON r.file_name = w.file_name AND r.n = w.n + 1),
 states AS (SELECT e.file_name, e.seq, e.action, e.actor, e."at", w.from_status, w.to_status, w.from_status <> w.to_status AS is_legal
   FROM event_walk w JOIN file_events e ON e.file_name = w.file_name AND e.seq = w.seq)"""


def evidence_ctes() -> str:
    """pairs, per_file, totals, ambiguous, strict, prob0 and prob; needs evidence."""
    return f"""pairs AS (SELECT {extract_first('first_raw')} AS name, {clean('gender_raw')} AS gender, source_file FROM evidence
   WHERE {extract_first('first_raw')} <> '' AND {clean('gender_raw')} IN ('male', 'female')),
 per_file AS (SELECT name, source_file, count(*) FILTER (gender = 'male') AS male, count(*) FILTER (gender = 'female') AS female FROM pairs GROUP BY ALL),
 totals AS (SELECT name, sum(male)::BIGINT AS m, sum(female)::BIGINT AS f, bool_or(male > 0 AND female > 0) AS in_file, count(*) AS n_files FROM per_file GROUP BY name),
 ambiguous AS (SELECT name, m AS male_count, f AS female_count, m + f AS total, n_files,
   CASE WHEN in_file THEN 'in_file_conflict' ELSE 'cross_file_conflict' END AS reason FROM totals WHERE m > 0 AND f > 0),
 strict AS (SELECT name, CASE WHEN m > 0 THEN 'male' ELSE 'female' END AS gender, m + f AS count, n_files FROM totals WHERE (m = 0 OR f = 0) AND m + f >= 2),
 prob0 AS (SELECT name, CASE WHEN m / (m + f) >= 0.95 THEN 'male' ELSE 'female' END AS gender, round(greatest(m, f) / (m + f), 4) AS confidence,
   m AS male_count, f AS female_count, m + f AS total, n_files FROM totals WHERE m + f >= 3 AND greatest(m, f) / (m + f) >= 0.95),
 prob AS (SELECT * FROM prob0 WHERE name NOT IN (SELECT name FROM strict))"""
