"""Secret scans: known shapes, and a battery of randomness tests with false-discovery control.

Long tokens are read in the encoding that their characters imply. Chi-squared uniformity of
the alphabet, runs and serial correlation are tested; the p-value says how likely an ordinary
token of that length would look as random. Discoveries are controlled by the step-up procedure of
Benjamini and Hochberg within bands of length, as short tokens can't give small p-values.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import let, stage

# The shapes that are always reported; a keyword's letters may be of either case.
_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(?i:" + "|".join(_KEYWORDS) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{{{0},}}"
HEX = "[0-9a-f]{{{0},}}"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}

TOKEN = "[A-Za-z0-9+/_-]{20,}"
_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in the order in which they are inferred: pattern of the token, alphabet in order of value.
ENCODINGS = (
    ("[0-9a-f]*[a-f][0-9a-f]*", _DIGITS + "abcdef"),
    ("[0-9A-F]*[A-F][0-9A-F]*", _DIGITS + "ABCDEF"),
    ("[A-Z2-7]*[A-Z][A-Z2-7]*", _UPPER + "234567"),
    (".*[A-Za-z].*", _UPPER + _UPPER.lower() + _DIGITS + "+/"),
)
#: Chance that two characters of an ordinary token agree, times the alphabet's size; and how uneven letters are.
AGREE = {16: 2.0, 32: 2.0, 64: 3.5}
UNEVEN = 1.15
VETO = 3.0
ALPHA = 0.05
BIN, LAST_BIN = 0.1, 3000


class Scan(NamedTuple):
    base: Column
    tokens: Column


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Non-overlapping matches of ``pattern``, leftmost first, as (start, end, group length) in code points.

    Splitting by the same pattern gives the text between matches, and so their places.
    """

    def place(b: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc.at + F.length(F.get(b.gaps, i))
            return let(start, lambda s: let(s + F.length(F.get(b.found, i)), lambda e: F.struct(
                e.alias("at"), F.concat(acc.out, F.array(F.struct(s.alias("start"), e.alias("end"), F.length(F.get(b.inner, i)).alias("size")))).alias("out"),
            )))

        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(b.found) - 1), zero, step, lambda acc: acc.out)

    none = F.array().cast("array<struct<start:int,end:int,size:int>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found"), inner.alias("inner"))
    return F.when(F.rlike(text, F.lit(pattern)), let(parts, place)).otherwise(none)


def _spans(text: Column, kind: str) -> Column:
    """Spans (start, kind, end) of a known shape; a longer match of [0-9a-f] or of capitals is one run, so its least length can be asked at once."""
    least = LEAST[kind]
    found = {
        "assign": lambda: F.filter(matches(text, ASSIGN, 1), lambda m: m.size >= least),
        "access": lambda: matches(text, ACCESS.format(least - 4)),
        "hex": lambda: matches(text, HEX.format(least)),
    }[kind]()
    return F.transform(found, lambda m: F.struct(m.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m.end.alias("end")))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[_spans(text, kind) for kind in KINDS[:3]]))


def _tested(token: Column) -> Column:
    """(length, p) of a token: p by a Chernoff bound on the normal tail; 1 where no encoding fits or a test rejects randomness."""

    def battery(alphabet: str) -> Column:
        k = len(alphabet)
        agree = AGREE[k] / k
        plain = F.translate(token, "-_", "+/")
        values = F.transform(F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0)), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))

        def decide(v: Column) -> Column:
            n = F.size(v).cast("double")
            squares = F.aggregate(F.array(*[F.lit(c) for c in alphabet]), F.lit(0.0), lambda a, c: a + F.pow(F.length(plain) - F.length(F.replace(plain, c, F.lit(""))), F.lit(2.0)))
            chi = squares * k / n - n
            chi_z = (chi - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
            # what an ordinary token would give, and its spread
            mean = (k - 1) + (n - 1) * (k * agree - 1)
            pairs = n * (n - 1) / 2
            spread = F.sqrt(pairs * agree * (1 - agree) + n * (n - 1) * (n - 2) * (UNEVEN - 1) * agree**2) * 2 * k / n
            high = F.transform(v, lambda x: (x >= k / 2).cast("int"))
            ups = F.aggregate(high, F.lit(0), lambda a, x: a + x).cast("double")
            runs = let(high, lambda h: F.size(F.filter(h, lambda x, i: (i == 0) | (x != F.get(h, i - 1))))).cast("double")
            expected = 1 + 2 * ups * (n - ups) / n
            runs_z = F.when((ups > 0) & (ups < n), (runs - expected) / F.sqrt((expected - 1) * (expected - 2) / (n - 1))).otherwise(99.0)
            average = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
            centred = F.transform(v, lambda x: x - average)
            products = let(centred, lambda c: F.aggregate(F.transform(c, lambda x, i: F.when(i > 0, x * F.get(c, i - 1)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x))
            variance = F.aggregate(centred, F.lit(0.0), lambda a, x: a + x * x)
            serial_z = F.when(variance > 0, products / variance * F.sqrt(n)).otherwise(99.0)
            return let(
                F.struct(chi_z.alias("chi"), F.abs(runs_z).alias("runs"), F.abs(serial_z).alias("serial"), ((mean - chi) / spread).alias("gap")),
                lambda z: F.when((z.chi > VETO) | (z.runs > VETO) | (z.serial > VETO) | (z.gap <= 0), 1.0).otherwise(
                    let(F.greatest(F.lit(0.0), z.gap - 0.5 * F.greatest(F.lit(0.0), z.runs - 2) - 0.5 * F.greatest(F.lit(0.0), z.serial - 2)), lambda g: 0.5 * F.exp(-g * g / 2))
                ),
            )

        return let(values, decide)

    p = F.lit(1.0)
    for pattern, alphabet in reversed(ENCODINGS):
        p = F.when(F.rlike(token, F.lit(f"(?s)^{pattern}$")), battery(alphabet)).otherwise(p)
    return p


def tokens(text: Column) -> Column:
    """Tested tokens (start, end, band, bin). The band is the length's power of two, the bin that of -ln p."""

    def test(m: Column) -> Column:
        p = let(F.substring(text, m.start + 1, m.end - m.start), _tested)
        return F.struct(
            m.start.alias("start"), m.end.alias("end"), F.floor(F.log2((m.end - m.start).cast("double"))).cast("int").alias("band"),
            F.least(F.floor(-F.log(p) / BIN), F.lit(LAST_BIN)).cast("int").alias("bin"),
        )

    return F.transform(matches(text, TOKEN), test)


def scan(text: Column) -> Scan:
    text = F.coalesce(text, F.lit(""))
    return Scan(base_spans(text), tokens(text))


def thresholds(rows: DataFrame, alpha: float = ALPHA) -> dict[int, int]:
    """Lowest bin that is a discovery, per band, over all rows with a column ``tokens``.

    Bands and bins are few whatever the input, so the counts are a small table; a band without
    discoveries is absent.
    """
    counts = rows.select(F.explode("tokens").alias("t")).groupBy("t.band", "t.bin").agg(F.count("*").alias("n"))
    band = Window.partitionBy("band")
    ranked = counts.select("band", "bin", F.sum("n").over(band).alias("all"), F.sum("n").over(band.orderBy(F.desc("bin"))).alias("found"))
    passed = ranked.where(F.exp(-F.col("bin") * BIN) * F.col("all") <= alpha * F.col("found"))
    return {r["band"]: r["least"] for r in passed.groupBy("band").agg(F.min("bin").alias("least")).collect()}


def all_spans(base: Column, tested: Column, least: dict[int, int]) -> Column:
    """Base spans and discovered ones by start, kind and end."""
    if not least:
        return base
    bands = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair])
    found = F.filter(tested, lambda t: F.coalesce(t.bin >= F.element_at(bands, t.band), F.lit(False)))
    return F.array_sort(F.concat(base, F.transform(found, lambda t: F.struct(t.start.alias("start"), F.lit(len(KINDS) - 1).alias("kind"), t.end.alias("end")))))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Counts of each base kind, digest of the base spans and list of all spans per document.

    Null texts count as empty; a document without spans has the digest of the empty text.
    Each row is scanned alone, so repeated rows and ids get equal results.
    """
    found = scan(F.col("text"))
    rows = stage(docs.select("doc_id", found.base.alias("base"), found.tokens.alias("tokens")), "secrets")
    least = thresholds(rows)
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(all_spans(F.col("base"), F.col("tokens"), least)).alias("spans"),
    )


def redacted(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with each stretch of overlapping spans replaced by one mask."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s.start >= acc.at
        gap = F.when(fresh, F.concat(F.substring(text, acc.at + 1, s.start - acc.at), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.concat(acc.out, gap).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))


def redact_documents(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """All documents, secrets in their texts replaced; ``n_chars``, where there is one, follows the text."""
    found = scan(F.col("text"))
    rows = stage(docs.select(F.struct(*docs.columns).alias("row"), found.base.alias("base"), found.tokens.alias("tokens")), "scanned")
    clean = redacted(F.col("row.text"), all_spans(F.col("base"), F.col("tokens"), thresholds(rows)), mask)
    cols = {"text": clean} | ({"n_chars": F.length(clean).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[cols.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
