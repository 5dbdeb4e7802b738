"""Mixing sources to target weights by repetition rates.

A source's rate is its target over its size: every document is taken floor(rate) times and once more by
a draw hashed from its id, with the fraction as probability. Draws of a small source of unequal documents
may miss its target by far, so each source has the seed, of DRAWS tried in one aggregation, whose sum
comes nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import WORD, ranked, stage

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-2"
DRAWS = 32
_BITS = 40


def text_size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size), stored: the texts are read once for both passes."""
    return stage(docs.select("doc_id", "source", text_size(F.col("text")).alias("size")), "sizes")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """(source, source_size, target, rate) per source of (source, size) rows, stored.

    Sources by code point, null last, take ``weights`` in turn and divide ``share`` of all sizes.
    A target stops at ``max_repeats`` times its source; what is over goes to the others by weight,
    in rounds until none is above. A round reads one row of sums. Sources without words get 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = ranked(totals, F.col("source").asc_nulls_last(), name="place")
    turn = F.array(*[F.lit(w) for w in weights])
    table = stage(
        ordered.select(
            "source", "source_size",
            F.get(turn, (F.col("place") % len(weights)).cast("int")).cast("long").alias("weight"),
            (F.col("source_size") * max_repeats).alias("most"),
        ),
        "sources",
    )
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("most")
        sums = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, F.col("most")).otherwise(0)).alias("fixed"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(over).alias("capped"),
        ).first()
        if sums["capped"] == capped or not sums["open"]:
            break
        capped, level = sums["capped"], (sums["all"] * share - sums["fixed"]) / sums["open"]
    target = F.least(F.col("weight") * F.lit(level), F.col("most").cast("double"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0)
    return stage(table.select("source", "source_size", target.alias("target"), rate.alias("rate")), "targets")


def with_rates(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets joined by source, null included; Spark broadcasts them only if they are small."""
    other = targets.withColumnRenamed("source", "_source")
    return rows.join(other, rows["source"].eqNullSafe(other["_source"]), "left").drop("_source")


def _halves(doc_id: Column, seed: str = SEED) -> Column:
    """Two numbers of _BITS bits from the MD5 of the id."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
    part = lambda at: F.conv(F.substring(digest, at, _BITS // 4), 16, 10).cast("long")
    return F.struct(part(1).alias("a"), part(1 + _BITS // 4).alias("b"))


def _drawn(rate: Column, halves: Column, draw: Column) -> Column:
    """Whether the draw takes one more copy; draws of one document are pairwise independent."""
    u = (halves.a + draw * halves.b) % F.lit(1 << _BITS) / F.lit(float(1 << _BITS))
    return u < rate - F.floor(rate)


def with_draws(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with the draw of each source whose sum is nearest to its target, of equal ones the first; stored."""
    rows = with_rates(sizes, targets).withColumn("_h", _halves(F.col("doc_id")))
    extra = [F.sum(F.when(_drawn(F.col("rate"), F.col("_h"), F.lit(k)), F.col("size")).otherwise(0)).alias(f"_{k}") for k in range(DRAWS)]
    sums = rows.groupBy("source").agg(F.first("rate").alias("_rate"), F.first("source_size").alias("_size"), F.first("target").alias("_target"), *extra)
    off = lambda k: F.abs((F.col("_size") * F.floor("_rate") + F.col(f"_{k}")).cast("double") - F.col("_target"))
    best = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(k).cast("long").alias("draw")) for k in range(DRAWS)])).draw
    return stage(sums.select("source", F.col("_size").alias("source_size"), F.col("_target").alias("target"), F.col("_rate").alias("rate"), best.alias("draw")), "draws")


def copies(rate: Column, doc_id: Column, draw: Column) -> Column:
    """floor(rate) copies and one more with the fraction's probability, drawn by a hash of the id."""
    return (F.floor(rate) + _drawn(rate, _halves(doc_id), draw).cast("long")).cast("long")


def mix_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document.

    Null texts have size 0; null sources are one source, the last; repeated rows are drawn
    alike as they share an id; null ids share one draw. An empty table gives none. Reruns agree.
    """
    sizes = sized(docs)
    return with_rates(sizes, with_draws(sizes, source_targets(sizes))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("doc_id"), F.col("draw"))).alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix: each row as often as it is taken, all columns kept."""
    sizes = sized(docs)
    targets = with_draws(sizes, source_targets(sizes))
    rates = targets.select(F.struct("source").alias("_key"), F.col("rate").alias("_rate"), F.col("draw").alias("_draw"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    joined = rows.join(rates, F.col("_row.source").eqNullSafe(F.col("_key.source")), "left")
    times = copies(F.col("_rate"), F.col("_row.doc_id"), F.col("_draw")).cast("int")
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).select("_row.*")
