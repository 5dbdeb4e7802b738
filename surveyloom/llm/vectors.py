"""Exact top-k search over binary codes by multi-index hashing.

A code is cut into segments. Codes within a Hamming distance r of a query differ from it in at most
r / segments bits of some segment. Probing all values within a radius of every segment therefore
covers all codes up to segments * (radius + 1) - 1; the radius grows until that reaches a query's
kth verified distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import stage

BITS = 16
K = 10


def binary_code(embedding: Column, bits: int = BITS) -> Column:
    """Signs of the values, ``bits`` to a segment: an array of integers; null for null or empty vectors. NaN and null values count as negative."""
    starts = F.sequence(F.lit(0), F.size(embedding) - 1, F.lit(bits))
    sign = lambda acc, x: acc * 2 + F.when((x > 0) & ~F.isnan(x), 1).otherwise(0)
    return F.when(F.size(embedding) > 0, F.transform(starts, lambda s: F.aggregate(F.slice(embedding, s + 1, bits), F.lit(0), sign)))


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def flips(radius: int, bits: int = BITS) -> list[int]:
    """All masks of ``bits`` bits with ``radius`` of them set."""
    return [m for m in range(1 << bits) if m.bit_count() == radius]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, distance): the ``k`` nearest other vectors of each query, ties by vec_id.

    Both tables have vec_id and embedding; codes are compared with codes of the same number of
    values. Vectors with equal codes are one entry of the index with its k + 1 smallest ids, all that
    a top-k with ties by id can use. Null and empty vectors are neither found nor answered; repeated
    ids count once, with their smallest code, and null ids are left out.
    """

    def coded(rows: DataFrame) -> DataFrame:
        known = rows.where(F.col("vec_id").isNotNull()).select("vec_id", F.size("embedding").alias("width"), binary_code(F.col("embedding"), bits).alias("code"))
        return known.where(F.col("code").isNotNull()).groupBy("vec_id").agg(F.min(F.struct("width", "code")).alias("c")).select("vec_id", "c.width", "c.code")

    ids = coded(vectors)
    # the smallest ids of a code: a window that Spark prunes in each task before the shuffle
    order = Window.partitionBy("width", "code").orderBy("vec_id")
    index = stage(
        ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).groupBy("width", "code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "codes"
    )
    asked = stage(coded(queries).select(F.col("vec_id").alias("query_id"), "width", "code"), "asked")
    segments = stage(index.select("width", "code", F.size("ids").alias("n"), F.posexplode("code").alias("segment", "value")), "segments")
    totals = stage(index.groupBy("width").agg(F.sum(F.size("ids")).alias("total")), "totals")
    # queries with equal codes probe once
    active = asked.select("width", F.col("code").alias("q")).distinct()
    found = answered = None
    for radius in range(bits + 1):
        masks = F.split(F.lit(",".join(map(str, flips(radius, bits)))), ",").cast("array<int>")
        probes = active.select("width", "q", F.posexplode("q").alias("segment", "own"))
        probes = probes.select("width", "q", "segment", F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m))).alias("value"))
        # probes are many more than the planner expects of the few queries, so neither side is broadcast
        met = probes.join(segments.hint("merge"), ["width", "segment", "value"]).select("width", "q", "code", "n").distinct()
        pool = met.withColumn("distance", distance(F.col("q"), F.col("code")))
        if found is not None:  # a code met in one segment comes again at a larger radius of another
            pool = pool.unionByName(found.join(active, ["width", "q"], "left_semi")).distinct()
        # a code can only matter while at most k ids are nearer
        near = Window.partitionBy("width", "q").orderBy("distance")
        before = F.sum("n").over(near) - F.sum("n").over(Window.partitionBy("width", "q", "distance"))
        found = stage(pool.withColumn("_before", before).where(F.col("_before") <= k).drop("_before"), "met")
        reach = found.groupBy("width", "q").agg(F.max("distance").alias("far"), F.sum("n").alias("ids")).join(totals, "width")
        covered = F.ceil(F.col("width") / bits) * (radius + 1) - 1
        done = reach.where(((F.col("ids") > k) & (F.col("far") <= covered)) | (F.col("ids") == F.col("total"))).select("width", "q")
        still = stage(active.join(done, ["width", "q"], "left_anti"), "open")
        answers = found.join(still, ["width", "q"], "left_anti")
        answered = answers if answered is None else answered.unionByName(answers)
        active = still
        if still.isEmpty():
            break
    pairs = answered.join(index, ["width", "code"]).select("width", "q", "distance", F.explode("ids").alias("vec_id"))
    mine = asked.join(pairs.withColumnRenamed("q", "code"), ["width", "code"]).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return mine.select("query_id", rank.alias("rank"), "vec_id", "distance").where(F.col("rank") <= k)
