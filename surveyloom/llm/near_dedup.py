"""MinHash near-deduplication with tensored banding and exact verification.

A table key combines one half key of collection A with one of collection B, each over ROWS minhashes.
All pairs of half keys give SIDE * SIDE tables from 2 * SIDE * ROWS minhashes. Two sets meet in some
table if they share a half key of either collection, so only those keys are combined.

Texts with equal shingle sets are one class, known by 64 bits of the set's 128-bit digest, seeded so that no two sets share them. In every bucket of a table, members are compared with
the bucket's most typical class only. What is left are buckets whose members lie in different
components; there the shingles that occur in several components are indexed, rare ones first, and
only sets that could still reach the threshold by them are compared. So no link between classes that
share a bucket is lost, and no bucket is expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import class_of, stage, unique_seed
from surveyloom.llm.components import components
from surveyloom.operators.keyed import split_by_keys

ROWS = 4
MISS = 5e-6
CACHE = 1 << 20
COLUMNS = 4096
#: Stands for a null doc_id.
LAST = (1 << 63) - 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def sides(percent: int) -> int:
    """Half keys a collection, so that a pair at the threshold is missed with probability MISS at most."""
    return math.ceil(math.log(MISS / 2) / math.log(1 - (percent / 100) ** ROWS))


class _Hashes(dict):
    """Hash of each word met, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words, A-Z lower-cased; of the whole sequence where it is shorter."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # splits and lowers ASCII only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = _mixed(out * _GOLD + h[i : n - width + 1 + i])
    return np.unique(out)


def half_keys(values: np.ndarray, count: int) -> np.ndarray:
    """``count`` half keys of a set: each hashes ROWS minhashes and its own number."""
    rng = np.random.default_rng(20240607)
    salt = rng.integers(0, 1 << 63, (count * ROWS, 1), np.uint64)
    odd = rng.integers(0, 1 << 63, (count * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(count * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), COLUMNS):
        np.minimum(least, ((values[None, i : i + COLUMNS] ^ salt) * odd).min(axis=1), out=least)
    out = np.arange(1, count + 1, dtype=np.uint64)
    for row in least.reshape(count, ROWS).T:
        out = _mixed(out * _GOLD + row)
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def sketches(docs: DataFrame, size: int, side: int) -> DataFrame:
    """(doc_id, th, n, digest, keys) per document, th being a hash of the text; digest (that of the set) and keys are null for empty sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for b in batches:
            out = []
            for doc_id, text, th in zip(b["doc_id"], b["text"], b["th"]):
                s = shingles(text, size, known)
                out.append((doc_id, th, len(s), xxhash.xxh3_128_digest(s.tobytes()), _signed(half_keys(s, 2 * side))) if len(s) else (doc_id, th, 0, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "th", "n", "digest", "keys"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInPandas(run, "doc_id long, th long, n long, digest binary, keys array<long>")


def class_sets(docs: DataFrame, wanted: DataFrame, size: int, seed: int) -> DataFrame:
    """(c, n, s): the shingle set of each wanted class (c, doc_id), from one of its documents' texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for b in batches:
            sets = [shingles(t, size, known) for t in b["text"]]
            yield pd.DataFrame({"digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "n": [len(s) for s in sets], "s": [_signed(s) for s in sets]})

    ids = wanted.select("doc_id").distinct()
    texts, _ = split_by_keys(docs.select("doc_id", "text"), ids, ["doc_id"])  # so that few texts are shuffled
    found = texts.join(ids, "doc_id", "left_semi").mapInPandas(run, "digest binary, n long, s array<long>").select(class_of(F.col("digest"), seed).alias("c"), "n", "s")
    return found.join(wanted.select("c"), "c", "left_semi").dropDuplicates(["c"])


def _can_link(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    x = sets.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    y = sets.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(x, "a").join(y, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` with the root of each c: itself where it has no link."""
    roots = components(links).withColumnRenamed("node", "c")
    return classes.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))


def _left_over(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (c, root) with different roots that may be similar enough.

    Only shingles that occur under several roots can be shared by such a pair; each class lists its own,
    rare ones first. Two sets of na and nb shingles need percent * (na + nb) / (100 + percent) in common,
    which is at least percent % of either. So a class with fewer goes, a linked pair has one in common
    among the first that a class has beyond that number, and from their first common one on each
    needs so many.
    """
    held = sets.join(members, "c").select("c", "root", F.explode("s").alias("t"))
    several = held.groupBy("t").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    several = stage(several.select("t", "df"), "several")
    listed = held.select("c", "t").join(several, "t").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("ts"))
    needed = F.ceil(F.col("n") * percent / 100)
    rare = (
        listed.join(sets.select("c", "n"), "c").where(F.size("ts") >= needed).join(members, "c")
        .select("c", "root", "n", F.size("ts").alias("u"), F.posexplode(F.slice("ts", 1, (F.size("ts") - needed + 1).cast("int"))).alias("i", "x"))
        .select("c", "root", "n", F.col("x.t").alias("t"), (F.col("u") - F.col("i")).alias("rest"))
    )
    rare = stage(rare, "rare")
    one = rare.select("t", *[F.col(c).alias(f"{c}_a") for c in ("c", "root", "n", "rest")])
    two = rare.select("t", *[F.col(c).alias(f"{c}_b") for c in ("c", "root", "n", "rest")])
    enough = (100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_a") + F.col("n_b"))
    met = one.join(two, (one["t"] == two["t"]) & (F.col("c_a") < F.col("c_b")) & (F.col("root_a") != F.col("root_b")) & enough)
    return met.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct()


def _components(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n, c, keys) per document and (c, doc_id, root) per class, doc_id being the smallest; all of them are stored."""
    side = sides(percent)
    stored = stage(sketches(docs, size, side), "sketches")
    seed = unique_seed(stored, "digest")
    rows = stored.select("doc_id", "th", "n", F.when(F.col("digest").isNotNull(), class_of(F.col("digest"), seed)).alias("c"), "keys")
    known = rows.where("c is not null")
    classes = known.groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    half = stage(classes.select("c", F.posexplode("keys").alias("no", "key")).select("c", (F.col("no") < side).alias("first"), "key"), "half-keys")
    # aggregated sides of joins are stored, so that a join can split its hot keys
    shared = stage(half.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    collected = lambda first: F.collect_list(F.when(F.col("first") == F.lit(first), F.col("key")))
    joined = half.join(shared, "key").groupBy("c").agg(collected(True).alias("a"), collected(False).alias("b"), F.sum("members").alias("weight"))
    sizes = known.groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    met = stage(joined.where((F.size("a") > 0) & (F.size("b") > 0)).join(sizes, "c"), "met")
    tensor = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    tables = met.select("c", "n", "weight", F.explode(tensor).alias("key"))
    # the class whose half keys are the most common ones stands for a bucket
    buckets = tables.groupBy("key").agg(F.max(F.struct("weight", "c", "n")).alias("lead"), F.count("*").alias("members")).where("members > 1")
    buckets = stage(buckets.select("key", F.col("lead.c").alias("lead"), F.col("lead.n").alias("lead_n")), "buckets")
    pairs = tables.join(buckets, "key").where((F.col("c") != F.col("lead")) & _can_link(F.col("n"), F.col("lead_n"), percent))
    pairs = stage(pairs.select(F.least("c", "lead").alias("a"), F.greatest("c", "lead").alias("b")).distinct(), "pairs")
    sets = stage(class_sets(docs, met, size, seed), "sets")
    links = stage(verified(pairs, sets, percent), "links")

    rooted = stage(_rooted(met.select("c"), links), "roots")
    mixed = tables.join(rooted, "c").groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    mixed = stage(mixed.select("key"), "mixed")
    members = stage(tables.join(mixed, "key", "left_semi").select("c").distinct().join(rooted, "c"), "members")
    more = stage(verified(stage(_left_over(members, sets, percent), "pairs"), sets, percent), "links")

    return rows, stage(_rooted(known.groupBy("c").agg(F.min("doc_id").alias("doc_id")), links.unionByName(more)), "classes")


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with LAST for null ids, so that their texts are found by id as well."""
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document.

    Documents whose sets have ``percent`` % or more of their union in common are linked; component_id
    is the smallest doc_id reachable, and kept says that it is the document's own. Null and wordless
    texts are linked with nothing. Each row has the links of its own text, so repeated rows lie in one
    component. A null doc_id counts as larger than any other: alone, its component is null, and it is kept.
    """
    rows, final = _components(_numbered(docs), size, percent)
    smallest = final.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = stage(final.join(smallest, "root").select("c", "component_id"), "components")
    found = rows.select("doc_id", "n", "c").join(named, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    given = lambda c: F.nullif(c, F.lit(LAST))
    return found.select(
        given(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), given(component).alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def _first_rows(packed: DataFrame, *by: str) -> DataFrame:
    """Of the rows with equal ``by`` the first in the order of their JSON."""
    return packed.groupBy(*by).agg(F.min_by("_row", F.to_json("_row")).alias("_row"))


def _one_row_each(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(_id, _th, _row) of the rows that ``one_row_each`` keeps."""
    rows, final = _components(_numbered(docs), size, percent)
    keys = rows.groupBy("doc_id", "th", "c").agg(F.count("*").alias("rows"))
    keys = stage(keys, "texts")
    texts = keys.where("c is not null").groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("one"))
    held = stage(final.select("c", "root").join(texts, "c"), "held")
    ones = stage(held.groupBy("root").agg(F.min("one").alias("one")), "ones")
    named = stage(held.select("c", "root").join(ones, "root").select("c", "one"), "components")
    judged = keys.join(named, "c", "left").withColumn("kept", F.col("c").isNull() | (F.struct("doc_id", "th") == F.col("one")))
    key = [F.col("doc_id").alias("_id"), F.col("th").alias("_th")]
    marked = stage(judged.where(~F.col("kept") | (F.col("rows") > 1)).select(*key, "kept"), "marked")
    packed = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.xxhash64("text").alias("_th"), F.struct(*docs.columns).alias("_row"))
    # most rows are neither dropped nor repeated, and are not shuffled
    maybe, alone = split_by_keys(packed, marked.select("_id", "_th"), ["_id", "_th"])
    single = maybe.join(marked, ["_id", "_th"], "left_anti")
    again = maybe.join(marked.where("kept"), ["_id", "_th"], "left_semi")
    return alone.unionByName(single).unionByName(_first_rows(again, "_id", "_th"))


def one_row_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, of each component only one row: of its smallest doc_id, and of that the text with the smallest hash. All columns stay.

    Rows of one id whose texts are not linked all stay, texts without words too; of rows with equal id and text one. Null ids count as the largest.
    """
    return _one_row_each(docs, size, percent).select("_row.*")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """As ``one_row_each``, but of the rows that an id keeps only one; null ids keep theirs."""
    found = stage(_one_row_each(docs, size, percent), "near")
    return found.where(F.col("_id") == LAST).unionByName(_first_rows(found.where(F.col("_id") != LAST), "_id").select("_id", F.lit(0).cast("long").alias("_th"), "_row")).select("_row.*")
