"""File lifecycle as an append-only event table.

Every file is a small state machine; an event that its state does not allow is kept in
the log, marked illegal, and changes nothing. Because the state after an event depends
on which earlier events were legal, the states are computed as a prefix scan over
*transition functions*: a file's events are cut into chunks by their rank, each chunk is
reduced to the function it applies to a start state, functions are composed level by
level, and the start states are handed back down. No chunk holds more than CHUNK events,
so a file with any number of events is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.operators.keyed import lookup, rank_within
from surveyloom.session import stage

# States, and which action leads from which state to which.
STATES = ("none", "pending", "held", "approved", "rejected", "promoted", "revoked")
TRANSITIONS = (
    ("upload", "none", "pending"),
    ("approve", "pending", "approved"),
    ("approve", "held", "approved"),
    ("reject", "pending", "rejected"),
    ("reject", "held", "rejected"),
    ("hold", "pending", "held"),
    ("promote", "rejected", "promoted"),
    ("promote", "revoked", "promoted"),
    ("revoke", "approved", "revoked"),
    ("revoke", "promoted", "revoked"),
)
CHUNK = 512


def _action_function(action: Column) -> Column:
    """Array f with f[s] = index of the state after ``action`` in state s."""
    identity = list(range(len(STATES)))
    chain = None
    for name in dict.fromkeys(t[0] for t in TRANSITIONS):
        f = list(identity)
        for act, source, target in TRANSITIONS:
            if act == name:
                f[STATES.index(source)] = STATES.index(target)
        value = F.lit(f)
        chain = F.when(action == name, value) if chain is None else chain.when(action == name, value)
    return chain.otherwise(F.lit(identity))


def _compose(first: Column, then: Column) -> Column:
    return F.transform(first, lambda s: F.get(then, s))


def _identity() -> Column:
    return F.lit(list(range(len(STATES))))


def _state(start: Column, f: Column) -> Column:
    return F.get(f, start)


def _prefix(items: Column, start: Column) -> Column:
    """For ordered structs with field ``f``: the state before each, given the state before the first."""
    seed = F.struct(start.alias("at"), F.array().cast("array<int>").alias("seen"))

    def step(acc: Column, item: Column) -> Column:
        return F.struct(
            F.get(item["f"], acc["at"]).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen")
        )

    return F.aggregate(items, seed, step)["seen"]


def apply_events(events: DataFrame, file: str = "file_name", seq: str = "seq", action: str = "action", chunk: int = CHUNK) -> DataFrame:
    """Add ``from_status``, ``to_status`` and ``is_legal``; ``seq`` is unique per file, null ones are left out.

    Files of up to ``chunk`` events end in one aggregation. Events of the others are ranked within their file,
    so the number of levels follows the largest file and not the sequence numbers, which may be sparse.
    """
    events = events.where(F.col(seq).isNotNull())
    sizes = events.groupBy(file).agg(F.count(F.lit(1)).alias("_events"))
    long = stage(sizes.where(F.col("_events") > chunk), "long-files")
    largest = long.agg(F.max("_events")).first()[0]
    if largest is None:
        return _scan(events.withColumn("_rank", F.lit(0).cast("bigint")), file, seq, action, chunk, 1)
    levels = 1
    while largest > chunk**levels:
        levels += 1
    named = lookup(events.withColumn("_file", F.struct(file)), long.select(F.struct(file).alias("_file"), F.lit(True).alias("_long")), ["_file"])
    short = named.where(F.col("_long").isNull()).drop("_file", "_long").withColumn("_rank", F.lit(0).cast("bigint"))
    ranked = rank_within(named.where("_long").drop("_file", "_long"), file, seq, "_rank")
    return _scan(short, file, seq, action, chunk, 1).unionByName(_scan(ranked, file, seq, action, chunk, levels))


def _scan(events: DataFrame, file: str, seq: str, action: str, chunk: int, levels: int) -> DataFrame:
    """The prefix scan over events with their ``_rank``; with one level the order within a file is that of ``seq`` alone."""
    rest = [c for c in events.columns if c not in (file, seq, "_rank")]
    leaves = events.select(
        F.struct(F.col(file).alias("name")).alias("_file"),
        F.col("_rank").alias("_at"),
        F.col(seq).cast("bigint").alias("_seq"),
        _action_function(F.col(action)).alias("f"),
        F.struct(*rest).alias("_event"),
    )

    # Up: per chunk the ordered parts and the function of the whole chunk.
    groups: list[DataFrame] = []
    level = leaves
    for depth in range(levels):
        part = F.struct("_seq", "f", "_event") if depth == 0 else F.struct("_at", "f")
        grouped = (
            level.groupBy("_file", F.floor(F.col("_at") / chunk).cast("bigint").alias("_chunk"))
            .agg(F.sort_array(F.collect_list(part)).alias("_parts") if depth else F.array_sort(F.collect_list(part), _by_position).alias("_parts"))
        )
        groups.append(grouped)
        level = grouped.select(
            "_file",
            F.col("_chunk").alias("_at"),
            F.aggregate("_parts", _identity(), lambda acc, p: _compose(acc, p["f"])).alias("f"),
        )

    # Down: the start state of every chunk, from the top level to the events.
    start = groups[-1].select("_file", "_chunk", F.lit(0).alias("_start"))
    for depth in range(levels - 1, 0, -1):
        placed = groups[depth].join(start, ["_file", "_chunk"]) if depth < levels - 1 else groups[depth].withColumn("_start", F.lit(0))
        pairs = F.arrays_zip(F.transform("_parts", lambda p: p["_at"]).alias("_chunk"), _prefix(F.col("_parts"), F.col("_start")).alias("_start"))
        start = placed.select("_file", F.inline(pairs).alias("_chunk", "_start"))
    bottom = groups[0].join(start, ["_file", "_chunk"]) if levels > 1 else groups[0].withColumn("_start", F.lit(0))
    pairs = F.arrays_zip(F.col("_parts").alias("_part"), _prefix(F.col("_parts"), F.col("_start")).alias("_before"))
    rows = bottom.select("_file", F.inline(pairs).alias("_part", "_before"))
    names = F.lit(list(STATES))
    after = _state(F.col("_before"), F.col("_part.f"))
    return rows.select(
        F.col("_file.name").alias(file),
        F.col("_part._seq").alias(seq),
        *[F.col(f"_part._event.{c}").alias(c) for c in rest],
        F.get(names, F.col("_before")).alias("from_status"),
        F.get(names, after).alias("to_status"),
        (after != F.col("_before")).alias("is_legal"),
    )


def _by_position(a: Column, b: Column) -> Column:
    return F.when(a["_seq"] < b["_seq"], -1).when(a["_seq"] > b["_seq"], 1).otherwise(0)


def new_uploads(uploads: DataFrame, registered: DataFrame) -> DataFrame:
    """Uploads not yet registered under the same name and checksum, each content once.

    A name that is taken by other content, registered or uploaded earlier in this batch,
    gets its time stamp appended.
    """
    fresh = uploads.join(registered.select("file_name", "checksum"), ["file_name", "checksum"], "left_anti")
    once = Window.partitionBy("file_name", "checksum").orderBy("uploaded_at")
    fresh = fresh.withColumn("_rank", F.row_number().over(once)).where(F.col("_rank") == 1).drop("_rank")
    taken = registered.select("file_name").distinct().withColumn("_taken", F.lit(True))
    earliest = fresh.groupBy("file_name").agg(F.min(F.struct("uploaded_at", "checksum")).alias("_earliest"))
    stamp = F.date_format("uploaded_at", "yyyyMMdd_HHmmss")
    stem = F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 1)
    suffix = F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 2)
    clash = F.col("_taken").isNotNull() | (F.col("_earliest.checksum") != F.col("checksum"))
    return (
        fresh.join(taken, "file_name", "left")
        .join(earliest, "file_name")
        .withColumn("stored_name", F.when(clash, F.concat(stem, F.lit("_"), stamp, suffix)).otherwise(F.col("file_name")))
        .drop("_taken", "_earliest")
    )


def registry(history: DataFrame) -> DataFrame:
    """Current state per file from events with applied states (see ``apply_events``).

    Upload time is the first legal event, the review fields come from the last one.
    """
    legal = history.where("is_legal")
    last = F.max_by(F.struct("to_status", "actor", "at", "action"), "seq")
    return (
        legal.groupBy("file_name")
        .agg(last.alias("_last"), F.min("seq").alias("uploaded_seq"), F.min("at").alias("uploaded_at"), F.count(F.lit(1)).alias("n_events"))
        .select(
            "file_name",
            F.col("_last.to_status").alias("status"),
            "uploaded_seq",
            "uploaded_at",
            F.when(F.col("_last.action") != "upload", F.col("_last.actor")).alias("reviewed_by"),
            F.when(F.col("_last.action") != "upload", F.col("_last.at")).alias("reviewed_at"),
            "n_events",
        )
    )


def with_status(registered: DataFrame, *statuses: str) -> DataFrame:
    return registered.where(F.col("status").isin(*statuses))


def pending(registered: DataFrame, include_held: bool = False) -> DataFrame:
    return with_status(registered, "pending", "held") if include_held else with_status(registered, "pending")


def oldest_first(registered: DataFrame) -> DataFrame:
    return registered.orderBy("uploaded_at", "file_name")


def status_counts(registered: DataFrame) -> DataFrame:
    counted = registered.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATES[1:]]
    )
    return counted.withColumns(
        {
            "in_verified": F.col("approved") + F.col("promoted"),
            "in_unverified": F.col("rejected") + F.col("revoked"),
            "needs_review": F.col("pending") + F.col("held"),
        }
    )


def audit_history(history: DataFrame) -> DataFrame:
    """Who moved which file from where to where, numbered per file by event order."""
    return history.where("is_legal").select(
        "file_name", "seq", "action", F.col("actor").alias("by"), "at", "from_status", "to_status"
    )


def tiers(registered: DataFrame) -> DataFrame:
    """(file_name, tier): which library a file may feed."""
    tier = F.when(F.col("status").isin("approved", "promoted"), "verified").when(
        F.col("status").isin("rejected", "revoked"), "unverified"
    )
    return registered.select("file_name", tier.alias("tier")).where(F.col("tier").isNotNull())
