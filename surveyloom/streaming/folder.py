"""Folder streams: continuous runs and a streaming newest-per-key table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from surveyloom.functions.temporal import parse_date
from surveyloom.plans.context import Context
from surveyloom.plans.survey import SurveyConfig, merged_table, review_table, run_survey, with_stored_trail
from surveyloom.session import drop_staged, stage, staged_paths
from surveyloom.sources.inspect import inspect_files, plain_path
from surveyloom.sources.sinks import write_table
from surveyloom.sources.tables import exists, is_supported, outcomes, read_inspected, string_schema, with_row_ids

FILES_PER_BATCH = 1000
#: Row ids of a batch start at its number shifted by so many bits, so that they differ between batches.
ROW_BITS = 40


def folder_stream(
    spark: SparkSession, path: str, columns: Sequence[str], archive: str | None = None, files_per_batch: int = FILES_PER_BATCH, sep: str = ","
) -> DataFrame:
    """New delimited files of a folder as they arrive, tagged by file; processed files can be archived.

    A stream has one layout: files with other columns or another order of them fail the query, as
    their header is checked. ``process_folder`` reads every file by its own header instead.
    """
    reader = spark.readStream.schema(string_schema(columns)).option("header", True).option("sep", sep).option("escape", '"')
    reader = reader.option("enforceSchema", False).option("pathGlobFilter", "*.[cCtT][sS][vV]*")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(path).withColumn("source_file", F.col("_metadata.file_name")).withColumn(
        "source_path", F.col("_metadata.file_path")
    )


def _trigger(every: str | None) -> dict[str, object]:
    return {"processingTime": every} if every else {"availableNow": True}


def arrivals(spark: SparkSession, path: str, archive: str | None = None, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Paths of new delimited files of a folder, whatever their columns: a row per file, whose content is not read."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    reader = reader.option("pathGlobFilter", "*.[cCtT][sS][vV]*").option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path).select(F.col("_metadata.file_path").alias("source_path"))


LEDGER_SCHEMA = "source_path string, status string, error string, attempts int, next_try timestamp, batch_id string"
#: Longest wait between two tries of an unreadable file.
MOST_WAIT = 86_400


def ledger(spark: SparkSession, out: str, but: int | None = None) -> DataFrame:
    """(source_path, status, error, attempts, next_try): the last try of every file that was ever unreadable, leaving out a batch."""
    if not exists(spark, f"{out}/ledger"):
        return spark.createDataFrame([], LEDGER_SCHEMA).drop("batch_id")
    tries = spark.read.schema(LEDGER_SCHEMA).parquet(f"{out}/ledger")
    if but is not None:
        tries = tries.where(F.col("batch_id") != str(but))
    last = tries.groupBy("source_path").agg(F.max_by(F.struct("status", "error", "attempts", "next_try"), "attempts").alias("last"))
    return last.select("source_path", "last.*")


def due(spark: SparkSession, out: str, most: int = FILES_PER_BATCH, but: int | None = None) -> list[str]:
    """Unreadable files whose next try has come, the longest overdue first; the rest waits for the next poll."""
    waiting = ledger(spark, out, but).where("status = 'failed' AND next_try <= current_timestamp()")
    return [r["source_path"] for r in waiting.orderBy("next_try", "source_path").limit(most).collect()]


def _tried(states: DataFrame, before: DataFrame, retry_seconds: float) -> DataFrame:
    """Ledger entries of a batch: files that are unreadable, or were. The wait doubles with every try."""
    old = before.select("source_path", F.col("attempts").alias("_attempts"))
    entries = states.join(old, "source_path", "left").where((F.col("status") == "failed") | F.col("_attempts").isNotNull())
    attempts = (F.coalesce(F.col("_attempts"), F.lit(0)) + 1).cast("int")
    wait = F.least(F.lit(float(MOST_WAIT)), F.lit(float(retry_seconds)) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(30))))
    return entries.select("source_path", "status", "error", attempts.alias("attempts"), F.timestamp_seconds(F.unix_timestamp() + wait).alias("next_try"))


def process_folder(
    stream: DataFrame, config: SurveyConfig, out: str, checkpoint: str, every: str | None = None, context: Context = Context(),
    columns: Sequence[str] | None = None, retry_seconds: float = 0.0,
) -> StreamingQuery:
    """Run the whole survey plan on every batch of new files, each file on its own.

    ``stream`` has a column source_path, as ``arrivals`` and ``folder_stream`` give; the files are read
    by their headers, ``columns`` being those wanted (by default the other ones of ``stream``). Files are
    known by their full path. The checkpoint makes each file count once; a content manifest also skips copies
    of a file under another name. Outputs go to one folder per batch id, so a batch replayed
    after a failure overwrites what it had written.

    An unreadable file is listed in ``outcomes`` and holds up no other one. The ledger keeps it, and it is
    read again on the next poll after ``retry_seconds`` (doubled with every try), whether it arrives anew
    or not: with ``every`` each poll joins the files that are due to the arrivals, without it a call first
    reads those (in batches with negative ids). Any other failure stops the query and its batch is
    replayed on restart.
    """
    spark = stream.sparkSession
    wanted = list(columns or [c for c in stream.columns if c not in ("source_file", "source_path")])
    each = replace(config, scope=("source_path",))

    def take(paths: list[str], batch_id: int) -> None:
        found = inspect_files(spark, [p for p in paths if is_supported(p)], checksums=True)
        states = outcomes(found)
        first = found.where("status = 'success'").groupBy("checksum").agg(F.min("path").alias("source_path"))
        if exists(spark, f"{out}/manifest"):
            seen = spark.read.schema("checksum string, batch_id string").parquet(f"{out}/manifest").where(F.col("batch_id") != str(batch_id)).select("checksum")
            first = first.join(seen, "checksum", "left_anti")
        first = stage(first, "new-content")
        new = found.join(first.select(F.col("source_path").alias("path")), "path", "left_semi")
        fresh = read_inspected(spark, new, wanted).select(*wanted, "source_file", "source_path")
        numbered = with_row_ids(fresh, each.row_id).withColumn(each.row_id, F.col(each.row_id) + F.lit(batch_id * (1 << ROW_BITS)))
        result = run_survey(stage(numbered, "numbered"), each, context)
        kept = with_stored_trail(result)
        tried = stage(_tried(states, ledger(spark, out, batch_id), retry_seconds), "tried")
        for name, table in (
            ("cleaned", kept.data), ("merged", merged_table(kept, each, context)), ("review", review_table(kept, each)),
            ("changes", result.changes), ("spell_changes", result.spell_changes), ("date_issues", result.date_issues),
            ("placeholders", result.placeholders), ("outcomes", states), ("manifest", first),
        ):
            write_table(table, f"{out}/{name}/batch_id={batch_id}")
        if not tried.isEmpty():  # last, as it settles what is read again
            write_table(tried, f"{out}/ledger/batch_id={batch_id}")

    def run(batch: DataFrame, batch_id: int) -> None:
        with staged_paths() as made:
            arrived = {plain_path(unquote(r[0])) for r in batch.select("source_path").distinct().collect() if r[0]}
            paths = sorted(arrived | set(due(spark, out, but=batch_id)))
            if paths:
                take(paths, batch_id)
        drop_staged(spark, made)

    if every:
        beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.lit(None).cast("string").alias("source_path"))
        stream = stream.select("source_path").unionByName(beat)
    else:
        waiting = due(spark, out)
        if waiting:
            with staged_paths() as made:
                take(sorted(waiting), -1 - _passes(spark, out))
            drop_staged(spark, made)
    return (
        stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()
    )


def _passes(spark: SparkSession, out: str) -> int:
    """Batches with negative ids on record; one that was lost before its ledger entry keeps its number."""
    found = spark.read.schema(LEDGER_SCHEMA).parquet(f"{out}/ledger").where(F.col("batch_id").startswith("-"))
    return found.select("batch_id").distinct().count()


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest_per_key_stream(stream: DataFrame, key: str, date: str, checkpoint: str, row_id: str = "row_id", every: str | None = None) -> StreamingQuery:
    """Keep the newest record per key over all batches so far, as keyed state.

    The newest row is the smallest of (date unreadable, age, row id, columns), an aggregate with partial
    results before the shuffle. Its state lives in RocksDB under the checkpoint, addressed by key: a batch
    touches the keys it holds and writes their change only, and ``current_state`` reads one row per key however
    many batches there were. The number of shuffle partitions of the first run stays that of the state.
    """
    spark = stream.sparkSession
    stamp = parse_date(F.col(date))
    order = F.struct(
        stamp.isNull().alias("undated"), (-F.unix_micros(stamp)).alias("age"), F.col(row_id).alias("row_id"),
        F.struct(*[F.col(c) for c in stream.columns]).alias("row"),
    )
    newest = stream.groupBy(key).agg(F.min(order).alias("newest"))
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return newest.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def current_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The newest record of every key, read from the state as of the last finished batch."""
    return spark.read.format("statestore").load(checkpoint).select("value.min.row.*")
