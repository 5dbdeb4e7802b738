"""Reading tables: delimited files, folders, record batches, libraries. Everything arrives as text."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from surveyloom.sources.inspect import SUFFIX, inspect_files, metadata_path

# The supported file types and the six fields of a record.
EXTENSIONS = (".csv", ".tsv")
RECORD_FIELDS = ("farmer_name", "father_or_spouse", "contact_number", "mgnrega_card", "gender", "category")
PROFILE_ROWS = 500
CORRUPT = "_corrupt_record"


def string_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def is_supported(path: str) -> bool:
    return SUFFIX.search(path) is not None


def base_name(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _by_name(spark: SparkSession, paths: list[str], sep: str, layout: tuple[str, ...], columns: Sequence[str], **options: str) -> DataFrame:
    """Files of one layout: columns are found by their header, missing ones are null, others are not read."""
    names, seen = [], set()
    for i, name in enumerate(layout):
        names.append(name if name and name not in seen else f"_unnamed_{i}")
        seen.add(name)
    table = (
        spark.read.option("header", True).option("sep", sep).option("escape", '"').option("columnNameOfCorruptRecord", CORRUPT)
        .options(**{"mode": "PERMISSIVE", **options}).schema(string_schema([*names, CORRUPT])).csv(paths)
    )
    chosen = [(F.col(f"`{c}`") if c in names else F.lit(None).cast("string")).alias(c) for c in columns]
    named = table.select(*chosen, CORRUPT, metadata_path().alias("source_path"))
    return named.select(*columns, CORRUPT, base_name("source_path").alias("source_file"), "source_path")


def _layouts(found: DataFrame) -> list[tuple[tuple[str, ...], bool, list[str]]]:
    """(columns, multi_line, paths) of the readable files: a row per distinct layout, whatever the number of files."""
    good = found.where("status = 'success'").groupBy("columns", "multi_line").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return sorted((tuple(r["columns"]), r["multi_line"], r["paths"]) for r in good.collect())


def read_inspected(spark: SparkSession, found: DataFrame, columns: Sequence[str], **options: str) -> DataFrame:
    """All readable files of ``inspect_files`` as one table: ``columns``, ``_corrupt_record``, source_file and source_path.

    One reader per distinct layout. Files with line breaks in quoted cells are read whole by a task each,
    others are split. Further options go to the readers.
    """
    frames = []
    for sep in (",", "\t"):
        mine = found.where(F.col("path").rlike(r"(?i)\.tsv(\.[a-z0-9]+)?$") == (sep == "\t"))
        frames += [_by_name(spark, paths, sep, layout, columns, **({"multiLine": "true"} if multi else {}) | options) for layout, multi, paths in _layouts(mine)]
    if not frames:
        return spark.createDataFrame([], string_schema([*columns, CORRUPT, "source_file", "source_path"]))
    table = frames[0]
    for frame in frames[1:]:
        table = table.unionByName(frame)
    return table


class FileSet(NamedTuple):
    rows: DataFrame
    outcomes: DataFrame


def read_file_set(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], **options: str) -> FileSet:
    """Rows of all readable files and the outcome of every supported one.

    Files are told apart by their full path (source_path); base names may repeat. A broken, empty or
    missing file stops no other and is never cut short in silence.
    """
    found = inspect_files(spark, [p for p in paths if is_supported(p)])
    return FileSet(read_inspected(spark, found, columns, **options), outcomes(found))


def outcomes(found: DataFrame) -> DataFrame:
    """(source_path, source_file, status, error) per file: success, empty, missing or failed."""
    return found.select(F.col("path").alias("source_path"), base_name("path").alias("source_file"), "status", "error")


def _delimited(spark: SparkSession, paths: str | list[str], sep: str, columns: Sequence[str] | None, **options: str) -> DataFrame:
    if columns is None:
        return spark.read.option("header", True).option("sep", sep).option("escape", '"').options(**options).csv(paths)
    listed = [f for p in ([paths] if isinstance(paths, str) else paths) for f in list_files(spark, p)]
    found = inspect_files(spark, listed)
    failed = found.where("status IN ('failed', 'missing')").orderBy("path").first()
    if failed:
        raise OSError(f"{failed['path']}: {failed['error']}")
    split = lambda layout: layout if sep == "," or len(layout) != 1 else tuple(c.strip() for c in next(csv.reader([layout[0]], delimiter=sep)))
    frames = [
        _by_name(spark, files, sep, split(layout), columns, **({"multiLine": "true"} if multi else {}) | options).select(*columns) for layout, multi, files in _layouts(found)
    ]
    table = frames[0] if frames else spark.createDataFrame([], string_schema(columns))
    for frame in frames[1:]:
        table = table.unionByName(frame)
    return table


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Data files of a folder, or the file itself; hidden files and subfolders are left out."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    files = [(f.getPath().getName(), f.getPath().toString()) for f in listed if f.isFile()]
    return sorted(p for name, p in files if not name.startswith(("_", ".")))


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, **options: str) -> DataFrame:
    """Comma-separated text. ``columns`` are found by header in every file, whatever its order of columns."""
    return _delimited(spark, path, ",", columns, **options)


def read_tsv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, **options: str) -> DataFrame:
    return _delimited(spark, path, "\t", columns, **options)


def read_files(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], **options: str) -> DataFrame:
    """Many files as one table tagged with ``source_file`` and ``source_path``; unsupported, missing and broken ones are left out, see ``read_file_set``.

    Broken lines keep their text in ``_corrupt_record``.
    """
    return read_file_set(spark, paths, columns, **options).rows


def read_folder(spark: SparkSession, path: str, columns: Sequence[str], **options: str) -> DataFrame:
    """All supported files of a folder, tagged by file, whatever the case of their endings."""
    return read_files(spark, list_files(spark, path), columns, **options)


def profile_rows(df: DataFrame, row_id: str = "row_id", rows: int = PROFILE_ROWS) -> DataFrame:
    """The first rows, every column as text: the bounded sample a profile looks at."""
    return df.orderBy(row_id).limit(rows).select(
        row_id, *[F.col(c).cast("string").alias(c) for c in df.columns if c != row_id]
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of the six record fields; missing fields count as blank."""
    records = spark.read.schema(string_schema(RECORD_FIELDS)).json(path)
    return records.fillna("", list(RECORD_FIELDS))


def with_row_ids(df: DataFrame, row_id: str = "row_id", order: Sequence[str] = ()) -> DataFrame:
    """Contiguous row ids from 0 without gathering rows in one task.

    Partitions are counted first (one row per partition), their offsets are added to the
    position inside the partition. Store the result before using it twice: the ids follow
    the physical layout of the input.
    """
    placed = df.withColumn("_pos", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_pos", 33))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part long, _offset long")
    return (
        placed.join(F.broadcast(table), "_part")
        .withColumn(row_id, F.col("_offset") + F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_pos", "_offset")
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for a small input that arrives in fewer partitions than there are cores.

    A large input has more splits than that and is returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


STRICT_SCHEMA = "name string, gender string, count long, n_files long"
PROB_SCHEMA = (
    "name string, gender string, confidence double, male_count long, female_count long, total long, n_files long"
)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one of the same schema where none has been written. A table that can't be read is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(schema).fields])


def load_library(spark: SparkSession, strict_path: str, prob_path: str) -> tuple[DataFrame, DataFrame]:
    """(strict, prob) without overlap."""
    strict = read_or_empty(spark, strict_path, STRICT_SCHEMA)
    prob = read_or_empty(spark, prob_path, PROB_SCHEMA)
    return strict, prob.join(strict.select("name"), "name", "left_anti")
