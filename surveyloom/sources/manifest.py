"""Which files have been ingested, by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.sources.inspect import inspect_files
from surveyloom.sources.tables import base_name, is_supported, list_files

MANIFEST_SCHEMA = "file_name string, checksum string, total_rows long, pair_count long, ingested_at timestamp"


def checksum(content: Column) -> Column:
    """'sha256:' and the first 16 hex digits."""
    return F.concat(F.lit("sha256:"), F.left(F.sha2(content, 256), F.lit(16)))


def folder_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, checksum, length) of the supported files of a folder, read as streams by the executors."""
    found = inspect_files(spark, [p for p in list_files(spark, path) if is_supported(p)], checksums=True)
    return found.select(base_name("path").alias("file_name"), "checksum", "length")


def file_status(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each current file with NEW, MODIFIED or UNCHANGED."""
    known = manifest.select("file_name", F.col("checksum").alias("_known"))
    status = (
        F.when(F.col("_known").isNull(), "NEW").when(F.col("_known") != F.col("checksum"), "MODIFIED").otherwise("UNCHANGED")
    )
    return current.join(known, "file_name", "left").withColumn("status", status).drop("_known")


def unseen(current: DataFrame, manifest: DataFrame) -> DataFrame:
    return file_status(current, manifest).where(F.col("status") != "UNCHANGED")


def updated_manifest(manifest: DataFrame, ingested: DataFrame) -> DataFrame:
    """Manifest after a run: entries of re-read files are replaced."""
    return manifest.join(ingested.select("file_name"), "file_name", "left_anti").unionByName(ingested)
