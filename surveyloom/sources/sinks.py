"""Writing tables."""

from __future__ import annotations

import csv
import gzip
import io
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.session import drop_staged, scratch_path, stage
from surveyloom.sources.inspect import BUFFER, file_system, has_client, metadata_path, plain_path

FILES_PER_FOLDER = 1000


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()
) -> str:
    """Parquet, CSV/TSV with header, or JSON lines; every task writes its own files."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt in ("csv", "tsv"):
        (
            writer.option("header", True)
            .option("sep", "," if fmt == "csv" else "\t")
            .option("extension", fmt)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    elif fmt == "json":
        writer.json(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_library(df: DataFrame, path: str) -> str:
    """A library sorted by name: range-partitioned, so reads by name touch few files."""
    return write_table(df.orderBy("name"), path)


def snapshot(df: DataFrame, path: str) -> str:
    """The untouched input, kept before any change."""
    return write_table(df, path, mode="error")


def write_texts(files: DataFrame, root: str) -> DataFrame:
    """One file per row of (file_name, text), the text and a line end; (path, length) of the files, stored.

    Tasks write files by themselves, as a commit by Spark moves every file through the driver. Folders are those of
    one task attempt, so the paths of a lost attempt are in no result, and a name may repeat. Where workers have
    no client for the file system, Spark writes a folder per name (file_name=...).
    """
    spark = files.sparkSession
    if not has_client(root):
        files.repartition("file_name").write.partitionBy("file_name").text(root)
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(metadata_path().alias("path"), "length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = file_system(root)
        attempt, folders, here, names = TaskContext.get().taskAttemptId(), 0, "", set()
        for b in batches:
            out = []
            for name, text in zip(b["file_name"], b["text"]):
                if not names or len(names) >= FILES_PER_FOLDER or name in names:
                    here, folders, names = f"{attempt}/{folders}", folders + 1, set()
                    system.create_dir(f"{top}/{here}", recursive=True)
                names.add(name)
                content = ((text or "") + "\n").encode()
                with system.open_output_stream(f"{top}/{here}/{name}", compression=None) as stream:
                    stream.write(content)
                out.append((f"{root}/{here}/{name}", len(content)))
            yield pd.DataFrame(out, columns=["path", "length"])

    return stage(files.select("file_name", "text").mapInPandas(run, "path string, length long"), "written")


def write_file(df: DataFrame, path: str, columns: Sequence[str], order: str) -> str:
    """One comma-separated file of ``columns`` with a header, whatever the size of ``df``, its rows in the order of a column; packed where the path ends in .gz.

    Ranges of the order are sorted and written by a task each, and one task strings their bytes together, piece by
    piece. Workers need a client for the file system.
    """
    if not has_client(path):
        raise ValueError(f"workers have no client for {path}")
    spark, packed = df.sparkSession, path.lower().endswith(".gz")
    parts = scratch_path(spark, "parts")
    options = {"compression": "gzip"} if packed else {}
    ranges = df.repartitionByRange(order).sortWithinPartitions(order).select(*columns)
    ranges.write.options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options).csv(parts)
    line = io.StringIO()
    csv.writer(line, lineterminator="\n").writerow(columns)
    header = gzip.compress(line.getvalue().encode()) if packed else line.getvalue().encode()  # members of a gzip file follow each other

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for target in b["path"]:
                system, name = file_system(target)
                folder, base = name.rsplit("/", 1)
                found, source = file_system(parts)
                mine = f"{folder}/.{base}.{TaskContext.get().taskAttemptId()}"
                system.create_dir(folder, recursive=True)
                listed = sorted(f.path for f in found.get_file_info(pyarrow.fs.FileSelector(source)) if f.base_name.startswith("part-"))
                with system.open_output_stream(mine, compression=None) as out:
                    out.write(header)
                    for part in listed:
                        with found.open_input_stream(part, compression=None) as stream:
                            while piece := stream.read(BUFFER):
                                out.write(piece)
                for stale in system.get_file_info([name, f"{folder}/.{base}.crc"]):
                    if stale.type == pyarrow.fs.FileType.File:
                        system.delete_file(stale.path)
                system.move(mine, name)
            yield b

    spark.createDataFrame([(path,)], "path string").coalesce(1).mapInPandas(run, "path string").collect()
    drop_staged(spark, [parts])
    return plain_path(path)
