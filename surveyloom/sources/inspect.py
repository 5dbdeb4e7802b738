"""What files hold, found by the executors: header, line breaks in cells, faults, digest.

Paths are rows of a table; a task opens its files as streams and reads them in pieces of BUFFER bytes, so
a file of any size takes little memory. File systems that workers have no client for are read through
Spark's binaryFile source instead, where a file is one value.
"""

from __future__ import annotations

import bz2
import codecs
import csv
import hashlib
import io
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from typing import BinaryIO
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.session import stage

BUFFER, HEAD_BUFFER = 1 << 20, 1 << 16
#: Longest header line; a file without a line break in so many bytes is reported as failed.
MOST_HEADER = 1 << 24
FILES_PER_TASK = 64
#: Bytes a task reads where the lengths of files are known, an opened file counting as OPEN_COST more.
TASK_BYTES, OPEN_COST = 128 << 20, 1 << 16
# The supported file types.
SUFFIX = re.compile(r"\.(csv|tsv)(?:\.(gz|bz2|zst|deflate))?$", re.I)
SCHEMA = "path string, status string, error string, columns array<string>, multi_line boolean, checksum string, length long"
#: Schemes that workers open by themselves, and those that they know by another name.
_KNOWN = {"": None, "file": None, "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}


class Unreadable(OSError):
    """The content is broken."""


def separator(path: str) -> str:
    found = SUFFIX.search(path)
    return "\t" if found and found[1].lower() == "tsv" else ","


def plain_path(path: str) -> str:
    """A path as files are named by throughout: local ones without scheme, others as they are."""
    return re.sub("^file:/+", "/", path)


def metadata_path() -> Column:
    """The same name from the URI in a reader's metadata."""
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(uri, "^file:/+", "/")


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A worker's own client for a path, and the path's name there."""
    scheme = urlsplit(path).scheme
    if scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), plain_path(path)
    return pyarrow.fs.FileSystem.from_uri(_KNOWN[scheme] + path[len(scheme) :])


def has_client(path: str) -> bool:
    return urlsplit(path).scheme in _KNOWN


def _open(path: str) -> BinaryIO:
    if urlsplit(path).scheme in ("", "file"):
        return open(plain_path(path), "rb")
    system, inner = file_system(path)
    return system.open_input_stream(inner, compression=None)  # bytes as stored


def _pieces(stream: BinaryIO, size: int = BUFFER) -> Iterator[bytes]:
    while piece := stream.read(size):
        yield bytes(piece)


def _unpacked(pieces: Iterator[bytes], codec: str | None) -> Iterator[bytes]:
    """The plain bytes; ``Unreadable`` where the compressed stream is broken or ends early."""
    if codec is None:
        yield from pieces
        return
    make: dict[str, Callable] = {
        "gz": lambda: zlib.decompressobj(wbits=31), "deflate": lambda: zlib.decompressobj(), "bz2": bz2.BZ2Decompressor,
        "zst": lambda: zstandard.ZstdDecompressor().decompressobj(),
    }
    opened, whole, any_bytes = None, True, False
    try:
        for piece in pieces:
            any_bytes = True
            while piece:  # members of a file may follow each other
                if opened is None:
                    opened, whole = make[codec](), False
                yield opened.decompress(piece)
                piece = b""
                if opened.eof:
                    piece, opened, whole = opened.unused_data, None, True
    except (zlib.error, OSError, EOFError, zstandard.ZstdError) as error:
        raise Unreadable(f"unreadable: {error}") from error
    if any_bytes and not whole:
        raise Unreadable("unreadable: the compressed stream ends early")


class _Reader:
    """Takes a file's plain bytes piece by piece."""

    def __init__(self):
        self.head = bytearray()
        self.ended = self.quoted = self.multi_line = False
        self.size = 0

    def take(self, piece: bytes) -> None:
        self.size += len(piece)
        if not self.ended:
            self.head += piece
            cut = _line_end(self.head)
            if cut >= 0:
                self.ended = True
                del self.head[cut:]
            elif len(self.head) > MOST_HEADER:
                raise Unreadable(f"no header within {MOST_HEADER} bytes")
        if not self.multi_line:
            parts = piece.split(b'"')
            inside = parts[0 if self.quoted else 1 :: 2]
            self.multi_line = any(b"\n" in p or b"\r" in p for p in inside)
            self.quoted ^= len(parts) % 2 == 0

    def columns(self, sep: str) -> list[str]:
        text = self.head.decode("utf-8", "replace").removeprefix("\ufeff").rstrip("\r\n")
        lines = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
        return [c.strip() for c in next(lines, [])]


def _line_end(head: bytes) -> int:
    """Place after the first line break outside quotes, or -1."""
    quoted, at = False, 0
    for part in re.finditer(rb'"|\r\n|\n|\r', head):
        if part[0] == b'"':
            quoted = not quoted
        elif not quoted:
            at = part.end()
            return at
    return -1


def facts(path: str, pieces: Iterator[bytes], checksum: bool, whole: bool = True) -> tuple:
    """A row of SCHEMA for one file from its raw bytes; unless ``whole``, these are read up to the end of the header."""
    codec = (SUFFIX.search(path) or [None] * 3)[2]
    digest, length, reader = hashlib.sha256(), 0, _Reader()

    def counted() -> Iterator[bytes]:
        nonlocal length
        for piece in pieces:
            length += len(piece)
            if checksum:
                digest.update(piece)
            yield piece

    raw = counted()
    try:
        for piece in _unpacked(raw, codec and codec.lower()):
            reader.take(piece)
            if reader.ended and not whole:
                break
        status, error = ("success" if reader.size else "empty"), None
    except Unreadable as broken:
        status, error = "failed", str(broken)[:500]
        for _ in raw:  # the digest is that of the whole file
            pass
    columns = []
    if status == "success":
        try:
            columns = reader.columns(separator(path))
        except csv.Error as broken:
            status, error = "failed", f"unreadable header: {broken}"
    return path, status, error, columns, reader.multi_line, f"sha256:{digest.hexdigest()[:16]}" if checksum else None, length


def _fault(path: str, error: Exception) -> tuple:
    missing = isinstance(error, FileNotFoundError) or "NotFound" in type(error).__name__
    return path, "missing" if missing else "failed", str(error).splitlines()[-1][:500] if str(error) else type(error).__name__, [], False, None, 0


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "status", "error", "columns", "multi_line", "checksum", "length"])


def _listed(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, int, list[str]]:
    """Paths that workers open by themselves as a table, the tasks for them, and the other paths."""
    paths = sorted({plain_path(p) for p in paths})
    own, other = [p for p in paths if has_client(p)], [p for p in paths if not has_client(p)]
    tasks = max(1, min(-(-len(own) // FILES_PER_TASK), 100_000), min(len(own), spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(p,) for p in own], "path string"), tasks, other


def _from_table(paths: DataFrame) -> tuple[DataFrame, int, list[str]]:
    """The same of a table; only paths that Spark has to read come to the driver, which lists them."""
    plain = F.regexp_replace("path", "^file:/+", "/").alias("path")
    once = paths.groupBy(plain).agg(F.max("length").alias("length"))
    known = F.lower(F.regexp_extract("path", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin(*_KNOWN)
    size = once.where(known).agg(F.coalesce(F.sum(F.col("length") + OPEN_COST), F.lit(0))).first()[0]
    other = sorted(r["path"] for r in once.where(~known).select("path").collect())
    tasks = max(paths.sparkSession.sparkContext.defaultParallelism, min(-(-size // TASK_BYTES), 100_000))
    return once.where(known).select("path"), tasks, other


def inspect_files(spark: SparkSession, paths: Sequence[str] | DataFrame, checksums: bool = False, whole: bool = True) -> DataFrame:
    """One row per path, in the columns of SCHEMA; stored. Unless ``whole`` only headers are read, and other facts are those of the bytes read.

    status is success, empty, missing or failed (with the error). Compressed files are read to their
    end, which alone shows that they are whole; multi_line tells whether a quoted cell holds a line
    break. Checksums are those of the bytes as stored. A path given twice is one row. Very many paths come
    as a stored table (path, length), which doesn't pass through the driver.
    """
    listed, tasks, other = _from_table(paths) if isinstance(paths, DataFrame) else _listed(spark, paths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path in b["path"]:
                try:
                    with _open(path) as stream:
                        out.append(facts(path, _pieces(stream, BUFFER if whole else HEAD_BUFFER), checksums, whole))
                except Exception as error:  # noqa: BLE001  the reason goes into the table
                    out.append(_fault(path, error))
            yield _frame(out)

    found = listed.repartition(tasks).mapInPandas(run, SCHEMA)
    return stage(found.unionByName(_through_spark(spark, other, checksums)) if other else found, "files")


def _contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of the files that exist, a file being one value."""
    asked = spark.createDataFrame([(p,) for p in paths], "path string")
    folders = sorted({p.rsplit("/", 1)[0] for p in paths})
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(folders)
    return files.select(metadata_path().alias("path"), "content").join(asked, "path", "left_semi")


def _through_spark(spark: SparkSession, paths: list[str], checksums: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frame([facts(p, iter([c]), checksums) for p, c in zip(b["path"], b["content"])])

    known = stage(_contents(spark, paths).mapInPandas(run, SCHEMA), "files")
    absent = spark.createDataFrame([(p,) for p in paths], "path string").join(known, "path", "left_anti")
    gone = absent.selectExpr(
        "path", "'missing' AS status", "'no such file' AS error", "array() AS columns", "false AS multi_line", "CAST(NULL AS string) AS checksum", "0L AS length"
    )
    return known.unionByName(gone.withColumn("columns", F.col("columns").cast("array<string>")))


def _lines(pieces: Iterator[bytes]) -> Iterator[str]:
    decoder, rest = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for piece in pieces:
        *lines, rest = (rest + decoder.decode(piece)).split("\n")
        yield from (line + "\n" for line in lines)
        if len(rest) > MOST_HEADER:
            raise Unreadable(f"no line break within {MOST_HEADER} characters")
    if rest:
        yield rest


def head(path: str, pieces: Iterator[bytes], columns: Sequence[str], rows: int) -> list[list[str | None]]:
    """Cells of the first ``rows`` rows of a file, columns found by its header; no more is read than holds them."""
    codec = (SUFFIX.search(path) or [None] * 3)[2]
    reader = csv.reader(_lines(_unpacked(pieces, codec and codec.lower())), delimiter=separator(path))
    names = [c.removeprefix("\ufeff").strip() for c in next(reader, [])]
    place = {c: names.index(c) for c in columns if c in names}
    cell = lambda line, c: (line[place[c]] or None) if c in place and place[c] < len(line) else None
    return [[cell(line, c) for c in columns] for line in islice(filter(None, reader), rows)]


def file_heads(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], rows: int) -> DataFrame:
    """(row_id, ``columns``, source_path): the first rows of every file as text, numbered from 0 in each.

    A task per few files reads them as streams and stops after the rows: what is read doesn't grow with
    the files, and nothing is sorted. Files that can't be read have no rows; ``inspect_files`` says why.
    """
    listed, tasks, other = _listed(spark, paths)

    def frame(path: str, pieces: Iterator[bytes]) -> list[tuple]:
        return [(i, path, cells) for i, cells in enumerate(head(path, pieces, columns, rows))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, path in enumerate(b["path"]):
                found: list[tuple] = []
                try:
                    if "content" in b:
                        found = frame(path, iter([b["content"].iloc[i]]))
                    else:
                        with _open(path) as stream:
                            found = frame(path, _pieces(stream, HEAD_BUFFER))
                except (OSError, csv.Error, pa.ArrowException):
                    pass  # reported by inspect_files
                yield pd.DataFrame(found, columns=["row_id", "source_path", "cells"])

    schema = "row_id long, source_path string, cells array<string>"
    found = listed.repartition(tasks).mapInPandas(run, schema)
    if other:
        found = found.unionByName(_contents(spark, other).mapInPandas(run, schema))
    return found.select("row_id", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)], "source_path")
