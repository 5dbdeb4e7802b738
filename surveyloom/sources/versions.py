"""Sets of tables that change together.

Every release writes its tables to a folder of its own and becomes visible by one commit record, which
names the folder of each table, also of those taken over from the release before. A record is created
under a number of its own and never changed, so readers see one release or the next, and of two
writers that start from the same release the later one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from surveyloom.sources.tables import exists, read_or_empty

COMMITS = "_commits"
#: Age after which a folder that no record names counts as left behind by a lost writer.
ORPHAN_HOURS = 24


class Version(NamedTuple):
    """A release: its number (0 before the first) and the path of every table below the root."""

    root: str
    number: int
    tables: dict[str, str]


class Conflict(RuntimeError):
    """Another release was committed since the one that this one started from."""


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _record(root: str, number: int) -> str:
    return f"{root}/{COMMITS}/{number:012d}"


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the releases on record, ascending."""
    if not exists(spark, f"{root}/{COMMITS}"):
        return []
    place, fs = _fs(spark, f"{root}/{COMMITS}")
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    return sorted(int(n) for n in names if n.isdigit())


def version(spark: SparkSession, root: str, number: int) -> Version:
    place, fs = _fs(spark, _record(root, number))
    stream = fs.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(root, number, json.loads(text))


def latest(spark: SparkSession, root: str) -> Version:
    known = numbers(spark, root)
    return version(spark, root, known[-1]) if known else Version(root, 0, {})


def read(spark: SparkSession, of: Version, name: str, schema: str) -> DataFrame:
    """A table of a release; empty where the release has none of that name."""
    return read_or_empty(spark, f"{of.root}/{of.tables[name]}", schema) if name in of.tables else spark.createDataFrame([], schema)


def new_folder() -> str:
    """Name of the folder for the tables of the next release."""
    return f"v-{uuid.uuid4().hex}"


def commit(spark: SparkSession, base: Version, changed: Mapping[str, str]) -> Version:
    """Make a release of ``base`` with the ``changed`` tables (name: path below the root).

    The record is written aside and renamed, which fails if its number has been taken.
    """
    number, tables = base.number + 1, {**base.tables, **changed}
    aside, fs = _fs(spark, f"{base.root}/{COMMITS}/.{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
    finally:
        stream.close()
    target, _ = _fs(spark, _record(base.root, number))
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), spark.sparkContext._gateway.new_array(kind, 0))
    except Py4JJavaError as error:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(error.java_exception):
            raise Conflict(f"release {number} of {base.root} was committed by another writer") from error
        raise
    return Version(base.root, number, tables)


def sweep(spark: SparkSession, root: str, keep: int = 2, orphan_hours: float = ORPHAN_HOURS) -> list[str]:
    """Delete all records but the last ``keep`` and the folders that only they named; returns the folders.

    Folders that no record names are deleted when they are older than ``orphan_hours``: a writer may still be at work in younger ones.
    """
    known = numbers(spark, root)
    dropped, kept = known[:-keep], known[-keep:]
    folders = lambda ns: {p.split("/")[0] for n in ns for p in version(spark, root, n).tables.values()}
    live = folders(kept)
    gone = folders(dropped) - live
    place, fs = _fs(spark, root)
    now = spark._jvm.java.lang.System.currentTimeMillis()
    for f in fs.listStatus(place) if exists(spark, root) else []:
        name = f.getPath().getName()
        if name.startswith("v-") and name not in live and now - f.getModificationTime() > orphan_hours * 3_600_000:
            gone.add(name)
    for number in dropped:  # records first: what they name is unreadable from then on
        fs.delete(_fs(spark, _record(root, number))[0], False)
    for name in gone:
        fs.delete(_fs(spark, f"{root}/{name}")[0], True)
    return sorted(gone)
