"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_made: ContextVar[list[str] | None] = ContextVar("staged_paths", default=None)


def build_session(app: str = "surveyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; a cluster passes its own on top."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scale_settings(input_bytes: int, partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Shuffle settings for an input of a given size: about one partition per ``partition_bytes``.

    AQE merges small partitions afterwards, so the number errs on the high side.
    """
    partitions = max(8, min(200_000, -(-input_bytes // partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
    }


def scratch_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage.

    On a cluster this is the shared folder named in ``spark.checkpoint.dir``. Only in
    local mode, where that is unset (tests, laptops), is a folder of our own created and
    recorded: executors elsewhere would not see it.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/surveyloom/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Used where several outputs share one computed table: it is computed once, and a
    lost executor costs a re-read instead of the whole lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    made = _made.get()
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged_paths() -> Iterator[list[str]]:
    """The paths of the tables staged inside the block, for ``drop_staged`` once their last reader is done."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        outer = _made.get()
        if outer is not None:
            outer += made


def drop_staged(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete staged tables; those that are gone already are no error."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
