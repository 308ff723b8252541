"""Session set-up and the shared scratch folder used to cut lineage."""

import re
import tempfile
import threading
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: timestamps are read and printed in UTC. Shuffle files of a finished job are removed, not left
    until the driver collects its garbage."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a local session may fall back to a temporary one."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="trendloom-"))
    return context.getCheckpointDir()


_scopes = threading.local()


def scratch_dir(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/trendloom/{label}-{uuid.uuid4().hex}"
    if getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of this job, in whatever store they are."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_paths() -> list[str]:
    """Folders that this thread has named in the innermost ``scratch_scope`` so far."""
    return list(getattr(_scopes, "paths", None) or [])


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch folders that this thread names inside are removed at the end, also after a failure. What is read from them must be used up by then."""
    outer, _scopes.paths = getattr(_scopes, "paths", None), []
    try:
        yield
    finally:
        paths, _scopes.paths = _scopes.paths, outer
        remove(spark, *paths)


def written(df: DataFrame, label: str, partition_by: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared folder and read it back.

    This cuts the lineage of iterative jobs, survives the loss of executors, and gives Catalyst the true
    size, so a later join broadcasts the table only if that size is below the session's threshold. ``spark`` is the
    session to read back with; a micro-batch passes the user's, as a stream's own has adaptive execution switched off.
    """
    spark = spark or df.sparkSession
    path = scratch_dir(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_alone(spark: SparkSession, label: str, frames: Iterable[DataFrame]) -> DataFrame:
    """``written`` for all of ``frames`` in one table; scratch tables that are written while these are made are removed."""
    path = scratch_dir(spark, label)
    with scratch_scope(spark):
        for df in frames:
            schema = df.schema
            df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def sized_session(spark: SparkSession, rows: int, rows_per_partition: int) -> SparkSession:
    """A sibling session whose shuffles have as many partitions as ``rows`` call for.

    For iterative jobs that join shuffle results with tables they keep in place: there the partition count is fixed
    by those tables, so adaptive execution cannot fit it to the data.
    """
    sibling = spark.newSession()
    sibling.conf.set("spark.sql.shuffle.partitions", str(max(1, -(-rows // rows_per_partition))))
    return prepare(sibling)
