"""What a session needs on a cluster: tables that cut lineage in the shared folder, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
#: Bytes of input files to a shuffle partition: compressed, so some ten times that as rows.
PART_BYTES = 8 << 20


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share.

    Where it is unset a local session gets a temporary folder; on a cluster that would be a folder of each machine's own, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="loomgraph-"))
        root = _local[0]
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Has Python workers that start from now on find this package, wherever the session was started from.

    A local session's workers get its folder in PYTHONPATH. On a cluster Spark sends the package's files to the executors, once a session.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    above, context = os.path.dirname(package), spark.sparkContext
    if is_local(spark):
        known = context.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
        if above not in known:
            context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [above, *known]))
    elif not getattr(context, "_loomgraph_shipped", False):
        archive = os.path.join(tempfile.mkdtemp(prefix="loomgraph-"), "loomgraph_package.zip")  # the driver's copy; Spark serves it
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for file in (os.path.join(folder, n) for n in names if n.endswith(".py")):
                    out.write(file, os.path.relpath(file, above))
        context.addPyFile(archive)
        context._loomgraph_shipped = True


def parts(spark: SparkSession, inputs: list[str]) -> int:
    """A part per PART_BYTES of the input files, one at least."""
    size = 0
    for uri in inputs:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(1, -(-size // PART_BYTES))


@contextmanager
def partitioned(spark: SparkSession, inputs: list[str]) -> Iterator[None]:
    """Has shuffles of what runs inside start with a partition per PART_BYTES of the input files, if the session has fewer.

    Small ones are put together again by adaptive execution, so that only the memory and spill of a task are bounded, whatever the input.
    """
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    old = spark.conf.get(key, None)
    spark.conf.set(key, max(int(old or spark.conf.get("spark.sql.shuffle.partitions")), parts(spark, inputs)))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def delete_at_end(spark: SparkSession, uri: str) -> None:
    """Has the folder deleted when the session's JVM ends: frames that read it may live till then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)


class Scratch:
    """Tables of one run under the shared folder, deleted at the end of the session."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        delete_at_end(spark, self.path)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
