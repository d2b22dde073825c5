"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.  One of our own only where none is
    named and driver and executors are one machine; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="sparkweave-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def settle(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what a row got, it keeps, however
    often and by whichever plan it is read, and lost executors cost no lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkweave-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    _written.append((spark, path.rsplit("/", 1)[0]))
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input: never broadcast.  The planner would guess
    from bytes on disk, which for repetitive rows are a small part of those in memory, and
    doesn't count what an explode adds."""
    return df.hint("merge")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the process ends."""
    path = f"{shared_dir(spark)}/sparkweave-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return
