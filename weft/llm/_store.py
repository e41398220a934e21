"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset, one of our own.

    A local[*] session has no other machines, so a temporary folder will do there; a session
    on a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="weft-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back; also where it lies.

    Cuts the lineage: what follows neither recomputes df nor depends on an executor's disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    return written(df, tag)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of written() that no later plan reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, the one knob by which users scale the operators."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
