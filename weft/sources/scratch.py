"""Intermediate tables that several jobs read, in the folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet below spark.checkpoint.dir and read back, columns still pruned.

    A lost executor costs nothing that was written. Only a local session may go without that
    setting; its tables go when Python ends.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="weft-"))
            atexit.register(shutil.rmtree, _own[0], True)
        base = "file://" + _own[0]
    path = f"{base.rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew only if it comes in fewer partitions than there are cores, as one small file does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
