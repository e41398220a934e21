"""Writers: JSON lines, splits, sheets, append and report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import formula_safe
from weft.operators.store import absent
from weft.sources.scratch import written

#: The column that tells in which batch a row was stored.
BATCH = "batch_id"


def json_lines(df: DataFrame, path: str, sort_keys: bool = False, mode: str = "errorifexists") -> None:
    """One object per line, in column order or with sorted keys."""
    (df.select(*sorted(df.columns)) if sort_keys else df).write.mode(mode).json(path)


def splits(df: DataFrame, path: str, column: str = "split") -> None:
    """A folder per split, in one pass."""
    df.write.partitionBy(column).json(path)


def sheet(df: DataFrame, path: str) -> None:
    """CSV whose text cells no spreadsheet takes for formulas."""
    safe = [formula_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table written by append_batch, with their batch; None if there are none."""
    try:
        return spark.read.option("basePath", path).parquet(path)
    except Exception as e:  # an absent table is an empty one; anything else is an error
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def append_batch(df: DataFrame, batch: str, path: str, key: list[str]) -> DataFrame:
    """Write the rows of a named batch whose key no other batch has, each key once; what it holds.

    A batch is one folder of the table and replaces it: written again after a failure, even
    one between the write and a stream's own commit, it does not see what it left before,
    and leaves the same. One writer at a time.
    """
    spark = df.sparkSession
    known = stored(spark, path)
    new = df.dropDuplicates(key) if known is None else absent(df, known.filter(F.col(BATCH) != batch), key)
    folder = f"{path.rstrip('/')}/{BATCH}={batch}"
    written(new).write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def append_absent(df: DataFrame, path: str, key: list[str]) -> int:
    """Append the rows whose key the table at path lacks, as a batch of its own; how many these were."""
    return append_batch(df, f"once-{uuid.uuid4().hex}", path, key).count()


def report_row(df: DataFrame) -> str:
    """A one-row result as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns))).first()[0]
