"""Exact deduplication by a content sort (DataFrame functions only).

Sampled splitters range-partition the rows by the head and a digest of their normalised
bytes, an external sort puts equal texts side by side, and each row is compared in full
with its neighbour. The row with the smallest identifier of each run stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._store import partitions, saved

#: Runs of blanks that count as one space; single spaces are not matched, as they stay.
BLANKS = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"
#: Share of the rows that is looked at to find texts held by very many rows.
HOT_SAMPLE = 1 / 32


def normalised(text) -> F.Column:
    """Blank runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _hot(docs: DataFrame, text: str, n: int) -> list[int]:
    """Digests of texts that seem to fill more than half a partition; at most 2n of them."""
    sample = docs.select(text).sample(HOT_SAMPLE, seed=11).select(F.xxhash64(normalised(F.col(text))).alias("h"))
    counts = sample.groupBy("h").count()
    least = F.greatest(F.lit(16), F.sum("count").over(Window.partitionBy()) / (2 * n))
    return [r.h for r in counts.filter("count >= 16").withColumn("least", least).filter("count >= least").limit(2 * n).collect()]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text equals the empty text. Of rows that repeat the smallest id of their group one
    stays; null ids come last, and keep_id is null only if every id of the group is null.
    Other columns of docs, whatever their names, play no part. An empty table gives none.

    A text that very many rows share is dealt out by a salt from the id; its salted runs
    (at most 2n texts of n runs) are merged by digest. Only the speed depends on the sample
    that finds such texts.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hot = _hot(docs, "text", n)
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm")).select(
        "doc_id", "norm", F.substring("norm", 1, 24).alias("head"), F.xxhash64("norm").alias("digest")
    )
    salt = F.when(F.col("digest").isin(hot), F.pmod(F.xxhash64("doc_id"), F.lit(n))).otherwise(F.lit(-1)) if hot else F.lit(-1).cast("long")
    rows = rows.withColumn("salt", salt.cast("int"))
    place = ["head", "digest", "salt"]
    rows = rows.repartitionByRange(n, *place)
    near = Window.partitionBy(*place).orderBy("norm", F.col("doc_id").asc_nulls_last())
    before = F.lag("norm").over(near)
    rows = rows.select(
        "doc_id", *place, F.sha2("norm", 256).alias("text_sha256"), F.when(before.isNull() | (before != F.col("norm")), 1).otherwise(0).alias("starts"), F.row_number().over(near).alias("at")
    )
    upto = Window.partitionBy(*place).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("starts").over(upto))
    run = Window.partitionBy(*place, "run")
    rows = rows.select(
        "doc_id", "text_sha256", "starts", (F.col("salt") >= 0).alias("salted"), F.min("doc_id").over(run).alias("low"), F.count(F.lit(1)).over(run).alias("n")
    )
    if hot:
        rows = saved(rows, "runs")
        runs = rows.filter("salted and starts = 1").groupBy("text_sha256").agg(F.min("low").alias("all_low"), F.sum("n").alias("all_n"))
        rows = rows.join(runs.hint("broadcast"), "text_sha256", "left")  # at most 2n rows
    else:
        rows = rows.withColumns({"all_low": F.lit(None).cast("long"), "all_n": F.lit(None).cast("long")})
    salted = F.col("salted") & F.col("all_n").isNotNull()
    keep = F.when(salted, F.col("all_low")).otherwise(F.col("low"))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.when(salted, F.col("all_n")).otherwise(F.col("n")).cast("long").alias("group_size"),
        ((F.col("starts") == 1) & F.col("doc_id").eqNullSafe(keep)).alias("kept"),
        "text_sha256",
    )


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
