"""Running totals over a global order, without a task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._store import partitions, saved


def running(df: DataFrame, order: list[str], measures: dict[str, Column], group: str | None = None) -> DataFrame:
    """df plus, for each measure, its inclusive running sum in the order given.

    Rows are range-partitioned by `order`, so a group that holds most rows is spread over
    many blocks; each block sums its own rows, and the block totals (one row per block and
    group) are summed once more. With `group`, which must be the first of `order`, the sums
    start anew in each group. Nulls come first. Rows equal in all of `order` are summed one
    after another in any order.
    """
    spark = df.sparkSession
    names = list(measures)
    blocks = saved(
        df.withColumns({f"__{k}": v for k, v in measures.items()})
        .repartitionByRange(partitions(spark), *order)
        .withColumn("__block", F.spark_partition_id()),
        "ordered",
    )
    part = ["__block", *([group] if group else [])]
    totals = blocks.groupBy(*part).agg(*[F.sum(f"__{k}").alias(f"__t_{k}") for k in names])
    earlier = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    key = [F.col(group).alias("__group")] if group else []
    offsets = totals.select(
        F.col("__block").alias("__b"), *key, *[F.coalesce(F.sum(f"__t_{k}").over(earlier), F.lit(0)).alias(f"__o_{k}") for k in names]
    )
    own = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = blocks.withColumns({f"__r_{k}": F.sum(f"__{k}").over(own) for k in names})
    on = F.col("__block") == F.col("__b")
    if group:
        on = on & F.col(group).eqNullSafe(F.col("__group"))
    out = sums.join(offsets, on, "inner")
    return out.select(*df.columns, *[(F.col(f"__r_{k}") + F.col(f"__o_{k}")).alias(k) for k in names])
