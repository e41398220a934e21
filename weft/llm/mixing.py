"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Each document expects target / source size copies. These are summed in order of document
size within the source, one offset per source is added, and a document is emitted once for
each integer that its interval of the running sum crosses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._ordered import running
from weft.llm._store import saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source of (source, size) rows.

    Sources in code point order, null last, get the weights in turn and share budget times
    all sizes; what exceeds most times a source's size is shared again by weight. That ends
    where every source has min(cap, weight * level) for one common level, found here by
    sorting the sources by cap / weight. One row per source, so this small table may meet
    in one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") - 1) % len(weights) + 1))
    per = per.withColumn("cap", F.col("source_size") * most)
    whole = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, 0)
    rest = F.lit(budget) * F.sum("source_size").over(whole) - (F.sum("cap").over(filled) - F.col("cap"))
    level = rest / (F.sum("weight").over(whole) - (F.sum("weight").over(filled) - F.col("weight")))
    per = per.withColumns({"level": level, "place": F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), "turn"))})
    open_ = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))
    per = per.withColumn("common", F.min(open_).over(whole)["level"])
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("common")).alias("target"))


def offset(source, seed: str) -> F.Column:
    """The source's one random offset, k / 4096, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("\x00")))), 1, 3), 16, 10).cast("long") / 4096


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies.

    size is the number of words (null text: 0). copies is 0 to most; as documents of a
    source are taken in order of size, the words taken differ from the target by about one
    document's. The same rows give the same copies whatever their order or partitions; rows
    equal in source, size and id are interchangeable. Null ids and sources are values of
    their own. If no document has words, all copies are 0.
    """
    sizes = saved(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "sizes",
    )
    goal = targets(sizes, weights, budget, most).select(F.col("source").alias("of"), "source_size", "target")
    ranked = running(sizes, ["source", "size", "doc_id"], {"rank": F.lit(1)}, group="source")
    rows = ranked.join(goal, F.col("source").eqNullSafe(F.col("of")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = F.floor(F.col("rank") * rate + u) - F.floor((F.col("rank") - 1) * rate + u)
    return rows.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies.cast("long").alias("copies"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS turn
  FROM d GROUP BY source
), w AS (
  SELECT *, source_size * 2 AS cap, [5, 2, 1][(turn - 1) % 3 + 1] AS weight FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - CAST(sum(cap) OVER o - cap AS DOUBLE))
            / CAST(sum(weight) OVER () - (sum(weight) OVER o - weight) AS DOUBLE) AS level,
         row_number() OVER (ORDER BY cap::DOUBLE / weight, turn) AS place
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, turn ROWS UNBOUNDED PRECEDING)
), g AS (
  SELECT source, source_size,
         least(cap::DOUBLE, weight * arg_min(level, place) FILTER (level <= cap::DOUBLE / weight) OVER ()) AS target
  FROM l
), r AS (
  SELECT d.*, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(d.source, chr(0))), 1, 3))::BIGINT / 4096.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY d.source ORDER BY size NULLS FIRST, doc_id NULLS FIRST) AS rank
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(floor(rank * rate + u) - floor((rank - 1) * rate + u) AS BIGINT) * size AS taken
FROM r
"""
