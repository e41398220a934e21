"""From raw documents to shards for training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Stages judge their own input only, which may hold repeated ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm import decontamination, mixing, near_dedup, quality, sharding
from weft.llm._store import saved
from weft.session import table

LEAST_QUALITY = 0.3
SHARDS = 40
#: Rows of whole texts that go to Python at once; the session's default of 10000 takes tens of MB a task.
BATCH_ROWS = 2000
#: Not SQL: trained models and searches for the best cut; tested against plain versions.
ORACLE_SQL = None


def _row(docs: DataFrame) -> Column:
    """All columns as they are, whatever their names."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def _in_small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of LEAST_QUALITY or more."""
    _in_small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter(F.col("score") >= LEAST_QUALITY).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8).

    That with the smallest id stays, null before others; of rows repeated with id and text,
    one. Rows are known by id and digest of both, so that repeated and null ids are no trouble.
    """
    _in_small_batches(spark)
    digest = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")), F.isnull("text").cast("string")), 256)
    rows = docs.select(_row(docs).alias("row"), digest.alias("digest"))
    one = rows.select(F.struct("row.doc_id", "digest").alias("id"), F.col("row.text").alias("text"))
    kept = near_dedup.near_dedup(one, id_col="id").filter("kept").select("doc_id.digest").distinct()
    return rows.join(kept, "digest", "left_semi").dropDuplicates(["digest"]).select("row.*")


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    _in_small_batches(spark)
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.filter("n_hit = 0").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    rows = docs.select(_row(docs).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), size.alias("words"))
    copies = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))  # one entry per repeated row
    rows = rows.join(copies, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("of").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size")))
    nth = F.row_number().over(Window.partitionBy("id", "of", "words").orderBy(F.xxhash64("row.text")))
    taken = F.element_at("copies", F.when(F.size("copies") > 1, nth).otherwise(1)).cast("int")
    return rows.withColumn("taken", taken).select("row", F.explode(F.array_repeat(F.lit(1), F.col("taken")))).select("row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row, equal texts in one shard."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", not_in_benchmark),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, "stage")
    return docs
