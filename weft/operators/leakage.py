"""Held-out items that no row of the training splits asks, word for word or nearly so."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.hashing import draw
from weft.functions.similarity import NearPool
from weft.functions.text import canonical
from weft.operators.samples import keep_first, smallest
from weft.sources.scratch import written

#: Items of the pool that are sent to all tasks at once, of at most `most` characters each.
POOL = 4096
NEAR, SHORTEST, GAP, HEAD = 0.93, 45, 0.1, 18


def _near(shared, kind: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shared.value
        pool, best = NearPool(texts, *kind), {}
        for batch in batches:
            for text in batch.column("canon").to_pylist():
                for i, ratio in pool.near(text):
                    best[i] = max(best.get(i, 0.0), ratio)
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best], pa.string()), pa.array(list(best.values()), pa.float64())], names=["canon", "ratio"])

    return run


def near_any(pool: DataFrame, others: DataFrame, least: float = NEAR, length: int = SHORTEST, gap: float = GAP, block: int | None = HEAD) -> DataFrame:
    """canon, ratio of pool texts (canon) that have a near copy among others (canon).

    The LCS ratio is at least `least`, lengths are `length` or more and differ by at most
    `gap`; with block, the two share their first or last `block` characters, without it any
    pair counts. The pool travels in blocks of POOL texts, so it should be bounded in number
    and length; others are read once a block and not shuffled, whatever they have in common.
    """
    spark = pool.sparkSession
    pool = pool.select("canon").filter(F.char_length("canon") >= length).distinct()
    others = others.select("canon").filter(F.char_length("canon") >= length)
    blocks = -(-pool.count() // POOL)
    found = spark.createDataFrame([], "canon string, ratio double")
    for b in range(blocks):
        texts = sorted(r.canon for r in pool.filter(F.pmod(F.xxhash64("canon"), F.lit(blocks)) == b).collect())  # about POOL rows
        shared = spark.sparkContext.broadcast((texts, texts))
        found = found.unionByName(others.mapInArrow(_near(shared, (least, length, gap, block)), "canon string, ratio double"))
    return found.groupBy("canon").agg(F.max("ratio").alias("ratio"))


def _stages(candidates: DataFrame, rate: float, seed: str, least: int, most: int, least_answer: int) -> tuple[DataFrame, dict[str, Column]]:
    """Candidates with their draw and lengths, and what each stage asks, in order."""
    text = F.concat_ws("\n", "question", "answer")
    rows = candidates.withColumns({"p": draw(seed, text), "asked": F.char_length("question"), "told": F.char_length("answer")})
    filled = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    return rows, {
        "valid": filled("asked") & filled("told"),
        "sampled_out": F.coalesce(F.col("p") >= rate, F.lit(True)),
        "question_length_kept": F.col("asked").between(least, most),
        "reference_length_kept": F.col("told") >= least_answer,
    }


def heldout(
    candidates: DataFrame, splits: DataFrame, limit: int, pool_factor: int = 10, least: int = 12, most: int = 2000, least_answer: int = 15,
    rate: float = 0.1963, seed: str = "42", near: float | None = NEAR, block: int | None = HEAD,
) -> tuple[DataFrame, DataFrame]:
    """Held-out items (id, question, reference, original_row) and one row of counters.

    candidates are (row, question, answer), splits (question). Rows without a question or an
    answer and those that the training sample took go, then those of other lengths; of equal
    canonical questions the first row counts. Of the limit * pool_factor questions with the
    smallest digests those go that a split row asks, and with `near` those that have a near
    copy there; of the rest `limit` are taken, in order of digest.

    Counters: raw and what each stage leaves, questions that repeat another's, the pool,
    split rows scanned, items asked in a split and those only nearly, eligible, written.
    """
    spark = candidates.sparkSession
    rows, stages = _stages(candidates, rate, seed, least, most, least_answer)
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("raw")]
    for name, ok in stages.items():
        passed = passed & F.coalesce(ok, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    rows_left = rows.filter(passed).select("row", "question", "answer", canonical(F.col("question")).alias("canon")).filter("canon <> ''")
    first = keep_first(rows_left, F.col("canon"), ["row"]).withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("canon")), 256))
    distinct = written(first)
    pool = written(smallest(distinct, F.col("digest"), limit * pool_factor, "canon"))
    asked = splits.select(canonical(F.col("question")).alias("canon"))
    asked = written(asked)
    exact = pool.join(asked.filter("canon <> ''").select("canon").distinct(), "canon", "left_semi").select("canon", F.lit(1.0).alias("ratio"), F.lit(True).alias("same"))
    nearly = near_any(pool, asked, near, block=block) if near else spark.createDataFrame([], "canon string, ratio double")
    found = exact.unionByName(nearly.withColumn("same", F.lit(False))).groupBy("canon").agg(F.max("same").alias("same"))
    found = written(found)  # limit * pool_factor rows at most
    eligible = pool.join(found, "canon", "left_anti")
    items = eligible.orderBy("digest", "canon").limit(limit).select(F.sha2("canon", 256).alias("id"), "question", F.col("answer").alias("reference"), F.col("row").alias("original_row"))
    number = lambda df, name, *ok: df.agg((F.count_if(*ok) if ok else F.count(F.lit(1))).alias(name))
    report = rows.agg(*counts, F.count_if(passed & (canonical(F.col("question")) != "")).alias("with_question"))
    for one in (
        number(distinct, "distinct_questions"), number(pool, "candidate_pool"), number(asked, "split_rows_scanned"),
        found.agg(F.count_if("same").alias("exact_question_overlap"), F.count_if(~F.col("same")).alias("near_text_overlap")), number(eligible, "eligible"),
    ):
        report = report.crossJoin(one)  # one row each
    report = report.withColumns({"candidate_question_duplicates": F.col("with_question") - F.col("distinct_questions"), "written": F.least("eligible", F.lit(limit))})
    return items, report.drop("with_question", "distinct_questions")


#: Texts of one block key and length band that are indexed together, and characters of these.
CELL, CELL_SIZE = 1024, 1 << 22


def _cells(kind: tuple):
    """Pairs (a, b, ratio) of near nodes of each cell: indexed texts, which come first, and others, in order of node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, texts, pool = None, [], [], None
        for batch in batches:
            found: list[tuple[bytes, bytes, float]] = []
            columns = (batch.column(c).to_pylist() for c in ("key", "band", "block", "asks", "node", "upper", "canon"))
            for key, band, block, asks, node, upper, canon in zip(*columns, strict=True):
                if (key, band, block) != cell:
                    cell, nodes, texts, pool = (key, band, block), [], [], None
                if not asks:
                    nodes.append(node)
                    texts.append(canon)
                    continue
                pool = pool or NearPool(texts, *kind)
                first = None if upper else bisect_left(nodes, node)  # of two texts of a band one asks
                found += [(min(node, nodes[i]), max(node, nodes[i]), r) for i, r in pool.near(canon, first, tail_only=key[0] == ">")]  # the others meet by their heads
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.float64()))], names=["a", "b", "ratio"])

    return run


def near_pairs(texts: DataFrame, least: float = NEAR, length: int = SHORTEST, gap: float = GAP, block: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """Near texts of (id, text): pairs (a, b, ratio) of distinct canonical texts, and (node, id) of all.

    As near_any() says, of texts that share their first or last `block` characters. Equal
    texts are one node. Of a block key only texts of neighbouring length bands meet, those of
    a band in cells of CELL indexed ones (or CELL_SIZE characters), so that a key of any number of texts is spread; a
    text is fetched only for keys that another one has.
    """
    canon = texts.select("id", canonical(F.col("text")).alias("canon")).filter(F.char_length("canon") >= length)
    rows = written(canon.withColumn("node", F.unhex(F.sha2("canon", 256))))
    band = F.floor(F.log(F.char_length("canon").cast("double")) / -math.log(1 - gap)).cast("int")
    keys = F.array(F.concat(F.lit("<"), F.left("canon", F.lit(block))), F.concat(F.lit(">"), F.right("canon", F.lit(block))))
    keyed = rows.select("node", F.char_length("canon").alias("size"), band.alias("own"), F.explode(keys).alias("key")).distinct()
    sizes = keyed.groupBy("key", "own").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    near = sizes.select("key", F.explode(F.array("own", F.col("own") - 1)).alias("band"), "n").groupBy("key", "band").agg(F.sum("n").alias("all"))
    cells = sizes.join(near.withColumnRenamed("band", "own"), ["key", "own"]).filter("all > 1")
    cells = written(cells.select("key", F.col("own").alias("band"), F.ceil(F.greatest(F.col("n") / CELL, F.col("size") / CELL_SIZE)).cast("int").alias("blocks")))
    held = keyed.withColumnRenamed("own", "band").join(cells, ["key", "band"])
    held = held.select("key", "band", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "node", F.lit(False).alias("upper"))
    asks = keyed.select("key", "node", "own", F.explode(F.array("own", F.col("own") - 1)).alias("band")).join(cells, ["key", "band"])
    asks = asks.select("key", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "node", (F.col("own") > F.col("band")).alias("upper"))
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    distinct = rows.groupBy("node").agg(F.first("canon").alias("canon"))
    both = held.unionByName(asks).join(distinct, "node").repartition(tasks, "key", "band", "block").sortWithinPartitions("key", "band", "block", "asks", "node")
    pairs = both.select("key", "band", "block", "asks", "node", "upper", "canon").mapInArrow(_cells((least, length, gap, block)), "a binary, b binary, ratio double")
    return pairs.groupBy("a", "b").agg(F.max("ratio").alias("ratio")), rows.select("node", "id")
