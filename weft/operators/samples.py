"""Chat samples for fine-tuning: conversion, sampling, deduplication, overlap, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.hashing import draw
from weft.functions.text import canonical, clean_text, without_think
from weft.operators.audit import keep_first

EMPTY_THINK = "<think>\n\n</think>\n\n"


def messages(rows: DataFrame) -> DataFrame:
    """instruction, input, output to messages; rows without a user or an assistant text go."""
    ask = F.concat_ws("\n\n", F.nullif(clean_text(F.col("instruction")), F.lit("")), F.nullif(clean_text(F.col("input")), F.lit("")))
    told = without_think(clean_text(F.col("output")))
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    out = rows.withColumns({"__q": ask, "__a": told}).filter("__q <> '' and __a <> ''")
    return out.withColumn("messages", F.array(say("user", F.col("__q")), say("assistant", F.col("__a")))).drop("__q", "__a")


def with_empty_think(m: Column) -> Column:
    """Assistant turns with their leading think block replaced by an empty one."""
    return F.transform(m, lambda x: F.when(x["role"] == "assistant", F.struct(x["role"].alias("role"), F.concat(F.lit(EMPTY_THINK), without_think(x["content"], anywhere=False)).alias("content"))).otherwise(x))


def valid(m: Column) -> Column:
    """Whether there are messages and each has a role and content."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return (F.size(m) > 0) & F.forall(m, lambda x: filled(x["role"]) & filled(x["content"]))


def first_user(m: Column) -> Column:
    return F.get(F.filter(m, lambda x: x["role"] == "user"), 0)["content"]


def conversation_messages(turns: DataFrame) -> DataFrame:
    """conv_id, messages in order of turn."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def sampled(rows: DataFrame, text: Column, rate: float, seed: str = "42", keep: bool = True) -> DataFrame:
    """Rows whose draw is below the rate, or the complement; the draw depends on the text alone."""
    chosen = F.coalesce(draw(seed, text) < rate, F.lit(False))
    return rows.filter(chosen if keep else ~chosen)


def exactly(rows: DataFrame, text: Column, n: int, seed: str = "42") -> DataFrame:
    """The n distinct texts with the smallest digests, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), text), 256)
    return rows.withColumn("__d", digest).dropDuplicates(["__d"]).orderBy("__d").limit(n).drop("__d")


def smallest(rows: DataFrame, digest: Column, n: int, tie: str = "id") -> DataFrame:
    """The n rows with the smallest hexadecimal digests, by any n, without a sort of all rows.

    Counts by the first four digits (65536 groups at most) tell the group in which the n-th
    lies; only that one is numbered.
    """
    group = F.left("__d", F.lit(4))
    keyed = rows.withColumn("__d", digest)
    counts = keyed.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.orderBy("g")) - F.col("c")
    last = counts.withColumn("b", before).filter(F.col("b") < n).agg(F.max(F.struct("g", "b")).alias("at")).first()["at"]
    if last is None:
        return rows.limit(0)
    edge = keyed.filter(group == last.g).withColumn("__n", F.row_number().over(Window.orderBy("__d", tie))).filter(F.col("__n") <= n - last.b)
    return keyed.filter(group < last.g).unionByName(edge.drop("__n")).drop("__d")


def split_of(text: Column, test: float = 0.001, validation: float = 0.001, seed: str = "42") -> Column:
    p = draw(seed, text)
    return F.when(p < test, "test").when(p < test + validation, "validation").otherwise("train")


def without_overlap(general: DataFrame, domain: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """General rows whose key is not in the domain set, and of equal ones the first."""
    left = general.withColumn("__k", key)
    right = domain.select(key.alias("__k")).distinct()
    return keep_first(left.join(right, "__k", "left_anti"), F.col("__k"), order).drop("__k")


def mixture_target(domain_rows: Column, available: Column, share: float = 0.1) -> Column:
    """Rows of the general set that make up `share` of the mixture, as far as there are."""
    return F.least(F.ceil(F.round(domain_rows * share / (1 - share), 6)), available)


def near_copies(candidates: DataFrame, others: DataFrame, similar: Column | None = None, block: int = 18, least: int = 45, gap: float = 0.1) -> DataFrame:
    """Pairs (id, other_id, a, b) of canonical texts that share their head or tail.

    Texts of fewer than `least` characters are not compared; lengths differ by at most `gap`.
    Both block keys are equi-joins of ids and lengths; the pairs are made distinct before
    any text is fetched.
    """
    prepared = lambda df, i, t: df.select(F.col("id").alias(i), canonical(F.col("text")).alias(t)).filter(F.char_length(t) >= least)
    left, right = prepared(candidates, "id", "a"), prepared(others, "other_id", "b")
    keyed = lambda df, i, t, n, f: df.select(i, F.char_length(t).alias(n), f(F.col(t), F.lit(block)).alias("k"))
    close = F.abs(F.col("n") - F.col("m")) <= gap * F.greatest("n", "m")
    by = lambda f: keyed(left, "id", "a", "n", f).join(keyed(right, "other_id", "b", "m", f), "k").filter(close & (F.col("id") != F.col("other_id"))).select("id", "other_id")
    pairs = by(F.left).unionByName(by(F.right)).distinct()
    return pairs.join(left, "id").join(right, "other_id").select("id", "other_id", "a", "b").distinct()


def token_histogram(rows: DataFrame, tokens: Column, edges: tuple[int, ...] = (128, 256, 512, 1024, 2048)) -> DataFrame:
    """bucket, label, rows, percent, largest: fixed buckets, those without rows included."""
    spark = rows.sparkSession
    n = rows.select(tokens.alias("t"))
    bucket = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        bucket = F.when(F.col("t") <= edges[i], i).otherwise(bucket)
    counted = n.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.max("t").alias("largest"))
    labels = [f"<={e}" for e in edges] + [f">{edges[-1]}"]
    every = spark.createDataFrame(list(enumerate(labels)), "bucket int, label string")
    out = every.join(counted, "bucket", "left").withColumn("rows", F.coalesce("rows", F.lit(0)).cast("long"))
    total = n.agg(F.count(F.lit(1)).alias("total"))
    return out.crossJoin(total).select("bucket", "label", "rows", F.round(F.when(F.col("total") > 0, 100 * F.col("rows") / F.col("total")).otherwise(0.0), 4).alias("percent"), "largest")  # total is one row
