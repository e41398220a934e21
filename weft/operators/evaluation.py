"""Evaluation: paired metrics, intervals, win rates, multiple choice, blind review."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import formula_safe
from weft.sources.scratch import written


def paired_means(rows: DataFrame, base: Column, other: Column) -> DataFrame:
    """n, means of both, mean difference; nulls where there are no pairs."""
    both = rows.select(base.alias("a"), other.alias("b")).filter("a is not null and b is not null")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("base_mean"), F.round(F.avg("b"), 6).alias("other_mean"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("difference"))


#: A resample holds a value k times if its draw is at least this in k places (Poisson of mean 1).
POISSON = np.cumsum([1 / math.factorial(k) for k in range(7)]) / math.e
#: Draws of four bytes that one digest gives.
PER_DIGEST = 8


def _resampled(seed: str, resamples: int):
    """Per task, for each resample the sum of the values it holds and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(resamples), np.zeros(resamples, dtype=np.int64)
        for batch in batches:
            for key, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                digests = b"".join(hashlib.sha256(f"{seed}:{k}:{key}".encode()).digest() for k in range(-(-resamples // PER_DIGEST)))
                times = np.searchsorted(POISSON, np.frombuffer(digests, dtype=">u4")[:resamples] / 2**32, "right")
                sums += times * v
                n += times
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(sums), pa.array(n)], names=["b", "total", "n"])

    return run


def bootstrap(values: DataFrame, seed: str = "42", resamples: int = 1000) -> DataFrame:
    """mean, low, high: 95 % interval of the mean of (id, v) by Poisson bootstrap.

    A resample holds each value as often as a Poisson(1) draw from its id says, so values
    are never gathered or numbered. Each task adds up all resamples over its values; what is
    shuffled are these sums, `resamples` rows a task whatever the number of values. The ends
    are order statistics, as of a sorted list of the resamples' means. Null values are left
    out; without values all three are null.
    """
    values = values.filter("v is not null").select(F.col("id").cast("string").alias("id"), F.col("v").cast("double").alias("v"))
    parts = values.mapInArrow(_resampled(seed, resamples), "b long, total double, n long")
    means = parts.groupBy("b").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    low, high = int(0.025 * (resamples - 1)), int(0.975 * (resamples - 1))
    ordered = means.agg(F.array_sort(F.collect_list(F.round("m", 9))).alias("m"))  # one number per resample
    return ordered.crossJoin(values.agg(F.round(F.avg("v"), 9).alias("mean"))).select("mean", F.get("m", low).alias("low"), F.get("m", high).alias("high"))


def paired_bootstrap(rows: DataFrame, key: Column, base: Column, other: Column, seed: str = "42", resamples: int = 1000) -> DataFrame:
    """As bootstrap(), of the differences other - base of the pairs that have both."""
    return bootstrap(rows.select(key.alias("id"), (other.cast("double") - base.cast("double")).alias("v")), seed, resamples)


#: Bins into which a range of values is cut at once.
BINS = 1024


def medians(rows: DataFrame, group: Column, value: Column) -> DataFrame:
    """grp, median of the values of each group, exact, without gathering a group's values.

    The one or two middle ranks are looked for in a histogram of the group's range; the bin
    that holds a rank is cut again until all its values are equal. Each pass reads the rows
    once and shuffles BINS counts a group and task at most. Null values do not count; a group
    of nulls has a null median.
    """
    rows = rows.select(group.alias("grp"), value.cast("double").alias("v"))
    data = rows.filter("v is not null")
    sizes = data.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))
    state = written(sizes.select("grp", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "low", "high"))
    while not state.filter("low < high").isEmpty():
        open_ = state.filter("low < high").withColumnRenamed("grp", "of")
        inside = data.join(open_, F.col("grp").eqNullSafe(F.col("of")) & F.col("v").between(F.col("low"), F.col("high")))
        # Halved, so that the width of the widest range is a number.
        place = F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS)
        bins = inside.groupBy("grp", "rank", "below", F.least(place, F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = Window.partitionBy("grp", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # BINS rows
        bins = bins.withColumn("upto", F.col("below") + F.sum("c").over(upto))
        holds = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank"))
        found = bins.filter(holds).select("grp", "rank", (F.col("upto") - F.col("c")).alias("below"), "low", "high")
        state = written(state.filter("low >= high").unionByName(found))
    middle = state.groupBy(F.col("grp").alias("of")).agg(F.avg("low").alias("median"))
    every = rows.select("grp").distinct()
    return every.join(middle, F.col("grp").eqNullSafe(F.col("of")), "left").select("grp", "median")


def paired_report(pairs: DataFrame, metrics: list[str], seed: str = "42", resamples: int = 1000) -> DataFrame:
    """metric, n, means, difference with its interval, medians of pairs (id, metric, base, other).

    Pairs that lack a side do not count; a metric without pairs has no row. pairs is read a
    few times a metric, so it should be a table.
    """
    both = pairs.filter("base is not null and other is not null")
    means = both.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("base"), 4).alias("base_mean"), F.round(F.avg("other"), 4).alias("other_mean"), F.round(F.avg(F.col("other") - F.col("base")), 4).alias("difference"))
    bounds = None
    for m in metrics:
        one = paired_bootstrap(both.filter(F.col("metric") == m), F.col("id"), F.col("base"), F.col("other"), seed, resamples)
        one = one.select(F.lit(m).alias("metric"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))
        bounds = one if bounds is None else bounds.unionByName(one)
    middle = lambda side: medians(both, F.col("metric"), F.col(side)).select(F.col("grp").alias("metric"), F.round("median", 4).alias(f"{side}_median"))
    return means.join(F.broadcast(bounds), "metric").join(middle("base"), "metric").join(middle("other"), "metric")  # a row per metric


def win_rates(rows: DataFrame, winner: Column) -> DataFrame:
    """Wins of each side, ties, and the other side's rate with half a win per tie."""
    w = rows.select(winner.alias("w")).filter(F.col("w").isin("base", "other", "tie"))
    out = w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("w") == "base").alias("base"), F.count_if(F.col("w") == "other").alias("other"), F.count_if(F.col("w") == "tie").alias("ties"))
    return out.withColumn("rate", F.round((F.col("other") + 0.5 * F.col("ties")) / F.nullif(F.col("n"), F.lit(0)), 6))


def choice_scores(rows: DataFrame, labels: list) -> DataFrame:
    """n, accuracy, macro_f1 over the labels of (truth, guess); 0 where nothing is divided by."""
    table = rows.groupBy("truth", "guess").count()
    parts = [F.struct(*[F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).alias(n) for n, c in (("tp", (F.col("truth") == x) & (F.col("guess") == x)), ("t", F.col("truth") == x), ("g", F.col("guess") == x))]) for x in labels]
    out = table.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("count")).otherwise(0)).alias("right"), F.array(*parts).alias("per"))
    f1 = F.transform("per", lambda p: F.when(p["t"] + p["g"] > 0, 2.0 * p["tp"] / (p["t"] + p["g"])).otherwise(0.0))
    return out.select("n", F.round(F.col("right") / F.col("n"), 6).alias("accuracy"), F.round(F.aggregate(f1, F.lit(0.0), lambda a, x: a + x) / len(labels), 6).alias("macro_f1"))


def discordant(rows: DataFrame, base: Column, other: Column) -> DataFrame:
    return rows.agg(F.count_if(base & ~other).alias("only_base"), F.count_if(~base & other).alias("only_other"))


def blind_sides(rows: DataFrame, seed: str = "42") -> DataFrame:
    """Which answer is shown as A, by the parity of a digest, and the review order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    odd = F.conv(F.substring(digest, 64, 1), 16, 10).cast("int") % 2
    return rows.withColumns({"a": F.when(odd == 1, "other").otherwise("base"), "b": F.when(odd == 1, "base").otherwise("other"), "review_key": digest})


def review_sheet(rows: DataFrame, columns: list[str], n: int, seed: str = "42") -> DataFrame:
    """The n rows first in review order, texts made safe for spreadsheets."""
    return blind_sides(rows, seed).orderBy("review_key").limit(n).select("id", *[formula_safe(F.col(c)).alias(c) for c in columns])


def unblind(ratings: DataFrame, sides: DataFrame) -> DataFrame:
    """id, winner as base, other or tie; ratings without a key or a valid choice go."""
    rows = ratings.join(sides.select("id", "a", "b"), "id")
    winner = F.when(F.upper(F.trim("winner")) == "A", F.col("a")).when(F.upper(F.trim("winner")) == "B", F.col("b")).when(F.lower(F.trim("winner")) == "tie", "tie")
    return rows.withColumn("winner", winner).filter("winner is not null").drop("a", "b")


def yes_or_no(c: Column) -> Column:
    """True, false, or null for what is neither."""
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin("true", "1", "yes", "y", "是"), True).when(v.isin("false", "0", "no", "n", "否", ""), False)


def judgement(raw: Column) -> Column:
    """winner and scores (1 to 5) from a model's reply; null unless all are valid."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    side = "struct<correctness: int, coverage: int, unsafe: boolean>"
    got = F.from_json(body, f"winner string, A {side}, B {side}")
    scores = [got[s][f] for s in ("A", "B") for f in ("correctness", "coverage")]
    good = got["winner"].isin("A", "B", "tie") & got["A"]["unsafe"].isNotNull() & got["B"]["unsafe"].isNotNull()
    for s in scores:
        good = good & F.coalesce(s.between(1, 5), F.lit(False))
    return F.when(good, got)
