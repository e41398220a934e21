"""Records: validation, lookups, counters of stages, links between neighbours, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.sources.scratch import written

#: Numbers of an id are taken modulo this, and leave so many places for kinds.
SEQUENCE_MODULUS, KIND_PLACES = 20_000_000, 100
SHORTEST_TIME = 1e-9


def of_kinds(rows: DataFrame, column: str, kinds: list[str], every: bool = False) -> DataFrame:
    """Rows whose column is one of the kinds; all rows with every. Null is no kind."""
    return rows if every else rows.filter(F.col(column).isin(kinds))


def matching(rows: DataFrame, contains: dict[str, str | None], any_of: dict[str, list | None] | None = None) -> DataFrame:
    """Rows whose columns contain the given texts in any case and are among the given values.

    Conditions are joined by AND; those that are None or empty are left out. % and _ in a
    text are wildcards.
    """
    terms = [F.col(c).ilike(f"%{v}%") for c, v in contains.items() if v]
    terms += [F.col(c).isin(v) for c, v in (any_of or {}).items() if v]
    return rows.filter(reduce(lambda a, b: a & b, terms)) if terms else rows


def problems(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in their order; a rule that is null is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def quarantined(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of those they break."""
    checked = rows.withColumn("problems", problems(rules))
    return checked.filter(F.size("problems") == 0).drop("problems"), checked.filter(F.size("problems") > 0)


def looked_up(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of the other table's row of the same key; a missing key is an error.

    The key must be unique in the other table. Which side travels is left to the optimizer.
    """
    found = rows.join(other.withColumn("__found", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.filter(F.when(F.col("__found"), F.lit(True)).otherwise(missing.cast("boolean"))).drop("__found")


def exact_sum(c: Column) -> Column:
    """The sum of numbers with up to nine decimals, the same in whatever order they come.

    Sums of doubles depend on it, so that equal sums differ and what is ordered by them is
    left to chance. Where a number has more decimals, or none at all, doubles are added.
    """
    held = c.try_cast("decimal(27,9)")
    exact = F.count(c) == F.count_if(held.cast("double") == c)
    return F.when(exact, F.sum(held).cast("double")).otherwise(F.sum(c))


def funnel(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """One row of counters: raw, then per stage the rows that pass it and all before it."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("raw")]
    for name, ok in stages.items():
        passed = passed & F.coalesce(ok, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return rows.agg(*counts)


def throughput(tokens: Column, seconds: Column) -> Column:
    """Tokens a second, with a least time instead of none."""
    return tokens / F.greatest(seconds, F.lit(SHORTEST_TIME))


def linked(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, sequence) with chunk_id, parent_id and the ids before and after."""
    ids = chunks.withColumn("parent_id", F.format_string("%d", "doc_id")).withColumn("chunk_id", F.format_string("%d_C%05d", "doc_id", F.col("sequence") + 1))
    order = Window.partitionBy("doc_id").orderBy("sequence")
    return ids.withColumns({"prev_id": F.lag("chunk_id").over(order), "next_id": F.lead("chunk_id").over(order)})


def paths(rows: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, rank) with `path`: the lines of the headings they lie under.

    An ancestor is the last heading of a smaller rank (1 to 3) before the line with no
    heading of that rank or a smaller one in between; a line without rank lies under all.
    """
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = {r: F.max(F.when(F.col("rank") == r, F.col("line_no"))).over(before) for r in (1, 2, 3)}
    out = rows.withColumns({f"__{r}": c for r, c in last.items()})
    seen, nodes = F.lit(0), []
    for r in (1, 2, 3):
        at = F.when((F.coalesce("rank", F.lit(4)) > r) & (F.col(f"__{r}") > seen), F.col(f"__{r}"))
        seen = F.greatest(seen, F.coalesce(f"__{r}", F.lit(0)))
        nodes.append(at)
    return out.withColumn("path", F.array_compact(F.array(*nodes))).drop("__1", "__2", "__3")


def best_and_last(rows: DataFrame, group: str, value: str, order: list[str], n: int = 10) -> DataFrame:
    """The row of the smallest value per group and its n last ones, in a column `report`."""
    last = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    best = Window.partitionBy(group).orderBy(F.asc_nulls_last(value), *order)
    pick = lambda w, k, name: rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).withColumn("report", F.lit(name))
    return pick(best, 1, "best").unionByName(pick(last, n, "last"))


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per key the last row by the order, as a combined aggregate instead of a window."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, "__r.*")


def first_units(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows by the order: each task keeps n."""
    return rows.orderBy(*order).limit(n)


def of_dimension(v: Column, dimension: int) -> Column:
    """The vector; an error if it has another length."""
    told = F.concat(F.lit(f"expected {dimension} dimensions, got "), F.size(v).cast("string"))
    return F.when(F.size(v) == dimension, v).when(v.isNotNull(), F.raise_error(told).cast("array<float>"))


def sibling_sequence(node_id: Column, rank: Column | int) -> Column:
    """A stable number among siblings: the trailing number of the id, then the rank of its kind.

    An id without a trailing number gives the first twelve hex digits of its digest.
    """
    digits = F.regexp_extract(node_id, r"([0-9]+)$", 1)
    number = F.when(digits != "", digits.try_cast("decimal(38,0)"))
    number = F.coalesce(number, F.conv(F.substring(F.sha2(node_id, 256), 1, 12), 16, 10).cast("decimal(38,0)"))
    return (F.pmod(number, F.lit(SEQUENCE_MODULUS)).cast("long") * KIND_PLACES + rank).cast("long")


def numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Rows with `number`, their place (from 1) in the group by order, which is unique there.

    Rows are dealt in ranges of group and order; each range numbers its own, and the counts
    of the ranges before it are added, so that a group of most rows is spread.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, group, order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy(F.col(group).alias("__g"), F.col("__range").alias("__r")).agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = counts.select("__g", "__r", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(group, "__range").orderBy(order))
    out = dealt.withColumn("__own", own).join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r")))
    return out.withColumn("number", F.col("__own") + F.col("__before")).drop("__own", "__before", "__range", "__g", "__r")
