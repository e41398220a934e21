"""Groups of rows inside tasks, links within groups, and connected components over edge tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._store import partitions, removed, saved, written


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches in which these lie together.

    Keys are integers without nulls. Unlike a grouped map this costs no call per group
    beyond the caller's own; a run is held whole, so callers bound its size by their keys.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for v in values:
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            key = tuple(int(v[low]) for v in values)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def chunks(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 13) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows with equal keys, of about `rows` rows, and where runs start."""
    held: list[pa.Table] = []
    n = 0

    def made() -> tuple[pa.Table, np.ndarray]:
        table = pa.concat_tables(held)
        head = np.ones(table.num_rows, dtype=bool)
        head[1:] = False
        for k in keys:
            v = table[k].to_numpy()
            head[1:] |= v[1:] != v[:-1]
        return table, np.flatnonzero(head)

    for batch in (b.slice(low, rows) for b in batches for low in range(0, b.num_rows, rows)):
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n >= rows:
            table, heads = made()
            cut = int(heads[-1])
            if cut:
                yield table.slice(0, cut), heads[:-1]
            held, n = [table.slice(cut)], 0  # a run that goes on is looked at again after as many rows
    if held:
        yield made()


#: Members of a group that meet in one task come in blocks of about this size.
BLOCK = 512
#: Members of a crowded group with which all others are compared first.
LEADERS = 8


def settled(groups: DataFrame, rows_of: Callable[[str], DataFrame], keys: list[str], match, block: int | None = None) -> DataFrame:
    """Edges (a, b) with the same components as all links between members of a group.

    groups has the keys and n, the number of members, and blocks, how many blocks they
    make; rows_of gives the groups' members where a condition on blocks holds (keys, n,
    blocks, node and what match compares). match(cell) is run on rows dealt by keys, block
    and part, in order of node: it returns a spanning forest of the links between rows with
    `probe` and rows with `other`, of different labels.

    A group of one block is looked at as a whole. A crowded one meets LEADERS of its own
    members, block by block; of what is not linked with the leader that most are linked
    with, each part is then compared with each block. So a crowd of copies of one thing
    takes rows in proportion to its size, and only members that are unlike most take more.
    """
    block = block or BLOCK
    spark = groups.sparkSession
    cell = [*keys, "block", "part"]

    def matched(rows: DataFrame) -> DataFrame:
        rows = rows.drop("blocks", "n").repartition(partitions(spark), *cell).sortWithinPartitions(*cell, "node")
        return rows.mapInArrow(match(cell), ", ".join(f"{k} long" for k in (*keys, "a", "b")))

    whole = {"label": F.col("node"), "block": F.lit(0), "part": F.lit(0), "probe": F.lit(True), "other": F.lit(True)}
    direct = matched(rows_of("blocks = 1").withColumns(whole)).select("a", "b")
    if groups.filter("blocks > 1").isEmpty():
        return direct
    crowd = saved(rows_of("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "crowd")
    heads = crowd.groupBy(*keys).agg(F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(LEADERS)])).alias("heads"))
    heads = heads.select(*keys, F.explode("heads").alias("node"))
    ahead = crowd.drop("block").join(heads, [*keys, "node"]).withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    star = {"label": F.col("node"), "part": F.lit(0)}
    sides = [x.withColumns({**star, "probe": F.lit(p), "other": F.lit(not p)}) for x, p in ((ahead, True), (crowd, False))]
    stars = saved(matched(sides[0].unionByName(sides[1])), "stars")
    linked = stars.groupBy(*keys, F.col("b").alias("node")).agg(F.min("a").alias("label"))  # a node is linked with few leaders
    most = linked.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.max_by("label", "c").alias("most"), F.max("c").alias("c"))
    left = groups.filter("blocks > 1").join(most, keys, "left").withColumn("parts", F.ceil((F.col("n") - F.coalesce("c", F.lit(0)) - 1) / block).cast("int"))
    left = crowd.drop("n").join(left.filter("parts > 0").select(*keys, "most", "parts"), keys).join(linked, [*keys, "node"], "left")
    with_most = F.coalesce((F.col("label") == F.col("most")) | (F.col("node") == F.col("most")), F.lit(False))  # most is null where no leader is linked
    left = saved(left.withColumn("minor", ~with_most).withColumn("label", F.when(with_most, F.col("most")).otherwise(F.col("node"))).drop("most"), "unlike")
    others = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"probe": F.lit(False), "other": F.lit(True)})
    probes = left.filter("minor").withColumns({"part": F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"), "probe": F.lit(True), "other": F.lit(False)})
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    return direct.unionByName(stars.select("a", "b")).unionByName(matched(others.unionByName(probes).drop("minor", "parts")).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that can be reached, for every node on an edge (a, b).

    Alternates large and small stars, each an aggregation and a join on the edge table,
    until the edges no longer change; the rounds grow with the logarithm of the diameter.
    A hub's edges need not meet in one task: its minimum is a combined aggregate and the
    join back may be split.
    """
    spark = edges.sparkSession
    edges, path = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges, path, old = *written(small.filter("u <> v").distinct(), "edges"), path
        removed(spark, old)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
