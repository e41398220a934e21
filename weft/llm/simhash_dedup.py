"""SimHash near-deduplication: counts of bits in segments, joined on a grid.

A fingerprint is embedded as its counts of ones in 32 segments of two bits. Two fingerprints
differ in at least as many bits as the Manhattan distance of their counts says, so all links
lie within that distance. Counts at most `distance` apart agree on all axes of all but
`distance` of the blocks of axes: for each choice of blocks the embedding is cut to a cell of
the grid, and only rows of one cell are compared, first by counts, then exactly.

Equal fingerprints are one node from the start. Cells of two are settled by their smallest and
largest member, within the aggregation; those of some more give a spanning forest each. The
members of crowded cells are not compared with each other: all fingerprints half the distance
away from a node are its ball, and nodes that share a point of their balls are linked, always
and only if they are within the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._groups import components
from weft.llm._store import saved
from weft.llm._text import byte_column

BITS = 64
#: Shingles hashed at once; longer texts take several rounds.
ROUND = 1 << 15
#: A fingerprint is heavy if one row in so many has it.
HEAVY = 1024
#: The lower bit of each segment of two.
LOW = 0x5555555555555555


def _long(x: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: each bit is that of more than half the hashes of its shingles.

    Shingles are `words` words, A-Z lower-cased, joined by spaces, repeats included; a text of
    fewer words is one shingle, one without words has fingerprint zero.
    """
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    start = [0, *np.cumsum([len(w) + 1 for w in parts]).tolist()]
    spans = list(zip(start, start[words:], strict=False)) or [(0, start[-1])]
    ones = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(spans), ROUND):
        some = spans[low : low + ROUND]
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], seed) for a, b in some), dtype="<u8", count=len(some))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(spans)))


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_column(batch.column("text"))
            found = [_long(fingerprint(data[a:b].tobytes(), words)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fingerprint"])

    return run


def _counts(x: Column) -> Column:
    """The counts of ones of all segments in unary: a segment's ones, moved to its lower end.

    The Manhattan distance of two such rows of counts is the number of bits they differ in.
    """
    above = F.shiftrightunsigned(x, 1)
    return x.bitwiseOR(above).bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(x.bitwiseAND(above).bitwiseAND(F.lit(LOW)), 1))


def _cells(counts: Column, distance: int, blocks: int) -> Column:
    """The grid cells of a row of counts: one for each choice of blocks that may not differ."""
    width = BITS // blocks
    masks = [sum(((1 << width) - 1) << width * b for b in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    return F.posexplode(F.array(*[counts.bitwiseAND(F.lit(_long(m))) for m in masks])).alias("choice", "cell")


def _forests(distance: int):
    """Spanning forests (a, b) of the links between the members of each cell."""

    def counts(x: np.ndarray) -> np.ndarray:
        low, above = np.uint64(LOW), x >> np.uint64(1)
        return ((x | above) & low) | ((x & above & low) << np.uint64(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column("members"):
                x = members.values.to_numpy().view(np.uint64)
                near = np.bitwise_count(counts(x)[:, None] ^ counts(x)) <= distance
                near &= np.bitwise_count(x[:, None] ^ x) <= distance
                tree = np.arange(len(x))
                for i, j in np.argwhere(np.triu(near, 1)).tolist():
                    if tree[i] != tree[j]:
                        a.append(int(x[i].view(np.int64)))
                        b.append(int(x[j].view(np.int64)))
                        tree[tree == tree[j]] = tree[i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _ball(x: Column, radius: int) -> Column:
    """All fingerprints at most `radius` bits from x."""
    flips = [sum(1 << i for i in chosen) for r in range(radius + 1) for chosen in combinations(range(BITS), r)]
    return F.explode(F.transform(F.array(*[F.lit(_long(m)) for m in flips]), lambda m: x.bitwiseXOR(m)))


def simhash_dedup(docs: DataFrame, words: int = 3, distance: int = 2, blocks: int = 8, crowd: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Texts whose fingerprints differ in at most `distance` bits (an even number) are linked;
    component_id is the smallest id reachable over links, null if all ids there are null.
    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated
    ids and rows count as what their texts are; other columns are left out; an empty table
    gives no rows. A text of any length is hashed whole, in rounds of bounded memory beyond
    its own words.

    `blocks` (a divisor of 64) trades cells a fingerprint (28 of 8) for rows a cell; `crowd`
    is the number of members up to which those of a cell are compared. Neither changes the
    result.
    """
    if distance % 2 or BITS % blocks or blocks <= distance:
        raise ValueError("distance must be even, blocks a divisor of 64 above the distance")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = saved(docs.mapInArrow(_prints(words), "doc_id long, fingerprint long"), "prints")
    nodes = saved(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows")), "nodes")
    cells = nodes.select("fingerprint", _cells(_counts(F.col("fingerprint")), distance, blocks))
    sized = cells.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b"))
    sized = saved(sized.filter("n > 1"), "cells")

    apart = lambda one, two: F.bit_count(one.bitwiseXOR(two)) <= distance
    a, b = F.col("a"), F.col("b")
    pairs = sized.filter("n = 2").filter(apart(_counts(a), _counts(b))).filter(apart(a, b)).select("a", "b")
    some = cells.join(sized.filter((F.col("n") > 2) & (F.col("n") <= crowd)).select("choice", "cell"), ["choice", "cell"])
    few = some.groupBy("choice", "cell").agg(F.collect_list("fingerprint").alias("members")).select("members")  # `crowd` members at most
    links = pairs.unionByName(few.mapInArrow(_forests(distance), "a long, b long"))

    crowded = cells.join(sized.filter(F.col("n") > crowd).select("choice", "cell"), ["choice", "cell"], "left_semi").select("fingerprint").distinct()
    points = crowded.select("fingerprint", _ball(F.col("fingerprint"), distance // 2).alias("point"))
    points = points.join(points.groupBy("point").agg(F.min("fingerprint").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "point")
    links = links.unionByName(points.filter("first < fingerprint").select(F.col("first").alias("a"), F.col("fingerprint").alias("b")))

    joined = components(links.distinct()).withColumnRenamed("node", "fingerprint")
    low = joined.join(nodes, "fingerprint")
    named = low.join(low.groupBy("root").agg(F.min("low").alias("component")), "root").select("fingerprint", "component")
    named = nodes.join(named, "fingerprint", "left").select("fingerprint", "rows", F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("component")).alias("component_id"))
    # Of fingerprints with over one row in HEAVY there are fewer than HEAVY; their rows stay where they are.
    named = saved(named.withColumn("heavy", F.col("rows") > prints.count() // HEAVY).drop("rows"), "named")
    heavy = F.broadcast(named.filter("heavy").drop("heavy"))
    light = prints.join(heavy, "fingerprint", "left_anti").join(named.filter("not heavy").drop("heavy"), "fingerprint")
    out = prints.join(heavy, "fingerprint").unionByName(light)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), BITS // 4, "0")).alias("fingerprint"), "component_id")

