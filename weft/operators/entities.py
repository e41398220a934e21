"""Names of a dictionary in texts, with their types and spans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.automaton import Automaton
from weft.sources.scratch import spread, written

#: Characters of the names whose automaton is sent to all tasks; larger dictionaries go in parts.
MOST_CHARACTERS = 1 << 22
#: Texts looked at together.
TEXTS = 1024


def _found(shared, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for low in range(0, len(texts), TEXTS):
                some = texts[low : low + TEXTS]
                rows = machine.leftmost_longest(some) if whole else list(zip(*(x.tolist() for x in machine.occurrences(some)), strict=True))
                of, start, name = ([r[k] for r in rows] for k in range(3))
                end = [s + int(machine.size[n]) for s, n in zip(start, name, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[low + i] for i in of], pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array([machine.names[n] for n in name], pa.string())],
                    names=["id", "start", "end", "name"],
                )

    return run


def mentions(docs: DataFrame, names: DataFrame, most: int = MOST_CHARACTERS) -> DataFrame:
    """id, start, end (characters from 0, half open), name: where names occur in docs (id, text).

    At each place the longest name counts, and what it covers is not looked at again. Empty
    and null names are none, null texts hold none. Rows with one id are texts of their own.
    The dictionary is sent to the tasks as an automaton. One of more than `most` characters
    is dealt in parts by first characters; what each finds then meets by row.
    """
    spark = docs.sparkSession
    names = names.select("name").filter("name <> ''").distinct()
    parts = -(-(names.agg(F.sum(F.char_length("name"))).first()[0] or 0) // most)
    shape = "id long, start long, end long, name string"
    if not parts:
        return spark.createDataFrame([], shape)
    part = F.pmod(F.xxhash64(F.left("name", F.lit(2))), F.lit(parts))
    machines = [spark.sparkContext.broadcast(Automaton(sorted(r.name for r in names.filter(part == p).collect()))) for p in range(parts)]  # about `most` characters each
    docs = spread(docs.select("id", "text"))
    if parts == 1:
        return docs.mapInArrow(_found(machines[0], True), shape)
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()))
    each = [rows.select(F.col("row").alias("id"), "text").mapInArrow(_found(m, False), shape) for m in machines]
    every = each[0]
    for one in each[1:]:
        every = every.unionByName(one)
    ordered = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "name")))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,back:bigint,name:string>>").alias("kept"))
    step = lambda acc, x: F.when(x["start"] >= acc["end"], F.struct((-x["back"]).alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    swept = every.groupBy(F.col("id").alias("row")).agg(F.aggregate(ordered, start, step)["kept"].alias("kept"))  # one text's finds
    return swept.select("row", F.explode("kept").alias("m")).join(rows.select("row", "id"), "row").select("id", "m.start", (-F.col("m.back")).alias("end"), "m.name")


def entities(docs: DataFrame, dictionary: DataFrame, most: int = MOST_CHARACTERS) -> DataFrame:
    """doc_id, name, type, first (characters from 1), times: mentions of a dictionary (name, type)."""
    found = mentions(docs.select(F.col("doc_id").alias("id"), "text"), dictionary, most)
    per = found.groupBy(F.col("id").alias("doc_id"), "name").agg((F.min("start") + 1).alias("first"), F.count(F.lit(1)).alias("times"))
    return per.join(dictionary.select("name", "type").distinct(), "name").select("doc_id", "name", "type", "first", "times")
