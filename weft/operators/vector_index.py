"""An approximate index for vectors, kept as tables: coarse lists and residual codes.

Vectors of length one are dealt to the list of their nearest centroid and kept there as the
difference from it, a byte per dimension. A search ranks the centroids for each query and
joins the query with the rows of its nearest lists; the best by code are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.records import of_dimension
from weft.operators.retrieval import cosines, nearest, ranked
from weft.sources.scratch import written

#: Vectors that train the centroids, those whose ids have the smallest hashes; all are indexed.
SAMPLE = 1 << 16
MOST_LISTS = 4096
#: Rows of a list and queries that meet in one task at once.
BLOCK, QUERIES = 1 << 14, 1 << 11
#: Sample vectors whose exact neighbours tell how many lists to probe.
TRIALS = 256
#: For each of the k best asked for, so many are compared exactly.
SPARE = 3


@dataclass(frozen=True)
class VectorIndex:
    """centroids, how many of their lists a search probes, and the rows: list, id, scale, code."""

    centroids: np.ndarray
    probes: int
    rows: DataFrame


def _unit(column: pa.Array, dimension: int) -> np.ndarray:
    """Vectors as rows of length one; a zero vector stays zero."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimension)
    norm = np.linalg.norm(values, axis=1, keepdims=True)
    return values / np.where(norm > 0, norm, 1)


def _sums(centroids):
    """Per task and list, how many vectors are nearest to its centroid, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        total, n = np.zeros(c.shape), np.zeros(len(c), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _unit(batch.column("v"), c.shape[1])
                near = (v @ c.T).argmax(1)
                np.add.at(total, near, v)
                n += np.bincount(near, minlength=len(c))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array([total[i].tobytes() for i in some], pa.binary())], names=["list", "n", "total"])

    return run


def _fit(sample: DataFrame, lists: int, rounds: int) -> np.ndarray:
    """Centroids of length one: the directions of their lists' sums, round after round."""
    spark = sample.sparkSession
    first = sample.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(lists).select("v").collect()
    c = np.array([r.v for r in first], dtype=np.float32)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(c)
        total = np.zeros(c.shape)
        for r in sample.select("v").mapInArrow(_sums(shared), "list long, n long, total binary").collect():  # lists x tasks rows
            total[r.list] += np.frombuffer(r.total)
        shared.destroy()
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c).astype(np.float32)
    return c


def _dealt(centroids, probes: int):
    """Each vector's nearest lists; without probes the nearest and its code there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = _unit(batch.column("v"), c.shape[1]), batch.column("id")
            score = v @ c.T
            if probes:
                order = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                take = pa.array(np.repeat(np.arange(len(v)), order.shape[1]))
                place = np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(v))
                vectors = pa.array([x.tobytes() for x in v], pa.binary()).take(take)
                yield pa.RecordBatch.from_arrays([pa.array(order.ravel()), ids.take(take), pa.array(place), vectors], names=["list", "id", "place", "unit"])
            else:
                near = score.argmax(1)
                rest = v - c[near]
                scale = np.maximum(np.abs(rest).max(1), 1e-12) / 127
                codes = np.rint(rest / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(near), ids, pa.array(scale.astype(np.float32)), pa.array([x.tobytes() for x in codes], pa.binary())], names=["list", "id", "scale", "code"])

    return run


def _lists_of(vectors: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    return vectors.mapInArrow(_dealt(shared, probes), "list long, id long, " + ("place int, unit binary" if probes else "scale float, code binary"))


def build(vectors: DataFrame, lists: int | None = None, recall: float = 0.95, k: int = 30, rounds: int = 8, sample: int = SAMPLE) -> VectorIndex:
    """The index of vectors (id, v): one pass over all of them, some over a sample.

    Null vectors are left out; one of another length than the first is an error. Zero
    vectors are in some list with similarity 0. lists is by default the root of the number
    of vectors, at most MOST_LISTS. How many of them a search probes is found on the sample:
    as few as hold the share `recall` of the k nearest sample vectors of TRIALS others.
    """
    vectors = vectors.filter("v is not null and id is not null").select("id", "v")
    one = vectors.select(F.size("v").alias("n")).first()
    if one is None:
        return VectorIndex(np.zeros((0, 0), dtype=np.float32), 0, vectors.sparkSession.createDataFrame([], "list long, id long, scale float, code binary"))
    vectors = vectors.withColumn("v", of_dimension(F.col("v"), one.n))
    some = written(vectors.orderBy(F.xxhash64("id"), "id").limit(sample))
    lists = lists or int(np.clip(round(vectors.count() ** 0.5), 1, MOST_LISTS))
    centroids = _fit(some, lists, rounds)
    trials = some.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(TRIALS).withColumnRenamed("id", "qid")
    ranks = _lists_of(trials.withColumnRenamed("qid", "id"), centroids, len(centroids)).select(F.col("id").alias("qid"), "list", "place")
    home = _lists_of(some, centroids, 1).select("id", "list")
    true = nearest(some, trials, k).filter("qid <> id").select("qid", "id")
    found = true.join(home, "id").join(ranks, ["qid", "list"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per list
    n = np.zeros(len(centroids) + 1)
    for r in found:
        n[r.place] = r.n
    share = np.cumsum(n) / max(n.sum(), 1)
    probes = int(np.argmax(share >= recall)) if n.sum() else len(centroids)
    return VectorIndex(centroids, max(probes, 1), written(_lists_of(vectors, centroids, 0)))


def _scan(centroids, k: int):
    """Per query and cell (list, block, part) the k best ids by code; queries come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        cell, asked, units, best = None, [], [], None

        def made() -> Iterator[pa.RecordBatch]:
            if asked and best is not None:
                qid = np.repeat(np.array(asked), best[0].shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(best[0].ravel()), pa.array(best[1].ravel().astype(np.float64))], names=["qid", "id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(x).to_numpy() for x in ("list", "block", "part", "member")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                now, member = tuple(keys[low, :3].tolist()), keys[low, 3]
                if now != cell:
                    yield from made()
                    cell, asked, units, best = now, [], [], None
                ids, code = batch.column("id").slice(low, high - low).to_numpy(), batch.column("code").slice(low, high - low).to_pylist()
                if not member:
                    asked += ids.tolist()
                    units.append(np.frombuffer(b"".join(code), dtype=np.float32).reshape(len(code), -1))
                elif asked:
                    q = np.concatenate(units)
                    rest = np.frombuffer(b"".join(code), dtype=np.int8).reshape(len(code), -1).astype(np.float32)
                    scale = batch.column("scale").slice(low, high - low).to_numpy()
                    score = (q @ c[now[0]])[:, None] + (q @ rest.T) * scale
                    ids = np.broadcast_to(ids, score.shape)
                    if best is not None:
                        ids, score = np.concatenate([best[0], ids], axis=1), np.concatenate([best[1], score], axis=1)
                    if score.shape[1] > k:
                        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                        ids, score = np.take_along_axis(ids, top, 1), np.take_along_axis(score, top, 1)
                    best = ids, score
        yield from made()

    return run


def search(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int = 30, probes: int | None = None) -> DataFrame:
    """qid, id, score, rank of about the k vectors (id, v) most similar to each query (qid, v).

    Every query meets the rows of its nearest lists, all queries in one pass: lists are
    split in blocks of BLOCK rows and groups of QUERIES queries, so that none is held in one
    task however many have it. SPARE * k a query are then fetched by id and compared exactly.
    """
    probes = min(probes or index.probes, len(index.centroids))
    if not probes:
        return vectors.sparkSession.createDataFrame([], "qid long, id long, score double, rank int")
    queries = queries.filter("v is not null and qid is not null").select("qid", of_dimension(F.col("v"), index.centroids.shape[1]).alias("v"))
    asked = written(_lists_of(queries.select(F.col("qid").alias("id"), "v"), index.centroids, probes))
    size = lambda df, n, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    cells = F.broadcast(written(size(index.rows, BLOCK, "blocks").join(size(asked, QUERIES, "parts"), "list")))  # MOST_LISTS rows at most
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.col(n)).cast("int")
    side = ["list", "block", "part", "member", "id", "scale", "code"]
    members = index.rows.join(cells, "list").withColumns({"block": one("blocks"), "part": spread("parts"), "member": F.lit(1)}).select(*side)
    probing = asked.join(cells, "list").withColumns({"part": one("parts"), "block": spread("blocks"), "member": F.lit(0), "scale": F.lit(0.0).cast("float")}).withColumnRenamed("unit", "code").select(*side)
    shared = vectors.sparkSession.sparkContext.broadcast(index.centroids)
    rows = probing.unionByName(members).repartition("list", "block", "part").sortWithinPartitions("list", "block", "part", "member")
    near = ranked(rows.mapInArrow(_scan(shared, SPARE * k), "qid long, id long, score double"), SPARE * k).select("qid", "id")
    pairs = near.join(vectors.select("id", "v"), "id").join(queries.select("qid", F.col("v").alias("asked")), "qid")
    return ranked(cosines(pairs), k)
