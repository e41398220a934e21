"""The prefix trie of conversations, screened by a count-min sketch.

A node is a distinct sequence of first turns; its members are the conversations that start
with it. Every prefix of every conversation has a key of 128 bits, made of running sums over
its turns' digests. A count-min sketch of all keys follows: where its estimate is one, the
prefix has a single member, and so have all longer prefixes; such tails are nodes as they
stand. Only prefixes that may be shared are shuffled, by their keys, for exact grouping.

Sums over subtrees need no descent. The smallest member of a node owns it. A conversation
owns its nodes from some depth on, so that each member of a node adds what its own turns and
leaf bring to the subtree, and that is known from the depth at which its ownership starts.

Texts are digested in the scan and never shuffled. No step holds a conversation, a node's
members or a list of ids whole: a conversation or prefix of any share of the rows is spread
by running sums over ranges, combined aggregates, and ids hashed in pieces.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._ordered import running
from weft.llm._store import partitions, saved

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the sketch; cells of each for a prefix, and at most (a quarter of so many bytes is broadcast).
ROWS, CELLS, MOST_CELLS = 4, 8, 1 << 24
#: Cells of a piece of the sketch that travels as one row.
SLICE = 1 << 15

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 1), digest and words of every turn; SHA-256 of role and text.

    Null turns come first; turns of one number are in order of their digests, repeated rows
    are turns of their own. Null roles and texts count as empty. Rows without conv_id belong
    to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return running(rows, ["conv_id", "turn", "digest"], {"place": F.lit(1)}, group="conv_id").select("conv_id", "place", "digest", "words")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(",", depth, *sums), 256), 1, 32))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, n, words, before (words of earlier turns), key and above (that of one turn less).

    Keys are of 128 bits under a random number drawn for the call; they appear in no result.
    """
    for k in range(2):
        mixed = F.xxhash64(F.lit(secrets.randbits(62)), "depth", "digest")
        turns = turns.withColumns({f"t{2 * k}": F.shiftrightunsigned(mixed, 32), f"t{2 * k + 1}": mixed.bitwiseAND(F.lit(0xFFFFFFFF))})
    rows = running(turns, ["conv_id", "depth"], {**{f"s{k}": F.col(f"t{k}") for k in range(4)}, "upto": F.col("words")}, group="conv_id")
    above = _key(F.col("depth") - 1, [F.col(f"s{k}") - F.col(f"t{k}") for k in range(4)])
    return rows.select(
        "conv_id", "depth", "n", "words", (F.col("upto") - F.col("words")).alias("before"),
        _key(F.col("depth"), [F.col(f"s{k}") for k in range(4)]).alias("key"), F.when(F.col("depth") > 1, above).alias("above"),
    )


def _places(keys: pa.Array, cells: int) -> np.ndarray:
    """The cell of each key in each row of the sketch, rows one after another."""
    pair = np.frombuffer(b"".join(keys.to_pylist()), dtype="<u8").reshape(-1, 2)
    r = np.arange(ROWS, dtype=np.uint64)
    return ((pair[:, :1] + r * pair[:, 1:]) & np.uint64(cells - 1)).astype(np.int64) + np.arange(ROWS) * cells


def _counted(cells: int):
    """The sketch of a task's keys in slices; counts stop at two, which is all that is asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.zeros(ROWS * cells, dtype=bool)
        two = np.zeros(ROWS * cells, dtype=bool)
        for batch in batches:
            if batch.num_rows:
                at, n = np.unique(_places(batch.column("key"), cells), return_counts=True)
                two[at[(n > 1) | one[at]]] = True
                one[at] = True
        size = min(SLICE, ROWS * cells)
        for low in range(0, ROWS * cells, size):
            if one[low : low + size].any():
                bits = [np.packbits(x[low : low + size]).tobytes() for x in (one, two)]
                yield pa.RecordBatch.from_arrays([pa.array([low // size]), pa.array([bits[0]], pa.binary()), pa.array([bits[1]], pa.binary())], names=["slice", "one", "two"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of one number, which lie together, as one; only the cells that count two or more."""
    now, one, two = None, np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.uint8)

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([two.tobytes()], pa.binary())], names=["slice", "two"])

    for batch in batches:
        for k, x, y in zip(*(batch.column(c).to_pylist() for c in ("slice", "one", "two")), strict=True):
            x, y = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
            if k != now:
                if now is not None:
                    yield made()
                now, one, two = k, x, y
            else:
                one, two = one | x, two | y | (one & x)
    if now is not None:
        yield made()


def _screened(sketch: Broadcast, cells: int):
    """alone and above_alone: whether the sketch proves that the prefix has one member."""

    def alone(keys: pa.Array) -> np.ndarray:
        at = _places(keys, cells)
        bits = sketch.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
        return ~bits.astype(bool).all(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            above = batch.column("above")
            single = np.zeros(batch.num_rows, dtype=bool)
            inner = above.is_valid().to_numpy(zero_copy_only=False)
            if inner.any():
                single[inner] = alone(above.filter(pa.array(inner)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone(batch.column("key"))), pa.array(single)], names=[*batch.schema.names, "alone", "above_alone"])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each key in sorted order, joined by commas, in a piece for each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
        heads = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
        ends = [*heads[1:], len(keys)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[a] for a in heads], pa.binary()), pa.array([ids[a] for a in heads]), pa.array([",".join(map(str, ids[a:b])) for a, b in zip(heads, ends, strict=True)])],
            names=["key", "first", "ids"],
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, fed one after another."""
    now, sha = None, hashlib.sha256()

    def made(keys: list, found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends_sha256"])

    for batch in batches:
        keys, found = [], []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key == now:
                sha.update(b"," + ids.encode())
                continue
            if now is not None:
                keys.append(now)
                found.append(sha.hexdigest())
            now, sha = key, hashlib.sha256(ids.encode())
        yield made(keys, found)
    if now is not None:
        yield made([now], [sha.hexdigest()])


def _ends(rows: DataFrame) -> DataFrame:
    """key, ends_sha256: the hash of the ids of each key, ascending and joined by commas."""
    n = partitions(rows.sparkSession)
    lists = rows.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_listed, "key binary, first long, ids string")
    return lists.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of turns (conv_id, depth, n, digest, words) and convs (conv_id, n), as prefix_trie.

    depth runs from 1 to n, the conversation's number of turns; convs has each conversation
    once, those without turns as well.
    """
    spark = turns.sparkSession
    every = saved(prefixes(turns), "prefixes")
    cells = 1 << max(3, min(MOST_CELLS, CELLS * every.count()).bit_length() - 1)
    slices = every.select("key").mapInArrow(_counted(cells), "slice long, one binary, two binary")
    slices = slices.repartition(partitions(spark), "slice").sortWithinPartitions("slice").mapInArrow(_merged, "slice long, two binary")
    sketch = np.zeros(max(1, ROWS * cells // 8), dtype=np.uint8)
    size = min(SLICE, ROWS * cells) // 8
    for r in slices.collect():  # ROWS * MOST_CELLS bits at most
        sketch[r.slice * size : (r.slice + 1) * size] = np.frombuffer(r.two, dtype=np.uint8)
    sketch = spark.sparkContext.broadcast(sketch)
    every = saved(every.mapInArrow(_screened(sketch, cells), every.schema.simpleString()[7:-1] + ",alone:boolean,above_alone:boolean"), "screened")
    sketch.destroy()

    tails, shared = every.filter("alone"), every.filter("not alone")
    groups = shared.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"), F.max("n").alias("deepest"),
        F.min("before").alias("before"), F.min("above").alias("above"), F.max("above_alone").alias("above_alone"),
    )
    groups = saved(groups, "groups")
    # From where each conversation owns its nodes, and whether it owns a leaf.
    start, last = F.struct("depth", "before"), F.col("alone") & (F.col("depth") == F.col("n"))
    by_tail = every.groupBy("conv_id").agg(
        F.max("n").alias("n"), F.max(F.col("before") + F.col("words")).alias("total"), F.min(F.when(F.col("alone"), start)).alias("of_tail"), F.max(last).alias("tail_leaf")
    )
    by_group = groups.groupBy("conv_id").agg(F.min(start).alias("of_group"), F.max(F.col("deepest") == F.col("depth")).alias("group_leaf"))
    own = by_tail.join(by_group, "conv_id", "left").withColumn("of", F.least("of_tail", "of_group"))
    own = own.select(
        "conv_id", F.coalesce("of.depth", F.col("n") + 1).alias("owns_from"), F.coalesce("of.before", "total").alias("not_owned"),
        (F.col("tail_leaf") | F.coalesce("group_leaf", F.lit(False))).cast("long").alias("leaf"), F.col("n").alias("turns"),
    )
    own = saved(own, "owners")

    def child(depth: Column) -> Column:
        return ((F.col("owns_from") <= depth + 1) & (depth < F.col("turns"))).cast("long")

    sums = shared.join(own, "conv_id").groupBy("key").agg(
        F.sum(child(F.col("depth"))).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("not_owned") - F.col("before"), F.lit(0))).alias("saved_tokens")
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    top = own.agg(F.sum(child(F.lit(0))).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("not_owned").alias("saved_tokens"))
    root = root.crossJoin(top).filter("n_convs > 0").select(  # one row each
        F.lit(b"").alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
    whole = root.select(F.col("conv_id").alias("root_conv"))

    ends = shared.filter("depth = n").select("key", "conv_id").unionByName(convs.filter("n = 0").select(F.lit(b"").alias("key"), "conv_id"))
    nodes = groups.join(sums, "key").select("key", "conv_id", "depth", "above", "above_alone", "n_convs", "n_children", "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("end"))
    single = tails.select(
        "key", "conv_id", "depth", "above", "above_alone", F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("depth") == F.col("n"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.sha2(F.lit(""), 256)).alias("end"),
    )
    # Within a tail the parent is known; below a group it is looked up.
    inner = single.filter("above_alone").withColumn("parent_conv_id", F.col("conv_id")).drop("above", "above_alone")
    outer = single.filter("not above_alone").unionByName(nodes)
    parents = groups.select(F.col("key").alias("above"), F.col("conv_id").alias("of_parent"))
    outer = outer.join(parents, "above", "left").crossJoin(F.broadcast(whole))  # one row
    parent = F.when(F.col("depth") == 1, F.col("root_conv")).when(F.col("above_alone"), F.col("conv_id")).otherwise(F.col("of_parent"))
    outer = outer.withColumn("parent_conv_id", parent).drop("above", "above_alone", "of_parent", "root_conv")
    open_ = outer.filter("end is null").drop("end").unionByName(root).join(_ends(ends), "key", "left")
    open_ = open_.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    done = inner.unionByName(outer.filter("end is not null")).withColumnRenamed("end", "ends_sha256")
    return open_.select(*NODE).unionByName(done.select(*NODE))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct sequence of first turns (role and text), from the root of depth 0.

    conv_id is the smallest member, the conversations that start so; parent_conv_id that of
    the node above (root: null); n_convs counts members, n_children the nodes below, n_leaves
    the childless ones in the subtree. saved_tokens sums over the subtree (n_convs - 1) times
    the words of the last turn; ends_sha256 is the SHA-256 of the ids of members that end here,
    ascending and joined by commas.

    Turns are ordered and null values taken as numbered() says; other columns are left out.
    A text of any length is digested in its row. A table without conversations has no nodes.
    """
    rows = saved(numbered(turns, conv_col, turn_col, role_col, text_col), "turns")
    convs = saved(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conversations")
    return trie(rows.withColumnRenamed("place", "depth").join(convs, "conv_id"), convs)
