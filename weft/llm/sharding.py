"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows with equal text are one atom. The atoms, in order of their smallest identifier, are
cut into contiguous shards whose largest size is as small as can be: the smallest feasible
capacity is found by binary search, each candidate being checked by filling shards
greedily.

The search needs only a few positions of the running sum. The driver therefore holds a
bounded number of known boundaries (LOOK), with which a check has an optimistic and a
pessimistic answer; where these differ, the boundaries in the few intervals concerned are
fetched, until both agree on the exact capacity. Each such round narrows the intervals by
about LOOK / shards, so billions of atoms need two or three.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._ordered import running
from weft.llm._store import saved

#: Boundaries the driver asks for at once.
LOOK = 1 << 15
#: Windows of the line that one such request names.
WINDOWS = 64
ROW_BYTES = 16


class Boundaries:
    """Where atoms end on the line from 0 to total, as far as known.

    hidden[i]: boundaries exist between at[i - 1] and at[i] that are not known.
    """

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total
        self.at, self.hidden = [0, total], [False, True]
        self.unclear: set[int] = set()

    def below(self, x: int, hopeful: bool = False) -> int:
        """The largest boundary <= x; noted as unclear if it may be an unknown one."""
        if x >= self.total:
            return self.total
        i = bisect_right(self.at, x)
        if self.hidden[i] and x > self.at[i - 1]:
            self.unclear.add(i)
            return x if hopeful else self.at[i - 1]
        return self.at[i - 1]

    def above(self, x: int) -> int:
        """The smallest boundary >= x."""
        if x <= 0:
            return 0
        i = bisect_left(self.at, x)
        if self.hidden[i] and x < self.at[i]:
            self.unclear.add(i)
        return self.at[i]

    def span(self, low: int, high: int) -> None:
        """Note every interval that meets [low, high], as one window."""
        for i in range(max(1, bisect_right(self.at, low)), min(len(self.at) - 1, bisect_left(self.at, high)) + 1):
            self.unclear.add(i)

    def fetch(self) -> None:
        """Learn up to LOOK boundaries in the intervals noted."""
        windows: list[list[int]] = []
        for i in sorted(self.unclear):
            if windows and windows[-1][1] == self.at[i - 1]:
                windows[-1][1] = self.at[i]
            else:
                windows.append([self.at[i - 1], self.at[i]])
        self.unclear.clear()
        gaps = sorted((b[0] - a[1] for a, b in zip(windows, windows[1:], strict=False)), reverse=True)
        if len(gaps) >= WINDOWS:  # bridge the narrow gaps: what lies in them is asked for again
            apart, wide = gaps[WINDOWS - 1], [windows[0]]
            for w in windows[1:]:
                if w[0] - wide[-1][1] > apart:
                    wide.append(w)
                else:
                    wide[-1][1] = w[1]
            windows = wide
        end, first = F.col("end"), 0
        bucket, inside = F.lit(None).cast("long"), F.lit(False)
        for a, b in windows:
            here = (end > a) & (end <= b)
            each = max(LOOK // len(windows), 2 * (bisect_right(self.at, b) - bisect_right(self.at, a)))  # finer than before
            width = -(-(b - a) // each)
            bucket = F.when(here, F.lit(first) + F.floor((end - a - 1) / F.lit(width)).cast("long")).otherwise(bucket)
            inside, first = inside | here, first + each
        rows = self.ends.filter(inside).groupBy(bucket.alias("k")).agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count(F.lit(1)).alias("n")).collect()
        # Both ends of a bucket become known, so that even a bucket that held all shrinks.
        found = {r.high: r.n > 2 for r in rows} | {r.low: False for r in rows}
        known = dict(zip(self.at, self.hidden, strict=True))
        for a, b in windows:
            for x in self.at[bisect_right(self.at, a) : bisect_right(self.at, b)]:
                known.pop(x, None)
        known.update(found)
        self.at = sorted(known)
        self.hidden = [known[x] for x in self.at]


def _fill(line: Boundaries, capacity: int, shards: int, hopeful: bool) -> list[int] | None:
    """Greedy cuts at this capacity; None if the last shard would exceed it."""
    cuts, at = [], 0
    for _ in range(shards):
        at = line.below(at + capacity, hopeful)
        cuts.append(at)
    return cuts if at >= line.total else None


def _smallest(line: Boundaries, least: int, shards: int, hopeful: bool) -> int:
    low, high = least, line.total
    while low < high:
        mid = (low + high) // 2
        if _fill(line, mid, shards, hopeful):
            high = mid
        else:
            low = mid + 1
    return low


def _even(line: Boundaries, capacity: int, shards: int) -> list[int]:
    """Cuts that hold the capacity and lie as near as they can to equal shares."""
    latest = [line.total]
    for _ in range(shards - 1):
        latest.append(line.above(latest[-1] - capacity))
    earliest = latest[::-1]
    cuts, at = [], 0
    for i in range(1, shards):
        ideal = line.total * i // shards
        high = line.below(at + capacity)
        low = max(at, earliest[i - 1])
        down, up = line.below(ideal), line.above(ideal)
        best = down if ideal - down <= up - ideal else up
        at = min(max(best, low), high)
        cuts.append(at)
    return cuts


def cut(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and shards - 1 cuts, of atoms that end at ends.end."""
    line = Boundaries(ends, total)
    least = max(-(-total // shards), largest)
    while True:
        low, high = _smallest(line, least, shards, True), _smallest(line, least, shards, False)
        line.unclear.clear()
        if low == high:
            cuts = _even(line, low, shards)
            if not line.unclear:
                return low, cuts
        else:
            for a, b in zip(_fill(line, low, shards, False) or _cuts_to_end(line, low, shards), _fill(line, high, shards, True), strict=True):
                line.span(a, b)
        line.fetch()


def _cuts_to_end(line: Boundaries, capacity: int, shards: int) -> list[int]:
    cuts, at = [], 0
    for _ in range(shards):
        at = line.below(at + capacity)
        cuts.append(at)
    return cuts


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 16; null counts as the empty text, with which it
    forms one atom. slot counts rows from 0 within a shard, without gaps. A shard stays
    empty only if there are fewer atoms than shards or one atom outweighs its share. Rows
    equal in text and id are interchangeable. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = saved(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("atom"),
        ),
        "atoms",
    )
    shared = rows.groupBy("atom").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = rows.join(shared, "atom", "left").withColumn("first", F.coalesce("low", "doc_id")).drop("low")
    line = saved(running(rows, ["first", "atom", "doc_id"], {"bytes_to": F.col("size"), "rows_to": F.lit(1)}), "line")
    ends = saved(line.groupBy("first", "atom").agg(F.max("bytes_to").alias("end"), F.sum("size").alias("bytes")).select("end", "bytes"), "ends")
    total, largest = ends.agg(F.max("end"), F.max("bytes")).first()
    cuts = cut(ends.select("end"), total, largest, shards)[1] if total else []
    start = F.col("bytes_to") - F.col("size")
    number = sum((F.when(start >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    placed = line.withColumn("shard", number.cast("int"))
    heads = placed.groupBy("shard").agg(F.min("rows_to").alias("head"))  # a row per shard
    placed = placed.join(F.broadcast(heads), "shard")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("rows_to") - F.col("head")).cast("long").alias("slot"))
