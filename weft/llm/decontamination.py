"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of ten words of a benchmark item is a pattern; an item of fewer words is one
pattern. Patterns of one length are searched together: a table says for each block of
three words how far the search may move on, blocks that end a pattern lead to the bucket of
patterns with that ending, and these are compared word by word, first by hashes and then by
their bytes. Many stretches of text advance side by side in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm._store import saved
from weft.llm._text import ALNUM, Words, byte_column, chained, pieces

WINDOW = 10
BLOCK = 3
TABLE_BITS = 18
#: Words of one stretch; the stretches of a piece advance together.
STRETCH = 64
#: Patterns searched for at once; a larger benchmark is searched for in several passes.
MOST_PATTERNS = 1 << 20


class Patterns:
    """Word sequences of one length, with their shift table and suffix buckets."""

    def __init__(self, rows: np.ndarray, texts: list[bytes], items: list[np.ndarray]):
        self.length = rows.shape[1]
        self.block = min(BLOCK, self.length)
        ends = np.array([chained(r[-self.block :], self.block)[0] for r in rows], dtype=np.uint64)
        order = np.argsort(ends, kind="stable")
        self.rows, self.ends = rows[order], ends[order]
        self.texts = [texts[i] for i in order]
        self.items = [items[i] for i in order]
        mask = np.uint64((1 << TABLE_BITS) - 1)
        self.shift = np.full(1 << TABLE_BITS, self.length - self.block + 1, dtype=np.uint8)
        for j in range(self.length - self.block + 1):
            blocks = chained_rows(rows[:, j : j + self.block])
            slot = (blocks & mask).astype(np.int64)
            np.minimum.at(self.shift, slot, np.uint8(self.length - self.block - j))

    def find(self, of: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words and pattern numbers of all occurrences that stay within one text."""
        words, text = of.hash, of.text
        none = np.zeros(0, dtype=np.int64)
        if len(words) < self.length:
            return none, none
        blocks = chained(words, self.block)
        slots = (blocks & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
        back = self.block - 1
        at = np.arange(0, len(words), STRETCH)
        stop = np.minimum(at + STRETCH, len(words))
        at = np.maximum(at, self.length - 1)
        found = []
        while True:
            going = at < stop
            at, stop = at[going], stop[going]
            if not len(at):
                break
            step = self.shift[slots[at - back]].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
        last = np.concatenate(found)
        first = last - (self.length - 1)
        first = first[text[first] == text[last]]
        ends = blocks[first + self.length - self.block]
        low, high = np.searchsorted(self.ends, ends, "left"), np.searchsorted(self.ends, ends, "right")
        size = high - low
        place = np.repeat(first, size)
        which = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        for j in range(self.length):
            same = words[place + j] == self.rows[which, j]
            place, which = place[same], which[same]
        true = np.zeros(len(place), dtype=bool)
        last, now = -1, b""
        for k, (p, w) in enumerate(zip(place.tolist(), which.tolist(), strict=True)):
            if p != last:
                last, now = p, b" ".join(of.bytes[of.start[j] : of.end[j]].tobytes() for j in range(p, p + self.length))
            true[k] = now == self.texts[w]
        return place[true], which[true]


def chained_rows(rows: np.ndarray) -> np.ndarray:
    """The hash of each row of words, as chained() gives it for neighbours."""
    k = rows.shape[1]
    return chained(rows.reshape(-1), k)[::k]


def _windows(window: int):
    """length, words (their hashes), text and item of each pattern of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_column(batch.column("text"))
            for i, item in enumerate(batch.column("item").to_pylist()):
                words = Words(data[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]), ALNUM)
                plain = [words.bytes[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
                length = min(window, len(plain))
                for low in range(0, len(plain) - length + 1 if length else 0, 10_000):
                    own = range(low, min(low + 10_000, len(plain) - length + 1))
                    columns = [[length] * len(own), [words.hash[j : j + length].tobytes() for j in own], [b" ".join(plain[j : j + length]) for j in own], [item] * len(own)]
                    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["length", "words", "pattern", "item"])

    return run


def patterns_of(benchmark: DataFrame, window: int) -> DataFrame:
    """length, words, pattern, items: each different pattern and the items that hold it (no null ids)."""
    rows = benchmark.mapInArrow(_windows(window), "length int, words binary, pattern binary, item long")
    return rows.groupBy("length", "words", "pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))


def compile_patterns(rows: list) -> list[Patterns]:
    """Patterns by length, of rows of patterns_of()."""
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(r["length"], []).append((bytes(r["words"]), bytes(r["pattern"]), r["items"]))
    return [
        Patterns(np.frombuffer(b"".join(x[0] for x in found), dtype=np.uint64).reshape(-1, length), [x[1] for x in found], [np.array(x[2], dtype=np.int64) for x in found])
        for length, found in ((n, sorted(v, key=lambda x: x[:2])) for n, v in sorted(by_length.items()))
    ]


def _search(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_column(batch.column("row").field(text_col))
            for low, high, part, offsets in pieces(data, at):
                rows = batch.slice(low, high - low)
                words = Words(part, offsets, ALNUM)
                hit = np.zeros(len(words) + 1, dtype=np.int64)
                heads = np.cumsum(words.count) - words.count
                items: list[set[int]] = [set(x or ()) for x in rows.column("items").to_pylist()]
                for i, spans in enumerate(rows.column("spans").to_pylist()):
                    for s in spans or ():
                        hit[heads[i] + s["start"]] += 1
                        hit[heads[i] + s["end"]] -= 1
                for patterns in shared.value:
                    place, which = patterns.find(words)
                    np.add.at(hit, place, 1)
                    np.add.at(hit, place + patterns.length, -1)
                    for t, k in zip(words.text[place].tolist(), which.tolist(), strict=True):
                        items[t].update(patterns.items[k].tolist())
                inside = np.cumsum(hit)[:-1] > 0
                per_text = np.bincount(words.text[inside], minlength=high - low)
                spans = [[] for _ in range(high - low)]
                for i in np.flatnonzero(per_text).tolist():
                    own = np.r_[False, inside[heads[i] : heads[i] + words.count[i]], False]
                    edges = np.flatnonzero(own[1:] != own[:-1]).tolist()
                    spans[i] = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("row"),
                        pa.array(words.count, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                    ],
                    names=["row", "n_words", "spans", "items"],
                )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """row (all columns of docs as they are), n_words, n_hit, spans, items.

    A-Z is lower-cased; words are runs of 0-9, a-z and characters beyond ASCII. A word is
    hit if it lies in an occurrence of a pattern; spans are the maximal runs of hit words
    (first, end), items the sorted ids of the items of which a pattern occurs. Null and
    wordless texts and items have no words; an item with a null id is searched for like any
    other, but has no id to report; equal items are all reported. Texts may be of any length.

    The patterns go to every task: at most about MOST_PATTERNS of them at once. Those of a
    larger benchmark are dealt to blocks by their words, and searched for block after block;
    the documents are written in between, so that only one block is held at a time.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    patterns = saved(patterns_of(items, window), "patterns")
    blocks = -(-patterns.count() // MOST_PATTERNS) or 1
    out = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row")).withColumns(
        {"spans": F.expr("cast(null as array<struct<start: bigint, end: bigint>>)"), "items": F.expr("cast(null as array<bigint>)")}
    )
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = [("row", out.schema["row"].dataType), ("n_words", T.LongType()), ("spans", span), ("items", T.ArrayType(T.LongType()))]
    shape = T.StructType([T.StructField(n, k) for n, k in kinds])
    for k in range(blocks):
        some = patterns.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k) if blocks > 1 else patterns
        shared = spark.sparkContext.broadcast(compile_patterns(some.collect()))
        out = out.select("row", "spans", "items").mapInArrow(_search(shared, text_col), shape)
        if k < blocks - 1:
            out = saved(out, "searched")
            shared.destroy()
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("row", "n_words", n_hit.alias("n_hit"), "spans", "items")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS r(i) WHERE len(w) > 0
), o AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM d, (SELECT DISTINCT n FROM p) AS l, unnest(range(1, len(w) - n + 2)) AS r(i)
), h AS (
  SELECT o.doc_id, o.i, o.n, p.item_id FROM o JOIN p ON o.n = p.n AND o.s = p.s
), c AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + n)) AS r(j) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
