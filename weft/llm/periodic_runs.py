"""Detection of periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q, at least four periods long, that cannot be
extended. Periods under SMALL are found by comparing each word with that q further. For longer
ones, each dyadic scale t has its synchronising set: position i belongs to it if of the hashes
of the t-word contexts at i .. i + t the smallest is the first or the last, so that equal
contexts of 2t words are both in or both out. Within t positions of a run of period t to 2t - 1
there is always such a position, and q words further its next equal: neighbouring positions of
equal context propose the period, and comparing the words themselves settles the run.

Contexts inside a run of period t / 4 or less are left out of the sets, which keeps these sparse;
such regions are known from smaller scales by then. Every document is worked on in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._text import byte_column, mixed, pieces

#: Periods under this many words are found directly; a power of two, the first scale.
SMALL = 8
#: Periods that a run holds at least, and its words.
PERIODS, LEAST = 4, 6
#: Of contexts that take no part.
BARRED = np.uint64(0xFFFFFFFFFFFFFFFF)

_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of true values."""
    edges = np.flatnonzero(np.diff(np.r_[np.int8(0), same.view(np.int8), np.int8(0)]))
    return edges[::2], edges[1::2]


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many first values of two arrays are equal."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        unlike = np.flatnonzero(x[at : min(at + step, n)] != y[at : min(at + step, n)])
        if len(unlike):
            return at + int(unlike[0])
        at, step = at + step, 2 * step
    return n


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbouring values, in time that does not depend on width."""
    n = len(values) - width + 1
    padded = np.r_[values, np.full(-len(values) % width, BARRED)].reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _primitive(ids: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether a stretch of several periods has no smaller one; it would divide this one."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            d = period // prime
            if np.array_equal(ids[start : start + period], ids[start + d : start + d + period]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def _small(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) of periods under SMALL."""
    found = []
    for q in range(1, min(SMALL, len(ids))):
        starts, ends = _stretches(ids[:-q] == ids[q:])
        long = ends - starts >= max(LEAST, PERIODS * q) - q
        found += [(a, b + q, q) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True) if _primitive(ids, a, b + q, q)]
    return found


def _proposals(names: np.ndarray, contexts: np.ndarray, barred: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """(period, position) of neighbouring positions of the synchronising set with equal contexts."""
    names = np.where(barred, BARRED, names)
    low = _lowest(names, scale + 1)
    chosen = np.flatnonzero((low != BARRED) & ((names[: len(low)] == low) | (names[scale : scale + len(low)] == low)))
    chosen = chosen[chosen < len(contexts)]
    order = chosen[np.argsort(contexts[chosen], kind="stable")]
    gap = np.diff(order)
    near = (contexts[order[1:]] == contexts[order[:-1]]) & (gap >= scale) & (gap < 2 * scale)
    return sorted(zip(gap[near].tolist(), order[:-1][near].tolist(), strict=True))


def runs_of(ids: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of texts of so many words that follow each other in ids.

    One number that occurs nowhere else must stand behind each text, so that no run spans two.
    """
    found = _small(ids)
    where = np.arange(len(ids))  # of what is left for longer periods
    names, length = mixed(ids.astype(np.uint64)), 1

    def doubled(x: np.ndarray, t: int) -> np.ndarray:
        return mixed(x[: len(x) - t] * np.uint64(0xD6E8FEB86659FD93) + x[t:])

    scale = SMALL
    while len(sizes) and PERIODS * scale <= sizes.max():
        large = sizes >= PERIODS * scale
        if not large.all():
            keep = np.repeat(large, sizes + 1)
            ids, where, names, sizes = ids[keep], where[keep], names[keep[: len(names)]], sizes[large]
        while length < scale and len(names) > length:
            names, length = doubled(names, length), 2 * length
        if len(names) <= scale + 1:
            break  # no context of this length is whole
        change = np.zeros(len(names) + 1, dtype=np.int64)
        for a, b, q in found:
            if PERIODS * q <= scale <= b - a:
                at = int(np.searchsorted(where, a))
                if at < len(where) and where[at] == a:
                    change[min(at, len(names))] += 1
                    change[min(at + b - a - scale + 1, len(names))] -= 1
        contexts = doubled(names, scale)
        last, end = 0, 0
        for q, p in _proposals(names, contexts, np.cumsum(change[:-1]) > 0, scale):
            if q == last and p + q + 2 * scale <= end:
                continue  # within the run just found
            start = p - _agree(ids[:p][::-1], ids[: p + q][::-1])
            last, end = q, p + q + _agree(ids[p:], ids[p + q :])
            if end - start >= max(LEAST, PERIODS * q) and _primitive(ids, start, end, q):
                found.append((int(where[start]), int(where[start]) + end - start, q))
        scale *= 2
        names, length = contexts, scale
    return found


Words = list[bytes]


def _found(words_of: Callable[[int | None, Words], Words] | None):
    def of_texts(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        doc_ids = batch.column("doc_id").to_pylist()
        raw = data.tobytes()
        texts = [raw[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        if words_of:
            texts = [words_of(i, w) for i, w in zip(doc_ids, texts, strict=True)]
        sizes = np.array([len(w) for w in texts], dtype=np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        code: defaultdict[bytes, int] = defaultdict(count(len(texts)).__next__)  # words by themselves, not by hashes
        ids = np.fromiter((x for k, w in enumerate(texts) for x in (*map(code.__getitem__, w), k)), dtype=np.int64, count=int(sizes.sum()) + len(texts))
        by_text = defaultdict(list)
        for a, b, q in runs_of(ids, sizes):
            k = int(np.searchsorted(starts, a, "right")) - 1
            by_text[k].append((a - int(starts[k]), b - a, q))
        runs, kept = [], []
        for k, w in enumerate(texts):
            own = sorted(by_text.get(k, ()), key=lambda r: (r[0], r[2]))
            if own:
                change = np.zeros(len(w) + 1, dtype=np.int64)
                for s, n, q in own:
                    change[s + q] += 1
                    change[s + n] -= 1
                w = [w[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            kept.append(b" ".join(w))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.array(runs, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_column(batch.column("text"))
            for low, high, part, offsets in pieces(data, at):
                yield of_texts(batch.slice(low, high - low), part, offsets)

    return run


def periodic_runs(
    docs: DataFrame, words_of: Callable[[int | None, Words], Words] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period), collapsed.

    Words are runs of bytes other than blanks; they are told apart by their bytes. A run has
    at least max(6, 4 * period) words; runs are in order of start, then period. collapsed is
    the text without what a run repeats: a word stays, joined by one space, unless some run
    contains it after that run's first period. words_of(doc_id, words), if given, says in
    which words of a document runs are looked for.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Null and
    repeated ids and repeated rows are answered row by row; other columns are left out; an
    empty table gives no rows. A text of any length is worked on whole, in n log n steps and
    with about 100 bytes of memory a word.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_found(words_of), _SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))

#: Of op12_periodic_runs: pairs of equal four-word grams at one distance, as islands.
ORACLE_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab
), numbered AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) AS h
  FROM documents, crc
), looped AS (
  SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS own, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM numbered
), texts AS (
  SELECT r, doc_id, n, CASE WHEN own THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // parts) + 1] END) ELSE w END AS w
  FROM looped
), words AS (
  SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM texts
), grams AS (
  SELECT r, n, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS gram
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.gram = y.gram AND y.i > x.i WHERE 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT r, q, min(i) AS s, count(*) + 3 + q AS n FROM islands GROUP BY r, q, island HAVING count(*) + 3 + q >= greatest(6, 4 * q)
), runs AS (
  SELECT r, q, s, n FROM stretches x
  WHERE NOT EXISTS (SELECT 1 FROM stretches y WHERE y.r = x.r AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.n >= x.s + x.n)
), best AS (
  SELECT r, count(*) AS n_runs, arg_min({'s': s, 'n': n, 'q': q}, {'n': -n, 's': s, 'q': q}) AS top,
    string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY r
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.r = w.r AND w.i >= x.s + x.q AND w.i < x.s + x.n) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::bigint AS n_runs, top.s::bigint AS start, top.n::bigint AS length, top.q::bigint AS period,
  (1000 * top.n // top.q)::bigint AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM texts LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
