"""Removal of long repeated substrings with suffix arrays.

A byte goes if it lies in a string of `length` bytes that starts at two places. Suffix
arrays of a whole corpus cannot be built in one place, so the work is divided exactly:

1.  Anchors. Of the hashes of all half-length pieces in a window of `length` bytes the
    smallest is an anchor. Equal windows choose the same anchor at the same offset, so they
    meet at the anchor's hash. A place is an anchor with its context, the bytes on either
    side that a window around it can reach.
2.  Places with one context in common are settled: if there are two, all windows in it
    repeat. Anchors seen in different contexts form groups, each a problem of its own.
3.  Groups. Each context of a group is cut where it parts with another, and each stretch
    becomes one symbol. A suffix array of these short strings, built by grouping suffixes by
    Lyndon prefix, gives by its neighbours how far each context agrees with any other from
    each cut on, and so exactly the windows that repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._groups import chunks
from weft.llm._store import partitions, saved
from weft.llm._text import _power, byte_column, mixed

LENGTH = 400
#: Groups of more contexts are divided by what a window holds around the anchor.
CROWD = 1024
CLASSES = 8


def suffix_array(text: list[int]) -> list[int]:
    """Sorted suffixes of a sequence of integers whose last one is unique and smallest.

    Groups of suffixes that share a prefix start from the first symbols and are taken in
    descending order. Each suffix of the group points back to the nearest one before it
    that is in a lower group; those pointed at are followed by as many copies of the group's
    prefix as point there, and move up to a group with so much longer a prefix. In the end a
    group's prefix is its suffixes' longest Lyndon prefix. What follows that prefix is a
    smaller suffix, so that going through the suffixes from the smallest on, each gives the
    next place in their groups to those whose prefix it follows.
    """
    n = len(text)
    symbols = sorted(set(text))
    number = {s: i for i, s in enumerate(symbols)}
    group = [number[s] for s in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * len(symbols)
    above = list(range(1, len(symbols))) + [-1]
    below = list(range(-1, len(symbols) - 1))
    done = [False] * len(symbols)
    back = [-1] * n
    final: list[list[int]] = []
    g = len(symbols) - 1
    while g >= 0:
        done[g] = True
        own = sorted(s for s in members[g] if group[s] == g)
        members[g] = own
        times: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and done[group[p]]:
                p = back[p]
            back[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        moved: dict[int, dict[int, list[int]]] = {}
        for p, k in times.items():
            moved.setdefault(group[p], {}).setdefault(k, []).append(p)
        for h, by_count in moved.items():
            at = h
            for k in sorted(by_count):
                new = len(size)
                size.append(size[h] + k * size[g])
                members.append(by_count[k])
                done.append(False)
                above.append(above[at])
                below.append(at)
                below[above[at]] = new
                above[at] = new
                at = new
                for p in by_count[k]:
                    group[p] = new
        final.append(own)
        g = below[g]
    start, follows = [0] * len(size), [[] for _ in range(n + 1)]
    at = 0
    for own in reversed(final):
        if own:
            start[group[own[0]]] = at
            at += len(own)
            for s in own:
                follows[s + size[group[s]]].append(s)
    out = [0] * n

    def place(after: int) -> None:
        for s in follows[after]:
            out[start[group[s]]] = s
            start[group[s]] += 1

    place(n)
    for r in range(n):
        place(out[r])
    return out


def common(text: list[int], suffixes: list[int]) -> list[int]:
    """Symbols that each sorted suffix shares with the one before it (Kasai's method)."""
    rank = [0] * len(text)
    for r, s in enumerate(suffixes):
        rank[s] = r
    out, h = [0] * len(text), 0
    for s in range(len(text)):
        if rank[s]:
            o = suffixes[rank[s] - 1]
            while s + h < len(text) and o + h < len(text) and text[s + h] == text[o + h]:
                h += 1
            out[rank[s]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out


def _agreement(sides: list[bytes]) -> list[list[int]]:
    """For each string the lengths, above 0, at which it parts with any other.

    In sorted order these are the running minima, either way, of the prefixes that
    neighbours share. Strings that share a prefix part with the others at the same places
    within it.
    """
    order = sorted(range(len(sides)), key=sides.__getitem__)
    shared = [0]
    for x, y in zip(order, order[1:], strict=False):
        a, b = sides[x], sides[y]
        n = min(len(a), len(b))
        if a[:n] != b[:n]:
            u, v = np.frombuffer(a, dtype=np.uint8, count=n), np.frombuffer(b, dtype=np.uint8, count=n)
            n = int(np.argmax(u != v))
        shared.append(n)
    cuts: list[set[int]] = [set() for _ in sides]
    for ahead, places in ((0, range(len(order))), (1, range(len(order) - 1, -1, -1))):
        low: list[int] = []
        for j in places:
            n = shared[j + ahead] if j + ahead < len(order) else 0
            while low and low[-1] > n:
                low.pop()
            if n and (not low or low[-1] < n):
                low.append(n)
            cuts[order[j]].update(low)
    return [sorted(c) for c in cuts]


def repeats(left: list[bytes], right: list[bytes], reach: int) -> list[list[tuple[int, int]]]:
    """For each context the ranges of bytes on its left with which a window is shared.

    left holds the bytes before the anchor, nearest first, right those after it. A window
    takes l bytes on the left and reach - l on the right. The contexts differ.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in left]
    l_cuts, r_cuts = _agreement(left), _agreement(right)
    l_most, r_most = [max(c, default=0) for c in l_cuts], [max(c, default=0) for c in r_cuts]
    able = [i for i in range(len(left)) if l_most[i] + r_most[i] >= reach]
    if len(able) < 2:
        return out
    number: dict[tuple[int, int, bytes], int] = {}
    text: list[int] = []
    heads: list[tuple[int, int, int, int]] = []  # context, left bytes, symbols up to the anchor, place
    fresh = -2

    def symbol(side: int, k: int, piece: bytes) -> int:
        return number.setdefault((side, k, piece), len(number) + 1)

    for i in able:
        ls, rs = [0, *l_cuts[i]], [0, *r_cuts[i]]
        low = next((k for k, c in enumerate(ls) if c + r_most[i] >= reach), len(ls))
        for k in range(len(ls) - 1, -1, -1):
            if k >= low:
                heads.append((i, ls[k], k, len(text)))
            if k:
                text.append(symbol(0, k, left[i][ls[k - 1] : ls[k]]))
        text.append(0)  # the anchor, which all contexts share
        for k in range(1, len(rs)):
            text.append(symbol(1, k, right[i][rs[k - 1] : rs[k]]))
        text.append(fresh)
        fresh -= 1
    text.append(fresh)
    suffixes = suffix_array(text)
    shared = common(text, suffixes)
    rank = [0] * len(text)
    for r, s in enumerate(suffixes):
        rank[s] = r
    shared.append(0)
    for i, taken, k, at in heads:
        symbols = max(shared[rank[at]], shared[rank[at] + 1]) - k - 1
        if symbols >= 0:
            beyond = r_cuts[i][symbols - 1] if symbols else 0
            if taken + beyond >= reach:
                out[i].append((max(0, reach - beyond), taken))
    return out


def anchors(data: np.ndarray, length: int) -> np.ndarray:
    """Places of the smallest hashed half-length piece of each window of a text."""
    piece = length // 2
    n, width = len(data), length - piece + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=sums[1:])
    h = mixed((sums[piece:] - sums[:-piece]) * _power("down", n - piece + 1))
    low, w = h, 1
    while w < width:
        step = min(w, width - w)
        low = np.minimum(low[:-step], low[step:])
        w += step
    edge = np.zeros(width - 1, dtype=np.uint64)
    high, w = np.concatenate([edge, low, edge]), 1
    while w < width:
        step = min(w, width - w)
        high = np.maximum(high[:-step], high[step:])
        w += step
    place = np.flatnonzero(high == h)
    reach = length - piece
    left, right = np.minimum(place, reach), np.minimum(n - place - piece, reach)
    around = (sums[place + piece + right] - sums[place - left]) * _power("down", n)[place - left]
    context = mixed(around + (left * 1024 + right).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return np.stack([h[place].view(np.int64), context.view(np.int64), place, right], axis=1)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what is made of them stays small."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _places(length: int):
    """Anchors of each text; those with equal contexts in one row, with all their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            data, at = byte_column(batch.column("text"))
            keys = batch.column("key").to_numpy()
            columns: list[list] = [[] for _ in range(5)]
            rest: list[bytes | None] = []

            def flush() -> pa.RecordBatch:
                flat = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in columns]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                return pa.RecordBatch.from_arrays([*(pa.array(f.astype(k.to_pandas_dtype())) for f, k in zip(flat, kinds, strict=True)), pa.array(rest, pa.binary())], names=["hash", "context", "key", "place", "right", "places"])

            for i in range(batch.num_rows):
                if at[i + 1] - at[i] < length:
                    continue
                found = anchors(data[at[i] : at[i + 1]], length)
                order = np.lexsort((found[:, 2], found[:, 1], found[:, 0]))
                found = found[order]
                head = np.flatnonzero(np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)])
                size = np.diff(np.r_[head, len(found)])
                first = found[head]
                for c, v in zip(columns, (first[:, 0], first[:, 1], np.full(len(head), keys[i]), first[:, 2], first[:, 3]), strict=True):
                    c.append(v)
                some: list[bytes | None] = [None] * len(head)
                for k in np.flatnonzero(size > 1).tolist():
                    some[k] = found[head[k] : head[k] + size[k], 2].astype(np.int32).tobytes()
                rest += some
                if len(rest) > 20_000:
                    yield flush()
                    columns = [[] for _ in range(5)]
                    rest = []
            yield flush()

    return run


def _contexts(length: int):
    """The bytes around the wanted places, nearest first, by the part of the group they join."""
    piece = length // 2
    reach = length - piece
    step = -(-reach // CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        names = ["hash", "class", "part", "context", "many", "left", "right"]
        last = None
        for batch in sliced(batches):
            rows: list[tuple] = []
            data, at = byte_column(batch.column("text"))
            keys = batch.column("key").to_pylist()
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                if keys[i] == last:  # a copy of the text before
                    continue
                last = keys[i]
                text = data[at[i] : at[i + 1]].tobytes()
                for w in wanted:
                    p = w["place"]
                    left, right = text[max(0, p - reach) : p][::-1], text[p + piece : p + piece + reach]
                    if w["contexts"] <= CROWD:
                        rows.append((w["hash"], -1, 0, w["context"], w["many"], left, right))
                        continue
                    for c in range(CLASSES):
                        inner, outer = c * step, reach - min(reach, (c + 1) * step)
                        if len(left) >= inner and len(right) >= outer:
                            part = hashlib.blake2b(left[:inner] + b"|" + right[:outer], digest_size=8).digest()
                            rows.append((w["hash"], c, int.from_bytes(part, "little", signed=True), w["context"], w["many"], left, right))
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _settle(length: int):
    """For the contexts of each group, ranges of left bytes with which a window repeats."""
    reach = length - length // 2
    step = -(-reach // CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("low", pa.int32()), ("high", pa.int32())])
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.list_(span)]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=["hash", "context", "spans"])

        for table, heads in chunks(batches, ["hash", "class", "part"]):
            hashes, classes = (table[k].to_numpy()[heads].tolist() for k in ("hash", "class"))
            contexts, every, lefts, rights = (table[k].to_pylist() for k in ("context", "many", "left", "right"))
            for at, end, own_hash, kind in zip(heads.tolist(), [*heads[1:].tolist(), table.num_rows], hashes, classes, strict=True):
                first = {contexts[r]: r for r in range(end - 1, at - 1, -1)}  # equal texts bring equal contexts
                context, rows = list(first), list(first.values())
                inner, outer, room = (0, 0, reach) if kind < 0 else (kind * step, reach - min(reach, (kind + 1) * step), min(reach, (kind + 1) * step) - kind * step)
                left, right = [lefts[r][inner : inner + room] for r in rows], [rights[r][outer : outer + room] for r in rows]
                many = [every[r] for r in rows]
                same: dict[tuple[bytes, bytes], list[int]] = {}
                for i, pair in enumerate(zip(left, right, strict=True)):
                    same.setdefault(pair, []).append(i)
                kinds = list(same)
                found = repeats([k[0] for k in kinds], [k[1] for k in kinds], room) if len(kinds) > 1 else [[]]
                for k, spans in zip(kinds, found, strict=True):
                    whole = [(max(0, room - len(k[1])), len(k[0]))] if len(k[0]) + len(k[1]) >= room else []
                    for i in same[k]:
                        mine = whole if many[i] or len(same[k]) > 1 else spans
                        if mine:
                            out.append((own_hash, context[i], [{"low": inner + a, "high": inner + b} for a, b in mine]))
                if len(out) > 5000:
                    yield flush()
                    out.clear()
        yield flush()

    return run


def _covered(length: int):
    """Byte spans that the repeated windows around the places of a row cover."""
    reach = length - length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            plain = np.asarray(batch.column("places").is_null()) & np.asarray(batch.column("spans").is_null())
            key, place, right = (batch.column(k).to_numpy()[plain].astype(np.int64) for k in ("key", "place", "right"))
            low, high = reach - right, np.minimum(reach, place)
            some = low <= high
            keys, starts, ends = [], [], []
            for r in batch.filter(pa.array(~plain)).to_pylist():
                places = np.frombuffer(r["places"], dtype=np.int32).tolist() if r["places"] is not None else [r["place"]]
                spans = [(s["low"], s["high"]) for s in r["spans"]] if r["spans"] is not None else [(reach - r["right"], min(reach, r["place"]))]
                for p in places:
                    for x, y in spans:
                        if x <= y:
                            keys.append(r["key"])
                            starts.append(p - y)
                            ends.append(p - x + length)
            columns = ((key, keys), ((place - high), starts), ((place - low + length), ends))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v[some], np.array(w, dtype=np.int64)])) for v, w in columns], names=["key", "start", "end"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for batch in sliced(batches):
        data, at = byte_column(batch.column("row").field("text"))
        column, whole = batch.column("spans"), batch.column("whole").to_pylist()
        bounds = column.offsets.to_numpy()
        starts, ends = (column.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        kept, removed = [], []
        for i in range(batch.num_rows):
            text = data[at[i] : at[i + 1]]
            runs_: list[dict] = []
            if whole[i]:
                runs_ = [{"start": 0, "end": len(text)}]
            elif column[i].is_valid:
                edge = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(edge, starts[bounds[i] : bounds[i + 1]], 1)
                np.add.at(edge, ends[bounds[i] : bounds[i + 1]], -1)
                gone = np.r_[False, np.cumsum(edge)[:-1] > 0, False]
                flips = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
                runs_ = [{"start": a, "end": b} for a, b in zip(flips[::2], flips[1::2], strict=True)]
            removed.append(runs_)
            cuts = [0, *(x for r in runs_ for x in (r["start"], r["end"])), len(text)]
            kept.append(b"".join(text[a:b].tobytes() for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column("row").field("doc_id"), pa.array(np.diff(at)), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, removed, kept.

    Texts are UTF-8 bytes, null counts as empty, and matches do not cross texts. removed are
    the maximal runs (first byte, end) of bytes in strings of `length` bytes that start at
    another place too, in this text or another; kept are the other bytes in order, which may
    cut characters. Repeated rows are copies of each other: texts of `length` bytes or more
    then go whole. Only id and text play a part.

    Texts, anchors and contexts are told apart by hashes (64, 64 and 64 bits together).
    """
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    long = docs.filter(F.octet_length("text") >= length)
    places = long.select("key", "text").mapInArrow(_places(length), "hash long, context long, key long, place int, right int, places binary")
    each = places.groupBy("hash", "context").agg(
        F.min("key").alias("key"), F.max("key").alias("other"), F.min_by("place", "key").alias("place"), F.max(F.when(F.col("places").isNotNull(), 1).otherwise(0)).alias("within")
    )
    each = each.select("hash", "context", "key", "place", ((F.col("key") != F.col("other")) | (F.col("within") == 1)).alias("many"))
    each = each.withColumn("contexts", F.count(F.lit(1)).over(Window.partitionBy("hash")))
    known = saved(each.filter("many or contexts > 1"), "anchors")
    wanted = known.filter("contexts > 1").groupBy("key").agg(F.collect_list(F.struct("hash", "context", "place", "many", "contexts")).alias("wanted"))
    around = long.select("key", "text").join(wanted, "key").select("key", "text", "wanted")
    around = around.mapInArrow(_contexts(length), "hash long, class int, part long, context long, many boolean, left binary, right binary")
    around = around.repartition(n, "hash", "class", "part").sortWithinPartitions("hash", "class", "part")
    settled = saved(around.mapInArrow(_settle(length), "hash long, context long, spans array<struct<low: int, high: int>>"), "settled")
    plain = known.filter("many and contexts = 1").select("hash", "context", F.lit(None).cast("array<struct<low: int, high: int>>").alias("spans"))
    verdict = settled.unionByName(plain)
    hits = places.join(verdict, ["hash", "context"]).select("key", "place", "right", "places", "spans")
    spans = hits.mapInArrow(_covered(length), "key long, start long, end long").groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    copies = long.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("key", F.lit(True).alias("whole"))
    gone = saved(spans.join(copies, "key", "full"), "spans")
    rows = docs.join(gone, "key", "left").select(F.struct("doc_id", "text").alias("row"), "spans", "whole")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, removed array<struct<start: bigint, end: bigint>>, kept binary")
