"""Language-model scoring by context-tree weighting over bytes, with a unigram base beside it.

A text is read as its lower-cased words, a blank after each but the last, and an end byte.
The next byte is decomposed into eight binary decisions. For each decision every context of
up to DEPTH preceding bytes keeps a Krichevsky-Trofimov estimate of what followed it in the
training texts, and context-tree weighting mixes the estimates of all depths: a context's
weight is the share of its own estimate in the weighted probability of its training data,
against those of its longer contexts.

The tree has every context of the training texts, so it grows with them and is held in no
one place. The counts of all grams (a byte after DEPTH others) are shuffled by the last CUT
bytes of their contexts: longer contexts have all of their data in one run of rows, where
their share of each gram's mixture is found. The contexts of fewer bytes than CUT, 65793 at
most, are mixed in the driver from sums over those runs. The texts' distinct grams are then
shuffled to the grams' log probabilities, and these back to the texts.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._groups import runs
from weft.llm._store import partitions, saved
from weft.llm._text import NOT_BLANK, Words, byte_column, mixed, pieces

DEPTH = 5
#: Contexts of so many bytes and more are mixed in tasks, shorter ones in the driver.
CUT = 3
#: Grams that are mixed at once, unless those of one context of CUT bytes are more.
CHUNK = 1 << 17
#: Bytes of text that ask for grams together; the more, the fewer distinct grams a byte.
ASKING = 1 << 21
#: Rows of the dense tables that are worked on at once.
ROWS = 2048
END = 10
FOLDS, HELD = 7, 2
#: Distinct grams that a task holds before it merges them.
HOLD = 1 << 21
#: Parts of the vocabulary per shuffle partition; a task holds one part at a time.
PARTS = 4


def stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each after DEPTH end bytes as context, and where texts start."""
    texts = len(words.count)
    size = words.end - words.start
    last = np.cumsum(words.count) - 1
    length = np.bincount(words.text, size + 1, texts).astype(np.int64) + (words.count == 0) + DEPTH
    start = np.cumsum(length) - length
    out = np.full(int(length.sum()), END, dtype=np.uint8)
    if len(words):
        into = np.cumsum(size + 1) - (size + 1)
        first = (np.cumsum(words.count) - words.count)[words.text]
        place = start[words.text] + DEPTH + into - into[first]
        total = int(size.sum())
        at = np.arange(total) + np.repeat(words.start - (np.cumsum(size) - size), size)
        to = np.arange(total) + np.repeat(place - (np.cumsum(size) - size), size)
        out[to] = words.bytes[at]
        out[place + size] = 32
        out[(place + size)[last[words.count > 0]]] = END
    return out, start


def keyed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts in order, and how many each text has (one at least).

    A gram has the preceding byte in its highest place, then the one before that, and the
    byte itself lowest: grams in order have the contexts of each depth together.
    """
    out, start = stream(words)
    scored = np.ones(len(out), dtype=bool)
    for j in range(DEPTH):
        scored[start + j] = False
    wide = out.astype(np.int64)
    key = wide[DEPTH:].copy()
    for j in range(1, DEPTH + 1):
        key |= wide[DEPTH - j : len(wide) - j] << (8 * (DEPTH + 1 - j))
    return key[scored[DEPTH:]], np.diff(np.r_[start, len(out)]) - DEPTH


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[heads], np.add.reduceat(counts, heads)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of this task's texts, with their counts in those that are not held out."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _merged(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    for batch in batches:
        data, at = byte_column(batch.column("text"))
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for low, high, part, offsets in pieces(data, at):
            key, size = keyed(Words(part, offsets, NOT_BLANK))
            held.append(_merged(key, np.repeat(train[low:high], size).astype(np.int64)))
            if sum(len(h[0]) for h in held) > HOLD:
                held = [merged()]
    if held:
        keys, counts = merged()
        for low in range(0, len(keys), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(keys[low : low + CHUNK]), pa.array(counts[low : low + CHUNK])], names=["gram", "n"])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma by Stirling's series, after moving the argument up by eight."""
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - low


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of each of the 255 decisions (places 1 to 255) from counts of bytes."""
    zeros, ones = np.zeros((len(counts), 256)), np.zeros((len(counts), 256))
    for k in range(8):
        split = counts.reshape(len(counts), 1 << k, 2, -1).sum(3)
        zeros[:, 1 << k : 2 << k], ones[:, 1 << k : 2 << k] = split[:, :, 0], split[:, :, 1]
    return zeros, ones


def _block(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """KT log probability of each decision's data, and the estimate of a one."""
    zeros, ones = _bits(counts)
    seen = zeros + ones
    log, some = np.zeros_like(seen), seen > 0
    log[some] = _lgamma(zeros[some] + 0.5) + _lgamma(ones[some] + 0.5) - np.log(np.pi) - _lgamma(seen[some] + 1)
    return log, (ones + 0.5) / (seen + 1)


@dataclass
class Tree:
    """log10 probabilities of bytes by deepest context kept, and how to find that context.

    The whole tree in one place, for small tables only: what the shuffled one must equal.
    """

    pairs: np.ndarray  # by the last two bytes: the deepest context of at most two bytes
    column: np.ndarray  # of each byte in child
    child: np.ndarray  # by context and the byte before it: the longer context, or itself
    depth: np.ndarray
    log10: np.ndarray

    def score(self, out: np.ndarray) -> np.ndarray:
        """log10 probability of each byte of a stream but the first DEPTH."""
        n = len(out) - DEPTH
        back = [out[DEPTH - j : DEPTH - j + n] for j in range(DEPTH + 1)]
        at = self.pairs[back[1].astype(np.int32) | back[2].astype(np.int32) << 8]
        for j in range(3, DEPTH + 1):
            deep = np.flatnonzero(self.depth[at] == j - 1)
            at[deep] = self.child[at[deep], self.column[back[j][deep]]]
        return self.log10[at, back[0]]


@dataclass
class Level:
    """Sorted contexts of one depth (last byte lowest) and what followed them, sparse."""

    contexts: np.ndarray
    row: np.ndarray
    byte: np.ndarray
    n: np.ndarray

    def dense(self, low: int, high: int) -> np.ndarray:
        a, b = np.searchsorted(self.row, [low, high])
        out = np.zeros((high - low, 256))
        np.add.at(out, (self.row[a:b] - low, self.byte[a:b]), self.n[a:b])
        return out


def level(context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> Level:
    order = np.lexsort((byte, context))
    contexts, row = np.unique(context[order], return_inverse=True)
    return Level(contexts, row, byte[order], n[order].astype(np.float64))


def build(levels: list[Level]) -> Tree:
    """The tree of contexts that are closed under suffixes, by depth from 0."""
    size = [len(v.contexts) for v in levels]
    first = np.cumsum([0, *size])
    total, deepest = int(first[-1]), len(levels) - 1
    depth = np.repeat(np.arange(len(levels), dtype=np.uint8), size)
    parents = [np.zeros(size[0], dtype=np.int64)]
    for d in range(1, len(levels)):
        parents.append(np.searchsorted(levels[d - 1].contexts, levels[d].contexts & ((1 << 8 * (d - 1)) - 1)))
    longer = [v.contexts >> 8 * max(d - 1, 0) for d, v in enumerate(levels)]
    used = np.unique(np.concatenate(longer[1:])) if deepest else np.zeros(0, dtype=np.int64)
    column = np.full(256, len(used), dtype=np.int16)
    column[used] = np.arange(len(used))
    child = np.repeat(np.arange(total, dtype=np.int32)[:, None], len(used) + 1, axis=1)
    for d in range(1, len(levels)):
        child[first[d - 1] + parents[d], column[longer[d]]] = first[d] + np.arange(size[d])
    last, before = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
    one = child[0, column[last]]
    pairs = np.where(depth[one] == 1, child[one, column[before]], one).astype(np.int32)
    weight = np.ones((total, 256), dtype=np.float32)
    estimate, rest = np.zeros_like(weight), np.zeros_like(weight)
    below = np.zeros((size[-1], 256))
    for d in range(deepest, -1, -1):
        above = np.zeros((size[d - 1] if d else 1, 256))
        kept = None
        if d < deepest:
            deeper = levels[d + 1]
            kept = Level(levels[d].contexts, parents[d + 1][deeper.row], deeper.byte, deeper.n)
            order = np.argsort(kept.row, kind="stable")
            kept = Level(kept.contexts, kept.row[order], kept.byte[order], kept.n[order])
        for low in range(0, size[d], ROWS):
            high = min(low + ROWS, size[d])
            here = slice(first[d] + low, first[d] + high)
            counts = levels[d].dense(low, high)
            own, estimate[here] = _block(counts)
            if kept is None:
                rest[here], weighted = estimate[here], own
            else:
                remaining, rest[here] = _block(counts - kept.dense(low, high))
                weighted = np.logaddexp(own, below[low:high] + remaining) + np.log(0.5)
                weight[here] = np.exp(np.log(0.5) + own - weighted)
            np.add.at(above, parents[d][low:high], weighted)
        below = above
    log10 = np.zeros((total, 256), dtype=np.float32)
    for d in range(len(levels)):
        for low in range(0, size[d], ROWS):
            at = np.arange(low, min(low + ROWS, size[d]))
            here = first[d] + at
            p = rest[here].astype(np.float64)
            for up in range(d, -1, -1):
                w = weight[first[up] + at]
                p = w * estimate[first[up] + at] + (1 - w) * p
                at = parents[up][at]
            logs = np.zeros((len(p), 256))
            for k in range(8):
                ones = p[:, 1 << k : 2 << k]
                logs += np.repeat(np.log10(np.stack([1 - ones, ones], axis=2)).reshape(len(p), 2 << k), 128 >> k, axis=1)
            log10[here] = logs
    return Tree(pairs, column, child, depth, log10)


_SMALL = 1 << 12
_HALF, _ONE = _lgamma(np.arange(_SMALL) + 0.5), _lgamma(np.arange(_SMALL) + 1.0)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """KT log probability of so many zeros and ones."""

    def looked(n: np.ndarray, known: np.ndarray, more: float) -> np.ndarray:
        out = known[np.minimum(n, _SMALL - 1).astype(np.int64)]
        big = n >= _SMALL
        out[big] = _lgamma(n[big] + more)
        return out

    return looked(zeros, _HALF, 0.5) + looked(ones, _HALF, 0.5) - np.log(np.pi) - looked(zeros + ones, _ONE, 1.0)


def _weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability weighted over own and longer contexts, and the weight of the own estimate."""
    both = np.logaddexp(own, below) + np.log(0.5)
    return both, np.exp(own + np.log(0.5) - both)


def mix(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of sorted distinct grams with all that share CUT bytes of context: the mixture from CUT
    on, by decision the probability of the gram's own bit; and what shorter contexts need.

    The latter is, by node (context of CUT - 1 bytes, then the place of the decision), the
    zeros, the ones and the weighted log probability of the contexts of CUT bytes.
    """
    byte = gram & 255
    orders, keys = {}, {}
    for d in range(DEPTH, CUT - 1, -1):
        key = gram >> (8 * (DEPTH - d) + 8) << 8 | byte
        orders[d] = np.argsort(key, kind="stable")
        keys[d] = key[orders[d]]
    p = np.empty((8, len(gram)), dtype=np.float32)
    nodes, sums = [], []
    for k in range(8):
        bit = byte >> (7 - k) & 1
        mixing, weighted, rep = [], None, None
        for d in range(DEPTH, CUT - 1, -1):
            prefix = keys[d] >> (8 - k)
            head = np.r_[True, prefix[1:] != prefix[:-1]]
            group = np.empty(len(gram), dtype=np.int64)
            group[orders[d]] = np.cumsum(head) - 1
            total, ones = np.bincount(group, n), np.bincount(group, n * bit)
            own = _kt(total - ones, ones)
            if weighted is None:
                weighted, weight = own, np.ones(len(own))
            else:
                weighted, weight = _weighted(own, np.bincount(group[rep], weighted, len(own)))
            rep = orders[d][np.flatnonzero(head)]
            estimate = (np.where(bit == 1, ones[group], (total - ones)[group]) + 0.5) / (total[group] + 1)
            mixing.append((weight[group], estimate))
        out = np.zeros(len(gram))
        for weight, estimate in mixing:
            out = weight * estimate + (1 - weight) * out
        p[k] = out
        nodes.append(gram[rep] >> 8 * (DEPTH + 2 - CUT) << 8 | 1 << k | byte[rep] >> (8 - k))
        sums.append((total - ones, ones, weighted))
    node, place = np.unique(np.concatenate(nodes), return_inverse=True)
    return p, [node, *(np.bincount(place, np.concatenate(c), len(node)) for c in zip(*sums, strict=True))]


MIX_ROW = "grams binary, p binary, nodes array<struct<node: bigint, zeros: double, ones: double, below: double>>"


def _mixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk of grams, from rows in order; chunks end where the last CUT bytes change."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    most = CHUNK

    def made(gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        gram, n = _merged(gram, n)
        p, (node, zeros, ones, below) = mix(gram, n)
        inner = pa.StructArray.from_arrays([pa.array(v) for v in (node, zeros, ones, below)], names=["node", "zeros", "ones", "below"])
        return pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([p.tobytes()], pa.binary()), pa.ListArray.from_arrays([0, len(node)], inner)], names=["grams", "p", "nodes"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column("gram").to_numpy(), batch.column("n").to_numpy()))
        if sum(len(h[0]) for h in held) > most:
            gram, n = (np.concatenate(c) for c in zip(*held, strict=True))
            cut = int(np.searchsorted(gram >> 8 * (DEPTH + 1 - CUT), gram[-1] >> 8 * (DEPTH + 1 - CUT)))
            if cut:
                yield made(gram[:cut], n[:cut])
            held = [(gram[cut:], n[cut:])]
            most = max(CHUNK, 2 * (len(gram) - cut))
    if held:
        yield made(*(np.concatenate(c) for c in zip(*held, strict=True)))


def upper(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the contexts of CUT - 1 bytes, and by place and node what turns a mixture of
    longer contexts into the whole: a summand for a zero, one for a one, and a factor."""
    known = np.unique(node >> 8)
    where = np.zeros(1 << 8 * (CUT - 1), dtype=np.int32)
    where[known] = np.arange(len(known))
    add, factor = np.zeros((2, len(node))), np.ones(len(node))
    at = np.arange(len(node))
    levels = []
    for d in range(CUT - 1, -1, -1):
        levels.append((at, *_weighted(_kt(zeros, ones), below), zeros, ones))
        if d:
            context = node >> 16 if d > 1 else np.zeros(len(node), dtype=np.int64)
            node, up = np.unique(context << 8 | node & 255, return_inverse=True)
            weighted = levels[-1][1]
            zeros, ones, below = (np.bincount(up, v, len(node)) for v in (zeros, ones, weighted))
            at = up[at]
    for at, _, weight, zeros, ones in levels:
        w, total = weight[at], (zeros + ones + 1)[at]
        add = w * np.stack([zeros[at] + 0.5, ones[at] + 0.5]) / total + (1 - w) * add
        factor = (1 - w) * factor
    return where, np.stack([*add, factor]).astype(np.float32)


def _logs(shared, parts: int):
    """By part the grams and their log10 probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, row, (zero, one, factor) = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                gram = np.frombuffer(batch.column("grams")[i].as_py(), dtype=np.int64)
                p = np.frombuffer(batch.column("p")[i].as_py(), dtype=np.float32).reshape(8, -1)
                context, byte, logs = where[gram >> 8 * (DEPTH + 2 - CUT)], gram & 255, np.zeros(len(gram))
                for k in range(8):
                    at = row[context, 1 << k | byte >> (8 - k)]
                    logs += np.log10(np.where(byte >> (7 - k) & 1, one[at], zero[at]) + factor[at] * p[k].astype(np.float64))
                order, cuts = _dealt(gram, parts)
                columns: list[list] = [[], [], []]
                for j in np.flatnonzero(np.diff(cuts)).tolist():
                    own = order[cuts[j] : cuts[j + 1]]
                    for c, v in zip(columns, (parts + j, gram[own].tobytes(), logs[own].astype(np.float32).tobytes()), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "grams", "logs"])

    return run


def _dealt(gram: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of grams by part, then as they are, and where each part starts in it.

    Grams that share four bytes of context share a part: their differences pack well.
    """
    part = (mixed((gram >> 16).astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _dealt_words(word: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of the sorted hashes of words, by their middle bits."""
    part = ((word >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _packed(values: np.ndarray) -> bytes:
    """An array compressed, its bytes by place."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return np.int64(planes.size).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind) -> np.ndarray:
    size = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def gram_logs(docs: DataFrame, parts: int) -> DataFrame:
    """part, grams, logs of all grams of docs (text, held_out), by the texts not held out.

    Null and wordless texts count as an end byte alone.
    """
    grams = docs.select("text", "held_out").mapInArrow(_grams, "gram long, n long")
    grams = grams.repartition(partitions(docs.sparkSession), F.shiftright("gram", 8 * (DEPTH + 1 - CUT))).sortWithinPartitions("gram")
    mixes = saved(grams.mapInArrow(_mixes, MIX_ROW), "mixes")
    nodes = mixes.select(F.explode("nodes").alias("x")).select("x.*").groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).toPandas()  # of at most 65536 contexts
    node = nodes["node"].to_numpy(dtype=np.int64)
    order = np.argsort(node)
    where, values = upper(node[order], *(nodes.iloc[:, j].to_numpy(dtype=np.float64)[order] for j in (1, 2, 3)))
    row = np.zeros((max(1, len(np.unique(node >> 8))), 256), dtype=np.int32)
    row[where[node[order] >> 8], node[order] & 255] = np.arange(len(node))
    return mixes.select("grams", "p").mapInArrow(_logs(docs.sparkSession.sparkContext.broadcast((where, row, values)), parts), "part int, grams binary, logs binary")


PIECE_ROW = "part int, piece long, doc_ids binary, known_ids binary, held binary, n_tokens binary, texts binary, words binary, trained binary, grams binary, logs binary"


def _scatter(parts: int, secret: int):
    """Per piece a row of its texts, by part of the vocabulary its words, by part of the grams its grams.

    A word row has the piece's distinct words of the part and how often its training texts
    have them. Parts of grams follow those of the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            data, at = byte_column(batch.column("text"))
            ids = batch.column("doc_id")
            held_all = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for low, high, part, offsets in pieces(data, at, ASKING):
                words = Words(part, offsets, NOT_BLANK, secret)
                held = held_all[low:high]
                own = ids.slice(low, high - low)
                piece = task << 32 | number
                number += 1
                columns = [
                    [(task + number) % parts], [piece], [own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], [np.asarray(own.is_valid()).tobytes()],
                    [held.tobytes()], [(words.count + 1).astype(np.int64).tobytes()], [_stored(part, offsets)], [None], [None], [None], [None],
                ]
                word, place = np.unique(words.hash, return_inverse=True)
                trained = np.bincount(place, ~held[words.text], len(word)).astype(np.int64)
                order, cuts = _dealt_words(word, parts)
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    own = order[cuts[p] : cuts[p + 1]]
                    row = [p, piece, *[None] * 5, word[own].tobytes(), _packed(trained[own]), None, None]
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                gram = np.unique(keyed(words)[0])
                order, cuts = _dealt(gram, parts)
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    row = [parts + p, piece, *[None] * 7, _packed(gram[order[cuts[p] : cuts[p + 1]]]), None]
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 9]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECE_ROW.split(", ")])

    return run


def _stored(data: np.ndarray, at: np.ndarray) -> bytes:
    """The texts of a piece, compressed, after their number, their size and their ends."""
    head = np.array([len(at) - 1, len(data)], dtype=np.int64)
    return head.tobytes() + at[1:].astype(np.int64).tobytes() + pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def _restored(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = np.frombuffer(stored, dtype=np.int64, count=2).tolist()
    at = np.r_[0, np.frombuffer(stored, dtype=np.int64, count=n, offset=16)]
    return np.frombuffer(pa.decompress(stored[16 + 8 * n :], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8), at


SUM_ROW = "piece long, doc_ids binary, known_ids binary, held binary, n_tokens binary, texts binary, vocabulary long, tokens long, part int, words binary, grams binary"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part of the vocabulary or of the grams, what each piece asks for, in its order.

    That is the training counts of words and the log probabilities of grams.
    """
    names = [x.split()[0] for x in SUM_ROW.split(", ")]
    kinds = [pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    for group in runs(batches, ["part"]):
        rows = group.to_pylist()
        some = [r for r in rows if r["words"]]
        out = [[r["piece"], r["doc_ids"], r["known_ids"], r["held"], r["n_tokens"], r["texts"], 0, 0, None, None, None] for r in rows if r["doc_ids"] is not None]
        table = [r for r in rows if r["logs"]]
        if table:
            gram = np.concatenate([np.frombuffer(r["grams"], dtype=np.int64) for r in table])
            order = np.argsort(gram)
            gram, logs = gram[order], np.concatenate([np.frombuffer(r["logs"], dtype=np.float32) for r in table])[order]
            out += [[r["piece"], *[None] * 5, 0, 0, r["part"], None, _packed(logs[np.searchsorted(gram, _unpacked(r["grams"], np.int64))])] for r in rows if not r["logs"] and r["grams"]]
        if some:
            words = [np.frombuffer(r["words"], dtype=np.uint64) for r in some]
            distinct, place = np.unique(np.concatenate(words), return_inverse=True)
            trained = np.concatenate([_unpacked(r["trained"], np.int64) for r in some])
            count = np.bincount(place, trained, len(distinct)).astype(np.int64)
            at = 0
            for r, w in zip(some, words, strict=True):
                out.append([r["piece"], *[None] * 5, 0, 0, r["part"], _packed(count[place[at : at + len(w)]]), None])
                at += len(w)
            out[-1][6:8] = [int((count > 0).sum()), int(count.sum())]
        for low in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[low : low + 256], strict=True), kinds, strict=True)], names=names)


def _gather(batches: Iterator[pa.RecordBatch], parts: int, secret: int) -> Iterator[pa.RecordBatch]:
    """The texts of each piece, scored by the answers to its words and grams; the first has the piece's totals."""

    def answers(rows: list[dict], name: str, kind) -> np.ndarray:
        some = sorted((r["part"], r[name]) for r in rows if r[name] is not None)
        return np.concatenate([np.zeros(0, dtype=kind), *(_unpacked(x[1], kind) for x in some)])

    for group in runs(batches, ["piece"]):
        rows = group.to_pylist()
        head = next(r for r in rows if r["doc_ids"] is not None)
        ids = np.frombuffer(head["doc_ids"], dtype=np.int64)
        words = Words(*_restored(head["texts"]), NOT_BLANK, secret)
        word, place = np.unique(words.hash, return_inverse=True)
        count = np.zeros(len(word), dtype=np.int64)
        count[_dealt_words(word, parts)[0]] = answers(rows, "words", np.int64)
        logs = np.bincount(words.text, np.log10(count + 1.0)[place], len(ids))
        known = np.bincount(words.text, (count > 0)[place], len(ids)).astype(np.int64)
        key, size = keyed(words)
        gram, place = np.unique(key, return_inverse=True)
        log10 = np.empty(len(gram), dtype=np.float32)
        log10[_dealt(gram, parts)[0]] = answers(rows, "grams", np.float32)
        scores = np.add.reduceat(log10[place].astype(np.float64), np.cumsum(size) - size)
        missing = ~np.frombuffer(head["known_ids"], dtype=bool)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, mask=missing),
                pa.array(np.frombuffer(head["held"], dtype=bool)),
                pa.array(np.frombuffer(head["n_tokens"], dtype=np.int64)),
                pa.array(known),
                pa.array(logs),
                pa.array(scores),
                pa.array(size.astype(np.int64)),
                *(pa.array([sum(r[k] for r in rows), *[0] * (len(ids) - 1)], pa.int64()) for k in ("vocabulary", "tokens")),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "n_bytes", "vocabulary", "tokens"],
        )


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text modulo FOLDS is HELD; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte.

    bits_per_byte is the code length of the text under the tree over the bytes it reads.
    Words are told apart by 64-bit hashes of their bytes under a random key. Tokens are the words and one end. score is the tree's log10 probability of the text,
    base_score the sum of log10((c + 1) / (N + V + 1)) over tokens, with counts c, N tokens
    and V distinct ones in the texts that are not held out. Null and wordless texts are an
    end alone. Rows stand for themselves, repeated ones too. Without training texts all
    bytes are equally likely.

    The vocabulary grows with the corpus, so its counts are shuffled: the distinct words of
    each piece of text by parts of the vocabulary, and their counts back by piece of text.
    The grams of the tree go the same way. A text of any length is one piece at most.
    """
    spark = docs.sparkSession
    n, secret = partitions(spark), secrets.randbits(64)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    parts = PARTS * n
    rows = docs.mapInArrow(_scatter(parts, secret), PIECE_ROW).unionByName(gram_logs(docs, parts), allowMissingColumns=True)
    sums = rows.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_counted, SUM_ROW)
    texts = sums.repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(
        lambda batches: _gather(batches, parts, secret), "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long, vocabulary long, tokens long"
    )
    texts = saved(texts, "texts")
    ends = docs.agg(F.count_if(~F.col("held_out")).alias("ends"))
    whole = texts.agg(F.sum("vocabulary").alias("v"), F.sum("tokens").alias("t")).crossJoin(ends).first()  # one row each
    ends = whole.ends or 0
    tokens, vocabulary = (whole.t or 0) + ends, (whole.v or 0) + (1 if ends else 0)
    unit = float(np.log10(tokens + vocabulary + 1))
    end = float(np.log10(ends + 1))
    return texts.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + (1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + end - F.col("n_tokens") * unit).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
