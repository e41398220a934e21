"""MinHash near-deduplication with HyperMinHash sketches.

A document is the set of its word shingles. Its sketch has one register for each of 128
buckets: the leading-zero count of the bucket's smallest hash and ten mantissa bits after
the first one. Empty registers borrow from others; bands of four registers
bring candidates together, a collision-corrected estimate rules out those far below the
threshold, and links are confirmed on the full sets.

Equal sets are one class from the start, so copies are never paired. Neither stage emits
pairs: each returns spanning forests of what it linked. Of a bucket or family of many
members all meet a few leaders first; only those that are then unlike most are compared on.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._groups import BLOCK, chunks, components, settled
from weft.llm._store import saved
from weft.llm._text import NOT_BLANK, Words, byte_column, pieces, shingles

BUCKET_BITS = 7
MANTISSA_BITS = 10
BAND = 4
EMPTY = 0xFFFF
#: Texts and sketches are shuffled only where one that is wanted has the same one of so many marks.
MARKS = 1 << 20
#: Shingles of a block of full sets, unless one set has more.
MOST_SHINGLES = 1 << 21
#: Standard deviations of the estimate by which a candidate may fall short.
SLACK = 5.0


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit registers per sorted set of 64-bit hashes."""
    buckets = 1 << BUCKET_BITS
    out = np.full(len(sets) * buckets, EMPTY, dtype=np.uint16)
    if not sets:
        return out.reshape(0, buckets)
    values = np.concatenate(sets)
    if len(values):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        slot = owner * buckets + (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.r_[True, slot[1:] != slot[:-1]]
        rest = (values[first] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)) >> np.uint64(4)
        width = 60 - BUCKET_BITS
        fraction, bits = np.frexp(rest.astype(np.float64))
        zeros = np.where(rest > 0, width - bits, width).astype(np.int64)
        mantissa = np.where(rest > 0, (fraction * 2 - 1) * (1 << MANTISSA_BITS), 0).astype(np.int64)
        out[slot[first]] = (zeros << MANTISSA_BITS | mantissa).astype(np.uint16)
    return out.reshape(len(sets), buckets)


def estimates(one: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of one sketch with others, and the registers each rests on.

    Of the matching registers those are taken off that would match by chance, for sets of
    n and m members about 0.1699 * 2 ** (p - r) * 4nm / (n + m) ** 2.
    """
    full = one != EMPTY
    used = ((others != EMPTY) | full).sum(1)
    same = ((others == one) & full).sum(1)
    ratio = 4.0 * n * sizes / (n + sizes) ** 2
    chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * ratio
    return np.maximum(same - chance, 0) / np.maximum(used, 1), used


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch(k: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_column(batch.column("text"))
            for low, high, part, offsets in pieces(data, at):
                sets = shingles(Words(part, offsets, NOT_BLANK, key), k)
                rows = registers(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([r.tobytes() if len(s) else None for r, s in zip(rows, sets, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "registers"],
                )

    return run


#: Of each register, the order in which it borrows from the others where it is empty.
_LENDERS = np.random.default_rng(1).permuted(np.tile(np.arange(1 << BUCKET_BITS), (1 << BUCKET_BITS, 1)), axis=1)


def filled(rows: np.ndarray) -> np.ndarray:
    """Registers, the empty ones with the value of the first lender that has one.

    Any two sets agree in such a register with the odds of their similarity, so that bands of
    small sets say as much as those of large ones.
    """
    out = rows.copy()
    which, at = np.nonzero((rows == EMPTY) & (rows != EMPTY).any(1)[:, None])
    for step in range(rows.shape[1]):
        if not len(which):
            break
        value = rows[which, _LENDERS[at, step]]
        full = value != EMPTY
        out[which[full], at[full]] = value[full]
        which, at = which[~full], at[~full]
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, band and key (the band's four registers, filled) of each band."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.frombuffer(b"".join(batch.column("registers").to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1)
        keys = np.ascontiguousarray(filled(rows)).view(np.int64)
        node, bands = batch.column("node").to_numpy(), keys.shape[1]
        band = np.tile(np.arange(bands, dtype=np.int32), len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, bands)), pa.array(band), pa.array(keys.ravel())], names=["node", "band", "key"])


def _near(threshold: float, one: np.ndarray, n, others: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates, and which of them may stand for a similarity of the threshold or more.

    Sets of n and m members that are so similar differ in (n + m) * (1 - t) / (1 + t) at most,
    and a register can differ only by one of these.
    """
    guess, used = estimates(one, n, others, sizes)
    near = guess >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
    near &= (others != one).sum(1) <= (n + sizes) * (1 - threshold) / (1 + threshold) + 1e-9
    return guess, near & (np.minimum(n, sizes) >= threshold * np.maximum(n, sizes) * (1 - 1e-12))


def _forest(percent: int, confirm: bool):
    """Spanning forests of the linked rows of each group, for settled().

    Links are pairs whose estimate is near the threshold or, with confirm, those of these
    that the full sets bear out.
    """
    threshold = percent / 100

    def of_group(node, label, probe, other, size, rows, sets) -> tuple[list[int], list[int]]:
        """Positions of the edges; the best estimates are confirmed first."""
        _, now = np.unique(label, return_inverse=True)
        every = np.flatnonzero(other)
        a, b = [], []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(probe).tolist():
            mates = every[now[every] != now[i]]
            if other[i]:
                mates = mates[mates > i]
            if not len(mates):
                continue
            guess, near = _near(threshold, rows[i], size[i], rows[mates], size[mates])
            mates, guess = mates[near], guess[near]
            if not len(mates):
                continue
            if confirm:
                found.append((guess, np.full(len(mates), i), mates))
                continue
            kinds, at = np.unique(now[mates], return_index=True)
            a += [i] * len(at)
            b += mates[at].tolist()
            now[np.isin(now, kinds)] = now[i]
        if found:
            guess, one, two = (np.concatenate(c) for c in zip(*found, strict=True))
            for k in np.argsort(-guess, kind="stable").tolist():
                i, j = int(one[k]), int(two[k])
                if now[i] == now[j]:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (size[i] + size[j] - common):
                    a.append(i)
                    b.append(j)
                    now[now == now[j]] = now[i]
        return a, b

    def by(cell: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [*cell[:-2], "a", "b"]
            for table, heads in chunks(batches, cell, 256 if confirm else 1 << 13):
                ends = np.r_[heads[1:], table.num_rows]
                node, label, probe, other = (table[k].to_numpy() for k in ("node", "label", "probe", "other"))
                if confirm:
                    sets = [np.frombuffer(x, dtype=np.uint64) for x in table["members"].to_pylist()]
                    size, rows = np.array([len(s) for s in sets]), registers(sets)
                else:
                    sets, size = [], table["n_shingles"].to_numpy()
                    rows = np.frombuffer(b"".join(table["registers"].to_pylist()), dtype=np.uint16).reshape(len(node), -1)
                a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                open_ = ends - heads > 1
                if not confirm:  # most groups are settled by their first member
                    first = np.repeat(heads, ends - heads)
                    rest = np.flatnonzero((first != np.arange(len(node))) & other & probe)
                    _, near = _near(threshold, rows[first[rest]], size[first[rest]], rows[rest], size[rest])
                    alike = np.bincount(np.searchsorted(heads, rest[near], "right") - 1, minlength=len(heads))
                    star = (alike == ends - heads - 1) & open_
                    of_star = star[np.searchsorted(heads, rest, "right") - 1]
                    a.append(first[rest[of_star]])
                    b.append(rest[of_star])
                    open_ &= ~star
                for low, high in zip(heads[open_].tolist(), ends[open_].tolist(), strict=True):
                    part = slice(low, high)
                    x, y = of_group(node[part], label[part], probe[part], other[part], size[part], rows[part], sets[part])
                    a.append(np.array(x, dtype=np.int64) + low)
                    b.append(np.array(y, dtype=np.int64) + low)
                one, two = np.concatenate(a), np.concatenate(b)
                group = [table[k].to_numpy()[one] for k in cell[:-2]]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (*group, node[one], node[two])], names=names)

        return run

    return by


def _sets(k: int, key: int):
    """The full sets of the family members, each of the very text its sketch came from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_column(batch.column("text"))
            for low, high, part, offsets in pieces(data, at):
                sets = shingles(Words(part, offsets, NOT_BLANK, key), k)
                wanted = batch.column("digest").slice(low, high - low).to_pylist()
                right = [i for i, s in enumerate(sets) if len(s) and _digest(s) == wanted[i]]
                rows = batch.slice(low, high - low).take(pa.array(right, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(k) for k in ("family", "node", "n", "blocks")), pa.array([sets[i].tobytes() for i in right], pa.binary())],
                    names=["family", "node", "n", "blocks", "members"],
                )

    return run


def _mark(name: str) -> Column:
    """One of MARKS numbers of an id."""
    return F.pmod(F.xxhash64(name), F.lit(MARKS))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A-Z is lower-cased and words are runs of bytes other than blanks. Two documents are
    linked when 100 * common >= percent * united shingles; component_id is the smallest id
    reachable over links. Null and wordless texts have no shingles and are linked with
    nothing; texts of fewer than `words` words have their whole sequence as one shingle.
    Ids are of any type that can be ordered. Rows with the same id count as what their texts are; kept is doc_id = component_id, and
    a null id is kept only where its whole component has null ids.

    A linked pair is missed if it shares no band: at a similarity of 0.8 with odds of
    about 5e-8 (1e-6 for sets of a few shingles), and less above. Texts may be of any length:
    each is worked on whole, in one task, with about 20 bytes of memory a byte of text.
    Shingles are told apart by 64-bit hashes of their words' bytes under a random key.
    """
    key = secrets.randbits(64)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = saved(docs.mapInArrow(_sketch(words, key), f"doc_id {kind}, n_shingles long, digest binary, registers binary"), "sketches")
    classes = saved(
        sketches.filter("digest is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    # Smaller sets are as similar as that to none but themselves.
    bands = classes.filter(F.col("n_shingles") * 100 >= (F.col("n_shingles") + 1) * percent).select("node", "registers").mapInArrow(_bands, "node long, band int, key long")
    shared = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = saved(bands.join(saved(shared.select("band", "key"), "repeated"), ["band", "key"]), "members")
    # Near copies share many bands: of buckets with the very same members one is enough.
    alone = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    alone = alone.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("at"))
    shared = saved(alone.select("at.band", "at.key", "n", F.ceil(F.col("n") / block).cast("long").alias("blocks")), "buckets")

    def sketched(some: str) -> DataFrame:
        rows = members.join(shared.filter(some), ["band", "key"])
        marked = rows.select(_mark("node").alias("mark")).distinct()  # MARKS rows at most
        asked = classes.select("node", "n_shingles", "registers", _mark("node").alias("mark")).join(F.broadcast(marked), "mark", "left_semi").drop("mark")
        return rows.join(asked, "node")

    alike = settled(shared, sketched, ["band", "key"], _forest(percent, False), block)
    family = saved(components(alike), "families").withColumnRenamed("root", "family").join(classes.select("node", "low", "digest", "n_shingles"), "node")
    most = F.greatest(F.count(F.lit(1)) / block, F.sum("n_shingles") / MOST_SHINGLES)
    sized = saved(family.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.ceil(most).cast("long").alias("blocks")), "sizes")

    wanted = family.join(sized, "family").drop("n_shingles")
    marked = wanted.select(_mark("low").alias("mark")).distinct()  # MARKS rows at most
    some = docs.withColumn("mark", _mark("doc_id")).join(F.broadcast(marked), "mark", "left_semi")
    texts = some.join(wanted, some.doc_id.eqNullSafe(wanted.low)).select("family", "node", "n", "blocks", "digest", "text")
    sets = texts.mapInArrow(_sets(words, key), "family long, node long, n long, blocks long, members binary")
    sets = saved(sets.dropDuplicates(["node"]), "sets")
    links = settled(sized, sets.filter, ["family"], _forest(percent, True), block)
    joined = saved(components(links), "components")
    low = joined.join(classes.select("node", "low"), "node")
    least = low.groupBy("root").agg(F.min("low").alias("component"))
    moved = low.join(least, "root").select("node", "component")
    named = classes.select("node", "digest", "low").join(moved, "node", "left").select("digest", F.coalesce("component", "low").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    whole = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), F.col("doc_id").eqNullSafe(whole).alias("kept"))
