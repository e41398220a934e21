"""Similarities of two texts."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weft.functions.text import bigrams


def bigram_f1(rows: DataFrame, key: list[str], a: Column, b: Column) -> DataFrame:
    """key, f1: 2 * shared / all character bigrams of a and b, as multisets; 0 without any.

    Bigrams are counted as rows, so long texts cost what they hold and not its square.
    """
    side = lambda c, x, y: F.transform(bigrams(F.coalesce(c, F.lit(""))), lambda g: F.struct(g.alias("g"), F.lit(x).alias("x"), F.lit(y).alias("y")))
    each = rows.select(*key, F.explode_outer(F.concat(side(a, 1, 0), side(b, 0, 1))).alias("s"))
    counts = each.groupBy(*key, "s.g").agg(F.sum("s.x").alias("x"), F.sum("s.y").alias("y"))
    sums = counts.groupBy(*key).agg(F.sum(F.least("x", "y")).alias("both"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    some = (F.coalesce("x", F.lit(0)) > 0) & (F.coalesce("y", F.lit(0)) > 0)
    return sums.select(*key, F.round(F.when(some, 2.0 * F.col("both") / (F.col("x") + F.col("y"))).otherwise(0.0), 9).alias("f1"))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per character of a.

    Common characters in front and at the end belong to one and are counted first.
    """
    if a == b:
        return len(a)
    front = len(os.path.commonprefix([a, b]))
    a, b = a[front:], b[front:]
    back = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - back], b[: len(b) - back]
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return front + back + len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def lcs_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / (length + length); 1 for two empty texts, null if either is null."""
    return pd.Series([None if x is None or y is None else 2 * _lcs(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(a, b, strict=True)], dtype="float64")


GRAM = 6


def _hashes(text: str) -> np.ndarray:
    """Hashes of the grams of GRAM characters, in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = max(len(codes) - GRAM + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(GRAM):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    return out


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of GRAM characters, sorted, and how often each occurs."""
    return np.unique(_hashes(text), return_counts=True)


def _bound(a: str, b: str) -> float:
    """No less than the LCS ratio of a and b, neither being empty.

    A character outside the LCS touches GRAM grams of its own text at most, and parts
    GRAM - 1 of the other's; grams that share a hash only raise the bound.
    """
    (x, nx), (y, ny) = _grams(a), _grams(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    total = len(a) + len(b)
    lost = total - 2 * (GRAM - 1) - 2 * int(np.minimum(nx[i], ny[j]).sum())
    return 1 - max(lost, 0) / ((2 * GRAM - 1) * total)


def near_ratio_udf(least: float):
    """The LCS ratio where it is `least` or more, else null; most others cost no LCS."""

    def ratio(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if x == y:
            return 1.0
        total = len(x) + len(y)
        if 2 * min(len(x), len(y)) / total < least or _bound(x, y) < least - 1e-9:
            return None
        out = 2 * _lcs(x, y) / total
        return out if out >= least else None

    @F.pandas_udf(DoubleType())
    def near_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return near_ratio


class NearPool:
    """Texts of a bounded pool, by the grams they hold, to find those near a given text.

    A text is cut into grams that do not overlap. A character outside the longest common
    subsequence, of either text, spoils one of them at most; the others occur in both. What
    has enough of them is counted in all grams, and what that leaves is compared exactly.
    """

    def __init__(self, texts: list[str], least: float, length: int, gap: float, block: int | None):
        self.texts, self.least, self.length, self.gap, self.block = texts, least, length, gap, block
        found = [_grams(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(g) for g, _ in found])
        gram = np.concatenate([np.zeros(0, dtype=np.uint64), *(g for g, _ in found)])
        order = np.argsort(gram, kind="stable")
        self.owner, self.times = owner[order], np.concatenate([np.zeros(0, dtype=np.int64), *(n for _, n in found)])[order]
        self.gram, self.start, self.held = np.unique(gram[order], return_index=True, return_counts=True)
        self.size = np.array([len(t) for t in texts], dtype=np.int64)

    def needed(self, total: np.ndarray | float) -> np.ndarray | float:
        """Grams that two texts of so many characters together share if their LCS ratio is `least`."""
        return (total * (1 - (2 * GRAM - 1) * (1 - self.least)) - 2 * (GRAM - 1)) / 2 - 1e-9

    def known(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where some grams are among the pool's, and which of them are there."""
        at = np.minimum(np.searchsorted(self.gram, grams), len(self.gram) - 1)
        return at, self.gram[at] == grams

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Where the entries of some of the pool's grams lie."""
        held = self.held[grams]
        return np.repeat(self.start[grams] - np.cumsum(held) + held, held) + np.arange(held.sum())

    def near(self, text: str, first: int | None = None, tail_only: bool = False) -> list[tuple[int, float]]:
        """Position and LCS ratio of the pool's texts that are near this one.

        With first, of so many first ones; with tail_only, of those that share its tail but not its head.
        """
        m = len(text)
        if m < self.length or not len(self.gram) or first == 0:
            return []
        hashes = _hashes(text)
        cut = hashes[::GRAM]
        at, known = self.known(cut)
        hits = np.bincount(self.owner[self.places(at[known])], minlength=len(self.texts))[:first]
        size = self.size[:first]
        fits = (size >= self.length) & (np.abs(size - m) <= self.gap * np.maximum(size, m))
        mates = np.flatnonzero(fits & (hits >= len(cut) - (1 - self.least) * (size + m) - 1e-6))
        if len(mates):
            grams, times = np.unique(hashes, return_counts=True)
            at, known = self.known(grams)
            rows = self.places(at[known])
            common = np.minimum(self.times[rows], np.repeat(times[known], self.held[at[known]]))
            shared = np.bincount(self.owner[rows], common, len(self.texts))
            mates = mates[shared[mates] >= self.needed(self.size[mates] + m)]
        if self.block:
            head, tail = text[: self.block], text[-self.block :]
            heads = [self.texts[i].startswith(head) for i in mates.tolist()]
            mates = [i for i, same in zip(mates.tolist(), heads, strict=True) if not tail_only and same or not same and self.texts[i].endswith(tail)]
        ratios = [(int(i), 2 * _lcs(self.texts[i], text) / (len(self.texts[i]) + m)) for i in mates]
        return [(i, r) for i, r in ratios if r >= self.least]
