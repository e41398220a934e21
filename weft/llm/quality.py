"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Each token of the vocabulary (hashed to VOCABULARY places) has a sparse random index
vector; its word vector is the sum of the index vectors of its neighbours over the whole
corpus. A document is the mean of its tokens' vectors, overall and in its oddest stretch. A
small network, trained in numpy on a bounded sample of labelled documents, scores it; a
temperature fitted on documents kept from the training makes the scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm._text import ALNUM, NOT_BLANK, Words, byte_column, mixed, pieces

VOCABULARY = 1 << 14
WIDTH = 32
#: Non-zero entries of an index vector.
SPARSE = 4
#: Neighbours on either side.
REACH = 2
#: At most so many labelled documents train the network.
SAMPLE = 20_000
HIDDEN = 32
#: Tokens of the stretches of which the oddest is looked at on its own.
STRETCH = 40

SYMBOL = NOT_BLANK & ~ALNUM


def index_vectors() -> np.ndarray:
    """Ternary vectors of all places, from a hash of the place."""
    out = np.zeros((VOCABULARY, WIDTH), dtype=np.float32)
    place = np.arange(VOCABULARY)
    for j in range(SPARSE):
        h = mixed(np.arange(VOCABULARY, dtype=np.uint64) * np.uint64(SPARSE) + np.uint64(j + 1))
        out[place, (h >> np.uint64(8)).astype(np.int64) % WIDTH] += np.where(h & np.uint64(1), 1.0, -1.0)
    return out


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary place and text number of words and of runs of symbols, in reading order.

    Words written in capitals or digits throughout count by that alone.
    """
    words, symbols = Words(data, at, ALNUM), Words(data, at, SYMBOL)
    size = words.end - words.start
    upper = np.r_[0, np.cumsum((data >= 65) & (data <= 90))]
    digit = np.r_[0, np.cumsum((data >= 48) & (data <= 57))]
    h = words.hash.copy()
    h[(size > 1) & (upper[words.end] - upper[words.start] == size)] = 1
    h[digit[words.end] - digit[words.start] == size] = 2
    start = np.r_[words.start, symbols.start]
    order = np.argsort(start, kind="stable")
    place = (mixed(np.r_[h, symbols.hash ^ np.uint64(3)][order]) >> np.uint64(7)).astype(np.int64) % VOCABULARY
    return place, np.r_[words.text, symbols.text][order]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per place the sum of the index vectors of its neighbours in this task's texts."""
    index = index_vectors()
    total = np.zeros((VOCABULARY, WIDTH), dtype=np.int64)
    for batch in batches:
        data, at = byte_column(batch.column("text"))
        for _, _, part, offsets in pieces(data, at):
            place, text = tokens(part, offsets)
            if len(place) < 2:
                continue
            own = index[place]
            near = np.zeros_like(own)
            for d in range(1, REACH + 1):
                same = (text[d:] == text[:-d])[:, None]
                near[d:] += own[:-d] * same
                near[:-d] += own[d:] * same
            order = np.argsort(place, kind="stable")
            sorted_place = place[order]
            heads = np.flatnonzero(np.r_[True, sorted_place[1:] != sorted_place[:-1]])
            total[sorted_place[heads]] += np.add.reduceat(near[order], heads, axis=0).astype(np.int64)
    some = np.flatnonzero(total.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, j]) for j in range(WIDTH))], names=["place", *(f"v{j}" for j in range(WIDTH))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit word vectors of all places, from all texts.

    Each task sums its own texts; the sums are integers, so neither partitions nor retries
    change them, and meet by place. The result has VOCABULARY rows whatever the corpus.
    """
    shape = "place long, " + ", ".join(f"v{j} long" for j in range(WIDTH))
    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(_neighbours, shape)
    rows = sums.groupBy("place").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(WIDTH)]).toArrow()
    rows = np.stack([c.to_numpy() for c in rows.columns], axis=1)
    out = np.zeros((VOCABULARY, WIDTH), dtype=np.float32)
    if len(rows):
        values = rows[:, 1:].astype(np.float64)
        out[rows[:, 0].astype(np.int64)] = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-9)
    return out


def pooled(data: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean vector, that of the stretch farthest from it, tokens' log count."""
    texts = len(at) - 1
    out = np.zeros((texts, 2 * WIDTH + 1), dtype=np.float32)
    place, text = tokens(data, at)
    if not len(place):
        return out
    count = np.bincount(text, minlength=texts)
    full = count > 0
    heads = (np.cumsum(count) - count)[full]
    own = vectors[place]
    out[full, :WIDTH] = np.add.reduceat(own, heads, axis=0) / count[full][:, None]
    at_token = np.arange(len(place)) - np.repeat(heads, count[full])
    first = np.flatnonzero(at_token % STRETCH == 0)
    size = np.diff(np.r_[first, len(place)])
    stretch = np.add.reduceat(own, first, axis=0) / size[:, None]
    of = text[first]
    far = ((stretch - out[of, :WIDTH]) ** 2).sum(1) * np.minimum(size, STRETCH) / STRETCH
    order = np.lexsort((far, of))
    last = np.flatnonzero(np.r_[of[order][1:] != of[order][:-1], True])
    out[of[order][last], WIDTH : 2 * WIDTH] = stretch[order[last]]
    out[:, -1] = np.log1p(count)
    return out


@dataclass
class Network:
    """Two layers, with the inputs' scale and the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.first + self.first_bias, 0)
        return hidden @ self.second + self.second_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, steps: int = 1500, batch: int = 512, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network:
    """Fit on four fifths with Adam and the temperature on the rest; x in a fixed order."""
    x = x.astype(np.float64)
    rng = np.random.default_rng(seed)
    aside = np.arange(len(x)) % 5 == 4
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    net = Network(mean, scale, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0)
    z, t = ((x - mean) / scale)[~aside], y[~aside].astype(np.float64)
    if not len(z) or t.min() == t.max():
        net.second[:] = 0
        share = (y.sum() + 1) / (len(y) + 2)
        net.second_bias = float(np.log(share / (1 - share)))
        return net
    params = [net.first, net.first_bias, net.second, np.zeros(1)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(z), batch)
        a, b = z[pick], t[pick]
        pre = a @ params[0] + params[1]
        hidden = np.maximum(pre, 0)
        out = hidden @ params[2] + params[3][0]
        g = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - b) / batch
        back = np.outer(g, params[2]) * (pre > 0)
        grads = [a.T @ back + decay * params[0], back.sum(0), hidden.T @ g + decay * params[2], np.array([g.sum()])]
        for p, m, d in zip(params, moments, grads, strict=True):
            m[0] += 0.1 * (d - m[0])
            m[1] += 0.001 * (d * d - m[1])
            p -= rate * (1 - step / (steps + 1)) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    net.second_bias = float(params[3][0])
    if aside.any():
        logits, truth = net.logits(x[aside]), y[aside]
        grid = np.exp(np.linspace(np.log(0.3), np.log(8), 120))
        loss = [np.logaddexp(0, np.where(truth == 1, -logits, logits) / s).mean() for s in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def _pool(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_column(batch.column("text"))
            for low, high, part, offsets in pieces(data, at):
                rows = pooled(part, offsets, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), batch.column("label").slice(low, high - low), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "x"])

    return run


def _score(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for batch in batches:
            data, at = byte_column(batch.column("row").field(text_col))
            for low, high, part, offsets in pieces(data, at):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(low, high - low), pa.array(net.scores(pooled(part, offsets, vectors)), pa.float64())], names=["row", "score"])

    return run


def held_out(doc_id, folds: int = 5, fold: int = 0) -> F.Column:
    """Whether crc32 of the id as text leaves this remainder; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all docs, and a network trained on at most `sample` labelled ones.

    Labels of held-out ids and null labels are not looked at. The sample are the labelled
    ids with the smallest hashes. Without any label all scores are 0.5; with one kind of
    label, its smoothed share.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most `sample` rows of two numbers
    shared = spark.sparkContext.broadcast(vectors)
    rows = rows.mapInArrow(_pool(shared), "doc_id long, label int, x binary")
    got = sorted((r.doc_id, r.label, bytes(r.x)) for r in rows.collect())
    shared.destroy()
    if not got:
        return vectors, train(np.zeros((0, 2 * WIDTH + 1)), np.zeros(0))
    order = np.random.default_rng(1).permutation(len(got))
    x = np.frombuffer(b"".join(g[2] for g in got), dtype=np.float32).reshape(len(got), -1)[order]
    y = np.array([g[1] for g in got])[order]
    return vectors, train(x, y)


def score(docs: DataFrame, model: tuple[np.ndarray, Network], text_col: str = "text") -> DataFrame:
    """row (all columns of docs as they are) and score, the probability of label 1.

    Null and wordless texts get the score of a text without tokens. Only the text counts,
    the whole of it: one of any length is worked on in one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(_score(shared, text_col), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
