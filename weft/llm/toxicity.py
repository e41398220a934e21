"""Toxicity by multiple-instance learning: sentences scored, documents combined by noisy-or.

A document is a bag of sentences. A sentence's probability comes from its words; the
document's is one minus the product of the sentences' complements. Only documents are
labelled; the gradient of the document's loss tells the sentences apart, so that the
offending ones can be named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm._text import ALNUM, Words, byte_column, pieces
from weft.llm.quality import held_out

#: Places of the hashed words and stems.
PLACES = 1 << 18
#: Bytes of the stems that count beside the whole word.
STEMS = (4, 5, 6)
#: At most so many labelled documents train the model.
SAMPLE = 20_000
#: A word or stem counts if so many documents of the sample have it, and if the toxic share
#: among them differs from that of the sample by so many standard errors.
LEAST_DOCUMENTS = 4
LEAST_ERRORS = 2.5
OFFENDING = 0.5

STOP = np.zeros(256, dtype=bool)
STOP[[10, 33, 46, 63]] = True  # line break ! . ?


def sentences(data: np.ndarray, at: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of the texts and, for each, the number of its sentence within the piece.

    Sentences end at . ! ? and line breaks, and with the text.
    """
    words = Words(data, at, ALNUM)
    stops = np.cumsum(STOP[data]) if len(data) else np.zeros(0, dtype=np.int64)
    number = stops[words.start] + words.text  # the text's number sets texts without stops apart
    _, dense = np.unique(number, return_inverse=True)
    return words, dense


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words and their stems, in reading order, and the word each is of."""
    columns, there = [words.hash], [np.ones(len(words), dtype=bool)]
    for k in STEMS:
        h, longer = words.prefix(k)
        columns.append(h)
        there.append(longer)
    some = np.stack(there, axis=1)
    place = (np.stack(columns, axis=1) >> np.uint64(11)).astype(np.int64) % PLACES
    return place[some], np.repeat(np.arange(len(words)), some.sum(1))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per place the documents, and the toxic ones, of this task that have it."""
    have, toxic = np.zeros(PLACES, dtype=np.int64), np.zeros(PLACES, dtype=np.int64)
    for batch in batches:
        data, at = byte_column(batch.column("text"))
        label = batch.column("label").to_numpy()
        for low, _, part, offsets in pieces(data, at):
            words, _ = sentences(part, offsets)
            place, word = features(words)
            pair = np.unique(words.text[word] * PLACES + place)
            have += np.bincount(pair % PLACES, minlength=PLACES)
            toxic += np.bincount(pair[label[low + pair // PLACES] == 1] % PLACES, minlength=PLACES)
    some = np.flatnonzero(have)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(have[some]), pa.array(toxic[some])], names=["place", "have", "toxic"])


def _bags(shared):
    """label and, of the features kept, the columns and the sentences within the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = shared.value
        for batch in batches:
            data, at = byte_column(batch.column("text"))
            for low, high, part, offsets in pieces(data, at):
                words, number = sentences(part, offsets)
                place, word = features(words)
                col = column[place]
                col, word = col[col >= 0], word[col >= 0]
                ends = np.searchsorted(words.text[word], np.arange(high - low), "right").tolist()
                first = np.searchsorted(words.text, np.arange(high - low), "left")
                base = np.r_[number, 0][first]
                full = words.count > 0
                n = np.zeros(high - low, dtype=np.int64)
                n[full] = number[np.cumsum(words.count)[full] - 1] - base[full] + 1
                spans = list(zip([0, *ends[:-1]], ends, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        batch.column("label").slice(low, high - low),
                        pa.array(n),
                        pa.array([col[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary()),
                        pa.array([(number[word[a:b]] - base[i]).astype(np.int32).tobytes() for i, (a, b) in enumerate(spans)], pa.binary()),
                    ],
                    names=["doc_id", "label", "n_sentences", "columns", "sentences"],
                )

    return run


def train(bags: list[tuple[int, int, np.ndarray, np.ndarray]], width: int, steps: int = 250, rate: float = 0.08, decay: float = 2e-6) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, number of sentences, columns, sentence numbers)."""
    w, bias = np.zeros(width), -6.0
    label = np.array([b[0] for b in bags])
    if not len(label):
        return w, np.nan
    if label.min() == label.max():
        return w, 1.0 if label[0] == 1 else bias
    count = np.array([max(1, b[1]) for b in bags])
    base = np.cumsum(count) - count
    col = np.concatenate([b[2] for b in bags])
    row = np.concatenate([b[3] + base[i] for i, b in enumerate(bags)])
    bag = np.repeat(np.arange(len(bags)), count)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.clip(np.bincount(row, w[col], len(bag)) + bias, -30, 30)
        total = np.bincount(bag, np.logaddexp(0, z), len(bags))
        slope = np.where(label == 1, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-9), 1.0)
        dz = (np.clip(slope, -50, 1) / len(bags))[bag] / (1 + np.exp(-z))
        g = np.r_[np.bincount(col, dz[row], width) + decay * w, dz.sum()]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w -= move[:-1]
        bias -= move[-1]
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE) -> np.ndarray:
    """Weights of all places and, last, the bias.

    At most `sample` labelled documents train it, those whose ids have the smallest hashes.
    Held-out ids and null labels are not looked at. Without any label all scores are 0.5
    (the bias is then no number); with one kind of label they are near that label.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most `sample` rows of two numbers
    counts = rows.mapInArrow(_counts, "place long, have long, toxic long").groupBy("place").agg(F.sum("have").alias("have"), F.sum("toxic").alias("toxic"))
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    share = (toxic or 0) / max(n, 1)
    errors = F.abs(F.col("toxic") - F.col("have") * share) / F.sqrt(F.col("have") * max(share * (1 - share), 1e-9))
    kept = sorted(r.place for r in counts.filter((F.col("have") >= LEAST_DOCUMENTS) & (errors >= LEAST_ERRORS)).select("place").collect())
    column = np.full(PLACES, -1, dtype=np.int32)
    column[kept] = np.arange(len(kept))
    shape = "doc_id long, label int, n_sentences long, columns binary, sentences binary"
    shared = spark.sparkContext.broadcast(column)
    got = rows.mapInArrow(_bags(shared), shape).collect()
    shared.destroy()
    got.sort(key=lambda r: (r.doc_id, r.label, r.n_sentences, bytes(r["columns"])))
    bags = [(r.label, r.n_sentences, np.frombuffer(r["columns"], dtype=np.int32), np.frombuffer(r["sentences"], dtype=np.int32)) for r in got]
    weights = np.zeros(PLACES + 1)
    weights[kept], weights[-1] = train(bags, len(kept))
    return weights


def _score(shared, text_col: str):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            data, at = byte_column(batch.column("row").field(text_col))
            for low, high, part, offsets in pieces(data, at):
                words, number = sentences(part, offsets)
                place, word = features(words)
                n = int(number[-1]) + 1 if len(number) else 0
                z = np.clip(np.bincount(number[word], weights[place], n) + weights[-1], -30, 30)
                first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]][: len(number)])
                last = np.r_[first[1:] - 1, len(number) - 1].astype(np.int64)[: len(first)]
                of = words.text[first]
                total = np.bincount(of, np.logaddexp(0, z), high - low)
                chance = 1 / (1 + np.exp(-z))
                spans: list[list[dict]] = [[] for _ in range(high - low)]
                for s in np.flatnonzero(chance >= OFFENDING).tolist():
                    start = offsets[of[s]]
                    spans[of[s]].append({"start": int(words.start[first[s]] - start), "end": int(words.end[last[s]] - start), "score": float(chance[s])})
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(low, high - low), pa.array(np.where(np.isnan(weights[-1]), 0.5, -np.expm1(-total)), pa.float64()), pa.array(spans, pa.list_(span))], names=["row", "score", "offending"])

    return run


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """row (all columns of docs as they are), score, offending.

    offending are the sentences (first byte, end, probability) at OFFENDING or above. Texts
    without words, null ones included, have no sentences and the score 0 (0.5 without labels). A text of any
    length is worked on whole, in one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    rows = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row"))
    kinds = [("start", T.LongType()), ("end", T.LongType()), ("score", T.DoubleType())]
    span = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in kinds]))
    return rows.mapInArrow(_score(shared, text_col), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("offending", span)]))
