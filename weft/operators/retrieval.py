"""Hybrid retrieval as set operations: every question at once, no loop over questions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.automaton import Automaton
from weft.sources.scratch import spread, written

FUZZY = 0.3
RRF_K = 60
WORDS = regex.compile(r"[\p{L}\p{N}]+")
#: Query vectors that are sent to all tasks at once.
QUERY_BLOCK = 4096


#: Characters of terms that are sent to all tasks at once.
TERM_BLOCK = 1 << 20
#: Words whose trigrams a task remembers.
KNOWN_WORDS = 1 << 17


@dataclass(frozen=True)
class Filters:
    """Which chunks each question may be given: distinct conditions, and the one of each question.

    A condition has texts that columns contain, in any case and with % and _ as wildcards, and
    lists of values that columns are among. Questions without a condition may be given all.
    """

    conditions: tuple[dict, ...]
    of: dict[int, int]

    def allowed(self, batch: pa.RecordBatch, qids: np.ndarray) -> np.ndarray:
        """Rows of the batch by questions."""
        every = [np.ones(batch.num_rows, dtype=bool)]
        for condition in self.conditions:
            ok = every[0].copy()
            for column, value in condition.items():
                values = batch.column(column)
                fits = pc.is_in(values, pa.array(value, values.type)) if isinstance(value, (list, tuple)) else pc.match_like(values, f"%{value}%", ignore_case=True)
                ok &= pc.fill_null(fits, False).to_numpy(zero_copy_only=False)
            every.append(ok)
        return np.stack(every, axis=1)[:, [self.of.get(int(q), -1) + 1 for q in qids]]


def filters(plans: DataFrame, contains: list[str], any_of: list[str] | None = None) -> Filters:
    """The conditions of plans (qid and columns of chunks); null and empty ones are left out.

    Distinct conditions are few beside the questions; both are held by the driver.
    """
    of, known = {}, {}
    for r in plans.select("qid", *contains, *(any_of or [])).collect():
        condition = {c: r[c] for c in contains if r[c]} | {c: tuple(r[c]) for c in any_of or [] if r[c]}
        if condition:
            of[r.qid] = known.setdefault(tuple(sorted(condition.items())), len(known))
    return Filters(tuple(dict(k) for k in known), of)


class _Best:
    """The k best ids for each question, ties by id."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = qids, k
        self.best = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(qids)

    def add(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        i, s = np.r_[self.best[j][0], ids], np.r_[self.best[j][1], scores]
        top = np.lexsort((i, -s))[: self.k]
        self.best[j] = i[top], s[top]

    def batch(self) -> pa.RecordBatch:
        counts = [len(b[0]) for b in self.best]
        columns = [np.concatenate([np.zeros(0, dtype=t), *(b[c] for b in self.best)]) for c, t in ((0, np.int64), (1, np.float64))]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.qids, counts)), *map(pa.array, columns)], names=["qid", "id", "score"])


class _Grams:
    """Trigrams of texts as numbers; words that come again are not cut again."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.words: dict[str, list[int]] = {}

    def of(self, text: str) -> set[int]:
        out: set[int] = set()
        for w in set(WORDS.findall(text.lower())):
            grams = self.words.get(w)
            if grams is None:
                padded = f"  {w} "
                grams = [self.number.setdefault(padded[i : i + 3], len(self.number)) for i in range(len(padded) - 2)]
                if len(self.words) < KNOWN_WORDS:
                    self.words[w] = grams
            out.update(grams)
        return out


def _lexical(shared, k: int, conditions: Filters | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, machine = shared.value  # (qid, term) in order; the automaton of the terms
        qids, first = np.unique([q for q, _ in asked], return_index=True)
        of_name = defaultdict(list)
        for t, (q, term) in enumerate(asked):
            of_name[term].append(int(np.searchsorted(qids, q)))
        asking = [np.array(of_name[n]) for n in machine.names]
        cut = _Grams()
        of_term = [cut.of(term) for _, term in asked]
        kept = dict(cut.number)
        size = np.array([len(g) for g in of_term], dtype=np.float64)
        holders = defaultdict(list)
        for t, grams in enumerate(of_term):
            for g in grams:
                holders[g].append(t)
        holders = {g: np.array(t) for g, t in holders.items()}
        best = _Best(qids, k)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            hit = np.zeros((len(texts), len(qids)), dtype=bool)
            for i, name in zip(*machine.present(texts), strict=True):
                hit[i, asking[name]] = True
            sim = np.zeros(hit.shape)
            for i, text in enumerate(texts):
                grams = cut.of(text)
                there = [holders[g] for g in grams if g in holders]
                if there:
                    common = np.bincount(np.concatenate(there), minlength=len(asked))
                    sim[i] = np.maximum.reduceat(common / np.maximum(len(grams) + size - common, 1), first)
                if len(cut.number) > 8 * KNOWN_WORDS:  # forget all but the terms' grams
                    cut.number, cut.words = dict(kept), {}
            ok = hit | (sim >= FUZZY)
            if conditions:
                ok &= conditions.allowed(batch, qids)
            ids = batch.column("id").to_numpy()
            scores = np.round(hit + sim, 9)
            for j in np.flatnonzero(ok.any(0)).tolist():
                best.add(j, ids[ok[:, j]], scores[ok[:, j], j])
        yield best.batch()

    return run


def lexical(chunks: DataFrame, terms: DataFrame, k: int = 30, conditions: Filters | None = None) -> DataFrame:
    """qid, id, score, rank of the k best chunks (id, text) per question (qid, term).

    The score is 1 if any term occurs literally, plus the largest trigram similarity of a
    term to the chunk; chunks with neither a hit nor a similarity of FUZZY are left out, and
    so are those that the conditions do not allow. Terms of fewer than two characters are
    ignored. Terms go to the tasks in blocks of TERM_BLOCK characters, with an automaton for
    literal occurrences and their trigrams; each task keeps the k best of its chunks per
    question, so neither texts nor grams are shuffled. Null texts count as empty.
    """
    spark = chunks.sparkSession
    terms = terms.filter((F.char_length(F.trim("term")) >= 2) & F.col("qid").isNotNull()).select("qid", "term").distinct()
    blocks = -(-(terms.agg(F.sum(F.char_length("term"))).first()[0] or 0) // TERM_BLOCK)
    found = spark.createDataFrame([], "qid long, id long, score double")
    chunks = spread(chunks)
    more = sorted({c for x in conditions.conditions for c in x} - {"id", "text"}) if conditions else []
    for b in range(blocks):
        asked = sorted((r.qid, r.term) for r in terms.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect())
        if asked:
            shared = spark.sparkContext.broadcast((asked, Automaton(sorted({t for _, t in asked}))))
            found = found.unionByName(chunks.select(F.col("id").cast("long").alias("id"), "text", *more).mapInArrow(_lexical(shared, k, conditions), "qid long, id long, score double"))
    return ranked(found, k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best (qid, id, score) per question with their rank, ties by id."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def alike(rows: DataFrame, asked: DataFrame, k: int, least: float = FUZZY) -> DataFrame:
    """The k rows (id, g) with the most similar sets of grams for each asked id (qid), itself left out.

    Grams have three characters, and rows of one id are one set. Equal sets are one class: only
    classes are compared, and of each the k + 1 smallest ids suffice. Score, ties by id, and rank.
    """
    of_id = rows.filter("id is not null").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("g")))).alias("g"))
    sets = written(of_id.filter(F.size("g") > 0).select("id", F.array_join("g", "").alias("key"), "g"))
    wanted = asked.join(sets, asked.qid == sets.id).select("qid", "key")
    grams = sets.select("key", "g").distinct().select("key", F.size("g").alias("n"), F.explode("g").alias("gram"))
    of_asked = grams.join(wanted.select("key").distinct(), "key").select(F.col("key").alias("of"), F.col("n").alias("m"), "gram")
    shared = grams.join(of_asked, "gram").groupBy("of", "key", "n", "m").count()
    scored = shared.select("of", "key", F.round(F.col("count") / (F.col("n") + F.col("m") - F.col("count")), 9).alias("score")).filter(F.col("score") >= least)
    first = sets.select("key", "id").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("place") <= k + 1)
    best = ranked(scored.join(first, "key").select(F.col("of").alias("qid"), "id", "score"), k + 1)
    best = best.groupBy(F.col("qid").alias("key")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))
    others = wanted.join(best, "key").select("qid", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("qid")), 1, k)).alias("at", "hit"))
    return others.select("qid", "hit.id", "hit.score", (F.col("at") + 1).alias("rank"))


def _nearest(shared, k: int, conditions: Filters | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix = shared.value
        best = _Best(qids, k)
        for batch in batches:
            flat = batch.column("v")
            if not len(flat):
                continue
            values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, matrix.shape[1])
            ids = batch.column("id").to_numpy()
            norm = np.linalg.norm(values, axis=1)
            scores = np.round((values / np.where(norm > 0, norm, 1)[:, None]) @ matrix.T, 9) + 0.0
            ok = conditions.allowed(batch, qids) if conditions else None
            for j in range(len(qids)):
                some = slice(None) if ok is None else ok[:, j]
                best.add(j, ids[some], scores[some, j])
        yield best.batch()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 30, conditions: Filters | None = None) -> DataFrame:
    """qid, id, score, rank of the k vectors (id, v) most cosine-similar to each query (qid, v).

    Exact. Queries go to the tasks in blocks of QUERY_BLOCK; each task keeps the k best of
    its rows per query, so k rows per query and task are shuffled. Vectors of another length
    than the queries' are no candidates; a zero vector has the similarity 0. The conditions leave
    out rows (by further columns of vectors) before the k best are taken.
    """
    spark = vectors.sparkSession
    queries = queries.filter(F.col("v").isNotNull() & F.col("qid").isNotNull())
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    found = None
    more = sorted({c for x in conditions.conditions for c in x} - {"id", "v"}) if conditions else []
    for b in range(blocks):
        rows = sorted((r.qid, r.v) for r in queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "v").collect())
        if not rows:
            continue
        matrix = np.array([r[1] for r in rows], dtype=np.float64)
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), matrix / np.where(norm > 0, norm, 1)))
        same = vectors.filter(F.size("v") == matrix.shape[1]).select(F.col("id").cast("long").alias("id"), "v", *more)
        part = same.mapInArrow(_nearest(shared, k, conditions), "qid long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "qid long, id long, score double")
    return ranked(found, k)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            n = len(batch.column("v")[0])
            a, b = (batch.column(x).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n) for x in ("v", "asked"))
            size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
            score = np.round((a * b).sum(1) / np.where(size > 0, size, 1), 9) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("id"), pa.array(score)], names=["qid", "id", "score"])


def cosines(pairs: DataFrame) -> DataFrame:
    """qid, id, score of pairs of vectors (qid, id, v, asked) of one length."""
    return pairs.select("qid", "id", "v", "asked").mapInArrow(_cosines, "qid long, id long, score double")


def fuse(channels: list[DataFrame], limit: int = 40, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: qid, id, rrf, channels (list numbers), place.

    Sums are rounded before they are ordered; ties keep the order in which the lists, one
    after another, first name an item.
    """
    lists = None
    for i, c in enumerate(channels):
        one = c.select("qid", "id", "rank", F.lit(i).alias("channel"))
        lists = one if lists is None else lists.unionByName(one)
    sums = lists.groupBy("qid", "id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"),
        F.sort_array(F.collect_set("channel")).alias("channels"),
        F.min(F.struct("channel", "rank")).alias("seen"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("rrf"), "seen", "id")
    return sums.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("seen")


def reranked(fused: DataFrame, scores: DataFrame | None, limit: int = 8) -> DataFrame:
    """The order an outside model gave (qid, id, rank), unknown ids dropped; else the fused one.

    A question for which no known id was returned keeps its fused order.
    """
    first = fused.filter(F.col("place") <= limit)
    if scores is None:
        return first
    known = scores.select("qid", "id", "rank").join(fused.drop("place"), ["qid", "id"])
    order = Window.partitionBy("qid").orderBy("rank", "id")
    known = known.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("rank")
    return known.unionByName(first.join(known.select("qid").distinct(), "qid", "left_anti"))


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int = 1, kind: str | None = None) -> DataFrame:
    """Chunks of a hit's node, and of its kind of text, whose sequence is at most `radius` away.

    hits and chunks have node and sequence, and with kind a column of that name; the result
    has the hits' columns and neighbour. Equality on the node keeps it a hash or merge join.
    """
    near = chunks.select(F.col("node").alias("n"), F.col("sequence").alias("s"), *([F.col(kind).alias("k")] if kind else []))
    on = (F.col("node") == F.col("n")) & F.col("s").between(F.greatest(F.col("sequence") - radius, F.lit(0)), F.col("sequence") + radius)
    if kind:
        on = on & (F.col(kind) == F.col("k"))
    return hits.join(near, on).drop("n", "k").withColumnRenamed("s", "neighbour")


def rendered(title: Column, section: Column, text: Column) -> Column:
    """A source as the answer sees it, after its label: title, section if there is one, text."""
    return F.concat(F.lit("\u300a"), F.coalesce(title, F.lit("")), F.lit("\u300b"), F.when(section != "", F.concat(F.lit(" \u00b7 "), section)).otherwise(""), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def context(hits: DataFrame, chunks: DataFrame, room: int = 12_000, radius: int = 1) -> DataFrame:
    """qid, ids, size of the chunks that fit into `room` characters, each hit before its neighbours.

    hits: qid, id, place; chunks: id, node, sequence, kind, title, section, text. Neighbours
    are of the hit's node and kind. What does not fit is skipped, what comes again counts once.
    """
    of = hits.select("qid", "id", "place").join(chunks.select("id", "node", "sequence", "kind"), "id")
    around = neighbours(of, chunks, radius, "kind").filter("neighbour <> sequence").select("qid", "place", "node", "kind", F.col("neighbour").alias("sequence"))
    around = around.join(chunks.select(F.col("id").alias("item"), "node", "kind", "sequence"), ["node", "kind", "sequence"]).select("qid", "place", F.lit(1).alias("after"), "sequence", "item")
    every = of.select("qid", "place", F.lit(0).alias("after"), "sequence", F.col("id").alias("item")).unionByName(around)
    sized = every.join(chunks.select(F.col("id").alias("item"), F.char_length(rendered(F.col("title"), F.col("section"), F.col("text"))).cast("long").alias("size")), "item")
    rows = sized.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "after", "sequence", "item", "size"))), lambda x: F.struct(x["item"].alias("id"), x["size"].alias("size"))).alias("x"))
    return rows.select("qid", packed(F.col("x"), room).alias("p")).select("qid", F.col("p.ids").alias("ids"), F.col("p.size").alias("size"))


def packed(ordered: Column, room: int) -> Column:
    """Fold an ordered array of (id, size): accept what fits, skip (not stop at) what does not.

    Repeated ids count once. Returns the accepted ids and the size they take. Sizes exclude
    the label "[S<n>] ", whose width depends on how many were accepted before.
    """
    start = F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(0).cast("long").alias("size"))

    def step(acc: Column, x: Column) -> Column:
        label = F.length(F.concat(F.lit("[S"), (F.size(acc["ids"]) + 1).cast("string"), F.lit("] ")))
        whole = acc["size"] + x["size"] + label
        fits = ~F.array_contains(acc["ids"], x["id"]) & (whole <= room)
        return F.struct(F.when(fits, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"), F.when(fits, whole).otherwise(acc["size"]).cast("long").alias("size"))

    return F.aggregate(ordered, start, step)


def metrics(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Mean recall@k, reciprocal rank and nDCG@k over the questions that have relevant items.

    results: qid, id, rank; relevant: qid, id.
    """
    total = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return graded(results.join(relevant, ["qid", "id"]), total, k)


def graded(found: DataFrame, total: DataFrame, k: int = 10) -> DataFrame:
    """As metrics(), from the relevant results (qid, rank) and how many items are relevant (qid, n)."""
    found = found.filter(F.col("rank") <= k)
    per = found.groupBy("qid").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    rows = total.join(per, "qid", "left").select(
        F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg")
    )
    return rows.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("recall"), 6).alias("recall_at_k"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg_at_k"))


def ablation(channels: dict[str, DataFrame], configurations: dict[str, list[str]], relevant: DataFrame, total: DataFrame, rerank: DataFrame | None = None, reranked_: tuple[str, ...] = (), limit: int = 40, k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """configuration, questions, recall_at_k, mrr, ndcg_at_k of subsets of channels, fused.

    channels are ranked lists (qid, id, rank); a configuration names those it fuses by
    reciprocal rank, of which `limit` a question go on. Those in reranked_ are put in order of
    rerank (qid, id, score) first. relevant is (qid, id), total (qid, n) how many there are.
    Every channel is computed once: its rows are tagged with the configurations that use them.
    """
    lists = None
    for i, (name, rows) in enumerate(channels.items()):
        users = [c for c, names in configurations.items() if name in names]
        one = rows.select("qid", "id", "rank", F.lit(i).alias("channel"), F.explode(F.array(*map(F.lit, users))).alias("configuration"))
        lists = one if lists is None else lists.unionByName(one)
    sums = lists.groupBy("configuration", "qid", "id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"), F.min(F.struct("channel", "rank")).alias("seen"))
    by = Window.partitionBy("configuration", "qid")
    fused = sums.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "seen", "id"))).filter(F.col("rank") <= limit).select("configuration", "qid", "id", "rank")
    if rerank is not None and reranked_:
        told = fused.join(rerank.select("qid", "id", F.col("score").alias("told")), ["qid", "id"], "left")
        chosen = F.when(F.col("configuration").isin(*reranked_), F.col("told"))
        fused = told.withColumn("rank", F.row_number().over(by.orderBy(F.desc_nulls_last(chosen), "rank"))).drop("told")
    hits = fused.filter(F.col("rank") <= k).join(relevant.select("qid", "id"), ["qid", "id"])
    per = hits.groupBy("configuration", "qid").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    every = total.select("qid", "n", F.explode(F.array(*map(F.lit, configurations))).alias("configuration"))
    rows = every.join(per, ["configuration", "qid"], "left").select(
        "configuration", F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg")
    )
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return rows.groupBy("configuration").agg(F.count(F.lit(1)).alias("questions"), mean("recall", "recall_at_k"), mean("rr", "mrr"), mean("ndcg", "ndcg_at_k"))
