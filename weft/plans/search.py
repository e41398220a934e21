"""Queries over indexes: approximate vector search and what it finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import retrieval, vector_index
from weft.plans.corpus import _LEXICAL, _chunks, _terms
from weft.session import table
from weft.sources.scratch import written

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the 30 vectors nearest to every vector with an id divisible by 20, by the index."""
    vectors = _vectors(spark, sf_dir)
    return vector_index.search(vector_index.build(vectors), vectors, vectors.filter("id % 20 = 0").withColumnRenamed("id", "qid"))


@query()
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the exact 30 nearest vectors, the share that the index finds, and its least for a query."""
    vectors = _vectors(spark, sf_dir)
    asked = vectors.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    found = vector_index.search(vector_index.build(vectors), vectors, asked).select("qid", "id", F.lit(1).alias("hit"))
    per = retrieval.nearest(vectors, asked).join(found, ["qid", "id"], "left").groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall"), 6).alias("recall_at_30"), F.round(F.min("recall"), 6).alias("least"))


_PLANS = """
pl AS (SELECT item_id AS qid, CASE WHEN (item_id // 20) % 2 = 0 THEN ['en', 'de'] ELSE ['fr', 'es', 'en'] END AS lang, CASE WHEN (item_id // 20) % 3 = 1 THEN 'E' END AS source FROM benchmark WHERE item_id % 20 = 0)
"""


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of the questions: languages of their own, and of some a letter in the source's name."""
    turn = F.floor(F.col("item_id") / 20)
    langs = lambda *x: F.array(*map(F.lit, x))
    items = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0")
    return items.select(F.col("item_id").alias("qid"), F.when(turn % 2 == 0, langs("en", "de")).otherwise(langs("fr", "es", "en")).alias("lang"), F.when(turn % 3 == 1, "E").alias("source"))


@query(f"""
WITH {_PLANS}, {_LEXICAL.split("lx AS")[0].rstrip().rstrip(",")},
fl AS (SELECT qid, id, score, CAST(rank AS INTEGER) AS rank, 'lexical' AS channel FROM (
  SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
    SELECT qid, id, round(max(hit) + max(sim), 9) AS score, max(hit) AS hit, max(sim) AS sim FROM ca JOIN documents d ON d.doc_id = id JOIN pl USING (qid)
    WHERE list_contains(pl.lang, d.lang) AND (pl.source IS NULL OR d.source ILIKE '%' || pl.source || '%') GROUP BY qid, id) WHERE hit = 1 OR sim >= 0.3) WHERE rank <= 30),
vf AS (SELECT qid, id, score, CAST(rank AS INTEGER) AS rank, 'vector' AS channel FROM (
  SELECT a.vec_id AS qid, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN pl ON pl.qid = a.vec_id JOIN embeddings b ON true JOIN documents d ON d.doc_id = b.vec_id AND list_contains(pl.lang, d.lang) AND (pl.source IS NULL OR d.source ILIKE '%' || pl.source || '%')) WHERE rank <= 30)
SELECT * FROM fl UNION ALL SELECT * FROM vf
""")
def metadata_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels, of the documents that each question's own conditions allow."""
    allowed = retrieval.filters(_plans(spark, sf_dir), ["source"], ["lang"])
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    words = retrieval.lexical(docs, _terms(spark, sf_dir), conditions=allowed).withColumn("channel", F.lit("lexical"))
    vectors = _vectors(spark, sf_dir).join(docs.drop("text"), "id")
    asked = _vectors(spark, sf_dir).withColumnRenamed("id", "qid").join(_plans(spark, sf_dir).select("qid"), "qid", "left_semi")
    return words.unionByName(retrieval.nearest(vectors, asked, conditions=allowed).withColumn("channel", F.lit("vector")))


def _half(spark: SparkSession, sf_dir: str, first: int) -> DataFrame:
    """One half of each vector: two models' vectors of the same documents."""
    return _vectors(spark, sf_dir).select("id", F.slice("v", first, 32).alias("v"))


def _list(name: str, rows: str) -> str:
    return f"""{name}s AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ({rows})),
{name} AS (SELECT qid, id, score, rank FROM {name}s WHERE rank <= 30)"""


_COS = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 9)"
_HALF = "SELECT a.vec_id AS qid, b.vec_id AS id, " + _COS.format(a="a.embedding[{0}:{1}]", b="b.embedding[{0}:{1}]") + " AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0"


@query(f"""
WITH {_list("o", _HALF.format(1, 32))}, {_list("m", _HALF.format(33, 64))},
l AS (SELECT qid, id, rank, 0 AS channel FROM o UNION ALL SELECT qid, id, rank, 1 FROM m),
f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(channel * 1000 + rank) AS seen, count(*) AS lists FROM l GROUP BY qid, id)
SELECT qid, id, rrf, CAST(place AS INTEGER) AS place, CAST(lists AS INTEGER) AS lists FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, seen, id) AS place FROM f) WHERE place <= 40
""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of two models for every vector with an id divisible by 20, fused."""
    lists = [retrieval.nearest(v, v.filter("id % 20 = 0").withColumnRenamed("id", "qid")) for v in (_half(spark, sf_dir, 1), _half(spark, sf_dir, 33))]
    return retrieval.fuse(lists).select("qid", "id", "rrf", "place", F.size("channels").alias("lists"))


_CONFIGURATIONS = {"A": ["original"], "B": ["modern"], "C": ["original", "modern"], "D": ["lexical", "original", "modern"], "E": ["lexical", "original", "modern"], "F": ["lexical", "original", "modern", "expanded"]}


@query(f"""
WITH {_LEXICAL}, b AS (SELECT item_id AS q FROM benchmark WHERE item_id % 20 = 0),
{_list("o", _HALF.format(1, 32))}, {_list("m", _HALF.format(33, 64))}, {_list("w", "SELECT a.vec_id AS qid, b.vec_id AS id, " + _COS.format(a="a.embedding", b="b.embedding") + " AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0")},
n AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM ws WHERE qid <> id) WHERE r = 1),
x AS (SELECT n.qid, list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE + c.embedding[i]) AS e FROM n JOIN embeddings a ON a.vec_id = n.qid JOIN embeddings c ON c.vec_id = n.id),
{_list("e", "SELECT x.qid, b.vec_id AS id, " + _COS.format(a="x.e", b="b.embedding") + " AS score FROM x JOIN embeddings b ON true")},
l AS (SELECT qid, id, rank, 0 AS channel, unnest(['D', 'E', 'F']) AS configuration FROM lx UNION ALL SELECT qid, id, rank, 1, unnest(['A', 'C', 'D', 'E', 'F']) FROM o
  UNION ALL SELECT qid, id, rank, 2, unnest(['B', 'C', 'D', 'E', 'F']) FROM m UNION ALL SELECT qid, id, rank, 3, 'F' FROM e),
f AS (SELECT configuration, qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(channel * 1000 + rank) AS seen FROM l WHERE qid IN (SELECT q FROM b) GROUP BY ALL),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY configuration, qid ORDER BY rrf DESC, seen, id) AS rank FROM f) WHERE rank <= 40),
h AS (SELECT configuration, g.qid, g.id, row_number() OVER (PARTITION BY configuration, g.qid ORDER BY CASE WHEN configuration IN ('E', 'F') THEN ws.score END DESC NULLS LAST, g.rank) AS rank FROM g LEFT JOIN ws ON ws.qid = g.qid AND ws.id = g.id),
r AS (SELECT a.vec_id AS qid, c.vec_id AS id FROM embeddings a JOIN embeddings c ON a.label = c.label AND a.vec_id IN (SELECT q FROM b)),
tt AS (SELECT qid, count(*) AS n FROM r GROUP BY qid),
p AS (SELECT configuration, h.qid, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM h JOIN r ON r.qid = h.qid AND r.id = h.id WHERE rank <= 10 GROUP BY ALL),
i AS (SELECT configuration, tt.qid, n, list_sum(list_transform(range(1, least(n, 10) + 1), lambda y: 1 / log2(y + 1.0))) AS ideal FROM tt, (SELECT unnest(['A', 'B', 'C', 'D', 'E', 'F']) AS configuration))
SELECT configuration, count(*) AS questions, round(avg(coalesce(hits / n::DOUBLE, 0)), 6) AS recall_at_k, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg_at_k FROM i LEFT JOIN p USING (configuration, qid) GROUP BY configuration
""")
def ablation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six systems over the benchmark's questions: halves of the vectors as two models, whole ones as reranker.

    The last one also searches for the question's vector plus that of its nearest neighbour.
    Items of the question's label are relevant.
    """
    whole = _vectors(spark, sf_dir)
    qids = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("qid"))
    ask = lambda v: v.withColumnRenamed("id", "qid").join(qids, "qid", "left_semi")
    original, modern = (retrieval.nearest(v, ask(v)) for v in (_half(spark, sf_dir, 1), _half(spark, sf_dir, 33)))
    mate = retrieval.nearest(whole, ask(whole), 2).filter("qid <> id").groupBy("qid").agg(F.min_by("id", "rank").alias("id"))
    wider = mate.join(whole, "id").join(ask(whole).withColumnRenamed("v", "own"), "qid").select("qid", F.zip_with("own", "v", lambda a, b: a.cast("double") + b).alias("v"))
    channels = {"lexical": retrieval.lexical(_chunks(spark, sf_dir), _terms(spark, sf_dir)), "original": original, "modern": modern, "expanded": retrieval.nearest(whole, wider)}
    named = written_lists(channels)
    seen = None
    for rows in named.values():
        seen = rows.select("qid", "id") if seen is None else seen.unionByName(rows.select("qid", "id"))
    pairs = seen.distinct().join(whole, "id").join(ask(whole).withColumnRenamed("v", "asked"), "qid")
    told = retrieval.cosines(pairs)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = labels.withColumnRenamed("id", "qid").join(qids, "qid", "left_semi").withColumnRenamed("label", "wanted")
    total = asked.join(labels.groupBy(F.col("label").alias("wanted")).agg(F.count(F.lit(1)).alias("n")), "wanted").select("qid", "n")
    relevant = seen.distinct().join(labels, "id").join(asked, "qid").filter("label = wanted").select("qid", "id")
    return retrieval.ablation(named, _CONFIGURATIONS, relevant, total, told, ("E", "F"))


def written_lists(channels: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The channels' lists, each computed once and kept."""
    return {name: written(rows.select("qid", "id", "rank")) for name, rows in channels.items()}
