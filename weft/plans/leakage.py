"""Queries that keep held-out items apart from training splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import leakage, samples
from weft.plans.corpus import _CANON
from weft.session import table

QUERIES: dict = {}
ORACLE: dict = {}
_DRAW = "('0x' || substr(sha256('42:' || {}), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: Near copies: pairs that share head or tail, bounded by their common six-grams, then the longest
#: common subsequence of what lies between their common ends, row by row.
_STAGES = f"""
r AS (SELECT doc_id AS row, text, {_DRAW.format("text || chr(10) || text")} AS p, {_CANON} AS canon FROM documents),
v AS (SELECT *, coalesce(length(text) > 0, false) AS valid FROM r),
k AS (SELECT * FROM v WHERE valid AND p >= 0.1963 AND length(text) BETWEEN 12 AND 2000 AND length(text) >= 15 AND canon <> ''),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY row) AS n FROM k) WHERE n = 1),
p AS (SELECT *, sha256('42:' || canon) AS digest FROM d ORDER BY digest, canon LIMIT 1000),
s AS (SELECT canon FROM r WHERE p < 0.1963 UNION ALL SELECT {_CANON} FROM benchmark),
c AS (SELECT DISTINCT p.canon AS a, s.canon AS b FROM p JOIN s ON length(p.canon) >= 45 AND length(s.canon) >= 45 AND abs(length(p.canon) - length(s.canon)) <= 0.1 * greatest(length(p.canon), length(s.canon))
  AND (left(p.canon, 18) = left(s.canon, 18) OR right(p.canon, 18) = right(s.canon, 18))),
ga AS (SELECT a AS t, substr(a, i, 6) AS g, count(*) AS n FROM (SELECT DISTINCT a FROM c), unnest(range(1, length(a) - 4)) AS r(i) GROUP BY ALL),
gb AS (SELECT b AS t, substr(b, i, 6) AS g, count(*) AS n FROM (SELECT DISTINCT b FROM c), unnest(range(1, length(b) - 4)) AS r(i) GROUP BY ALL),
o AS (SELECT a, b FROM c JOIN ga ON ga.t = a JOIN gb ON gb.t = b AND gb.g = ga.g GROUP BY a, b HAVING sum(least(ga.n, gb.n)) >= ((length(a) + length(b)) * (1 - 11 * 0.07) - 10) / 2 - 1e-6),
f AS (SELECT a, b, coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(length(a), length(b))) AS f FROM o),
h AS (SELECT *, reverse(substr(a, f + 1)) AS x, reverse(substr(b, f + 1)) AS y FROM f),
e AS (SELECT *, coalesce(list_min(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: x[i] <> y[i])) - 1, least(length(x), length(y))) AS e FROM h),
m AS (SELECT a, b, f + e AS ends, substr(x, e + 1) AS x, substr(y, e + 1) AS y FROM e),
l AS (SELECT a, b, ends + coalesce(list_max(list_reduce(range(1, length(y) + 1), lambda prev, j: list_reduce(range(1, length(x) + 1), lambda acc, i:
    list_append(acc, CASE WHEN x[i] = y[j] THEN CASE WHEN i > 1 THEN prev[i - 1] ELSE 0 END + 1 ELSE greatest(prev[i], coalesce(acc[-1], 0)) END), []::BIGINT[]),
    list_transform(range(1, length(x) + 1), lambda i: 0::BIGINT))), 0) AS lcs FROM m),
near AS (SELECT DISTINCT a AS canon FROM l WHERE 2.0::DOUBLE * lcs / (length(a) + length(b)) >= 0.93::DOUBLE),
same AS (SELECT DISTINCT canon FROM p WHERE canon IN (SELECT canon FROM s)),
el AS (SELECT * FROM p WHERE canon NOT IN (SELECT canon FROM same) AND canon NOT IN (SELECT canon FROM near))
"""


def _heldout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), F.col("text").alias("question"), F.col("text").alias("answer"))
    trained = samples.sampled(rows, F.concat_ws("\n", "question", "answer"), 0.1963).select("question")
    return leakage.heldout(rows, trained.unionByName(table(spark, sf_dir, "benchmark").select(F.col("text").alias("question"))), limit=100)


@query(f"WITH {_STAGES} SELECT sha256(canon) AS id, text AS question, text AS reference, row AS original_row FROM el ORDER BY digest, canon LIMIT 100")
def heldout_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 held-out items (documents) that no benchmark item and no sampled document asks, nor nearly."""
    return _heldout(spark, sf_dir)[0]


@query(f"""
WITH {_STAGES}
SELECT (SELECT count(*) FROM v) AS raw, (SELECT count(*) FROM v WHERE valid) AS valid, (SELECT count(*) FROM v WHERE valid AND p >= 0.1963) AS sampled_out,
  (SELECT count(*) FROM v WHERE valid AND p >= 0.1963 AND length(text) BETWEEN 12 AND 2000) AS question_length_kept,
  (SELECT count(*) FROM v WHERE valid AND p >= 0.1963 AND length(text) BETWEEN 12 AND 2000 AND length(text) >= 15) AS reference_length_kept,
  (SELECT count(*) FROM p) AS candidate_pool, (SELECT count(*) FROM s) AS split_rows_scanned, (SELECT count(*) FROM same) AS exact_question_overlap,
  (SELECT count(*) FROM near WHERE canon NOT IN (SELECT canon FROM same)) AS near_text_overlap, (SELECT count(*) FROM el) AS eligible,
  (SELECT count(*) FROM k) - (SELECT count(*) FROM d) AS candidate_question_duplicates, least((SELECT count(*) FROM el), 100) AS written
""")
def heldout_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage of the held-out builder leaves."""
    return _heldout(spark, sf_dir)[1]


@query()
def near_copy_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which documents are near copies, and documents of each other (LCS ratio 0.93 or more)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("id"), "text")
    near, members = leakage.near_pairs(items.unionByName(docs))
    same = members.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("ratio")).distinct()
    every = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio")).unionByName(same)
    one, two = (members.select(F.col("node").alias(n), F.col("id").alias(i)) for n, i in (("a", "id"), ("b", "other_id")))
    return every.join(one, "a").join(two, "b").filter("id >= 0 and id <> other_id").select("id", "other_id", F.round("ratio", 6).alias("ratio"))
