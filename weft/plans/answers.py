"""Queries on the way from retrieved documents to answers, and the report on pairs of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import dialogue, evaluation, preparation, retrieval, rules
from weft.operators.records import numbered
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


@query(f"""
WITH RECURSIVE {_LEXICAL},
ch AS (SELECT doc_id AS id, coalesce(source, '') AS node, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS sequence, lang AS kind,
  length('《Document ' || doc_id || '》' || CASE WHEN lang <> '' THEN ' · ' || lang ELSE '' END || chr(10) || coalesce(text, '') || chr(10)) AS size FROM documents),
ho AS (SELECT qid, lx.id, rank AS place, node, sequence, kind, size FROM lx JOIN ch USING (id)),
ev AS (SELECT qid, place, 0 AS after, sequence, id, size FROM ho UNION ALL SELECT h.qid, h.place, 1, c.sequence, c.id, c.size FROM ho h JOIN ch c ON c.node = h.node AND c.kind = h.kind AND abs(c.sequence - h.sequence) = 1),
od AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, after, sequence) AS i FROM ev),
pk AS (SELECT DISTINCT qid, 0::BIGINT AS i, []::BIGINT[] AS ids, 0::BIGINT AS size FROM od
  UNION ALL SELECT qid, i, CASE WHEN fits THEN list_append(ids, id) ELSE ids END, CASE WHEN fits THEN whole ELSE size END FROM (
    SELECT p.qid, o.i, p.ids, p.size, o.id, p.size + o.size + length('[S' || (len(p.ids) + 1) || '] ') AS whole,
      NOT list_contains(p.ids, o.id) AND p.size + o.size + length('[S' || (len(p.ids) + 1) || '] ') <= 12000 AS fits FROM pk p JOIN od o ON o.qid = p.qid AND o.i = p.i + 1))
SELECT qid, array_to_string(arg_max(ids, i), ',') AS ids, arg_max(size, i) AS size FROM pk GROUP BY qid
""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents found for each question, and those next to them in their source and language, in 12000 characters."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("node"), F.col("lang").alias("kind"), "text")
    chunks = numbered(docs.drop("text"), "node", "id").withColumnRenamed("number", "sequence").join(docs.select("id", "text"), "id")
    chunks = chunks.withColumns({"title": F.concat(F.lit("Document "), F.col("id").cast("string")), "section": F.col("kind")})
    hits = written(retrieval.lexical(_chunks(spark, sf_dir), _terms(spark, sf_dir))).withColumnRenamed("rank", "place")
    return retrieval.context(hits, chunks).select("qid", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "size")


@query(f"""
WITH {_LEXICAL}, b AS (SELECT item_id AS qid, text AS question FROM benchmark WHERE item_id % 20 = 0),
va AS (SELECT qid, list(id ORDER BY rank) AS valid FROM lx WHERE rank <= 8 GROUP BY qid),
s0 AS (SELECT b.qid, question, coalesce(valid, []) AS valid FROM b LEFT JOIN va USING (qid)),
a0 AS (SELECT *, length(question) % 3 > 0 AS asks, valid[2:2] || [-1] || valid[2:5] AS proposed FROM s0),
c0 AS (SELECT *, valid[2:4] AS chosen FROM a0),
e0 AS (SELECT qid, string_agg(substr(coalesce(text, ''), 1, 700), '|' ORDER BY nth) AS x, sum(length(substr(coalesce(text, ''), 1, 700))) AS chars
  FROM (SELECT qid, unnest(chosen) AS id, unnest(range(1, len(chosen) + 1)) AS nth FROM c0 WHERE asks) JOIN documents ON doc_id = id GROUP BY qid)
SELECT c0.qid, CASE WHEN asks AND len(chosen) > 0 THEN CASE WHEN chars >= 900 THEN 'read ' || chars ELSE '当前证据不足以给出可靠回答，请补充问题或核对资料后再咨询。' END ELSE 'from context' END AS answer,
  CASE WHEN asks AND len(chosen) > 0 THEN 1 ELSE 0 END AS rounds, CASE WHEN asks THEN array_to_string(chosen, ',') ELSE '' END AS read, sha256(coalesce(x, '')) AS excerpts_sha256,
  CASE WHEN asks AND len(chosen) = 0 THEN 'nothing to read' WHEN asks AND chars < 900 THEN 'no rounds left' ELSE 'answer' END AS stop
FROM c0 LEFT JOIN e0 USING (qid)
""")
def answer_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's questions through one round of reading; lengths stand for a model's decisions."""
    questions = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    hits = retrieval.lexical(_chunks(spark, sf_dir), _terms(spark, sf_dir)).filter("rank <= 8").select("qid", "id", F.col("rank").alias("place"))
    originals = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("start"), F.lit(100).alias("end"))

    def decide(open_: DataFrame) -> DataFrame:
        chars = F.aggregate("excerpts", F.lit(0), lambda a, x: a + F.char_length(x))
        first = F.col("round") == 0
        asks = F.when(first, F.char_length("question") % 3 > 0).otherwise(chars < 900)
        proposed = F.concat(F.slice("valid", 2, 1), F.array(F.lit(-1).cast("long")), F.slice("valid", 2, 4))
        answer = F.when(first, "from context").when(asks, "").otherwise(F.concat(F.lit("read "), chars.cast("string")))
        return open_.select("qid", F.when(asks, "read_originals").otherwise("answer").alias("action"), proposed.alias("proposed"), answer.alias("answer"))

    out = dialogue.read_originals(questions, written(hits), originals, decide)
    return out.select("qid", "answer", "rounds", F.array_join(F.transform("read", lambda x: x.cast("string")), ",").alias("read"), F.sha2(F.array_join("excerpts", "|"), 256).alias("excerpts_sha256"), "stop")


@query("""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE 'plan ' || turn END AS search_query, CASE WHEN turn % 2 = 0 THEN text ELSE 'meaning ' || turn END AS semantic_query,
  CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END AS n_keywords FROM conversations WHERE role = 'user' OR turn % 2 = 1
""")
def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries of turns: those of a plan where there is one (odd turns), else the turn itself."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user' or turn % 2 = 1").withColumn("qid", F.struct("conv_id", "turn"))
    plans = turns.filter("turn % 2 = 1").select("qid", F.concat(F.lit("plan "), F.col("turn").cast("string")).alias("search_query"), F.concat(F.lit("meaning "), F.col("turn").cast("string")).alias("semantic_query"), F.array(F.lit("word")).alias("keywords"))
    out = dialogue.planned(turns.select("qid", F.col("text").alias("question")), plans)
    return out.select("qid.conv_id", "qid.turn", "search_query", "semantic_query", F.size("keywords").alias("n_keywords"))


@query("""
SELECT doc_id, '你描述的情况包含需要优先处理的信号（' || CASE WHEN f = '' THEN '可能需要紧急评估的症状' ELSE f END || '）。'
  || CASE WHEN toxic = 1 THEN '请立即联系当地急救服务或尽快前往急诊' ELSE '请尽快（最好当天）联系医疗机构进行评估；如症状加重，请直接前往急诊' END
  || '，不要等待中医辨证或自行用药。如果身边有人，请让对方陪同并准备好当前用药和过敏信息。' AS message
FROM (SELECT doc_id, toxic, concat_ws('、', CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 AND toxic = 1 THEN 'poor' END) AS f FROM labels WHERE toxic = 1 OR quality = 0)
""")
def urgent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message of each flagged document, its labels standing for the reasons."""
    rows = table(spark, sf_dir, "labels").filter("toxic = 1 or quality = 0")
    flags = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "poor")))
    level = F.when(F.col("toxic") == 1, "emergency").otherwise("urgent")
    return rows.select("doc_id", rules.urgent_message(level, flags).alias("message"))


_METRICS = {"price": "l_extendedprice", "quantity": "l_quantity", "discount": "l_discount"}


@query("""
WITH p AS (SELECT a.l_orderkey AS id, unnest(['price', 'quantity', 'discount']) AS metric, unnest([a.l_extendedprice::DOUBLE, a.l_quantity::DOUBLE, a.l_discount::DOUBLE]) AS base, unnest([b.l_extendedprice::DOUBLE, b.l_quantity::DOUBLE, b.l_discount::DOUBLE]) AS other
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2),
h AS (SELECT id, k, sha256('42:' || k || ':' || id) AS h FROM (SELECT DISTINCT id FROM p), unnest(range(0, 125)) AS u(k)),
c AS (SELECT list_transform([1, 2, 2.5, 2.6666666666666665, 2.7083333333333335, 2.716666666666667, 2.7180555555555554], lambda x: x::DOUBLE / 2.718281828459045::DOUBLE) AS c),
d AS (SELECT id, k * 8 + j AS b, ('0x' || substr(h, 8 * j + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM h, unnest(range(0, 8)) AS w(j)),
t AS (SELECT id, b, (u >= c[1])::INT + (u >= c[2])::INT + (u >= c[3])::INT + (u >= c[4])::INT + (u >= c[5])::INT + (u >= c[6])::INT + (u >= c[7])::INT AS k FROM d, c),
m AS (SELECT metric, b, round(sum(k * (other - base)) / sum(k), 9) AS m FROM t JOIN p USING (id) GROUP BY metric, b), o AS (SELECT metric, list_sort(list(m)) AS m FROM m GROUP BY metric)
SELECT metric, count(*) AS n, round(avg(base), 4) AS base_mean, round(avg(other), 4) AS other_mean, round(avg(other - base), 4) AS difference, round(any_value(o.m[25]), 4) AS low, round(any_value(o.m[975]), 4) AS high,
  round(median(base), 4) AS base_median, round(median(other), 4) AS other_median FROM p JOIN o USING (metric) GROUP BY metric
""")
def paired_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, medians and the interval of the difference of three measures, first against second lines of orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_METRICS.values())
    measures = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("v")) for m, c in _METRICS.items()])
    of = lambda n, name: lines.filter(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("id"), F.explode(measures).alias("x")).select("id", "x.metric", F.col("x.v").alias(name))
    pairs = written(of(1, "base").join(of(2, "other"), ["id", "metric"]))
    return evaluation.paired_report(pairs, list(_METRICS))


@query(r"""
WITH c AS (SELECT conv_id, string_agg('[S' || (turn + 1) || ']', ' ' ORDER BY turn) FILTER (length(text) % 2 = 0) AS answer, count(*) FILTER (role = 'user') AS sources FROM conversations GROUP BY conv_id),
n AS (SELECT conv_id, sources, list_distinct(regexp_extract_all(coalesce(answer, ''), '\[S(\d+)\]', 1)) AS n FROM c),
v AS (SELECT *, len(list_filter(n, lambda x: x::INT BETWEEN 1 AND sources)) AS valid FROM n)
SELECT conv_id, CAST(len(n) AS INTEGER) AS cited, CAST(valid AS INTEGER) AS valid, round(valid / nullif(sources, 0)::DOUBLE, 6) AS coverage, round(valid / nullif(len(n), 0)::DOUBLE, 6) AS correctness FROM v
""")
def citation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and correctness of citations: turns of even length are cited, the user's turns are the sources."""
    turns = table(spark, sf_dir, "conversations").withColumn("mark", F.when(F.char_length("text") % 2 == 0, F.concat(F.lit("[S"), (F.col("turn") + 1).cast("string"), F.lit("]"))))
    marks = F.array_sort(F.collect_list(F.when(F.col("mark").isNotNull(), F.struct("turn", "mark"))))
    per = turns.groupBy("conv_id").agg(F.array_join(F.transform(marks, lambda x: x["mark"]), " ").alias("answer"), F.count_if(F.col("role") == "user").cast("int").alias("sources"))
    return per.select("conv_id", rules.citations(F.col("answer"), F.col("sources")).alias("c")).select("conv_id", "c.*")


@query("""
WITH c AS (SELECT conv_id, CASE WHEN min(length(text)) >= 120 THEN 1 WHEN min(length(text)) >= 60 THEN 2 WHEN min(length(text)) >= 30 THEN 3 END AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, CAST(t AS INTEGER) AS try, CASE WHEN t IS NULL THEN 'failed' ELSE 'completed' END AS status FROM conversations JOIN c USING (conv_id)
""")
def batch_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as batches; each try returns turns of half the length that the one before asked for."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("unit"), F.char_length("text").alias("size"))
    back = lambda open_, n: open_.filter(F.col("size") >= 240 // 2**n)
    return preparation.retried(turns, back, "conv_id", "unit", "turn").select("conv_id", "turn", "try", "status")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso FROM events")
def events_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps of events as ISO strings."""
    return table(spark, sf_dir, "events").select("event_id", text.utc_iso(F.col("ts")).alias("iso"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.9g', x::DOUBLE)), ',') || ']' AS literal FROM embeddings")
def vector_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as text."""
    return table(spark, sf_dir, "embeddings").select("vec_id", text.vector_literal(F.col("embedding")).alias("literal"))


@query("""
WITH n AS (SELECT p_type, 'run-' || p_size || '.' || p_partkey AS name FROM part)
SELECT p_type, arg_max(name, list_transform(regexp_extract_all(name, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END)) AS newest FROM n GROUP BY p_type
""")
def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the names of each type, the one with the largest numbers."""
    name = F.concat(F.lit("run-"), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_type", name.alias("name"))
    return rows.groupBy("p_type").agg(F.max_by("name", text.version_key(F.col("name"))).alias("newest"))
