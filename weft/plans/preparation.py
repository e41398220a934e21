"""Queries that prepare a fine-tuning mixture, check replies and report on answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import entities, preparation, structure
from weft.session import table

QUERIES: dict = {}
ORACLE: dict = {}

_SPACE = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WORDS = "len(regexp_extract_all(coalesce({}, ''), '[^ \\t\\n\\r\\f\\v]+'))"
_DRAW = "('0x' || substr(sha256('42:' || {}), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _clean(c: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace(replace(coalesce({c}, ''), chr(0), ''), '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


@query(f"SELECT doc_id, {_WORDS.format('text')}::INTEGER AS tokens FROM documents WHERE {_WORDS.format('text')} <= 1000")
def token_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of at most 1000 words."""
    rows = table(spark, sf_dir, "documents").select("doc_id", preparation.word_count(F.col("text")).alias("tokens"))
    return preparation.within_tokens(rows, F.col("tokens"))


@query(f"""
WITH n AS (SELECT doc_id AS id, lang, concat_ws(chr(10) || chr(10), nullif({_clean("source")}, ''), nullif({_clean("lang")}, '')) AS question,
                  {_strip("regexp_replace(" + _clean("text") + r", '(?is)<think>.*?</think>\s*', '', 'g')")} AS answer FROM documents),
m AS (SELECT *, sha256(question || chr(10) || answer) AS sample FROM n WHERE question <> '' AND answer <> ''),
d AS (SELECT *, CASE lang WHEN 'de' THEN 'first' WHEN 'fr' THEN 'second' ELSE 'third' END AS origin, CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS place
      FROM m WHERE lang IN ('de', 'fr') OR lang = 'es' AND {_DRAW.format("sample")} < 0.1963),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY place, id) AS r FROM d) WHERE r = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY id) AS r FROM m WHERE lang = 'en' AND {_WORDS.format("question || chr(10) || answer")} <= 1000),
other AS (SELECT *, row_number() OVER (ORDER BY sha256('42:' || sample), id) AS nth FROM g WHERE r = 1 AND sample NOT IN (SELECT sample FROM own)),
u AS (SELECT origin, id, question, answer, sample FROM own
      UNION ALL SELECT 'general', id, question, answer, sample FROM other WHERE nth <= (SELECT ceil(count(*) / 9.0::DOUBLE) FROM own))
SELECT origin, id, sha256(question) AS question_sha256, sha256(answer) AS answer_sha256,
       CASE WHEN p < 0.1 THEN 'test' WHEN p < 0.2 THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, {_DRAW.format("sample")} AS p FROM u)
""")
def sft_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sets of documents by language, one of them sampled, and a tenth of English ones, split."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("instruction"), F.col("lang").alias("input"), F.col("text").alias("output"))
    of = lambda lang: docs.filter(F.col("input") == lang)
    out = preparation.mixture([("first", of("de"), 1.0), ("second", of("fr"), 1.0), ("third", of("es"), 0.1963)], of("en"), test=0.1, validation=0.1)
    return out.select("origin", "id", F.sha2("question", 256).alias("question_sha256"), F.sha2("answer", 256).alias("answer_sha256"), "split")


@query("""
WITH n AS (SELECT doc_id, greatest(ceil((length(coalesce(text, '')) - 80) / 520.0), 1)::INTEGER AS n FROM documents),
c AS (SELECT doc_id, CAST(i AS INTEGER) AS sequence FROM n, unnest(range(0, n)) AS r(i))
SELECT c.doc_id, c.sequence, d.lang, d.source, l.quality, len(e.embedding)::INTEGER AS dimension
FROM c JOIN documents d USING (doc_id) JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = c.doc_id
""")
def retrieval_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their document, its label and its vector; Catalyst orders the joins."""
    docs = table(spark, sf_dir, "documents")
    chunks = structure.chunks(docs.select("doc_id", F.lit(0).alias("node"), F.coalesce("text", F.lit("")).alias("content"))).select("doc_id", "sequence")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dimension"))
    return chunks.join(docs.select("doc_id", "lang", "source"), "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").join(vectors, "doc_id")


@query("""
SELECT conv_id, count(*) AS requested, count(*) FILTER (role <> 'system' AND length(text) >= 40) AS returned,
       list(turn ORDER BY turn) = coalesce(list(turn ORDER BY turn) FILTER (role <> 'system' AND length(text) >= 40), []) AS accepted FROM conversations GROUP BY conv_id
""")
def batch_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as batches of turns, of which those of 40 characters or more come back."""
    turns = table(spark, sf_dir, "conversations")
    units = turns.select("conv_id", "turn", F.col("turn").alias("unit"))
    back = turns.filter((F.col("role") != "system") & (F.char_length("text") >= 40)).select("conv_id", "turn", F.col("turn").alias("unit"))
    return preparation.contract(units, back, "conv_id", "unit", "turn")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_discount = 0 THEN 'NO_DATA' WHEN l_tax = 0 THEN 'STRUCTURE_ERROR' WHEN l_linestatus <> 'O' THEN 'TRANSLATION_ERROR'
  WHEN l_partkey % 7 = 0 THEN 'METADATA_ERROR' WHEN l_quantity > 40 THEN 'RETRIEVAL_MISS' WHEN l_linenumber > 5 THEN 'RERANK_ERROR' WHEN l_suppkey % 2 = 0 THEN 'CONTEXT_ERROR' ELSE 'GENERATION_ERROR' END AS error FROM lineitem
""")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What went wrong with each line, its quantity and number standing for ranks."""
    c = F.col
    label = preparation.error_label(c("l_discount") != 0, c("l_tax") != 0, c("l_linestatus") == "O", c("l_partkey") % 7 != 0, c("l_quantity"), c("l_linenumber"), c("l_suppkey") % 2 != 0, c("l_returnflag") == "A", 40, 5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("error"))


_SAFETY = {
    "red_flag_recall": ("toxic = 1", "length(text) < 1500"),
    "unsafe_advice_rate": ("quality = 1", "toxic = 1"),
    "unsupported_diagnosis_rate": ("quality = 0", "contains(text, '?')"),
    "formula_safety_recall": ("contains(text, '@')", "quality = 0"),
    "interaction_recall": ("contains(text, 'http')", "quality = 0"),
    "citation_accuracy": ("contains(text, '.')", "quality = 1"),
    "abstention_accuracy": ("length(text) < 200", "quality = 0"),
    "escalation_accuracy": ("toxic = 2", "quality = 0"),
}


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) AS n, round(avg(CASE WHEN {b} THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM documents JOIN labels USING (doc_id) WHERE {a}" for m, (a, b) in _SAFETY.items()))
def safety_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight recalls and rates in one pass; labels and marks in texts stand for what judges say."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    return preparation.safety(rows, {m: (F.expr(a), F.expr(b)) for m, (a, b) in _SAFETY.items()})


@query("""
WITH p AS (SELECT p_type, avg(p_retailprice) AS price, avg(CASE WHEN p_size > 45 THEN p_size::DOUBLE END) AS large FROM part GROUP BY p_type)
SELECT -1 AS line_no, '| p_type | price | large |' AS line UNION ALL SELECT 0, '|---|---:|---:|'
UNION ALL SELECT row_number() OVER (ORDER BY p_type)::INTEGER, '| ' || p_type || ' | ' || printf('%.4f', round(price, 4)) || ' | ' || coalesce(printf('%.4f', round(large, 4)), 'N/A') || ' |' FROM p
""")
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown table of means per type of part."""
    rows = table(spark, sf_dir, "part").groupBy("p_type").agg(F.round(F.avg("p_retailprice"), 4).alias("price"), F.round(F.avg(F.when(F.col("p_size") > 45, F.col("p_size").cast("double"))), 4).alias("large"))
    return preparation.metric_lines(rows, "p_type", ["price", "large"])


_NAMES = r"e AS (SELECT name, 'type ' || (length(name) % 8) AS type FROM (SELECT DISTINCT unnest(regexp_split_to_array(coalesce(text, ''), '[^\pL\pN]+')) AS name FROM benchmark) WHERE length(name) >= 6)"


@query(f"""
WITH {_NAMES}, p AS (SELECT string_agg(name, '|' ORDER BY length(name) DESC, name) AS p FROM e),
t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), p) AS n, string_split_regex(coalesce(text, ''), p) AS s FROM documents, p),
m AS (SELECT r, doc_id, n[i] AS name, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(n[1:i - 1], lambda x: length(x))), 0) + 1 AS start FROM t, unnest(range(1, len(n) + 1)) AS u(i))
SELECT doc_id, name, type, min(start)::BIGINT AS first, count(*) AS times FROM m JOIN e USING (name) GROUP BY doc_id, name, type
""")
def dictionary_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in all documents, and where: the benchmark's words of six letters or more, in eight types."""
    w = F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+")
    names = table(spark, sf_dir, "benchmark").select(F.explode(w).alias("name")).filter(F.char_length("name") >= 6).distinct()
    names = names.withColumn("type", F.concat(F.lit("type "), F.char_length("name") % 8))
    return entities.entities(table(spark, sf_dir, "documents").select("doc_id", "text"), names)
