"""Queries over records of any table: validation, lookups, counters, links, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import records, structure
from weft.plans.corpus import _latin
from weft.session import table

QUERIES: dict = {}
ORACLE: dict = {}
LANGS = ["de", "en", "es", "fr"]


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two languages."""
    return records.of_kinds(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["de", "fr"])


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_type ILIKE '%st%' AND p_brand ILIKE '%brand%' AND p_size IN (1, 5, 10, 15)")
def metadata_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by two texts in any case and a list of sizes; an absent filter does nothing."""
    found = records.matching(table(spark, sf_dir, "part"), {"p_type": "ST", "p_brand": "brand", "p_name": None}, {"p_size": [1, 5, 10, 15]})
    return found.select("p_partkey", "p_name", "p_type")


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id IS NULL THEN 'id' END, CASE WHEN NOT coalesce(trim(text) <> '', false) THEN 'text' END,
  CASE WHEN NOT coalesce(lang IN ('de', 'en', 'es', 'fr'), false) THEN 'lang' END, CASE WHEN NOT coalesce(n_chars = length(text) AND n_chars <= 5000, false) THEN 'length' END], lambda x: x IS NOT NULL), ',') AS problems
FROM documents WHERE NOT coalesce(doc_id IS NOT NULL AND trim(text) <> '' AND lang IN ('de', 'en', 'es', 'fr') AND n_chars = length(text) AND n_chars <= 5000, false)
""")
def validation_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that break a rule, with the rules they break."""
    rules = {"id": F.col("doc_id").isNotNull(), "text": F.trim("text") != "", "lang": F.col("lang").isin(LANGS), "length": (F.col("n_chars") == F.char_length("text")) & (F.col("n_chars") <= 5000)}
    return records.quarantined(table(spark, sf_dir, "documents"), rules)[1].select("doc_id", F.array_join("problems", ",").alias("problems"))


@query("SELECT c_custkey, c_nationkey AS nationkey, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the name of their nation, which must exist."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("nation"))
    return records.looked_up(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey")), nations, "nationkey")


@query("""
SELECT count(*) AS raw, count(*) FILTER (trim(text) <> '') AS filled, count(*) FILTER (trim(text) <> '' AND length(text) BETWEEN 12 AND 2000) AS of_length,
       count(*) FILTER (trim(text) <> '' AND length(text) BETWEEN 12 AND 2000 AND lang = 'en') AS english FROM documents
""")
def stage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents pass each of three stages."""
    stages = {"filled": F.trim("text") != "", "of_length": F.char_length("text").between(12, 2000), "english": F.col("lang") == "en"}
    return records.funnel(table(spark, sf_dir, "documents"), stages)


@query("""
SELECT l_returnflag, round(sum(l_quantity) / greatest(sum(l_discount), 1e-9), 4) AS overall,
       round(avg(CASE WHEN l_discount > 0 THEN l_quantity / greatest(l_discount, 1e-9) END), 4) AS mean_of_rows, round(avg(l_tax), 6) AS mean_first
FROM lineitem GROUP BY l_returnflag
""")
def overall_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per flag: of the sums and as mean of rows; quantities stand for tokens, discounts for seconds."""
    per_row = F.when(F.col("l_discount") > 0, records.throughput(F.col("l_quantity"), F.col("l_discount")))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(records.throughput(F.sum("l_quantity"), F.sum("l_discount")), 4).alias("overall"), F.round(F.avg(per_row), 4).alias("mean_of_rows"), F.round(F.avg("l_tax"), 6).alias("mean_first")
    )


@query("""
SELECT lang, round(avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END), 6) AS exact_match, round(avg(CASE WHEN n_chars >= 2000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS truncated
FROM documents JOIN labels USING (doc_id) GROUP BY lang
""")
def match_and_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of equal answers (the two labels) and of texts at the limit, per language."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return rows.groupBy("lang").agg(share(F.col("quality") == F.col("toxic")).alias("exact_match"), share(F.col("n_chars") >= 2000).alias("truncated"))


@query("""
SELECT event_type, event_id, value, CAST(place AS INTEGER) AS place, report FROM (
  SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value NULLS LAST, ts, event_id) AS place, 'best' AS report FROM events) WHERE place <= 1
UNION ALL SELECT event_type, event_id, value, CAST(place AS INTEGER) AS place, report FROM (
  SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place, 'last' AS report FROM events) WHERE place <= 10
""")
def best_and_last_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest value and the last ten records of each type."""
    return records.best_and_last(table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value"), "event_type", "value", ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def newest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user."""
    return records.newest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50")
def first_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty documents, a limit that is the operator."""
    return records.first_units(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], 50)


@query("""
WITH n AS (SELECT doc_id, greatest(ceil((length(coalesce(text, '')) - 80) / 520.0), 1)::INTEGER AS n FROM documents),
c AS (SELECT doc_id, CAST(i AS INTEGER) AS sequence, doc_id::VARCHAR AS parent_id, doc_id::VARCHAR || '_C' || lpad((i + 1)::VARCHAR, 5, '0') AS chunk_id FROM n, unnest(range(0, n)) AS r(i))
SELECT *, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY sequence)
""")
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents with their own id, their document's and their neighbours'."""
    nodes = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("node"), F.coalesce("text", F.lit("")).alias("content"))
    return records.linked(structure.chunks(nodes).select("doc_id", "sequence"))


@query(r"""
WITH u AS (SELECT doc_id, i, trim(replace(trim(p[i]), chr(10), '')) AS t FROM (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [''] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS p FROM documents), unnest(range(1, len(p) + 1)) AS r(i)),
v AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, CASE WHEN t = '' THEN NULL WHEN NOT contains(t, ' ') THEN 1 WHEN length(t) <= 40 THEN 2 WHEN length(t) <= 60 THEN 3 END AS rank FROM u),
a AS (SELECT x.doc_id, x.line_no, h.line_no AS up, h.rank AS up_rank FROM v x JOIN v h ON x.doc_id = h.doc_id AND h.line_no < x.line_no AND h.rank < coalesce(x.rank, 4)),
k AS (SELECT a.doc_id, a.line_no, a.up FROM a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.doc_id = a.doc_id AND b.line_no > a.up AND b.line_no < a.line_no AND b.rank <= a.up_rank))
SELECT v.doc_id, v.line_no, coalesce(string_agg(up::VARCHAR, '/' ORDER BY up), '') AS path FROM v LEFT JOIN k USING (doc_id, line_no) GROUP BY v.doc_id, v.line_no
""")
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings that each line of all documents lies under, outermost first."""
    return records.paths(_latin(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "rank")).select("doc_id", "line_no", F.array_join("path", "/").alias("path"))


@query("SELECT vec_id, len(embedding)::INTEGER AS dimension, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS squared FROM embeddings")
def dimension_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared lengths of all vectors; one that is not of 64 dimensions would be an error."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", records.of_dimension(F.col("embedding"), 64).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return v.select("vec_id", F.size("v").alias("dimension"), F.round(total, 6).alias("squared"))


@query("""
SELECT c_custkey AS key, c_name AS name, (c_custkey % 20000000) * 100 + 1 AS sequence FROM customer
UNION ALL SELECT p_partkey, p_name, (coalesce(nullif(regexp_extract(p_name, '([0-9]+)$', 1), '')::HUGEINT, ('0x' || substr(sha256(p_name), 1, 12))::BIGINT) % 20000000)::BIGINT * 100 + 2 FROM part
""")
def sibling_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of customers (by the number in their name) and of parts (mostly by digest)."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit(1).alias("rank"))
    names = names.unionByName(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.lit(2).alias("rank")))
    return names.select("key", "name", records.sibling_sequence(F.col("name"), F.col("rank")).alias("sequence"))
