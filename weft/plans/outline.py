"""Queries over the structure of documents: paths of headings, bounded chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import structure
from weft.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: Lines of all documents; one of up to twelve words is a heading whose rank is their number.
_HEADS = r"""
p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}])|[^\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]+') AS p FROM documents),
l AS (SELECT doc_id, i AS node, trim(regexp_replace(p[i], '[\r\n]+$', '')) AS title FROM p, unnest(range(1, len(p) + 1)) AS r(i)),
w AS (SELECT *, len(regexp_extract_all(title, '[^ ]+')) AS words FROM l),
h AS (SELECT doc_id, node, title, CASE WHEN words <= 12 THEN words END AS rank, CASE WHEN words <= 12 THEN 'heading ' || words ELSE 'text' END AS type FROM w WHERE words > 0)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("line_no").cast("long").alias("node"), F.trim("raw").alias("title"))
    words = F.regexp_count("title", F.lit("[^ ]+"))
    rows = rows.withColumn("words", words).filter("words > 0")
    kind = F.when(F.col("words") <= 12, F.concat(F.lit("heading "), F.col("words").cast("string"))).otherwise("text")
    return rows.select("doc_id", "node", F.when(F.col("words") <= 12, F.col("words")).alias("rank"), kind.alias("type"), "title")


@query(f"""
WITH RECURSIVE {_HEADS},
u AS (SELECT a.doc_id, a.node, a.type, a.title, max(b.node) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.node < a.node AND b.rank < coalesce(a.rank, 99) GROUP BY ALL),
t AS (SELECT doc_id, node, 0 AS depth, '' AS path FROM u WHERE parent IS NULL
  UNION ALL SELECT u.doc_id, u.node, t.depth + 1, t.path || '/' || u.parent || ':' || o.type || ':' || o.title FROM u JOIN t ON t.doc_id = u.doc_id AND t.node = u.parent JOIN u o ON o.doc_id = u.doc_id AND o.node = u.parent)
SELECT doc_id, node, CAST(depth AS INTEGER) AS depth, path FROM t
""")
def ancestor_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings above each line of all documents, twelve ranks deep at most."""
    rows = structure.ancestors(_lines(spark, sf_dir))
    step = F.transform("path", lambda x: F.concat(F.lit("/"), x["node"].cast("string"), F.lit(":"), x["type"], F.lit(":"), x["title"]))
    return rows.select("doc_id", "node", F.size("path").alias("depth"), F.array_join(step, "").alias("path"))


_BOUNDED = r"""
p AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^.!?\n\x{3002}\x{FF01}\x{FF1F}]*[.!?\n\x{3002}\x{FF01}\x{FF1F}]+') AS p FROM documents),
d AS (SELECT doc_id, text, length(text) AS n, list_transform(range(1, len(p) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))) AS ends FROM p),
e AS (SELECT doc_id, text, n, -1 AS sequence, 0::BIGINT AS start, 80::BIGINT AS stop, ends FROM d
  UNION ALL SELECT doc_id, text, n, sequence + 1, stop - 80, CASE WHEN n - (stop - 80) <= 600 OR (n - (stop - 80) <= 1200 AND n - c < 200) THEN n ELSE c END, ends FROM (
    SELECT *, coalesce(list_max(list_filter(ends, lambda x: x BETWEEN stop + 120 AND stop + 520)), list_min(list_filter(ends, lambda x: x > stop + 520 AND x <= stop + 1120)), least(stop + 1120, n)) AS c FROM e WHERE sequence < 0 OR stop < n))
"""


@query(f"WITH RECURSIVE {_BOUNDED} SELECT doc_id, CAST(sequence AS INTEGER) AS sequence, start, substr(text, start + 1, stop - start) AS text FROM e WHERE sequence >= 0")
def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 200 to 1200 characters of all documents, each document one node."""
    nodes = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("node"), F.col("text").alias("content"))
    return structure.bounded_chunks(nodes).drop("node")


@query("""
WITH RECURSIVE v AS (SELECT coalesce(source, '') AS grp, doc_id AS id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents JOIN embeddings ON vec_id = doc_id),
s AS (SELECT grp, i, id, true AS kept, NULL::BIGINT AS compared_with, NULL::DOUBLE AS score, id AS last, e FROM v WHERE i = 1
  UNION ALL SELECT grp, i, id, score < 0.2, last, score, CASE WHEN score < 0.2 THEN id ELSE last END, CASE WHEN score < 0.2 THEN mine ELSE e END
  FROM (SELECT v.grp, v.i, v.id, s.last, s.e, v.e AS mine, round(list_cosine_similarity(v.e, s.e), 9) AS score FROM s JOIN v ON v.grp = s.grp AND v.i = s.i + 1))
SELECT grp, id, kept, compared_with, score FROM s
""")
def semantic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source in order of id, without those whose vector is like that of the last one kept."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("grp"), F.col("doc_id").alias("id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return structure.neighbour_dedup(docs.join(vectors, "id"), ["id"], 0.2)
