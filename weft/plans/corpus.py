"""Queries over the documents: audit, duplicates, structure, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.text import canonical, trigrams, words
from weft.operators import audit, preparation, records, retrieval, rules, store, structure
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


@query(r"""
SELECT doc_id, upper(substr(sha256(coalesce(text, '')), 1, 16)) AS document_id, sha256(coalesce(text, '')) AS text_sha256,
       CAST(strlen(coalesce(text, '')) AS BIGINT) AS byte_count, CAST(length(coalesce(text, '')) AS BIGINT) AS character_count,
       CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS line_count,
       round(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) = '')) / len(string_split(coalesce(text, ''), chr(10))), 5) AS empty_line_ratio,
       CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(65533), '')) AS BIGINT) AS replacement_char_count,
       regexp_matches(coalesce(text, ''), '[□' || chr(65533) || ']{3,}') OR CASE WHEN regexp_matches(coalesce(text, ''), '[\x{4E00}-\x{9FFF}]{9}') THEN len(list_filter(range(1, length(text) - 7),
         lambda i: unicode(substr(text, i, 1)) BETWEEN 19968 AND 40959 AND substr(text, i, 9) = repeat(substr(text, i, 1), 9))) > 0 ELSE false END AS suspected_ocr
FROM documents
""")
def audit_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity and quality of every document."""
    return audit.profile(table(spark, sf_dir, "documents"))


@query("""
SELECT lang, count(*) AS documents, count(DISTINCT sha256(coalesce(text, ''))) AS distinct_texts, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS characters,
       count(*) FILTER (length(coalesce(text, '')) < 200) AS short, count(*) FILTER (contains(coalesce(text, ''), chr(10))) AS with_lines, count(*) FILTER (source IS NULL) AS without_source
FROM documents GROUP BY lang
""")
def audit_report_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the audit, per language."""
    return audit.report(table(spark, sf_dir, "documents"))


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def audit_rollup_lang_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""
SELECT doc_id, upper(substr(h, 1, 16)) AS duplicate_group, CASE WHEN doc_id <> first THEN first END AS duplicate_of, copies
FROM (SELECT doc_id, h, min(doc_id) OVER (PARTITION BY h) AS first, count(*) OVER (PARTITION BY h) AS copies
      FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)) WHERE copies > 1
""")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of documents that share their text."""
    return audit.duplicates(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("h"))
    return audit.keep_first(docs, F.col("h"), ["doc_id"]).drop("h")


_CANON = r"regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\pP]', '', 'g')"


@query(f"""
WITH b AS (SELECT DISTINCT {_CANON} AS c FROM benchmark)
SELECT doc_id, source FROM documents WHERE {_CANON} NOT IN (SELECT c FROM b)
""")
def overlap_with_benchmark_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose canonical text is not that of a benchmark item."""
    docs = table(spark, sf_dir, "documents").withColumn("c", canonical(F.col("text")))
    items = table(spark, sf_dir, "benchmark").select(canonical(F.col("text")).alias("c")).distinct()
    return docs.join(items, "c", "left_anti").select("doc_id", "source")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def overlap_with_benchmark_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark item.

    The second and third word of an item of four or more stand between blanks, so that any
    document that holds it has them as neighbouring words: an equi-join key before the
    literal test. Shorter items are found by their first characters.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"), F.split("text", " ").alias("w"))
    long = items.filter(F.size("w") > 3).withColumn("key", F.array_join(F.slice("w", 2, 2), " "))
    w = F.split("text", " ")
    pairs = F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    keyed = docs.select("doc_id", F.explode(F.array_distinct(pairs)).alias("key")).join(long.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    found = keyed.join(docs, "doc_id").join(long.select("item_id", "item"), "item_id")
    found = found.filter(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    return found.unionByName(preparation.containing(docs, items.filter(F.size("w") <= 3)))


#: The lines of all documents, as their breaks divide them.
_LINES = r"""
p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}])|[^\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]+') AS p FROM documents),
l AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, regexp_replace(CASE WHEN len(p) > 0 THEN p[i] ELSE '' END, '[\r\n]+$', '') AS raw FROM p, unnest(range(1, greatest(len(p), 1) + 1)) AS r(i))
"""


@query(r"""
WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}])|[^\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]+') AS p FROM documents),
q AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE [''] END AS p FROM p),
u AS (SELECT doc_id, i, p[i] AS raw FROM q, unnest(range(1, len(p) + 1)) AS r(i)),
s AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, regexp_replace(raw, '[\r\n]+$', '') AS raw,
             coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM u)
SELECT doc_id, line_no, start, CAST(start + length(raw) AS BIGINT) AS "end", raw FROM s
""")
def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents with their character spans."""
    return structure.lines(table(spark, sf_dir, "documents")).withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))


def _latin(docs: DataFrame) -> DataFrame:
    """Lines classed by forms that Latin texts have: one word, up to 40 and up to 60 characters."""
    rows = structure.lines(docs).withColumn("text", F.trim("raw"))
    n = F.char_length("text")
    rank = F.when(n == 0, None).when(~F.contains("text", F.lit(" ")), 1).when(n <= 40, 2).when(n <= 60, 3)
    rows = rows.withColumn("rank", rank.cast("int"))
    kind = F.when(n == 0, "break").when(F.col("rank").isNotNull(), "heading").otherwise("text")
    return rows.select("doc_id", "line_no", "start", "end", "text", kind.alias("kind"), F.when(F.col("rank").isNotNull(), F.col("text")).alias("title"), "rank")


@query(r"""
WITH u AS (SELECT doc_id, i, trim(p[i]) AS t FROM (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [''] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS p FROM documents), unnest(range(1, len(p) + 1)) AS r(i)),
v AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, trim(replace(t, chr(10), '')) AS t FROM u)
SELECT doc_id, line_no, CASE WHEN t = '' THEN 'break' WHEN NOT contains(t, ' ') OR length(t) <= 60 THEN 'heading' ELSE 'text' END AS kind,
       CAST(CASE WHEN t = '' THEN NULL WHEN NOT contains(t, ' ') THEN 1 WHEN length(t) <= 40 THEN 2 WHEN length(t) <= 60 THEN 3 END AS INTEGER) AS rank FROM v
""")
def heading_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of lines of all documents, by Latin forms."""
    return _latin(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "kind", "rank")


#: Trees by their definition: a parent is the latest heading of a smaller rank, a subtree ends before the next heading of its rank or a smaller one.
_TREE = r"""
p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}])|[^\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]+') AS p FROM documents),
l0 AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, CASE WHEN len(p) > 0 THEN p[i] ELSE '' END AS whole, regexp_replace(CASE WHEN len(p) > 0 THEN p[i] ELSE '' END, '[\r\n]+$', '') AS raw FROM p, unnest(range(1, greatest(len(p), 1) + 1)) AS r(i)),
l1 AS (SELECT *, coalesce(sum(length(whole)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, trim(raw) AS t FROM l0),
li AS (SELECT doc_id, line_no, start, (start + length(raw))::BIGINT AS stop, t, CASE WHEN t = '' THEN NULL WHEN NOT contains(t, ' ') THEN 1 WHEN length(t) <= 40 THEN 2 WHEN length(t) <= 60 THEN 3 END AS rank FROM l1),
v0 AS (SELECT *, last_value(CASE WHEN rank = 1 THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS vol FROM li),
v1 AS (SELECT *, coalesce(rank = 1 AND t = vol, false) AS again FROM v0),
v2 AS (SELECT *, last_value(CASE WHEN rank = 1 AND NOT again THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vline,
  sum(CASE WHEN t <> '' AND rank IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM v1),
hd AS (SELECT *, CASE WHEN again THEN vline ELSE line_no END AS node FROM v2 WHERE rank IS NOT NULL),
hp AS (SELECT h.doc_id, h.line_no, arg_max(o.node, o.line_no) AS parent FROM hd h JOIN hd o ON o.doc_id = h.doc_id AND o.line_no < h.line_no AND o.rank < h.rank GROUP BY ALL),
mg AS (SELECT hd.doc_id, node, arg_min(t, hd.line_no) AS content, min(rank) AS rank, (list(parent ORDER BY hd.line_no))[1] AS parent, min(start) AS start, max(stop) AS stop FROM hd LEFT JOIN hp ON hp.doc_id = hd.doc_id AND hp.line_no = hd.line_no GROUP BY hd.doc_id, node),
pr AS (SELECT doc_id, min(line_no) AS node, string_agg(t, '' ORDER BY line_no) AS content, min(start) AS start, max(stop) AS stop FROM v2 WHERE rank IS NULL AND t <> '' GROUP BY doc_id, run),
pp AS (SELECT p.doc_id, p.node, arg_max(o.node, o.line_no) AS parent FROM pr p JOIN hd o ON o.doc_id = p.doc_id AND o.line_no < p.node GROUP BY ALL),
mk AS (SELECT doc_id, node, rank, stop FROM mg UNION ALL SELECT doc_id, node, NULL, stop FROM pr),
en AS (SELECT g.doc_id, g.node, (SELECT min(x.node) FROM mk x WHERE x.doc_id = g.doc_id AND x.node > g.node AND x.rank <= g.rank) AS halt FROM mg g),
ee AS (SELECT en.doc_id, en.node, max(mk.stop) AS stop FROM en JOIN mk ON mk.doc_id = en.doc_id AND mk.node >= en.node AND (en.halt IS NULL OR mk.node < en.halt) GROUP BY ALL),
nd AS (SELECT mg.doc_id, mg.node, CASE rank WHEN 1 THEN 'volume' WHEN 2 THEN 'chapter' ELSE 'section' END AS type, content, parent, start, greatest(mg.stop, ee.stop) AS stop FROM mg JOIN ee ON ee.doc_id = mg.doc_id AND ee.node = mg.node
  UNION ALL SELECT pr.doc_id, pr.node, 'paragraph', content, parent, start, stop FROM pr LEFT JOIN pp ON pp.doc_id = pr.doc_id AND pp.node = pr.node)
"""


@query(f'WITH {_TREE} SELECT doc_id, node, type, content, parent, start, stop AS "end", CAST(row_number() OVER (PARTITION BY doc_id, type ORDER BY node) AS INTEGER) AS number FROM nd')
def doc_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of every document: headings, paragraphs, parents, spans, numbers."""
    return structure.tree(_latin(table(spark, sf_dir, "documents")))


@query(f"""
WITH {_TREE}, b AS (SELECT doc_id, string_agg(CASE type WHEN 'volume' THEN '## ' WHEN 'chapter' THEN '### ' WHEN 'section' THEN '#### ' ELSE '' END || content, chr(10) || chr(10) ORDER BY node) AS body FROM nd GROUP BY doc_id)
SELECT doc_id, '# Document ' || doc_id || coalesce(chr(10) || chr(10) || body, '') || chr(10) AS markdown FROM documents LEFT JOIN b USING (doc_id)
""")
def doc_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tree as Markdown."""
    docs = table(spark, sf_dir, "documents")
    return structure.markdown(structure.tree(_latin(docs)), docs.select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title")))


@query(rf"""
WITH {_LINES},
c AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(nfc_normalize(raw), '\r\n', ' '), '\n', ' '), '\t', ' '), '\x', ''), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text FROM l),
n AS (SELECT *, coalesce(lag(text) OVER w, '') = '' OR coalesce(lead(text) OVER w, '') = '' AS beside FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no, text FROM n WHERE beside AND length(text) BETWEEN 2 AND 50 AND NOT regexp_matches(text, '[。！？；：，、]$')
""")
def heading_review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that may be headings by the source system's own forms."""
    return structure.review_candidates(structure.classify_lines(table(spark, sf_dir, "documents")))


@query(rf"""
WITH RECURSIVE {_LINES},
b AS (SELECT doc_id, line_no, 1 AS batch, length(raw) AS size FROM l WHERE line_no = 1
  UNION ALL SELECT l.doc_id, l.line_no, CASE WHEN b.size > 0 AND b.size + length(raw) > 2000 THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.size > 0 AND b.size + length(raw) > 2000 THEN length(raw) ELSE b.size + length(raw) END FROM b JOIN l ON l.doc_id = b.doc_id AND l.line_no = b.line_no + 1)
SELECT doc_id, line_no, CAST(batch AS INTEGER) AS batch FROM b
""")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document, empty ones too, in batches of at most 2000 characters."""
    rows = structure.lines(table(spark, sf_dir, "documents"))
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.char_length("raw").cast("long").alias("size")))).alias("x"))
    out = per.withColumn("b", structure.batches(F.transform("x", lambda v: v["size"]), 2000))
    return out.select("doc_id", F.explode(F.arrays_zip(F.col("x.line_no").alias("line_no"), F.col("b").alias("batch"))).alias("z")).select("doc_id", "z.line_no", "z.batch")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def translation_units_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a completed record; good labels stand for those."""
    done = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"))
    return store.pending(table(spark, sf_dir, "documents").select("doc_id", "lang"), done, ["doc_id"])


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: benchmark items with an id divisible by 20; terms: their words of two letters or more, and they as a whole."""
    items = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0")
    return items.select(F.col("item_id").alias("qid"), F.explode(F.array_append(words(F.col("text")), F.col("text"))).alias("term")).filter(F.char_length(F.trim("term")) >= 2).distinct()


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


_LEXICAL = r"""
q AS (SELECT item_id AS qid, unnest(regexp_split_to_array(lower(text), '[^\pL\pN]+')) AS term FROM benchmark WHERE item_id % 20 = 0 UNION SELECT item_id, text FROM benchmark WHERE item_id % 20 = 0),
t AS (SELECT DISTINCT qid, term FROM q WHERE length(trim(term)) >= 2),
dw AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+')) AS w FROM documents),
dg AS (SELECT DISTINCT id, substr('  ' || w || ' ', i, 3) AS g FROM dw, unnest(range(1, length(w) + 2)) AS r(i) WHERE w <> ''),
tw AS (SELECT DISTINCT qid, term, unnest(regexp_split_to_array(lower(term), '[^\pL\pN]+')) AS w FROM t),
tg AS (SELECT DISTINCT qid, term, substr('  ' || w || ' ', i, 3) AS g FROM tw, unnest(range(1, length(w) + 2)) AS r(i) WHERE w <> ''),
dn AS (SELECT id, count(*) AS n FROM dg GROUP BY id),
tn AS (SELECT qid, term, count(*) AS m FROM tg GROUP BY qid, term),
sh AS (SELECT qid, term, id, count(*) AS c FROM dg JOIN tg USING (g) GROUP BY qid, term, id),
ca AS (SELECT qid, id, c / (n + m - c)::DOUBLE AS sim, 0 AS hit FROM sh JOIN dn USING (id) JOIN tn USING (qid, term)
  UNION ALL SELECT qid, doc_id, 0, 1 FROM documents JOIN t ON contains(text, term)),
lx AS (SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
  FROM (SELECT qid, id, round(max(hit) + max(sim), 9) AS score, max(hit) AS hit, max(sim) AS sim FROM ca GROUP BY qid, id) WHERE hit = 1 OR sim >= 0.3) WHERE rank <= 30)
"""
_VECTOR = """
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
vs AS (SELECT a.id AS qid, b.id AS id, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.id % 20 = 0),
vt AS (SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vs) WHERE rank <= 30)
"""


@query(f"WITH {_LEXICAL} SELECT * FROM lx")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 documents that match each question's terms best."""
    return retrieval.lexical(_chunks(spark, sf_dir), _terms(spark, sf_dir))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.nearest(vectors, vectors.filter("id % 20 = 0").withColumnRenamed("id", "qid"))


@query(f"WITH {_VECTOR} SELECT * FROM vt")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 vectors nearest to every vector with an id divisible by 20."""
    return _nearest(spark, sf_dir)


@query("""
WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.id AS qid, b.id AS id, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.id % 20 = 0 AND b.label % 2 = 0)
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 30
""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among the vectors of even labels, filtered before the search."""
    all_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return retrieval.nearest(all_.filter("label % 2 = 0"), all_.filter("id % 20 = 0").select(F.col("id").alias("qid"), "v"))


@query(f"""
WITH {_LEXICAL}, {_VECTOR},
l AS (SELECT qid, id, rank, 0 AS channel FROM lx UNION ALL SELECT qid, id, rank, 1 FROM vt WHERE qid IN (SELECT item_id FROM benchmark)),
f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, count(DISTINCT channel) AS n_channels, min(channel * 1000 + rank) AS seen FROM l GROUP BY qid, id)
SELECT qid, id, rrf, CAST(n_channels AS INTEGER) AS n_channels, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, seen, id) AS place FROM f) WHERE place <= 40
""")
def rag_hybrid_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector lists of each question, fused by reciprocal rank."""
    terms = _terms(spark, sf_dir)
    near = _nearest(spark, sf_dir).join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")), "qid", "left_semi")
    fused = retrieval.fuse([retrieval.lexical(_chunks(spark, sf_dir), terms), near])
    return fused.select("qid", "id", "rrf", F.size("channels").alias("n_channels"), "place")


@query("""
SELECT a.conv_id, a.turn, b.turn AS neighbour FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.role = a.role AND b.turn BETWEEN greatest(a.turn - 2, 0) AND a.turn + 2 WHERE a.role = 'user'
""")
def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the same role around every user turn, conversations as nodes."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("node"), F.col("turn").alias("sequence"), "role")
    out = retrieval.neighbours(turns.filter("role = 'user'"), turns, 2, "role")
    return out.select(F.col("node").alias("conv_id"), F.col("sequence").alias("turn"), "neighbour")


@query("""
WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.id AS qid, a.label AS ql, b.id AS id, b.label, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s),
n AS (SELECT a.id AS qid, count(*) AS n FROM v a JOIN v b ON a.id % 20 = 0 AND a.label = b.label GROUP BY a.id),
f AS (SELECT qid, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM t WHERE rank <= 10 AND label = ql GROUP BY qid),
i AS (SELECT qid, n, list_sum(list_transform(range(1, least(n, 10) + 1), lambda x: 1 / log2(x + 1.0))) AS ideal FROM n)
SELECT count(*) AS questions, round(avg(coalesce(hits / n::DOUBLE, 0)), 6) AS recall_at_k, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg_at_k FROM i LEFT JOIN f USING (qid)
""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the vector search: items of the question's label are relevant."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = labels.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("label").alias("wanted"))
    total = asked.join(labels.groupBy(F.col("label").alias("wanted")).agg(F.count(F.lit(1)).alias("n")), "wanted")
    found = _nearest(spark, sf_dir).join(labels, "id").join(asked, "qid").filter(F.col("label") == F.col("wanted"))
    return retrieval.graded(found.select("qid", "rank"), total.select("qid", "n"))


@query(r"SELECT conv_id, turn, CAST(len(list_distinct(regexp_extract_all(text, '\[S(\d+)\]', 1))) AS BIGINT) AS n_cited FROM conversations")
def source_cards_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that each turn cites."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(rules.cited(F.col("text"))).cast("long").alias("n_cited"))


@query(r"""
WITH w AS (SELECT p_partkey AS id, unnest(regexp_split_to_array(lower(p_name), '[^\pL\pN]+')) AS w FROM part),
g AS (SELECT DISTINCT id, substr('  ' || w || ' ', i, 3) AS g FROM w, unnest(range(1, length(w) + 2)) AS r(i) WHERE w <> ''),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
s AS (SELECT a.id AS qid, b.id AS id, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id % 20 = 0 AND a.id <> b.id GROUP BY a.id, b.id),
r AS (SELECT qid, s.id, round(c / (x.n + y.n - c)::DOUBLE, 9) AS score FROM s JOIN n x ON x.id = qid JOIN n y ON y.id = s.id)
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM r WHERE score >= 0.3) WHERE rank <= 10
""")
def trigram_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part names most similar to those of every part with a key divisible by 20."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), trigrams(F.col("p_name")).alias("g"))
    return retrieval.alike(parts, parts.filter("id % 20 = 0").select(F.col("id").alias("qid")).distinct(), 10)


@query("""
SELECT name, rows FROM (
  SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'embeddings', count(*) FROM embeddings
  UNION ALL SELECT 'labelled_documents', count(DISTINCT d.doc_id) FROM documents d JOIN labels l USING (doc_id))
""")
def store_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the store, documents with a label among them."""
    t = {n: table(spark, sf_dir, n) for n in ("documents", "labels", "embeddings")}
    return store.inspect(t | {"labelled_documents": t["documents"].join(t["labels"], "doc_id").select("doc_id").distinct()})


@query("""
SELECT source, count(l.doc_id) AS labels, count(*) FILTER (l.toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source
""")
def store_labels_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels per source, sources without any included."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("quality").alias("labels"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("""
SELECT 'price_positive' AS rule, count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) AS violations FROM orders
UNION ALL SELECT 'status_known', count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O', 'P'), false)) FROM orders
UNION ALL SELECT 'repeated_keys', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'orphans', count(*) FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL)
""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks, uniqueness and references of orders and their lines."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    out = store.violations(orders, {"price_positive": F.col("o_totalprice") > 0, "status_known": F.col("o_orderstatus").isin("F", "O", "P")})
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
    return out.unionByName(one("repeated_keys", store.repeated_keys(orders, ["o_orderkey"]))).unionByName(one("orphans", store.orphans(items, orders, "l_orderkey", "o_orderkey")))


@query("""
WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) SELECT count(DISTINCT h) AS first_import, 0::BIGINT AS second_import FROM a
""")
def idempotent_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts added by importing all documents, and by importing them again."""
    new = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    stored = store.absent(new, new.limit(0), ["h"])
    again = store.absent(new, stored, ["h"])
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return count(stored, "first_import").crossJoin(count(again, "second_import"))  # one row each


@query("""
SELECT c_custkey, greatest(c_acctbal, 0) AS kept, o.n AS orders_n, row_number() OVER (PARTITION BY c_nationkey ORDER BY o.total DESC, c_custkey) AS nation_rank
FROM customer JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
""")
def ranked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders, ranked by value within their nation."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders_n"), records.exact_sum(F.col("o_totalprice")).alias("total"))
    rows = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"))
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("total"), "c_custkey"))
    return rows.select("c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("kept"), "orders_n", rank.cast("long").alias("nation_rank"))
