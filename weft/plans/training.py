"""Queries over samples, labels and conversations, and general relational ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.hashing import blake2b_udf
from weft.functions.similarity import bigram_f1, lcs_ratio_udf
from weft.functions.text import clean_text
from weft.operators import audit, evaluation, rules, samples
from weft.plans.corpus import _CANON
from weft.session import table
from weft.streaming import ingest

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


_DRAW = "('0x' || substr(sha256('42:' || {}), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id FROM documents WHERE {_DRAW.format('text')} < 0.1")
def hash_sample_10pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by text."""
    return samples.sampled(_docs(spark, sf_dir), F.col("text"), 0.1).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE NOT coalesce({_DRAW.format('text')} < 0.1, false)")
def hash_sample_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the sample leaves out."""
    return samples.sampled(_docs(spark, sf_dir), F.col("text"), 0.1, keep=False).select("doc_id")


@query("SELECT h AS text_sha256, n FROM (SELECT sha256(text) AS h, min(sha256('42:' || text)) AS d, count(*) AS n FROM documents GROUP BY 1 ORDER BY d LIMIT 150)")
def exact_n_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 distinct texts by smallest digest; sampling an exact number is the operator."""
    per = _docs(spark, sf_dir).filter("text is not null").groupBy(F.sha2("text", 256).alias("text_sha256"), F.sha2(F.concat(F.lit("42:"), "text"), 256).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return per.orderBy("d").limit(150).drop("d")


@query(f"""
SELECT doc_id, CASE WHEN p < 0.1 THEN 'test' WHEN p < 0.3 THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, {_DRAW.format('text')} AS p FROM documents)
""")
def split_train_val_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every document, by its text."""
    return _docs(spark, sf_dir).select("doc_id", samples.split_of(F.col("text"), 0.1, 0.2).alias("split"))


@query("""
WITH c AS (SELECT count(*) FILTER (lang = 'en') AS d, count(*) FILTER (lang <> 'en') AS g FROM documents),
r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY sha256('42:' || doc_id::VARCHAR)) AS n FROM documents WHERE lang <> 'en')
SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang FROM r, c WHERE n <= least(ceil(c.d * 0.1::DOUBLE / (1 - 0.1::DOUBLE)), c.g)
""")
def mixture_10pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All English documents, and others by digest until they make up a tenth."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang")
    size = docs.agg(F.count_if(F.col("lang") == "en").alias("d"), F.count_if(F.col("lang") != "en").alias("g")).select(samples.mixture_target(F.col("d"), F.col("g")).alias("n")).first().n
    digest = F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 256)
    return docs.filter("lang = 'en'").unionByName(samples.smallest(docs.filter("lang <> 'en'"), digest, int(size), "doc_id"))


@query("""
SELECT conv_id, count(*) AS turns, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id
""")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages in order."""
    m = samples.conversation_messages(table(spark, sf_dir, "conversations"))
    line = F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"]))
    return m.select("conv_id", F.size("messages").cast("long").alias("turns"), F.array_join(line, "\n").alias("transcript"))


@query("SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS prompt FROM conversations GROUP BY conv_id")
def chat_first_user_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing the user says in each conversation."""
    m = samples.conversation_messages(table(spark, sf_dir, "conversations"))
    return m.select("conv_id", samples.first_user(F.col("messages")).alias("prompt"))


@query("""
SELECT conv_id, bool_and(coalesce(trim(role) <> '', false) AND coalesce(trim(text) <> '', false)) AS valid, count(*) FILTER (role = 'assistant') AS assistant_turns FROM conversations GROUP BY conv_id
""")
def chat_role_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each conversation is well formed, and its turns that get an empty think block."""
    m = samples.conversation_messages(table(spark, sf_dir, "conversations"))
    rewritten = samples.with_empty_think(F.col("messages"))
    marked = F.size(F.filter(rewritten, lambda x: F.startswith(x["content"], F.lit(samples.EMPTY_THINK))))
    return m.select("conv_id", samples.valid(F.col("messages")).alias("valid"), marked.cast("long").alias("assistant_turns"))


@query("""
WITH n AS (SELECT len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+')) AS t FROM documents),
b AS (SELECT CASE WHEN t <= 128 THEN 0 WHEN t <= 256 THEN 1 WHEN t <= 512 THEN 2 WHEN t <= 1024 THEN 3 WHEN t <= 2048 THEN 4 ELSE 5 END AS bucket, t FROM n),
l AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS bucket, unnest(['<=128', '<=256', '<=512', '<=1024', '<=2048', '>2048']) AS label)
SELECT l.bucket, label, count(t) AS rows, round(100 * count(t) / (SELECT count(*) FROM n)::DOUBLE, 4) AS percent, CAST(max(t) AS INTEGER) AS largest FROM l LEFT JOIN b USING (bucket) GROUP BY l.bucket, label
""")
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their number of words, empty buckets included."""
    return samples.token_histogram(_docs(spark, sf_dir), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+")))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 200 AND 2000")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter(F.char_length("text").between(200, 2000)).select("doc_id", "n_chars")


@query(r"""
SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(html, ''), chr(0), ''), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS cleaned_sha256 FROM pages
""")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with line ends and blank runs cleaned."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(clean_text(F.col("html")), 256).alias("cleaned_sha256"))


@query(f"""
WITH b AS (SELECT DISTINCT {_CANON} AS c FROM benchmark), d AS (SELECT doc_id, lang, {_CANON} AS c FROM documents)
SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id) AS n FROM d WHERE lang <> 'en' AND c NOT IN (SELECT c FROM d WHERE lang = 'en')) WHERE n = 1
""")
def overlap_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other documents that share no canonical text with an English one, each text once."""
    from weft.functions.text import canonical

    docs = _docs(spark, sf_dir).select("doc_id", "lang", canonical(F.col("text")).alias("c"))
    return samples.without_overlap(docs.filter("lang <> 'en'"), docs.filter("lang = 'en'"), F.col("c"), ["doc_id"]).select("doc_id")


@query()
def blake2b_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLAKE2b keys of all documents, for stores that were keyed so."""
    return _docs(spark, sf_dir).select("doc_id", blake2b_udf(16)(F.trim(F.coalesce("text", F.lit("")))).alias("digest"))


@query(r"""
WITH p AS (SELECT a.conv_id, a.turn, regexp_replace(coalesce(a.text, ''), '\s+', '', 'g') AS x, regexp_replace(coalesce(b.text, ''), '\s+', '', 'g') AS y
           FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
gx AS (SELECT conv_id, turn, substr(x, i, 2) AS g, count(*) AS n FROM p, unnest(range(1, length(x))) AS r(i) GROUP BY ALL),
gy AS (SELECT conv_id, turn, substr(y, i, 2) AS g, count(*) AS n FROM p, unnest(range(1, length(y))) AS r(i) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(least(gx.n, gy.n)) AS c FROM gx JOIN gy USING (conv_id, turn, g) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN length(x) < 2 OR length(y) < 2 THEN 0 ELSE 2.0 * coalesce(c, 0) / (length(x) + length(y) - 2) END::DOUBLE, 9) AS f1 FROM p LEFT JOIN s USING (conv_id, turn)
""")
def paired_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram F1 of each turn and the next."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return bigram_f1(t.join(nxt, ["conv_id", "turn"]), ["conv_id", "turn"], F.col("text"), F.col("next"))


@query()
def rouge_l_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character LCS ratio of each turn and the next."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return t.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(lcs_ratio_udf("text", "next"), 9).alias("ratio"))


@query("""
WITH r AS (SELECT doc_id AS id, toxic::DOUBLE - quality AS v FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
h AS (SELECT id, v, k, sha256('42:' || k || ':' || id) AS h FROM r, unnest(range(0, 125)) AS u(k)),
d AS (SELECT k * 8 + j AS b, v, ('0x' || substr(h, 8 * j + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM h, unnest(range(0, 8)) AS w(j)),
c AS (SELECT list_transform([1, 2, 2.5, 2.6666666666666665, 2.7083333333333335, 2.716666666666667, 2.7180555555555554], lambda x: x::DOUBLE / 2.718281828459045::DOUBLE) AS c),
t AS (SELECT b, v, len(list_filter(c, lambda x: u >= x)) AS k FROM d, c),
m AS (SELECT b, round(sum(k * v) / sum(k), 9) AS m FROM t GROUP BY b), o AS (SELECT list_sort(list(m)) AS m FROM m)
SELECT round((SELECT avg(v) FROM r), 9) AS mean, m[25] AS low, m[975] AS high FROM o
""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean difference between the two labels of a document."""
    return evaluation.paired_bootstrap(table(spark, sf_dir, "labels"), F.col("doc_id"), F.col("quality"), F.col("toxic"))


_WINNER = "CASE WHEN quality > toxic THEN 'base' WHEN quality < toxic THEN 'other' ELSE 'tie' END"


@query(f"""
SELECT count(*) AS n, count(*) FILTER (w = 'base') AS base, count(*) FILTER (w = 'other') AS other, count(*) FILTER (w = 'tie') AS ties,
       round((count(*) FILTER (w = 'other') + 0.5::DOUBLE * count(*) FILTER (w = 'tie')) / count(*), 6) AS rate FROM (SELECT {_WINNER} AS w FROM labels)
""")
def win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins of quality against toxicity."""
    return evaluation.win_rates(table(spark, sf_dir, "labels"), F.expr(_WINNER))


@query("""
WITH t AS (SELECT quality AS t, toxic AS g FROM labels),
f AS (SELECT x, 2.0::DOUBLE * count(*) FILTER (t = x AND g = x) / (count(*) FILTER (t = x) + count(*) FILTER (g = x)) AS f FROM t, (SELECT unnest([0, 1]) AS x) GROUP BY x)
SELECT (SELECT count(*) FROM t) AS n, round((SELECT avg((t = g)::INT) FROM t), 6) AS accuracy, round(avg(f), 6) AS macro_f1 FROM f
""")
def mcq_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro F1 of toxicity as a guess of quality."""
    return evaluation.choice_scores(table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("guess")), [0, 1])


@query("""
SELECT doc_id AS id, sha256('42:' || doc_id::VARCHAR) AS review_key,
       CASE WHEN ('0x' || substr(sha256('42:' || doc_id::VARCHAR), 64, 1))::INT % 2 = 1 THEN 'other' ELSE 'base' END AS a,
       CASE WHEN ('0x' || substr(sha256('42:' || doc_id::VARCHAR), 64, 1))::INT % 2 = 1 THEN 'base' ELSE 'other' END AS b FROM documents
""")
def blind_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides and review order of all documents."""
    return evaluation.blind_sides(_docs(spark, sf_dir).select(F.col("doc_id").alias("id")))


_RULES = [(r"\d{3}-\d{4}|@", "contact"), (r"(?i)apache|license", "license"), (r"(.)\1{4}", "repetition")]


@query(r"""
SELECT conv_id, turn, CASE WHEN f THEN 'emergency' ELSE 'knowledge_only' END AS level, CASE WHEN f THEN 'urgent_message' ELSE 'analyse' END AS route FROM (
  SELECT conv_id, turn, regexp_matches(coalesce(text, ''), '\d{3}-\d{4}|@') OR regexp_matches(coalesce(text, ''), '(?i)apache|license')
         OR len(list_filter(range(1, length(coalesce(text, '')) - 3), lambda i: substr(text, i, 5) = repeat(substr(text, i, 1), 5) AND substr(text, i, 1) NOT IN (chr(10), chr(13), chr(133), chr(8232), chr(8233)))) > 0 AS f FROM conversations)
""")
def red_flag_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and route of every turn under three rules."""
    return rules.triage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), F.col("text"), _RULES).select("conv_id", "turn", "level", "route")


@query("""
WITH p AS (SELECT o_custkey AS c_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS c_mktsegment FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, coalesce(p.c_mktsegment, c.c_mktsegment) AS c_mktsegment, (p.c_mktsegment IS NOT NULL AND p.c_mktsegment IS DISTINCT FROM c.c_mktsegment) AS is_changed FROM customer c LEFT JOIN p USING (c_custkey)
""")
def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers patched with the priority of their latest order."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("c_mktsegment"))
    out = rules.merged(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), orders, "c_custkey", ["c_mktsegment"])
    return out.select("c_custkey", "c_mktsegment", (F.size("changed") > 0).alias("is_changed"))


@query("""
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def events_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type."""
    return ingest.windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session
""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, split at gaps of over 30 minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTE")
    rows = table(spark, sf_dir, "events").withColumn("fresh", F.when(gap, 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("fresh").over(w))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def star_join_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per nation of the customer."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("lines"))


@query("""
(SELECT s_nationkey AS nation, 'both' AS side FROM supplier INTERSECT SELECT c_nationkey, 'both' FROM customer)
UNION ALL (SELECT c_nationkey, 'customers only' FROM customer EXCEPT SELECT s_nationkey, 'customers only' FROM supplier)
""")
def setops_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with suppliers and customers, and with customers alone."""
    s, c = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    both = s.intersect(c).withColumn("side", F.lit("both"))
    return both.unionByName(c.subtract(s).withColumn("side", F.lit("customers only")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest events of each user."""
    return audit.nth_latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "event_type")


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS only_base, count(*) FILTER (quality = 0 AND toxic = 1) AS only_other FROM labels")
def discordant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.discordant(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@query("SELECT count(*) AS n, round(avg(quality), 6) AS base_mean, round(avg(toxic), 6) AS other_mean, round(avg(toxic - quality), 6) AS difference FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def paired_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.paired_means(table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic"))


@query("""
SELECT l_shipmode AS grp, count(*) AS lines, round(avg(r), 6) AS mean_ratio, round(median(r), 9) AS median_ratio, max(r) AS max_ratio
FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_tax / nullif(l_discount, 0) AS r FROM lineitem) GROUP BY 1
""")
def ratio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, exact median and maximum of tax over discount, per flag and status of the lines."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("grp"), (F.col("l_tax") / F.nullif(F.col("l_discount"), F.lit(0))).alias("r"))
    means = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg("r"), 6).alias("mean_ratio"), F.max("r").alias("max_ratio"))
    return means.join(evaluation.medians(rows, F.col("grp"), F.col("r")).withColumn("median_ratio", F.round("median", 9)).drop("median"), "grp")


@query("""
SELECT grp, place, l_orderkey, l_linenumber, ratio FROM (SELECT l_returnflag || l_linestatus AS grp, l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 6) AS ratio,
  CAST(row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY round(l_extendedprice / l_quantity, 6) DESC, l_orderkey, l_linenumber) AS INTEGER) AS place FROM lineitem) WHERE place <= 10
""")
def ratio_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten lines of each flag and status with the largest price a piece; each task keeps ten a group."""
    ratio = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 6)
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("grp"), "l_orderkey", "l_linenumber", ratio.alias("ratio"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("ratio"), "l_orderkey", "l_linenumber"))
    return rows.withColumn("place", place).filter(F.col("place") <= 10)
