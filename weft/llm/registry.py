"""The queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontamination, exact_dedup, line_dedup, lm_scoring, mixing, near_dedup, periodic_runs, prefix_trie, quality, sharding, simhash_dedup, substring_dedup, toxicity
from weft.llm._store import saved
from weft.session import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of nearly equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents in 400-byte strings that occur elsewhere."""
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents, blanks normalised."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: four-word shingles, similarity 0.8."""
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), words=4, percent=80)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the context tree of six folds in seven."""
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where ten-word windows of the benchmark occur in all documents."""
    found = decontamination.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes from each."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels of four folds in five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", quality.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of four folds in five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", quality.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal lines among all documents, two edits apart at most."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: SimHash of three-word shingles, two bits apart at most."""
    return simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"), words=3, distance=2)


def _looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document; those of every tenth end in a loop, as its number says."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, and what is left without repeats."""
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), _looped)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share first turns, as trie() takes them: turns and conversations.

    Conversation c starts with the first crc32(c) % 4 turns of conversation c - c % 20, in
    place of as many of its own.
    """
    turns = saved(turns, "turns")
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    own = own.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, "host": F.col("conv_id") - F.col("conv_id") % 20})
    heads = turns.filter("conv_id % 20 = 0 and place <= 3").groupBy(F.col("conv_id").alias("host"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))  # three at most
    convs = own.join(heads, "host", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), 1, F.col("h").cast("int")))
    convs = saved(convs.withColumn("n", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    lent = convs.select("conv_id", "n", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "n", "t.digest", "t.words")
    kept = turns.join(convs.select("conv_id", "h", "n", F.size("head").alias("lent")), "conv_id").filter("place > h")
    kept = kept.select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "n", "digest", "words")
    return lent.unionByName(kept), convs.select("conv_id", "n")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that many share their first turns."""
    return prefix_trie.trie(*_rebuilt(prefix_trie.numbered(table(spark, sf_dir, "conversations"))))


#: Of op13_prefix_trie: paths as joined digests; a node's subtree by the paths of the members that are smallest in theirs.
PREFIX_TRIE_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab
), turns AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM turns
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS host, xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM numbered), crc
), parts AS (
  SELECT c.conv_id, 0 AS part, place, digest, words FROM convs c JOIN numbered t ON t.conv_id = c.host AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 1, place, digest, words FROM convs c JOIN numbered t ON t.conv_id = c.conv_id AND t.place > c.h
), paths AS (
  SELECT conv_id, row_number() OVER o AS depth, words, string_agg(digest, '') OVER o AS path FROM parts
  WINDOW o AS (PARTITION BY conv_id ORDER BY part, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), sizes AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, max(n) = depth AS leaf,
    sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM paths JOIN sizes USING (conv_id) GROUP BY path, depth
), below AS (
  SELECT p.path, count(*) FILTER (WHERE v.leaf) AS n_leaves, count(*) FILTER (WHERE v.depth = p.depth + 1) AS n_children, sum((v.n_convs - 1) * v.words) AS saved_tokens
  FROM nodes v JOIN paths p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.path
)
SELECT u.conv_id, u.depth, p.conv_id AS parent_conv_id, u.n_convs, n_children, n_leaves, saved_tokens::bigint AS saved_tokens, u.ends_sha256
FROM nodes u JOIN below USING (path) LEFT JOIN nodes p ON u.depth > 0 AND p.path = left(u.path, -64)
"""


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_decontamination": op6_decontamination,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_simhash": op11_simhash,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE = {
    "op6_decontamination": decontamination.ORACLE_SQL,
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op12_periodic_runs": periodic_runs.ORACLE_SQL,
    "op13_prefix_trie": PREFIX_TRIE_SQL,
}
