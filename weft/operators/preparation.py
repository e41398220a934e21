"""Preparation of a fine-tuning mixture, and checks of what models return for it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import samples
from weft.sources.scratch import written

#: The classes of a wrong answer, in the order in which they are looked for.
ERRORS = ["NO_DATA", "STRUCTURE_ERROR", "TRANSLATION_ERROR", "METADATA_ERROR", "RETRIEVAL_MISS", "RERANK_ERROR", "CONTEXT_ERROR", "GENERATION_ERROR"]


def word_count(c: Column) -> Column:
    """Words between ASCII blanks; null has none."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+"))


def token_count_udf(path: str):
    """Tokens of a text by the tokenizer file at `path`, which every executor must be able to read."""

    @F.pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for s in parts:
            yield pd.Series([len(e.ids) for e in tokenizer.encode_batch(s.fillna("").tolist())], dtype="int32")

    return run


def within_tokens(rows: DataFrame, tokens: Column, most: int = 1000) -> DataFrame:
    """Rows of at most `most` tokens, by any count of them; an unknown count goes."""
    return rows.filter(tokens <= most)


def mixture(domain: list[tuple[str, DataFrame, float]], general: DataFrame, tokens=word_count, most: int = 1000, share: float = 0.1, test: float = 0.001, validation: float = 0.001, seed: str = "42") -> DataFrame:
    """origin, id, question, answer, split: domain sets in order of precedence and a share of general rows.

    Every set has id, instruction, input and output. Domain sets are normalised, sampled at
    their rates by question and answer, and of equal samples the first stays, by precedence
    and id. General rows are normalised, kept up to `most` tokens of question and answer,
    freed of each other's copies and of what the domain has, and drawn until they make up
    `share` of the whole, as far as there are. Splits depend on the sample alone.

    Samples are written once; which stay is decided on their digests, by combined aggregates.
    """

    def normal(rows: DataFrame, origin: str, place: int) -> DataFrame:
        m = samples.messages(rows).select(F.lit(origin).alias("origin"), F.lit(place).alias("place"), "id", F.get("messages", 0)["content"].alias("question"), F.get("messages", 1)["content"].alias("answer"))
        return m.withColumn("sample", F.sha2(F.concat_ws("\n", "question", "answer"), 256))

    last = len(domain)
    every = within_tokens(normal(general, "general", last), tokens(F.concat_ws("\n", "question", "answer")), most)
    for i, (origin, rows, rate) in enumerate(domain):
        part = normal(rows, origin, i)
        every = every.unionByName(part if rate >= 1 else samples.sampled(part, F.col("sample"), rate, seed))
    every = written(every.withColumn("row", F.monotonically_increasing_id()))
    first = written(every.groupBy("sample").agg(F.min(F.struct("place", "id", "row")).alias("at")).select("sample", "at.place", "at.row"))
    own = F.col("place") < last
    size = first.agg(F.count_if(own).alias("d"), F.count_if(~own).alias("g"))
    n = int(size.select(samples.mixture_target(F.col("d"), F.col("g"), share).alias("n")).first().n)
    drawn = samples.smallest(first.filter(~own), F.sha2(F.concat(F.lit(f"{seed}:"), "sample"), 256), n, "row")
    chosen = first.filter(own).unionByName(drawn).select("row", samples.split_of(F.col("sample"), test, validation, seed).alias("split"))
    return every.join(chosen, "row").select("origin", "id", "question", "answer", "split")


def contract(requests: DataFrame, responses: DataFrame, batch: str, unit: str, order: str) -> DataFrame:
    """batch, requested, returned, accepted: whether a reply has the very units asked for, in order.

    A batch without a reply is not accepted; units without an id count as such.
    """
    listed = lambda df, name: df.groupBy(batch).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, unit))), lambda x: x[unit]).alias(name))
    both = listed(requests, "__asked").join(listed(responses, "__got"), batch, "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return both.select(batch, size("__asked").alias("requested"), size("__got").alias("returned"), F.coalesce(F.col("__asked").eqNullSafe(F.col("__got")), F.lit(False)).alias("accepted"))


def error_label(exists: Column, structured: Column, translated: Column, described: Column, rank: Column, reranked: Column, in_context: Column, right: Column, pool: int = 50, kept: int = 8) -> Column:
    """The first thing that went wrong on the way to an answer; null for a right answer.

    Null counts as wrong, and a null rank as not found.
    """
    ok = [exists, structured, translated, described, rank <= pool, reranked <= kept, in_context, F.lit(False)]
    out = F.lit(None).cast("string")
    for name, good in reversed(list(zip(ERRORS, ok, strict=True))):
        out = F.when(~F.coalesce(good, F.lit(False)), F.lit(name)).otherwise(out)
    return F.when(~F.coalesce(right, F.lit(False)), out)


def safety(rows: DataFrame, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """metric, n, rate: among the rows where the first condition holds, the share where the second does.

    One pass over the rows; the rate is null where no row qualifies, and null is no.
    """
    of = {m: (F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))) for m, (a, b) in metrics.items()}
    one = rows.agg(*[F.struct(F.lit(m).alias("metric"), F.count_if(a).alias("n"), F.count_if(a & b).alias("k")).alias(f"__{i}") for i, (m, (a, b)) in enumerate(of.items())])
    return one.select(F.explode(F.array(*[f"__{i}" for i in range(len(of))])).alias("m")).select("m.metric", "m.n", F.round(F.col("m.k") / F.nullif(F.col("m.n"), F.lit(0)), 6).alias("rate"))


def metric_lines(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """line_no, line: a Markdown table of the rows, numbers with four decimals, N/A for null."""
    cell = lambda c: F.when(F.col(c).isNull(), F.lit("N/A")).otherwise(F.format_string("%.4f", F.col(c).cast("double")))
    body = rows.select(F.row_number().over(Window.orderBy(order)).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", F.coalesce(F.col(order).cast("string"), F.lit("N/A")), *map(cell, columns)), F.lit(" |")).alias("line"))  # a report's few rows
    head = rows.sparkSession.createDataFrame([(-1, "| " + " | ".join([order, *columns]) + " |"), (0, "|---|" + "---:|" * len(columns))], "line_no int, line string")
    return head.unionByName(body)


def containing(docs: DataFrame, items: DataFrame, head: int = 8) -> DataFrame:
    """doc_id, item_id of documents whose text holds an item's text, which may be of any length.

    Candidates meet by the item's first characters, `head` of them or all it has: an
    equi-join with the distinct grams of those lengths that items have (head + 1 at most).
    The empty item is in every text, null in none.
    """
    keyed = items.select("item_id", F.left("item", F.lit(head)).alias("key")).withColumn("l", F.char_length("key")).filter("key is not null")
    lengths = F.broadcast(keyed.select("l").distinct())  # head + 1 rows at most
    grams = F.regexp_extract_all("text", F.concat(F.lit("(?s)(?=(.{"), F.col("l").cast("string"), F.lit("}))")), F.lit(1))
    found = docs.select("doc_id", "text").join(lengths, F.char_length("text") >= F.col("l")).select("doc_id", F.explode(F.array_distinct(grams)).alias("key"))
    pairs = found.join(keyed.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    both = pairs.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", "item"), "item_id")
    return both.filter(F.contains("text", F.col("item"))).select("doc_id", "item_id")



def retried(requests: DataFrame, respond: Callable[[DataFrame, int], DataFrame], batch: str, unit: str, order: str, tries: int = 3) -> DataFrame:
    """Units of requests with the try that their batch was accepted in, and a status.

    respond(open, n) gives the units that the n-th try returns for the batches still open; a
    batch counts only if these are its very units, in order, and is then asked no more. What
    no try settles is "failed", its try null. Open batches are written anew each time.
    """
    open_, done = written(requests), None
    for n in range(1, tries + 1):
        judged = written(contract(open_, respond(open_, n), batch, unit, order).select(F.col(batch).alias("__b"), "accepted"))
        both = open_.join(judged, F.col(batch).eqNullSafe(F.col("__b"))).drop("__b")
        settled = both.filter("accepted").drop("accepted").withColumns({"try": F.lit(n), "status": F.lit("completed")})
        done = settled if done is None else done.unionByName(settled)
        open_ = written(both.filter("not accepted").drop("accepted"))
        if open_.isEmpty():
            break
    return done.unionByName(open_.withColumns({"try": F.lit(None).cast("int"), "status": F.lit("failed")}))
