"""Questions on their way to an answer: plans, reading of originals, rounds that end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.sources.readers import excerpt
from weft.sources.scratch import written

#: Excerpts that one round reads, and the answer of a model that gave none.
MOST_READ = 3
NO_ANSWER = "当前证据不足以给出可靠回答，请补充问题或核对资料后再咨询。"


def planned(questions: DataFrame, plans: DataFrame) -> DataFrame:
    """qid, search_query, semantic_query, keywords of each question (qid, question).

    Questions without a plan are searched for as they stand, without keywords.
    """
    known = plans.select("qid", "search_query", "semantic_query", "keywords")
    none = F.array().cast("array<string>")
    out = questions.join(known, "qid", "left")
    return out.select("qid", F.coalesce("search_query", "question").alias("search_query"), F.coalesce("semantic_query", "question").alias("semantic_query"), F.coalesce("keywords", none).alias("keywords"))


def selected(proposed: Column, valid: Column, most: int = MOST_READ) -> Column:
    """The first `most` proposed ids that are valid, each once, in order."""
    return F.slice(F.array_distinct(F.filter(proposed, lambda x: F.array_contains(valid, x))), 1, most)


def read_originals(
    questions: DataFrame, candidates: DataFrame, originals: DataFrame, decide: Callable[[DataFrame], DataFrame], rounds: int = 1, pad: int = 600, most: int = 4000
) -> DataFrame:
    """qid, answer, rounds, read (ids), excerpts, stop: every question, once it is answered.

    candidates (qid, id, place) are what retrieval ranked, originals (id, text, start, end)
    where to read. decide(open) is asked in each round about the open questions (qid,
    question, valid, read, excerpts, round) and gives them action, proposed (ids) and answer.
    A question is read for if it asks to ("read_originals"), may (it has candidates and
    rounds are left) and proposes a valid id; otherwise it is answered. An empty answer
    becomes NO_ANSWER. The open questions are a table that every round writes anew, so a
    round costs one pass over them and over the originals asked for. stop tells why it ended:
    "answer", or "no rounds left" or "nothing to read" if it still asked to read.
    """
    valid = candidates.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("valid"))
    none = F.array().cast("array<bigint>")
    state = questions.select("qid", "question").join(valid, "qid", "left").withColumns(
        {"valid": F.coalesce("valid", none), "read": none, "excerpts": F.array().cast("array<string>"), "round": F.lit(0)}
    )
    state, done = written(state), None
    for n in range(rounds + 1):
        told = decide(state).select("qid", "action", "proposed", "answer")
        now = state.join(told, "qid", "left").withColumn("asks", F.coalesce(F.col("action") == "read_originals", F.lit(False)))
        now = now.withColumn("chosen", selected(F.coalesce("proposed", none), F.col("valid")))
        now = written(now.withColumn("reads", F.col("asks") & (F.size("chosen") > 0) & F.lit(n < rounds)))
        why = F.when(~F.col("asks"), "answer").when(F.size("chosen") == 0, "nothing to read").otherwise("no rounds left")
        answer = F.when(F.trim("answer") != "", F.trim("answer")).otherwise(NO_ANSWER)
        ended = now.filter(~F.col("reads")).select("qid", answer.alias("answer"), F.col("round").alias("rounds"), "read", "excerpts", why.alias("stop"))
        done = ended if done is None else done.unionByName(ended)
        going = now.filter("reads")
        if n == rounds or going.isEmpty():
            break
        asked = going.select("qid", F.posexplode("chosen").alias("nth", "id")).join(originals.select("id", "text", "start", "end"), "id", "left")
        text = F.coalesce(excerpt(F.col("text"), F.col("start"), F.col("end"), F.lit(""), pad, most), F.lit(""))
        parts = asked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", text.alias("text")))), lambda x: x["text"]).alias("more"))
        state = written(
            going.join(parts, "qid").select(
                "qid", "question", "valid", F.concat("read", "chosen").alias("read"), F.concat("excerpts", "more").alias("excerpts"), (F.col("round") + 1).alias("round")
            )
        )
    return written(done)
