"""Preparation operators against plain versions on small rows."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import entities, preparation, samples

ROWS = "id long, instruction string, input string, output string"


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def test_mixture_against_plain_steps(spark):
    rnd = random.Random(3)
    make = lambda n: [(i if i % 9 else None, f"ask {rnd.randrange(40)}", rnd.choice([None, "", "more"]), rnd.choice([f"told {rnd.randrange(3)}", "<think>x</think> told 1", "", None])) for i in range(n)]
    sets = {"a": make(60), "b": make(60), "general": [*make(200), (500, "long", None, "w " * 30)]}

    def normal(rows):
        for i, ask, more, told in rows:
            q, a = ask + (f"\n\n{more}" if more else ""), (told or "").replace("<think>x</think> ", "").strip()
            if q and a:
                yield i, q, a

    samples_of = {k: {f"{q}\n{a}" for _, q, a in normal(v)} for k, v in sets.items()}
    samples_of["b"] = {s for s in samples_of["b"] if int(_sha("42:" + _sha(s))[:15], 16) / (1 << 60) < 0.5}
    expected = {s: "a" for s in samples_of["a"]} | {s: "b" for s in samples_of["b"] - samples_of["a"]}
    free = sorted((s for s in samples_of["general"] - set(expected) if len(s.split()) <= 20), key=lambda s: _sha("42:" + _sha(s)))
    expected |= {s: "general" for s in free[: math.ceil(len(expected) / 9)]}
    df = {k: spark.createDataFrame(v, ROWS) for k, v in sets.items()}
    got = preparation.mixture([("a", df["a"], 1.0), ("b", df["b"], 0.5)], df["general"], most=20, test=0.3, validation=0.3).collect()
    assert sorted((f"{r.question}\n{r.answer}", r.origin) for r in got) == sorted(expected.items())
    for r in got:
        p = int(_sha("42:" + _sha(f"{r.question}\n{r.answer}"))[:15], 16) / (1 << 60)
        assert r.split == ("test" if p < 0.3 else "validation" if p < 0.6 else "train")


def test_mixture_of_nothing(spark):
    none = spark.createDataFrame([], ROWS)
    assert preparation.mixture([("a", none, 1.0)], none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 57, 300, 999])
def test_smallest_is_a_sort_and_a_limit(spark, n):
    rows = spark.range(300).select("id", (F.col("id") % 100).alias("v"))
    got = samples.smallest(rows, F.sha2(F.col("v").cast("string"), 256), n)
    expected = sorted(range(300), key=lambda i: (_sha(str(i % 100)), i))[:n]
    assert sorted(r.id for r in got.collect()) == sorted(expected) and got.columns == ["id", "v"]


def test_containing_and_entities(spark):
    texts = ["", "a", "say aaa, aaa", "x.y(z)\nlong item here", "ünï\U0001f600code long item", None]
    items = ["", "a", "aa", "x.y(z)\nlong", "\U0001f600code", "long item", "absent", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = spark.createDataFrame(list(enumerate(items)), "item_id long, item string")
    for head in (3, 8):
        got = preparation.containing(docs, named, head).collect()
        expected = [(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if t is not None and x is not None and x in t]
        assert sorted((r.doc_id, r.item_id) for r in got) == expected
    dictionary = spark.createDataFrame([("aa", "x"), ("aa", "y"), ("aa", "x"), ("long item", "x"), ("", "x"), (None, "x")], "name string, type string")
    got = sorted(tuple(r) for r in entities.entities(docs, dictionary).collect())
    assert got == [(2, "aa", "x", 5, 2), (2, "aa", "y", 5, 2), (3, "long item", "x", 8, 1), (4, "long item", "x", 10, 1)]


def test_contract(spark):
    ask = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d"), (3, 1, None)], "b int, o int, u string")
    got = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (3, 0, "d"), (3, 1, None), (9, 0, "z")], "b int, o int, u string")
    rows = sorted(tuple(r) for r in preparation.contract(ask, got, "b", "u", "o").collect())
    assert rows == [(1, 2, 2, False), (2, 1, 0, False), (3, 2, 2, True)]


def test_error_label(spark):
    rows = [(None,) * 8, (True, False, True, True, 1, 1, True, False), (True, True, True, True, None, 1, True, False), (True, True, True, True, 50, 9, True, False), (True, True, True, True, 50, 8, True, None), (True,) * 4 + (99, 99, False, True)]
    names = ["e", "s", "t", "m", "r", "k", "c", "ok"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e boolean, s boolean, t boolean, m boolean, r int, k int, c boolean, ok boolean")
    got = [r.x for r in df.orderBy("i").select(preparation.error_label(*map(F.col, names)).alias("x")).collect()]
    assert got == ["NO_DATA", "STRUCTURE_ERROR", "RETRIEVAL_MISS", "RERANK_ERROR", "GENERATION_ERROR", None]


def test_safety_and_lines(spark):
    df = spark.createDataFrame([(True, True), (True, None), (None, True), (False, True)], "a boolean, b boolean")
    got = {r.metric: (r.n, r.rate) for r in preparation.safety(df, {"x": (F.col("a"), F.col("b")), "none": (F.lit(False), F.col("b"))}).collect()}
    assert got == {"x": (2, 0.5), "none": (0, None)}
    lines = preparation.metric_lines(spark.createDataFrame([("m", 0.5, None)], "metric string, base double, other double"), "metric", ["base", "other"])
    assert [r.line for r in lines.orderBy("line_no").collect()] == ["| metric | base | other |", "|---|---:|---:|", "| m | 0.5000 | N/A |"]


def test_token_filter_by_a_tokenizer(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = str(tmp_path / "words.json")
    model = tokenizers.Tokenizer(tokenizers.models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    model.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    model.save(path)
    df = spark.createDataFrame([("a b a",), ("a zz",), ("",), (None,)], "text string")
    counted = df.withColumn("n", preparation.token_count_udf(path)("text"))
    assert [r.n for r in counted.collect()] == [3, 2, 0, 0]
    assert preparation.within_tokens(counted, F.col("n"), 2).count() == 3


def test_metrics_of_rankings(spark):
    from weft.operators import retrieval

    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (4, 10, 1)], "qid long, id long, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (2, 77), (3, 10)], "qid long, id long")
    got = retrieval.metrics(results, relevant, 2).first()
    dcg, ideal = 1 / math.log2(3), 1 + 1 / math.log2(3)
    assert got.questions == 3
    assert got.recall_at_k == pytest.approx((1 / 3) / 3, abs=1e-6) and got.mrr == pytest.approx(0.5 / 3, abs=1e-6)
    assert got.ndcg_at_k == pytest.approx(dcg / ideal / 3, abs=1e-6)
