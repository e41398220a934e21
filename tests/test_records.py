"""Operators on records, on fixtures written out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import records


def test_filters(spark):
    rows = spark.createDataFrame([(1, "Alpha", "x"), (2, "beta", None), (3, None, "y")], "id long, a string, k string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(records.of_kinds(rows, "k", ["x"])) == [1] and ids(records.of_kinds(rows, "k", ["x"], every=True)) == [1, 2, 3]
    assert ids(records.matching(rows, {"a": "ALP", "k": None})) == [1]
    assert ids(records.matching(rows, {"a": "_eta"}, {"k": None})) == [2]
    assert ids(records.matching(rows, {}, {"k": ["x", "y"]})) == [1, 3] and ids(records.matching(rows, {})) == [1, 2, 3]


def test_quarantine_and_funnel(spark):
    rows = spark.createDataFrame([(1, "a"), (None, ""), (3, None)], "id long, t string")
    good, bad = records.quarantined(rows, {"id": F.col("id").isNotNull(), "t": F.col("t") != ""})
    assert [r.id for r in good.collect()] == [1]
    assert sorted((r.id or 0, r.problems) for r in bad.collect()) == [(0, ["id", "t"]), (3, ["t"])]
    counts = records.funnel(rows, {"t": F.col("t").isNotNull(), "id": F.col("id") > 0}).first()
    assert (counts.raw, counts.t, counts.id) == (3, 2, 1)
    assert records.funnel(rows.limit(0), {"t": F.lit(True)}).first().t == 0


def test_lookup_needs_every_key(spark):
    other = spark.createDataFrame([(1, "one")], "k long, v string")
    assert [r.v for r in records.looked_up(spark.createDataFrame([(1,), (1,)], "k long"), other, "k").collect()] == ["one", "one"]
    for key in (2, None):
        with pytest.raises(Exception, match="no row for k"):
            records.looked_up(spark.createDataFrame([(key,)], "k long"), other, "k").collect()


def test_dimensions(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    assert [r.v for r in rows.select(records.of_dimension(F.col("v"), 2).alias("v")).collect()] == [[1.0, 2.0], None]
    with pytest.raises(Exception, match="expected 3 dimensions, got 2"):
        rows.select(records.of_dimension(F.col("v"), 3).alias("v")).collect()


def test_links_and_sequences(spark):
    chunks = spark.createDataFrame([(7, 0), (7, 1), (8, 0)], "doc_id long, sequence int")
    got = {r.chunk_id: (r.parent_id, r.prev_id, r.next_id) for r in records.linked(chunks).collect()}
    assert got == {"7_C00001": ("7", None, "7_C00002"), "7_C00002": ("7", "7_C00001", None), "8_C00001": ("8", None, None)}
    ids = spark.createDataFrame([("D_V0012",), ("9" * 50,), ("none",), (None,)], "x string")
    got = {r.x: r.s for r in ids.select("x", records.sibling_sequence(F.col("x"), 3).alias("s")).collect()}
    assert got["D_V0012"] == 1203 and got[None] is None and all(0 <= got[x] < 2_000_000_000 for x in ("9" * 50, "none"))


def test_paths_against_a_stack(spark):
    rnd = random.Random(5)
    rows, expected = [], {}
    for d in range(20):
        stack = []
        for line in range(1, 30):
            rank = rnd.choice([None, None, 1, 2, 3])
            above = [at for r, at in stack if r < (rank or 4)]
            expected[d, line] = above
            if rank:
                stack = [(r, at) for r, at in stack if r < rank] + [(rank, line)]
            rows.append((d, line, rank))
    got = records.paths(spark.createDataFrame(rows, "doc_id long, line_no int, rank int")).collect()
    assert {(r.doc_id, r.line_no): r.path for r in got} == expected


def test_best_last_newest_first(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 3, 5.0), ("b", 4, None)], "g string, at int, v double")
    got = sorted((r.g, r.report, r.place, r["at"]) for r in records.best_and_last(rows, "g", "v", ["at"], 2).collect())
    assert got == [("a", "best", 1, 1), ("a", "last", 1, 3), ("a", "last", 2, 2), ("b", "best", 1, 4), ("b", "last", 1, 4)]
    assert {r.g: r["at"] for r in records.newest(rows, "g", ["at"]).collect()} == {"a": 3, "b": 4}
    assert [r["at"] for r in records.first_units(rows, ["at"], 2).collect()] == [1, 2]
    assert spark.range(1).select(records.throughput(F.lit(3.0), F.lit(0.0)).alias("t")).first().t == pytest.approx(3e9)


def test_near_ratio_loses_no_near_pair():
    from weft.functions import similarity

    rnd = random.Random(11)
    for _ in range(400):
        a = "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 120)))
        b = list(a)
        for _ in range(rnd.randint(0, 12)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "a"])
        b = "".join(b) or "a"
        assert similarity._bound(a, b) >= 2 * similarity._lcs(a, b) / (len(a) + len(b)) - 1e-12


def test_near_ratio_values(spark):
    from weft.functions.similarity import near_ratio_udf

    rows = [("abcd" * 20, "abcd" * 20), ("abcd" * 20, "abcd" * 19 + "abxd"), ("abcd" * 20, "dcba" * 20), (None, "a"), ("a", "aaaa"), ("", "")]
    got = [r.v for r in spark.createDataFrame(rows, "a string, b string").select(near_ratio_udf(0.93)("a", "b").alias("v")).collect()]
    assert got == [1.0, 158 / 160, None, None, None, 1.0]


def test_sums_that_do_not_depend_on_order(spark, tmp_path):
    from weft.plans import corpus

    rows = [(1, 0.3), (1, 0.2), (1, 0.1), (2, 0.1), (2, 0.2), (2, 0.3), (3, float("nan")), (3, 1.0), (4, 1e300), (4, 1.0), (5, None), (6, 0.61)]
    spark.createDataFrame(rows, "o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, 7, -1.0) for i in range(1, 7)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: (r.nation_rank, r.orders_n) for r in corpus.ranked_orders(spark, str(tmp_path)).collect()}
    assert got == {3: (1, 2), 4: (2, 2), 6: (3, 1), 1: (4, 3), 2: (5, 3), 5: (6, 1)}


def test_similar_names_of_many_parts(spark, tmp_path):
    from weft.plans import corpus

    rnd = random.Random(5)
    names = [f"{a} {b}" for a in ("large", "larger", "hot", "cold") for b in ("ring", "rings", "bolt")] + [None, "", "- -", "Ring LARGE"]
    rows = [(i, rnd.choice(names)) for i in range(300)] + [(20, "large ring"), (21, "cold bolt"), (None, "large ring")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    grams = {}
    for i, name in rows:
        for w in (name or "").replace("-", " ").lower().split():
            grams.setdefault(i, set()).update(f"  {w} "[j : j + 3] for j in range(len(w) + 1))
    grams.pop(None)
    want = set()
    for q in (i for i in grams if i % 20 == 0):
        near = [(-round(len(grams[q] & grams[i]) / len(grams[q] | grams[i]), 9), i) for i in grams if i != q]
        want |= {(q, i, -s, n) for n, (s, i) in enumerate(sorted(x for x in near if x[0] <= -0.3)[:10], 1)}
    found = corpus.trigram_similarity_topk(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == want and [f.dataType.simpleString() for f in found.schema] == ["bigint", "bigint", "double", "int"]
