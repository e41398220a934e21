"""Indexes, automata, held-out stages, intervals, paths and chunks against plain versions."""

import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import automaton, similarity
from weft.operators import entities, evaluation, leakage, retrieval, structure, vector_index


def clustered(seed=0, n=600, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, d))


def test_index_finds_what_the_exact_search_finds(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 16)  # lists are split in blocks and parts
    monkeypatch.setattr(vector_index, "QUERIES", 4)
    v = clustered()
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900 + i, [1.0] * 16) for i in range(40)] + [(990, None), (991, [0.0] * 16)]
    vectors = spark.createDataFrame(rows, "id long, v array<float>")
    asked = vectors.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    index = vector_index.build(vectors, lists=20, k=10)
    assert index.rows.count() == 641 and index.rows.select("id").distinct().count() == 641
    exact = {(r.qid, r.id) for r in retrieval.nearest(vectors, asked, 10).collect()}
    found = vector_index.search(index, vectors, asked, 10).collect()
    assert len({(r.qid, r.id) for r in found} & exact) >= 0.9 * len(exact)
    whole = vector_index.search(index, vectors, asked, 10, probes=20)
    best = {(r.qid, r["rank"]): r.score for r in retrieval.nearest(vectors, asked, 10).collect()}
    assert sum(abs(best[(r.qid, r["rank"])] - r.score) < 1e-6 for r in whole.collect()) >= 0.99 * len(best)


def test_index_of_nothing_and_of_mixed_lengths(spark):
    none = spark.createDataFrame([], "id long, v array<float>")
    assert vector_index.search(vector_index.build(none), none, none.withColumnRenamed("id", "qid")).count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id long, v array<float>")
    with pytest.raises(Exception, match="expected"):
        vector_index.build(mixed)


def test_automaton_against_plain_search(monkeypatch):
    monkeypatch.setattr(automaton, "SEGMENT", 16)
    rnd = random.Random(1)
    for _ in range(150):
        letters = "abé漢"[: rnd.randint(1, 4)]
        names = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 8))})
        texts = ["".join(rnd.choice("abé漢x") for _ in range(rnd.randint(0, 80))) for _ in range(5)]
        machine = automaton.Automaton(names)
        got = sorted(zip(*(x.tolist() for x in machine.occurrences(texts)), strict=True))
        assert got == sorted((i, s, k) for i, t in enumerate(texts) for k, n in enumerate(names) for s in range(len(t)) if t.startswith(n, s))
        assert sorted(zip(*(x.tolist() for x in machine.present(texts)), strict=True)) == sorted({(i, k) for i, _, k in got})


def test_mentions_of_dictionaries_in_parts(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 200))) for _ in range(40)] + [None, ""]
    names = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(30)})
    docs = spark.createDataFrame([(i % 30, t) for i, t in enumerate(texts)], "id long, text string")
    table = spark.createDataFrame([(n,) for n in [*names, "", None]], "name string")
    one, parts = (sorted(tuple(r) for r in entities.mentions(docs, table, most).collect()) for most in (1 << 20, 25))
    want = []
    for i, t in enumerate(texts):
        s = 0
        while t and s < len(t):
            n = max((n for n in names if t.startswith(n, s)), key=len, default="")
            if n:
                want.append((i % 30, s, s + len(n), n))
            s += len(n) or 1
    assert one == parts == sorted(want)


def plain_ratio(a, b):
    row = [0] * (len(a) + 1)
    for y in b:
        new = [0]
        for i, x in enumerate(a):
            new.append(row[i] + 1 if x == y else max(row[i + 1], new[i]))
        row = new
    return 2 * row[-1] / (len(a) + len(b))


def variants(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(40, 120))) for _ in range(12)]
    out = []
    for t in base:
        for edits in (0, 1, 3, 6, 12):
            x = list(t)
            for _ in range(edits):
                x[rnd.randrange(len(x))] = rnd.choice(["", "z", "qq"])
            out.append("".join(x))
    return out


@pytest.mark.parametrize("block", [None, 18])
def test_near_pool_misses_nothing(spark, block, monkeypatch):
    monkeypatch.setattr(leakage, "POOL", 7)  # several passes
    pool, others = variants(1)[::2], variants(1)[1::2]
    want = {}
    for a in pool:
        for b in others:
            near = min(len(a), len(b)) >= 45 and abs(len(a) - len(b)) <= 0.1 * max(len(a), len(b))
            near = near and (block is None or a[:block] == b[:block] or a[-block:] == b[-block:])
            if near and plain_ratio(a, b) >= 0.93:
                want[a] = max(want.get(a, 0), plain_ratio(a, b))
    table = lambda x: spark.createDataFrame([(t,) for t in x], "canon string")
    got = {r.canon: r.ratio for r in leakage.near_any(table(pool), table(others), block=block).collect()}
    assert want and got == pytest.approx(want)
    assert similarity.NearPool([], 0.93, 45, 0.1, None).near("x" * 50) == []


def test_heldout_drops_near_copies_and_counts(spark):
    rnd = random.Random(3)
    ask = [" ".join(f"w{rnd.randrange(500)}" for _ in range(15)) for _ in range(60)]
    rows = spark.createDataFrame([(i, q, "a sufficient answer") for i, q in enumerate(ask)] + [(90, ask[0], "another long answer"), (91, "", "x"), (92, None, "y"), (93, "short", "a sufficient answer")], "row long, question string, answer string")
    plain, counts = leakage.heldout(rows, rows.select("question").limit(0), 100)
    left = {r.question for r in plain.collect()}
    one = counts.first()
    assert one.raw == 64 and one.written == one.eligible == one.candidate_pool == len(left) and one.near_text_overlap == 0
    target = sorted(left)[0]
    split = spark.createDataFrame([(target[:40] + "Q" + target[41:],), (sorted(left)[1].upper(),), (None,)], "question string")
    again, counts = leakage.heldout(rows, split, 100)
    one = counts.first()
    assert {r.question for r in again.collect()} == left - {target, sorted(left)[1]}
    assert (one.exact_question_overlap, one.near_text_overlap, one.split_rows_scanned) == (1, 1, 3)


def test_bootstrap_is_near_the_normal_interval(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=400), rng.normal(loc=0.3, size=400)
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))] + [(900, None, 1.0), (901, 1.0, None)], "id long, x double, y double")
    got = evaluation.paired_bootstrap(rows, F.col("id"), F.col("x"), F.col("y")).first()
    half = 1.96 * (b - a).std() / math.sqrt(400)
    assert got.mean == pytest.approx((b - a).mean(), abs=1e-6)
    assert got.low == pytest.approx(got.mean - half, abs=0.03) and got.high == pytest.approx(got.mean + half, abs=0.03)
    none = evaluation.bootstrap(rows.limit(0).select("id", F.col("x").alias("v"))).first()
    assert none.mean is None and none.low is None
    digest = hashlib.sha256(b"42:0:7").digest()
    assert np.searchsorted(evaluation.POISSON, int.from_bytes(digest[:4], "big") / 2**32, "right") in range(8)


def test_medians_are_exact(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BINS", 3)  # many rounds
    rnd = random.Random(5)
    groups = {g: [rnd.choice([rnd.uniform(-1e9, 1e9), float(rnd.randrange(5)), 1e-12, -1e300, 1e300]) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 101), ("d", 60), (None, 7))}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    got = {r.grp: r["median"] for r in evaluation.medians(spark.createDataFrame(rows, "g string, v double"), F.col("g"), F.col("v")).collect()}
    assert got == pytest.approx({g: statistics.median(vs) for g, vs in groups.items()} | {"e": None})


def test_paths_by_stack_and_by_doubling(spark):
    rnd = random.Random(6)
    rows, want, parent = [], {}, {}
    for d in (1, 2, None):
        stack = []
        for n in range(80):
            rank = rnd.choice([None, 1, 2, 3, 5, 9, 40, 41, 42]) if n % 9 else n
            if rank is not None:
                stack = [s for s in stack if s[0] < rank]
            want[(d, n)] = [s[1] for s in stack]
            parent[(d, n)] = stack[-1][1] if stack else None
            if rank is not None:
                stack.append((rank, n))
            rows.append((d, n, rank, f"t{rank}", f"title {n}"))
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, node long, rank int, type string, title string")
    got = structure.ancestors(table).collect()
    assert {(r.doc_id, r.node): [x.node for x in r.path] for r in got} == want and len(got) == len(rows)
    assert all(x.title == f"title {x.node}" for r in got for x in r.path)
    nodes = spark.createDataFrame([(d, n, parent[(d, n)], t, c) for d, n, _, t, c in rows], "doc_id long, node long, parent long, type string, content string")
    assert {(r.doc_id, r.node): [x.node for x in r.path] for r in structure.lineage(nodes).collect()} == want


def test_bounded_chunks_keep_their_bounds(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("ab é。") if rnd.random() < 0.995 else rnd.choice(".!?\n") for _ in range(rnd.randint(0, 6000))) for _ in range(20)] + [None, "", "x" * 5000, "." * 3000]
    nodes = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)], "doc_id long, node int, content string")
    by = {}
    for r in structure.bounded_chunks(nodes, 300, 100, 500, 40).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert len(by) == len(texts)
    for i, t in enumerate(texts):
        rows = sorted(by[i], key=lambda r: r.sequence)
        assert all(r.text == (t or "")[r.start : r.start + len(r.text)] and len(r.text) <= 500 for r in rows)
        assert all(len(r.text) >= 100 for r in rows[:-1]) and rows[-1].start + len(rows[-1].text) == len(t or "")
        assert all(b.start == a.start + len(a.text) - 40 for a, b in zip(rows, rows[1:], strict=False))
    with pytest.raises(ValueError):
        structure.bounded_chunks(nodes, 300, 100, 200)


def test_neighbours_that_say_the_same(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 0.1]), ("a", 3, [1.0, 0.5]), ("a", 4, None), ("a", 5, [1.0, 0.6]), ("a", 6, [0.0, 1.0]), ("b", 1, [1.0, 0.0]), (None, 2, [1.0]), (None, 3, [0.0])]
    got = {(r.grp, r.id): (r.kept, r.compared_with) for r in structure.neighbour_dedup(spark.createDataFrame(rows, "grp string, id long, v array<double>"), ["id"], 0.97).collect()}
    assert got == {("a", 1): (True, None), ("a", 2): (False, 1), ("a", 3): (True, 1), ("a", 4): (True, None), ("a", 5): (False, 3), ("a", 6): (True, 3), ("b", 1): (True, None), (None, 2): (True, None), (None, 3): (True, 2)}


def test_lines_of_repeated_ids_do_not_mix(spark):
    docs = spark.createDataFrame([(1, "ab\r\nc"), (1, " x"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.raw, r.start, r.end) for r in structure.lines(docs).collect())
    assert got == [(0, "", 0, 0), (1, "ab", 0, 2), (1, "c", 4, 5), (1, "x", 1, 2), (1, " ", 0, 1)]


def test_conditions_of_questions(spark):
    chunks = spark.createDataFrame([(1, "river one", "Alpha", "x"), (2, "river two", "beta", "y"), (3, "river three", None, "x")], "id long, text string, title string, kind string")
    terms = spark.createDataFrame([(q, "river") for q in range(4)], "qid long, term string")
    plans = spark.createDataFrame([(0, None, []), (1, "ALPH", None), (2, None, ["x"]), (3, "a", ["y"])], "qid long, title string, kind array<string>")
    allowed = retrieval.filters(plans, ["title"], ["kind"])
    got = sorted((r.qid, r.id) for r in retrieval.lexical(chunks, terms, conditions=allowed).collect())
    assert got == [(0, 1), (0, 2), (0, 3), (1, 1), (2, 1), (2, 3), (3, 2)]


@pytest.mark.parametrize("cell", [2, 128])
def test_near_pairs_miss_nothing(spark, cell, monkeypatch):
    monkeypatch.setattr(leakage, "CELL", cell)
    texts = variants(9)[:40] + variants(9)[:3]
    got, members = leakage.near_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    node = {r.id: bytes(r.node) for r in members.collect()}
    found = {(bytes(r.a), bytes(r.b)): r.ratio for r in got.collect()}
    want = {}
    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            if a != b and min(len(a), len(b)) >= 45 and abs(len(a) - len(b)) <= 0.1 * max(len(a), len(b)) and (a[:18] == b[:18] or a[-18:] == b[-18:]):
                if plain_ratio(a, b) >= 0.93:
                    want[tuple(sorted((node[i], node[j])))] = plain_ratio(a, b)
    assert want and found == pytest.approx(want)
    assert {i for i in node} == {i for i, t in enumerate(texts) if len(t) >= 45}


def test_pool_loses_no_near_text():
    rnd = random.Random(21)
    base = ["".join(rnd.choice("abcde") for _ in range(n)) for n in (45, 60, 61, 150, 400) for _ in range(6)]
    pool = similarity.NearPool(base, 0.93, 45, 0.1, None)
    found = 0
    for text in base:
        for _ in range(12):
            t = list(text)
            for _ in range(rnd.randint(0, len(t) // 9)):
                at = rnd.randrange(len(t))
                t[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "a"])
            t = "".join(t)
            want = {i: plain_ratio(b, t) for i, b in enumerate(base) if min(len(b), len(t)) >= 45 and abs(len(b) - len(t)) <= 0.1 * max(len(b), len(t))}
            want = {i: r for i, r in want.items() if r >= 0.93}
            got = dict(pool.near(t))
            assert got == pytest.approx(want)
            assert set(dict(pool.near(t, 7))) == {i for i in want if i < 7}
            found += len(want)
    assert found > 100
