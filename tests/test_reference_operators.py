"""Operators on small fixtures, most of them written out by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import hashing, similarity, text
from weft.operators import audit, evaluation, leakage, retrieval, rules, samples, store, structure
from weft.sources import readers, writers
from weft.streaming import ingest


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, "\x00 a\r\n\r\n\r\n\r\nb　", text.clean_text) == "a\n\nb"
    assert one(spark, None, text.clean_text) == ""
    assert one(spark, "<THINK>x\ny</think> answer", text.without_think) == "answer"
    assert one(spark, "Q: 你 好？", text.canonical) == one(spark, "q你好", text.canonical)
    assert one(spark, " 不详 ", text.null_tokens) is None
    assert one(spark, " =1+1", text.formula_safe) == "' =1+1"
    assert one(spark, "abcdef", lambda c: text.shortened(c, 3)) == "abc…"
    assert one(spark, "中 医\\n方\\x  a  b", text.clean_line) == "中医 方 a b".replace("医 方", "医方")
    assert sorted(one(spark, "cat", text.trigrams)) == ["  c", " ca", "at ", "cat"]
    assert one(spark, "a b c", text.bigrams) == ["ab", "bc"]
    assert one(spark, "x", text.bigrams) == []


def test_hashes(spark):
    import hashlib

    assert one(spark, "abc", hashing.blake2b_udf(8)) == hashlib.blake2b(b"abc", digest_size=8).hexdigest()
    assert one(spark, "abc", lambda c: hashing.draw("42", c)) == int(hashlib.sha256(b"42:abc").hexdigest()[:15], 16) / 2**60


def test_lcs_ratio(spark):
    rows = [("abcd", "acbd"), ("", ""), ("a", ""), (None, "a"), ("same", "same")]
    got = [r.v for r in spark.createDataFrame(rows, "a string, b string").select(similarity.lcs_ratio_udf("a", "b").alias("v")).collect()]
    assert got == [0.75, 1.0, 0.0, None, 1.0]


def test_bigram_f1(spark):
    rows = spark.createDataFrame([(1, "abab", "abab"), (2, "ab", "cd"), (3, "a", "ab"), (4, None, "x"), (5, "aaaa", "aa")], "id long, a string, b string")
    got = {r.id: r.f1 for r in similarity.bigram_f1(rows, ["id"], F.col("a"), F.col("b")).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.5}


def test_file_names_headers_and_types(spark):
    name = one(spark, "(1.2-34).方书-古方.《金匮要略》（三卷、续集二卷）", audit.file_name)
    assert (name.code, name.catalog_id, name.category, name.title, name.form) == ("1.2", "34", ["方书", "古方"], "金匮要略", "catalog_filename")
    assert one(spark, "012-伤寒论", audit.file_name).title == "伤寒论"
    assert one(spark, "plain", audit.file_name).title == "plain"
    head = one(spark, "书名：未知\n作者：张三\n年份：公元1650年\n<篇名>序\n", audit.header)
    assert (head.title, head.author, head.dynasty) == ("序", "张三", None)
    assert one(spark, "公元1650年", audit.only_year) == 1650 and one(spark, "1650 1651", audit.only_year) is None
    for word, n in (("12", 12), ("十", 10), ("十二", 12), ("二十", 20), ("三十五", 35), ("百", 100), ("七", 7), ("甲", None)):
        assert one(spark, word, audit.numeral) == n, word
    kind = lambda t, y, body: spark.createDataFrame([(t, y, body)], "t string, y int, b string").select(audit.text_type(F.col("t"), F.col("y"), F.col("b")).alias("k")).first().k.text_type
    assert [kind("书", 1950, "x" * 300), kind("某某医案", None, "x"), kind("伤寒论注", None, "x"), kind("本草", None, "短"), kind("本草", None, "x" * 300), kind("医籍考", 1800, "x")] == [
        "modern_book", "medical_case", "commentary", "unknown", "ancient_classical", "reference",
    ]
    v = spark.createDataFrame([("（三卷、续集二卷）", "")], "a string, b string").select(audit.volumes(F.col("a"), F.col("b")).alias("v")).first().v
    assert v.has_volume and v.volumes == 5
    assert one(spark, "醫藥經傷證針灸臟" * 2, audit.script) == "traditional" and one(spark, "医药", audit.script) == "simplified"


def stack_tree(rows):
    """Plain stack version of the tree: (line, kind, title, rank) to {node: parent}."""
    stack, parents, last = [(0, None)], {}, None
    volume = None
    for line, kind, title, rank in rows:
        if kind != "heading":
            continue
        while stack and stack[-1][0] >= rank:
            stack.pop()
        node = line
        if rank == 1:
            if title == last:
                node = volume
            else:
                volume = line
            last = title
        if node == line:
            parents[node] = stack[-1][1] if stack else None
        stack.append((rank, node))
    return parents


def test_tree_against_a_stack(spark):
    rnd = random.Random(3)
    rows, expected = [], {}
    for d in range(12):
        doc = []
        for line in range(1, 40):
            kind = rnd.choice(["heading", "text", "text", "break"])
            rank = rnd.randint(1, 3) if kind == "heading" else None
            doc.append((line, kind, rnd.choice("AB") if kind == "heading" else None, rank))
        expected[d] = stack_tree(doc)
        rows += [(d, n, 10 * n, 10 * n + 5, f"t{n}", k, t, r) for n, k, t, r in doc]
    nodes = structure.tree(spark.createDataFrame(rows, "doc_id long, line_no int, start long, end long, text string, kind string, title string, rank int")).collect()
    for d in range(12):
        assert {r.node: r.parent for r in nodes if r.doc_id == d and r.type != "paragraph"} == expected[d]


def test_lines_and_headings(spark):
    docs = spark.createDataFrame([(1, "卷一\r\n第一章 总论\n\n正文一\n正文二"), (2, ""), (3, None)], "doc_id long, text string")
    lines = structure.lines(docs).orderBy("doc_id", "line_no").collect()
    assert [(r.start, r.end, r.raw) for r in lines if r.doc_id == 1][:2] == [(0, 2, "卷一"), (4, 10, "第一章 总论")]
    assert [r.raw for r in lines if r.doc_id > 1] == ["", ""]
    nodes = {r.content: r for r in structure.tree(structure.classify_lines(docs)).collect()}
    assert nodes["第一章总论" if "第一章总论" in nodes else "第一章 总论"].type == "chapter"
    assert nodes["正文一正文二"].type == "paragraph" and nodes["卷一"].type == "volume"
    md = structure.markdown(structure.tree(structure.classify_lines(docs)), spark.createDataFrame([(1, "T")], "doc_id long, title string")).first().markdown
    assert md.startswith("# T\n\n## 卷一\n\n### ") and md.endswith("正文一正文二\n")


def test_batches_and_packing(spark):
    sizes = lambda *x: spark.createDataFrame([(list(x),)], "x array<bigint>")
    assert sizes(3, 4, 9, 1, 1).select(structure.batches(F.col("x"), 7).alias("b")).first().b == [1, 1, 2, 3, 3]
    rnd = random.Random(2)
    for _ in range(10):
        items = [(rnd.randint(1, 6), rnd.randint(1, 50)) for _ in range(12)]
        chosen, size = [], 0
        for i, n in items:
            whole = n + len(f"[S{len(chosen) + 1}] ")
            if i not in chosen and size + whole <= 120:
                chosen.append(i)
                size += whole
        row = spark.createDataFrame([(items,)], "x array<struct<id: bigint, size: bigint>>").select(retrieval.packed(F.col("x"), 120).alias("p")).first().p
        assert (row.ids, row["size"]) == (chosen, size)


def test_retrieval(spark):
    chunks = spark.createDataFrame([(1, "the river stone"), (2, "stony rivers"), (3, "nothing"), (4, None), (5, "服用人参后")], "id long, text string")
    terms = spark.createDataFrame([(0, "river"), (0, "x"), (1, "人参"), (2, None)], "qid long, term string")
    got = [(r.qid, r.id, r.rank) for r in retrieval.lexical(chunks, terms).orderBy("qid", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (1, 5, 1)] or got == [(0, 2, 1), (0, 1, 2), (1, 5, 1)]
    rng = np.random.default_rng(0)
    v = rng.normal(size=(50, 4))
    vectors = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(90, None), (91, [1.0])], "id long, v array<float>")
    near = retrieval.nearest(vectors, vectors.filter("id < 3").withColumnRenamed("id", "qid"), 5).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(3):
        assert [r.id for r in sorted(near, key=lambda r: r.rank) if r.qid == q] == np.argsort(-(unit @ unit[q]))[:5].tolist()
    lists = [spark.createDataFrame(x, "qid long, id long, rank int") for x in ([(0, 1, 1), (0, 2, 2)], [(0, 2, 1), (0, 3, 2)])]
    fused = [(r.id, r.channels) for r in retrieval.fuse(lists).orderBy("place").collect()]
    assert fused == [(2, [0, 1]), (1, [0]), (3, [1])]
    order = spark.createDataFrame([(0, 3, 1), (0, 99, 2)], "qid long, id long, rank int")
    assert [r.id for r in retrieval.reranked(retrieval.fuse(lists), order).collect()] == [3]


def test_samples(spark):
    rows = spark.createDataFrame([("问", "", "<think>t</think>答"), ("", "only input", "ok"), ("q", "", "  ")], "instruction string, input string, output string")
    got = samples.messages(rows)
    assert sorted(m.messages[1].content for m in got.collect()) == ["ok", "答"]
    assert got.select(samples.valid(F.col("messages")).alias("v")).distinct().collect()[0].v
    base = spark.createDataFrame([(i, f"question number {i} asks something", "a long enough answer") for i in range(200)], "row long, question string, answer string")
    leaked = leakage.heldout(base, base.limit(0), 10)[0].collect()
    assert len(leaked) == 10
    split = spark.createDataFrame([(leaked[0].question.upper() + "?!",)], "question string")
    again = leakage.heldout(base, split, 10, pool_factor=20)[0].collect()
    assert len(again) == 10 and leaked[0].id not in {r.id for r in again}
    kept = samples.sampled(base, F.col("question"), 0.2).count()
    assert kept + samples.sampled(base, F.col("question"), 0.2, keep=False).count() == 200 and 15 < kept < 70
    text_rows = spark.createDataFrame([(1, "x" * 30 + "abcdefghij" * 3), (2, "x" * 30 + "abcdefghij" * 3 + "k"), (3, "short")], "id long, text string")
    assert {(r.id, r.other_id) for r in samples.near_copies(text_rows, text_rows).collect()} == {(1, 2), (2, 1)}
    general = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "n long, k string")
    assert [r.n for r in samples.without_overlap(general, general.filter("k = 'a'"), F.col("k"), ["n"]).orderBy("n").collect()] == [2, 4]


def test_evaluation(spark):
    rows = spark.createDataFrame([(i, float(i % 2)) for i in range(60)], "id long, v double")
    ci = evaluation.bootstrap(rows, resamples=200).first()
    assert ci.mean == 0.5 and 0.25 < ci.low < 0.5 < ci.high < 0.75
    w = evaluation.win_rates(spark.createDataFrame([("base",), ("other",), ("tie",), ("odd",)], "w string"), F.col("w")).first()
    assert (w.n, w.rate) == (3, 0.5)
    s = evaluation.choice_scores(spark.createDataFrame([("A", "A"), ("B", "A"), ("B", "B")], "truth string, guess string"), list("ABCD")).first()
    assert s.accuracy == pytest.approx(2 / 3, abs=1e-6) and s.macro_f1 == pytest.approx((2 / 3 + 2 / 3) / 4, abs=1e-6)
    side = '{"correctness": 5, "coverage": %s, "unsafe": false}'
    good = '```json\n{"winner": "A", "A": ' + side % 4 + ', "B": ' + side % 1 + "}\n```"
    assert one(spark, good, evaluation.judgement).winner == "A"
    assert one(spark, good.replace('"coverage": 4', '"coverage": 9'), evaluation.judgement) is None
    sides = evaluation.blind_sides(spark.createDataFrame([(1,), (2,)], "id long"))
    rated = spark.createDataFrame([(1, " a "), (2, "tie"), (2, "?"), (9, "A")], "id long, winner string")
    first = sides.filter("id = 1").first().a
    assert sorted(r.winner for r in evaluation.unblind(rated, sides).collect()) == sorted([first, "tie"])
    assert one(spark, "是", evaluation.yes_or_no) is True and one(spark, "maybe", evaluation.yes_or_no) is None


def test_rules_and_store(spark):
    t = rules.triage(spark.createDataFrame([("突然昏迷",), ("养生",), (None,)], "q string"), F.col("q")).collect()
    assert [r.level for r in t] == ["emergency", "knowledge_only", "knowledge_only"] and t[0].flags == ["意识障碍或持续抽搐"]
    g = spark.createDataFrame([("怎么煎",), ("问候",)], "q string").select(rules.formula_gate(F.col("q"), F.expr("cast(null as array<string>)"), F.lit(False)).alias("g")).collect()
    assert [r.g.triggered for r in g] == [True, False]
    base = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "user_id long, name string, age int")
    patch = spark.createDataFrame([(1, None, 7), (2, "c", 5)], "user_id long, name string, age int")
    got = {r.user_id: (r.name, r.age, r.changed) for r in rules.merged(base, patch, "user_id", ["user_id", "name", "age"]).collect()}
    assert got == {1: ("a", 7, ["age"]), 2: ("c", 5, ["name"])}
    assert one(spark, "see [S2] and [S1], [S2]", rules.cited) == [2, 1]
    wanted = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "version int, statement string")
    ledger = spark.createDataFrame([(1, "x"), (2, "old")], "version int, s string").select("version", F.sha2("s", 256).alias("checksum"))
    assert {r.version: r.action for r in store.migrations(ledger, wanted).collect()} == {1: "skip", 2: "changed", 3: "apply"}


def test_sources_sinks_and_stream(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"q": "x"}, {"q": "y"}]')
    (tmp_path / "l.json").write_text('{"q": "x"}\n\n{"q": "z"}\n')
    assert sorted(r.q for r in readers.records(spark, str(tmp_path / "a.json"), "q string").collect()) == ["x", "y"]
    assert sorted(r.q for r in readers.records(spark, str(tmp_path / "l.json"), "q string").collect() if r.q) == ["x", "z"]
    (tmp_path / "files").mkdir()
    for name, raw in (("1.txt", "中医".encode("gb18030")), ("2.txt", "中医".encode()), ("3.txt", b"\xff\xff\xff")):
        (tmp_path / "files" / name).write_bytes(raw)
    got = {r.path[-5:]: (r.text, r.ok) for r in readers.files(spark, str(tmp_path / "files")).collect()}
    assert got["1.txt"] == ("中医", True) and got["2.txt"] == ("中医", True)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    assert writers.append_absent(df, str(tmp_path / "t"), ["k"]) == 2
    assert writers.append_absent(df, str(tmp_path / "t"), ["k"]) == 0
    writers.json_lines(df, str(tmp_path / "out"), sort_keys=True)
    writers.sheet(spark.createDataFrame([("=1",)], "c string"), str(tmp_path / "sheet"))
    assert readers.csv_sheet(spark, str(tmp_path / "sheet"), "c string").first().c == "'=1"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"k": 1, "v": "a"}\n{"k": 3, "v": "c"}\n')
    for _ in range(2):
        ingest.import_files(spark, str(tmp_path / "in"), "k long, v string", str(tmp_path / "t"), ["k"], str(tmp_path / "cp"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]


def test_canonical_folds_forms_and_case(spark):
    assert one(spark, "Ｑ：Straße？", text.canonical) == "qstrasse"
    assert one(spark, "ＡＢ c", text.canonical) == one(spark, "ab C", text.canonical) == "abc"


def test_lcs_of_common_ends():
    from weft.functions.similarity import _lcs

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1]

    for a, b in (("", ""), ("aba", "ababa"), ("abcxdef", "abcydef"), ("aaaa", "aa"), ("xabc", "abcx"), ("same", "same")):
        assert _lcs(a, b) == plain(a, b)


def test_signs_of_bad_ocr(spark):
    rows = [("a□□�b", True), ("□□", False), ("漢" * 9, True), ("漢" * 8, False), ("---------", False)]
    got = spark.createDataFrame(rows, "text string, bad boolean").select("bad", audit.quality(F.col("text"))["suspected_ocr"].alias("x")).collect()
    assert all(r.bad == r.x for r in got)
