import collections
import inspect
import re

import corpus_pipeline
from tests.llm.data import documents, empty, texts
from weft.llm import registry

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1 if i % 9 else 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, texts()[20])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, tmp_path):
    docs = documents(spark)
    sf = tables(spark, tmp_path / "in", docs)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        out = stage(spark, now, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.names == docs.schema.names
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
    assert set(now.columns) == {"doc_id", "size", "text_crc32", "shard", "slot"}


def test_near_copies_and_benchmark_go(spark, tmp_path):
    docs = documents(spark)
    sf = tables(spark, tmp_path / "in", docs)
    kept = corpus_pipeline.one_of_each(spark, docs, sf).collect()
    counts = collections.Counter((r.doc_id, r.text) for r in kept)
    assert max(counts.values()) == 1
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))] for i in range(max(len(w) - 4, 0))}
    sets = [s for s in (shingles(r.text) for r in kept) if s]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert 100 * len(a & b) < 80 * len(a | b)
    clean = {r.doc_id for r in corpus_pipeline.not_in_benchmark(spark, docs, sf).collect()}
    assert 20 not in clean and 21 in clean


def test_mix_repeats_rows_as_often_as_it_says(spark, tmp_path):
    docs = documents(spark)
    sf = tables(spark, tmp_path / "in", docs)
    from weft.llm.mixing import mix

    want = collections.Counter()
    for r in mix(docs).collect():
        want[(r.doc_id, r.source)] += r.copies
    got = collections.Counter((r.doc_id, r.source) for r in corpus_pipeline.mixed(spark, docs, sf).collect())
    assert got == +want


def test_empty_corpus(spark, tmp_path):
    sf = tables(spark, tmp_path / "in", empty(spark))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_repeated_and_null_ids_and_a_column_called_size(spark, tmp_path):
    text = " ".join(f"v{i}" for i in range(60))
    near = [text + " one", text + " two", text + " three"]
    rows = [(1, near[0]), (5, near[1]), (5, near[2]), (None, near[0]), (None, near[1]), (6, "something else"), (6, "other words"), (7, None), (7, None), (8, "")]
    docs = documents(spark, rows)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert sum(n for (_, t), n in got.items() if t in near) == 1
    assert got[(6, "something else")] == got[(6, "other words")] == got[(7, None)] == got[(8, "")] == 1
    many = spark.createDataFrame([(i, " ".join(f"u{i}x{j}" for j in range(9)), "a", 999, "kept") for i in range(20)], "doc_id long, text string, source string, size int, words string")
    out = corpus_pipeline.mixed(spark, many, "").collect()
    assert out and {r["size"] for r in out} == {999} and {r["words"] for r in out} == {"kept"}
