"""Readers and writers: formats by file, encodings, excerpts, batches that run again."""

import json

import pytest
from pyspark.sql import functions as F

from weft.sources import readers, writers
from weft.streaming import ingest


def test_every_file_is_read_by_its_own_form(spark, tmp_path):
    (tmp_path / "b.json").write_text('﻿ [\n {"q": "two"},\n {"q": "three"}]', encoding="utf-8")
    (tmp_path / "a.json").write_text('{"q": "one"}\n\n{"q": "[x]"}\n')
    (tmp_path / "c.json").write_text("  \n" + json.dumps({"q": "four"}))
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.txt").write_text('{"q": "not this"}')
    rows = readers.records(spark, str(tmp_path), "q string", "*.json", source=True).filter("q is not null").collect()
    assert sorted((r.src_rank, r.q) for r in rows) == [(0, "[x]"), (0, "one"), (1, "three"), (1, "two"), (2, "four")]
    assert [r.path[-6:] for r in readers.listed(spark, str(tmp_path), "*.json").orderBy("src_rank").collect()] == ["a.json", "b.json", "c.json"]  # one of no bytes is no file
    assert readers.records(spark, str(tmp_path / "c.json"), "q string").first().q == "four"


def test_bytes_of_any_encoding(spark):
    texts = ["plain", "﻿marked", "汉字", None]
    rows = [(i, None if t is None else bytearray(t.encode())) for i, t in enumerate(texts)] + [(9, bytearray("汉字".encode("gb18030"))), (10, bytearray(b"\xff\xff")), (11, bytearray(b""))]
    got = {r.i: (r.d.text, r.d.encoding, r.d.ok) for r in spark.createDataFrame(rows, "i int, c binary").select("i", readers.decoded(F.col("c")).alias("d")).collect()}
    assert got[0] == ("plain", "utf-8-sig", True) and got[1][0] == "marked" and got[2][0] == "汉字" and got[3][0] == "" == got[11][0]
    assert got[9] == ("汉字", "gb18030", True) and got[10] == ("��", "utf-8", False)


def test_excerpts_by_span_lines_and_literal(spark):
    text = "one\ntwo two\nthree\nfour"
    rows = [(text, 4, 7, None, None, None), (text, None, None, 2, 3, None), (text, None, None, None, None, "three"), (text, None, None, 9, 9, "four"), (text, None, None, None, None, "absent"), (None, 0, 1, None, None, "x"), (text, None, None, None, None, "")]
    df = spark.createDataFrame(rows, "t string, s int, e int, a int, b int, l string")
    cut = lambda pad, most: [r[0] for r in df.select(readers.excerpt(F.col("t"), F.col("s"), F.col("e"), F.col("l"), pad, most, F.col("a"), F.col("b"))).collect()]
    assert cut(0, 100) == ["two", "two two\nthree", "three", "four", None, None, None]
    assert cut(2, 6) == ["e\ntwo ", "e\ntwo ", "o\nthre", "e\nfour", None, None, None]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = lambda *k: spark.createDataFrame([(x, f"v{x}") for x in k], "k long, v string")
    assert writers.append_batch(rows(1, 1, 2), "s-0", table, ["k"]).count() == 2
    for _ in range(3):  # as after a kill between the write and the stream's commit
        assert sorted(r.k for r in writers.append_batch(rows(2, 3), "s-1", table, ["k"]).collect()) == [3]
    assert writers.append_absent(rows(3, 4), table, ["k"]) == 1
    assert sorted(r.k for r in writers.stored(spark, table).collect()) == [1, 2, 3, 4]


def test_a_stream_killed_before_its_commit_adds_nothing_twice(spark, tmp_path, monkeypatch):
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "t", "cp"))
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.json(folder)
    whole = ingest.append_batch

    def dies(batch, number, path, key):
        whole(batch, number, path, key)
        raise RuntimeError("killed")

    monkeypatch.setattr(ingest, "append_batch", dies)
    with pytest.raises(Exception, match="killed"):
        ingest.import_files(spark, folder, "k long, v string", table, ["k"], checkpoint)
    monkeypatch.setattr(ingest, "append_batch", whole)
    for _ in range(2):
        ingest.import_files(spark, folder, "k long, v string", table, ["k"], checkpoint)
    assert sorted(r.k for r in writers.stored(spark, table).collect()) == [1, 2]
