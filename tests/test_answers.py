"""From hits to answers: contexts, rounds of reading, plans, messages, retries, settings."""

import pytest
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import dialogue, evaluation, preparation, records, retrieval, rules, store


def test_context_takes_hits_before_neighbours(spark):
    rows = [(i, "n" if i < 5 else "m", i, "a" if i != 2 else "b", "T", None if i == 0 else "s", "x" * (10 * i)) for i in range(8)]
    chunks = spark.createDataFrame(rows, "id long, node string, sequence long, kind string, title string, section string, text string")
    hits = spark.createDataFrame([(0, 3, 1), (0, 6, 2), (0, 4, 3), (1, 0, 1), (1, 99, 2)], "qid long, id long, place int")
    size = {i: len("《T》" + (" · s" if i else "") + "\n" + "x" * 10 * i + "\n") for i in range(8)}

    def plain(order, room):
        taken, used = [], 0
        for i in order:
            whole = size[i] + len(f"[S{len(taken) + 1}] ")
            if i not in taken and used + whole <= room:
                taken.append(i)
                used += whole
        return taken, used

    for room in (10_000, 150, 60):
        got = {r.qid: (r.ids, r["size"]) for r in retrieval.context(hits, chunks, room).collect()}
        assert got == {0: plain([3, 4, 6, 5, 7, 4, 3], room), 1: plain([0, 1], room)}


def test_rounds_of_reading_end(spark):
    questions = spark.createDataFrame([(0, "answers"), (1, "reads"), (2, "always reads"), (3, "reads nothing"), (4, "silent")], "qid long, question string")
    candidates = spark.createDataFrame([(q, 10 * q + p, p) for q in (1, 2, 3) for p in range(5)], "qid long, id long, place int")
    originals = spark.createDataFrame([(i, f"text {i} of the original", 0, 4) for i in range(60)] + [(99, None, 0, 1)], "id long, text string, start int, end int")

    def decide(open_):
        asks = F.col("question").contains("reads") & ((F.col("round") == 0) | (F.col("question") == "always reads"))
        proposed = F.when(F.col("question") == "reads nothing", F.array(F.lit(-5).cast("long"))).otherwise(F.concat(F.array(F.lit(-1).cast("long")), F.reverse("valid"), F.col("valid")))
        answer = F.when(F.col("question") != "silent", F.concat(F.lit("after "), F.size("excerpts").cast("string")))
        return open_.filter("question <> 'silent'").select("qid", F.when(asks, "read_originals").otherwise("answer").alias("action"), proposed.alias("proposed"), answer.alias("answer"))

    for rounds in (0, 1, 2):
        got = {r.qid: r for r in dialogue.read_originals(questions, candidates, originals, decide, rounds, pad=0).collect()}
        assert sorted(got) == [0, 1, 2, 3, 4]
        assert (got[0].answer, got[0].rounds, got[0].stop) == ("after 0", 0, "answer")
        assert (got[1].rounds, got[1].read) == ((1, [14, 13, 12]) if rounds else (0, []))
        assert got[2].rounds == rounds and got[2].stop == "no rounds left" and len(got[2].excerpts) == 3 * rounds
        assert got[3].stop == "nothing to read" and got[4].answer == dialogue.NO_ANSWER
    assert got[1].excerpts == ["text", "text", "text"]


def test_plans_and_messages(spark):
    questions = spark.createDataFrame([(1, "raw"), (2, "other")], "qid long, question string")
    plans = spark.createDataFrame([(1, "search", None, ["k"])], "qid long, search_query string, semantic_query string, keywords array<string>")
    assert sorted(tuple(r) for r in dialogue.planned(questions, plans).collect()) == [(1, "search", "raw", ["k"]), (2, "other", "other", [])]
    rows = spark.createDataFrame([("emergency", ["a", "b"]), ("urgent", []), ("urgent", None), ("knowledge_only", ["a"])], "level string, flags array<string>")
    got = [r[0] for r in rows.select(rules.urgent_message(F.col("level"), F.col("flags"))).collect()]
    assert "（a、b）。请立即" in got[0] and rules.NO_FLAG in got[1] and got[1] == got[2] and got[3] is None


def test_nested_profiles(spark):
    base = spark.createDataFrame([(1, "n", {"a": "1", "b": "2"}), (2, "m", None), (3, "k", {"a": "1"})], "user_id long, name string, habits map<string,string>")
    patch = spark.createDataFrame([(1, None, {"b": "3", "c": None}), (2, "m", {"x": "y"}), (3, "z", {"a": "1"})], "user_id long, name string, habits map<string,string>")
    got = {r.user_id: (r.name, r.habits, r.changed) for r in rules.merged(base, patch, "user_id", ["name"], ["habits"]).collect()}
    assert got == {1: ("n", {"a": "1", "b": "3"}, ["habits"]), 2: ("m", {"x": "y"}, ["habits"]), 3: ("z", {"a": "1"}, ["name"])}


def test_citations(spark):
    rows = spark.createDataFrame([("[S1] and [S3] [S1] [S9]", 3), ("none", 2), (None, 0), ("[S1]", 0)], "a string, n int")
    got = [tuple(r[0]) for r in rows.select(rules.citations(F.col("a"), F.col("n"))).collect()]
    assert got == [(3, 2, 0.666667, 0.666667), (0, 0, 0.0, None), (0, 0, None, None), (1, 0, None, 0.0)]


def test_batches_are_asked_until_they_come_back_whole(spark):
    ask = spark.createDataFrame([(b, o, f"{b}{o}") for b in range(4) for o in range(3)], "b long, o int, u string")

    def respond(open_, n):
        return open_.filter(F.col("b") < n) if n > 1 else open_.filter("b = 0 or o < 2")

    got = {(r.b, r.o): (r["try"], r.status) for r in preparation.retried(ask, respond, "b", "u", "o", 3).collect()}
    assert len(got) == 12 and {k[0]: v for k, v in got.items()} == {0: (1, "completed"), 1: (2, "completed"), 2: (3, "completed"), 3: (None, "failed")}


def test_numbers_in_groups_and_settings_and_texts(spark, tmp_path):
    rows = spark.createDataFrame([("a" if i % 3 else None, 7 * i % 101) for i in range(100)], "g string, o int")
    got = records.numbered(rows, "g", "o").collect()
    for g in ("a", None):
        mine = sorted((r.o, r.number) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    assert store.same_settings(spark, {"a": "1", "b": "2"}, str(tmp_path / "s")) and not store.same_settings(spark, {"b": "2", "a": "1"}, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        store.same_settings(spark, {"a": "9"}, str(tmp_path / "s"))
    values = [0.0, -1.5, 1 / 3, 1e-4, 1.25e-5, 123456789.0, 1234567891.0, -2e20, 2.5e-300]
    lit = spark.createDataFrame([(values,)], "v array<double>").select(text.vector_literal(F.col("v"))).first()[0]
    assert lit == "[" + ",".join(f"{x:.9g}" for x in values) + "]"
    names = spark.createDataFrame([(f"c-{i}",) for i in (2, 10, 9)], "n string").orderBy(text.version_key(F.col("n"))).collect()
    assert [r.n for r in names] == ["c-2", "c-9", "c-10"]


def test_vector_literals_round_the_number_itself(spark):
    values = [2.0**-13, -(2.0**-13), 3 * 2.0**-13, 0.12345678949999999, -0.0, float("nan"), float("inf"), 1e-45, 999999999.5]
    rows = spark.createDataFrame([(values,), ([],), (None,), ([None, 0.5, None],)], "v array<double>")
    got = [r[0] for r in rows.coalesce(1).select(text.vector_literal(F.col("v"))).collect()]
    assert got == ["[" + ",".join(f"{x:.9g}" for x in values) + "]", "[]", None, "[0.5]"]
    assert got[0].startswith("[0.000122070312,-0.000122070312,0.000366210938,")


def test_report_on_pairs(spark):
    rows = [(i, m, float(i), float(i + k)) for i in range(30) for k, m in ((1, "x"), (-2, "y"))] + [(99, "x", None, 1.0)]
    got = {r.metric: r for r in evaluation.paired_report(spark.createDataFrame(rows, "id long, metric string, base double, other double"), ["x", "y", "z"], resamples=50).collect()}
    assert set(got) == {"x", "y"} and got["x"].n == 30 and got["x"].low == got["x"].high == got["x"].difference == 1.0 and got["y"].other_median == 12.5
