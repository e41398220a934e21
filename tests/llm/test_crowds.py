"""Groups of many members, and words that weak hashes take for one another."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.data import documents
from weft.llm import decontamination, line_dedup, lm_scoring, near_dedup, substring_dedup
from weft.llm._text import ALNUM, Words


def crowd():
    """Texts of one family, half of which are near each other, and a few of another."""
    rnd = random.Random(4)
    out = []
    for size, n in ((120, 150), (60, 40)):
        base = [f"v{rnd.randrange(5000)}" for _ in range(size)]
        for _ in range(n):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 2, 3, 6])):
                w[rnd.randrange(size)] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def components_of(rows, k):
    sets = []
    for t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)})
    low = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            changed |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    return low


@pytest.mark.parametrize("block", [8, 64])
def test_near_copies_in_crowds(spark, block):
    rows = crowd()
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(documents(spark, list(enumerate(rows))), block=block).collect()}
    assert got == dict(enumerate(components_of(rows, 5)))


def lonely():
    """Families of texts that are nearly near, and in each one near pair that its leaders hardly know."""
    rnd = random.Random(6)
    out = []
    for f in range(4):
        base = [f"v{f}-{rnd.randrange(5000)}" for _ in range(300)]
        for _ in range(100):
            w = list(base)
            for i in rnd.sample(range(300), 5):
                w[i] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(w))
        out.append(out[-1] + " tail")
    return out


def test_near_copies_where_no_leader_has_any(spark):
    rows = lonely()
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(documents(spark, list(enumerate(rows))), block=16).collect()}
    assert got == dict(enumerate(components_of(rows, 5)))


def test_empty_registers_borrow():
    import numpy as np

    rnd = np.random.default_rng(2)
    hits = []
    for _ in range(300):
        common, one, two = (np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (16, 2, 2))
        rows = near_dedup.filled(near_dedup.registers([np.sort(np.r_[common, x]) for x in (one, two)]))
        assert (rows != near_dedup.EMPTY).all()
        hits.append((rows[0] == rows[1]).mean())
    assert abs(np.mean(hits) - 0.8) < 0.02
    assert (near_dedup.filled(near_dedup.registers([common[:0]])) == near_dedup.EMPTY).all()


def thue_morse(n, one="a", other="b"):
    return "".join(other if bin(i).count("1") % 2 else one for i in range(n))


A, B = thue_morse(2048), thue_morse(2048, "b", "a")


def test_words_of_thue_and_morse_are_told_apart(spark):
    docs = documents(spark, [(1, A), (2, B), (5, A + " x")])
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()} == {1: 1, 2: 2, 5: 5}
    item = spark.createDataFrame([(7, A)], "item_id long, text string")
    assert {r.row.doc_id: r.n_hit for r in decontamination.decontaminate(docs, item).collect()} == {1: 1, 2: 0, 5: 1}
    rows = {r.doc_id: r for r in lm_scoring.lm_scores(documents(spark, [(i, A if i else B) for i in range(12)])).collect()}
    held = [i for i in rows if not rows[i].held_out]
    assert all(rows[i].n_known == (1 + (sum(j > 0 for j in held) > 0 if i else 0 in held)) for i in rows)
    kept = {r.doc_id: len(r.kept) for r in substring_dedup.remove_repeats(documents(spark, [(1, A[:1000]), (2, "z" * 399 + B[:1]), (3, A[:399])])).collect()}
    assert kept[2] == 400 and kept[3] == 399


def test_hashes_of_equal_words_are_equal_wherever_they_stand():
    import numpy as np

    data = ("ab " * 3 + "x" * 70 + " " + "y" * 9 + " ab " + "x" * 70 + " " + "y" * 9).encode()
    words = Words(np.frombuffer(data, dtype=np.uint8), np.array([0, 4, len(data)]), ALNUM)
    of = {}
    for s, e, h in zip(words.start, words.end, words.hash, strict=True):
        of.setdefault(bytes(data[s:e]), set()).add(int(h))
    assert all(len(v) == 1 for v in of.values()) and len({next(iter(v)) for v in of.values()}) == len(of)


def test_lines_of_one_template(spark):
    rnd = random.Random(3)
    lines = [f"entry {i:03d} of the long list of entries, page {i % 7}" for i in range(120)]
    lines += ["x" * 60 + "".join(rnd.choice("abcd") for _ in range(6)) for _ in range(60)]

    def near(a, b, k=2):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1] <= k

    distinct = sorted(set(lines))
    links = {a: sum(near(a, b) for b in distinct if b != a) for a in distinct}
    got = line_dedup.line_dedup(documents(spark, [(i, t) for i, t in enumerate(lines)])).collect()
    assert all(r.links == links[lines[r.doc_id]] for r in got)


def _candidates(spark, monkeypatch, lines):
    """How many pairs of lines the operator compares: as many as are linked if all of these are."""
    seen = []
    saved = line_dedup.saved

    def noted(df, tag):
        out = saved(df, tag)
        if tag == "links":
            seen.append(out.count())
        return out

    with monkeypatch.context() as m:
        m.setattr(line_dedup, "saved", noted)
        m.setattr(line_dedup, "AT_ONCE", 0, raising=False)
        m.setattr(line_dedup, "within", lambda a, b, edits: F.lit(True))
        line_dedup.line_dedup(documents(spark, list(enumerate(lines)))).count()
    return seen[0]


def test_templates_do_not_make_all_pairs(spark, monkeypatch):
    rnd = random.Random(21)
    lines = [f"order {''.join(rnd.sample('0123456789', 10))} has been shipped from the second warehouse" for _ in range(800)]
    lines += ["нет " + "".join(rnd.choice("абвгдежз") for _ in range(12)) + " и так далее" for _ in range(400)]
    few = _candidates(spark, monkeypatch, lines[:400] + lines[800:1000])
    many = _candidates(spark, monkeypatch, lines)
    assert few < 10 * 600 and many < 10 * len(lines), (few, many)


def test_links_in_divided_crowds(spark, monkeypatch):
    rnd = random.Random(22)

    def edited(s, n):
        s = list(s)
        for _ in range(n):
            at = rnd.randrange(len(s) + 1)
            kind = rnd.randrange(3)
            s[at : at + (kind > 0)] = rnd.choice("abé1 ") if kind < 2 else ""
        return "".join(s)

    base = "".join(rnd.choice("abcdefgh ") for _ in range(50))
    lines = {edited(base, rnd.randint(0, 5)) for _ in range(150)}
    lines |= {edited("ab" * 12, rnd.randint(0, 4)) for _ in range(100)} | {edited("a" * 15, rnd.randint(0, 4)) for _ in range(60)}
    lines |= {base[:20] + f"{i:02d}" + base[20:] + "z" * (i % 3) for i in range(50)}
    lines = sorted(lines)

    def near(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1] <= 2

    links = [0] * len(lines)
    for i, a in enumerate(lines):
        for j in range(i):
            if abs(len(a) - len(lines[j])) <= 2 and near(a, lines[j]):
                links[i] += 1
                links[j] += 1
    for few in (2, 16):
        with monkeypatch.context() as m:
            m.setattr(line_dedup, "FEW", few)
            m.setattr(line_dedup, "AT_ONCE", 0)
            got = line_dedup.line_dedup(documents(spark, list(enumerate(lines)))).collect()
        assert {r.doc_id: r.links for r in got} == dict(enumerate(links))
