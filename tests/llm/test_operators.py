import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.data import documents, empty, texts
from weft.llm import decontamination, exact_dedup, line_dedup, lm_scoring, mixing, near_dedup, quality, sharding, substring_dedup, toxicity

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(spark):
    """Documents with distinct ids only, for comparisons by id."""
    return documents(spark, [(i, t) for i, t in enumerate(texts())])


def items(spark):
    t = texts()
    rows = [(1, t[8]), (2, "two words"), (3, None), (4, ""), (5, "Unïque?"), (5, t[20]), (None, "one"), (7, t[8])]
    return spark.createDataFrame(rows, "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(40)] + [(41, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "shard": lambda s, d: sharding.shard(d, 5),
    "remove_repeats": lambda s, d: substring_dedup.remove_repeats(d),
    "exact_dedup": lambda s, d: exact_dedup.exact_dedup(d),
    "near_dedup": lambda s, d: near_dedup.near_dedup(d),
    "lm_scores": lambda s, d: lm_scoring.lm_scores(d),
    "decontaminate": lambda s, d: decontamination.decontaminate(d, items(s)),
    "mix": lambda s, d: mixing.mix(d),
    "quality": lambda s, d: quality.score(d, quality.fit(d, labels(s))),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row_whatever_the_rows(spark, name):
    docs = documents(spark)
    assert OPERATORS[name](spark, docs).count() == docs.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).count() == 0


def test_empty_side_tables(spark):
    docs = plain(spark)
    assert decontamination.decontaminate(docs, items(spark).limit(0)).filter("n_hit > 0").count() == 0
    none = labels(spark).limit(0)
    assert quality.score(docs, quality.fit(docs, none)).filter("score is null").count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, none)).filter("score is null").count() == 0


def test_line_dedup_of_odd_and_empty_tables(spark):
    assert line_dedup.line_dedup(empty(spark)).count() == 0
    docs = documents(spark)
    rows = line_dedup.line_dedup(docs)
    assert rows.count() == sum((r.text or "").count("\n") + 1 for r in docs.collect() if r.text is not None)


def test_shards_are_the_best_possible(spark):
    rows = sharding.shard(plain(spark), 7).collect()
    atoms = {}
    for i, t in enumerate(texts()):
        first, size = atoms.get(t or "", (i, 0))
        atoms[t or ""] = (first, size + len((t or "").encode()) + 16)
    sizes = [s for _, s in sorted(atoms.values())]

    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= 7

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
    per = collections.defaultdict(int)
    slots = collections.defaultdict(list)
    for r in rows:
        per[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(per.values()) == best
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_cut_with_hidden_boundaries(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LOOK", 16)
    rnd = random.Random(2)
    sizes = [rnd.randint(1, 50) for _ in range(3000)]
    ends = np.cumsum(sizes).tolist()
    capacity, cuts = sharding.cut(spark.createDataFrame([(e,) for e in ends], "end long"), ends[-1], max(sizes), 11)
    assert set(cuts) <= set(ends) and max(np.diff([0, *cuts, ends[-1]])) <= capacity

    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= 11

    assert fits(capacity) and not fits(capacity - 1)


def test_suffix_array_and_common_prefixes():
    rnd = random.Random(1)
    for _ in range(400):
        t = [rnd.randint(1, rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 50))] + [0]
        sa = substring_dedup.suffix_array(t)
        assert sa == sorted(range(len(t)), key=lambda i: t[i:])
        shared = substring_dedup.common(t, sa)
        for r in range(1, len(t)):
            a, b = t[sa[r - 1] :], t[sa[r] :]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert shared[r] == n


@pytest.mark.parametrize("length,crowd", [(40, 1024), (40, 2), (400, 1024)])
def test_repeats_against_all_windows(spark, monkeypatch, length, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    rnd = random.Random(4)
    motif = "".join(rnd.choice("abc") for _ in range(3 * length))
    rows = []
    for i in range(30):
        a, b = sorted(rnd.sample(range(3 * length), 2))
        noise = "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, length)))
        rows.append((i, noise + motif[a:b] + noise[::-1] + "é" * (i % 3)))
    rows += [(30, "ab" * length), (31, "ab" * (length // 4)), (32, rows[0][1]), (33, None)]
    raw = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    # crowd is read in the tasks' own process; the expected result does not depend on it
    for r in substring_dedup.remove_repeats(documents(spark, rows), length).collect():
        b = raw[r.doc_id]
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        assert bytes(r.kept) == bytes(x for x, g in zip(b, gone, strict=True) if not g), r.doc_id
        assert r.n_bytes == len(b)


def test_exact_dedup_with_hot_text(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_SAMPLE", 1.0)
    rows = [(i, "the  same\ttext") for i in range(200)] + [(200 + i, f"text {i % 40}") for i in range(80)] + [(500, None), (501, "")]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(documents(spark, rows)).collect()}
    assert all(got[i].keep_id == 0 and got[i].group_size == 200 and got[i].kept == (i == 0) for i in range(200))
    assert got[200].group_size == 2 and got[240].keep_id == 200 and got[501].keep_id == 500
    assert got[0].text_sha256 == hashlib.sha256(b"the same text").hexdigest()


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup_against_all_pairs(spark, k):
    sets = {}
    for i, t in enumerate(texts()):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                common = len(sets[i] & sets[j])
                if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    for r in near_dedup.near_dedup(plain(spark), words=k).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), low[r.doc_id], low[r.doc_id] == r.doc_id)


def test_estimate_is_near_the_similarity():
    rnd = np.random.default_rng(3)
    pool = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    a, b = np.unique(pool[:2600]), np.unique(pool[400:])
    rows = near_dedup.registers([a, b])
    guess, used = near_dedup.estimates(rows[0], len(a), rows[1:], np.array([len(b)]))
    assert used[0] == 128 and abs(guess[0] - 2200 / 3000) < 0.15


def test_base_score_and_distribution(spark):
    docs = plain(spark)
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs).collect()}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\n"] for i, t in enumerate(texts())}
    count = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n = sum(count.values())
    for i, ws in tokens.items():
        base = sum(math.log10((count[w] + 1) / (n + len(count) + 1)) for w in ws)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_tree_is_the_mixture_of_all_depths():
    """Against the definition, by recursion over contexts, on a tiny text with all contexts kept."""
    text = b"\n" * lm_scoring.DEPTH + b"abracadabra\n"
    depth = lm_scoring.DEPTH
    pairs = collections.Counter()
    for i in range(depth, len(text)):
        for d in range(depth + 1):
            pairs[(d, int.from_bytes(text[i - d : i], "big"), text[i])] += 1
    levels = []
    for d in range(depth + 1):
        rows = [(c, b, n) for (x, c, b), n in pairs.items() if x == d]
        levels.append(lm_scoring.level(*[np.array(v, dtype=np.int64) for v in zip(*rows, strict=True)]))
    tree = lm_scoring.build(levels)
    assert np.allclose((10.0 ** tree.log10.astype(float)).sum(1), 1, atol=1e-4)

    def kt(zeros, ones):
        p = 1.0
        for i in range(zeros):
            p *= (i + 0.5) / (i + 1)
        for i in range(ones):
            p *= (i + 0.5) / (zeros + i + 1)
        return p

    def bits(context, node):
        d = len(context)
        k = node.bit_length() - 1
        zeros = ones = 0
        for (x, c, b), n in pairs.items():
            if x == d and c == int.from_bytes(context, "big") and (b | 256) >> (8 - k) == node:
                if b >> (7 - k) & 1:
                    ones += n
                else:
                    zeros += n
        return zeros, ones

    def longer(context):
        d = len(context) + 1
        return [c.to_bytes(d, "big") for x, c, _ in {(x, c, 0) for x, c, _ in pairs} if x == d and c.to_bytes(d, "big")[1:] == context] if d <= depth else []

    def weighted(context, node):
        own = kt(*bits(context, node))
        if len(context) == depth:
            return own
        product = 1.0
        for c in longer(context):
            product *= weighted(c, node)
        return 0.5 * own + 0.5 * product

    def estimate(context, node, upto=0):
        """P(one) at the node, contexts being the suffixes of `context` from length upto on."""
        part = context[len(context) - upto :]
        zeros, ones = bits(part, node)
        own = (ones + 0.5) / (zeros + ones + 1)
        if upto == depth:
            return own
        w = 0.5 * kt(zeros, ones) / weighted(part, node)
        if context[len(context) - upto - 1 :] not in longer(part):
            deeper = 0.5
        else:
            deeper = estimate(context, node, upto + 1)
        return w * own + (1 - w) * deeper

    stream = np.frombuffer(text, dtype=np.uint8)
    scores = tree.score(stream)
    for i in (depth, depth + 3, depth + 7, len(text) - 1):
        p, node = 1.0, 1
        for k in range(7, -1, -1):
            one = estimate(text[i - depth : i], node)
            bit = text[i] >> k & 1
            p *= one if bit else 1 - one
            node = node * 2 + bit
        assert scores[i - depth] == pytest.approx(math.log10(p), abs=1e-4)


def test_decontamination_against_scanning(spark):
    found = {r.row.doc_id: r for r in decontamination.decontaminate(plain(spark), items(spark)).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    patterns = collections.defaultdict(set)
    for r in items(spark).collect():
        w = split(r.text)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[j : j + n])] |= {r.item_id} - {None}  # one without id is found, but not named
    for i, t in enumerate(texts()):
        w, hit, ids = split(t), set(), set()
        for p, owners in patterns.items():
            for j in range(len(w) - len(p) + 1):
                if tuple(w[j : j + len(p)]) == p:
                    hit |= set(range(j, j + len(p)))
                    ids |= owners
        assert (found[i].n_words, found[i].n_hit, list(found[i]["items"])) == (len(w), len(hit), sorted(ids)), i


def test_decontamination_in_blocks_is_the_same(spark, monkeypatch):
    whole = decontamination.decontaminate(plain(spark), items(spark)).select("row.doc_id", "n_hit", "spans", "items").orderBy("doc_id").collect()
    monkeypatch.setattr(decontamination, "MOST_PATTERNS", 7)
    parts = decontamination.decontaminate(plain(spark), items(spark)).select("row.doc_id", "n_hit", "spans", "items").orderBy("doc_id").collect()
    assert whole == parts and any(r.n_hit for r in whole)


def test_mix_takes_near_the_targets(spark):
    rows = mixing.mix(documents(spark)).collect()
    assert all(0 <= r.copies <= 2 for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 2 * max(r.size for r in own)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(documents(spark).repartition(3)).collect()), key=str)


def test_quality_separates_and_is_calibrated(spark):
    rnd = random.Random(8)
    good = lambda: " ".join(rnd.choice(["the", "of", "river", "stone", "light", "house"]) for _ in range(60))
    bad = lambda: " ".join(rnd.choice(["%%%", "###", "BUY", "click|", "$$$"]) for _ in range(60))
    docs = documents(spark, [(i, good() if i % 3 else bad()) for i in range(400)] + [(400, ""), (401, None)])
    known = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, known)).select("row.doc_id", "score").collect()
    right = [(r.score >= 0.3) == (r.doc_id % 3 > 0) for r in got if r.doc_id < 400]
    assert sum(right) >= 395
    assert len({r.score for r in got if r.doc_id >= 400}) == 1


def test_toxicity_finds_the_sentence(spark):
    rnd = random.Random(9)
    calm = lambda: " ".join(rnd.choice(["the", "of", "river", "stone", "light", "house"]) for _ in range(8))
    rows = []
    for i in range(400):
        s = [calm() for _ in range(6)]
        if i % 4 == 0:
            s[i % 6] += " you idiotic " + rnd.choice(["fool", "thing"])
        rows.append((i, ". ".join(s) + "."))
    docs = documents(spark, rows + [(400, None), (401, "...")])
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, known)).select("row.doc_id", "row.text", "score", "offending").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id < 400)
    for r in got:
        for s in r.offending:
            assert "idiotic" in r.text.encode()[s.start : s.end].decode()
        assert bool(r.offending) == (r.score >= 0.5)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_banded_distance(spark):
    rnd = random.Random(5)
    rows = [("", ""), ("", "a"), ("abc", "")]
    for _ in range(400):
        a = "".join(rnd.choice("abé漢") for _ in range(rnd.randint(0, 12)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            b.insert(rnd.randint(0, len(b)), rnd.choice("abé")) if rnd.random() < 0.5 or not b else b.pop(rnd.randrange(len(b)))
        rows.append((a, "".join(b)))
    for edits in (1, 2, 3):
        got = spark.createDataFrame(rows, "a string, b string").withColumn("w", line_dedup.within(F.col("a"), F.col("b"), edits)).collect()
        assert all(r.w == (distance(r.a, r.b) <= edits) for r in got)


def test_line_links_against_all_pairs(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(40):
        lines = []
        for _ in range(6):
            base = random.Random(rnd.randrange(12))
            s = [base.choice("abcdeé ") for _ in range(base.randint(20, 60))]
            for _ in range(rnd.randint(0, 2)):
                s[rnd.randrange(len(s))] = rnd.choice("abxyz")
            lines.append("".join(s))
        rows.append((i, "\n".join(lines)))
    where = collections.defaultdict(list)
    for i, t in rows:
        for j, line in enumerate(t.split("\n")):
            where[line].append((i, j))
    nodes = list(where)
    links, up = collections.Counter(), {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if distance(a, b) <= 2:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                if x != y:
                    up[x] = y
    first = {}
    for x in nodes:
        first[root(x)] = min(first.get(root(x), (1e9, 0)), min(where[x]))
    expected = {p: (*first[root(x)], len(where[x]), links[x]) for x in nodes for p in where[x]}
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.copies, r.links) for r in line_dedup.line_dedup(documents(spark, rows)).collect()}
    assert got == expected and sum(links.values()) > 20


def test_tree_keeps_every_context(spark):
    """Scores equal those of the whole tree, built in one place, of more than 32768 contexts."""
    rnd = random.Random(11)
    rows = [(i, "".join(rnd.choice("abcdefghij klmnopqrstuvwxyzé") for _ in range(500))) for i in range(60)] + [(60, None), (61, " "), (62, "ab" * 300)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    raw = {i: b"\n" * lm_scoring.DEPTH + (" ".join(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))) + "\n").encode() for i, t in rows}
    levels = []
    for d in range(lm_scoring.DEPTH + 1):
        counts = collections.Counter((int.from_bytes(b[j - d : j], "big"), b[j]) for i, b in raw.items() if not held[i] for j in range(lm_scoring.DEPTH, len(b)))
        levels.append(lm_scoring.level(*(np.array(v, dtype=np.int64) for v in zip(*((c, x, n) for (c, x), n in counts.items()), strict=True))))
    assert sum(len(v.contexts) for v in levels) > 1 << 15 and any(held.values())
    tree = lm_scoring.build(levels)
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(documents(spark, rows)).collect()}
    for i, b in raw.items():
        assert got[i] == pytest.approx(tree.score(np.frombuffer(b, dtype=np.uint8)).sum(dtype=float), rel=1e-4), i


def test_chunks_of_grams_change_nothing(monkeypatch):
    rnd = np.random.default_rng(5)
    grams = np.sort(rnd.choice(np.array([97, 98, 99]), (4000, lm_scoring.DEPTH + 1)) @ (1 << 8 * np.arange(lm_scoring.DEPTH, -1, -1)))
    batches = [pa.RecordBatch.from_arrays([pa.array(g), pa.array(g % 3)], names=["gram", "n"]) for g in np.split(grams, 40)]

    def made(chunk):
        monkeypatch.setattr(lm_scoring, "CHUNK", chunk)
        rows = list(lm_scoring._mixes(iter(batches)))
        p = [np.frombuffer(r.column("p")[0].as_py(), dtype=np.float32).reshape(8, -1) for r in rows]
        return len(rows), b"".join(r.column("grams")[0].as_py() for r in rows), np.concatenate(p, axis=1)

    (one, whole, p), (several, parts, q) = made(1 << 20), made(150)
    assert one == 1 and several > 5 and whole == parts and np.allclose(p, q)


def test_short_lines_are_linked_too(spark):
    rnd = random.Random(12)
    lines = {"".join(rnd.choice("abé1-") for _ in range(rnd.randint(0, 7))) for _ in range(150)} | {"", "a", "漢"}
    for n in (8, 12, 22, 23, 24, 25):
        base = "".join(rnd.choice("abcdefgh") for _ in range(n))
        lines |= {base, base[1:], base[:3] + "x" + base[4:], base[:2] + base[3:] + "y", base + "z"}
    lines = sorted(lines)
    links = {a: sum(a != b and distance(a, b) <= 2 for b in lines) for a in lines}
    got = line_dedup.line_dedup(documents(spark, [(i, x) for i, x in enumerate(lines)])).collect()
    assert {lines[r.doc_id]: r.links for r in got} == links and any(links[x] for x in lines if len(x) == 23)


def test_columns_with_odd_names(spark):
    docs = plain(spark).withColumnsRenamed({"row": "my col", "key": "a.b", "digest": "c`d", "label": "SELECT"})
    names = docs.columns
    found = [
        decontamination.decontaminate(docs, items(spark)),
        quality.score(docs, quality.fit(docs, labels(spark))),
        toxicity.score(docs, toxicity.fit(docs, labels(spark))),
    ]
    assert all(f.select("row.*").columns == names and f.count() == docs.count() for f in found)


def test_quality_without_labels_is_undecided(spark):
    docs = plain(spark)
    scores = quality.score(docs, quality.fit(docs, labels(spark).limit(0))).select("score").distinct().collect()
    assert [r.score for r in scores] == [0.5]
