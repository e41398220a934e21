"""SimHash near copies, periodic runs and prefix tries against plain versions of themselves."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.data import documents, empty, texts
from weft.llm import line_dedup, lm_scoring, near_dedup, periodic_runs, prefix_trie, registry, simhash_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, k=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    some = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_groups(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    low = list(range(len(rows)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return collections.Counter((k, f"{prints[i]:016x}", least.get(find(i))) for i, (k, _) in enumerate(rows))


def variants():
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(300)}" for _ in range(60)]
    out = [(None, "x y"), (1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a  B"), (5, "a  B"), (None, "x y")]
    for i in range(200):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2])):
            w[rnd.randrange(60)] = f"x{rnd.randrange(1000)}"
        out.append((i + 6, " ".join(w)))
    return out


@pytest.mark.parametrize("crowd", [2, 5, 128])
def test_simhash_components_against_all_pairs(spark, crowd):
    rows = variants()
    got = simhash_dedup.simhash_dedup(documents(spark, rows), crowd=crowd).collect()
    assert collections.Counter(tuple(r) for r in got) == plain_groups(rows)


def test_fingerprints_of_long_and_odd_texts(spark):
    long = " ".join(f"W{i % 977}" for i in range(150_000))  # over a megabyte, several rounds
    for t in [*texts(), long]:
        assert simhash_dedup.fingerprint((t or "").encode()) == plain_fingerprint(t)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)
    assert simhash_dedup.simhash_dedup(empty(spark)).count() == 0


def test_links_under_any_grid():
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 2**63, 200, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rnd.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 200, dtype=np.uint64))
    low = np.uint64(simhash_dedup.LOW)
    counts = lambda v: ((v | v >> np.uint64(1)) & low) | ((v & v >> np.uint64(1) & low) << np.uint64(1))
    assert (np.bitwise_count(counts(x) ^ counts(y)) <= np.bitwise_count(x ^ y)).all()


def plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                if not any(q % d == 0 and all(w[x] == w[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                    out.add((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rnd):
    k = rnd.choice([1, 2, 3, 5, 50])
    w = [rnd.randrange(k) for _ in range(rnd.randint(0, 120))]
    for _ in range(rnd.randint(0, 3)):
        q = rnd.randint(1, 40)
        root = [rnd.randrange(k) for _ in range(q)]
        if rnd.random() < 0.3:
            root = (root[: max(1, q // 5)] * 9)[:q]
        at = rnd.randint(0, len(w))
        w[at:at] = [root[i % q] for i in range(rnd.randint(2 * q, 7 * q))]
    return w


def test_runs_against_all_periods():
    rnd = random.Random(3)
    for _ in range(300):
        some = [repetitive(rnd) for _ in range(rnd.randint(1, 4))]
        n = len(some)
        ids = np.array([x for k, w in enumerate(some) for x in [*(y + n for y in w), k]], dtype=np.int64)
        sizes = np.array([len(w) for w in some])
        start = np.cumsum(sizes + 1) - sizes - 1
        want = sorted((a + int(start[k]), a + int(start[k]) + m, q) for k, w in enumerate(some) for a, m, q in plain_runs(w))
        assert sorted(periodic_runs.runs_of(ids, sizes)) == want


def collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def test_runs_of_documents(spark):
    rnd = random.Random(4)
    rows = [(i, "\t ".join(f"é{x}" for x in repetitive(rnd))) for i in range(60)] + [(None, None), (None, "a " * 9), (3, ""), (3, " \n"), (9, "b b b b b b" + " c d" * 70_000)]
    got = collections.Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periodic_runs.periodic_runs(documents(spark, rows)).collect())
    want = collections.Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        runs = plain_runs(w) if len(w) < 9000 else [(0, 6, 1), (6, 140_000, 2)]
        want[(i, len(w), tuple(runs), collapsed(w, runs) if len(w) < 9000 else "b c d")] += 1
    assert got == want
    assert periodic_runs.periodic_runs(empty(spark)).count() == 0


def test_query_of_runs_ends_texts_in_loops(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 50))) for i in range(300)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in registry.op12_periodic_runs(spark, str(tmp_path)).collect():
        w = [f"w{j}" for j in range(r.doc_id % 50)]
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()


def plain_trie(convs):
    members, below = collections.defaultdict(list), collections.defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    for k in members:
        if k:
            below[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in below[k]) or 1
        saved[k] = sum(saved[x] for x in below[k]) + (len(members[k]) - 1) * (len(WORD.findall(k[-1][1])) if k else 0)
    ends = {k: ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k)))) for k, m in members.items()}
    return collections.Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(below[k]), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()
    )


def conversations():
    rnd = random.Random(5)
    out = {c: [(rnd.choice("ua"), rnd.choice(["", "a b", "c", "d e f"])) for _ in range(rnd.choice([1, 1, 2, 3, 4, 8, 30]))] for c in range(150)}
    return out | {c: out[17] for c in range(300, 340)}


def turns(spark, convs):
    rows = [(c, None if i == 0 else i, r or None, t or None, 7) for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    random.Random(6).shuffle(rows)
    return spark.createDataFrame([*rows, (None, 0, "u", "x", 7)], "conv_id long, turn long, role string, text string, depth int")


def counted(df):
    return collections.Counter(tuple(r) for r in df.select(*prefix_trie.NODE).collect())


def test_trie_against_a_plain_one(spark):
    convs = conversations()
    assert counted(prefix_trie.prefix_trie(turns(spark, convs))) == plain_trie(convs)


def test_trie_with_a_crowded_sketch(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MOST_CELLS", 16)  # estimates of one are rare then
    convs = conversations()
    assert counted(prefix_trie.prefix_trie(turns(spark, convs))) == plain_trie(convs)


def test_query_of_tries_lends_first_turns(spark, tmp_path):
    convs = conversations() | {c: [("u", "alone")] for c in range(341, 350)}  # without a host
    turns(spark, convs).write.parquet(f"{tmp_path}/conversations.parquet")
    head = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    rebuilt = {c: convs.get(c - c % 20, [])[: head[c]] + t[head[c] :] for c, t in convs.items()}
    assert any(not t for t in rebuilt.values())
    assert counted(registry.op13_prefix_trie(spark, str(tmp_path))) == plain_trie(rebuilt)


def test_tries_of_nothing_and_of_equal_turns(spark):
    some = turns(spark, {4: [("u", "x")]})
    assert prefix_trie.prefix_trie(some.limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, 0, "u", "x"), (1, 0, "u", "x"), (1, 0, "a", "y"), (2, 3, "u", "x")], "conv_id long, turn long, role string, text string")
    nodes = counted(prefix_trie.prefix_trie(repeated))
    assert sum(nodes.values()) in (4, 5) and max(n[1] for n in nodes) == 3


def test_words_made_to_share_a_hash(spark):
    one, two = "tixlzwxuqaoyhubf", "vybloqjbbg?da}x_"
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_dedup(docs).collect()} == {1, 2}
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][0]
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][0]
    rows = {r.doc_id: r for r in lm_scoring.lm_scores(spark.createDataFrame([(train, one), (held, two)], "doc_id long, text string")).collect()}
    assert rows[held].n_known == 1 and rows[train].n_known == 2
    assert rows[held].bits_per_byte > rows[train].bits_per_byte > 0


def test_toxicity_without_labels_is_even(spark):
    docs = spark.createDataFrame([(1, "one. two"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}


def lines_with_one_hash():
    """Two lines of 64 characters with one 64-bit hash: the second stripe makes up for the first."""
    m, p1, p2 = 2**64, 11400714785074694791, 14029467366897019727
    rnd = random.Random(8)
    word = lambda: bytes(rnd.randrange(97, 123) for _ in range(8))

    def after(block):
        x = (42 + p1 + p2 + int.from_bytes(block, "little") * p2) % m
        return (x << 31 | x >> 33) * p1 % m

    while True:
        a1, b1, a2 = word(), word(), word()
        b2 = ((int.from_bytes(a2, "little") + (after(a1) - after(b1)) * pow(p2, -1, m)) % m).to_bytes(8, "little")
        if all(32 <= c < 127 for c in b2):
            rest = b"x" * 24
            return (a1 + rest + a2 + rest).decode(), (b1 + rest + b2 + rest).decode()


def test_lines_made_to_share_a_hash(spark):
    one, two = lines_with_one_hash()
    assert one != two and xxhash.xxh64_intdigest(one.encode(), 42) == xxhash.xxh64_intdigest(two.encode(), 42)
    docs = spark.createDataFrame([(1, one + "\n" + one), (2, two), (3, two[:-1] + "y")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.copies, r.links, r.kept) for r in line_dedup.line_dedup(docs).collect()}
    first = min(n for d, n in got if d == 1)
    assert got[(1, first)] == (1, 2, 0, True) and got[(2, first)] == (2, 1, 1, True) and got[(3, first)] == (2, 1, 1, False)
