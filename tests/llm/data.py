"""Small documents with everything that is awkward in them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size string, digest string, shard string, spans string, label string, `__n` string"


def words(rnd, n, of=400):
    return [f"w{rnd.randrange(of)}" for _ in range(n)]


def texts(seed=7):
    rnd = random.Random(seed)
    base = [" ".join(words(rnd, rnd.randint(1, 60))) for _ in range(25)]
    out = [None, "", " ", "\t\n", "é", "one", "two words", "Ünïcode Straße ÉÉ 漢字 漢字", base[0], base[0], base[1], base[1].upper(), base[2].replace(" ", "  \t")]
    out += base[2:]
    long = " ".join(words(rnd, 4000, 3000))
    out += [long, long + " tail", "shared start " + long[3000:6000] + " shared end"]
    near = words(rnd, 80)
    for i in range(6):
        w = list(near)
        w[10 * i] = f"new{i}"
        out.append(" ".join(w))
    out += ["\n".join(["line number one of the test text", "line number one of the test tent", "short", "short"])] * 2
    return out


def documents(spark, rows=None):
    """Documents with null ids, repeated ids and rows, and columns whose names clash."""
    if rows is None:
        rows = [(i, t) for i, t in enumerate(texts())]
        rows += [(None, "a text without id that is long enough to be something"), (3, "\t\n"), (8, rows[8][1]), (None, None)]
    full = [(i, t, "en", [None, "b", "a", "ä"][(i or 0) % 4], len(t or ""), "r", "k", "s", "d", "h", "p", "l", "n") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
