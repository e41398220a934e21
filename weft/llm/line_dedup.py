"""Line deduplication by a segment-partition edit join (DataFrame functions only).

Lines within EDITS edits of each other are linked. A line is split into EDITS + 1 segments,
at least one of which a linked line holds unchanged, at nearly the same place: segments
index the lines by length, and each line probes them with its substrings at the few
positions that its length and EDITS allow. Lines of fewer characters than segments are found
by the characters, in order, that a linked line must share with them. Of the lines that meet
at a segment, many are divided by segments of the rest, again and again; of the few that
meet in the end only those become candidates whose counts of letters and digits allow it;
these are verified by a banded bit-parallel edit distance: the states of the band are bits
of one number per error count.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._groups import components
from weft.llm._store import partitions, saved

EDITS = 2
#: Characters after the first difference by which most candidates are refused.
HEAD = 32
#: Keys under which more lines are held are divided by what is left of the lines.
FEW = 16
#: What makes fewer pairs than this, or than there are rows, is compared at once instead.
AT_ONCE = 1 << 16
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def looks(edits: int) -> list[tuple[int, int, int, int]]:
    """What a line enters or looks up: characters fewer, segment, shift, and 1 for entering.

    Segment i of a line that is d characters shorter may stand in this line shifted by at
    most i characters and, seen from the end, by at most edits - i, of which d are due to
    the lengths. An entry is looked up by itself, too.
    """
    own = [(0, i, 0, 1) for i in range(edits + 1)]
    others = [
        (d, i, shift, 0)
        for d in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)
        if d or shift
    ]
    return own + others


def short_looks(edits: int) -> list[tuple[int, tuple[int, ...], int]]:
    """Line length, places of characters, and 1 for entering, where the shorter line has at
    most `edits` characters.

    Of a line with n characters at least n - edits stay, in order, in any line linked with
    it; one of up to `edits` characters can be turned into any other such line.
    """
    own = [(n, at, 1) for n in range(edits + 1) for r in range(n + 1) for at in combinations(range(1, n + 1), r)]
    return own + [(n, at, 0) for n in range(edits + 1, 2 * edits + 1) for at in combinations(range(1, n + 1), n - edits)]


def _placed(rows: DataFrame, edits: int) -> DataFrame:
    """Rows (line, length and the look's d, i, s) with the looked-up line's length and the piece's place.

    A line has edits + 1 segments of equal size, or one more character in the later ones;
    base is the size of the first.
    """
    count = edits + 1
    rows = rows.withColumn("other", F.col("length") - F.col("d")).filter(F.col("other") > edits)
    rows = rows.withColumns({"base": F.floor(F.col("other") / count).cast("int"), "long_from": count - F.col("other") % count})
    rows = rows.withColumn("size", F.col("base") + F.when(F.col("i") >= F.col("long_from"), 1).otherwise(0))
    rows = rows.withColumn("at", F.col("i") * F.col("base") + F.greatest(F.col("i") - F.col("long_from"), F.lit(0)) + 1 + F.col("s"))
    return rows.filter((F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.col("length"))).drop("long_from")


def _looks(edits: int) -> Column:
    """All looks as structs: d, i, s, h and their number."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("dish", x, strict=True)], F.lit(k).alias("look")) for k, x in enumerate(looks(edits))])


def keys(lines: DataFrame, edits: int) -> DataFrame:
    """node, key, look of (node, line, length): one row per look.

    look is the number in looks(), of short lines -1, or -2 for entering.
    """
    few = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit("short"), F.lit(len(at)), F.concat(F.lit(""), *[F.substring("line", k, 1) for k in at])).alias("key"), F.lit(-1 - h).alias("look"))
            for n, at, h in short_looks(edits)
        ]
    )
    short = lines.filter(F.col("length") <= 2 * edits).select("node", "length", F.explode(few).alias("x")).filter("x.n = length").select("node", "x.key", "x.look")
    rows = lines.select("node", "line", "length", F.explode(_looks(edits)).alias("x")).select("node", "line", "length", "x.*")
    piece = F.substring("line", F.col("at"), F.col("size"))
    return _placed(rows, edits).select("node", F.xxhash64("other", "i", piece).alias("key"), "look").unionByName(short)


def _blocks(edits: int) -> list[int]:
    """Masks of the bits of counts in blocks, one of which is the same in lines within `edits` edits.

    Frequent letters are dealt over the blocks.
    """
    out = [0] * (2 * edits + 1)
    for k, c in enumerate("etaoinshrdlucmfwypvbgkjqxz"):
        out[k % len(out)] |= 3 << 2 * LETTERS.index(c)
    for k in range(len(DIGITS)):
        out[k % len(out)] |= 1 << 2 * len(LETTERS) + k
    return out


def _rest() -> Column:
    """The line without the pieces in cuts, each counted in what the cuts before it leave."""
    return F.aggregate("cuts", F.col("line"), lambda s, c: F.concat(F.substring(s, F.lit(1), c["at"] - 1), F.substring(s, c["at"] + c["size"], F.char_length(s))))


def _tags(level: int, edits: int) -> dict[str, Column]:
    """One column per earlier segment, by which a pair of a crowded key is known to meet at that segment, too.

    A pair that starts with the same segments need not meet at a later one, nor one that
    has the segment before the last in common with it. Where the earlier segment would be
    looked up at another shift than is allowed, the value is the row's own.
    """
    own = F.xxhash64("node", F.lit("own"))
    out = {f"p{level}": F.when(F.col("i") > 0, F.xxhash64(F.substring("line", F.lit(1), F.col("base"))))}
    if edits == 2:  # at the last segment: that before it, seen from the end
        size = F.col("base") + F.when(F.col("other") % 3 == 2, 1).otherwise(0)
        before = F.xxhash64(F.substring("line", F.col("at") - size, size))
        out[f"q{level}"] = F.when(F.col("i") == 2, F.when(F.col("d") <= 1, before).otherwise(own))
    return out


def crowds(shared: DataFrame, texts: DataFrame, edits: int, most: int, bound: int) -> DataFrame:
    """key, node, held of groups of lines that meet; where more than `most` are held under a key, of its parts.

    Two lines that share a segment are linked only if what is left of them without it is
    within as many edits. So a crowded key is divided by blocks of the counts of letters, of
    which one at least is the same, then by the segments of the rest, with the same looks,
    and what is still crowded by those of its rest, until groups are small or the rest is at
    most `edits` characters (then nearly all of them are links), or until what is still
    crowded makes `bound` pairs at most. A look for lines that much shorter stays one for
    these, and only entries stay entries.
    """
    n = partitions(shared.sparkSession)
    line = texts.select("node", "line")
    masks = _blocks(edits)
    done, tags = [], []

    def crowded(rows: DataFrame) -> DataFrame | None:
        """What is still to be divided of the rows; the others, where lines still meet, go to done."""
        sums = [F.sum("held").alias("n_held"), F.min("node").alias("low"), F.max("node").alias("high"), F.min("rest").alias("least")]
        groups = rows.groupBy("key").agg(*sums, *[f(t).alias(f"{f.__name__}_{t}") for t in tags for f in (F.min, F.max)])
        differ = [f"(min_{t} is null or min_{t} <> max_{t})" for t in tags]
        groups = groups.filter(" and ".join(["n_held > 0 and low <> high", *differ])).select("key", "n_held", ((F.col("n_held") <= most) | (F.col("least") <= edits)).alias("small"))
        rows = saved(rows.join(groups, "key"), "crowd")
        left = rows.filter("not small").agg(F.sum("n_held")).first()[0] or 0
        done.append((rows.filter("small") if left > bound else rows).select("key", "node", "held"))
        return rows.filter("not small").drop("n_held", "small") if left > bound else None

    def cut(rows: DataFrame, level: int) -> DataFrame:
        """Rows with what the tags and cuts of this level are."""
        here = _tags(level, edits)
        rows = rows.withColumns(here)
        tags.extend(here)
        piece = F.struct(F.col("at").cast("int").alias("at"), F.col("size").cast("int").alias("size"))
        return rows.select("key", "node", "held", "d", (F.col("other") - F.col("size")).alias("rest"), F.concat("cuts", F.array(piece)).alias("cuts"), *tags)

    rows = crowded(shared.withColumn("rest", F.when(F.col("look") < 0, 0).otherwise(edits + 1)))  # short lines under one key are nearly all links
    if rows is not None:
        rows = rows.join(texts.select("node", "letters"), "node")
        block = F.posexplode(F.array(*[F.col("letters").bitwiseAND(m) for m in masks])).alias("nth", "block")
        rows = rows.select("key", "node", "held", "look", "rest", "letters", block)
        tags += [f"t{j}" for j in range(len(masks) - 1)]
        rows = rows.withColumns({"key": F.xxhash64("key", "nth", "block"), **{t: F.when(F.col("nth") > j, F.col("letters").bitwiseAND(masks[j])) for j, t in enumerate(tags)}})
        rows = crowded(saved(rows.drop("nth", "block", "letters"), "divided"))
    if rows is not None:
        looked = F.element_at(_looks(edits), F.col("look") + 1)
        rows = rows.join(line, "node").select("key", "node", "held", "line", *tags, F.char_length("line").alias("length"), looked.alias("x")).select("key", "node", "held", "line", "length", *tags, "x.*")
        rows = _placed(rows, edits).withColumn("cuts", F.array().cast("array<struct<at: int, size: int>>"))
        rows = crowded(saved(cut(rows, 0), "divided"))
    level = 0
    while rows is not None:
        level += 1
        rows = rows.join(line, "node").withColumn("line", _rest()).withColumn("length", F.char_length("line")).withColumn("of", F.col("key")).withColumnRenamed("d", "less")
        rows = rows.withColumn("x", F.explode(_looks(edits))).filter("x.d = less").select("of", "node", "line", "length", "held", "cuts", *tags, "x.*")
        piece = F.substring("line", F.col("at"), F.col("size"))
        rows = _placed(rows, edits).withColumns({"key": F.xxhash64("of", "other", "i", piece), "held": F.col("held") * F.col("h")}).repartition(n)
        rows = crowded(saved(cut(rows, level), "divided"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _counts() -> Column:
    """Counts of the letters modulo 4 and of the digits modulo 2, as bits; an edit changes at most two.

    Counts modulo 4 take two bits in Gray code, in which neighbouring counts differ by one bit.
    """
    low = F.lower("line")
    count = lambda c: F.octet_length(low) - F.octet_length(F.replace(low, F.lit(c), F.lit("")))
    gray = lambda n: n.bitwiseXOR(F.shiftright(n, 1)).bitwiseAND(F.lit(3))
    out = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        out = out.bitwiseOR(F.shiftleft(gray(count(c)).cast("long"), 2 * i))
    for i, c in enumerate(DIGITS):
        out = out.bitwiseOR(F.shiftleft((count(c) % 2).cast("long"), 2 * len(LETTERS) + i))
    return out


def _let(values: dict[str, Column], use) -> Column:
    """use(row of the values), each value computed once a row."""
    row = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.element_at(F.transform(F.array(row), use), 1)


def _common(a: Column, b: Column, most: Column) -> Column:
    """Length of the common prefix of a and b, both `most` characters long, by halving."""
    steps = F.transform(F.sequence(F.ceil(F.log2(most + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    same = lambda n, step: F.substring(a, n + 1, step) == F.substring(b, n + 1, step)
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= most) & same(n, step), n + step).otherwise(n))


def _states(left: Column, right: Column, edits: int) -> Column:
    """Bits of the band for `edits` errors after the characters of right, bit-parallel.

    Bit o + edits of state e says that the first j characters of right and the first j + o
    of left are within e edits; left has `edits` fillers in front. Per character of right a
    mask tells which characters of left, in the band around it, are equal; substitution
    keeps the bit's place, an insertion moves it down and a deletion up.
    """
    full = (1 << (2 * edits + 1)) - 1

    def mask(c: Column, j: Column) -> Column:
        out = F.lit(0)
        for o in range(2 * edits + 1):
            out = out + F.when(F.coalesce(F.get(left, j + o), F.lit("")) == c, 1 << o).otherwise(0)
        return out

    start = F.struct(*[F.lit(sum(1 << (o + edits) for o in range(e + 1))).alias(f"e{e}") for e in range(edits + 1)])

    def step(s: Column, same: Column) -> Column:
        states = [s["e0"].bitwiseAND(same)]
        for e in range(1, edits + 1):
            old = s[f"e{e - 1}"]
            new = s[f"e{e}"].bitwiseAND(same).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(states[-1], 1))
            states.append(new.bitwiseAND(F.lit(full)))
        return F.struct(*[x.alias(f"e{e}") for e, x in enumerate(states)])

    return F.aggregate(F.transform(right, mask), start, step, lambda s: s[f"e{edits}"])


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of a and b is at most edits (banded, bit-parallel).

    Common characters in front and at the end change no distance and are cut. What is left
    is read up to HEAD characters first: where no state of the band is alive by then, the
    rest need not be read.
    """

    def letters(s: Column) -> Column:
        return F.filter(F.split(s, ""), lambda c: c != "")

    def decide(v: Column) -> Column:
        filler = F.array_repeat(F.lit(""), edits)
        heads = {"left": F.concat(filler, letters(F.substring(v["a"], 1, HEAD + edits))), "right": letters(F.substring(v["b"], 1, HEAD))}
        alive = _let(heads, lambda h: _states(h["left"], h["right"], edits)) > 0
        whole = {"left": F.concat(filler, letters(v["a"])), "right": letters(v["b"])}
        last = F.char_length(v["a"]) - F.char_length(v["b"]) + edits
        ends = _let(whole, lambda h: _states(h["left"], h["right"], edits)).bitwiseAND(F.element_at(F.array(*[F.lit(1 << o) for o in range(2 * edits + 1)]), last + 1))
        return F.when(alive, ends > 0).otherwise(False)

    def cut(v: Column) -> Column:
        most = F.least(F.char_length(v["a"]), F.char_length(v["b"]))
        front = _common(v["a"], v["b"], most)

        def rest(w: Column) -> Column:
            left = F.least(F.char_length(w["a"]), F.char_length(w["b"]))
            back = _common(F.reverse(w["a"]), F.reverse(w["b"]), left)
            return _let({"a": w["a"], "b": w["b"], "n": back}, lambda x: _let({k: F.substring(x[k], 1, F.char_length(x[k]) - x["n"]) for k in "ab"}, decide))

        return _let({"n": front, "a": v["a"], "b": v["b"]}, lambda x: _let({k: F.substring(x[k], x["n"] + 1, F.char_length(x[k])) for k in "ab"}, rest))

    close = F.abs(F.char_length(a) - F.char_length(b)) <= edits
    return F.when(close, _let({"a": a, "b": b}, cut)).otherwise(False)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line; a null text has no lines, an empty one an empty line."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))


def line_dedup(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: doc_id, line_no, class_doc_id, class_line_no, copies, links, kept.

    Equal lines are one node, and nodes within `edits` edits are linked, whatever their
    length. The class is named by the first line, in order of doc_id and line
    number, that can be reached over links, and only that line is kept. copies counts the
    lines equal to this one, links the different lines linked with it. Null texts have no
    lines; null ids come first. Lines of
    repeated rows are kept together.

    Lines are told apart by 64-bit hashes, and where two share one, by their SHA-256. Of a line held by very many documents only one
    occurrence enters the join.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    every = lines_of(docs, id_col, text_col).withColumn("node", F.xxhash64("line"))
    place = F.struct(F.col("doc_id"), F.col("line_no"))
    check = F.xxhash64(F.sha2("line", 256))

    def counted() -> DataFrame:
        sums = [F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.min(check).alias("low"), F.max(check).alias("high")]
        return saved(every.groupBy("node").agg(*sums), "lines")

    nodes = counted()
    twins = nodes.filter("low <> high").select(F.col("node").alias("twin"))
    if not twins.isEmpty():  # unlike lines with one hash: these go by their SHA-256
        every = every.join(twins, F.col("node") == F.col("twin"), "left")
        every = every.withColumn("node", F.when(F.col("twin").isNull(), F.col("node")).otherwise(F.xxhash64(F.lit(1), F.sha2("line", 256)))).drop("twin")
        nodes = counted()
    nodes = nodes.drop("low", "high")
    total = nodes.agg(F.sum("copies")).first()[0] or 0
    often = nodes.filter(F.col("copies") > max(64, total // (16 * n))).select(F.col("node").alias("often"), F.col("first").alias("at"))
    once = every.join(F.broadcast(often), F.col("node") == F.col("often"), "left")  # fewer than 16n rows
    once = once.filter(F.col("at").isNull() | (place.eqNullSafe(F.col("at"))))
    once = once.select("node", "line", F.char_length("line").alias("length"))
    looked = keys(once, edits).repartition(n, "key")
    per_key = Window.partitionBy("key")
    looked = looked.withColumn("held", (F.col("look").between(0, edits) | (F.col("look") == -2)).cast("int"))
    shared = looked.withColumns({"n_held": F.sum("held").over(per_key), "low": F.min("node").over(per_key), "high": F.max("node").over(per_key)})
    shared = saved(shared.filter("n_held > 0 and low <> high").select("key", "node", "look", "held").distinct(), "shared")
    wanted = shared.select(F.col("node").alias("want")).distinct()
    texts = once.join(wanted, F.col("node") == F.col("want"), "left_semi").groupBy("node").agg(F.first("line").alias("line"))
    texts = saved(texts.withColumn("letters", _counts()), "texts")
    meet = crowds(shared, texts, edits, FEW, max(AT_ONCE, shared.count()))
    signed = meet.distinct().join(texts.select("node", "letters"), "node")
    index = signed.filter("held = 1").select("key", "node", "letters")
    asks = signed.select(F.col("key").alias("k"), F.col("node").alias("by"), F.col("letters").alias("other"))
    near = F.bit_count(F.col("letters").bitwiseXOR(F.col("other"))) <= 2 * edits
    pairs = index.join(asks, (F.col("key") == F.col("k")) & (F.col("node") != F.col("by")) & near)
    pairs = pairs.select(F.least("node", "by").alias("a"), F.greatest("node", "by").alias("b")).distinct()
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("line").alias("line_b")), "b")
    both = both.repartition(n, "a", "b")  # by cost, not by size
    links = saved(both.filter(within(F.col("line_a"), F.col("line_b"), edits)).select("a", "b"), "links")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    group = components(links)
    known = nodes.join(group, "node").join(ends, "node")
    least = known.groupBy("root").agg(F.min("first").alias("class"))
    moved = known.join(least, "root").select("node", "class", "links")
    named = nodes.join(moved, "node", "left").select("node", "copies", F.coalesce("class", "first").alias("class"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    rows = every.select("doc_id", "line_no", "node")
    hot = often.select(F.col("often").alias("node"))
    rest = rows.join(F.broadcast(hot), "node", "left_anti").join(named, "node")
    out = rest.unionByName(rows.join(F.broadcast(named.join(F.broadcast(hot), "node", "left_semi")), "node"))  # fewer than 16n names
    rows = out.select("doc_id", "line_no", F.col("class.doc_id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no"), "copies", "links")
    same = F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("line_no") == F.col("class_line_no"))
    return rows.withColumn("kept", same)
