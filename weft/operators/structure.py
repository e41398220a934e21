"""Documents as lines, headings, trees and units."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import clean_line
from weft.sources.scratch import written

# The heading forms of the source texts.
MARKER = r"^<(目录|篇名)>\s*(.*?)\s*$"
VOLUME = r"^(?:卷(?:第)?[一二三四五六七八九十百千〇零\d]+|第[一二三四五六七八九十百千〇零\d]+卷)"
CHAPTER = r"^(?:第[一二三四五六七八九十百千〇零\d]+[篇章节].*|.+?篇第[一二三四五六七八九十百千〇零\d]+|.+?论)$"
SECTION = r"^(?:【.+】|[一二三四五六七八九十]+、.+|第[一二三四五六七八九十百千〇零\d]+节.+)$"
METADATA = r"^(?:书名|作者|朝代|年份)[：:]"
ATTRIBUTE = r"^属性[：:]\s*"
SENTENCE_END = r"[。！？；：，、]$"
CHAPTER_CHARS, SECTION_CHARS = 40, 80
BREAKS = r"\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}"
RANKS = {"volume": 1, "chapter": 2, "section": 3}


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = "\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029"
    pattern = re.compile(rf"[^{ends}]*(?:\r\n|[{ends}])|[^{ends}]+")
    for batch in batches:
        for i, text in enumerate(batch.column("text").to_pylist()):
            found = [(m.start(), m[0].rstrip("\r\n")) for m in pattern.finditer(text or "")] or [(0, "")]
            n = len(found)
            start = pa.array([s for s, _ in found], pa.int64())
            end = pa.array([s + len(r) for s, r in found], pa.int64())
            ids = batch.column("doc_id").take(pa.array([i] * n, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(range(1, n + 1), pa.int32()), start, end, pa.array([r for _, r in found], pa.string())], names=["doc_id", "line_no", "start", "end", "raw"])


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), start, end (characters, without the break), raw.

    Breaks are those of Unicode text; a break at the end does not open another line, and an
    empty or null text is one empty line. Each row is split on its own, so rows with one
    doc_id do not mix and nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_split, f"doc_id {kind}, line_no int, start long, end long, raw string")


def heading(line: Column) -> Column:
    """type, title, rank, evidence of a heading line; null for others."""
    say = lambda kind, title, why: F.struct(F.lit(kind).alias("type"), title.alias("title"), F.lit(RANKS[kind]).alias("rank"), F.lit(why).alias("evidence"))
    is_marker = F.regexp_like(line, F.lit(MARKER))
    title = F.trim(F.regexp_extract(line, MARKER, 2))
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    return (
        F.when(is_marker & (title == ""), None)
        .when(is_marker & like(title, VOLUME), say("volume", title, "marked volume"))
        .when(is_marker, say("chapter", title, "marker"))
        .when(like(line, VOLUME), say("volume", line, "plain volume pattern"))
        .when(like(line, CHAPTER) & (F.char_length(line) <= CHAPTER_CHARS), say("chapter", line, "plain chapter pattern"))
        .when(like(line, SECTION) & (F.char_length(line) <= SECTION_CHARS), say("section", line, "plain section pattern"))
    )


def tree(classified: DataFrame) -> DataFrame:
    """Parents and paragraphs of (doc_id, line_no, start, end, text, kind, title, rank).

    kind is "heading", "text" or "break". The parent of a heading is the latest heading
    before it with a smaller rank, of a paragraph the latest heading; with few ranks these
    are running maxima, one per rank. A paragraph is a run of text lines. A volume heading
    that repeats the previous top-level volume's title continues it. Returns doc_id, node
    (first line), type, title or text, parent (a line; null: the root), number within its
    type, start, end: the end of a heading is that of its last descendant.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("kind") == "heading"
    rows = classified.withColumn("last_volume", F.last(F.when(is_head & (F.col("rank") == 1), F.col("title")), ignorenulls=True).over(before))
    rows = rows.withColumn("again", is_head & (F.col("rank") == 1) & F.coalesce(F.col("title") == F.col("last_volume"), F.lit(False)))
    rows = rows.withColumn("volume_line", F.last(F.when(is_head & (F.col("rank") == 1) & ~F.col("again"), F.col("line_no")), ignorenulls=True).over(upto))
    rows = rows.withColumn("node", F.when(F.col("again"), F.col("volume_line")).when(is_head, F.col("line_no")))
    stands = {}
    for r in range(1, max(RANKS.values()) + 1):
        # The node of rank r that is open here: the latest one, unless a smaller rank came since.
        latest = F.last(F.when(is_head & (F.col("rank") <= r), F.struct("rank", "node")), ignorenulls=True).over(before)
        stands[r] = F.when(latest["rank"] == r, latest["node"])
    rows = rows.withColumns({f"open{r}": c for r, c in stands.items()})
    parent_of = lambda below: F.coalesce(*[F.when(F.lit(r) < below, F.col(f"open{r}")) for r in sorted(stands, reverse=True)])
    heads = rows.filter(is_head).select("doc_id", "line_no", "node", "again", F.col("title"), "rank", parent_of(F.col("rank")).alias("parent"), "start", "end")
    breaks = F.sum(F.when(F.col("kind") == "text", 0).otherwise(1)).over(upto)
    body = rows.withColumn("run", breaks).filter("kind = 'text'").withColumn("parent", parent_of(F.lit(99)))
    paragraphs = body.groupBy("doc_id", "run").agg(
        F.min("line_no").alias("node"), F.first("parent").alias("parent"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "").alias("text"),
    )
    kinds = F.element_at(F.create_map(*[x for k, r in RANKS.items() for x in (F.lit(r), F.lit(k))]), F.col("rank"))
    merged = heads.groupBy("doc_id", "node").agg(
        F.min_by("title", "line_no").alias("content"), F.min("rank").alias("rank"), F.min_by("parent", "line_no").alias("parent"), F.min("start").alias("start"), F.max("end").alias("own_end")
    )
    # A heading owns all lines up to the next heading of its rank or a smaller one.
    texts = paragraphs.select("doc_id", F.col("node").alias("at"), F.lit(None).cast("int").alias("rank"), F.col("end").alias("reach"))
    marks = merged.select("doc_id", F.col("node").alias("at"), "rank", F.col("own_end").alias("reach")).unionByName(texts)
    back = Window.partitionBy("doc_id").orderBy(F.desc("at"))
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumns({"prior": F.lead("reach").over(back), "all": F.first("reach").over(back)})
    for r in RANKS.values():
        marks = marks.withColumn(f"stop{r}", F.last(F.when(F.col("rank") <= r, F.struct("at", "prior")), ignorenulls=True).over(later))
    stop = F.coalesce(*[F.when(F.col("rank") == r, F.col(f"stop{r}")) for r in RANKS.values()])
    # Lines end in their order, so what stands right before the stop reaches furthest; only a
    # continued volume has a later end of its own.
    reach = F.when(stop.isNull(), F.col("all")).otherwise(stop["prior"])
    ends = marks.filter("rank is not null").select("doc_id", F.col("at").alias("node"), F.greatest("reach", reach).alias("end"))
    nodes = merged.join(ends, ["doc_id", "node"]).select("doc_id", "node", kinds.alias("type"), "content", "parent", "start", "end")
    nodes = nodes.unionByName(paragraphs.select("doc_id", "node", F.lit("paragraph").alias("type"), F.col("text").alias("content"), "parent", "start", "end"))
    return nodes.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("node")))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ancestors of headings that come in order: a stack of the open ones, of rising rank."""
    doc, stack = None, []
    kind = pa.list_(pa.struct([("node", pa.int64()), ("type", pa.string()), ("title", pa.string())]))
    for batch in batches:
        paths = []
        for d, node, rank, type_, title in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "node", "rank", "type", "title")), strict=True):
            if d != doc:
                doc, stack = d, []
            while rank is not None and stack and stack[-1][0] >= rank:
                stack.pop()
            paths.append([x for _, x in stack])
            if rank is not None:
                stack.append((rank, {"node": node, "type": type_, "title": title}))
        if paths:
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "node", "rank", "type", "title")] + [pa.array(paths, kind)], names=["doc_id", "node", "rank", "type", "title", "path"])


def ancestors(rows: DataFrame) -> DataFrame:
    """Headings and texts (doc_id, node, rank, type, title) with their path, from the root down.

    node orders the rows of a document. A heading closes all open ones of its rank or a
    larger one and lies under the rest; a row without rank lies under all open ones. path is
    an array of (node, type, title). Ranks are any numbers. One ordered pass: a task keeps
    the open headings only, however long the document.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.select("doc_id", F.col("node").cast("long").alias("node"), F.col("rank").cast("int").alias("rank"), "type", "title").repartition("doc_id").sortWithinPartitions("doc_id", "node")
    return ordered.mapInArrow(_fold, f"doc_id {kind}, node long, rank int, type string, title string, path array<struct<node: long, type: string, title: string>>")


def lineage(nodes: DataFrame) -> DataFrame:
    """Nodes (doc_id, node, parent, type, content) with their path, as ancestors(), from the parents alone.

    Each round every path is extended by that of the node it has reached, so it doubles and
    the rounds grow with the logarithm of the depth. A parent that is no node ends the path;
    parents must not form a circle.
    """
    one = F.array(F.struct(F.col("node").cast("long").alias("node"), "type", F.col("content").alias("title")))
    state = written(nodes.select("doc_id", "node", F.col("parent").alias("jump"), F.slice(one, 1, 0).alias("path"), one.alias("own")))
    while not state.filter("jump is not null").isEmpty():
        of = state.select(F.col("doc_id").alias("d"), F.col("node").alias("at"), F.col("jump").alias("next"), F.concat("path", "own").alias("above"))
        done = state.filter("jump is null")
        going = state.filter("jump is not null").join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("jump") == F.col("at")), "left")
        # What is above the node reached comes first; its own jump is the next to take.
        going = going.select("doc_id", "node", F.col("next").alias("jump"), F.concat(F.coalesce("above", F.slice("path", 1, 0)), "path").alias("path"), "own")
        state = written(done.unionByName(going))
    return nodes.join(state.select(F.col("doc_id").alias("d"), F.col("node").alias("at"), "path"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("node") == F.col("at"))).drop("d", "at")


def classify_lines(docs: DataFrame) -> DataFrame:
    """The lines of documents with kind, title and rank, by the fixed heading forms."""
    rows = lines(docs).withColumn("clean", clean_line(F.col("raw")))
    marker = F.regexp_like("clean", F.lit(MARKER)) & (F.trim(F.regexp_extract("clean", MARKER, 2)) == "")
    stop = (F.col("clean") == "") | F.regexp_like("clean", F.lit(METADATA)) | marker
    rows = rows.withColumn("text", F.regexp_replace("clean", ATTRIBUTE, "")).withColumn("h", heading(F.col("text")))
    kind = F.when(stop, "break").when(F.col("h").isNotNull(), "heading").otherwise("text")
    return rows.select("doc_id", "line_no", "start", "end", "text", kind.alias("kind"), F.when(kind == "heading", F.col("h.title")).alias("title"), F.when(kind == "heading", F.col("h.rank")).alias("rank"))


def review_candidates(classified: DataFrame) -> DataFrame:
    """Short text lines next to a blank one without sentence-final punctuation."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    blank = lambda c: c.isNull() | (c == "break")
    rows = classified.withColumns({"prev": F.lag("kind").over(order), "next": F.lead("kind").over(order)})
    short = F.char_length("text").between(2, 50) & ~F.regexp_like("text", F.lit(SENTENCE_END))
    return rows.filter((F.col("kind") == "text") & (blank(F.col("prev")) | blank(F.col("next"))) & short).select("doc_id", "line_no", "text")


def markdown(nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, markdown: headings by rank (six levels at most), paragraphs between blank lines."""
    depth = F.element_at(F.create_map(*[x for k, r in RANKS.items() for x in (F.lit(k), F.lit(r + 1))]), F.col("type"))
    part = F.when(F.col("type") == "paragraph", F.col("content")).otherwise(F.concat(F.repeat(F.lit("#"), F.least(depth, F.lit(6))), F.lit(" "), F.col("content")))
    body = nodes.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", part.alias("s")))), lambda x: x["s"]), "\n\n").alias("body"))
    return titles.join(body, "doc_id", "left").select("doc_id", F.concat(F.lit("# "), F.col("title"), F.coalesce(F.concat(F.lit("\n\n"), F.col("body")), F.lit("")), F.lit("\n")).alias("markdown"))


def batches(sizes: Column, room: int) -> Column:
    """Batch numbers of an ordered array of sizes: a new batch opens when the next overflows.

    An item larger than the room stands alone.
    """
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        opens = (acc["size"] > 0) & (acc["size"] + x > room)
        n = F.when(acc["n"] == 0, 1).when(opens, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(F.concat(acc["out"], F.array(n)).alias("out"), F.when(opens, x).otherwise(acc["size"] + x).cast("long").alias("size"), n.alias("n"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def chunks(nodes: DataFrame, target: int = 600, overlap: int = 80) -> DataFrame:
    """node-bounded chunks of (doc_id, node, content): sequence, start, text.

    Windows of target characters that start target - overlap apart; none crosses a node.
    """
    step = target - overlap
    n = F.greatest(F.ceil((F.char_length("content") - overlap) / step), F.lit(1)).cast("int")
    rows = nodes.select("doc_id", "node", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("sequence"))
    return rows.select("doc_id", "node", "sequence", (F.col("sequence") * step).alias("start"), F.substring("content", F.col("sequence") * step + 1, F.lit(target)).alias("text"))


def _bounded(target: int, least: int, most: int, overlap: int):
    marks = re.compile(r"[.!?\n\u3002\uff01\uff1f]+")

    def cut(text: str) -> list[tuple[int, int]]:
        ends, out, start, n = [m.end() for m in marks.finditer(text)], [], 0, len(text)
        while True:
            end = n
            if n - start > target:
                last = bisect_right(ends, start + target) - 1
                after = bisect_right(ends, start + target)
                if last >= 0 and ends[last] >= start + least:
                    end = ends[last]
                elif after < len(ends) and ends[after] <= start + most:
                    end = ends[after]
                else:
                    end = min(start + most, n)
                if n - start <= most and n - end < least:
                    end = n
            out.append((start, end))
            if end == n:
                return out
            start = end - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("content").to_pylist()):
                found = cut(text or "")
                at = pa.array([i] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("node").take(at), pa.array(range(len(found)), pa.int32()), pa.array([a for a, _ in found], pa.int64()), pa.array([(text or "")[a:b] for a, b in found], pa.string())],
                    names=["doc_id", "node", "sequence", "start", "text"],
                )

    return run


def bounded_chunks(nodes: DataFrame, target: int = 600, least: int = 200, most: int = 1200, overlap: int = 80) -> DataFrame:
    """doc_id, node, sequence, start, text: chunks of (doc_id, node, content) that end with sentences.

    A chunk ends at the last sentence end that leaves it `least` to `target` characters, else
    at the first one up to `most`, else after `most`. What is left at a node's end is taken
    along if it is shorter than `least` and fits. So no chunk is longer than `most`, and only
    a node's last one shorter than `least`. The next chunk starts `overlap` characters before
    the end; none crosses a node. An empty or null content is one empty chunk.
    """
    if not 0 <= overlap < least <= target <= most:
        raise ValueError("overlap < least <= target <= most is asked for")
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    return nodes.select("doc_id", "node", "content").mapInArrow(_bounded(target, least, most, overlap), f"doc_id {kinds['doc_id']}, node {kinds['node']}, sequence int, start long, text string")


def _swept(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept_id, kept = None, None, None
        for batch in batches:
            stays, like, scores = [], [], []
            for g, i, v in zip(batch.column("grp").to_pylist(), batch.column("id").to_pylist(), batch.column("v"), strict=True):
                v = None if v.as_py() is None else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if g != group:
                    group, kept_id, kept = g, None, None
                score = None
                if v is not None and kept is not None and len(v) == len(kept):
                    size = np.linalg.norm(v) * np.linalg.norm(kept)
                    score = round(float(v @ kept / size), 9) if size else 0.0
                stays.append(score is None or score < least)
                like.append(kept_id if score is not None else None)
                scores.append(score)
                if stays[-1] and v is not None:
                    kept_id, kept = i, v
            if stays:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("grp"), batch.column("id"), pa.array(stays), pa.array(like, pa.int64()), pa.array(scores, pa.float64())], names=["grp", "id", "kept", "compared_with", "score"]
                )

    return run


def neighbour_dedup(rows: DataFrame, order: list[str], least: float = 0.9) -> DataFrame:
    """grp, id, kept, compared_with, score: of neighbours (grp, id, v) that say the same, the first.

    Rows of a group are taken in order; one goes if its vector's cosine similarity with the
    last row kept before it is `least` or more, so that what is kept depends on what was kept.
    Rows without a vector, or with one of another length, stay and are compared with nothing.
    A task keeps one vector of a group, however many rows that has.
    """
    kind = rows.schema["grp"].dataType.simpleString()
    ordered = rows.withColumn("id", F.col("id").cast("long")).repartition("grp").sortWithinPartitions("grp", *order).select("grp", "id", "v")
    return ordered.mapInArrow(_swept(least), f"grp {kind}, id long, kept boolean, compared_with long, score double")
