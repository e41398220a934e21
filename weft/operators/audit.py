"""Audit of raw documents: file names, headers, types, quality, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.hashing import short_id
from weft.functions.text import null_tokens, strip

# The source data's catalogue format, header keys and title indicators.
CATALOG = r"^\(([\d.]+)-([\d.]+)\)\.([^.]+)\.《([^》]+)》(.*)$"
NUMBERED = r"^(\d+)[.-](.+)$"
HEADER_KEYS = {"title": "书名", "author": "作者", "dynasty": "朝代", "year_text": "年份"}
VOLUMES = r"[（(]([一二三四五六七八九十百\d]+)卷(?:、续集([一二三四五六七八九十百\d]+)卷)?[）)]"
MODERN_TITLE = ["近现代", "名老中医", "临证经验", "医疗经验", "实验录", "名师垂教", "方法", "应用"]
REFERENCE_TITLE = ["医籍考", "目录", "辞典", "索引", "汇编"]
CASE_TITLE = ["医案", "验案", "病案"]
COMMENTARY_TITLE = ["集注", "注", "解", "释", "疏", "校注", "评文"]
TRADITIONAL = "醫藥經傷證針灸臟腑學錄診療衛產婦兒"
NUMERALS = "一二三四五六七八九"
FIRST_MODERN_YEAR = 1912
HEADER_CHARS, SCRIPT_CHARS, SHORT_CHARS = 5000, 20000, 200

#: Fixed value: signs of bad OCR.
SUSPECTED_OCR = r"[□\uFFFD]{3,}|([\u4e00-\u9fff])\1{8,}"


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def file_name(stem: Column) -> Column:
    """code, catalog_id, category, title, tail, form of a file name without its suffix."""
    catalog = F.regexp_like(stem, F.lit(CATALOG))
    only = lambda i: F.when(catalog, F.regexp_extract(stem, CATALOG, i))
    return F.struct(
        only(1).alias("code"),
        only(2).alias("catalog_id"),
        F.split(only(3), "-").alias("category"),
        F.coalesce(only(4), _group(stem, NUMBERED, 2), stem).alias("title"),
        only(5).alias("tail"),
        F.when(catalog, "catalog_filename").otherwise("filename").alias("form"),
    )


def header(text: Column) -> Column:
    """The first known value of each header key near the start; the title may be a marker's."""
    early = F.left(text, F.lit(HEADER_CHARS))

    def first(key: str) -> Column:
        found = F.regexp_extract_all(early, F.lit(rf"(?m)^{key}[：:]\s*(.+?)\s*$"), 1)
        return F.get(F.filter(F.transform(found, null_tokens), lambda v: v.isNotNull()), 0)

    fields = {name: first(key) for name, key in HEADER_KEYS.items()}
    fields["title"] = F.coalesce(fields["title"], null_tokens(_group(early, r"(?m)^<篇名>\s*(.+?)\s*$", 1)))
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def only_year(value: Column) -> Column:
    """The year 1000 to 2099 that a value names, if it names exactly one."""
    years = F.regexp_extract_all(value, F.lit(r"(?<!\d)(1[0-9]{3}|20[0-9]{2})(?!\d)"), 1)
    return F.when(F.size(years) == 1, F.get(years, 0).cast("int"))


def numeral(value: Column) -> Column:
    """Digits, the numerals 1 to 10 and 100, and compounds of ten; null for others."""
    one = lambda c: F.nullif(F.instr(F.lit(NUMERALS), c), F.lit(0))
    tens, rest = F.substring_index(value, "十", 1), F.substring_index(value, "十", -1)
    compound = F.when(tens == "", F.lit(1)).otherwise(F.coalesce(one(tens), F.lit(1))) * 10 + F.when(rest == "", F.lit(0)).otherwise(F.coalesce(one(rest), F.lit(0)))
    single = F.when(F.char_length(value) == 1, one(value))
    return (
        F.when(F.regexp_like(value, F.lit(r"^[0-9]+$")), value.cast("int"))
        .when(value == "十", 10)
        .when(value == "百", 100)
        .when(single.isNotNull(), single)
        .when(F.contains(value, F.lit("十")), compound)
    )


def text_type(title: Column, year: Column, text: Column, modern=None, reference=None, case=None, commentary=None) -> Column:
    """text_type, method, confidence, evidence by the first rule that applies."""
    say = lambda kind, method, sure, why: F.struct(F.lit(kind).alias("text_type"), F.lit(method).alias("method"), F.lit(sure).alias("confidence"), why.alias("evidence"))
    term = lambda terms: F.get(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(title, t)), 0)
    rule = F.when(year >= FIRST_MODERN_YEAR, say("modern_book", "rule", "high", F.concat(F.lit("header.year="), year.cast("string"))))
    for terms, kind, sure in ((modern or MODERN_TITLE, "modern_book", "medium"), (reference or REFERENCE_TITLE, "reference", "medium"), (case or CASE_TITLE, "medical_case", "high"), (commentary or COMMENTARY_TITLE, "commentary", "medium")):
        rule = rule.when(term(terms).isNotNull(), say(kind, "title_rule", sure, F.concat(F.lit("title contains "), term(terms))))
    rule = rule.when(F.char_length(strip(text)) < SHORT_CHARS, say("unknown", "content_rule", "low", F.lit("text shorter than 200 characters")))
    return rule.otherwise(say("ancient_classical", "default_rule", "low", F.lit("no indicator")))


def language_style(kind: Column) -> Column:
    return F.when(kind == "modern_book", "modern_chinese").when(kind.isin("ancient_classical", "commentary", "medical_case"), "classical_chinese").otherwise("unknown")


def script(text: Column) -> Column:
    """Traditional if eight or more hint characters occur near the start."""
    early = F.left(text, F.lit(SCRIPT_CHARS))
    hints = F.char_length(early) - F.char_length(F.translate(early, TRADITIONAL, ""))
    return F.when(hints >= 8, "traditional").otherwise("simplified")


def volumes(tail: Column, text: Column) -> Column:
    """has_volume, volumes: the count in brackets of the file name, else of the header."""
    early = F.left(text, F.lit(HEADER_CHARS))
    source = F.when(F.regexp_like(F.coalesce(tail, F.lit("")), F.lit(VOLUMES)), tail).when(F.regexp_like(early, F.lit(VOLUMES)), early)
    count = numeral(_group(source, VOLUMES, 1)) + F.coalesce(numeral(_group(source, VOLUMES, 2)), F.lit(0))
    return F.struct(source.isNotNull().alias("has_volume"), count.alias("volumes"))


def quality(text: Column) -> Column:
    """Line, character and byte counts, replacement characters, and signs of bad OCR."""
    lines = F.split(text, "\n")
    empty = F.size(F.filter(lines, lambda v: F.trim(v) == ""))
    return F.struct(
        F.octet_length(text).cast("long").alias("byte_count"),
        F.char_length(text).cast("long").alias("character_count"),
        F.size(lines).cast("long").alias("line_count"),
        F.round(empty / F.size(lines), 5).alias("empty_line_ratio"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("�"), F.lit("")))).cast("long").alias("replacement_char_count"),
        F.regexp_like(text, F.lit(SUSPECTED_OCR)).alias("suspected_ocr"),
    )


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, document_id and quality of each document; null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", short_id(text).alias("document_id"), F.sha2(text, 256).alias("text_sha256"), quality(text).alias("q")).select("doc_id", "document_id", "text_sha256", "q.*")


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, duplicate_group, duplicate_of, copies of documents that share their text.

    Nothing is deleted. Counts are combined before they are shuffled and joined back, so a
    text that very many documents share is not gathered in one task.
    """
    keyed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    groups = keyed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    out = keyed.join(groups, "h").select("doc_id", F.upper(F.substring("h", 1, 16)).alias("duplicate_group"), "first", "copies")
    return out.select("doc_id", "duplicate_group", F.when(F.col("doc_id") != F.col("first"), F.col("first")).alias("duplicate_of"), "copies")


def keep_first(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in the given order, as when inputs are read one after another."""
    best = rows.withColumn("__key", key)
    first = best.groupBy("__key").agg(F.min(F.struct(*order)).alias("__first"))
    same = [F.col(f"__first.{c}").eqNullSafe(F.col(c)) for c in order]
    joined = best.join(first, "__key")
    for s in same:
        joined = joined.filter(s)
    return joined.drop("__key", "__first")


def report(docs: DataFrame) -> DataFrame:
    """Per language: documents, distinct texts, characters, and counts of flags."""
    text = F.coalesce("text", F.lit(""))
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        F.countDistinct(F.sha2(text, 256)).alias("distinct_texts"),
        F.sum(F.char_length(text)).alias("characters"),
        F.count_if(F.char_length(text) < SHORT_CHARS).alias("short"),
        F.count_if(F.contains(text, F.lit("\n"))).alias("with_lines"),
        F.count_if(F.col("source").isNull()).alias("without_source"),
    )


def nth_latest(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The latest n rows of each key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
