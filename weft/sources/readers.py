"""Readers: JSON arrays or lines, CSV with a byte-order mark, files of unknown encoding."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

#: Tried in turn for what is not UTF-8.
LEGACY = ("gb18030", "big5")
#: Bytes of a file that tell whether it holds an array.
HEAD = 64


def listed(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length, src_rank of the files under a path, in order of path.

    Contents are not read; files of no bytes are left out.
    """
    files = spark.read.format("binaryFile")
    files = (files.option("pathGlobFilter", glob) if glob else files).load(path).select("path", "length")
    return files.withColumn("src_rank", F.row_number().over(Window.orderBy("path")) - 1)  # a row per file


def _is_array(spark: SparkSession, path: str) -> bool:
    """Whether the first character that is no blank, past a byte-order mark, opens an array."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        head = bytearray()
        while len(head) < HEAD and (byte := stream.read()) >= 0:
            head.append(byte)
    finally:
        stream.close()
    return head.removeprefix(b"\xef\xbb\xbf").lstrip()[:1] == b"["


def records(spark: SparkSession, path: str, schema: str, glob: str | None = None, source: bool = False) -> DataFrame:
    """JSON records of files that each hold either one array or one object per line.

    Every file is judged by its own first bytes, which are all that the driver reads of it;
    the schema is given, never inferred. With source, the records carry the path of their
    file and src_rank, its place in the order of paths.
    """
    files = listed(spark, path, glob)
    paths = [r.path for r in files.orderBy("path").collect()]  # names only
    with ThreadPoolExecutor(16) as pool:
        arrays = list(pool.map(lambda p: _is_array(spark, p), paths))
    out = None
    for multi in (False, True):
        some = [p for p, a in zip(paths, arrays, strict=True) if a == multi]
        if some:
            one = spark.read.schema(schema).option("multiLine", multi).option("mode", "PERMISSIVE").json(some).select("*", F.col("_metadata.file_path").alias("path"))
            out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], schema).withColumn("path", F.lit(""))
    if not source:
        return out.drop("path")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return out.withColumn("at", plain(F.col("path"))).join(files.select(plain(F.col("path")).alias("at"), "src_rank"), "at").drop("at")


def in_order(spark: SparkSession, paths: list[str]) -> DataFrame:
    """src_rank, line_no, line of text inputs in the order listed; blank lines go.

    Line numbers rise within a file; they come from the file's own order of reading.
    """
    out = None
    for i, p in enumerate(paths):
        one = spark.read.text(p).select(F.lit(i).alias("src_rank"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
        out = one if out is None else out.unionByName(one)
    return out.filter(F.trim("line") != "")


def csv_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV sheet with a header; quoted fields may hold line breaks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)


def _decoded(raw: bytes) -> dict:
    for encoding in LEGACY:
        try:
            return {"text": raw.decode(encoding), "encoding": encoding, "ok": True}
        except UnicodeDecodeError:
            pass
    return {"text": raw.decode("utf-8", errors="replace"), "encoding": "utf-8", "ok": False}


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType()), StructField("ok", BooleanType())]))
def legacy_udf(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_decoded(bytes(c)) if c is not None else dict.fromkeys(("text", "encoding", "ok")) for c in content], columns=["text", "encoding", "ok"])


def decoded(content: Column) -> Column:
    """text, encoding and ok of bytes: UTF-8, without its mark, or else a legacy encoding that fits.

    Where none does, UTF-8 with replacements, not ok. Only bytes that are not UTF-8 go to Python.
    """
    content = F.coalesce(content, F.lit(b""))
    valid = F.is_valid_utf8(content)
    text = F.regexp_replace(content.cast("string"), "^\\x{FEFF}", "")
    other = legacy_udf(F.when(~valid, content))
    return F.when(valid, F.struct(text.alias("text"), F.lit("utf-8-sig").alias("encoding"), F.lit(True).alias("ok"))).otherwise(other)


def files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """path, sha256, text, encoding, ok of the files directly under a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", False).load(path)
    return raw.select("path", F.sha2("content", 256).alias("sha256"), decoded(F.col("content")).alias("d")).select("path", "sha256", "d.*")


def excerpt(text: Column, start: Column, end: Column, literal: Column, pad: int = 600, most: int = 4000, line_start: Column | None = None, line_end: Column | None = None) -> Column:
    """Up to `most` characters around a span, else around lines (from 1), else around a literal.

    A span or lines that are null do not count, nor does a literal that does not occur; null
    if nothing is left.
    """
    at = F.when(literal != "", F.position(literal, text))
    of_literal = F.when(at > 0, F.struct((at - 1).alias("low"), (at - 1 + F.char_length(literal)).alias("high")))
    of_span = F.when(start.isNotNull() & end.isNotNull(), F.struct(start.cast("int").alias("low"), end.cast("int").alias("high")))
    found = [of_span, of_literal]
    if line_start is not None and line_end is not None:
        rows = F.split(text, "\n")
        chars = lambda n: F.aggregate(F.slice(rows, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), F.lit(0), lambda a, x: a + F.char_length(x) + 1)
        inside = line_start.between(1, F.size(rows)) & (line_end >= line_start)
        found.insert(1, F.when(inside, F.struct(chars(line_start - 1).alias("low"), (chars(line_end) - 1).alias("high"))))
    span = F.coalesce(*found)
    low = F.greatest(span["low"] - pad, F.lit(0))
    return F.when(span.isNotNull(), F.substring(text, low + 1, F.least(span["high"] + pad - low, F.lit(most))))


def preview(df: DataFrame, n: int = 3, chars: int = 500) -> DataFrame:
    """The first n records with every value cut to so many characters."""
    return df.limit(n).select(*[F.left(F.col(c).cast("string"), F.lit(chars)).alias(c) for c in df.columns])
