"""The document store: constraints, insert-if-absent, migrations, inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def absent(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """The new rows whose key is not stored yet, one per key; a second import adds none."""
    return new.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


def pending(units: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Units without a completed record."""
    return units.join(done.filter("status = 'completed'").select(*key).distinct(), key, "left_anti")


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rule, violations: rows for which a check is false or null, all checks in one pass."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return counts.select(F.explode(F.create_map(*[x for n in checks for x in (F.lit(n), F.col(n))])).alias("rule", "violations"))


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).count().filter("count > 1")


def orphans(rows: DataFrame, parents: DataFrame, column: str, parent: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col(parent).alias(column)).distinct(), column, "left_anti")


def migrations(ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """version, action of (version, statement) against (version, checksum).

    "skip" if applied with the same text, "apply" if new, "changed" if the text differs:
    then nothing may run.
    """
    rows = wanted.select("version", F.sha2("statement", 256).alias("checksum")).join(ledger.select("version", F.col("checksum").alias("applied")), "version", "left")
    return rows.select("version", F.when(F.col("applied").isNull(), "apply").when(F.col("applied") == F.col("checksum"), "skip").otherwise("changed").alias("action"))


def inspect(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def run_settings(spark: SparkSession, settings: dict[str, str]) -> DataFrame:
    """One row: settings as JSON and their fingerprint; a resumed run compares it first."""
    row = spark.createDataFrame([(sorted(settings.items()),)], "s array<struct<k: string, v: string>>")
    text = F.to_json(F.map_from_entries("s"))
    return row.select(text.alias("settings"), F.sha2(text, 256).alias("fingerprint"))


def same_settings(spark: SparkSession, settings: dict[str, str], path: str) -> bool:
    """Whether a run starts anew at path; an error if one with other settings was begun there.

    The first run stores its settings with their fingerprint; a resumed one compares its own.
    """
    own = run_settings(spark, settings)
    try:
        before = spark.read.schema(own.schema).json(path).first()
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        own.coalesce(1).write.json(path)
        return True
    if before.fingerprint != own.first().fingerprint:
        raise ValueError(f"a run with other settings was begun here: {before.settings}")
    return False
