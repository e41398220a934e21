"""Digests, and draws made from them: the same in every run and every partition."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNIT = float(1 << 60)


def draw(seed: str, c: Column) -> Column:
    """A number from 0 to 1, from the first 60 bits of sha256(seed:value)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), c), 256), 1, 15), 16, 10).cast("long") / UNIT


def short_id(c: Column) -> Column:
    """The first 16 hexadecimal digits of sha256, in capitals."""
    return F.upper(F.substring(F.sha2(c, 256), 1, 16))


def blake2b_udf(size: int = 16):
    """Hexadecimal BLAKE2b of `size` bytes, which Spark lacks; Arrow batches, not rows."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=size).hexdigest())

    return run
