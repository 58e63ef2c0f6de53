"""Text helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_az(c: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes empty. lower() is much faster and the same on pure ASCII."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller's table can't clash with ours."""
    return df.select(*names)


#: Bytes, as the optimizer estimates them (of written tables those of the files), up to which a table may be broadcast.
BROADCAST_BYTES = 32 << 20


def small_enough(df: DataFrame, rows: int, most: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes: the check that stands before every broadcast."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size <= most and df.limit(rows + 1).count() <= rows
