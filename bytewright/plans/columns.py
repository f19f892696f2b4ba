"""Taking columns by exact name from frames whose other columns may clash with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns. Names match exactly first, else without case; a missing one raises ``KeyError``."""
    have = df.columns
    plain = df.toDF(*(f"_{i}" for i in range(len(have))))
    chosen = []
    for name in names:
        at = next((i for i, c in enumerate(have) if c == name), None)
        if at is None:
            at = next((i for i, c in enumerate(have) if c.lower() == name.lower()), None)
        if at is None:
            raise KeyError(f"no column {name} among {have}")
        chosen.append(F.col(f"_{at}").alias(name))
    return plain.select(*chosen)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
