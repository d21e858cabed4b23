"""Missing and truth values of text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: texts that mean a missing value, and texts that mean false (fixed values)
MISSING = ("NaN", "nan", "None", "N/A", "")
FALSE = ("False", "false", "0")


def nullify(c: Column) -> Column:
    """Null where the text means a missing value."""
    return F.when(~c.isin(*MISSING), c)


def is_missing(c: Column) -> Column:
    return F.coalesce(c.cast("string").isin(*MISSING), F.lit(True))


def is_false(c: Column) -> Column:
    return ~is_missing(c) & c.cast("string").isin(*FALSE)


def is_true(c: Column) -> Column:
    """Neither missing nor one of the false texts; other spellings, ``FALSE`` among them, count as true."""
    return ~is_missing(c) & ~c.cast("string").isin(*FALSE)
