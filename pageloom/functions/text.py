"""Small string columns that the other functions share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def blank(x: Column) -> Column:
    return strip(F.coalesce(x, F.lit(""))) == ""


def concat(*parts: Column | str) -> Column:
    """Strings are literals here."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
