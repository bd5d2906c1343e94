"""Aggregates and ratios in which unknown stays unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def poisoned_sum(value: Column, *, empty_is_zero: bool) -> Column:
    """The sum, or null as soon as one value is unknown; without rows 0 or null as told."""
    total = F.sum(value)
    known = F.coalesce(total, F.lit(0).cast("decimal(38,8)")) if empty_is_zero else total
    return F.when(F.coalesce(F.bool_or(value.isNull()), F.lit(False)), F.lit(None)).otherwise(known)


def guarded_ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; null where part is unknown or whole is 0 or unknown."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def blank_to_null(text: Column) -> Column:
    """Trims all white space; what is empty then is unknown."""
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))
