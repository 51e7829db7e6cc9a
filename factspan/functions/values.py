"""Expressions over ids, years and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_prefix(value: Column, prefix: str) -> Column:
    """An IRI's local id."""
    return F.replace(value, F.lit(prefix), F.lit(""))


def is_unknown(group: Column, prefix: str) -> Column:
    """No group, an empty one, or the id of an unknown value."""
    return group.isNull() | (group == "") | group.startswith(prefix)


def year_bin(year: Column, span) -> Column:
    """First year of the bin; floors, so -5 falls into -10..-1."""
    span = span if isinstance(span, Column) else F.lit(span)
    return F.floor(year / span) * span


def percent(value: Column, total: Column) -> Column:
    """Share in percent, half-even to two places; 0 for nothing."""
    share = F.lit(1.0) * value / F.greatest(total, F.lit(1)) * F.lit(100.0)
    return F.when(F.coalesce(value, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.bround(share, 2))


def strip(text: Column) -> Column:
    """Drop white space (line ends too) from both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def literal_regex(text: str) -> str:
    """``text`` quoted for a regular expression."""
    return r"\Q" + text + r"\E"
