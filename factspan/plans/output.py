"""Rows in a total order of any size: places by ranges, and files in that order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspan.operators.tables import written

# A row's number in its task, as Spark hands them out.
_IN_TASK = (1 << 33) - 1


def with_places(rows: DataFrame, by: str, order: Sequence[Column | str]) -> DataFrame:
    """``rows`` with ``place``: 1, 2, ... within each value of ``by``, in ``order``.

    Rows are dealt to tasks by ranges of (``by``, order) and sorted there. A place is the
    row's number in its range plus the sizes of the ranges before, which are a few
    numbers for each task; so no value of ``by`` has to fit into one task. The result is
    a written table; ties are in any order.
    """
    taken = [c for c in ("_range", "_number", "_first", "_n") if c in rows.columns]
    if taken:
        raise ValueError(f"columns named {', '.join(taken)}")
    keys = [F.col(by), *[F.col(c) if isinstance(c, str) else c for c in order]]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()
    marked = dealt.select(
        "*",
        F.shiftright(number, 33).cast("int").alias("_range"),
        number.bitwiseAND(F.lit(_IN_TASK)).alias("_number"),
    )
    marked = written(marked)
    ranges = marked.groupBy(by, "_range").agg(
        F.min("_number").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # A row for each task that holds some of the value: small, whatever the rows are.
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    ranges = ranges.select(F.col(by).alias("_by"), F.col("_range").alias("_of"), "_first", offset)
    met = marked.join(
        F.broadcast(ranges),
        marked[by].eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_of")),
    )
    place = (F.col("_number") - F.col("_first") + F.col("_before") + 1).alias("place")
    return met.select(*rows.columns, place)


def write_ordered(rows: DataFrame, path: str, by: str, text: str, mode: str = "overwrite") -> None:
    """Write the ``text`` of rows with ``by`` and ``place`` as files whose order is theirs.

    One folder for each value of ``by``; its files, read by name, give its rows by place.
    A text ends with its own line end, which the files' line ends replace.
    """
    dealt = rows.repartitionByRange(F.col(by), F.col("place")).sortWithinPartitions(by, "place")
    line = F.regexp_replace(text, r"\n\z", "").alias("value")
    dealt.select(by, line).write.mode(mode).partitionBy(by).text(path)
