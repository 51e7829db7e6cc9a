"""Where reports go."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report rows as parquet, one folder per dashboard."""
    rows.write.mode(mode).partitionBy("dashboard").parquet(path)


def write_texts(texts: DataFrame, path: str, column: str = "report", mode: str = "overwrite"):
    """Rendered texts as records parted by an empty line."""
    texts.select(column).write.mode(mode).option("lineSep", "\n\n").text(path)


def write_lists(lists: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Member lists, one folder per group, inside one per dashboard if they have that column.

    A huge group is split over many files.
    """
    keys = [c for c in ("dashboard", "group_key") if c in lists.columns]
    lists = lists.hint("rebalance", *keys)
    lists.write.mode(mode).partitionBy(*keys).parquet(path)
