"""Reports from the lines of a coverage plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.functions.markup import (
    CELL_TEMPLATE,
    count_cell,
    higher_group_cell,
    row_heading,
    value_cell,
)
from factspan.functions.values import percent
from factspan.operators.grouping import per_dashboard
from factspan.plans.coverage import Coverage
from factspan.spec import Dashboard


def ordered(lines: DataFrame) -> DataFrame:
    """Largest groups first, then the "no grouping" row, then the totals."""
    return lines.orderBy("dashboard", "section", F.col("count").desc(), "group_key")


def row_order() -> Column:
    """A struct that sorts a dashboard's rows."""
    return F.struct("section", (-F.col("count")).alias("size"), "group_key")


def _flag_of(coverage: Coverage) -> dict[str, str]:
    return dict(zip(coverage.keys, coverage.cells, strict=True))


def long_report(coverage: Coverage, lines: DataFrame | None = None) -> DataFrame:
    """One row per (report row, column): its count and percentage."""
    lines = coverage.lines() if lines is None else lines
    by_columns: dict[tuple[str, ...], set[str]] = {}
    for d in coverage.dashboards:
        by_columns.setdefault(tuple(c.key for c in d.columns), set()).add(d.name)
    flags = _flag_of(coverage)

    def cells(keys: tuple[str, ...]) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(key).alias("column_key"), F.col(flags[key]).alias("column_count")
                )
                for key in keys
            ]
        )

    choices = list(by_columns)
    place = {name: i for i, keys in enumerate(choices) for name in by_columns[keys]}
    array = F.when(per_dashboard(place) == 0, cells(choices[0])) if choices[0] else None
    for i, keys in enumerate(choices[1:], start=1):
        array = array.when(per_dashboard(place) == i, cells(keys))
    head = ["dashboard", "section", "kind", "group_key", "count"]
    rows = lines.select(*head, F.inline(array))
    return rows.withColumn("percent", percent(F.col("column_count"), F.col("count")))


def wide_report(coverage: Coverage, dashboard: Dashboard | None = None) -> DataFrame:
    """One row per report row, with a count for each column in the given order."""
    dashboard = dashboard or coverage.dashboards[0]
    flags = _flag_of(coverage)
    lines = coverage.lines().filter(F.col("dashboard") == dashboard.name)
    return lines.select(
        "section",
        "kind",
        "group_key",
        "higher_group",
        "group_link",
        "count",
        *[F.col(flags[c.key]).alias(c.key) for c in dashboard.columns],
    )


def report_head(d: Dashboard) -> str:
    """Table opening and header rows."""
    lines = ['{| class="wikitable sortable"']
    width = 3 if d.higher else 2
    lines.append(f'! colspan="{width}" |Top groupings (Minimum {d.threshold} items)')
    if d.columns:
        lines.append(
            f'! colspan="{len(d.columns)}"|Top Properties '
            f"(used at least {d.cell_threshold} times per grouping)"
        )
    lines.append("|-")
    if d.higher:
        lines.append("! ")
    lines += ["! Name", "! Count"]
    lines += [f'! data-sort-type="number"|{c.header}' for c in d.columns]
    return "\n".join(lines) + "\n"


def _row(d: Dashboard, flags: dict[str, str], template: str) -> Column:
    """One report row as markup."""
    kind, count = F.col("kind"), F.col("count")
    opener = F.when(kind == "totals", '|- class="sortbottom"\n').otherwise("|-\n")
    parts = [opener]
    if d.higher:
        parts.append(higher_group_cell(kind, F.col("higher_group")))
    heading = row_heading(kind, F.col("title"), F.col("span"))
    parts.append(F.concat(F.lit("| "), heading, F.lit("\n")))
    parts.append(count_cell(kind, F.col("group_link"), count))
    for column in d.columns:
        value = F.col(flags[column.key])
        share = percent(value, count)
        parts.append(value_cell(share, value, column.key, F.col("group_key"), template))
    return F.concat(*parts)


def render(coverage: Coverage, template: str = CELL_TEMPLATE) -> DataFrame:
    """(dashboard, report): each dashboard's table as one text.

    All rows of a dashboard meet in one aggregate, so this is for dashboards with a
    ``limit`` or few groups; :meth:`factspan.plans.fleet.Fleet.texts` gives lines of
    reports of any size.
    """
    flags = _flag_of(coverage)
    markup = reduce(
        lambda rest, d: F.when(F.col("dashboard") == d.name, _row(d, flags, template)).otherwise(
            rest
        ),
        coverage.dashboards,
        F.lit(None).cast("string"),
    )
    rows = coverage.lines().select("dashboard", row_order().alias("place"), markup.alias("markup"))
    spark = coverage.facts.spark
    heads = spark.createDataFrame(
        [(d.name, report_head(d)) for d in coverage.dashboards], "dashboard string, head string"
    )
    sorted_rows = F.array_sort(F.collect_list(F.struct("place", "markup")))
    body = F.array_join(F.transform(sorted_rows, lambda row: row["markup"]), "")
    bodies = rows.groupBy("dashboard").agg(body.alias("body"))
    report = F.concat("head", F.coalesce("body", F.lit("")), F.lit("|}\n"))
    return heads.join(bodies, "dashboard", "left").select("dashboard", report.alias("report"))
