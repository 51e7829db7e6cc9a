"""Expressions that turn report rows into headings, cells and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed texts of the report markup.
NO_GROUP_HEADING = "No grouping"
TOTALS_HEADING = "'''Totals''' <small>(all items)</small>"
UNKNOWN_HEADING = "{{int:wikibase-snakview-variations-somevalue-label}}"
IMAGE_PREFIX = "http://commons.wikimedia.org/wiki/Special:FilePath/"
CELL_TEMPLATE = "Coverage cell"


def text(*parts) -> Column:
    """Concatenate columns and plain strings; a null column gives an empty string."""
    columns = [
        F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts
    ]
    return F.concat(*columns)


def year_heading(start: Column, span: Column) -> Column:
    """``1950``, ``1950s``, ``-10 ka`` or ``-80 Ma`` by the width of the bin."""
    millions = (span >= 1_000_000) & (start % 1_000_000 == 0)
    thousands = (span >= 10_000) & (start % 1_000 == 0)
    return (
        F.when(span == 1, start.cast("string"))
        .when(millions, text(F.floor(start / 1_000_000), " Ma"))
        .when(thousands, text(F.floor(start / 1_000), " ka"))
        .otherwise(text(start, "s"))
    )


def row_heading(kind: Column, title: Column, span: Column) -> Column:
    return (
        F.when(kind == "item", text("{{Q|", title, "}}"))
        .when(kind == "year", year_heading(title.try_cast("bigint"), span))
        .when(kind == "site", title)
        .when(kind == "unknown", UNKNOWN_HEADING)
        .when(kind == "none", NO_GROUP_HEADING)
        .otherwise(TOTALS_HEADING)
    )


def higher_group_class(value: Column, grouping_type: str | None = None) -> Column:
    """What an item group's higher group is: ``item``, ``image``, ``flag`` or ``text``."""
    other = F.lit("flag" if grouping_type == "country" else "text")
    return (
        F.when(value.rlike(r"^Q[0-9]+"), "item")
        .when(value.startswith(IMAGE_PREFIX), "image")
        .otherwise(other)
    )


def higher_group_cell(kind: Column, value: Column, grouping_type: str | None = None) -> Column:
    """The cell before the heading; the unknown row gets an empty one."""
    what = higher_group_class(value, grouping_type)
    image = F.replace(value, F.lit(IMAGE_PREFIX), F.lit(""))
    sort = F.when((kind == "item") & (what == "image"), image).otherwise(value)
    shown = (
        F.when(kind != "item", value)
        .when(what == "item", text("{{Q|", value, "}}"))
        .when(what == "image", text("[[File:", image, "|center|100px]]"))
        .when(what == "flag", text("{{Flag|", value, "}}"))
        .otherwise(value)
    )
    return (
        F.when(kind == "totals", "||\n")
        .when(kind.isin("none", "unknown"), "|\n")
        .otherwise(text('| data-sort-value="', sort, '"| ', shown, "\n"))
    )


def is_external(link: Column) -> Column:
    return link.startswith("http://") | link.startswith("https://")


def count_cell(kind: Column, link: Column, count: Column) -> Column:
    """The count, linked if the row has a link; special rows never link."""
    plain = (link.isNull() | (link == "")) | kind.isin("none", "totals")
    return (
        F.when(plain, text("| ", count, " \n"))
        .when(is_external(link), text("| [", link, " ", count, "] \n"))
        .otherwise(text("| [[", link, "|", count, "]] \n"))
    )


def percent_text(share: Column) -> Column:
    """``0`` for nothing, else at least one decimal: ``100.0``, ``33.33``."""
    return F.when(share == 0, "0").otherwise(share.cast("string"))


def value_cell(
    share: Column, value: Column, column_key: str, group_key: Column, template: str
) -> Column:
    fields = [
        F.lit(template),
        percent_text(share),
        value.cast("string"),
        F.lit(f"column={column_key}"),
        text("grouping=", group_key),
    ]
    return text("| {{", F.concat_ws("|", *fields), "}}\n")
