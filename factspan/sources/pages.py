"""Dashboards in page texts: find, read, rename, and put reports back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.functions.values import literal_regex, strip
from factspan.spec import PARAM_RENAMES, Dashboard, SpecError, dashboard_from_params

# The marker templates around a report, and the escaped pipe.
START_TEMPLATE = "Property dashboard"
END_TEMPLATE = "Property dashboard end"
ESCAPED_PIPE = "{{!}}"

_COMMENT = r"(?:\s*<!--[\s\S]*?-->)*\s*"


def _named(title: str) -> str:
    """A page name as wikis read it: first letter in either case, ``_`` for a space."""
    first, *others = title.split()
    start = f"[{first[0].lower()}{first[0].upper()}]{literal_regex(first[1:])}"
    return r"[\s_]*" + r"[ _]+".join([start, *map(literal_regex, others)])


def _opening(title: str) -> str:
    return rf"\{{\{{{_COMMENT}{_named(title)}{_COMMENT}(?=\||\}}\}})"


def has_markers(text: Column, start: str = START_TEMPLATE, end: str = END_TEMPLATE) -> Column:
    """Whether a page has both markers."""
    return text.rlike(_opening(start)) & text.rlike(_opening(end))


def _tokens(text: Column, start: str, end: str) -> Column:
    """A page's text in pieces that add up to it.

    Openings of both markers, comments, verbatim parts, brackets, bars, and what lies
    between them. A marker inside a comment or a verbatim part is none.
    """
    pattern = rf"(?s){_opening(start)}|{_opening(end)}|<!--.*?-->|<nowiki>.*?</nowiki>"
    pattern += r"|\{\{|\}\}|\[\[|\]\]|\||[^{}\[\]|<]+|."
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _is_opening(token: Column, title: str) -> Column:
    pattern = rf"\A\{{\{{{_COMMENT}{_named(title)}{_COMMENT}\z"
    return token.startswith("{{") & token.rlike(pattern)


def _read_tokens(tokens: Column, start: str) -> Column:
    """Where the start templates lie among a page's tokens: (starts, bars, names, ends).

    ``bars`` part a template's own parameters, ``names`` are the tokens a parameter
    starts with. A running depth tells a template's own bars and end from those of the
    templates and links inside it, however deep these are. A template that does not
    end has no place in ``ends``.
    """
    none = F.expr("cast(array() as array<int>)")
    zero = F.struct(
        F.lit(0).alias("at"),
        F.lit(-1).alias("depth"),  # -1 outside of a start template, 0 at its own bars
        F.lit(False).alias("fresh"),
        *[none.alias(name) for name in ("starts", "bars", "names", "ends")],
    )

    def further(state: Column, token: Column) -> Column:
        depth, at = state["depth"], state["at"]
        starts = (depth < 0) & _is_opening(token, start)
        own = depth == 0
        ends, bar = own & (token == "}}"), own & (token == "|")
        opens = (depth >= 0) & (token.startswith("{{") | (token == "[["))
        closes = (depth > 0) & token.isin("}}", "]]")
        blank = token.startswith("<!--") | token.rlike(r"\A\s*\z")
        names = state["fresh"] & own & ~blank & ~ends & ~bar
        after = (
            F.when(starts, 0)
            .when(ends, -1)
            .when(opens, depth + 1)
            .when(closes, depth - 1)
            .otherwise(depth)
        )

        def more(name: str, here: Column) -> Column:
            longer = F.concat(state[name], F.array(at))
            return F.when(here, longer).otherwise(state[name]).alias(name)

        return F.struct(
            (at + 1).alias("at"),
            after.alias("depth"),
            (bar | (state["fresh"] & blank)).alias("fresh"),
            more("starts", starts),
            more("bars", bar),
            more("names", names),
            more("ends", ends),
        )

    return F.aggregate(tokens, zero, further)


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once per row, however often it is used.

    As a plain column its expression may be put in the place of each use, also within
    lambdas and filters.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _with_places(rows: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """Rows with ``_tokens`` and the ``_places`` of the start templates among them."""
    rows = _once(rows, "_tokens", _tokens(F.col(text), start, end))
    return _once(rows, "_places", _read_tokens(F.col("_tokens"), start))


def _between(tokens: Column, after: Column, before: Column) -> Column:
    """The tokens between two places."""
    return F.slice(tokens, after + 2, F.greatest(before - after - 1, F.lit(0)))


def _read(pages: DataFrame, page: str, text: str, start: str, end: str) -> DataFrame:
    """(page, closed, params): whether the first dashboard ends, and its parameters' texts."""
    marked = pages.filter(has_markers(F.col(text), start, end))
    marked = marked.select(F.col(page).alias("page"), F.col(text).alias("text"))
    placed = _with_places(marked, "text", start, end)
    tokens, places = F.col("_tokens"), F.col("_places")
    stop = F.get(places["ends"], F.lit(0))
    own = F.concat(F.filter(places["bars"], lambda at: at < stop), F.array(stop))
    placed = _once(placed, "_cuts", own)
    cuts = F.col("_cuts")

    def param(at: Column, i: Column) -> Column:
        inside = _between(tokens, at, F.get(cuts, i + 1))
        return F.array_join(F.filter(inside, lambda t: ~t.startswith("<!--")), "")

    bars = F.slice(cuts, 1, F.greatest(F.size(cuts) - 1, F.lit(0)))
    none = F.expr("cast(array() as array<string>)")
    params = F.when(stop.isNotNull(), F.transform(bars, param)).otherwise(none)
    # A marker that is in comments only starts nothing.
    started = placed.filter(F.size(places["starts"]) > 0)
    return _once(started, "params", params).select("page", stop.isNotNull().alias("closed"), "params")


def dashboard_params(
    pages: DataFrame,
    page: str = "page",
    text: str = "text",
    start: str = START_TEMPLATE,
    end: str = END_TEMPLATE,
) -> DataFrame:
    """(page, field, value): parameters of each page's first dashboard.

    Escaped pipes become pipes, names are trimmed, empty names dropped; the last
    of several parameters with one name wins. Pages need both markers. Pages whose
    template does not end are in :func:`unreadable_pages`.
    """
    closed = _read(pages, page, text, start, end).filter("closed")
    rows = closed.select("page", F.posexplode("params").alias("pos", "param"))
    pair = F.split("param", "=", 2)
    value = F.coalesce(F.get(pair, F.lit(1)), F.lit(""))
    rows = rows.select(
        "page",
        "pos",
        strip(pair[0]).alias("field"),
        strip(F.replace(value, F.lit(ESCAPED_PIPE), F.lit("|"))).alias("value"),
    ).filter("field <> ''")
    return rows.groupBy("page", "field").agg(F.max_by("value", "pos").alias("value"))


def unreadable_pages(
    pages: DataFrame,
    page: str = "page",
    text: str = "text",
    start: str = START_TEMPLATE,
    end: str = END_TEMPLATE,
) -> DataFrame:
    """(page, error) of the pages whose dashboard template does not end."""
    broken = _read(pages, page, text, start, end).filter("not closed")
    return broken.select("page", F.lit("the dashboard template does not end").alias("error"))


def rename_params(params: DataFrame) -> DataFrame:
    """Present names for deprecated parameters; a present name given as well wins."""
    field = F.col("field")
    renamed = field
    for old, new in PARAM_RENAMES.items():
        renamed = F.when(field == old, new).otherwise(renamed)
    rows = params.select("page", renamed.alias("field"), "value", (field == renamed).alias("own"))
    return rows.groupBy("page", "field").agg(F.max_by("value", "own").alias("value"))


def migrate_texts(
    pages: DataFrame, text: str = "text", start: str = START_TEMPLATE, end: str = END_TEMPLATE
) -> DataFrame:
    """Pages with deprecated parameters renamed inside start templates, nowhere else."""
    placed = _with_places(pages, text, start, end)
    names = F.col("_places")["names"]

    def renamed(token: Column, at: Column) -> Column:
        new_token = token
        for old, new in PARAM_RENAMES.items():
            pattern = rf"\A(\s*){literal_regex(old)}(\s*=)"
            new_token = F.regexp_replace(new_token, pattern, rf"$1{new}$2")
        return F.when(F.array_contains(names, at), new_token).otherwise(token)

    whole = F.array_join(F.transform("_tokens", renamed), "")
    kept = F.when(F.size(names) > 0, whole).otherwise(F.col(text))
    return placed.withColumn(text, kept).select(*pages.columns)


def splice_reports(
    pages: DataFrame,
    reports: DataFrame,
    page: str = "page",
    text: str = "text",
    start: str = START_TEMPLATE,
    end: str = END_TEMPLATE,
) -> DataFrame:
    """Pages with their report between the markers of the first dashboard.

    ``reports`` has ``page`` and ``report``. The report takes the place of what lies
    between the template that starts the dashboard, whole, and the next end marker.
    Pages without a report or without markers stay as they are. Nothing in a report is
    taken as a pattern.
    """
    joined = pages.join(reports.select(F.col("page").alias(page), F.col("report").alias("_report")), page, "left")
    placed = _with_places(joined, text, start, end)
    tokens, stop = F.col("_tokens"), F.get(F.col("_places")["ends"], F.lit(0))
    # Where the end marker opens; the tokens are looked at only where there is a template.
    after = F.slice(tokens, stop + 2, F.size(tokens))
    tail = F.transform(after, lambda t, i: F.when(_is_opening(t, end), i))
    marker = F.array_min(F.array_compact(tail)) + stop + 1
    head = F.array_join(F.slice(tokens, 1, stop + 1), "")
    rest = F.array_join(F.slice(tokens, marker + 1, F.size(tokens)), "")
    spliced = F.concat(head, F.lit("\n"), F.col("_report"), F.lit("\n"), rest)
    return placed.withColumn(text, F.coalesce(spliced, F.col(text))).select(*pages.columns)


def load_dashboards(
    params: DataFrame, projects: dict[str, tuple[str, str]] | None = None
) -> tuple[list[Dashboard], DataFrame]:
    """Valid dashboards, and (page, error) rows for the others.

    Configuration is needed on the driver to build the plan.
    """
    spark = params.sparkSession
    entries = F.map_from_entries(F.collect_list(F.struct("field", "value")))
    by_page = params.groupBy("page").agg(entries.alias("params"))
    rows = by_page.orderBy("page").collect()
    dashboards, errors = [], []
    for row in rows:
        try:
            dashboards.append(dashboard_from_params(row.params, str(row.page), projects))
        except SpecError as error:
            errors.append((str(row.page), str(error)))
    return dashboards, spark.createDataFrame(errors, "page string, error string")


def unique_pages(registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A dashboard registry without repeated entries."""
    return registry.dropDuplicates(list(keys))
