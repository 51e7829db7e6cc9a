"""Grouping edges and what happens to group rows after the count."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.facts import Facts, has_value
from factspan.functions.values import is_unknown, strip_prefix, year_bin
from factspan.operators.selection import among, follow_path, labels, select_entities
from factspan.operators.steps import Steps, followed
from factspan.spec import (
    Dashboard,
    EmptyGroupingError,
    GroupBy,
    Link,
    UnsupportedGroupingError,
    explicit_groups,
)

MAX_YEAR_BINS = 100
# Spans 1, 10, ... 10^18: the widest puts all years a claim can hold into 20 bins.
_SPAN_EXPONENTS = range(19)
_KIND_OF_TYPE = {"item": "item", "time": "year"}

UNKNOWN_KEY = "UNKNOWN_VALUE"


def group_kinds(facts: Facts) -> DataFrame:
    """(property, group_kind) by value type; null where values cannot be grouped."""
    kind = F.lit(None).cast("string")
    for value_type, name in _KIND_OF_TYPE.items():
        kind = F.when(F.col("value_type") == value_type, name).otherwise(kind)
    rows = facts.claims.filter(F.col("snak_type") == "value")
    types = rows.groupBy("property").agg(F.min("value_type").alias("value_type"))
    return types.select("property", kind.alias("group_kind"))


def frame_kind(edges: DataFrame) -> str:
    """Kind of a ready edge frame, by the declared type of ``group``."""
    declared = edges.schema["group"].dataType
    if isinstance(declared, T.StringType):
        return "item"
    if isinstance(declared, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "year"
    raise UnsupportedGroupingError(f"cannot group by {declared.simpleString()}")


def resolve_kind(facts: Facts, dashboard: Dashboard) -> Dashboard:
    """Fill in the kind of grouping, where none is declared: that of the values its entities have.

    Values of several types go by the first of their names. If no selected entity has a
    value, or the selector is empty, all values of the property tell.
    """
    by = dashboard.group_by
    if by.kind:
        return dashboard
    if by.edges is not None:
        return dashboard.with_kind(frame_kind(by.edges))
    known = F.when(F.col("snak_type") == "value", F.col("value_type"))
    found = None
    if not isinstance(dashboard.selector, str) or dashboard.selector:
        steps = Steps(facts.spark, {by.text: by.path})
        starts = select_entities(facts, dashboard.selector).distinct()
        ends = followed(facts, starts.select(F.lit(by.text).alias("path"), "entity_id"), steps)
        found = ends.agg(F.min(known)).first()[0]
    if found is None:
        last = facts.claims.filter(F.col("property") == by.path[-1])
        found = last.agg(F.min(known)).first()[0]
    if found is None:
        raise EmptyGroupingError(f"no values for {by.text}, cannot tell how to group")
    kind = _KIND_OF_TYPE.get(found)
    if kind is None:
        raise UnsupportedGroupingError(f"{by.text} has values of type {found}")
    return dashboard.with_kind(kind)


def group_edges(facts: Facts, by: GroupBy, near: Facts | None = None) -> DataFrame:
    """Distinct (entity_id, group); an entity is in each of its groups.

    The group is null where a date has no year. ``near`` has the facts of the
    entities in question, where they are cut down.
    """
    near = near or facts
    if by.edges is not None:
        group = F.col("group")
        if by.kind == "year" and frame_kind(by.edges) == "year":
            group = F.year(group)
        rows = by.edges.select("entity_id", group.cast("string").alias("group"))
    elif by.kind == "site":
        rows = near.sitelinks.select("entity_id", F.col("project_url").alias("group"))
    else:
        column = "time_year" if by.kind == "year" else "value"
        # follow_path yields distinct rows already.
        return follow_path(facts, by.path, column, near).withColumnRenamed("value", "group")
    return rows.distinct()


def restrict_groups(
    edges: DataFrame, dashboard: Dashboard, projects: dict | None = None
) -> DataFrame:
    """Keep the groups named by the dashboard, if any valid one is named."""
    named = explicit_groups(dashboard.groups, dashboard.group_by.kind, projects)
    return edges.filter(F.col("group").isin(*named)) if named else edges


def top_groups(groups: DataFrame, limits: dict[str, int | None], prefix: str) -> DataFrame:
    """The largest groups of each dashboard that has a limit; ties go by group key.

    Unknown groups are one row of the report later, so they neither count nor go.
    """
    if not any(limits.values()):
        return groups
    unknown = is_unknown(F.col("group"), prefix)
    known = groups.filter(~unknown)
    order = [F.col("count").desc(), F.col("group")]
    if len(limits) == 1:
        (limit,) = limits.values()
        top = known.orderBy(*order).limit(limit)
    else:
        place = F.row_number().over(Window.partitionBy("dashboard").orderBy(*order))
        most = per_dashboard({name: limit or 2**31 - 1 for name, limit in limits.items()})
        top = known.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")
    return top.unionByName(groups.filter(unknown))


def fold_unknown(
    kept: DataFrame, counted: DataFrame | None, cells: Sequence[str], prefix: str
) -> DataFrame:
    """Merge unknown groups into one row per dashboard, with a null ``title``.

    Its count adds up the kept unknown groups. Its cells add up the unknown
    groups of ``counted`` (all of them), as columns are not bound by the group
    threshold; without ``counted`` there is at most one unknown group, the kept one.
    """
    unknown = is_unknown(F.col("group"), prefix)
    rows = kept.withColumn("title", F.when(~unknown, F.col("group")))
    if counted is None:
        return rows.select("dashboard", "title", "count", *cells)
    sums = [F.sum(c).alias(c) for c in ("count", *cells)]
    folded = rows.groupBy("dashboard", "title").agg(*sums)
    if not cells:
        return folded
    everywhere = counted.filter(unknown).groupBy("dashboard")
    everywhere = everywhere.agg(F.struct(*[F.sum(c).alias(c) for c in cells]).alias("_all"))
    joined = folded.join(everywhere, "dashboard", "left")
    return joined.select(
        "dashboard",
        "title",
        "count",
        *[
            F.when(F.col("title").isNull(), F.col(f"_all.{c}")).otherwise(F.col(c)).alias(c)
            for c in cells
        ],
    )


def year_spans(groups: DataFrame, max_bins: int = MAX_YEAR_BINS) -> DataFrame:
    """(dashboard, span): the smallest power of ten giving at most ``max_bins`` bins."""
    spans = F.array(*[F.lit(10**k).cast("bigint") for k in _SPAN_EXPONENTS])
    bins = groups.filter(F.col("kind") == "year").select(
        "dashboard", F.col("title").cast("bigint").alias("_year"), F.explode(spans).alias("span")
    )
    counted = bins.groupBy("dashboard", "span").agg(
        F.count_distinct(F.floor(F.col("_year") / F.col("span"))).alias("_bins")
    )
    fitting = counted.filter(F.col("_bins") <= max_bins)
    return fitting.groupBy("dashboard").agg(F.min("span").alias("span"))


def rebin_years(
    groups: DataFrame, cells: Sequence[str], max_bins: int = MAX_YEAR_BINS
) -> DataFrame:
    """Merge years into the smallest span of 10^k that leaves ``max_bins`` bins.

    Counts and cells are added, not recounted; the bin's largest year gives its
    link, with the year in it replaced by the bin's start. Rows of other kinds
    stay as they are.
    """
    spans = year_spans(groups, max_bins)
    spanned = groups.join(spans, "dashboard", "left")
    is_year = F.col("kind") == "year"
    year = F.when(is_year, F.col("title").try_cast("bigint"))
    span = F.when(is_year, F.col("span")).otherwise(F.lit(1).cast("bigint"))
    start = F.when(
        is_year, year_bin(year, F.col("span")).cast("bigint").cast("string")
    ).otherwise(F.col("title"))
    link = F.when(
        is_year, F.replace(F.col("group_link"), F.col("title"), start)
    ).otherwise(F.col("group_link"))
    rows = spanned.select(
        "dashboard",
        "kind",
        start.alias("title"),
        span.alias("span"),
        link.alias("group_link"),
        "higher_group",
        F.struct(-F.col("count"), year).alias("_place"),
        "count",
        *cells,
    )
    return rows.groupBy("dashboard", "kind", "title", "span").agg(
        F.min_by("higher_group", "_place").alias("higher_group"),
        F.min_by("group_link", "_place").alias("group_link"),
        *[F.sum(c).alias(c) for c in ("count", *cells)],
    )


def per_dashboard(values: dict[str, object]) -> Column:
    """A constant of each dashboard, looked up by the ``dashboard`` column."""
    distinct = set(values.values())
    if len(distinct) == 1:
        return F.lit(distinct.pop())
    entries = [F.lit(x) for pair in values.items() for x in pair]
    return F.create_map(*entries)[F.col("dashboard")]


def higher_groups(facts: Facts, ids: DataFrame, path: Sequence[str]) -> DataFrame:
    """(title, higher_group): one higher group for each group id that has any."""
    found = follow_path(facts, path, start=among(facts, ids.select(F.col("title").alias("entity_id"))))
    value = F.min(strip_prefix(F.col("value"), facts.entity_prefix))
    return found.groupBy(F.col("entity_id").alias("title")).agg(value.alias("higher_group"))


def link_values(facts: Facts, ids: DataFrame, link: Link) -> DataFrame:
    """(title, link_value): what fills the link template of each group id."""
    few = among(facts, ids.select(F.col("title").alias("entity_id")))
    if link.by == "label":
        found = labels(few, link.arg).withColumnRenamed("label", "value")
    else:
        found = follow_path(facts, [link.arg], start=few)
    return found.groupBy(F.col("entity_id").alias("title")).agg(
        F.min("value").alias("link_value")
    )


def link_text(link: Link, key: Column, value: Column | None = None) -> Column:
    """The template with its placeholder filled; an empty value falls back to the key."""
    fill = key if value is None else F.coalesce(F.nullif(value, F.lit("")), key)
    return F.replace(F.lit(link.template), F.lit(link.placeholder), fill)


def _looked_up(
    groups: DataFrame, choices: dict[str, object], lookup_of, default_schema: str
) -> DataFrame:
    """Left join each dashboard's groups to the lookup its choice asks for."""
    distinct = list(dict.fromkeys(c for c in choices.values() if c is not None))
    if not distinct:
        name, kind = default_schema.split()
        return groups.withColumn(name, F.lit(None).cast(kind))
    place = {d: distinct.index(c) if c is not None else -1 for d, c in choices.items()}
    found = [
        lookup_of(choice).withColumn("_choice", F.lit(i)) for i, choice in enumerate(distinct)
    ]
    rows = groups.withColumn("_choice", per_dashboard(place))
    joined = rows.join(reduce(DataFrame.unionByName, found), ["_choice", "title"], "left")
    return joined.drop("_choice")


def decorate(groups: DataFrame, facts: Facts, dashboards: Sequence[Dashboard]) -> DataFrame:
    """Add ``higher_group`` and ``group_link`` to the kept groups.

    The groups are few by now, so the fact tables are cut down to them first.
    Only item groups have statements and labels of their own.
    """
    ids = groups.filter(F.col("kind") == "item").select("title")
    items = {d.name for d in dashboards if d.group_by.kind == "item"}
    paths = {d.name: d.higher if d.name in items else None for d in dashboards}
    groups = _looked_up(
        groups, paths, lambda path: higher_groups(facts, ids, path), "higher_group string"
    )
    has_higher = per_dashboard({d.name: d.higher is not None for d in dashboards})
    groups = groups.withColumn(
        "higher_group",
        F.when(
            has_higher & (F.col("kind") != "unknown"),
            F.coalesce(F.col("higher_group"), F.lit("")),
        ),
    )
    links = {d.name: d.link if d.group_by.kind != "site" else None for d in dashboards}
    fetched = {
        name: link if link and link.by != "id" and name in items else None
        for name, link in links.items()
    }
    groups = _looked_up(
        groups, fetched, lambda link: link_values(facts, ids, link), "link_value string"
    )
    key = F.coalesce(F.col("title"), F.lit(UNKNOWN_KEY))
    text = F.lit(None).cast("string")
    for link in dict.fromkeys(link for link in links.values() if link):
        mine = per_dashboard({name: links[name] == link for name in links})
        text = F.when(mine, link_text(link, key, F.col("link_value"))).otherwise(text)
    return groups.withColumn("group_link", text).drop("link_value")
