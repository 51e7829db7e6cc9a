"""Member lists: one list of entities for each linked group of a report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.facts import Facts, has_value
from factspan.functions.markup import is_external
from factspan.functions.values import is_unknown, year_bin
from factspan.operators.grouping import UNKNOWN_KEY, group_edges, resolve_kind
from factspan.operators.selection import among, labels, select_entities, truthy
from factspan.operators.tables import written
from factspan.spec import Dashboard, Property, Qualifier, Referenced, Text, follows_group


def groups_to_list(
    lines: DataFrame, existing: DataFrame, foreign_prefixes: Sequence[str] = ()
) -> DataFrame:
    """Groups that get a list: linked inside the site, without a page yet.

    ``existing`` has the ``title`` of each page. Links that start with a foreign
    prefix lie on another site; the first of them ends the work.
    """
    link = F.col("group_link")
    linked = lines.filter((F.col("section") == 0) & (F.coalesce(link, F.lit("")) != ""))
    inside = linked.filter(~is_external(link))
    place = F.struct(
        (F.col("kind") == "unknown").alias("last"),
        (-F.col("count")).alias("size"),
        F.col("group_key").alias("key"),
    )
    if foreign_prefixes:
        foreign = reduce(lambda a, b: a | b, [link.startswith(p) for p in foreign_prefixes])
        stops = inside.filter(foreign).groupBy("dashboard").agg(F.min(place).alias("_stop"))
        inside = inside.join(stops, "dashboard", "left")
        before = F.col("_stop").isNull() | (place < F.col("_stop"))
        inside = inside.filter(before).drop("_stop")
    pages = existing.select(F.col("title").alias("group_link")).distinct()
    return inside.join(pages, "group_link", "left_anti")


# What a list shows first; fields of other kinds follow in the order of the columns.
_FIELD_RANKS = {"label": 0, "description": 1}


def list_fields(dashboard: Dashboard) -> list[str]:
    """What a list shows: labels first, then descriptions, then the rest; no site links."""
    fields = [c.list_field for c in dashboard.columns if c.list_field]
    kinds = {field.split("/")[0] for field in fields}
    fields += [] if "label" in kinds else ["label"]
    rank = lambda field: _FIELD_RANKS.get(field.split("/")[0], len(_FIELD_RANKS))
    return sorted(dict.fromkeys(fields), key=rank)


_FIELDS = (
    "dashboard string, position int, field string, source string, property string, "
    "qualifier string, wanted string, tied boolean"
)
# Where a field's values come from.
_NAMED, _TEXT, _VALUE, _QUALIFIER = "named", "text", "value", "qualifier"


def _field_rows(dashboard: Dashboard) -> list[tuple]:
    """The fields of a dashboard as rows of ``_FIELDS``."""
    sources: dict[str, tuple] = {"label": (_NAMED, None, None, None, False)}
    for c in dashboard.columns:
        if isinstance(c, Text):
            sources[c.list_field] = (_TEXT, c.kind, c.lang, None, False)
        elif isinstance(c, Property | Referenced):
            sources[c.list_field] = (_VALUE, c.property, None, None, False)
        elif isinstance(c, Qualifier):
            tied = follows_group(c)
            wanted = None if tied else c.value
            sources[c.list_field] = (_QUALIFIER, c.property, c.qualifier, wanted, tied)
    return [(dashboard.name, i, f, *sources[f]) for i, f in enumerate(list_fields(dashboard))]


def _field_values(facts: Facts, fields: DataFrame, lang: str) -> DataFrame:
    """Distinct (entity_id, field, value, slot) of all listed fields.

    ``slot`` is the group a value belongs to, for qualifiers tied to the group, else empty.
    """
    wanted = fields.drop("dashboard", "position").distinct()
    of = lambda source: wanted.filter(F.col("source") == source).drop("source")
    named = labels(facts, lang).join(of(_NAMED).select("field"))
    named = named.select("entity_id", "field", F.col("label").alias("value"))
    kinds = of(_TEXT).select("field", F.col("property").alias("kind"), F.col("qualifier").alias("lang"))
    texts = facts.terms.join(kinds, ["kind", "lang"])
    texts = texts.select("entity_id", "field", F.col("text").alias("value"))
    asked = of(_VALUE).select("field", "property")
    listed = facts.claims.join(asked.select("property").distinct(), "property", "left_semi")
    values = truthy(replace(facts, claims=listed)).filter(has_value()).join(asked, "property")
    values = values.select("entity_id", "field", "value")
    free = reduce(DataFrame.unionByName, [named, texts, values])
    quals = of(_QUALIFIER).select(
        "field", "property", "wanted", "tied", F.col("qualifier").alias("_qualifier")
    )
    claims = facts.claims.select("statement_id", "entity_id", "property", F.col("value").alias("_owner"))
    claims = claims.join(quals, "property")
    claims = claims.filter(F.col("wanted").isNull() | (F.col("_owner") == F.col("wanted")))
    found = facts.qualifiers.filter(has_value())
    found = found.select("statement_id", F.col("property").alias("_qualifier"), "value")
    rows = claims.join(found, ["statement_id", "_qualifier"])
    slot = F.when(F.col("tied"), F.col("_owner")).otherwise("")
    rows = rows.select("entity_id", "field", "value", slot.alias("slot"))
    return free.withColumn("slot", F.lit("")).unionByName(rows).distinct()


def members_of(pairs: DataFrame, groups: DataFrame, unknown_prefix: str) -> DataFrame:
    """Distinct (dashboard, group_key, entity_id) of the report rows in ``groups``.

    ``pairs`` are (dashboard, entity_id, group, kind). All year rows of a dashboard have
    one span.
    """
    spans = groups.groupBy("dashboard").agg(F.coalesce(F.max("span"), F.lit(1)).alias("_span"))
    rows = pairs.join(spans, "dashboard")
    group = F.col("group")
    start = year_bin(group.try_cast("bigint"), F.col("_span")).cast("bigint").cast("string")
    binned = F.when(F.col("_span") > 1, F.concat_ws("/", start, F.col("_span"))).otherwise(start)
    key = F.when(is_unknown(group, unknown_prefix), UNKNOWN_KEY)
    key = key.when(F.col("kind") == "year", binned).otherwise(group)
    rows = rows.select("dashboard", key.alias("group_key"), "entity_id")
    wanted = groups.select("dashboard", "group_key").distinct()
    return rows.join(wanted, ["dashboard", "group_key"], "left_semi").distinct()


def listed(
    facts: Facts, dashboards: Sequence[Dashboard], members: DataFrame, lang: str = "en"
) -> DataFrame:
    """(dashboard, group_key, entity_id, position, field, value) of the ``members``.

    What the dashboards list is a table, so the plan is the same for any number of them.
    The facts are cut down to the members before ranks are compared or labels looked up.
    One row per shown value, and one with a null value for a field an entity lacks, so no
    entity's values are gathered in one place.
    """
    rows = [row for d in dashboards for row in _field_rows(d)]
    fields = written(facts.spark.createDataFrame(rows, _FIELDS).coalesce(1))
    members = written(members)
    near = among(facts, members.select("entity_id").distinct())
    shown = members.join(fields.select("dashboard", "position", "field", "tied"), "dashboard")
    slot = F.when(F.col("tied"), F.col("group_key")).otherwise("")
    shown = shown.withColumn("slot", slot)
    met = shown.join(_field_values(near, fields, lang), ["entity_id", "field", "slot"], "left")
    return met.select("dashboard", "group_key", "entity_id", "position", "field", "value")


def list_members(facts: Facts, dashboard: Dashboard, groups: DataFrame) -> DataFrame:
    """Distinct (dashboard, group_key, entity_id) of one dashboard's report rows in ``groups``."""
    dashboard = resolve_kind(facts, dashboard)
    selected = select_entities(facts, dashboard.selector).distinct()
    edges = group_edges(facts, dashboard.group_by).join(selected, ["entity_id"], "left_semi")
    name, kind = F.lit(dashboard.name), F.lit(dashboard.group_by.kind)
    pairs = edges.select(name.alias("dashboard"), "entity_id", "group", kind.alias("kind"))
    groups = groups.withColumn("dashboard", name)
    if "span" not in groups.columns:
        groups = groups.withColumn("span", F.lit(1))
    return members_of(pairs, groups, facts.unknown_prefix)


def member_lists(
    facts: Facts, dashboard: Dashboard, groups: DataFrame, lang: str = "en"
) -> DataFrame:
    """(group_key, entity_id, position, field, value) of one dashboard's listed groups."""
    members = list_members(facts, dashboard, groups)
    return listed(facts, [dashboard], members, lang).drop("dashboard")
