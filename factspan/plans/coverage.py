"""Coverage of one or many dashboards in one plan.

All dashboards share one presence pass over the fact tables. Their group rows,
"no grouping" rows and totals come from the same entity table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.facts import Facts
from factspan.operators.grouping import (
    decorate,
    fold_unknown,
    group_edges,
    per_dashboard,
    rebin_years,
    resolve_kind,
    restrict_groups,
    top_groups,
)
from factspan.operators.presence import flag_name, pair_presence, presence
from factspan.operators.selection import among, select_entities
from factspan.operators.tables import written
from factspan.spec import Column, Dashboard, EmptyGroupingError, GroupBy, follows_group

SECTION_GROUPS, SECTION_NO_GROUP, SECTION_TOTALS = 0, 1, 2
NO_GROUP_KEY, TOTALS_KEY = "None", ""


class Coverage:
    """The plan of one or more dashboards.

    Some frames feed several branches: the selection, the edges to the groups, the
    entities with their flags, and the raw group counts. Each is computed once and
    written to the shared folder, so no branch repeats the pass over the facts, also
    when executors are lost.
    """

    def __init__(self, facts: Facts, dashboards: Dashboard | Sequence[Dashboard], begun=None):
        """``begun`` is a fleet with some of these dashboards; its selections and edges are used."""
        if isinstance(dashboards, Dashboard):
            dashboards = [dashboards]
        names = [d.name for d in dashboards]
        if len(set(names)) != len(names):
            raise ValueError("dashboard names must be unique")
        self.facts = facts
        self.dashboards = [resolve_kind(facts, d) for d in dashboards]
        by_key = {c.key: c for d in self.dashboards for c in d.columns}
        self.keys = list(by_key)
        self.columns: dict[str, Column] = {
            flag_name(i): column for i, column in enumerate(by_key.values())
        }
        self.cells = list(self.columns)
        sites = any(d.group_by.kind == "site" and d.groups for d in self.dashboards)
        self._projects = facts.project_table() if sites else None
        self._kept: dict[str, DataFrame] = {}
        self._near: Facts | None = None
        self._begun = begun
        self._ready = {d.name for d in begun.dashboards} & set(names) if begun else set()

    def _keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = written(build())
        return self._kept[name]

    # Entities

    def _edges(self, by: GroupBy) -> DataFrame:
        """Distinct (entity_id, group) of the selected entities.

        Written where both "no grouping" rows and groups are made of them.
        """
        if by not in self._grouping_marks():
            return self._found_edges(by)
        name = f"edges of {self._grouping_marks()[by]}"
        return self._keep(name, lambda: self._found_edges(by))

    def _found_edges(self, by: GroupBy) -> DataFrame:
        mine = [d.name for d in self.dashboards if d.group_by == by]
        if by.edges is not None or by.kind == "site" or not self._ready.issuperset(mine):
            return group_edges(self.facts, by, self.near())
        group = F.col("time_year" if by.kind == "year" else "value").cast("string")
        rows = self._begun.edges().filter(F.col("dashboard").isin(*mine))
        return rows.select("entity_id", group.alias("group")).distinct()

    def _grouping_marks(self) -> dict[GroupBy, str]:
        """A flag for each grouping that some "no grouping" row asks about."""
        wanted = dict.fromkeys(d.group_by for d in self.dashboards if d.row_no_group)
        return {by: f"grouped{i}" for i, by in enumerate(wanted)}

    def near(self) -> Facts:
        """The facts of the selected entities."""
        if self._near is None and self._ready.issuperset(d.name for d in self.dashboards):
            self._near = self._begun.near()
        if self._near is None:
            ids = self.selected().select("entity_id").distinct()
            self._near = among(self.facts, ids)
        return self._near

    def selected(self) -> DataFrame:
        """(dashboard, entity_id, times): the selection, with its multiplicity."""
        return self._keep("selected", self._selected)

    def _selected(self) -> DataFrame:
        parts = [
            select_entities(self.facts, d.selector).select(
                F.lit(d.name).alias("dashboard"), "entity_id"
            )
            for d in self.dashboards
            if d.name not in self._ready
        ]
        found = []
        if self._ready:
            found.append(self._begun.selected().filter(F.col("dashboard").isin(*sorted(self._ready))))
        if parts:
            bag = reduce(DataFrame.union, parts)
            found.append(bag.groupBy("dashboard", "entity_id").agg(F.count(F.lit(1)).alias("times")))
        return reduce(DataFrame.union, found)

    def entities(self) -> DataFrame:
        """The selection with one boolean per column and whether it is in a group."""
        return self._keep("entities", self._entities)

    def _entities(self) -> DataFrame:
        marks = self._grouping_marks()
        edges = {name: self._edges(by) for by, name in marks.items()}
        rows = self.selected()
        if self.columns or edges:
            found = presence(self.near(), self.columns, edges)
            rows = rows.join(found, "entity_id", "left")
        flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in self.cells]
        grouped = F.lit(True)
        for by, name in marks.items():
            mine = per_dashboard(
                {d.name: d.row_no_group and d.group_by == by for d in self.dashboards}
            )
            grouped = F.when(mine, F.coalesce(F.col(name), F.lit(False))).otherwise(grouped)
        return rows.select(
            "dashboard", "entity_id", "times", *flags, grouped.alias("grouped")
        )

    def pairs(self) -> DataFrame:
        """(edge_set, entity_id, group) with flags of the columns tied to the group.

        Dashboards with the same grouping and the same named groups share a set.
        """
        tied = [n for n, c in self.columns.items() if follows_group(c)]
        parts = []
        for i, (_, sharing) in enumerate(self._edge_sets().items()):
            first = sharing[0]
            edges = restrict_groups(self._edges(first.group_by), first, self._projects)
            # A year is never equal to a statement's value.
            matched = tied and first.group_by.kind != "year"
            if matched:
                own = pair_presence(self.near(), self.columns)
                edges = edges.join(own, ["entity_id", "group"], "left")
            flags = [
                (F.coalesce(F.col(n), F.lit(False)) if matched else F.lit(False)).alias(f"own_{n}")
                for n in tied
            ]
            parts.append(edges.select(F.lit(i).alias("edge_set"), "entity_id", "group", *flags))
        return reduce(DataFrame.union, parts)

    def _edge_sets(self) -> dict[tuple, list[Dashboard]]:
        sets: dict[tuple, list[Dashboard]] = {}
        for d in self.dashboards:
            sets.setdefault((d.group_by, d.groups), []).append(d)
        return sets

    # Counts

    def counted_groups(self) -> DataFrame:
        """(dashboard, group, count, cells) of every raw group.

        Pairs and entities are distinct, so plain sums replace distinct counts
        and are combined before the shuffle: a huge group costs one row per task.
        """
        return self._keep("counted", self._counted_groups)

    def _counted_groups(self) -> DataFrame:
        sets = list(self._edge_sets().values())
        place = {d.name: i for i, sharing in enumerate(sets) for d in sharing}
        keys = ["entity_id"] if len(sets) == 1 else ["edge_set", "entity_id"]
        entities = self.entities().withColumn("edge_set", per_dashboard(place))
        pairs = self.pairs()
        if len(sets) == 1:
            pairs = pairs.drop("edge_set")
            entities = entities.drop("edge_set")
        rows = pairs.join(entities, keys, "inner")
        sums = []
        for name, column in self.columns.items():
            flag = F.col(f"own_{name}") if follows_group(column) else F.col(name)
            sums.append(F.sum(flag.cast("bigint")).alias(name))
        counted = rows.groupBy("dashboard", "group").agg(F.count(F.lit(1)).alias("count"), *sums)
        floor = {d.name: d.cell_threshold for d in self.dashboards}
        if max(floor.values()) > 1:
            least = per_dashboard(floor)
            cells = [F.when(F.col(c) >= least, F.col(c)).otherwise(0).alias(c) for c in self.cells]
            counted = counted.select("dashboard", "group", "count", *cells)
        return counted

    def _above_threshold(self) -> DataFrame:
        threshold = per_dashboard({d.name: d.threshold for d in self.dashboards})
        return self.counted_groups().filter(F.col("count") >= threshold)

    def reported(self) -> DataFrame:
        """Names of the dashboards that have any group to report."""
        return self._above_threshold().select("dashboard").distinct()

    def groups(self) -> DataFrame:
        """Group rows as reported: kept, folded, decorated and rebinned."""
        counted = self.counted_groups()
        limits = {d.name: d.limit for d in self.dashboards}
        prefix = self.facts.unknown_prefix
        kept = top_groups(self._above_threshold(), limits, prefix)
        kinds = {d.name: d.group_by.kind for d in self.dashboards}
        many_unknown = "item" in kinds.values()
        groups = fold_unknown(
            kept, counted if many_unknown else None, self.cells, prefix
        )
        kind = F.when(F.col("title").isNull(), "unknown").otherwise(per_dashboard(kinds))
        groups = groups.withColumn("kind", kind)
        groups = decorate(groups, self.facts, self.dashboards)
        if "year" in kinds.values():
            return rebin_years(groups, self.cells)
        return groups.withColumn("span", F.lit(1).cast("bigint"))

    def sums(self) -> DataFrame:
        """"No grouping" and totals rows of the bag; group rows never add up to them."""
        flags = {"count": F.lit(True)} | {c: F.col(c) for c in self.cells}
        kinds = {SECTION_TOTALS: F.lit(True)}
        if any(d.row_no_group for d in self.dashboards):
            kinds[SECTION_NO_GROUP] = ~F.col("grouped")
        sums = [
            F.sum(F.when(inside & flag, F.col("times")).otherwise(0)).alias(f"{name}_{section}")
            for section, inside in kinds.items()
            for name, flag in flags.items()
        ]
        summed = self.entities().groupBy("dashboard").agg(*sums)
        rows = [
            F.struct(
                F.lit(section).alias("section"),
                *[F.col(f"{name}_{section}").alias(name) for name in flags],
            )
            for section in kinds
        ]
        found = summed.select("dashboard", F.inline(F.array(*rows)))
        wanted = [
            (d.name, section)
            for d in self.dashboards
            for section, on in (
                (SECTION_NO_GROUP, d.row_no_group),
                (SECTION_TOTALS, d.row_totals),
            )
            if on
        ]
        # An empty selection still has its rows, with zeros.
        spark = self.facts.spark
        asked = spark.createDataFrame(wanted, "dashboard string, section int")
        joined = asked.join(found, ["dashboard", "section"], "left")
        return joined.fillna(0, ["count", *self.cells])

    def lines(self) -> DataFrame:
        """Every report row: groups, then "no grouping", then totals."""
        groups = self.groups()
        span = F.when(F.col("kind") == "year", F.col("span"))
        key = F.when(F.col("kind") == "unknown", "UNKNOWN_VALUE").otherwise(
            F.when(span > 1, F.concat_ws("/", "title", span)).otherwise(F.col("title"))
        )
        rows = groups.select(
            "dashboard",
            F.lit(SECTION_GROUPS).alias("section"),
            "kind",
            key.alias("group_key"),
            "title",
            span.alias("span"),
            "higher_group",
            "group_link",
            "count",
            *self.cells,
        )
        if not any(d.row_no_group or d.row_totals for d in self.dashboards):
            return rows
        totals = F.col("section") == SECTION_TOTALS
        special = self.sums().select(
            "dashboard",
            "section",
            F.when(totals, "totals").otherwise("none").alias("kind"),
            F.when(totals, TOTALS_KEY).otherwise(NO_GROUP_KEY).alias("group_key"),
            F.lit(None).cast("string").alias("title"),
            F.lit(None).cast("bigint").alias("span"),
            F.lit(None).cast("string").alias("higher_group"),
            F.lit(None).cast("string").alias("group_link"),
            "count",
            *self.cells,
        )
        return rows.unionByName(special)

    def checked_lines(self) -> DataFrame:
        """Like :meth:`lines`, but a dashboard without any group is an error."""
        if self._above_threshold().isEmpty():
            raise EmptyGroupingError("no groups found")
        return self.lines()
