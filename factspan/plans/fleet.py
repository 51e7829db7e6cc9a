"""Any number of dashboards in one plan: their settings are tables, their cells rows.

Where :class:`factspan.plans.coverage.Coverage` has a column for each report column, this
plan has rows, so its size does not grow with the dashboards. What a dashboard asks
for (columns, checks, paths, thresholds, links) is joined to the facts.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factspan.facts import Facts, has_value
from factspan.functions.markup import (
    CELL_TEMPLATE,
    count_cell,
    higher_group_cell,
    percent_text,
    row_heading,
    text,
)
from factspan.functions.values import is_unknown, percent, strip_prefix
from factspan.operators import paths
from factspan.operators.grouping import _KIND_OF_TYPE, UNKNOWN_KEY, frame_kind, rebin_years
from factspan.operators.selection import among, select_entities
from factspan.operators.steps import Steps, followed
from factspan.operators.tables import shared_folder, written
from factspan.plans.coverage import (
    NO_GROUP_KEY,
    SECTION_GROUPS,
    SECTION_NO_GROUP,
    SECTION_TOTALS,
    TOTALS_KEY,
)
from factspan.plans.output import with_places
from factspan.plans.report import report_head
from factspan.spec import (
    POOR_REFERENCE_PROPERTIES,
    Dashboard,
    Property,
    Qualifier,
    Referenced,
    SiteLink,
    SpecError,
    Text,
    UnsupportedGroupingError,
    explicit_groups,
    follows_group,
)

# Selectors that one job reads; what Spark has to plan at once stays of one size.
SELECTORS_A_JOB = 16

_SELECTED = "selection int, entity_id string, times long"
_GIVEN = "grouping string, entity_id string, value string, time_year long"
_SITE = "site"

# Places in a long that tells which of some a statement has; the sign is not used.
_WORD = 63


def _message(error: Exception) -> str:
    lines = [line for line in str(error).splitlines() if line.strip()]
    return lines[0] if lines else type(error).__name__


def _numbered(values) -> dict:
    return {value: i for i, value in enumerate(dict.fromkeys(values))}


def _bits(rows: DataFrame, name: str, count: int, key: str = "statement_id", *more: Expr) -> DataFrame:
    """(key, name0, name1, ...): the places of ``rows(key, place)`` as bits of longs; none without place."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % _WORD)
    word = F.floor(F.col("place") / _WORD)
    words = [
        F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"{name}{i}")
        for i in range(_words(count))
    ]
    return rows.groupBy(key).agg(*words, *more)


def _bit(name: str, place: Expr, count: int) -> Expr:
    """Whether the bit of ``place`` is set in numbers made by :func:`_bits`, which may be missing."""
    words = F.array(*[F.col(f"{name}{i}") for i in range(_words(count))])
    word = F.get(words, F.floor(place / _WORD).cast("int"))
    bit = F.call_function("shiftright", word, place % _WORD).bitwiseAND(F.lit(1).cast("long"))
    return F.coalesce(bit == 1, F.lit(False))


def _words(count: int) -> int:
    return max(1, -(-count // _WORD))


class Fleet:
    """The plan of many dashboards, and how each of them fared."""

    def __init__(self, facts: Facts, dashboards: Sequence[Dashboard]):
        names = [d.name for d in dashboards]
        if len(set(names)) != len(names):
            raise ValueError("dashboard names must be unique")
        self.facts, self.spark = facts, facts.spark
        self.failed: dict[str, str] = {}
        self._kept: dict[str, DataFrame] = {}
        self._seconds: dict[str, float] = {}
        self.asked = list(dashboards)
        self.dashboards = self._runnable(self._selectable(self.asked))
        self._settle()

    def _keep(self, name: str, build) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = written(build())
        return self._kept[name]

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        """A setting as a table whose size Spark knows, so that it picks how to join it."""
        return written(self.spark.createDataFrame(rows, schema).coalesce(1))

    # Selections

    def _selectable(self, dashboards: Sequence[Dashboard]) -> list[Dashboard]:
        """Write the selections; dashboards whose selector fails are left out.

        Selectors that several dashboards share run once. Path selectors with the same
        path are one search. Others run a few to a job, without those that cannot even be
        planned; if a job fails, its selectors run one by one.
        """
        key = lambda d: d.selector if isinstance(d.selector, str) else id(d.selector)
        self._selection_of = {d.name: key(d) for d in dashboards}
        selectors = {key(d): d.selector for d in dashboards}
        numbers = _numbered(selectors)
        self._place_of = lambda name: numbers[self._selection_of[name]]
        self._folder = shared_folder(self.spark)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(place)
        self._table([], _SELECTED).write.parquet(self._folder)
        by_path: dict = {}
        others: list[tuple] = []
        errors: dict = {}
        for chosen, selector in selectors.items():
            if not (isinstance(selector, str) and paths.is_path_text(selector)):
                others.append((chosen, selector))
                continue
            try:
                by_path[chosen] = paths.conditions_from_text(selector)
            except SpecError as error:
                errors[chosen] = str(error)
        if by_path:
            found = self._attempt(list(by_path), lambda: self._by_paths(by_path, numbers))
            errors |= dict.fromkeys(by_path, found) if found else {}
        planned = []
        for chosen, selector in others:
            started = time.monotonic()
            try:
                planned.append((chosen, select_entities(self.facts, selector)))
            except (PySparkException, Py4JJavaError) as error:
                errors[chosen] = _message(error)
                self._seconds[chosen] = time.monotonic() - started
        for start in range(0, len(planned), SELECTORS_A_JOB):
            some = planned[start : start + SELECTORS_A_JOB]
            if self._attempt([c for c, _ in some], lambda: self._by_frames(some, numbers)):  # noqa: B023
                for one in some:
                    found = self._attempt([one[0]], lambda: self._by_frames([one], numbers))  # noqa: B023
                    errors |= {one[0]: found} if found else {}
        self.failed |= {d.name: errors[key(d)] for d in dashboards if key(d) in errors}
        return [d for d in dashboards if d.name not in self.failed]

    def _attempt(self, chosen: list, rows_of) -> str | None:
        """Append some selections; why it failed, if it did."""
        started = time.monotonic()
        try:
            rows_of().write.mode("append").parquet(self._folder)
            return None
        except (PySparkException, Py4JJavaError) as error:
            return _message(error)
        finally:
            took = time.monotonic() - started
            self._seconds |= {c: self._seconds.get(c, 0.0) + took for c in chosen}

    def _by_frames(self, some: list[tuple], numbers: dict) -> DataFrame:
        parts = [rows.select(F.lit(numbers[c]).alias("selection"), "entity_id") for c, rows in some]
        bag = reduce(DataFrame.union, parts)
        return bag.groupBy("selection", "entity_id").agg(F.count(F.lit(1)).alias("times"))

    def _by_paths(self, by_path: dict, numbers: dict) -> DataFrame:
        ends: dict = {}
        wanted = []
        for chosen, conditions in by_path.items():
            for i, condition in enumerate(conditions):
                ends.setdefault(condition.path, []).append(condition.end)
                wanted.append((numbers[chosen], i, len(conditions), condition.path, condition.end))
        places = _numbered(ends)
        found = [
            paths.entities_to_ends(self.facts, path, some).withColumn("path", F.lit(places[path]))
            for path, some in ends.items()
        ]
        rows = [(n, i, count, places[path], end) for n, i, count, path, end in wanted]
        schema = "selection int, condition int, conditions int, path int, end string"
        asked = self._table(rows, schema).withColumnRenamed("end", "to")
        found = reduce(DataFrame.unionByName, found).withColumnRenamed("path", "of")
        met = asked.join(found, (F.col("path") == F.col("of")) & F.col("to").eqNullSafe(F.col("end")))
        # The ways through all conditions; there are as many rows as conditions.
        product = F.aggregate(F.collect_list("times"), F.lit(1).cast("long"), lambda a, b: a * b)
        both = met.groupBy("selection", "conditions", "entity_id").agg(
            F.count(F.lit(1)).alias("n"), product.alias("times")
        )
        return both.filter("n = conditions").select("selection", "entity_id", "times")

    def _runnable(self, dashboards: list[Dashboard]) -> list[Dashboard]:
        """Write the edges that dashboards bring along; those whose edges fail are left out."""
        self._given = shared_folder(self.spark)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._given)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(place)
        self._table([], _GIVEN).write.parquet(self._given)
        self._grouping_of: dict[str, str] = {}
        self._given_kind: dict[str, str | None] = {}
        done: dict[int, str | None] = {}
        for d in dashboards:
            by = d.group_by
            if by.edges is None:
                self._grouping_of[d.name] = _SITE if by.kind == "site" else "/".join(by.path)
                continue
            name = f"given {id(by.edges)}"
            self._grouping_of[d.name] = name
            if id(by.edges) not in done:
                done[id(by.edges)] = self._write_edges(name, by)
            if done[id(by.edges)]:
                self.failed[d.name] = done[id(by.edges)]
        return [d for d in dashboards if d.name not in self.failed]

    def _write_edges(self, name: str, by) -> str | None:
        try:
            dated = frame_kind(by.edges) == "year"
            group = F.col("group")
            year = F.year(group) if dated else group.try_cast("bigint")
            rows = by.edges.select(
                F.lit(name).alias("grouping"),
                "entity_id",
                group.cast("string").alias("value"),
                year.cast("long").alias("time_year"),
            )
            rows.distinct().write.mode("append").parquet(self._given)
            self._given_kind[name] = "year" if dated else "item"
        except (UnsupportedGroupingError, PySparkException, Py4JJavaError) as error:
            return _message(error)
        return None

    # Settings

    def _settle(self) -> None:
        """The settings of all dashboards as tables."""
        sites = any(d.group_by.kind == "site" and d.groups for d in self.dashboards)
        projects = self.facts.project_table() if sites else None
        checks = _numbered(
            c.check for d in self.dashboards for c in d.columns if isinstance(c, Referenced)
        )
        columns = _numbered(c for d in self.dashboards for c in d.columns)
        boards, listed, named, routes = [], [], [], {}
        for d in self.dashboards:
            by, link = d.group_by, d.link if d.group_by.kind != "site" else None
            grouping = self._grouping_of[d.name]
            kind = by.kind or self._given_kind.get(grouping)
            if by.edges is None and by.kind != "site":
                routes[grouping] = by.path
            higher = "/".join(d.higher) if d.higher else None
            if d.higher:
                routes[higher] = d.higher
            if link and link.by == "property":
                routes[link.arg] = (link.arg,)
            # Named groups are read by the kind, which may be open: both readings are given.
            kinds = [kind] if kind else ["item", "year"]
            for each in kinds:
                named += [(d.name, each, g) for g in explicit_groups(d.groups, each, projects)]
            boards.append(
                (
                    d.name,
                    self._place_of(d.name),
                    grouping,
                    kind,
                    d.threshold,
                    d.cell_threshold,
                    d.limit,
                    d.row_no_group,
                    d.row_totals,
                    higher,
                    link.template if link else None,
                    link.placeholder if link else None,
                    link.by if link else None,
                    link.arg if link else None,
                    d.link_mode,
                )
            )
            listed += [(d.name, i, c.key, columns[c]) for i, c in enumerate(d.columns)]
        self.boards = self._table(
            boards,
            "dashboard string, selection int, grouping string, kind string, threshold long, "
            "cell_threshold long, most long, row_no_group boolean, row_totals boolean, "
            "higher string, template string, placeholder string, link_by string, "
            "link_arg string, link_mode string",
        )
        self.columns = self._table(
            listed, "dashboard string, position int, column_key string, column_id int"
        )
        self.named = self._table(named, "dashboard string, kind string, group string")
        self.steps = Steps(self.spark, routes)
        self._defined = list(columns)
        self.definitions = self._table(
            [self._definition(c, i, checks) for c, i in columns.items()],
            "column_id int, kind string, property string, wanted string, qualifier string, "
            "check_id int, tied boolean, detail string, extra string",
        )
        self._checks = checks
        # Snaks that checks ask for have places, and a check the numbers of its places' bits.
        places = _numbered(part for check in checks for part in check.parts)
        self.parts = self._table(
            [(place, prop, value) for (prop, value), place in places.items()],
            "place int, asked string, wanted string",
        )
        masks = range(_words(len(places)))
        self.checks = self._table(
            [
                (
                    i,
                    check.mode,
                    *[
                        sum(1 << places[part] % _WORD for part in set(check.parts) if places[part] // _WORD == m)
                        for m in masks
                    ],
                )
                for check, i in checks.items()
            ],
            "check_id int, mode string, " + ", ".join(f"mask{m} long" for m in masks),
        )
        self._part_count = len(places)

    @staticmethod
    def _definition(column, number: int, checks: dict) -> tuple:
        prop = getattr(column, "property", None)
        tied = follows_group(column)
        value = None if tied else getattr(column, "value", None)
        qualifier = getattr(column, "qualifier", None)
        check = checks[column.check] if isinstance(column, Referenced) else None
        kinds = {Property: "property", Qualifier: "qualifier", Referenced: "referenced"}
        kind = kinds.get(type(column), "text" if isinstance(column, Text) else "site")
        detail = column.kind if isinstance(column, Text) else None
        extra = column.lang if isinstance(column, Text) else None
        extra = column.url if isinstance(column, SiteLink) else extra
        return (number, kind, prop, value, qualifier, check, tied, detail, extra)

    # Selected entities and their groups

    def selected(self) -> DataFrame:
        """(dashboard, entity_id, times)."""
        rows = self.spark.read.schema(_SELECTED).parquet(self._folder)
        mine = self.boards.select("dashboard", "selection")
        return rows.join(mine, "selection").select("dashboard", "entity_id", "times")

    def _entities(self) -> DataFrame:
        rows = self.spark.read.schema(_SELECTED).parquet(self._folder)
        return rows.select("entity_id").distinct()

    def near(self) -> Facts:
        """The facts of the selected entities; of claims, the properties that dashboards name.

        These claims feed paths and columns, and are cut down and written once.
        """
        ids = self._keep("entities", self._entities)
        asked = {c.property for c in self._defined if isinstance(c, Property | Qualifier | Referenced)}
        asked |= set(self.steps.properties(0))
        claims = self.facts.claims.filter(F.col("property").isin(*sorted(asked)))
        claims = claims.join(ids, "entity_id", "left_semi").drop("time_value")
        return replace(among(self.facts, ids), claims=self._keep("claims", lambda: claims))

    def edges(self) -> DataFrame:
        """(dashboard, entity_id, value, time_year, value_type) of the selected entities."""
        return self._keep("edges", self._edges)

    def _edges(self) -> DataFrame:
        near = self.near()
        rows = self.selected().join(self.boards.select("dashboard", "grouping"), "dashboard")
        rows = rows.select("dashboard", "entity_id", "grouping")
        starts = rows.select(F.col("grouping").alias("path"), "entity_id").distinct()
        found = followed(self.facts, starts, self.steps, near)
        none = F.lit(None)
        claimed = found.select(
            F.col("path").alias("grouping"),
            "entity_id",
            "value",
            "time_year",
            F.when(F.col("snak_type") == "value", F.col("value_type")).alias("value_type"),
        )
        sites = near.sitelinks.select(
            F.lit(_SITE).alias("grouping"),
            "entity_id",
            F.col("project_url").alias("value"),
            none.cast("long").alias("time_year"),
            none.cast("string").alias("value_type"),
        )
        given = self.spark.read.schema(_GIVEN).parquet(self._given)
        given = given.withColumn("value_type", none.cast("string"))
        every = reduce(DataFrame.unionByName, [claimed, sites, given]).distinct()
        return rows.join(every, ["grouping", "entity_id"]).drop("grouping")

    def kinds(self) -> DataFrame:
        """(dashboard, kind): how each groups, from the values its own entities have.

        A property with values of several types goes by the first of their names. The kind
        is null where values cannot be grouped, or where there are none.
        """
        types = self.edges().groupBy("dashboard").agg(F.min("value_type").alias("value_type"))
        kind = F.lit(None).cast("string")
        for value_type, name in _KIND_OF_TYPE.items():
            kind = F.when(F.col("value_type") == value_type, name).otherwise(kind)
        met = self.boards.select("dashboard", F.col("kind").alias("told")).join(
            types, "dashboard", "left"
        )
        return met.select("dashboard", F.coalesce("told", kind).alias("kind"), "value_type")

    def pairs(self) -> DataFrame:
        """Distinct (dashboard, entity_id, group, kind); the group of an unknown year is null."""
        return self._keep("pairs", self._pairs)

    def _pairs(self) -> DataFrame:
        kinds = self.kinds().filter("kind is not null").select("dashboard", "kind")
        # A row for each dashboard, whatever its estimate: the edges are never the side sent around.
        rows = self.edges().join(F.broadcast(kinds), "dashboard")
        year = F.col("time_year").cast("string")
        group = F.when(F.col("kind") == "year", year).otherwise(F.col("value"))
        return rows.select("dashboard", "entity_id", group.alias("group"), "kind").distinct()

    # Presence, one row for each column an entity has

    def _statements(self, near: Facts) -> DataFrame:
        """(entity_id, value, snak_type, column_id, tied, bad) of matching statements.

        Which qualifiers a statement has and which checks it passes are bits of a few
        numbers, written before they meet the claims; so claims are sorted by statement
        once, and become a row for each column after that.
        """
        of = [c for c in self._defined if isinstance(c, Qualifier | Referenced)]
        claims = near.claims.filter(F.col("property").isin(*sorted({c.property for c in of})))
        claims = claims.select("entity_id", "property", "statement_id", "snak_type", "value")
        wanted = _numbered(sorted({c.qualifier for c in of if c.qualifier}))
        places = self._table(list(wanted.items()), "qualifier string, place int")
        found = self.facts.qualifiers.filter(F.col("property").isin(*wanted) & has_value())
        found = found.select("statement_id", F.col("property").alias("qualifier")).join(places, "qualifier")
        found = written(_bits(found, "_has", len(wanted)))
        judged = claims.filter(F.col("property").isin(*sorted({c.property for c in of if isinstance(c, Referenced)})))
        passed = self._passed(judged.select("statement_id").distinct())
        passed = written(_bits(passed.withColumnRenamed("check_id", "place"), "_passed", len(self._checks)))
        met = claims.join(found, "statement_id", "left").join(passed, "statement_id", "left")
        defs = self.definitions.filter(F.col("kind").isin("qualifier", "referenced"))
        rows = met.join(F.broadcast(defs.join(places, "qualifier", "left")), "property")
        asked = F.col("tied") | F.col("wanted").isNotNull()
        free = (F.col("kind") == "referenced") & ~asked
        fits = F.col("wanted").isNull() | (F.col("wanted") == F.col("value"))
        has = F.col("qualifier").isNull() | _bit("_has", F.col("place"), len(wanted))
        rows = rows.filter((free | has_value()) & F.coalesce(fits, F.lit(False)) & has)
        bad = F.col("check_id").isNotNull() & ~_bit("_passed", F.col("check_id"), len(self._checks))
        return rows.select("entity_id", "value", "snak_type", "column_id", "tied", bad.alias("bad"))

    def _passed(self, statements: DataFrame) -> DataFrame:
        """(statement_id, check_id) where a single node passes the check."""
        nodes = written(self.facts.reference_nodes.join(statements, "statement_id", "left_semi"))
        wanted = {p for c in self._checks for p, _ in c.parts} | set(POOR_REFERENCE_PROPERTIES)
        snaks = self.facts.reference_snaks.filter(F.col("property").isin(*sorted(wanted)))
        snaks = snaks.join(nodes.select("reference_id"), "reference_id", "left_semi")
        fits = (F.col("property") == F.col("asked")) & (F.col("wanted").isNull() | (F.col("wanted") == F.col("value")))
        met = snaks.join(F.broadcast(self.parts), fits, "left")
        poor = F.max(F.col("property").isin(*POOR_REFERENCE_PROPERTIES)).alias("poor")
        # A row for each node, which no check looks at again; nodes of a popular one are many.
        shown = written(_bits(met, "_shown", self._part_count, "reference_id", poor))
        rows = nodes.join(shown, "reference_id", "left").crossJoin(F.broadcast(self.checks))
        some, every = F.lit(False), F.lit(True)
        for i in range(_words(self._part_count)):
            bits = F.coalesce(F.col(f"_shown{i}"), F.lit(0).cast("long")).bitwiseAND(F.col(f"mask{i}"))
            some, every = some | (bits != 0), every & (bits == F.col(f"mask{i}"))
        passes = (
            F.when(F.col("mode") == "any", True)
            .when(F.col("mode") == "good", ~F.coalesce("poor", F.lit(False)))
            .when(F.col("mode") == "any_of", some)
            .otherwise(every)
        )
        return rows.filter(passes).select("statement_id", "check_id")

    def presence(self) -> DataFrame:
        """Distinct (entity_id, column_id, group): ``group`` where the column follows it, else null."""
        return self._keep("presence", self._presence)

    def _presence(self) -> DataFrame:
        near, defs = self.near(), self.definitions
        none = F.lit(None).cast("string").alias("group")
        no = F.lit(False).alias("bad")
        props = sorted({c.property for c in self._defined if isinstance(c, Property)})
        claims = near.claims.filter(F.col("property").isin(*props)).select("entity_id", "property")
        direct = claims.join(defs.filter("kind = 'property'"), "property")
        terms = near.terms.select("entity_id", F.col("kind").alias("detail"), F.col("lang").alias("extra"))
        texts = terms.join(defs.filter("kind = 'text'"), ["detail", "extra"])
        links = near.sitelinks.select("entity_id", F.col("project_url").alias("extra"))
        links = links.join(defs.filter("kind = 'site'"), "extra")
        plain = [rows.select("entity_id", "column_id", none, no) for rows in (direct, texts, links)]
        rows = self._statements(near).filter(~F.col("tied") | has_value())
        group = F.when(F.col("tied"), F.col("value")).alias("group")
        # Sorting statements and counting entities are stages of their own.
        rows = written(rows.select("entity_id", "column_id", group, "bad"))
        every = reduce(DataFrame.union, [*plain, rows]).groupBy("entity_id", "column_id", "group")
        return every.agg(F.max("bad").alias("bad")).filter("not bad").drop("bad")

    # Counts

    def counted(self) -> DataFrame:
        """(dashboard, group, kind, count) of every raw group."""
        return self._keep("counted", self._counted)

    def _wanted_pairs(self) -> DataFrame:
        """The pairs of the groups that a dashboard names, or of all where it names none."""
        named = self.named.join(self.kinds().select("dashboard", "kind"), ["dashboard", "kind"], "left_semi")
        few = named.select("dashboard").distinct()
        pairs = self.pairs()
        all_of = pairs.join(few, "dashboard", "left_anti")
        some_of = pairs.join(named.select("dashboard", "group"), ["dashboard", "group"], "left_semi")
        return all_of.unionByName(some_of)

    def _counted(self) -> DataFrame:
        return self._wanted_pairs().groupBy("dashboard", "group", "kind").agg(F.count(F.lit(1)).alias("count"))

    def cells(self) -> DataFrame:
        """(dashboard, group, column_id, cell) of every raw group with any entity that has it."""
        return self._keep("cells", self._cells)

    def _cells(self) -> DataFrame:
        pairs, has = self._wanted_pairs(), self.presence()
        tied = self.definitions.filter("tied").select("column_id")
        free = pairs.join(has.join(tied, "column_id", "left_anti").drop("group"), "entity_id")
        # No value equals a year.
        own = has.join(tied, "column_id", "left_semi")
        own = pairs.filter("kind <> 'year'").join(own, ["entity_id", "group"])
        rows = [r.select("dashboard", "group", "column_id") for r in (free, own)]
        rows = reduce(DataFrame.union, rows).join(
            self.columns.select("dashboard", "column_id"), ["dashboard", "column_id"], "left_semi"
        )
        summed = rows.groupBy("dashboard", "group", "column_id").agg(F.count(F.lit(1)).alias("cell"))
        floor = self.boards.select("dashboard", "cell_threshold")
        return summed.join(floor, "dashboard").filter("cell >= cell_threshold").drop("cell_threshold")

    def _kept_groups(self) -> DataFrame:
        """Raw groups as reported: those over the threshold, and the largest where there is a limit."""
        limits = self.boards.select("dashboard", "threshold", "most")
        rows = self.counted().join(limits, "dashboard").filter("count >= threshold")
        unknown = is_unknown(F.col("group"), self.facts.unknown_prefix)
        rows = rows.withColumn("unknown", unknown)
        free = rows.filter("most is null or unknown")
        order = Window.partitionBy("dashboard").orderBy(F.col("count").desc(), "group")
        # The place is compared with the limit at once, so a task keeps the largest only.
        few = rows.filter("most is not null and not unknown")
        few = few.withColumn("_place", F.row_number().over(order)).filter("_place <= most").drop("_place")
        return free.unionByName(few).drop("threshold", "most")

    def reported(self) -> DataFrame:
        """Names of the dashboards that have any group to report."""
        floor = self.boards.select("dashboard", "threshold")
        rows = self.counted().join(floor, "dashboard").filter("count >= threshold")
        return rows.select("dashboard").distinct()

    # Report rows

    def groups(self) -> DataFrame:
        """(dashboard, kind, title, span, higher_group, group_link, count) of the group rows."""
        return self._keep("groups", self._groups)

    def _groups(self) -> DataFrame:
        kept = self._kept_groups()
        title = F.when(~F.col("unknown"), F.col("group"))
        kind = F.when(F.col("unknown"), "unknown").otherwise(F.col("kind"))
        rows = kept.groupBy("dashboard", kind.alias("kind"), title.alias("title"))
        rows = rows.agg(F.sum("count").alias("count"), F.max("kind").alias("grouped_by"))
        return rebin_years(self._decorated(rows), [])

    def _decorated(self, rows: DataFrame) -> DataFrame:
        settings = self.boards.select(
            "dashboard", "higher", "template", "placeholder", "link_by", "link_arg"
        )
        rows = written(rows.join(settings, "dashboard"))
        items = rows.filter("kind = 'item'")
        by_property = items.filter("link_by = 'property'")
        starts = items.filter("higher is not null").select(F.col("higher").alias("path"), F.col("title").alias("entity_id"))
        starts = starts.union(by_property.select("link_arg", "title")).distinct()
        near = among(self.facts, starts.select("entity_id").distinct())
        ends = written(followed(self.facts, starts, self.steps, near).groupBy("path", "entity_id").agg(
            F.min("value").alias("value"),
            F.min(strip_prefix(F.col("value"), self.facts.entity_prefix)).alias("stripped"),
        ))
        highers = ends.select(F.col("path").alias("higher"), F.col("entity_id").alias("title"), F.col("stripped").alias("found"))
        wanted = items.filter("link_by = 'label'").select("link_arg", "title").distinct()
        terms = self.facts.terms.filter("kind = 'label'").select(
            F.col("entity_id").alias("title"), "lang", "text"
        )
        told = wanted.join(terms, "title").filter("lang = link_arg or lang = 'mul'")
        own = F.min(F.when(F.col("lang") == F.col("link_arg"), F.col("text")))
        told = told.groupBy("link_arg", "title").agg(F.coalesce(own, F.min("text")).alias("fill"))
        told = told.withColumn("link_by", F.lit("label"))
        reached = ends.select(
            F.col("path").alias("link_arg"),
            F.col("entity_id").alias("title"),
            F.col("value").alias("fill"),
            F.lit("property").alias("link_by"),
        )
        fills = told.unionByName(reached)
        rows = rows.join(highers, ["higher", "title"], "left")
        rows = rows.join(fills, ["link_by", "link_arg", "title"], "left")
        is_item = F.col("kind") == "item"
        has_higher = F.col("higher").isNotNull() & (F.col("kind") != "unknown")
        higher = F.when(has_higher, F.coalesce(F.when(is_item, F.col("found")), F.lit("")))
        key = F.coalesce("title", F.lit(UNKNOWN_KEY))
        fill = F.coalesce(F.nullif(F.when(is_item, F.col("fill")), F.lit("")), key)
        link = F.replace(F.col("template"), F.col("placeholder"), fill)
        return rows.select(
            "dashboard", "kind", "title", higher.alias("higher_group"), link.alias("group_link"), "count"
        )

    def _key(self, span: Expr) -> Expr:
        whole = F.when(span > 1, F.concat_ws("/", "title", span)).otherwise(F.col("title"))
        return F.when(F.col("kind") == "unknown", UNKNOWN_KEY).otherwise(whole)

    def _group_cells(self) -> DataFrame:
        """(dashboard, section, group_key, column_id, cell) of the group rows."""
        rows = self.groups()
        unknown = is_unknown(F.col("group"), self.facts.unknown_prefix)
        spans = rows.filter("kind = 'year'").groupBy("dashboard").agg(F.max("span").alias("_span"))
        kept = self._kept_groups().filter("not unknown").join(spans, "dashboard", "left")
        start = F.floor(F.col("group").try_cast("bigint") / F.col("_span")) * F.col("_span")
        binned = F.concat_ws("/", start.cast("bigint").cast("string"), F.col("_span"))
        key = F.when((F.col("kind") == "year") & (F.col("_span") > 1), binned).otherwise(F.col("group"))
        known = kept.select("dashboard", "group", key.alias("group_key"))
        mine = self.cells().join(known, ["dashboard", "group"])
        # The cells of the unknown row are those of all unknown groups.
        folded = rows.filter("kind = 'unknown'").select("dashboard").distinct()
        others = self.cells().filter(unknown).join(folded, "dashboard", "left_semi")
        others = others.withColumn("group_key", F.lit(UNKNOWN_KEY))
        names = ["dashboard", "group_key", "column_id", "cell"]
        every = mine.select(*names).union(others.select(*names))
        summed = every.groupBy("dashboard", "group_key", "column_id").agg(F.sum("cell").alias("cell"))
        return summed.withColumn("section", F.lit(SECTION_GROUPS))

    def _bag_rows(self) -> DataFrame:
        """(dashboard, section, entity_id, times): the entities of the totals and of "no grouping"."""
        return self._keep("bag", self._bag)

    def _bag(self) -> DataFrame:
        asked = self.boards.select("dashboard", "row_no_group", "row_totals")
        rows = self.selected().join(asked, "dashboard")
        wanted = asked.filter("row_no_group").select("dashboard")
        grouped = self.edges().select("dashboard", "entity_id").join(F.broadcast(wanted), "dashboard", "left_semi")
        outside = rows.filter("row_no_group").join(grouped, ["dashboard", "entity_id"], "left_anti")
        parts = ((SECTION_NO_GROUP, outside), (SECTION_TOTALS, rows.filter("row_totals")))
        parts = [
            part.select("dashboard", F.lit(section).alias("section"), "entity_id", "times")
            for section, part in parts
        ]
        return reduce(DataFrame.union, parts)

    def _bag_lines(self) -> DataFrame:
        sections = F.array(
            F.when(F.col("row_no_group"), SECTION_NO_GROUP), F.when(F.col("row_totals"), SECTION_TOTALS)
        )
        asked = self.boards.select("dashboard", F.explode(F.array_compact(sections)).alias("section"))
        summed = self._bag_rows().groupBy("dashboard", "section").agg(F.sum("times").alias("count"))
        # An empty selection still has its rows, with zeros.
        return asked.join(summed, ["dashboard", "section"], "left").fillna(0, ["count"])

    def _bag_cells(self) -> DataFrame:
        tied = self.definitions.filter("tied").select("column_id")
        free = self.presence().join(tied, "column_id", "left_anti").select("entity_id", "column_id")
        own = self.presence().join(tied, "column_id", "left_semi").select("entity_id", "column_id")
        has = free.union(own.distinct())
        rows = self._bag_rows().join(has, "entity_id")
        rows = rows.join(self.columns.select("dashboard", "column_id"), ["dashboard", "column_id"], "left_semi")
        return rows.groupBy("dashboard", "section", "column_id").agg(F.sum("times").alias("cell"))

    def lines(self) -> DataFrame:
        """Every report row of the dashboards that have any group, without cells."""
        rows = self.groups()
        span = F.when(F.col("kind") == "year", F.col("span"))
        head = ["dashboard", "section", "kind", "group_key", "title", "span", "higher_group", "group_link"]
        rows = rows.select(
            "dashboard",
            F.lit(SECTION_GROUPS).alias("section"),
            "kind",
            self._key(span).alias("group_key"),
            "title",
            span.alias("span"),
            "higher_group",
            "group_link",
            "count",
        )
        totals = F.col("section") == SECTION_TOTALS
        none = F.lit(None).cast("string")
        special = self._bag_lines().select(
            "dashboard",
            "section",
            F.when(totals, "totals").otherwise("none").alias("kind"),
            F.when(totals, TOTALS_KEY).otherwise(NO_GROUP_KEY).alias("group_key"),
            none.alias("title"),
            F.lit(None).cast("bigint").alias("span"),
            none.alias("higher_group"),
            none.alias("group_link"),
            "count",
        )
        special = special.join(self.reported(), "dashboard", "left_semi")
        return rows.select(*head, "count").unionByName(special)

    def long_report(self) -> DataFrame:
        """(dashboard, section, kind, group_key, count, position, column_key, column_count, percent)."""
        return self._with_cells(self.lines()).drop("column_id", "title", "span", "higher_group", "group_link")

    def _with_cells(self, lines: DataFrame) -> DataFrame:
        key = F.when(F.col("section") == SECTION_TOTALS, TOTALS_KEY).otherwise(NO_GROUP_KEY)
        bag = self._bag_cells().withColumn("group_key", key)
        cells = self._group_cells().unionByName(bag)
        rows = lines.join(self.columns, "dashboard")
        met = rows.join(cells, ["dashboard", "section", "group_key", "column_id"], "left")
        value = F.coalesce("cell", F.lit(0)).cast("long")
        met = met.withColumn("column_count", value).drop("cell")
        return met.withColumn("percent", percent(F.col("column_count"), F.col("count")))

    # Texts

    def texts(self, template: str = CELL_TEMPLATE) -> DataFrame:
        """(dashboard, place, line): reports as lines of markup, of any length, in order.

        The head has place 0 and the end the last one. A line holds one report row with
        all its cells, so it is as long as the dashboard is wide.
        """
        lines = self._keep("lines", self.lines)
        cells = self._with_cells(lines.select("dashboard", "section", "group_key", "count"))
        shown = text(
            F.lit("| {{"),
            F.concat_ws(
                "|",
                F.lit(template),
                percent_text(F.col("percent")),
                F.col("column_count").cast("string"),
                F.concat(F.lit("column="), "column_key"),
                F.concat(F.lit("grouping="), "group_key"),
            ),
            F.lit("}}\n"),
        )
        cells = cells.select("dashboard", "section", "group_key", "position", shown.alias("shown"))
        in_order = F.array_sort(F.collect_list(F.struct("position", "shown")))
        row_cells = cells.groupBy("dashboard", "section", "group_key").agg(
            F.array_join(F.transform(in_order, lambda cell: cell["shown"]), "").alias("cells")
        )
        order = ["section", F.col("count").desc(), "group_key"]
        rows = with_places(lines, "dashboard", order)
        rows = rows.join(row_cells, ["dashboard", "section", "group_key"], "left")
        rows = rows.join(self.boards.select("dashboard", "higher"), "dashboard")
        kind, count = F.col("kind"), F.col("count")
        opener = F.when(kind == "totals", '|- class="sortbottom"\n').otherwise("|-\n")
        higher = F.when(F.col("higher").isNotNull(), higher_group_cell(kind, F.col("higher_group")))
        line = F.concat(
            opener,
            F.coalesce(higher, F.lit("")),
            F.lit("| "),
            row_heading(kind, F.col("title"), F.col("span")),
            F.lit("\n"),
            count_cell(kind, F.col("group_link"), count),
            F.coalesce("cells", F.lit("")),
        )
        rows = rows.select("dashboard", F.col("place").cast("long"), line.alias("line"))
        shown = [(d.name, report_head(d)) for d in self.dashboards]
        heads = self._table(shown, "dashboard string, line string")
        heads = heads.join(self.reported(), "dashboard", "left_semi")
        counted = lines.groupBy("dashboard").agg((F.count(F.lit(1)) + 1).alias("place"))
        ends = counted.select("dashboard", "place", F.lit("|}\n").alias("line"))
        heads = heads.select("dashboard", F.lit(0).cast("long").alias("place"), "line")
        return heads.union(rows).union(ends)

    # Outcomes

    def outcomes(self) -> DataFrame:
        """(dashboard, outcome, error, groups, select_seconds) of every dashboard that was asked for.

        ``outcome`` is ``reported``, ``empty`` or ``failed``. ``select_seconds`` is how long
        the job that ran its selector took, which others may share; the rest is one plan
        for all.
        """
        failed = sorted(self.failed.items())
        seconds = [(d.name, self._seconds.get(self._selection_of[d.name])) for d in self.asked]
        timed = self._table(seconds, "dashboard string, select_seconds double")
        broken = self._table(failed, "dashboard string, failure string")
        rows = self.groups().groupBy("dashboard").agg(F.count(F.lit(1)).alias("groups"))
        kinds = self.kinds().join(self.boards.select("dashboard", "grouping"), "dashboard")
        last = F.element_at(F.split("grouping", "/"), -1)
        known = self.facts.claims.filter(F.col("snak_type") == "value")
        props = sorted({path[-1] for path in self.steps.paths.values()})
        known = known.filter(F.col("property").isin(*props)).select("property").distinct()
        kinds = kinds.join(known, F.col("property") == last, "left")
        by_claims = F.col("grouping").isin(*self.steps.paths) if self.steps.paths else F.lit(False)
        reason = (
            F.when(F.col("kind").isNull() & F.col("value_type").isNotNull(), F.concat(F.lit("cannot group by the values of "), last))
            .when(by_claims & F.col("property").isNull() & F.col("kind").isNull(), F.concat(F.lit("no values for "), last))
            .otherwise("no groups found")
        )
        reasons = kinds.select("dashboard", reason.alias("reason"))
        met = timed.join(broken, "dashboard", "left").join(reasons, "dashboard", "left")
        met = met.join(rows, "dashboard", "left")
        outcome = (
            F.when(F.col("failure").isNotNull(), "failed")
            .when(F.col("groups").isNull(), "empty")
            .otherwise("reported")
        )
        error = F.coalesce("failure", F.when(F.col("groups").isNull(), F.col("reason")))
        groups = F.coalesce("groups", F.lit(0)).cast("long").alias("groups")
        return met.select("dashboard", outcome.alias("outcome"), error.alias("error"), groups, "select_seconds")
