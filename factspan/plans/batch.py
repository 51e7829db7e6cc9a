"""All dashboards in one plan; bad ones become error rows and the others go on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from factspan.facts import Facts
from factspan.operators.grouping import frame_kind, group_kinds
from factspan.operators.selection import select_entities
from factspan.operators.tables import written
from factspan.plans.coverage import Coverage
from factspan.plans.fleet import Fleet
from factspan.plans.lists import groups_to_list, listed, members_of
from factspan.sources.sinks import write_lists
from factspan.spec import Dashboard, SpecError, UnsupportedGroupingError


@dataclass(frozen=True)
class Batch:
    """The shared plan (None if no dashboard is valid) and (dashboard, error) rows."""

    coverage: Coverage | None
    errors: DataFrame

    def lines(self) -> DataFrame:
        """Report rows of the dashboards that have at least one group."""
        if self.coverage is None:
            raise SpecError("no dashboard can be run")
        lines = self.coverage.lines()
        return lines.join(self.coverage.reported(), "dashboard", "left_semi")

    def lists(
        self, existing: DataFrame, foreign_prefixes: Sequence[str] = (), lang: str = "en"
    ) -> DataFrame:
        """Member lists, with ``dashboard``, of the dashboards whose link mode is ``create``.

        ``existing`` and ``foreign_prefixes`` are those of :func:`groups_to_list`.
        """
        boards = self.coverage.dashboards if self.coverage is not None else []
        asked = [d for d in boards if d.link_mode == "create"]
        if not asked:
            spark = self.errors.sparkSession
            schema = "dashboard string, group_key string, entity_id string, position int"
            return spark.createDataFrame([], f"{schema}, field string, value string")
        lines = self.lines().filter(F.col("dashboard").isin(*[d.name for d in asked]))
        groups = written(groups_to_list(lines, existing, foreign_prefixes))
        facts = self.coverage.facts
        members = members_of(Fleet(facts, asked).pairs(), groups, facts.unknown_prefix)
        return listed(facts, asked, members, lang)

    def create_lists(
        self,
        existing: DataFrame,
        path: str,
        foreign_prefixes: Sequence[str] = (),
        lang: str = "en",
    ) -> None:
        """Write the lists of :meth:`lists`, one folder per dashboard and group."""
        write_lists(self.lists(existing, foreign_prefixes, lang), path)


def _with_kinds(
    facts: Facts, dashboards: Sequence[Dashboard]
) -> tuple[list[Dashboard | str], Fleet | None]:
    """Each dashboard with its kind of grouping, or why it has none; few jobs for all.

    The values of a dashboard's own entities tell, as in a plan of one dashboard; if there
    are none, all values of the property do. The fleet that told has their selections and edges.
    """
    undeclared = [d for d in dashboards if d.group_by.kind is None and d.group_by.edges is None]
    own: dict[str, Row] = {}
    kinds: dict[str, str | None] = {}
    failed: dict[str, str] = {}
    fleet = None
    if undeclared:
        fleet = Fleet(facts, undeclared)
        failed = fleet.failed
        own = {row.dashboard: row for row in fleet.kinds().collect()}
        # One row per property that some dashboard without values of its own names.
        without = [d for d in undeclared if d.name in own and not own[d.name].value_type]
        ends = {d.group_by.path[-1] for d in without}
        if ends:
            wanted = group_kinds(facts).filter(F.col("property").isin(*sorted(ends)))
            kinds = {row.property: row.group_kind for row in wanted.collect()}
    resolved: list[Dashboard | str] = []
    for d in dashboards:
        if d.group_by.kind:
            resolved.append(d)
            continue
        if d.group_by.edges is not None:
            try:
                resolved.append(d.with_kind(frame_kind(d.group_by.edges)))
            except UnsupportedGroupingError as error:
                resolved.append(str(error))
            continue
        prop = d.group_by.path[-1]
        if d.name in failed:
            resolved.append(failed[d.name])
            continue
        told = own[d.name]
        kind = told.kind if told.value_type else kinds.get(prop)
        if not told.value_type and prop not in kinds:
            resolved.append(f"no values for {prop}")
        elif kind is None:
            resolved.append(f"cannot group by the values of {prop}")
        else:
            resolved.append(d.with_kind(kind))
    return resolved, fleet


def _that_run(
    facts: Facts, dashboards: Sequence[Dashboard]
) -> tuple[list[Dashboard], list[tuple[str, str]]]:
    """The dashboards whose selection and edges can be computed, and why others can't.

    What was computed is kept, so it isn't computed again.
    """
    good, failed = [], []
    for d in dashboards:
        try:
            found = replace(d, selector=written(select_entities(facts, d.selector)))
            if d.group_by.edges is not None:
                edges = d.group_by.edges.select("entity_id", "group")
                found = replace(found, group_by=replace(d.group_by, edges=written(edges)))
            good.append(found)
        except (PySparkException, Py4JJavaError) as error:
            lines = [x for x in str(error).splitlines() if x.strip()]
            failed.append((d.name, lines[0] if lines else type(error).__name__))
    return good, failed


def plan_all(
    facts: Facts, dashboards: Sequence[Dashboard], errors: DataFrame | None = None
) -> Batch:
    """One plan for all valid dashboards; ``errors`` are (dashboard, error) so far."""
    bad: list[tuple[str, str]] = []
    good: list[Dashboard] = []
    resolved, fleet = _with_kinds(facts, dashboards)
    for d, found in zip(dashboards, resolved, strict=True):
        if isinstance(found, str):
            bad.append((d.name, found))
            continue
        try:
            select_entities(facts, d.selector)
        except (AnalysisException, ParseException) as error:
            bad.append((d.name, str(error).splitlines()[0]))
            continue
        good.append(found)
    rows = facts.spark.createDataFrame(bad, "dashboard string, error string")
    if errors is not None:
        rows = errors.toDF("dashboard", "error").unionByName(rows)
    if not good:
        return Batch(None, rows)
    coverage = Coverage(facts, good, fleet)
    try:
        coverage.counted_groups()
    except (PySparkException, Py4JJavaError):
        good, failed = _that_run(facts, good)
        rows = rows.unionByName(
            facts.spark.createDataFrame(failed, "dashboard string, error string")
        )
        if not good:
            return Batch(None, rows)
        coverage = Coverage(facts, good)
    names = facts.spark.createDataFrame([(d.name,) for d in good], "dashboard string")
    empty = names.join(coverage.reported(), "dashboard", "left_anti")
    empty = empty.withColumn("error", F.lit("no groups found"))
    return Batch(coverage, rows.unionByName(empty))
