"""The entities behind one cell: those that have the column and those that lack it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.facts import Facts, has_value
from factspan.functions.values import is_unknown, year_bin
from factspan.operators.grouping import UNKNOWN_KEY, group_edges, resolve_kind
from factspan.operators.presence import StatementTests
from factspan.operators.references import shown_references
from factspan.operators.selection import among, follow_path, select_entities, with_labels
from factspan.operators.tables import written
from factspan.plans.coverage import NO_GROUP_KEY, TOTALS_KEY
from factspan.spec import (
    Column,
    Dashboard,
    Property,
    Qualifier,
    Referenced,
    SiteLink,
    Text,
    follows_group,
)


@dataclass(frozen=True)
class Row:
    """A report row: ``item``, ``year``, ``site``, ``unknown``, ``none`` or ``totals``."""

    kind: str
    key: str = ""
    span: int = 1


def row_from_key(dashboard: Dashboard, key: str) -> Row:
    """The row a report's group key names, such as ``Q5``, ``1950/10`` or ``None``."""
    special = {NO_GROUP_KEY: "none", TOTALS_KEY: "totals", UNKNOWN_KEY: "unknown"}
    if key in special:
        return Row(special[key])
    kind = dashboard.group_by.kind
    if kind == "year" and "/" in key:
        start, span = key.rsplit("/", 1)
        return Row("year", start, int(span))
    return Row(kind, key)


class DrillDown:
    """Lists for the cells of one dashboard."""

    def __init__(self, facts: Facts, dashboard: Dashboard):
        self.facts = facts
        self.dashboard = resolve_kind(facts, dashboard)
        self._members: dict[Row, DataFrame] = {}
        self._near: dict[Row, Facts] = {}

    def row(self, key: str | Row) -> Row:
        return key if isinstance(key, Row) else row_from_key(self.dashboard, key)

    # Members

    def _edges_of(self, row: Row) -> DataFrame:
        edges = group_edges(self.facts, self.dashboard.group_by)
        group = F.col("group")
        if row.kind == "unknown":
            return edges.filter(is_unknown(group, self.facts.unknown_prefix))
        if row.kind == "year":
            year = group.try_cast("bigint")
            return edges.filter(year_bin(year, row.span) == F.lit(int(row.key)))
        return edges.filter(group == row.key)

    def members(self, key: str | Row) -> DataFrame:
        """Distinct selected entities of a row, computed once and written."""
        row = self.row(key)
        if row not in self._members:
            self._members[row] = written(self._find_members(row))
        return self._members[row]

    def near(self, row: Row) -> Facts:
        """The facts of the row's members."""
        if row not in self._near:
            self._near[row] = among(self.facts, self.members(row))
        return self._near[row]

    def _find_members(self, row: Row) -> DataFrame:
        selected = select_entities(self.facts, self.dashboard.selector).distinct()
        if row.kind == "totals":
            return selected
        if row.kind == "none":
            grouped = group_edges(self.facts, self.dashboard.group_by).select("entity_id")
            return selected.join(grouped, "entity_id", "left_anti")
        mine = self._edges_of(row).select("entity_id")
        return selected.join(mine, "entity_id", "left_semi")

    def _scope(self, row: Row, tied: bool) -> tuple[DataFrame, list[str]]:
        """The members, and the keys a column's rows meet them on.

        Members of the unknown row come with their unknown value, which a tied
        column's value has to equal.
        """
        members = self.members(row)
        if tied and row.kind == "unknown":
            by = self.dashboard.group_by
            edges = self._edges_of(row)
            if by.kind == "year" and by.edges is None:
                # The year of an unknown date is null; its value is the unknown's own id.
                edges = follow_path(self.facts, by.path).withColumnRenamed("value", "group")
                edges = edges.filter(F.col("group").startswith(self.facts.unknown_prefix))
            return edges.join(members, "entity_id", "left_semi"), ["entity_id", "group"]
        return members, ["entity_id"]

    def _fitting(self, rows: DataFrame, row: Row, tied: bool) -> DataFrame:
        """Rows whose value (``group``) is the row's group, for tied columns.

        No value equals a year; rows without a group of their own, and site
        rows, take any value.
        """
        if tied and row.kind == "item":
            return rows.filter(F.col("group") == row.key)
        if tied and row.kind == "year":
            return rows.filter(F.lit(False))
        return rows

    def _of_members(self, rows: DataFrame, row: Row, column: Column) -> DataFrame:
        """The rows that fit; they are of members already, but for their values."""
        tied = follows_group(column)
        rows = self._fitting(rows, row, tied)
        scope, keys = self._scope(row, tied)
        if "group" in keys:
            rows = rows.join(scope, keys, "left_semi")
        return rows.drop("group")

    # Columns

    def _column(self, column: Column | str) -> Column:
        return self.dashboard.column(column) if isinstance(column, str) else column

    def positive(self, column: Column | str, key: str | Row, lang: str = "en") -> DataFrame:
        """Distinct (entity, values) of the members that have the column, with labels."""
        column, row = self._column(column), self.row(key)
        rows = self._positive_rows(column, row).distinct()
        return self._labelled(rows, lang)

    def negative(self, column: Column | str, key: str | Row, lang: str = "en") -> DataFrame:
        """Distinct members that lack the column, with labels.

        Not the complement of the positive list: each kind of column has its own
        rule, see the methods below.
        """
        column, row = self._column(column), self.row(key)
        if isinstance(column, Referenced):
            rows = self._badly_referenced(column, row)
        else:
            tied = follows_group(column)
            scope, keys = self._scope(row, tied)
            having = self._fitting(self._not_missing(column, self.near(row)), row, tied)
            rows = scope.join(having.select(*keys).distinct(), keys, "left_anti")
            rows = rows.select("entity_id")
        return self._labelled(rows.distinct(), lang)

    def _labelled(self, rows: DataFrame, lang: str) -> DataFrame:
        ids = [c for c in rows.columns if c != "snak_type"]
        return with_labels(rows, self.facts, ids, lang)

    def _positive_rows(self, column: Column, row: Row) -> DataFrame:
        facts = self.near(row)
        if isinstance(column, Property):
            claims = facts.claims.filter(F.col("property") == column.property)
            return self._of_members(claims.select("entity_id", "value").distinct(), row, column)
        if isinstance(column, Qualifier):
            rows = self._qualified(column, facts)
            rows = rows.select("entity_id", "group", "value", "snak_type").distinct()
            return self._of_members(rows, row, column)
        if isinstance(column, Referenced):
            return self._referenced(column, row)
        if isinstance(column, Text):
            terms = facts.terms.filter(_is_term(column))
            names = ["entity_id"]
            if column.kind == "description":
                names.append("value")
                terms = terms.withColumnRenamed("text", "value")
            return self._of_members(terms.select(*names).distinct(), row, column)
        links = facts.sitelinks.filter(F.col("project_url") == column.url)
        rows = links.select("entity_id", F.col("title").alias("value")).distinct()
        return self._of_members(rows, row, column)

    def _not_missing(self, column: Column, facts: Facts) -> DataFrame:
        """Entities (with ``group`` for tied columns) that the negative list leaves out."""
        if isinstance(column, Property):
            # Some best-rank statement (value or "none") exists exactly if any
            # statement is not deprecated.
            return facts.claims.filter(
                (F.col("property") == column.property) & (F.col("rank") != "deprecated")
            ).select("entity_id")
        if isinstance(column, Qualifier):
            return self._qualified(column, facts).select("entity_id", "group")
        if isinstance(column, Text):
            return facts.terms.filter(_is_term(column)).select("entity_id")
        assert isinstance(column, SiteLink)
        links = facts.sitelinks.filter(F.col("project_url") == column.url)
        return links.select("entity_id")

    def _qualified(self, column: Qualifier, facts: Facts) -> DataFrame:
        """(entity_id, group, value, snak_type): qualifiers, "no value" ones included.

        ``group`` is the statement's main value; a statement without one stays,
        unless the column asks for a value.
        """
        claims = facts.claims.filter(F.col("property") == column.property)
        if column.value:
            claims = claims.filter(has_value())
            if not follows_group(column):
                claims = claims.filter(F.col("value") == column.value)
        claims = claims.select("statement_id", "entity_id", F.col("value").alias("group"))
        found = facts.qualifiers.filter(F.col("property") == column.qualifier)
        found = found.select("statement_id", "value", "snak_type").distinct()
        return found.join(claims, ["statement_id"], "inner")

    # References

    def _statements(self, column: Referenced, row: Row) -> DataFrame:
        """Statements of the property: value, what matches and what is unsourced.

        They feed several branches and jobs, so they are judged once and written.
        """
        facts = self.near(row)
        claims = facts.claims.filter(F.col("property") == column.property)
        tests = StatementTests(replace(facts, claims=claims), [column])
        rows = tests.rows.select(
            "entity_id",
            "statement_id",
            "snak_type",
            "value",
            F.col("value").alias("group"),
            tests.matches(column).alias("matches"),
            tests.unreferenced(column).alias("bad"),
        )
        return written(self._fitting(rows, row, follows_group(column)))

    def _referenced(self, column: Referenced, row: Row) -> DataFrame:
        """Matching statements with a value, of entities with no unsourced match.

        A tied column in a row that binds no value is judged value by value.
        """
        tied = follows_group(column)
        rows = self._statements(column, row)
        by_value = tied and row.kind not in ("item", "year")
        keys = ["entity_id", "group"] if by_value else ["entity_id"]
        bad = rows.filter("bad").select(*keys).distinct()
        shown = rows.filter(F.col("matches") & has_value())
        shown = shown.select("entity_id", "value", "statement_id", "group")
        good = shown.join(bad, keys, "left_anti")
        good = written(self._of_members(good, row, column))
        shown = shown_references(self.facts, column.check, good)
        first = ["entity_id", "value"]
        rest = [c for c in shown.columns if c not in (*first, "statement_id")]
        return shown.select(*first, *rest)

    def _badly_referenced(self, column: Referenced, row: Row) -> DataFrame:
        """Members without a matching statement, or with an unsourced one.

        They come with the property's values, as far as the column speaks of them.
        """
        tied = follows_group(column)
        scope, keys = self._scope(row, tied)
        rows = self._statements(column, row)
        verdict = rows.groupBy(*keys).agg(
            F.max("matches").alias("any"), F.max("bad").alias("bad")
        )
        judged = scope.join(verdict, keys, "left")
        lacking = judged.filter(F.coalesce(~F.col("any") | F.col("bad"), F.lit(True)))
        lacking = lacking.select(*keys)
        values = rows.filter(has_value())
        if column.value and not tied:
            values = values.filter(F.col("value") == column.value)
        elif tied and row.kind in ("none", "totals", "site"):
            values = values.filter("bad")
        values = values.select(*dict.fromkeys([*keys, "value"])).distinct()
        return lacking.join(values, keys, "left").select("entity_id", "value")


def _is_term(column: Text) -> Expr:
    return (F.col("kind") == column.kind) & (F.col("lang") == column.lang)
