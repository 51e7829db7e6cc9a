"""Which columns each entity has: one pass per fact table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.facts import Facts, has_value
from factspan.operators.references import statement_checks
from factspan.operators.tables import written
from factspan.spec import (
    Column,
    Property,
    Qualifier,
    Referenced,
    SiteLink,
    Text,
    follows_group,
)


def flag_name(index: int) -> str:
    """Internal name of the flag of the column at ``index``."""
    return f"c{index}"


def _lacking(name: str) -> str:
    return f"{name}_bad"


def _entity_rows(table: DataFrame, tests: dict[str, Expr]) -> DataFrame:
    """Rows passing a test, as (entity_id, one flag per test)."""
    any_test = reduce(lambda a, b: a | b, tests.values())
    return table.filter(any_test).select(
        "entity_id", *[test.alias(name) for name, test in tests.items()]
    )


def _direct_tests(columns: dict[str, Column]) -> dict[str, dict[str, Expr]]:
    """Per fact table, the tests that need no join."""
    tests: dict[str, dict[str, Expr]] = {"claims": {}, "terms": {}, "sitelinks": {}}
    for name, column in columns.items():
        if isinstance(column, Property):
            tests["claims"][name] = F.col("property") == column.property
        elif isinstance(column, Text):
            tests["terms"][name] = (F.col("kind") == column.kind) & (
                F.col("lang") == column.lang
            )
        elif isinstance(column, SiteLink):
            tests["sitelinks"][name] = F.col("project_url") == column.url
    return tests


def _is_statement_column(column: Column) -> bool:
    return isinstance(column, Qualifier | Referenced)


def _written_claims(facts: Facts, properties: Sequence[str]) -> DataFrame:
    claims = facts.claims.filter(F.col("property").isin(*properties))
    return written(claims.select("entity_id", "property", "statement_id", "snak_type", "value"))


class StatementTests:
    """Statements of some qualifier and reference columns, with their flags joined.

    Qualifiers and references are reduced to one row per statement before they
    meet the claims, so every join here is one to one. The claims and these rows are
    written: three frames are cut down to the claims, and what a task sorts and counts
    for the steps between two shuffles adds up in its memory. ``kept`` are claims that
    were written already, of these properties or more.
    """

    def __init__(self, facts: Facts, columns: Sequence[Column], kept: DataFrame | None = None):
        self.qualifiers = list(dict.fromkeys(c.qualifier for c in columns if c.qualifier))
        self.checks = list(
            dict.fromkeys(c.check for c in columns if isinstance(c, Referenced))
        )
        properties = sorted({c.property for c in columns})
        if kept is None:
            kept = _written_claims(facts, properties)
        rows = claims = kept.filter(F.col("property").isin(*properties))
        if self.qualifiers:
            flags = written(self._qualifier_flags(facts, claims))
            rows = rows.join(flags, "statement_id", "left")
        if self.checks:
            checked = written(statement_checks(facts, self.checks, claims))
            rows = rows.join(checked, "statement_id", "left")
        self.rows = rows

    def _qualifier_flags(self, facts: Facts, claims: DataFrame) -> DataFrame:
        rows = facts.qualifiers.filter(
            F.col("property").isin(*self.qualifiers) & has_value()
        )
        rows = rows.join(claims.select("statement_id"), "statement_id", "left_semi")
        flags = [
            F.max(F.col("property") == prop).alias(f"q{i}")
            for i, prop in enumerate(self.qualifiers)
        ]
        return rows.groupBy("statement_id").agg(*flags)

    def matches(self, column: Qualifier | Referenced) -> Expr:
        """Statements the column speaks about, but for a value tied to the group."""
        test = F.col("property") == column.property
        if isinstance(column, Qualifier) or column.value:
            test = test & has_value()
        if column.value and not follows_group(column):
            test = test & (F.col("value") == column.value)
        if column.qualifier:
            flag = F.col(f"q{self.qualifiers.index(column.qualifier)}")
            test = test & F.coalesce(flag, F.lit(False))
        return F.coalesce(test, F.lit(False))

    def unreferenced(self, column: Referenced) -> Expr:
        ok = F.col(f"ok{self.checks.index(column.check)}")
        return self.matches(column) & ~F.coalesce(ok, F.lit(False))

    def flags(self, columns: dict[str, Column]) -> list[Expr]:
        """Row flags: ``c`` for a matching statement, ``c_bad`` for an unreferenced one."""
        flags = []
        for name, column in columns.items():
            flags.append(self.matches(column).alias(name))
            if isinstance(column, Referenced):
                flags.append(self.unreferenced(column).alias(_lacking(name)))
        return flags


def _settle(columns: dict[str, Column]) -> list[Expr]:
    """Flags after the aggregation: seen, and nothing matching is unreferenced."""
    settled = []
    for name, column in columns.items():
        seen = F.coalesce(F.col(name), F.lit(False))
        if isinstance(column, Referenced) and not follows_group(column):
            seen = seen & ~F.coalesce(F.col(_lacking(name)), F.lit(False))
        settled.append(seen.alias(name))
    return settled


def pair_presence(facts: Facts, columns: dict[str, Column]) -> DataFrame | None:
    """(entity_id, group, flags) of the columns whose value is the row's group."""
    tied = {n: c for n, c in columns.items() if follows_group(c)}
    if not tied:
        return None
    tests = StatementTests(facts, list(tied.values()))
    flags = tests.flags(tied)
    rows = tests.rows.filter(has_value()).select(
        "entity_id", F.col("value").alias("group"), *flags
    )
    names = [c for c in rows.columns if c not in ("entity_id", "group")]
    pairs = rows.groupBy("entity_id", "group").agg(*[F.max(n).alias(n) for n in names])
    settled = []
    for name, column in tied.items():
        seen = F.col(name)
        if isinstance(column, Referenced):
            seen = seen & ~F.col(_lacking(name))
        settled.append(seen.alias(name))
    return pairs.select("entity_id", "group", *settled)


def presence(
    facts: Facts, columns: dict[str, Column], marks: dict[str, DataFrame] | None = None
) -> DataFrame:
    """One row per entity with one boolean per column (named by the dict's keys).

    Every fact table is read once and reduced to flags; the flags of all tables
    meet in one aggregation with map-side combine, so neither an entity with very
    many statements nor many columns make an extra shuffle. ``marks`` adds a
    flag for the entities of a frame. Columns tied to the group are true here
    if any value fits.
    """
    free = {n: c for n, c in columns.items() if not follows_group(c)}
    parts = []
    on_statements = {n: c for n, c in free.items() if _is_statement_column(c)}
    kept = None
    if on_statements:
        # Columns without a join read the same claims: these are cut down and written once.
        asked = [c for c in free.values() if isinstance(c, Property | Qualifier | Referenced)]
        kept = _written_claims(facts, sorted({c.property for c in asked}))
    for table, tests in _direct_tests(free).items():
        if tests:
            rows = kept if table == "claims" and kept is not None else getattr(facts, table)
            parts.append(_entity_rows(rows, tests))
    if on_statements:
        tests = StatementTests(facts, list(on_statements.values()), kept)
        # Sorting statements and counting entities are stages of their own.
        parts.append(written(tests.rows.select("entity_id", *tests.flags(on_statements))))
    pairs = pair_presence(facts, columns)
    if pairs is not None:
        parts.append(pairs.drop("group"))
    for name, entities in (marks or {}).items():
        parts.append(entities.select("entity_id", F.lit(True).alias(name)))
    if not parts:
        return facts.claims.select("entity_id").limit(0)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in rows.columns if c != "entity_id"]
    merged = rows.groupBy("entity_id").agg(*[F.max(n).alias(n) for n in names])
    others = [F.coalesce(F.col(n), F.lit(False)).alias(n) for n in marks or {}]
    return merged.select("entity_id", *_settle(columns), *others)


def entities_with_column(facts: Facts, column: Column) -> DataFrame:
    """Distinct entities that have the column."""
    return presence(facts, {"c0": column}).filter("c0").select("entity_id")
