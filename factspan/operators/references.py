"""Reference checks at node and statement level, and what a node shows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.facts import Facts
from factspan.operators.tables import written
from factspan.spec import (
    FIRST_REFERENCE_PROPERTIES,
    LAST_REFERENCE_PROPERTIES,
    POOR_REFERENCE_PROPERTIES,
    RefCheck,
)

_POOR = "_poor"


def _snak_tests(checks: Iterable[RefCheck]) -> dict[tuple[str, str | None], str]:
    """A flag name for each (property, value) that some check asks for."""
    parts = dict.fromkeys(part for check in checks for part in check.parts)
    return {part: f"_has{i}" for i, part in enumerate(parts)}


def _node_flags(facts: Facts, checks: Sequence[RefCheck]) -> DataFrame | None:
    """One row per node that has a snak some check looks at; None if none does."""
    tests = _snak_tests(checks)
    wanted = {prop for prop, _ in tests}
    flags = []
    for (prop, value), name in tests.items():
        test = F.col("property") == prop
        if value is not None:
            test = test & (F.col("value") == value)
        flags.append(F.max(test).alias(name))
    if any(check.mode == "good" for check in checks):
        wanted.update(POOR_REFERENCE_PROPERTIES)
        flags.append(F.max(F.col("property").isin(*POOR_REFERENCE_PROPERTIES)).alias(_POOR))
    if not flags:
        return None
    snaks = facts.reference_snaks.filter(F.col("property").isin(*sorted(wanted)))
    return snaks.groupBy("reference_id").agg(*flags)


def _passes(check: RefCheck, tests: dict[tuple[str, str | None], str]) -> Column:
    """Whether one node passes; missing flags count as false."""
    if check.mode == "any":
        return F.lit(True)
    if check.mode == "good":
        return ~F.coalesce(F.col(_POOR), F.lit(False))
    found = [F.coalesce(F.col(tests[part]), F.lit(False)) for part in check.parts]
    verdict = found[0]
    for other in found[1:]:
        verdict = verdict & other if check.mode == "all_of" else verdict | other
    return verdict


def _snaks_of(facts: Facts, nodes: DataFrame) -> Facts:
    """The facts with the snaks of these nodes only."""
    wanted = nodes.select("reference_id").distinct()
    snaks = facts.reference_snaks.join(wanted, "reference_id", "left_semi")
    return replace(facts, reference_snaks=snaks)


def statement_checks(
    facts: Facts, checks: Sequence[RefCheck], statements: DataFrame
) -> DataFrame:
    """(statement_id, ok0, ok1, ...): whether a single node passes each check.

    All checks share one pass over the snaks and one over the nodes. Nodes of
    other ``statements`` go first: of all a graph's references few are in question.
    Snaks of other nodes go before they are reduced to flags; as nodes are read twice
    then, they are written.
    """
    ids = statements.select("statement_id")
    nodes = facts.reference_nodes.join(ids, "statement_id", "left_semi")
    if any(check.mode != "any" for check in checks):
        nodes = written(nodes)
        flags = _node_flags(_snaks_of(facts, nodes), checks)
        nodes = nodes.join(flags, ["reference_id"], "left")
    tests = _snak_tests(checks)
    verdicts = [F.max(_passes(c, tests)).alias(f"ok{i}") for i, c in enumerate(checks)]
    return nodes.groupBy("statement_id").agg(*verdicts)


def shown_by_priority(facts: Facts) -> DataFrame:
    """(reference_id, ref_property, ref_value): each node's most telling snaks.

    Classes in order: the leading properties one by one, any other property,
    the last-resort properties; ties within the first filled class all stay.
    """
    prop = F.col("property")
    rank = F.when(prop.isin(*LAST_REFERENCE_PROPERTIES), len(FIRST_REFERENCE_PROPERTIES) + 1)
    for place, leading in enumerate(FIRST_REFERENCE_PROPERTIES):
        rank = rank.when(prop == leading, place)
    snaks = facts.reference_snaks.select(
        "reference_id",
        F.col("property").alias("ref_property"),
        F.col("value").alias("ref_value"),
        rank.otherwise(len(FIRST_REFERENCE_PROPERTIES)).alias("_class"),
    )
    best = snaks.groupBy("reference_id").agg(F.min("_class").alias("_class"))
    shown = snaks.join(best, ["reference_id", "_class"], "left_semi")
    return shown.drop("_class").distinct()


def _values_of(facts: Facts, prop: str, name: str) -> DataFrame:
    rows = facts.reference_snaks.filter(F.col("property") == prop)
    return rows.select("reference_id", F.col("value").alias(name)).distinct()


def _with_node_values(
    facts: Facts, rows: DataFrame, values: DataFrame, how: str
) -> DataFrame:
    return rows.join(values, ["reference_id"], how)


def shown_references(facts: Facts, check: RefCheck, rows: DataFrame) -> DataFrame:
    """Add what ``check`` shows of each statement's references to ``rows``.

    ``rows`` carry ``statement_id``. Checks without an open property add nothing.
    """
    open_properties = list(dict.fromkeys(check.open_properties))
    priority = check.mode in ("any", "good")
    if not priority and not open_properties:
        return rows
    statements = rows.select("statement_id").distinct()
    # A statement's own rows are few per node; the statement side is unique.
    nodes = written(facts.reference_nodes.join(statements, ["statement_id"], "left_semi"))
    facts = _snaks_of(facts, nodes)
    if priority:
        nodes = _with_node_values(facts, nodes, shown_by_priority(facts), "left")
    elif check.mode == "all_of":
        for prop in open_properties:
            nodes = _with_node_values(
                facts, nodes, _values_of(facts, prop, f"ref_{prop}"), "inner"
            )
    elif len(check.parts) == 1:
        shown = _values_of(facts, open_properties[0], "ref_value")
        nodes = _with_node_values(facts, nodes, shown, "inner")
    else:
        names = []
        for prop in open_properties:
            names.append(f"_{prop}")
            nodes = _with_node_values(facts, nodes, _values_of(facts, prop, names[-1]), "left")
        nodes = nodes.withColumn("ref_value", F.coalesce(*names)).drop(*names)
    shown = nodes.drop("reference_id").distinct()
    return shown.join(rows, ["statement_id"], "inner")
