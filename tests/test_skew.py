"""Hot keys are split at run time; that changes where rows go, never the result."""

import pytest

from factspan import Dashboard, GroupBy, columns_from_text
from factspan.operators.selection import (
    class_closure,
    entities_of_class,
    follow_path,
    truthy_edges,
)
from factspan.plans import report
from factspan.plans.coverage import Coverage
from factspan.plans.drilldown import DrillDown
from tests.graph import Graph, bag

# Any partition of some bytes counts as skewed, and none is broadcast.
EAGER = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.01",
}


def skewed_graph():
    """One entity, value, node and class hold a large share of everything."""
    g = Graph()
    for i in range(40):
        entity = f"e{i}"
        g.claim("hot", "P17", f"Q{i}", rank="preferred" if i % 2 else "normal")
        g.claim(entity, "P17", "Q1")
        statement = g.claim(entity, "P1", "Q1" if i % 3 else f"Q{i}", quals=[("P2", "x")] * 2)
        g.node(statement, "shared" if i % 5 else f"own{i}")
        g.claim(f"Q{i + 1}", "P279", "Q0" if i < 20 else f"Q{i % 7 + 1}")
        g.claim("hot", "P1", f"Q{i}", refs=[[("P854", f"u{i}")]])
        g.claim(f"Q{i}", "P30", "Q900" if i % 2 else f"Q{i + 100}")
    for i in range(9):
        g.rows["reference_snaks"].append(("shared", f"P{700 + i}", "v"))
        g.label(f"Q{i}", "en", f"name {i}")
    g.rows["reference_snaks"].append(("shared", "P248", "Q1"))
    return g


def both(spark, run):
    facts = skewed_graph().facts(spark)
    wanted = sorted(map(repr, run(facts).collect()))
    before = {key: spark.conf.get(key, None) for key in EAGER}
    try:
        for key, value in EAGER.items():
            spark.conf.set(key, value)
        found = sorted(map(repr, run(facts).collect()))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    assert found == wanted
    return found


def selector(spark):
    return bag(spark, "hot", "hot", *[f"e{i}" for i in range(40)])


def test_coverage(spark):
    keys = "P1,P1/P2,P1/S*,P1/S248,P1/?grouping/P2,P1/?grouping/S*"
    board = Dashboard(
        selector(spark),
        GroupBy(("P17",), "item"),
        columns_from_text(keys),
        threshold=1,
        row_no_group=True,
    )
    assert len(both(spark, lambda f: report.long_report(Coverage(f, board)))) > 40


@pytest.mark.parametrize("key", ["P1/S*", "P1/S248", "P1/P2", "P1"])
def test_drill_downs(spark, key):
    board = Dashboard(selector(spark), GroupBy(("P17",), "item"), columns_from_text(key))
    assert both(spark, lambda f: DrillDown(f, board).positive(key, ""))
    both(spark, lambda f: DrillDown(f, board).negative(key, ""))


def test_paths_and_classes(spark):
    assert both(spark, lambda f: truthy_edges(f, "P17"))
    assert both(spark, lambda f: follow_path(f, ("P17", "P30")))
    assert len(both(spark, lambda f: class_closure(f, "Q0", "P279"))) == 41
    assert both(spark, lambda f: entities_of_class(f, "Q0", "P17", "P279"))


def test_class_cycles_end(spark):
    g = Graph()
    g.claim("Q2", "P279", "Q1")
    g.claim("Q1", "P279", "Q2")
    g.claim("a", "P31", "Q1")
    g.claim("a", "P31", "Q2")
    facts = g.facts(spark)
    assert {r.class_id for r in class_closure(facts, "Q1", "P279").collect()} == {"Q1", "Q2"}
    found = entities_of_class(facts, "Q1", "P31", "P279").collect()
    assert [r.entity_id for r in found] == ["a", "a"]
