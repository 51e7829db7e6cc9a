"""The facts are cut down to the selection, whatever its size, before anything is aggregated."""

from factspan import Dashboard, GroupBy, columns_from_text
from factspan.operators.presence import presence
from factspan.operators.selection import among
from factspan.plans.coverage import Coverage
from factspan.plans.drilldown import DrillDown
from tests.graph import bag
from tests.test_brute_force import KEYS, random_graph


def board(spark, chosen):
    columns = columns_from_text(KEYS)
    return Dashboard(bag(spark, *chosen), GroupBy(("P17",), "item"), columns, threshold=1)


def test_facts_of_others_do_not_matter(spark):
    g, chosen = random_graph(7)
    facts = g.facts(spark)
    plan = Coverage(facts, board(spark, chosen))
    kept = plan.near()
    inside = {r.entity_id for r in kept.claims.select("entity_id").collect()}
    assert inside <= set(chosen)
    again = Coverage(among(facts, bag(spark, *set(chosen))), board(spark, chosen))
    assert sorted(map(repr, plan.lines().collect())) == sorted(map(repr, again.lines().collect()))


def test_one_plan_for_selections_of_any_size(spark):
    """Each drill-down joins the fact tables to the members before it reduces them."""
    g, chosen = random_graph(3)
    facts = g.facts(spark)
    for some in (chosen, chosen[:2]):
        drill = DrillDown(facts, board(spark, some))
        near = drill.near(drill.row("Q1"))
        for table in (near.claims, near.terms, near.sitelinks):
            assert "LeftSemi" in table._jdf.queryExecution().optimizedPlan().toString()


def _plan_text(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_groups_and_no_grouping_rows_share_their_edges(spark):
    """What both are made of is cut down to the selection once and read back."""
    g, chosen = random_graph(5)
    columns = columns_from_text("P21,P569/P1319")
    by = GroupBy(("P17",), "item")
    shared = Dashboard(bag(spark, *chosen), by, columns, threshold=1, row_no_group=True)
    plan = Coverage(g.facts(spark), shared)
    assert "Join" not in _plan_text(plan.pairs())


def test_claims_of_all_columns_are_cut_down_once(spark):
    """Columns with and without qualifiers or references read the same written claims."""
    g, chosen = random_graph(5)
    plan = Coverage(g.facts(spark), board(spark, chosen))
    columns = {f"c{i}": c for i, c in enumerate(columns_from_text("P21,P569/P1319,P21/S*"))}
    assert "Join" not in _plan_text(presence(plan.near(), columns))
