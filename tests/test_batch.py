"""Dashboards that fail leave the others alone; limits and unknown rows of each are its own."""

from dataclasses import replace

from factspan import Dashboard, GroupBy, columns_from_text
from factspan.plans.batch import plan_all
from factspan.plans.coverage import Coverage
from factspan.plans.drilldown import DrillDown
from factspan.plans.lists import member_lists
from factspan.spec import dashboard_from_params
from tests.graph import Graph, bag

BY_COUNTRY = GroupBy(("P17",), "item")
UNKNOWN = "http://www.wikidata.org/.well-known/genid/"


def countries():
    g = Graph()
    for i in range(9):
        g.claim(f"e{i}", "P17", f"Q{i % 3}")
        g.claim(f"e{i}", "P1", "v", quals=[("P2", f"x{i}")])
    return g


def test_failing_dashboards_become_errors(spark):
    facts = countries().facts(spark)
    chosen = bag(spark, *[f"e{i}" for i in range(9)])
    ids = spark.createDataFrame([("e1", 5)], "entity_id string, group int")
    failing = "select cast(raise_error('no such row') as string) as entity_id from {claims}"
    wrong = "select cast(entity_id as int) as entity_id from {claims}"
    boards = [
        Dashboard(chosen, BY_COUNTRY, columns_from_text("P1"), "good", threshold=1),
        Dashboard(chosen, BY_COUNTRY, columns_from_text("P1"), "two", threshold=1, limit=2),
        Dashboard(failing, BY_COUNTRY, (), "failing", threshold=1),
        Dashboard(wrong, BY_COUNTRY, (), "wrong", threshold=1),
        Dashboard(chosen, GroupBy(edges=ids), (), "numbers", threshold=1),
    ]
    batch = plan_all(facts, boards)
    errors = {r.dashboard: r.error for r in batch.errors.collect()}
    assert set(errors) == {"failing", "wrong", "numbers"} and all(errors.values())
    lines = batch.lines().filter("section = 0").collect()
    assert sorted((r.dashboard, r.group_key, r["count"], r.c0) for r in lines) == [
        *[("good", f"Q{i}", 3, 3) for i in range(3)],
        *[("two", f"Q{i}", 3, 3) for i in range(2)],
    ]


def test_the_unknown_row_is_whole_whatever_the_limit(spark):
    g = countries()
    for i in range(40):
        g.claim(f"u{i}", "P17", f"{UNKNOWN}{i}", snak="somevalue")
    chosen = bag(spark, *[f"e{i}" for i in range(9)], *[f"u{i}" for i in range(40)])
    facts = g.facts(spark)
    for limit in (None, 1, 3):
        board = Dashboard(chosen, BY_COUNTRY, (), threshold=1, limit=limit)
        rows = {r.group_key: r["count"] for r in Coverage(facts, board).lines().collect()}
        assert rows["UNKNOWN_VALUE"] == 40
        assert sum(k.startswith("Q") for k in rows) == (limit or 3)
        assert DrillDown(facts, board).members("UNKNOWN_VALUE").count() == 40


def test_tied_qualifiers_in_member_lists(spark):
    g = Graph()
    g.claim("a", "P17", "Q1", quals=[("P2", "one")])
    g.claim("a", "P17", "Q2", quals=[("P2", "two")])
    facts = g.facts(spark)
    board = Dashboard(bag(spark, "a"), BY_COUNTRY, columns_from_text("P17/?grouping/P2"), threshold=1)
    found = member_lists(facts, board, Coverage(facts, board).lines().filter("section = 0"))
    shown = {(r.group_key, r.value) for r in found.collect() if r.field != "label"}
    assert shown == {("Q1", "one"), ("Q2", "two")}


def test_dashboards_that_ask_for_lists_get_them(spark, tmp_path):
    facts = countries().facts(spark)
    chosen = bag(spark, *[f"e{i}" for i in range(9)])
    params = {"grouping_property": "P17", "properties": "P1", "grouping_threshold": "1"}
    params |= {"selector": "select entity_id from {claims} where property = 'P1'"}
    params |= {"grouping_link": "Lists/{id}"}
    boards = [
        dashboard_from_params(params | {"grouping_link_mode": mode}, name)
        for mode, name in (("create", "a"), ("link", "b"), ("create", "c"))
    ]
    boards[2] = replace(boards[2], selector=chosen.filter("entity_id < 'e4'"))
    pages = spark.createDataFrame([("Lists/Q1",)], "title string")
    plan_all(facts, boards).create_lists(pages, str(tmp_path / "lists"))
    found = spark.read.parquet(str(tmp_path / "lists")).filter("field = 'P1'").collect()
    assert sorted((r.dashboard, r.group_key, r.entity_id, r.value) for r in found) == sorted(
        (d, f"Q{i % 3}", f"e{i}", "v") for d, n in (("a", 9), ("c", 4)) for i in range(n) if i % 3 != 1
    )
    assert plan_all(facts, boards[1:2]).lists(pages).collect() == []


def test_what_told_the_kinds_is_not_computed_again(spark):
    """Selections, edges and the claims of entities come from the fleet that told the kinds."""
    facts = countries().facts(spark)
    chosen = bag(spark, *[f"e{i}" for i in range(9)])
    boards = [Dashboard(chosen, GroupBy(("P17",)), columns_from_text("P1/P2,P1"), f"d{i}", threshold=1 + i) for i in range(2)]
    batch = plan_all(facts, boards)
    for frame in (batch.coverage.near().claims, batch.coverage._edges(batch.coverage.dashboards[0].group_by)):
        assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()
    # One that tells its kind itself is selected beside the others.
    mixed = plan_all(facts, [*boards, replace(boards[0].with_kind("item"), name="told")])
    rows = lambda b, name: sorted(tuple(r)[1:] for r in b.lines().filter(f"dashboard = '{name}'").collect())
    assert rows(mixed, "told") == rows(mixed, "d0") == rows(batch, "d0") != []


def test_lists_of_many_dashboards_are_one_plan(spark):
    facts = countries().facts(spark)
    pages = spark.createDataFrame([], "title string")

    def batch(n):
        params = {"grouping_property": "P17", "grouping_threshold": "1", "grouping_link": "L/{id}"}
        params |= {"selector": "select entity_id from {claims} where property = 'P1'"}
        params |= {"grouping_link_mode": "create"}
        return plan_all(
            facts,
            [
                dashboard_from_params(params | {"properties": "P1,Len" if i % 2 else "P1"}, f"d{i}")
                for i in range(n)
            ],
        )

    few, many = batch(3).lists(pages), batch(50).lists(pages)
    size = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(many) == size(few)
    found = {}
    for r in many.collect():
        found.setdefault(r.dashboard, set()).add((r.group_key, r.entity_id, r.field, r.value))
    assert len(found) == 50
    named = [("label", None), ("P1", "v")]
    texts = [("label/en", None), ("P1", "v")]
    for i in range(50):
        fields = texts if i % 2 else named
        assert found[f"d{i}"] == {(f"Q{j % 3}", f"e{j}", f, v) for j in range(9) for f, v in fields}
