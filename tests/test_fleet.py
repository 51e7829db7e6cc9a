"""Dashboards as data give the rows that each gives by itself, in a plan of one size."""

import random

import pytest

from factspan import Dashboard, GroupBy, columns_from_text
from factspan.operators.grouping import resolve_kind
from factspan.plans import report
from factspan.plans.coverage import Coverage
from factspan.plans.fleet import Fleet
from factspan.plans.output import with_places, write_ordered
from factspan.spec import EmptyGroupingError, link_from_text
from tests.graph import UNKNOWN_PREFIX, Graph, bag

PROJECTS = {"awiki": ("http://a/", "Q91"), "bwiki": ("http://b/", "Q92")}
COLUMNS = (
    "P1,P1/P2,P1/Q1/P2,P1/?grouping/P2,P1/S*,P1/S!,P1/S248,P1/S248=Q1,P1/S248=Q1;S854,"
    "P1/S248+S854,P1/Q1/S*,P1/P2/S*,P1/Q1/P2/S248,P1/?grouping/S*,Lde,Dde,awiki,P17"
)


def random_graph(seed=3, entities=40):
    draw = random.Random(seed)
    g = Graph()
    value = lambda: f"Q{draw.randrange(4)}"
    for i in range(entities):
        e = f"e{i}"
        for prop in ("P1", "P17"):
            for _ in range(draw.randrange(3)):
                refs = [
                    [(draw.choice(["P248", "P854", "P143", "P813"]), value()) for _ in range(draw.randrange(3))]
                    for _ in range(draw.randrange(3))
                ]
                quals = [("P2", draw.choice([None, value()])) for _ in range(draw.randrange(2))]
                rank = draw.choice(["normal", "normal", "preferred", "deprecated"])
                snak = draw.choice(["value"] * 5 + ["novalue", "somevalue"])
                found = None if snak != "value" else value()
                g.claim(e, prop, found, rank=rank, snak=snak, quals=quals, refs=refs)
        if i % 3:
            g.claim(e, "P569", str(1900 + i * 7), year=1900 + i * 7)
        if i % 7 == 0:
            g.claim(e, "P569", f"{UNKNOWN_PREFIX}y{i}", snak="somevalue", kind="time")
        # One property with dates for some entities and items for others.
        if i < 20:
            g.claim(e, "P5", value())
        else:
            g.claim(e, "P5", "x", year=2000 + i % 3)
        g.claim(e, "P31", f"K{i % 3}")
        g.claim(e, "P9", f"text {i}", kind="string")
        if draw.random() < 0.5:
            g.label(e, "de", "x")
        if draw.random() < 0.3:
            g.label(e, "de", "x", kind="description")
        if draw.random() < 0.6:
            g.link(e, draw.choice(["http://a/", "http://b/"]))
    for i in range(4):
        g.claim(f"Q{i}", "P30", f"C{i % 2}")
        g.claim(f"Q{i}", "P298", f"code{i}", kind="string")
        g.label(f"Q{i}", "en" if i % 2 else "mul", f"name {i}")
    g.claim("K1", "P279", "K0")
    g.claim("K2", "P279", "K1")
    return g


def boards(spark, facts):
    everyone = bag(spark, *[f"e{i}" for i in range(40)], "e1", "e2", "gone")
    young = "select entity_id from {claims} where property = 'P569' and time_year > 2000"
    columns = columns_from_text(COLUMNS, PROJECTS)
    edges = facts.claims.filter("property = 'P17' and snak_type = 'value'")
    edges = edges.selectExpr("entity_id", "value as `group`").distinct()
    plain = {"threshold": 1, "row_no_group": True}
    return [
        Dashboard(everyone, GroupBy(("P17",)), columns, "items", **plain, higher=("P30",), link=link_from_text("L")),
        Dashboard(young, GroupBy(("P17",)), columns[:6], "few", threshold=3, cell_threshold=2, link=link_from_text("x/{P298}")),
        Dashboard(everyone, GroupBy(("P569",)), columns[3:9], "years", **plain, link=link_from_text("Y/{id}")),
        Dashboard(everyone, GroupBy(("P17", "P30")), columns[:3], "path", **plain),
        Dashboard(everyone, GroupBy(("P17",)), columns[2:5], "named", **plain, groups="Q1,Q3,nothing"),
        Dashboard(everyone, GroupBy(kind="site"), columns[14:17], "sites", **plain),
        Dashboard(everyone, GroupBy(kind="item", edges=edges), columns[13:15], "given", **plain, limit=2),
        Dashboard("wdt:P31/wdt:P279* wd:K1", GroupBy(("P17",)), columns[:2], "classes", **plain),
        Dashboard("P31/P279* K1 ; P569 []", GroupBy(("P17",)), (), "no columns", threshold=1),
        Dashboard("wdt:P31 wd:K0", GroupBy(("P5",)), columns[:2], "mixed", **plain),
        Dashboard(bag(spark, *[f"e{i}" for i in range(20)]), GroupBy(("P5",)), columns[:2], "as items", **plain),
        Dashboard(bag(spark, *[f"e{i}" for i in range(20, 40)]), GroupBy(("P5",)), columns[:2], "as years", **plain),
    ]


BROKEN = {
    "select raise_error('broken') as entity_id from {claims}": "failed",
    "select no_such_column from {claims}": "failed",
    "P31/ K1": "failed",
}


@pytest.fixture(scope="module")
def graph(spark):
    return random_graph().facts(spark)


@pytest.fixture(scope="module")
def fleet(spark, graph):
    bad = [Dashboard(s, GroupBy(("P17",)), (), f"bad {i}") for i, s in enumerate(BROKEN)]
    odd = [
        Dashboard(bag(spark, "e1"), GroupBy(("P99",)), (), "no values"),
        Dashboard(bag(spark, "nobody"), GroupBy(("P17",)), (), "nobody"),
        Dashboard(bag(spark, "e1", "e2"), GroupBy(("P9",)), (), "strings", threshold=1),
        Dashboard(bag(spark, "e1"), GroupBy(edges=spark.createDataFrame([("e1", 1)], "entity_id string, group int")), (), "numbers"),
    ]
    return Fleet(graph, [*bad, *boards(spark, graph), *odd])


def test_rows_are_those_of_each_dashboard(spark, graph, fleet):
    lines, cells = {}, {}
    for r in fleet.lines().collect():
        lines.setdefault(r.dashboard, set()).add(tuple(r)[1:])
    for r in fleet.long_report().collect():
        cells.setdefault(r.dashboard, {})[r.section, r.group_key, r.column_key] = (r.column_count, r.percent)
    for board in boards(spark, graph):
        plan = Coverage(graph, board)
        rows = plan.lines().collect()
        wanted = {
            (r.section, r.kind, r.group_key, r.title, r.span, r.higher_group, r.group_link, r["count"]) for r in rows
        }
        assert lines[board.name] == wanted, board.name
        flags = dict(zip(plan.keys, plan.cells, strict=True))
        counts = {
            (r.section, r.group_key, c.key): r[flags[c.key]] for r in rows for c in board.columns
        }
        assert {k: v for k, (v, _) in cells.get(board.name, {}).items()} == counts, board.name


def test_outcomes(spark, graph, fleet):
    found = {r.dashboard: r for r in fleet.outcomes().collect()}
    assert len(found) == len(fleet.asked)
    reported = {b.name for b in boards(spark, graph)}
    assert {n for n, r in found.items() if r.outcome == "reported"} == reported
    assert all(r.select_seconds >= 0 and r.groups > 0 and r.error is None for n, r in found.items() if n in reported)
    assert [found[f"bad {i}"].outcome for i in range(3)] == ["failed"] * 3
    assert "broken" in found["bad 0"].error and "cannot read" in found["bad 2"].error
    told = {n: found[n].error for n in ("no values", "nobody", "strings", "numbers")}
    assert told == {
        "no values": "no values for P99",
        "nobody": "no groups found",
        "strings": "cannot group by the values of P9",
        "numbers": "cannot group by int",
    }


def test_the_kind_is_that_of_the_selected_entities(spark, graph, fleet):
    kinds = {r.dashboard: r.kind for r in fleet.kinds().collect()}
    assert (kinds["as items"], kinds["as years"], kinds["mixed"]) == ("item", "year", "item")
    for board in boards(spark, graph)[-3:]:
        assert resolve_kind(graph, board).group_by.kind == kinds[board.name]
    with pytest.raises(EmptyGroupingError):
        resolve_kind(graph, Dashboard(bag(spark, "e1"), GroupBy(("P99",)), ()))


def test_texts_in_order(spark, graph, fleet, tmp_path):
    texts = fleet.texts()
    write_ordered(texts, str(tmp_path / "texts"), "dashboard", "line")
    for board in boards(spark, graph)[1:3]:
        (whole,) = report.render(Coverage(graph, board)).collect()
        rows = texts.filter(texts.dashboard == board.name).orderBy("place").collect()
        assert [r.place for r in rows] == list(range(len(rows)))
        assert "".join(r.line for r in rows) == whole.report
        files = sorted((tmp_path / "texts" / f"dashboard={board.name}").glob("*.txt"))
        assert "".join(f.read_text() for f in files) == whole.report


def test_places_over_many_ranges(spark):
    draw = random.Random(2)
    rows = [("big" if i % 9 else f"d{i % 4}", draw.randrange(50), i) for i in range(3000)] + [(None, 1, -1)]
    table = spark.createDataFrame(rows, "name string, size int, id int")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = with_places(table, "name", [table["size"].desc(), "id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for name in {r[0] for r in rows}:
        wanted = sorted((r for r in rows if r[0] == name), key=lambda r: (-r[1], r[2]))
        own = sorted((r for r in found if r.name == name), key=lambda r: r.place)
        assert [tuple(r)[:3] for r in own] == wanted
        assert [r.place for r in own] == list(range(1, len(own) + 1))


def plan_size(frame) -> int:
    return frame._jdf.queryExecution().optimizedPlan().toString().count("\n")


def test_statements_are_cut_down_and_judged_before_they_meet(fleet):
    """A task that joins verdicts to statements neither looks at nodes nor at snaks."""
    plan = fleet._statements(fleet.near())._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan
    assert "reference_id" not in plan


def plan_text(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_claims_are_cut_down_to_the_selection_once(fleet):
    """Paths and columns read the same written claims."""
    assert "Join" not in plan_text(fleet.near().claims)


def test_selectors_that_cannot_be_planned_split_no_job(spark, graph, monkeypatch):
    jobs = []
    run = Fleet._by_frames
    monkeypatch.setattr(Fleet, "_by_frames", lambda self, some, numbers: jobs.append(len(some)) or run(self, some, numbers))
    texts = ["select no_such_column from {claims}", *[f"select entity_id from {{claims}} where property = 'P{i}'" for i in (1, 17)]]
    found = Fleet(graph, [Dashboard(t, GroupBy(("P17",)), (), f"b{i}") for i, t in enumerate(texts)])
    assert jobs == [2] and list(found.failed) == ["b0"]
    assert {r.dashboard for r in found.selected().select("dashboard").distinct().collect()} == {"b1", "b2"}


def test_more_checks_and_qualifiers_than_a_number_has_bits(spark):
    g = Graph()
    for i in range(70):
        quals = [(f"P{200 + i}", "v"), (f"P{200 + (i + 1) % 70}", "v")]
        g.claim(f"e{i}", "P1", "Q1", quals=quals, refs=[[(f"P{400 + i}", "v"), (f"P{400 + (i + 7) % 70}", "v")]])
    g.claim("e0", "P17", "Q1")
    text = ",".join(f"P1/P{200 + i},P1/S{400 + i},P1/S{400 + i}+S{400 + (i + 7) % 70},P1/S{400 + i};S{400 + (i + 3) % 70}" for i in range(70))
    board = Dashboard(bag(spark, *[f"e{i}" for i in range(70)]), GroupBy(("P17",)), columns_from_text(text), "b", threshold=1)
    rows = Fleet(g.facts(spark), [board]).long_report().filter("section = 2").collect()
    found = {r.column_key: r.column_count for r in rows}
    wanted = {}
    for i in range(70):
        wanted |= {f"P1/P{200 + i}": 2, f"P1/S{400 + i}": 2, f"P1/S{400 + i}+S{400 + (i + 7) % 70}": 1}
        wanted[f"P1/S{400 + i};S{400 + (i + 3) % 70}"] = 4
    assert found == wanted


def test_edges_meet_the_kinds_of_their_dashboards_where_they_lie(fleet):
    plan = fleet._pairs()._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan


def test_two_hundred_dashboards_have_the_plan_of_twenty(spark, graph):
    columns = columns_from_text(COLUMNS, PROJECTS)

    def many(count):
        return [
            Dashboard(
                f"wdt:P31/wdt:P279* wd:K{i % 3}",
                GroupBy((("P17",), ("P569",), ("P17", "P30"))[i % 3]),
                columns[i % 10 : i % 10 + 5],
                f"board {i}",
                threshold=1 + i % 2,
                row_no_group=i % 2 == 0,
            )
            for i in range(count)
        ]

    few, most = Fleet(graph, many(20)), Fleet(graph, many(200))
    sizes = [(plan_size(f.long_report()), plan_size(f.texts()), plan_size(f._pairs()), plan_size(f._presence())) for f in (few, most)]
    assert sizes[0] == sizes[1]
    shown = lambda f, name: sorted(map(tuple, f.long_report().filter(f"dashboard = '{name}'").collect()))
    assert shown(few, "board 7") == shown(most, "board 7") != []
    # Boards that ask the same under other names have the same rows.
    assert [r[1:] for r in shown(most, "board 190")] == [r[1:] for r in shown(most, "board 10")]
