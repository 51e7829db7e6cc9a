import pytest

from factspan import Dashboard, Facts, GroupBy, columns_from_text, link_from_text
from factspan.operators.grouping import group_kinds, resolve_kind
from factspan.operators.presence import StatementTests, presence
from factspan.operators.selection import follow_path, truthy_edges
from factspan.plans import report
from factspan.plans.coverage import Coverage
from factspan.spec import EmptyGroupingError, UnsupportedGroupingError
from tests.graph import Graph, bag

ITEM = GroupBy(("P17",), "item")


def lines(facts, selector, columns="", by=ITEM, **options):
    """{(section, group key): (count, cells...)}"""
    options = {"threshold": 1, "row_no_group": True} | options
    board = Dashboard(selector, by, columns_from_text(columns, facts.project_table()), **options)
    plan = Coverage(facts, board)
    rows = plan.lines().collect()
    return {(r.section, r.group_key): (r["count"], *[r[c] for c in plan.cells]) for r in rows}


def test_totals_count_the_bag_and_groups_count_entities(spark):
    g = Graph()
    for country in ("Q1", "Q2"):
        g.claim("a", "P17", country)
    g.claim("b", "P17", "Q1")
    g.claim("a", "P1", "Q9")
    found = lines(g.facts(spark), bag(spark, "a", "a", "b", "c", "c"), "P1")
    assert found == {
        (0, "Q1"): (2, 1),
        (0, "Q2"): (1, 1),
        (1, "None"): (2, 0),
        (2, ""): (5, 2),
    }


def test_best_rank(spark):
    g = Graph()
    g.claim("a", "P17", "Q1", rank="preferred")
    g.claim("a", "P17", "Q2")
    g.claim("a", "P17", "Q3", rank="deprecated")
    g.claim("b", "P17", "Q2")
    g.claim("c", "P17", "Q3", rank="deprecated")
    g.claim("d", "P17", snak="novalue", rank="preferred")
    g.claim("d", "P17", "Q1")
    found = {tuple(r) for r in truthy_edges(g.facts(spark), "P17").collect()}
    assert found == {("a", "Q1"), ("b", "Q2")}


def test_paths_reach_unknown_and_several_values(spark):
    g = Graph()
    g.claim("a", "P17", "Q1")
    g.claim("b", "P17", "Q2")
    g.claim("Q1", "P30", "Q10")
    g.claim("Q1", "P30", "Q11")
    g.claim("Q2", "P30", snak="somevalue", value="x:1")
    found = {tuple(r) for r in follow_path(g.facts(spark), ("P17", "P30")).collect()}
    assert found == {("a", "Q10"), ("a", "Q11"), ("b", "x:1")}


def test_property_counts_any_statement(spark):
    g = Graph()
    for entity in "abcd":
        g.claim(entity, "P17", "Q1")
    g.claim("a", "P1", "Q5", rank="deprecated")
    g.claim("b", "P1", snak="novalue")
    g.claim("c", "P1", snak="somevalue")
    assert lines(g.facts(spark), bag(spark, *"abcd"), "P1")[0, "Q1"] == (4, 3)


def test_qualifiers_need_a_value_on_both(spark):
    g = Graph()
    for entity in "abcd":
        g.claim(entity, "P17", "Q1")
    g.claim("a", "P1", "Q5", quals=[("P2", "x")])
    g.claim("b", "P1", "Q6", quals=[("P2", None)])
    g.claim("c", "P1", snak="novalue", quals=[("P2", "x")])
    g.claim("d", "P1", "Q6", quals=[("P3", "x")])
    found = lines(g.facts(spark), bag(spark, *"abcd"), "P1/P2,P1/Q5/P2,P1/Q6/P2,P1/Q6/P3")
    assert found[0, "Q1"] == (4, 1, 1, 0, 1)


def reference_graph():
    g = Graph()
    for entity in "abcdefg":
        g.claim(entity, "P17", "Q1")
    # a: one node has both; b: two nodes, each has one; c: a node without snaks.
    g.claim("a", "P1", "Q5", refs=[[("P248", "Q7"), ("P304", "9")]])
    g.claim("b", "P1", "Q5", refs=[[("P248", "Q7")], [("P304", "9")]])
    g.claim("c", "P1", "Q5", refs=[[]])
    # d: one statement is unreferenced; e: no statement at all.
    g.claim("d", "P1", "Q5", refs=[[("P248", "Q8")]])
    g.claim("d", "P1", "Q6", quals=[("P2", "x")])
    # f: poor node only; g: a poor and a good node, shared with f's statement.
    poor = g.claim("f", "P1", "Q6")
    g.node(poor, "shared", [("P143", "Q1"), ("P248", "Q7")])
    both = g.claim("g", "P1", "Q6", snak="novalue", refs=[[("P854", "u")]])
    g.rows["reference_nodes"].append((both, "shared"))
    return g


@pytest.mark.parametrize(
    ("key", "count"),
    [
        ("P1/S*", 5),  # a b c f g
        ("P1/S!", 4),  # a b c g
        ("P1/S248", 4),  # a b f g
        ("P1/S248=Q7", 4),
        ("P1/S248=Q8", 0),
        ("P1/S304;S854", 3),  # a b g
        ("P1/S248+S304", 1),  # a
        ("P1/S248=Q7+S143", 2),  # f g
        ("P1/Q5/S*", 4),  # a b c d: d's other statement is out of scope
        ("P1/Q6/S*", 1),  # f: g has no main value
        ("P1/P2/S*", 0),
    ],
)
def test_reference_checks(spark, key, count):
    facts = reference_graph().facts(spark)
    assert lines(facts, bag(spark, *"abcdefg"), key)[0, "Q1"] == (7, count)


def test_reference_columns_share_a_plan(spark):
    keys = "P1/S*,P1/S!,P1/S248,P1/S304;S854,P1/S248+S304,P1/Q5/S*,P1"
    found = lines(reference_graph().facts(spark), bag(spark, *"abcdefg"), keys)
    assert found[0, "Q1"] == (7, 5, 4, 4, 3, 1, 4, 6)
    assert found[2, ""] == (7, 5, 4, 4, 3, 1, 4, 6)


@pytest.mark.parametrize("keys", ["P1/P2", "P1/S*", "P1/S!", "P1/S248,P1/P2,P1/Q5/S*"])
def test_what_meets_the_statements_is_reduced_before(spark, keys):
    """A task that joins flags to statements neither cuts frames down nor counts as well."""
    rows = StatementTests(reference_graph().facts(spark), columns_from_text(keys)).rows
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan
    assert "LeftSemi" not in plan
    assert "Aggregate" not in plan


def test_entities_are_counted_after_statements_are_joined(spark):
    columns = dict(zip(["c0", "c1"], columns_from_text("P1/P2,P1/S!"), strict=True))
    found = presence(reference_graph().facts(spark), columns)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan
    assert "Join" not in plan


def test_columns_tied_to_the_group(spark):
    g = Graph()
    g.claim("a", "P17", "Q1")
    g.claim("b", "P17", "Q1")
    g.claim("a", "P1", "Q1", quals=[("P2", "x")], refs=[[]])
    g.claim("a", "P1", "Q3")
    g.claim("b", "P1", "Q2", quals=[("P2", "x")])
    g.claim("c", "P1", "Q2", quals=[("P2", "x")], refs=[[]])
    keys = "P1/?grouping/P2,P1/?grouping/S*"
    found = lines(g.facts(spark), bag(spark, *"abc"), keys)
    # Without a group any value fits.
    assert found == {(0, "Q1"): (2, 1, 1), (1, "None"): (1, 1, 1), (2, ""): (3, 3, 2)}


def test_tied_columns_never_equal_a_year(spark):
    g = Graph()
    g.claim("a", "P571", "1990", year=1990)
    g.claim("a", "P1", "1990", quals=[("P2", "x")])
    by = GroupBy(("P571",), "year")
    found = lines(g.facts(spark), bag(spark, "a"), "P1/?grouping/P2", by)
    assert found[0, "1990"] == (1, 0)
    assert found[2, ""] == (1, 1)


def test_terms_and_sites(spark):
    g = Graph()
    g.label("a", "de", "A")
    g.label("b", "mul", "B")
    g.label("b", "de", "text", kind="description")
    g.link("a", "https://br.example.org/")
    g.link("b", "https://br.example.org/")
    g.link("b", "https://fr.example.org/")
    g.rows["projects"] += [("brwiki", "https://br.example.org/", "Q1")]
    by = GroupBy(kind="site")
    found = lines(g.facts(spark), bag(spark, "a", "b", "c"), "Lde,Dde,brwiki", by)
    assert found == {
        (0, "https://br.example.org/"): (2, 1, 1, 2),
        (0, "https://fr.example.org/"): (1, 0, 1, 1),
        (1, "None"): (1, 0, 0, 0),
        (2, ""): (3, 1, 1, 2),
    }


@pytest.mark.parametrize(("threshold", "unknown"), [(1, (3, 2)), (2, None)])
def test_unknown_groups_fold_after_the_threshold(spark, threshold, unknown):
    g = Graph()
    for entity in "abc":
        g.claim(entity, "P17", snak="somevalue")
    for entity in "de":
        g.claim(entity, "P17", "Q1")
    for entity in "abd":
        g.claim(entity, "P1", "Q5")
    found = lines(g.facts(spark), bag(spark, *"abcde"), "P1", threshold=threshold)
    assert found.get((0, "UNKNOWN_VALUE")) == unknown
    assert found[0, "Q1"] == (2, 1)
    assert found[1, "None"] == (0, 0)


def test_unknown_cells_add_up_groups_below_the_threshold_too(spark):
    g = Graph()
    for entity in "abc":
        g.claim(entity, "P17", snak="somevalue", value="http://www.wikidata.org/.well-known/genid/x" if entity != "c" else None)
        g.claim(entity, "P1", "Q5")
    found = lines(g.facts(spark), bag(spark, *"abc"), "P1", threshold=2)
    assert found[0, "UNKNOWN_VALUE"] == (2, 3)


def test_cell_threshold(spark):
    g = Graph()
    for entity in "abc":
        g.claim(entity, "P17", "Q1")
    g.claim("a", "P1", "Q5")
    facts = g.facts(spark)
    found = lines(facts, bag(spark, *"abc"), "P1,P17", cell_threshold=2)
    assert found[0, "Q1"] == (3, 0, 3)
    assert found[2, ""] == (3, 1, 3)


def test_years_without_a_date_are_unknown(spark):
    g = Graph()
    g.claim("a", "P571", "x", year=1990)
    g.claim("b", "P571", snak="somevalue")
    found = lines(g.facts(spark), bag(spark, "a", "b"), by=GroupBy(("P571",), "year"))
    assert found[0, "UNKNOWN_VALUE"] == (1,)
    assert found[0, "1990"] == (1,)


def year_lines(spark, counts, **options):
    """Lines of a dashboard with so many entities (all, and with P1) in each year."""
    edges, claims = [], Graph()
    for year, (total, having) in counts.items():
        for i in range(total):
            edges.append((f"{year}_{i}", str(year)))
            if i < having:
                claims.claim(f"{year}_{i}", "P1", "Q5")
    frame = spark.createDataFrame(edges, "entity_id string, group string")
    by = GroupBy(kind="year", edges=frame)
    board = Dashboard(
        frame.select("entity_id"), by, columns_from_text("P1"), row_totals=False, **options
    )
    rows = Coverage(claims.facts(spark), board).lines().collect()
    return {r.group_key: r for r in rows}


def test_years_are_rebinned_when_bins_are_too_many(spark):
    rows = year_lines(spark, {y: (2, 1) for y in range(1700, 1850, 1)}, threshold=1)
    assert {r["span"] for r in rows.values()} == {10} and len(rows) == 15
    assert all((r["count"], r["c0"]) == (20, 10) for r in rows.values())


def test_a_bin_has_the_link_of_its_start(spark):
    years = {y: (3, 0) for y in range(1500, 1600)} | {1642: (7, 2), 1649: (4, 4)}
    rows = year_lines(spark, years, threshold=1, link=link_from_text("Reports on {id}"))
    assert rows["1640/10"]["group_link"] == "Reports on 1640"
    assert (rows["1640/10"]["count"], rows["1640/10"]["c0"]) == (11, 6)


def test_years_of_the_whole_range_of_bigint(spark):
    years = {k * 10**12: (1, 1) for k in range(1, 300)} | {9 * 10**18: (1, 0), -(9 * 10**18): (1, 0)}
    rows = year_lines(spark, years, threshold=1)
    assert sum(r["count"] for r in rows.values()) == 301
    assert all(k and r["span"] for k, r in rows.items()) and len(rows) <= 100


def test_a_hundred_years_stay(spark):
    rows = year_lines(spark, {y: (1, 0) for y in range(1900, 2000)}, threshold=1)
    assert len(rows) == 100
    assert rows["1999"]["span"] == 1


def test_far_years(spark):
    years = {y: (1, 0) for y in [*range(1800, 1950), -80_000_000, -5]}
    rows = year_lines(spark, years, threshold=1)
    assert rows["-10/10"]["count"] == 1
    assert rows["-80000000/10"]["count"] == 1


def test_higher_groups_and_links(spark):
    g = Graph()
    for entity, country in (("a", "Q1"), ("b", "Q2"), ("c", "Q3")):
        g.claim(entity, "P17", country)
    g.claim("Q1", "P30", "Q21")
    g.claim("Q1", "P30", "Q20")
    g.claim("Q2", "P30", "http://www.wikidata.org/entity/Q22")
    g.claim("Q1", "P298", "AA", kind="string")
    g.claim("Q1", "P298", "AB", kind="string")
    g.label("Q1", "mul", "One")
    g.label("Q2", "mul", "Two")
    g.label("Q2", "en", "Second")
    facts = g.facts(spark)

    def rows(link):
        board = Dashboard(
            bag(spark, *"abc"),
            ITEM,
            threshold=1,
            higher=("P30",),
            link=link_from_text(link),
            row_totals=False,
        )
        found = Coverage(facts, board).lines().collect()
        return {r.group_key: (r.higher_group, r.group_link) for r in found}

    assert rows("Foo") == {
        "Q1": ("Q20", "Foo/One"),
        "Q2": ("Q22", "Foo/Second"),
        "Q3": ("", "Foo/Q3"),
    }
    assert {k: v[1] for k, v in rows("Foo/{P298}").items()} == {
        "Q1": "Foo/AA",
        "Q2": "Foo/Q2",
        "Q3": "Foo/Q3",
    }


def test_explicit_groups_restrict_groups_only(spark):
    g = Graph()
    for entity, country in (("a", "Q1"), ("b", "Q2")):
        g.claim(entity, "P17", country)
    found = lines(g.facts(spark), bag(spark, *"abc"), groups="Q1,nope")
    assert found == {(0, "Q1"): (1,), (1, "None"): (1,), (2, ""): (3,)}
    found = lines(g.facts(spark), bag(spark, *"abc"), groups="nope")
    assert len(found) == 4


def test_kinds_are_found_from_the_values(spark):
    g = Graph()
    g.claim("a", "P17", "Q1")
    g.claim("a", "P571", "x", year=1990)
    g.claim("a", "P8", "x", kind="string")
    facts = g.facts(spark)
    kinds = {r.property: r.group_kind for r in group_kinds(facts).collect()}
    assert kinds == {"P17": "item", "P571": "year", "P8": None}
    for prop, kind in (("P17", "item"), ("P571", "year")):
        board = resolve_kind(facts, Dashboard("", GroupBy((prop,))))
        assert board.group_by.kind == kind
    with pytest.raises(UnsupportedGroupingError):
        resolve_kind(facts, Dashboard("", GroupBy(("P8",))))
    with pytest.raises(EmptyGroupingError):
        resolve_kind(facts, Dashboard("", GroupBy(("P9",))))
    dated = spark.sql("select 'a' as entity_id, timestamp_ntz '1990-05-01' as `group`")
    board = resolve_kind(facts, Dashboard(bag(spark, "a"), GroupBy(edges=dated), threshold=1))
    assert Coverage(facts, board).groups().first().title == "1990"
    numbers = spark.sql("select 'a' as entity_id, 5 as `group`")
    with pytest.raises(UnsupportedGroupingError):
        resolve_kind(facts, Dashboard("", GroupBy(edges=numbers)))


def test_no_group_at_all(spark):
    facts = Graph().facts(spark)
    plan = Coverage(facts, Dashboard(bag(spark, "a"), ITEM))
    with pytest.raises(EmptyGroupingError):
        plan.checked_lines()
    assert [tuple(r)[:4] for r in plan.lines().collect()] == [("dashboard", 2, "totals", "")]
    empty = Coverage(facts, Dashboard(bag(spark), ITEM, columns_from_text("P1")))
    assert [(r["count"], r["c0"]) for r in empty.lines().collect()] == [(0, 0)]


def test_rendered_report(spark):
    g = Graph()
    for entity in "abc":
        g.claim(entity, "P17", "Q142")
    g.claim("a", "P1435", "Q5")
    board = Dashboard(
        bag(spark, *"abc"), ITEM, columns_from_text("P1435,Lbr"), threshold=2, cell_threshold=1
    )
    text = report.render(Coverage(g.facts(spark), board), "Cell").first().report
    assert text == (
        '{| class="wikitable sortable"\n'
        '! colspan="2" |Top groupings (Minimum 2 items)\n'
        '! colspan="2"|Top Properties (used at least 1 times per grouping)\n'
        "|-\n"
        "! Name\n"
        "! Count\n"
        '! data-sort-type="number"|{{Property|P1435}}\n'
        '! data-sort-type="number"|{{#language:br}}\n'
        "|-\n"
        "| {{Q|Q142}}\n"
        "| 3 \n"
        "| {{Cell|33.33|1|column=P1435|grouping=Q142}}\n"
        "| {{Cell|0|0|column=Lbr|grouping=Q142}}\n"
        '|- class="sortbottom"\n'
        "| '''Totals''' <small>(all items)</small>\n"
        "| 3 \n"
        "| {{Cell|33.33|1|column=P1435|grouping=}}\n"
        "| {{Cell|0|0|column=Lbr|grouping=}}\n"
        "|}\n"
    )


def test_facts_survive_a_round_trip(spark, tmp_path):
    facts = reference_graph().facts(spark)
    facts.write(str(tmp_path / "facts"))
    again = Facts.read(spark, str(tmp_path / "facts"))
    assert lines(again, bag(spark, *"abcdefg"), "P1/S248,P1/P2") == lines(
        facts, bag(spark, *"abcdefg"), "P1/S248,P1/P2"
    )


def test_plans_stay_on_the_jvm_without_cross_joins(spark):
    facts = reference_graph().facts(spark)
    board = Dashboard(bag(spark, "a"), ITEM, columns_from_text("P1,P1/P2,P1/S!,Lde"))
    plan = Coverage(facts, board)
    for frame in (plan._entities(), plan._counted_groups(), plan.lines()):
        text = frame._jdf.queryExecution().toString()
        assert "CartesianProduct" not in text
        assert "Python" not in text
