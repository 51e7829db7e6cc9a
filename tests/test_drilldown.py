import pytest

from factspan import Dashboard, GroupBy, columns_from_text
from factspan.operators.selection import with_labels
from factspan.plans.drilldown import DrillDown, Row, row_from_key
from factspan.plans.lists import groups_to_list, list_fields, member_lists
from tests.graph import Graph, bag
from tests.test_coverage import ITEM, reference_graph


def rows(frame, *names):
    return {tuple(r[n] for n in names) for r in frame.select(*names).collect()}


def drill(facts, selector, columns, by=ITEM):
    return DrillDown(facts, Dashboard(selector, by, columns_from_text(columns)))


def test_row_keys():
    years = Dashboard("", GroupBy(("P1",), "year"))
    assert row_from_key(years, "1950/10") == Row("year", "1950", 10)
    assert row_from_key(years, "-10/10") == Row("year", "-10", 10)
    assert row_from_key(years, "None") == Row("none")
    assert row_from_key(years, "") == Row("totals")
    assert row_from_key(years, "UNKNOWN_VALUE") == Row("unknown")
    assert row_from_key(Dashboard("", ITEM), "Q1") == Row("item", "Q1")


def test_property_lists_overlap_for_deprecated_statements(spark):
    g = Graph()
    for entity in "abc":
        g.claim(entity, "P17", "Q1")
    g.claim("a", "P1", "Q5", rank="deprecated")
    g.claim("b", "P1", snak="novalue")
    g.label("a", "mul", "A")
    g.label("Q5", "en", "five")
    d = drill(g.facts(spark), bag(spark, "a", "a", "b", "c", "x"), "P1")
    found = rows(d.positive("P1", "Q1"), "entity_id", "entity_label", "value", "value_label")
    assert found == {("a", "A", "Q5", "five"), ("b", None, None, None)}
    assert rows(d.negative("P1", "Q1"), "entity_id") == {("a",), ("c",)}


def test_qualifier_lists_leave_a_gap_for_no_value(spark):
    g = Graph()
    for entity in "abcd":
        g.claim(entity, "P17", "Q1")
    g.claim("a", "P1", "Q5", quals=[("P2", "x")])
    g.claim("b", "P1", "Q5", quals=[("P2", None)])
    g.claim("c", "P1", snak="novalue", quals=[("P2", "x")])
    d = drill(g.facts(spark), bag(spark, *"abcd"), "P1/P2,P1/Q5/P2,P1/?grouping/P2")
    found = rows(d.positive("P1/P2", "Q1"), "entity_id", "value", "snak_type")
    assert found == {("a", "x", "value"), ("b", None, "novalue"), ("c", "x", "value")}
    assert rows(d.negative("P1/P2", "Q1"), "entity_id") == {("d",)}
    assert rows(d.positive("P1/Q5/P2", "Q1"), "entity_id") == {("a",), ("b",)}
    # No statement has the group as its value, but in the totals any value fits.
    assert rows(d.positive("P1/?grouping/P2", "Q1"), "entity_id") == set()
    assert len(rows(d.negative("P1/?grouping/P2", "Q1"), "entity_id")) == 4
    assert rows(d.positive("P1/?grouping/P2", ""), "entity_id") == {("a",), ("b",)}


def test_columns_tied_to_an_unknown_group(spark):
    g = Graph()
    unknown = "http://www.wikidata.org/.well-known/genid/1"
    g.claim("a", "P17", snak="somevalue", value=unknown)
    g.claim("b", "P17", snak="somevalue")
    g.claim("a", "P1", snak="somevalue", value=unknown, quals=[("P2", "x")], refs=[[]])
    g.claim("b", "P1", "Q5", quals=[("P2", "x")], refs=[[]])
    keys = "P1/?grouping/P2,P1/?grouping/S*"
    d = drill(g.facts(spark), bag(spark, "a", "b"), keys)
    for key in keys.split(","):
        assert rows(d.positive(key, "UNKNOWN_VALUE"), "entity_id") == {("a",)}
        assert rows(d.negative(key, "UNKNOWN_VALUE"), "entity_id") == {("b",)}


def test_members_of_each_kind_of_row(spark):
    g = Graph()
    for entity, year in (("a", 1990), ("b", 1995), ("c", -5)):
        g.claim(entity, "P571", str(year), year=year)
    g.claim("d", "P17", "Q1")
    g.claim("e", "P17", snak="somevalue")
    g.link("a", "https://br.example.org/")
    facts, everyone = g.facts(spark), bag(spark, *"abcdef")

    def members(by, key):
        found = DrillDown(facts, Dashboard(everyone, by)).members(key)
        return "".join(sorted(r.entity_id for r in found.collect()))

    year, site = GroupBy(("P571",), "year"), GroupBy(kind="site")
    assert members(year, "1990") == "a"
    assert members(year, "1990/10") == "ab"
    assert members(year, "-10/10") == "c"
    assert members(year, "None") == "def"
    assert members(ITEM, "Q1") == "d"
    assert members(ITEM, "UNKNOWN_VALUE") == "e"
    assert members(ITEM, "") == "abcdef"
    assert members(site, "https://br.example.org/") == "a"
    assert members(site, "None") == "bcdef"


def test_reference_lists(spark):
    d = drill(reference_graph().facts(spark), bag(spark, *"abcdefg"), "P1/S*,P1/S248,P1/Q5/S*")
    assert rows(d.positive("P1/S*", "Q1"), "entity_id") == {(e,) for e in "abcf"}
    assert rows(d.negative("P1/S*", "Q1"), "entity_id", "value") == {
        ("d", "Q5"),
        ("d", "Q6"),
        ("e", None),
    }
    assert rows(d.negative("P1/Q5/S*", "Q1"), "entity_id", "value") == {
        ("e", None),
        ("f", None),
        ("g", None),
    }
    assert rows(d.positive("P1/S248", "Q1"), "entity_id", "ref_value") == {
        ("a", "Q7"),
        ("b", "Q7"),
        ("f", "Q7"),
    }


@pytest.mark.parametrize(
    ("snaks", "shown"),
    [
        ([], {(None, None)}),
        ([("P854", "u"), ("P248", "Q1"), ("P9", "x")], {("P248", "Q1")}),
        ([("P854", "u"), ("P9", "x")], {("P854", "u")}),
        ([("P9", "x"), ("P10", "y"), ("P813", "t")], {("P9", "x"), ("P10", "y")}),
        ([("P813", "t")], {("P813", "t")}),
    ],
)
def test_most_telling_reference(spark, snaks, shown):
    g = Graph()
    g.claim("a", "P1", "Q5", refs=[snaks])
    found = drill(g.facts(spark), bag(spark, "a"), "P1/S*").positive("P1/S*", "")
    assert rows(found, "ref_property", "ref_value") == shown


def test_shown_values_of_any_and_all(spark):
    g = Graph()
    g.claim("a", "P1", "Q5", refs=[[("P248", "Q1"), ("P304", "9")], [("P304", "8")], []])
    keys = "P1/S248;S304,P1/S248+S304,P1/S248=Q1;S304=Q2"
    d = drill(g.facts(spark), bag(spark, "a"), keys)
    assert rows(d.positive("P1/S248;S304", ""), "ref_value") == {("Q1",), ("8",), (None,)}
    assert rows(d.positive("P1/S248+S304", ""), "ref_P248", "ref_P304") == {("Q1", "9")}
    fixed = d.positive("P1/S248=Q1;S304=Q2", "")
    assert fixed.columns == ["entity_id", "entity_label", "value", "value_label"]


def lists_graph():
    g = Graph()
    for entity, country in (("a", "Q1"), ("b", "Q1"), ("c", "Q2")):
        g.claim(entity, "P17", country)
    g.claim("a", "P1", "Q5", quals=[("P2", "x")])
    g.claim("a", "P1", "Q6")
    g.label("a", "en", "A")
    g.label("b", "de", "text", kind="description")
    return g


def test_list_fields():
    board = Dashboard("", ITEM, columns_from_text("P21,Dde,Lde,P1/S*,P21/P2"))
    assert list_fields(board) == ["label/de", "description/de", "P21", "P1", "P21/P2"]
    assert list_fields(Dashboard("", ITEM, columns_from_text("P136"))) == ["label", "P136"]


def test_member_lists(spark):
    board = Dashboard(bag(spark, *"abc"), ITEM, columns_from_text("P1/S*,P1/P2,Dde"))
    groups = spark.createDataFrame([("Q1",)], "group_key string")
    found = member_lists(lists_graph().facts(spark), board, groups)
    assert rows(found, "group_key", "entity_id", "position", "field", "value") == {
        ("Q1", "a", 0, "label", "A"),
        ("Q1", "a", 1, "description/de", None),
        ("Q1", "a", 2, "P1", "Q5"),
        ("Q1", "a", 2, "P1", "Q6"),
        ("Q1", "a", 3, "P1/P2", "x"),
        ("Q1", "b", 0, "label", None),
        ("Q1", "b", 1, "description/de", "text"),
        ("Q1", "b", 2, "P1", None),
        ("Q1", "b", 3, "P1/P2", None),
    }


def test_member_lists_of_year_bins(spark):
    g = Graph()
    for entity, year in (("a", 1990), ("b", 1995), ("c", -5)):
        g.claim(entity, "P571", str(year), year=year)
    board = Dashboard(bag(spark, *"abc"), GroupBy(("P571",), "year"))
    groups = spark.createDataFrame([("1990/10", 10)], "group_key string, span bigint")
    found = member_lists(g.facts(spark), board, groups)
    assert rows(found, "group_key", "entity_id") == {("1990/10", "a"), ("1990/10", "b")}


def test_which_groups_are_listed(spark):
    lines = spark.createDataFrame(
        [
            ("d", 0, "item", "Q1", "Foo/1", 9),
            ("d", 0, "item", "Q2", "Foo/2", 8),
            ("d", 0, "item", "Q3", "https://x.org/3", 7),
            ("d", 0, "item", "Q4", None, 6),
            ("d", 0, "item", "Q5", ":en:Foo/5", 5),
            ("d", 0, "item", "Q6", "Foo/6", 4),
            ("d", 0, "unknown", "UNKNOWN_VALUE", "Foo/U", 10),
            ("d", 2, "totals", "", "Foo/T", 30),
            ("e", 0, "item", "Q6", "Foo/6", 4),
        ],
        "dashboard string, section int, kind string, group_key string, group_link string, "
        "count bigint",
    )
    pages = spark.createDataFrame([("Foo/2",)], "title string")
    found = rows(groups_to_list(lines, pages, [":en:"]), "dashboard", "group_key")
    assert found == {("d", "Q1"), ("e", "Q6")}
    found = rows(groups_to_list(lines, pages), "dashboard", "group_key")
    assert found == {
        ("d", "Q1"),
        ("d", "Q5"),
        ("d", "Q6"),
        ("d", "UNKNOWN_VALUE"),
        ("e", "Q6"),
    }


def test_equal_rows_stay_when_labelled(spark):
    g = Graph()
    g.label("a", "en", "A")
    rows = spark.createDataFrame([("a", "b"), ("a", "b"), (None, "a")], "entity_id string, value string")
    found = with_labels(rows, g.facts(spark), ["entity_id", "value"])
    assert found.columns == ["entity_id", "entity_label", "value", "value_label"]
    assert sorted(map(tuple, found.collect()), key=repr) == [
        ("a", "A", "b", None), ("a", "A", "b", None), (None, None, "a", "A"),
    ]


def test_judged_statements_are_written_once(spark):
    g = Graph()
    g.claim("a", "P1", "Q5", refs=[[("P248", "x")]])
    d = drill(g.facts(spark), bag(spark, "a"), "P1/S!")
    judged = d._statements(d._column("P1/S!"), d.row(""))
    assert "Join" not in judged._jdf.queryExecution().optimizedPlan().toString()
    assert rows(d.positive("P1/S!", ""), "entity_id", "ref_value") == {("a", "x")}
