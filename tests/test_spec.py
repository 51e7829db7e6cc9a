import pytest

from factspan import (
    Property,
    Qualifier,
    RefCheck,
    Referenced,
    SiteLink,
    Text,
    column_from_key,
    columns_from_text,
    dashboard_from_params,
    link_from_text,
)
from factspan.spec import (
    ColumnSyntaxError,
    Dashboard,
    GroupBy,
    LinkSyntaxError,
    SpecError,
    explicit_groups,
    group_by_from_text,
    rename_params,
)

PROJECTS = {"zawiki": ("https://za.example.org/", "Q7001")}

KEYS = {
    "P21": Property("P21"),
    "P4511/P1552": Qualifier("P4511", "P1552"),
    "P1435/Q10/P580": Qualifier("P1435", "P580", "Q10"),
    "P1/?grouping/P2": Qualifier("P1", "P2", "?grouping"),
    "P21/S*": Referenced("P21"),
    "P21/S!": Referenced("P21", RefCheck("good")),
    "P21/S248": Referenced("P21", RefCheck("any_of", (("P248", None),))),
    "P21/S248=Q5": Referenced("P21", RefCheck("any_of", (("P248", "Q5"),))),
    "P21/S248;S854=Q1": Referenced(
        "P21", RefCheck("any_of", (("P248", None), ("P854", "Q1")))
    ),
    "P21/S248+S304=Q1": Referenced(
        "P21", RefCheck("all_of", (("P248", None), ("P304", "Q1")))
    ),
    "P1/Q5/S*": Referenced("P1", value="Q5"),
    "P1/?grouping/S*": Referenced("P1", value="?grouping"),
    "P1/P580/S*": Referenced("P1", qualifier="P580"),
    "P1/Q5/P580/S*": Referenced("P1", value="Q5", qualifier="P580"),
    "Lde": Text("label", "de"),
    "Dzh-hans": Text("description", "zh-hans"),
    "zawiki": SiteLink("zawiki", "https://za.example.org/", "Q7001"),
}


@pytest.mark.parametrize("key", KEYS)
def test_keys_are_read_and_written(key):
    column = column_from_key(key, projects=PROJECTS)
    assert column == KEYS[key]
    assert column.key == key


@pytest.mark.parametrize(
    "key",
    [
        "xxwiki",
        "P1/?item/P2",
        "P1/?item/S*",
        "P1/Q5/P2/P3",
        "P1/Q5/P2/P3/S*",
        "P1/Q5/Q6/S*",
        "P1/S",
        "P1/Sx",
        "P1/S248=5",
        "P1/S248;854",
        "P1/S248;S304+S5",
        "P1/S248+Sx=Q1",
    ],
)
def test_bad_keys_are_rejected(key):
    with pytest.raises(ColumnSyntaxError):
        column_from_key(key, projects=PROJECTS)


def test_headers():
    headers = {
        "P21": "{{Property|P21}}",
        "P4511/P1552": "{{Property|P1552}}",
        "P21/S*": "{{Property|P21}}📚",
        "P21/S!": "{{Property|P21}}📚✓",
        "P1/P580/S248=Q5": "{{Property|P580}}📚{{Property|P248}}={{Q|Q5}}",
        "P21/S248;S854": "{{Property|P21}}📚{{Property|P248}}/{{Property|P854}}",
        "P21/S248+S854": "{{Property|P21}}📚{{Property|P248}}+{{Property|P854}}",
        "Lde": "{{#language:de}}",
        "zawiki": "{{Q|Q7001}}",
    }
    assert {k: column_from_key(k, projects=PROJECTS).header for k in headers} == headers
    assert column_from_key("P4511/P1552", "kind").header == "[[Property:P1552|kind]]"
    assert column_from_key("zawiki", "za", PROJECTS).header == "[[Q7001|za]]"


def test_column_lists():
    columns = columns_from_text("P7937:form, P6216,,Lde")
    assert columns == [Property("P7937", "form"), Property("P6216"), Text("label", "de")]
    # More than one colon: all of it is the key.
    assert columns_from_text("P1:a:b") == [Property("P1:a:b")]


def test_repeated_keys_keep_the_last_definition_in_the_first_place():
    board = Dashboard("", GroupBy(), columns_from_text("P1:a,P2,P1:b"))
    assert board.columns == (Property("P1", "b"), Property("P2"))


def test_group_by():
    assert group_by_from_text("P17") == GroupBy(("P17",))
    assert group_by_from_text("wdt:P17/wdt:P298") == GroupBy(("P17", "P298"))
    assert group_by_from_text("schema:about") == GroupBy(kind="site")


def test_explicit_groups_drop_what_is_no_group():
    assert explicit_groups("Q1, Q2,Q1,x,Q3x", "item") == ("Q1", "Q2")
    assert explicit_groups("1995, -5,0012,x", "year") == ("1995", "12")
    assert explicit_groups("zawiki,xxwiki", "site", PROJECTS) == ("https://za.example.org/",)
    assert explicit_groups(None, "item") == ()


def test_links():
    assert link_from_text(None) is None
    assert link_from_text("Foo").template == "Foo/{Len}"
    link = link_from_text("Foo/{Lzh-hans}")
    assert (link.by, link.arg, link.placeholder) == ("label", "zh-hans", "{Lzh-hans}")
    assert link_from_text("Foo/{id}").by == "id"
    assert link_from_text("Foo/{P297}").placeholder == "{P297}"
    for bad in ("Foo/{foo}", "Foo/{Len}/{Lfr}"):
        with pytest.raises(LinkSyntaxError):
            link_from_text(bad)


PARAMS = {"selector": "select 1", "grouping_property": "P17", "properties": "P1,P2"}


def test_params_with_defaults():
    board = dashboard_from_params(PARAMS, "page")
    assert (board.threshold, board.cell_threshold, board.link) == (20, 0, None)
    assert (board.row_no_group, board.row_totals, board.link_mode) == (False, True, "link")


def test_params_given():
    board = dashboard_from_params(
        PARAMS
        | {
            "grouping_threshold": "5",
            "property_threshold": "3",
            "higher_grouping": "wdt:P30",
            "grouping_link": "Foo",
            "stats_for_no_group": "1",
            "row_totals": "0",
            "grouping_link_mode": "create",
        }
    )
    assert (board.threshold, board.cell_threshold, board.higher) == (5, 3, ("P30",))
    assert (board.row_no_group, board.row_totals, board.link_mode) == (True, False, "create")


@pytest.mark.parametrize(
    "change",
    [
        {"grouping_threshold": "many"},
        {"grouping_link_mode": "other"},
        {"properties": "nope"},
        {"grouping_link": "{a}{b}"},
    ],
)
def test_bad_params(change):
    with pytest.raises(SpecError):
        dashboard_from_params(PARAMS | change)


def test_missing_params():
    with pytest.raises(SpecError, match="selector"):
        dashboard_from_params({"grouping_property": "P17", "properties": "P1"})


def test_present_name_wins_over_deprecated_one():
    assert rename_params({"stats_for_no_group": "1"}) == {"row_no_group": "1"}
    both = {"row_no_group": "0", "stats_for_no_group": "1"}
    assert rename_params(both) == {"row_no_group": "0"}
