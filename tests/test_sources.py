import json
import random

import pytest
from pyspark.sql import functions as F

from factspan import Facts
from factspan.plans import report
from factspan.plans.batch import plan_all
from factspan.sources import bindings, pages, sinks
from factspan.spec import SpecError
from tests.graph import Graph

PAGE = """Intro text.
{{Property dashboard
| selector = select entity_id from {claims} where property = 'P50'
| grouping_link = Lists/{Lfr}
| properties = P577/S*, Dsv
| grouping_property = P495
}}
old report
{{Property dashboard end}}
Closing text.
"""


def texts(spark, *found):
    return spark.createDataFrame(
        [(i, text) for i, text in enumerate(found)], "page int, text string"
    )


def params_of(spark, text):
    found = pages.dashboard_params(texts(spark, text)).collect()
    return {r.field: r.value for r in found}


def dashboard(inside, name="Property dashboard"):
    return "{{%s%s}} x {{Property dashboard end}}" % (name, inside)


def test_params_of_a_page(spark):
    assert params_of(spark, PAGE) == {
        "selector": "select entity_id from {claims} where property = 'P50'",
        "grouping_link": "Lists/{Lfr}",
        "properties": "P577/S*, Dsv",
        "grouping_property": "P495",
    }


@pytest.mark.parametrize(
    ("inside", "wanted"),
    [
        ("|p=7|q = 8 |p= 9|=r|s|t=", {"p": "9", "q": "8", "s": "", "t": ""}),
        ("|p=u {{!}} v=w", {"p": "u | v=w"}),
        ("|p={{a|{{b|c={{d|e}}}}}}|q=1", {"p": "{{a|{{b|c={{d|e}}}}}}", "q": "1"}),
        ("|p=[[f|g{{h|i=1}}j]]|q=2", {"p": "[[f|g{{h|i=1}}j]]", "q": "2"}),
        ("<!-- note | x=1 -->|p=1<!-- | z=2 -->|q=2", {"p": "1", "q": "2"}),
        ("|p=<nowiki>k|l}}</nowiki>|q=3", {"p": "<nowiki>k|l}}</nowiki>", "q": "3"}),
        ("|p={k} ]] }|q=4", {"p": "{k} ]] }", "q": "4"}),
    ],
)
def test_params_with_anything_inside(spark, inside, wanted):
    assert params_of(spark, dashboard(inside)) == wanted


@pytest.mark.parametrize(
    "name", ["property dashboard", "Property_dashboard", " Property  dashboard ", "property_dashboard\n"]
)
def test_names_as_wikis_read_them(spark, name):
    assert params_of(spark, dashboard("|p=1", name)) == {"p": "1"}


def test_other_templates_are_not_dashboards(spark):
    assert params_of(spark, dashboard("|p=1", "Property dashboards")) == {}
    assert params_of(spark, dashboard("|p=1", "My property dashboard")) == {}


def test_pages_that_cannot_be_read_are_errors(spark):
    good, broken = dashboard("|p=1"), "{{Property dashboard|p={{x}} {{Property dashboard end}}"
    found = texts(spark, good, broken, "no dashboard", None)
    assert [r.page for r in pages.unreadable_pages(found).collect()] == [1]
    assert {r.page for r in pages.dashboard_params(found).collect()} == {0}


def test_first_dashboard_counts_and_both_markers_are_needed(spark):
    assert params_of(spark, "{{Property dashboard|p=1}}") == {}
    assert params_of(spark, "{{Property dashboard end}}") == {}
    two = "{{Property dashboard|p=3}} {{Property dashboard|p=4}}{{Property dashboard end}}"
    assert params_of(spark, two) == {"p": "3"}


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def walks(frame):
    """How often a plan cuts a page into tokens, and how often it walks over them."""
    plan = plan_of(frame)
    return plan.count("regexp_extract_all("), plan.count("aggregate(")


def test_a_page_is_read_once_for_its_params(spark):
    assert walks(pages.dashboard_params(texts(spark, dashboard("|a=1")))) == (1, 1)


def migrated(spark, text):
    return pages.migrate_texts(texts(spark, text)).first().text


@pytest.mark.parametrize(
    ("old", "new"),
    [
        ("|q=2|stats_for_no_group= 0", "|q=2|row_no_group= 0"),
        ("|q={{a|{{b|c}}}}|stats_for_no_group=0|r=1", "|q={{a|{{b|c}}}}|row_no_group=0|r=1"),
        ("|no_stats_for_no_group=0", "|no_stats_for_no_group=0"),
        ("|q=stats_for_no_group", "|q=stats_for_no_group"),
        ("|q={{a|{{b|{{c|{{d|{{e|{{f|g}}}}}}}}}}}}|stats_for_no_group=0", "|q={{a|{{b|{{c|{{d|{{e|{{f|g}}}}}}}}}}}}|row_no_group=0"),
        ("|q={{a|stats_for_no_group=1}}|<!-- old --> stats_for_no_group =2", "|q={{a|stats_for_no_group=1}}|<!-- old --> row_no_group =2"),
        ("<!-- |stats_for_no_group=1 -->|q=<nowiki>|stats_for_no_group=1</nowiki>", "<!-- |stats_for_no_group=1 -->|q=<nowiki>|stats_for_no_group=1</nowiki>"),
    ],
)
def test_migration_inside_the_template(spark, old, new):
    around = "{{Other|stats_for_no_group=5}} %s and |stats_for_no_group=6"
    assert migrated(spark, around % dashboard(old)) == around % dashboard(new)


def spliced(spark, text, report_text):
    reports = spark.createDataFrame([(0, report_text)], "page int, report string")
    return pages.splice_reports(texts(spark, text), reports, start="Property dashboard")


@pytest.mark.parametrize("link", ["Lists/{Lfr}", "a {{!}} b"])
@pytest.mark.parametrize("new", ["plain", "$0 \\2 {{x}}"])
def test_report_is_put_between_the_markers(spark, link, new):
    page = PAGE.replace("Lists/{Lfr}", link)
    wanted = page.replace("\nold report\n", f"\n{new}\n")
    assert spliced(spark, page, new).first().text == wanted
    again = page.replace("Intro", "Second")
    assert spliced(spark, page + again, new).first().text == wanted + again


@pytest.mark.parametrize(
    "opening",
    [
        "{{Property dashboard|p={{Q|5}}|q=2}}",
        "{{property dashboard\n|p=1}}",
        "{{Property_dashboard|p=[[a|b]]<!-- }} -->|q=<nowiki>}}</nowiki>}}",
        "{{Property dashboard<!-- {{Property dashboard end}} -->|p={{a|{{b|{{c|{{d|{{e|{{f}}}}}}}}}}}}}}",
        "\U0001f600 {{Property dashboard|p=\U0001f600}}",
    ],
)
def test_reports_leave_the_template_whole(spark, opening):
    page = "Head {{Q|1}} %s%s{{property_dashboard end}} tail {{Property dashboard end}}"
    assert spliced(spark, page % (opening, " old {{Q|7}} }} "), "new").first().text == page % (opening, "\nnew\n")


def test_all_dashboards_of_a_page_are_migrated(spark):
    two = "{{Property dashboard|stats_for_no_group=1}} a |stats_for_no_group=2 {{property_dashboard|x|stats_for_no_group=3}}"
    assert migrated(spark, two) == two.replace("stats_for_no_group=1", "row_no_group=1").replace(
        "stats_for_no_group=3", "row_no_group=3"
    )
    # A template that does not end is left to its reader, its parameters are renamed.
    assert migrated(spark, "{{Property dashboard|stats_for_no_group=1") == "{{Property dashboard|row_no_group=1"
    assert migrated(spark, "") == "" and migrated(spark, None) is None


def test_pages_without_markers_or_report_stay(spark):
    assert spliced(spark, "plain", "bar").first().text == "plain"
    kept = pages.splice_reports(
        texts(spark, PAGE), spark.createDataFrame([], "page int, report string")
    )
    assert kept.first().text == PAGE


def test_result_files(spark, tmp_path):
    documents = {
        "a": {
            "results": {
                "bindings": [
                    {"x": {"type": "uri", "value": "Q1"}, "n": {"type": "literal", "value": "2"}},
                    {"x": {"type": "uri", "value": "Q2"}},
                ]
            }
        },
        "b": {"results": {"bindings": []}},
        "c": {},
    }
    for name, document in documents.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(document, indent=1))
    rows = bindings.read_bindings(spark, str(tmp_path), ["x", "n"]).collect()
    assert {tuple(r) for r in rows} == {("Q1", "2"), ("Q2", None)}
    held = spark.createDataFrame([(k, json.dumps(v)) for k, v in documents.items()], "k string, t string")
    rows = bindings.parse_bindings(held, "t", ["x", "n"], ["k"]).collect()
    assert {tuple(r) for r in rows} == {("a", "Q1", "2"), ("a", "Q2", None)}


def test_one_large_result_file_is_read_by_many_tasks(spark, tmp_path):
    signs = ['}', '{', '"', '\\', '},{', '"bindings": [{', 'é', ' ', 'word', '[', ']', '\n']
    rng = random.Random(3)
    texts_ = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(400)]
    found = [
        {"x": {"type": "literal", "value": t}} | ({"n": {"type": "literal", "value": str(i)}} if i % 3 else {})
        for i, t in enumerate(texts_)
    ]
    found[7] = {}
    document = {"head": {"vars": ["x", "n"], "link": ["{"]}, "results": {"bindings": found}}
    (tmp_path / "one").write_text(json.dumps(document))
    (tmp_path / "two").write_text(json.dumps(document, indent=2, ensure_ascii=False) + "\n")
    wanted = [(b.get("x", {}).get("value"), b.get("n", {}).get("value")) for b in found] * 2
    key = lambda row: tuple(v or "" for v in row)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("257", "3000", old["spark.sql.files.maxPartitionBytes"]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            if size == "3000":
                parts = spark.read.text(str(tmp_path / "one"), lineSep="}").rdd.getNumPartitions()
                assert parts > 3
            rows = bindings.read_bindings(spark, str(tmp_path), ["x", "n"]).collect()
            assert sorted(map(tuple, rows), key=key) == sorted(wanted, key=key)
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def dashboard_page(selector, **params):
    params = {"selector": selector, "grouping_property": "P17", "properties": "P1"} | params
    body = "".join(f"|{k}={v}\n" for k, v in params.items())
    return "{{Property dashboard\n%s}}\nold\n{{Property dashboard end}}" % body


def test_batch_from_pages_to_pages(spark, tmp_path):
    g = Graph()
    for entity in "abc":
        g.claim(entity, "P17", "Q1")
    g.claim("a", "P1", "Q5")
    g.claim("a", "P571", "x", year=1990)
    everyone = "select distinct entity_id from {claims} where property = 'P17'"
    found = texts(
        spark,
        dashboard_page(everyone, grouping_threshold="1"),
        dashboard_page(everyone, properties="nope"),
        dashboard_page("select nothing from {claims}"),
        dashboard_page(everyone, grouping_threshold="4"),
        dashboard_page(everyone, grouping_property="P571", grouping_threshold="1"),
        dashboard_page(everyone, grouping_property="P99"),
        "no dashboard",
    )
    facts = g.facts(spark)
    params = pages.rename_params(pages.dashboard_params(found))
    boards, errors = pages.load_dashboards(params)
    batch = plan_all(facts, boards, errors)
    errors = {r.dashboard: r.error for r in batch.errors.collect()}
    assert set(errors) == {"1", "2", "3", "5"}
    assert errors["3"] == "no groups found"
    lines = {(r.dashboard, r.group_key): r["count"] for r in batch.lines().collect()}
    assert lines == {("0", "Q1"): 3, ("0", ""): 3, ("4", "1990"): 1, ("4", ""): 3}
    reports = report.render(batch.coverage).withColumnRenamed("dashboard", "page")
    done = pages.splice_reports(found, reports.withColumn("page", F.col("page").cast("int")))
    after = {r.page: r.text for r in done.collect()}
    assert "| {{Q|Q1}}" in after[0] and "\nold\n" not in after[0]
    assert after[1] == found.filter("page = 1").first().text
    sinks.write_report(batch.lines(), str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report")).count() == 4


def test_batch_without_a_valid_dashboard(spark):
    batch = plan_all(Graph().facts(spark), [])
    with pytest.raises(SpecError):
        batch.lines()


def test_registry_is_deduplicated(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "page string, site int")
    assert pages.unique_pages(rows, ["page", "site"]).count() == 2


def test_projects_are_a_dimension(spark):
    facts = Facts.from_rows(spark, projects=[("brwiki", "u", "Q1")])
    assert facts.project_table() == {"brwiki": ("u", "Q1")}
