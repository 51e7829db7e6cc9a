"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan import Dashboard, Facts, GroupBy, columns_from_text, link_from_text
from factspan.facts import ENTITY_PREFIX
from factspan.functions import markup
from factspan.functions.values import strip_prefix, year_bin
from factspan.operators.grouping import group_kinds
from factspan.operators.selection import (
    class_closure,
    entities_of_class,
    labels,
    select_entities,
    truthy,
)
from factspan.operators.tables import shared_folder
from factspan.plans import report
from factspan.plans.batch import plan_all
from factspan.plans.coverage import Coverage
from factspan.plans.drilldown import DrillDown
from factspan.plans.fleet import Fleet
from factspan.plans.lists import groups_to_list, member_lists
from factspan.plans.output import with_places
from factspan.sources import bindings, pages
from factspan.spec import dashboard_from_params
from workload.star import run_view, selection, star_facts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HOME = GroupBy(("P3",), "item")
YEARS = GroupBy(("P4",), "year")
WIDE_YEARS = GroupBy(("P10",), "year")
SITES = GroupBy(kind="site")


def query(function: Query) -> Query:
    """Register a query under its name; a trailing underscore only avoids a clash."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def by_home(spark: SparkSession, sf_dir: str, columns: str = "", **options) -> Dashboard:
    """Orders by the nation of their customer."""
    given = {"group_by": HOME, "threshold": 1} | options
    return Dashboard(
        selection(spark, sf_dir, "orders"), columns=columns_from_text(columns), **given
    )


def by_source(spark: SparkSession, sf_dir: str, facts: Facts, columns: str) -> Dashboard:
    """Documents by their source: the edge is in the table already."""
    edges = run_view(
        spark,
        sf_dir,
        "select 'd' || cast(doc_id as varchar(20)) as entity_id, source as `group` "
        "from {documents}",
    )
    return Dashboard(
        selection(spark, sf_dir, "documents"),
        GroupBy(kind="item", edges=edges),
        columns_from_text(columns, facts.project_table()),
        threshold=1,
    )


def by_site(spark: SparkSession, sf_dir: str, facts: Facts, columns: str = "", **options):
    return Dashboard(
        selection(spark, sf_dir, "documents"),
        SITES,
        columns_from_text(columns, facts.project_table()),
        threshold=1,
        **options,
    )


def counts(lines: DataFrame, **cells: str) -> DataFrame:
    """Report rows with readable names for the cells."""
    named = [F.col(f"c{i}").alias(name) for i, name in enumerate(cells)]
    return lines.select("section", "group_key", "count", *named)


# Selection


@query
def select_entities_(spark, sf_dir):
    return select_entities(star_facts(spark, sf_dir), selection(spark, sf_dir, "big_lines"))


@query
def select_entities_sql(spark, sf_dir):
    text = "select entity_id from {claims} where property = 'P3' and value = 'Q7'"
    return select_entities(star_facts(spark, sf_dir), text)


@query
def select_by_path(spark, sf_dir):
    """Orders of customers below c3, once for each way to it."""
    return select_entities(star_facts(spark, sf_dir), "wdt:P11/wdt:P6* wd:c3")


@query
def select_by_path_choice(spark, sf_dir):
    """Orders that go to nation 7 or come from a customer there, with any supplier."""
    return select_entities(star_facts(spark, sf_dir), "P3|P11/P7 Q7 ; P1/P5? []")


@query
def detect_group_type_selected(spark, sf_dir):
    """One property has dates for customers and items for orders; each selection has its kind."""
    facts = star_facts(spark, sf_dir)
    prop = F.when(F.col("property").isin("P3", "P4"), "P20").otherwise(F.col("property"))
    facts = replace(facts, claims=facts.claims.withColumn("property", prop))
    both = "select entity_id from {claims} where property = 'P20'"
    selectors = {
        "orders": selection(spark, sf_dir, "orders"),
        "customers": selection(spark, sf_dir, "customers"),
        "both": both,
        "nations": "P5 []",
    }
    boards = [Dashboard(s, GroupBy(("P20",)), name=name) for name, s in selectors.items()]
    return Fleet(facts, boards).kinds().select("dashboard", "kind")


@query
def class_closure_set(spark, sf_dir):
    """Customers below c1 in the tree of customers."""
    return class_closure(star_facts(spark, sf_dir), "c1", "P6")


@query
def class_closure_(spark, sf_dir):
    """Orders of customers below c3."""
    return entities_of_class(star_facts(spark, sf_dir), "c3", "P11", "P6")


@query
def truthy_values(spark, sf_dir):
    rows = truthy(star_facts(spark, sf_dir), ["P1"])
    return rows.select("entity_id", "statement_id", "rank", "snak_type", "value")


@query
def strip_prefix_(spark, sf_dir):
    claims = star_facts(spark, sf_dir).claims.filter("property = 'P3'")
    iri = F.concat(F.lit(ENTITY_PREFIX), "value")
    return claims.select("entity_id", strip_prefix(iri, ENTITY_PREFIX).alias("local_id"))


@query
def label_fallback(spark, sf_dir):
    return labels(star_facts(spark, sf_dir), "en")


@query
def detect_group_type(spark, sf_dir):
    return group_kinds(star_facts(spark, sf_dir))


@query
def year_bin_floor(spark, sf_dir):
    claims = star_facts(spark, sf_dir).claims.filter("property = 'P10'")
    binned = claims.select(year_bin(F.col("time_year"), 10).cast("bigint").alias("start"))
    return binned.groupBy("start").agg(F.count(F.lit(1)).alias("count"))


# Grouping


@query
def group_counts(spark, sf_dir):
    plan = Coverage(
        star_facts(spark, sf_dir), by_home(spark, sf_dir, threshold=450, row_totals=False)
    )
    return counts(plan.lines())


@query
def group_counts_sitelink(spark, sf_dir):
    facts = star_facts(spark, sf_dir)
    return counts(Coverage(facts, by_site(spark, sf_dir, facts)).lines())


@query
def path_grouping(spark, sf_dir):
    by = GroupBy(("P3", "P5"), "item")
    plan = Coverage(
        star_facts(spark, sf_dir), by_home(spark, sf_dir, "P1", group_by=by, row_no_group=True)
    )
    return counts(plan.lines(), has_p1="")


@query
def explicit_groups(spark, sf_dir):
    named = "Q1, Q2,Q3,Q3,foo,17"
    plan = Coverage(
        star_facts(spark, sf_dir),
        by_home(spark, sf_dir, "P1", groups=named, row_no_group=True),
    )
    return counts(plan.lines(), has_p1="")


@query
def sitelink_project_lookup(spark, sf_dir):
    facts = star_facts(spark, sf_dir)
    board = by_site(spark, sf_dir, facts, "frwiki", groups="frwiki, dewiki,xxwiki")
    return counts(Coverage(facts, board).lines(), has_fr="")


@query
def unknown_fold(spark, sf_dir):
    by = GroupBy(("P9",), "item")
    plan = Coverage(star_facts(spark, sf_dir), by_home(spark, sf_dir, "P1/S*", group_by=by))
    return counts(plan.lines(), sourced="")


@query
def unknown_fold_many(spark, sf_dir):
    """More unknown groups than any report lists: each unknown value is one."""
    by = GroupBy(("P1",), "item")
    plan = Coverage(star_facts(spark, sf_dir), by_home(spark, sf_dir, "P1/S*", group_by=by))
    return counts(plan.lines(), sourced="")


@query
def year_groups(spark, sf_dir):
    board = Dashboard(selection(spark, sf_dir, "customers"), YEARS, columns_from_text("P7,P4"))
    return counts(Coverage(star_facts(spark, sf_dir), board).lines(), has_p7="", has_p4="")


@query
def year_rebin(spark, sf_dir):
    board = by_home(
        spark, sf_dir, "P1/S248", group_by=WIDE_YEARS, link=link_from_text("Years/{id}")
    )
    lines = Coverage(star_facts(spark, sf_dir), board).lines()
    return lines.select(
        "section", "group_key", "span", "group_link", "count", F.col("c0").alias("sourced")
    )


@query
def top_groups(spark, sf_dir):
    plan = Coverage(
        star_facts(spark, sf_dir), by_home(spark, sf_dir, limit=10, row_totals=False)
    )
    return counts(plan.lines())


@query
def group_decorate(spark, sf_dir):
    plan = Coverage(
        star_facts(spark, sf_dir), by_home(spark, sf_dir, higher=("P5",), row_totals=False)
    )
    return plan.lines().select("group_key", "higher_group", "count")


def _links(spark, sf_dir, template: str) -> DataFrame:
    board = by_home(spark, sf_dir, link=link_from_text(template), row_totals=False)
    lines = Coverage(star_facts(spark, sf_dir), board).lines()
    return lines.select("group_key", "group_link", "count")


@query
def group_link_id(spark, sf_dir):
    return _links(spark, sf_dir, "Lists/{id}")


@query
def group_link_label(spark, sf_dir):
    return _links(spark, sf_dir, "Lists")


@query
def group_link_property(spark, sf_dir):
    return _links(spark, sf_dir, "Lists/{P8}")


# Coverage, one column kind each


def _coverage_query(name: str, key: str) -> None:
    def run(spark, sf_dir):
        board = by_home(spark, sf_dir, key, threshold=20, row_no_group=True)
        return counts(Coverage(star_facts(spark, sf_dir), board).lines(), has="")

    run.__doc__ = f"Orders by nation, column {key}."
    QUERIES[name] = run


COVERAGE_KEYS = {
    "coverage_property": "P1",
    "coverage_qualifier": "P1/P2",
    "coverage_qualifier_value": "P1/Q5/P2",
    "coverage_qualifier_group_value": "P1/?grouping/P2",
    "coverage_ref_any": "P1/S*",
    "coverage_ref_good": "P1/S!",
    "coverage_ref_property": "P1/S248",
    "coverage_ref_property_value": "P1/S248=Q82",
    "coverage_ref_any_of": "P1/S248=Q82;S854=Q70",
    "coverage_ref_all_of": "P1/S248=Q82+S854=Q70",
    "coverage_ref_scoped_value": "P1/Q5/S*",
    "coverage_ref_scoped_qualifier": "P1/P2/S*",
    "coverage_ref_scoped_both": "P1/Q5/P2/S248",
    "coverage_ref_scoped_group": "P1/?grouping/S*",
}
for _name, _key in COVERAGE_KEYS.items():
    _coverage_query(_name, _key)


def _document_coverage(name: str, key: str) -> None:
    def run(spark, sf_dir):
        facts = star_facts(spark, sf_dir)
        plan = Coverage(facts, by_source(spark, sf_dir, facts, key))
        return counts(plan.lines(), has="")

    run.__doc__ = f"Documents by source, column {key}."
    QUERIES[name] = run


DOCUMENT_KEYS = {
    "coverage_label": "Len",
    "coverage_description": "Dde",
    "coverage_sitelink": "frwiki",
}
for _name, _key in DOCUMENT_KEYS.items():
    _document_coverage(_name, _key)


@query
def label_coverage(spark, sf_dir):
    """Exact languages, no fallback, over documents by site."""
    facts = star_facts(spark, sf_dir)
    board = by_site(spark, sf_dir, facts, "Len,Lfr,Lmul", row_no_group=True)
    return counts(Coverage(facts, board).lines(), en="", fr="", mul="")


@query
def totals(spark, sf_dir):
    """The bag is counted, not the distinct entities."""
    board = Dashboard(selection(spark, sf_dir, "big_lines"), HOME)
    return counts(Coverage(star_facts(spark, sf_dir), board).sums().withColumn("group_key", F.lit("")))


@query
def totals_by_column(spark, sf_dir):
    board = Dashboard(
        selection(spark, sf_dir, "big_lines"), HOME, columns_from_text("P1,P1/P2,P1/S248")
    )
    sums = Coverage(star_facts(spark, sf_dir), board).sums()
    return counts(sums.withColumn("group_key", F.lit("")), has_p1="", taxed="", sourced="")


def _no_group(spark, sf_dir, columns: str) -> DataFrame:
    board = Dashboard(
        selection(spark, sf_dir, "big_lines"),
        HOME,
        columns_from_text(columns),
        row_no_group=True,
        row_totals=False,
    )
    sums = Coverage(star_facts(spark, sf_dir), board).sums()
    return sums.withColumn("group_key", F.lit("None"))


@query
def no_group_total(spark, sf_dir):
    return counts(_no_group(spark, sf_dir, ""))


@query
def no_group_by_column(spark, sf_dir):
    rows = _no_group(spark, sf_dir, "P1,P1/P2,P1/S248")
    return counts(rows, has_p1="", taxed="", sourced="")


# Reports

REPORT_COLUMNS = "P1:Supplier,P1/P2,P1/S*,P1/S248"


def report_plan(spark, sf_dir) -> Coverage:
    board = by_home(
        spark,
        sf_dir,
        REPORT_COLUMNS,
        threshold=20,
        row_no_group=True,
        higher=("P5",),
        link=link_from_text("Lists"),
    )
    return Coverage(star_facts(spark, sf_dir), board)


@query
def coverage_report_long(spark, sf_dir):
    return report.long_report(report_plan(spark, sf_dir))


@query
def coverage_report_wide(spark, sf_dir):
    return report.wide_report(report_plan(spark, sf_dir))


@query
def report_order(spark, sf_dir):
    lines = report_plan(spark, sf_dir).lines()
    rows = with_places(lines, "dashboard", ["section", F.col("count").desc(), "group_key"])
    return rows.select(F.col("place").cast("int").alias("place"), "section", "group_key", "count")


@query
def report_text_lines(spark, sf_dir):
    """The report's text line by line, in order, of any length."""
    plan = report_plan(spark, sf_dir)
    return Fleet(plan.facts, plan.dashboards).texts()


@query
def render_report(spark, sf_dir):
    return report.render(report_plan(spark, sf_dir))


@query
def row_heading(spark, sf_dir):
    """Headings of bins of several widths, from a wide range of years."""
    claims = star_facts(spark, sf_dir).claims.filter("property = 'P10'")
    years = claims.select("time_year").distinct()
    spans = F.array(*[F.lit(10**k).cast("bigint") for k in (0, 1, 2, 4, 6, 7)])
    rows = years.withColumn("span", F.explode(spans))
    scaled = rows.select("span", (F.col("time_year") * 1000 * F.col("span")).alias("wide_year"))
    scaled = scaled.union(rows.select("span", (F.col("time_year") * F.col("span"))))
    heading = markup.row_heading(
        F.lit("year"), F.col("wide_year").cast("string"), F.col("span")
    )
    return scaled.distinct().select("wide_year", "span", heading.alias("heading"))


@query
def higher_group_class(spark, sf_dir):
    """Nation values as item, image and plain text."""
    claims = star_facts(spark, sf_dir).claims.filter("property = 'P3'")
    number = F.substring("value", 2, 10).cast("int")
    value = (
        F.when(number % 3 == 0, F.col("value"))
        .when(number % 3 == 1, F.concat(F.lit(markup.IMAGE_PREFIX), "value"))
        .otherwise(F.concat(F.lit("land "), "value"))
    )
    rows = claims.select("entity_id", value.alias("higher"))
    return rows.select(
        "entity_id",
        markup.higher_group_class(F.col("higher")).alias("higher_class"),
        markup.higher_group_cell(F.lit("item"), F.col("higher")).alias("cell"),
    )


@query
def count_cell(spark, sf_dir):
    template = "Lists/{id}"
    board = by_home(spark, sf_dir, link=link_from_text(template), row_no_group=True)
    lines = Coverage(star_facts(spark, sf_dir), board).lines()
    link = F.when(F.col("count") % 2 == 0, F.col("group_link")).otherwise(
        F.concat(F.lit("https://lists.example.org/"), "group_key")
    )
    cell = markup.count_cell(F.col("kind"), link, F.col("count"))
    return lines.select("section", "group_key", cell.alias("cell"))


_EVERY = "select distinct entity_id from {claims} where property = '%s'"
BATCH_PARAMS = {
    "orders": {
        "selector": _EVERY % "P9",
        "grouping_property": "P3",
        "properties": "P1,P1/P2",
        "stats_for_no_group": "1",
        "grouping_threshold": "100",
    },
    "customers": {
        "selector": _EVERY % "P4",
        "grouping_property": "P4",
        "properties": "P7",
    },
    "supplied": {
        "selector": "select entity_id from {claims} where property = 'P1'",
        "grouping_property": "P3",
        "properties": "P1/S248,P1",
        "grouping_threshold": "20",
    },
    "no values": {
        "selector": _EVERY % "P1",
        "grouping_property": "P99",
        "properties": "P1",
    },
    "no groups": {
        "selector": _EVERY % "P7",
        "grouping_property": "P3",
        "properties": "P1",
    },
}


@query
def multi_dashboard_report(spark, sf_dir):
    """Three dashboards of different selections and groupings, and two bad ones."""
    facts = star_facts(spark, sf_dir)
    batch = multi_dashboards(spark, sf_dir, facts)
    lines = report.long_report(batch.coverage, batch.lines())
    return lines.select(
        "dashboard", "section", "group_key", "count", "column_key", "column_count", "percent"
    )


@query
def multi_dashboard_errors(spark, sf_dir):
    return multi_dashboards(spark, sf_dir, star_facts(spark, sf_dir)).errors


@query
def dashboards_as_data(spark, sf_dir):
    """The same dashboards, and one with a path selector, in the plan of settings as tables."""
    lines = many_dashboards(spark, sf_dir).long_report()
    return lines.select(
        "dashboard", "section", "group_key", "count", "column_key", "column_count", "percent"
    )


@query
def dashboard_outcomes(spark, sf_dir):
    """How each dashboard fared, with one whose selector fails."""
    found = many_dashboards(spark, sf_dir).outcomes()
    error = F.when(F.col("outcome") == "failed", "failed").otherwise(F.col("error"))
    return found.select("dashboard", "outcome", error.alias("error"), "groups")


def many_dashboards(spark, sf_dir) -> Fleet:
    more = {
        "tree": {
            "selector": "wdt:P11/wdt:P6* wd:c3",
            "grouping_property": "P3",
            "properties": "P1/S!,P1/?grouping/P2",
            "grouping_threshold": "2",
            "row_no_group": "1",
        },
        "broken": {
            "selector": "select no_such_column from {claims}",
            "grouping_property": "P3",
            "properties": "P1",
        },
    }
    params = BATCH_PARAMS | more
    boards = [dashboard_from_params(p, name) for name, p in params.items()]
    return Fleet(star_facts(spark, sf_dir), boards)


def multi_dashboards(spark, sf_dir, facts):
    return plan_all(facts, [dashboard_from_params(p, name) for name, p in BATCH_PARAMS.items()])




# Drill-downs


def _drill(name: str, board, column: str, key: str, positive: bool) -> None:
    def run(spark, sf_dir):
        facts = star_facts(spark, sf_dir)
        drill = DrillDown(facts, board(spark, sf_dir, facts, column))
        return (drill.positive if positive else drill.negative)(column, key)

    run.__doc__ = f"{'Has' if positive else 'Lacks'} {column} in row {key!r}."
    QUERIES[name] = run


def _orders(spark, sf_dir, facts, column):
    return by_home(spark, sf_dir, column)


def _unknown(spark, sf_dir, facts, column):
    return by_home(spark, sf_dir, column, group_by=GroupBy(("P9",), "item"))


def _customers(spark, sf_dir, facts, column):
    return Dashboard(selection(spark, sf_dir, "customers"), YEARS, columns_from_text(column))


def _unknown_years(spark, sf_dir, facts, column):
    by = GroupBy(("P12",), "year")
    return Dashboard(selection(spark, sf_dir, "orders"), by, columns_from_text(column))


DRILLS = {
    "drill_positive_property": (_orders, "P1", "Q7", True),
    "missing_property": (_orders, "P1", "", False),
    "drill_positive_qualifier": (_orders, "P1/P2", "Q7", True),
    "drill_negative_qualifier": (_orders, "P1/P2", "Q7", False),
    "drill_positive_qualifier_group": (_orders, "P1/?grouping/P2", "Q7", True),
    "drill_negative_qualifier_group": (_orders, "P1/?grouping/P2", "Q7", False),
    "drill_reference_priority": (_orders, "P1/S*", "Q7", True),
    "drill_reference_good": (_orders, "P1/S!", "", True),
    "drill_reference_property": (_orders, "P1/S248", "Q7", True),
    "drill_reference_any_of": (_orders, "P1/S854;S248", "Q7", True),
    "drill_reference_all_of": (_orders, "P1/S248+S854", "", True),
    "drill_negative_reference": (_orders, "P1/S248", "Q7", False),
    "drill_negative_reference_scoped": (_orders, "P1/P2/S*", "Q7", False),
    "drill_unknown_group": (_unknown, "P1", "UNKNOWN_VALUE", True),
    "drill_unknown_group_negative": (_unknown, "P1/S*", "UNKNOWN_VALUE", False),
    "drill_unknown_year": (_unknown_years, "P1", "UNKNOWN_VALUE", True),
    "drill_unknown_year_negative": (_unknown_years, "P1/S*", "UNKNOWN_VALUE", False),
    "drill_no_group": (_orders, "P1", "None", True),
    "drill_totals": (_orders, "P1", "", True),
    "drill_year_span": (_customers, "P7", "1990/10", True),
    "drill_positive_label": (by_site, "Lfr", "https://fr.example.org/", True),
    "drill_positive_description": (by_site, "Den", "", True),
    "drill_sitelink_group": (by_site, "enwiki", "https://en.example.org/", True),
    "missing_label": (by_site, "Len", "", False),
    "missing_description": (by_site, "Dde", "", False),
    "missing_sitelink": (by_site, "frwiki", "", False),
}
for _name, _drilled in DRILLS.items():
    _drill(_name, *_drilled)


# Member lists


def _linked_plan(spark, sf_dir, columns: str) -> Coverage:
    board = by_home(spark, sf_dir, columns, link=link_from_text("Lists"), row_totals=False)
    return Coverage(star_facts(spark, sf_dir), board)


def _existing_lists(spark, sf_dir) -> DataFrame:
    return run_view(
        spark,
        sf_dir,
        "select 'Lists/' || n_name as title from {nation} where n_nationkey % 5 = 0",
    )


def _groups_without_page(spark, sf_dir, plan: Coverage) -> DataFrame:
    """Pages exist for every fifth nation; links to nations 24 lie on another site."""
    existing = _existing_lists(spark, sf_dir)
    return groups_to_list(plan.lines(), existing, ["Lists/NATION_24"])


@query
def member_lists_missing(spark, sf_dir):
    groups = _groups_without_page(spark, sf_dir, _linked_plan(spark, sf_dir, ""))
    return groups.select("group_key", "group_link", "count")


@query
def member_lists_(spark, sf_dir):
    plan = _linked_plan(spark, sf_dir, "P1,P1/P2,Dde")
    groups = _groups_without_page(spark, sf_dir, plan)
    return member_lists(plan.facts, plan.dashboards[0], groups)


@query
def create_lists(spark, sf_dir):
    """A batch of two dashboards, one of which asks for lists."""
    board = _linked_plan(spark, sf_dir, "P1,P1/P2,Dde").dashboards[0]
    boards = [replace(board, name="lists", link_mode="create"), replace(board, name="links")]
    batch = plan_all(star_facts(spark, sf_dir), boards)
    return batch.lists(_existing_lists(spark, sf_dir), ["Lists/NATION_24"])


# Pages and result documents

def page_texts(spark, sf_dir) -> DataFrame:
    """Pages with a dashboard, made from the documents and their whole texts."""
    rows = run_view(
        spark, sf_dir, "select doc_id, lang, source, n_chars, text from {documents}"
    )
    page = F.col("doc_id")

    def part(test, *pieces):
        return F.when(test, markup.text(*pieces)).otherwise("")

    text = markup.text(
        "Head ",
        F.col("source"),
        "\n{{Property dashboard\n|selector=",
        F.col("lang"),
        part(page % 3 == 0, " {{!}} ", F.col("source")),
        "\n|properties = P",
        F.col("n_chars"),
        ":size, L",
        F.col("lang"),
        part(page % 2 == 0, "\n|stats_for_no_group=1"),
        part(page % 4 == 0, "\n|row_no_group=0"),
        "\n|=dropped\n|grouping_property=P1\n|grouping_property=P17\n}}\n",
        "old {{Q|1}}\n{{Property dashboard end}}\n|stats_for_no_group=1 ",
        F.col("text"),
    )
    return rows.select(page.alias("page"), text.alias("text"))


@query
def extract_dashboard_params(spark, sf_dir):
    return pages.dashboard_params(page_texts(spark, sf_dir))


@query
def migrate_params(spark, sf_dir):
    return pages.rename_params(pages.dashboard_params(page_texts(spark, sf_dir)))


@query
def migrate_page_text(spark, sf_dir):
    texts = page_texts(spark, sf_dir)
    return pages.migrate_texts(texts).select("page", "text")


@query
def splice_report(spark, sf_dir):
    """Two of three pages get a report, with signs that patterns would read."""
    texts = page_texts(spark, sf_dir)
    report_text = F.concat(F.lit("costs $1 \\1 on page "), F.col("page").cast("string"))
    reports = texts.filter("page % 3 <> 1").select("page", report_text.alias("report"))
    return pages.splice_reports(texts, reports)


@query
def ingest_bindings(spark, sf_dir):
    """One result document per customer, with a variable missing now and then."""
    documents = _result_documents(spark, sf_dir)
    return bindings.parse_bindings(documents, "json", ["name", "segment"], ["document"])


@query
def ingest_result_files(spark, sf_dir):
    """The same documents out of files that hold many, read by byte ranges."""
    path = shared_folder(spark)
    _result_documents(spark, sf_dir).select("json").write.text(path)
    return bindings.read_bindings(spark, path, ["name", "segment"])


def _result_documents(spark, sf_dir):
    rows = run_view(
        spark, sf_dir, "select c_custkey, c_name, c_mktsegment, c_acctbal from {customer}"
    )

    def bound(value):
        return F.struct(F.lit("literal").alias("type"), value.alias("value"))

    first = F.struct(
        bound(F.col("c_name")).alias("name"),
        F.when(F.col("c_acctbal") > 0, bound(F.col("c_mktsegment"))).alias("segment"),
    )
    second = F.struct(
        bound(F.concat("c_name", F.lit("-again"))).alias("name"),
        F.lit(None).cast("struct<type:string,value:string>").alias("segment"),
    )
    found = F.when(F.col("c_custkey") % 7 == 0, F.array().cast(
        "array<struct<name:struct<type:string,value:string>,"
        "segment:struct<type:string,value:string>>>"
    )).otherwise(F.array(first, second))
    return rows.select(
        F.col("c_custkey").alias("document"),
        F.to_json(F.struct(F.struct(found.alias("bindings")).alias("results"))).alias("json"),
    )
