"""Time the headline queries and print one JSON line.

The fact tables are written once to a scratch folder, as a user would have them;
that step is timed on its own. With BENCH_BASELINE=1 the dashboards are also run
with one job per column and section, the form the one-pass plan replaces.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan import Dashboard, Facts, GroupBy, columns_from_text
from factspan.operators.grouping import group_edges
from factspan.operators.presence import entities_with_column
from factspan.plans import report
from factspan.plans.coverage import Coverage
from factspan.plans.drilldown import DrillDown
from workload.queries import QUERIES
from workload.star import selection, star_facts

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HOME = GroupBy(("P3",), "item")
SEVEN = "P1,P1/P2,P1/Q5/P2,P1/S*,P1/S248,P9,P10"
SIX_CHECKS = "P1/S*,P1/S!,P1/S248,P1/S248=Q82,P1/S248=Q82;S854=Q70,P1/S248=Q82+S854=Q70"
STAR_QUERIES = ("coverage_report_long", "year_rebin", "group_decorate", "missing_property")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read(frame: DataFrame) -> None:
    """Run a plan to its end."""
    frame.write.format("noop").mode("overwrite").save()


def dashboard(orders: DataFrame, columns: str) -> Dashboard:
    return Dashboard(orders, HOME, columns_from_text(columns), row_no_group=True)


def one_pass(facts: Facts, board: Dashboard) -> None:
    report.long_report(Coverage(facts, board)).collect()


def naive(facts: Facts, board: Dashboard) -> None:
    """One job per column and section."""
    bag = board.selector
    edges = group_edges(facts, board.group_by)
    pairs = bag.join(edges, "entity_id")
    outside = bag.join(edges, "entity_id", "left_anti")

    def grouped(rows: DataFrame) -> None:
        rows.groupBy("group").agg(F.count_distinct("entity_id").alias("count")).collect()

    grouped(pairs)
    bag.groupBy().count().collect()
    outside.groupBy().count().collect()
    for column in board.columns:
        having = entities_with_column(facts, column)
        grouped(pairs.join(having, "entity_id", "left_semi"))
        for rows in (bag, outside):
            rows.join(having, "entity_id", "left_semi").groupBy().count().collect()


def timed(run, runs: int) -> float:
    """Median time after one warm-up."""
    run()
    took = []
    for _ in range(runs):
        started = time.perf_counter()
        run()
        took.append(time.perf_counter() - started)
    return round(statistics.median(took), 3)


def main() -> None:
    spark = session()
    folder = tempfile.mkdtemp(prefix="bench-facts-")
    started = time.perf_counter()
    star_facts(spark, SF_DIR).write(folder, mode="overwrite")
    prepared = round(time.perf_counter() - started, 3)
    orders = selection(spark, SF_DIR, "orders")

    def facts() -> Facts:
        # Fresh each time, so that hot keys are looked up inside the timing.
        return Facts.read(spark, folder)

    seven, six = dashboard(orders, SEVEN), dashboard(orders, SIX_CHECKS)

    def drill(positive: bool) -> None:
        found = DrillDown(facts(), seven)
        read((found.positive if positive else found.negative)("P1/S248", "Q7"))

    headline = {
        "dashboard_seven_columns": lambda: one_pass(facts(), seven),
        "dashboard_six_reference_checks": lambda: one_pass(facts(), six),
        "drill_positive": lambda: drill(True),
        "drill_negative": lambda: drill(False),
    } | {f"star_{name}": lambda name=name: read(QUERIES[name](spark, SF_DIR)) for name in STAR_QUERIES}
    baseline = {
        "naive_seven_columns": lambda: naive(facts(), seven),
        "naive_six_reference_checks": lambda: naive(facts(), six),
    }
    queries = {}
    for name, run in headline.items():
        queries[name] = timed(run, RUNS)
        print(name, queries[name], file=sys.stderr, flush=True)
    compared = {}
    if os.environ.get("BENCH_BASELINE") == "1":
        for name, run in baseline.items():
            started = time.perf_counter()
            run()
            compared[name] = round(time.perf_counter() - started, 3)
    result = {
        "metric": "headline_total",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "baseline": compared,
        "prepare_facts": prepared,
        "sf": SF_DIR.rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))


if __name__ == "__main__":
    sys.exit(main())
