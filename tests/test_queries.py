"""Registered queries against their oracles on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")

# The whole set is run by check.py; these cover each family.
NAMES = (
    "select_entities_sql",
    "unknown_fold",
    "year_rebin",
    "coverage_ref_scoped_group",
    "render_report",
    "drill_reference_priority",
    "drill_negative_reference",
    "member_lists_missing",
    "extract_dashboard_params",
    "ingest_bindings",
)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, name):
    verdict, rows, _ = check.compare(spark, SF_DIR, name)
    assert verdict == "ok" and rows > 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
