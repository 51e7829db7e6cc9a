import pytest
from pyspark.sql import functions as F

from factspan.functions import markup
from factspan.functions.values import is_unknown, percent, year_bin


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "total", "share"),
    [(0, 10, 0.0), (None, 10, 0.0), (10, 10, 100.0), (1, 3, 33.33), (1, 800, 0.12), (5, 0, 500.0)],
)
def test_percent(spark, value, total, share):
    column = percent(F.lit(value).cast("bigint"), F.lit(total).cast("bigint"))
    assert one(spark, column) == share


@pytest.mark.parametrize(
    ("year", "span", "start"), [(1995, 10, 1990), (-5, 10, -10), (-10, 10, -10), (3, 100, 0)]
)
def test_year_bins_are_floored(spark, year, span, start):
    assert one(spark, year_bin(F.lit(year), span)) == start


@pytest.mark.parametrize(
    ("start", "span", "heading"),
    [
        (1873, 1, "1873"),
        (1640, 10, "1640s"),
        (1700, 100, "1700s"),
        (3000, 1000, "3000s"),
        (-120_000_000, 10**7, "-120 Ma"),
        (-40_000, 10**4, "-40 ka"),
    ],
)
def test_year_headings(spark, start, span, heading):
    start, span = (F.lit(x).cast("bigint") for x in (start, span))
    assert one(spark, markup.year_heading(start, span)) == heading


def test_unknown_groups(spark):
    rows = spark.createDataFrame([("Q1",), ("",), (None,), ("x:genid/1",)], "g string")
    found = rows.select(is_unknown(F.col("g"), "x:genid/").alias("u")).collect()
    assert [r.u for r in found] == [False, True, True, True]


@pytest.mark.parametrize(
    ("value", "kind", "cell"),
    [
        ("Q5", None, '| data-sort-value="Q5"| {{Q|Q5}}\n'),
        (
            "http://commons.wikimedia.org/wiki/Special:FilePath/a%20b.svg",
            None,
            '| data-sort-value="a%20b.svg"| [[File:a%20b.svg|center|100px]]\n',
        ),
        ("AT", "country", '| data-sort-value="AT"| {{Flag|AT}}\n'),
        ("AT", None, '| data-sort-value="AT"| AT\n'),
        ("", None, '| data-sort-value=""| \n'),
    ],
)
def test_higher_group_cells(spark, value, kind, cell):
    assert one(spark, markup.higher_group_cell(F.lit("item"), F.lit(value), kind)) == cell


@pytest.mark.parametrize(
    ("kind", "link", "cell"),
    [
        ("item", None, "| 7 \n"),
        ("item", "Foo/A", "| [[Foo/A|7]] \n"),
        ("unknown", "Foo/B", "| [[Foo/B|7]] \n"),
        ("item", "https://x.org/A", "| [https://x.org/A 7] \n"),
        ("none", "Foo/A", "| 7 \n"),
        ("totals", "Foo/A", "| 7 \n"),
    ],
)
def test_count_cells(spark, kind, link, cell):
    column = markup.count_cell(F.lit(kind), F.lit(link).cast("string"), F.lit(7))
    assert one(spark, column) == cell
