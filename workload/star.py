"""The driver's tables as fact tables.

The views below run unchanged on Spark and on DuckDB. Entities: orders ``o1``,
customers ``c1``, documents ``d1``, nations ``Q1``, regions ``Q1001``.

Properties: P1 nation of the supplier, one statement per order and line number,
with ranks, unknown values and "no value"; P3 nation of an order's customer;
P4 order dates of a customer; P5 region of a nation; P6 parent in a tree of
customers; P7 nation of a customer; P8 short code of a nation; P9 as P3 with unknown
values; P10 a wide range of years; P11 customer of an order. Qualifier P2 of P1 is its tax. The nodes of a
statement are its line items, with snaks P248 or P143 (return flag) and P854 or
P813 (line status).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factspan import Facts

TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
        "c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}

_STATEMENT = "cast(l_orderkey as varchar(20)) || '-' || cast(l_linenumber as varchar(20))"
_UNKNOWN = "'http://www.wikidata.org/.well-known/genid/'"

_STATEMENTS = f"""
select l_orderkey, {_STATEMENT} as statement_id, min(l_returnflag) as flag,
  min(l_suppkey) as suppkey, min(s_nationkey) as nation, min(l_tax) as tax
from {{lineitem}} join {{supplier}} on l_suppkey = s_suppkey
group by l_orderkey, l_linenumber"""

_NODES = f"""
select distinct {_STATEMENT} as statement_id, {_STATEMENT} || '-' ||
  cast(l_partkey as varchar(20)) || '-' || cast(l_suppkey as varchar(20)) || '-' ||
  l_returnflag || l_linestatus as reference_id, l_returnflag as flag, l_linestatus as status
from {{lineitem}} where l_discount >= 0.04"""


def _plain_claims(prop: str, entity: str, value: str, source: str, **other: str) -> str:
    """A claims select with the plain case for what is not given."""
    year = other.get("year", "cast(null as bigint)")
    return f"""
select {entity} as entity_id, '{prop}' as property,
  {other.get("statement", f"{entity} || '-{prop}'")} as statement_id, 'normal' as rank,
  {other.get("snak", "'value'")} as snak_type, '{other.get("type", "item")}' as value_type,
  {value} as value, {other.get("time", "null")} as time_value, {year} as time_year
from {source}"""


_ORDER = "'o' || cast(o_orderkey as varchar(20))"
_CUSTOMER = "'c' || cast(c_custkey as varchar(20))"
_NATION = "'Q' || cast(n_nationkey as varchar(20))"
_HOME = "'Q' || cast(c_nationkey as varchar(20))"
_GROUPED = (
    "{orders} join {customer} on o_custkey = c_custkey where c_mktsegment <> 'MACHINERY'"
)

VIEWS = {
    "claims": " union all ".join(
        [
            f"""
select 'o' || cast(l_orderkey as varchar(20)) as entity_id, 'P1' as property, statement_id,
  case flag when 'A' then 'preferred' when 'N' then 'normal' else 'deprecated' end as rank,
  case when suppkey % 19 = 0 then 'novalue' when suppkey % 23 = 0 then 'somevalue'
    else 'value' end as snak_type, 'item' as value_type,
  case when suppkey % 19 = 0 then null when suppkey % 23 = 0 then {_UNKNOWN} || statement_id
    else 'Q' || cast(nation as varchar(20)) end as value,
  null as time_value, cast(null as bigint) as time_year
from ({_STATEMENTS}) s""",
            _plain_claims("P3", _ORDER, _HOME, _GROUPED),
            _plain_claims(
                "P4",
                "'c' || cast(o_custkey as varchar(20))",
                "cast(cast(o_orderdate as date) as varchar(10))",
                "{orders}",
                type="time",
                statement=f"{_ORDER} || '-P4'",
                time="o_orderdate",
                year="cast(year(o_orderdate) as bigint)",
            ),
            _plain_claims(
                "P5",
                _NATION,
                "'Q' || cast(n_regionkey + 1000 as varchar(20))",
                "{nation}",
            ),
            _plain_claims(
                "P6",
                _CUSTOMER,
                "'c' || cast(cast(floor(c_custkey / 8) as bigint) as varchar(20))",
                "{customer} where c_custkey > 0",
            ),
            _plain_claims("P7", _CUSTOMER, _HOME, "{customer}"),
            _plain_claims(
                "P8",
                _NATION,
                "'N' || lpad(cast(n_nationkey as varchar(20)), 2, '0')",
                "{nation} where n_nationkey % 4 <> 0",
                type="string",
            ),
            _plain_claims(
                "P9",
                _ORDER,
                f"case when o_orderkey % 17 = 0 then {_UNKNOWN} || {_ORDER} else {_HOME} end",
                _GROUPED,
                snak="case when o_orderkey % 17 = 0 then 'somevalue' else 'value' end",
            ),
            _plain_claims(
                "P10",
                _ORDER,
                "cast(o_orderkey % 400 - 150 as varchar(20))",
                "{orders}",
                type="time",
                year="o_orderkey % 400 - 150",
            ),
            _plain_claims(
                "P12",
                _ORDER,
                f"case when o_orderkey % 13 = 0 then {_UNKNOWN} || {_ORDER} "
                "else cast(cast(o_orderdate as date) as varchar(10)) end",
                "{orders}",
                type="time",
                snak="case when o_orderkey % 13 = 0 then 'somevalue' else 'value' end",
                time="case when o_orderkey % 13 <> 0 then o_orderdate end",
                year="case when o_orderkey % 13 <> 0 then cast(year(o_orderdate) as bigint) end",
            ),
            _plain_claims(
                "P11", _ORDER, "'c' || cast(o_custkey as varchar(20))", "{orders}"
            ),
        ]
    ),
    "qualifiers": f"""
select statement_id, 'P2' as property,
  case when tax > 0.07 then 'novalue' else 'value' end as snak_type,
  case when tax > 0.07 then null
    else 'Q' || cast(cast(round(tax * 100, 0) as int) as varchar(20)) end as value
from ({_STATEMENTS}) s where tax > 0.04""",
    "reference_nodes": f"select statement_id, reference_id from ({_NODES}) n",
    "reference_snaks": f"""
select reference_id, case flag when 'N' then 'P143' else 'P248' end as property,
  'Q' || cast(ascii(flag) as varchar(20)) as value from ({_NODES}) n
union all
select reference_id, case status when 'F' then 'P854' else 'P813' end as property,
  'Q' || cast(ascii(status) as varchar(20)) as value from ({_NODES}) n""",
    "terms": f"""
select 'd' || cast(doc_id as varchar(20)) as entity_id,
  case when n_chars > 1000 then 'description' else 'label' end as kind,
  case when lang = 'es' then 'mul' else lang end as lang, text
from {{documents}}
union all
select {_NATION}, 'label', case when n_nationkey % 3 = 0 then 'mul' else 'en' end, n_name
from {{nation}}""",
    "sitelinks": """
select 'd' || cast(page_id as varchar(20)) as entity_id,
  'https://' || split_part(url, '/', 4) || '.example.org/' as project_url, url as title
from {pages}""",
    "projects": """
select distinct lang || 'wiki' as code, 'https://' || lang || '.example.org/' as url,
  'Q9' || cast(ascii(lang) as varchar(20)) as item from {documents}""",
}

# Selections of entities.
SELECTIONS = {
    "orders": f"select {_ORDER} as entity_id from {{orders}}",
    # A bag: an order comes once per large line item.
    "big_lines": "select 'o' || cast(l_orderkey as varchar(20)) as entity_id "
    "from {lineitem} where l_quantity > 25",
    "customers": f"select {_CUSTOMER} as entity_id from {{customer}}",
    "documents": "select 'd' || cast(doc_id as varchar(20)) as entity_id from {documents}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def run_view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view's text over the tables it names."""
    named = [name for name in TABLE_SCHEMAS if "{%s}" % name in text]
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in named})


def star_facts(spark: SparkSession, sf_dir: str) -> Facts:
    return Facts(**{name: run_view(spark, sf_dir, text) for name, text in VIEWS.items()})


def selection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_view(spark, sf_dir, SELECTIONS[name])
