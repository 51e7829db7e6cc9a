"""The same questions in plain SQL, written entity by entity rather than in one pass."""

from __future__ import annotations

from workload.star import SELECTIONS, TABLE_SCHEMAS, VIEWS


def _plain(text: str) -> str:
    """A view's text over the registered tables."""
    for name in TABLE_SCHEMAS:
        text = text.replace("{%s}" % name, name)
    return text


TRUTHY = """
select entity_id, property, statement_id, rank, snak_type, value, time_year from (
  select *, max(case rank when 'preferred' then 2 when 'normal' then 1 else 0 end)
    over (partition by entity_id, property) as best from f_claims) r
where best = case rank when 'preferred' then 2 when 'normal' then 1 else 3 end"""

BASE = {f"f_{name}": _plain(text) for name, text in VIEWS.items()} | {
    "truthy": TRUTHY,
    "labels": """
select entity_id, coalesce(min(case when lang = 'en' then text end),
  min(case when lang = 'mul' then text end)) as label
from f_terms where kind = 'label' and lang in ('en', 'mul') group by entity_id""",
    "quals": """
select c.entity_id, c.statement_id, c.value as main, c.snak_type as main_type,
  q.value, q.snak_type
from f_claims c join f_qualifiers q on q.statement_id = c.statement_id
where c.property = 'P1' and q.property = 'P2'""",
}


def sql(body: str, **ctes: str) -> str:
    """A query over the fact views and extra common table expressions."""
    everything = BASE | ctes
    named = ", ".join(f"{name} as materialized ({text})" for name, text in everything.items())
    return f"with {named} {body}"


def edges(prop: str, column: str = "value") -> str:
    return (
        f"select distinct entity_id, {column} as grp from truthy "
        f"where property = '{prop}' and snak_type <> 'novalue'"
    )


HOME = edges("P3")
YEARS = edges("P4", "cast(time_year as varchar)")
WIDE_YEARS = edges("P10", "cast(time_year as varchar)")
SITES = "select distinct entity_id, project_url as grp from f_sitelinks"
ORDERS = _plain(SELECTIONS["orders"])
BIG_LINES = _plain(SELECTIONS["big_lines"])
CUSTOMERS = _plain(SELECTIONS["customers"])
DOCUMENTS = _plain(SELECTIONS["documents"])

# Reference checks: a node of statement x that passes.
_SNAK = "exists (select 1 from f_reference_snaks s where s.reference_id = n.reference_id and {})"


def _snak(prop: str, value: str | None = None) -> str:
    test = f"s.property = '{prop}'" + (f" and s.value = '{value}'" if value else "")
    return _SNAK.format(test)


NODE_TESTS = {
    "S*": "true",
    "S!": "not " + _SNAK.format("s.property in ('P143', 'P3452', 'P887')"),
    "S248": _snak("P248"),
    "S248=Q82": _snak("P248", "Q82"),
    "S854;S248": f"({_snak('P854')} or {_snak('P248')})",
    "S248=Q82;S854=Q70": f"({_snak('P248', 'Q82')} or {_snak('P854', 'Q70')})",
    "S248+S854": f"({_snak('P248')} and {_snak('P854')})",
    "S248=Q82+S854=Q70": f"({_snak('P248', 'Q82')} and {_snak('P854', 'Q70')})",
}


def referenced(check: str) -> str:
    """Statements with a passing node."""
    return f"select n.statement_id from f_reference_nodes n where {NODE_TESTS[check]}"


_TAXED = (
    "statement_id in (select statement_id from f_qualifiers "
    "where property = 'P2' and snak_type <> 'novalue')"
)
_P5 = "snak_type <> 'novalue' and value = 'Q5'"


def statements(scope: str = "true") -> str:
    return f"select * from f_claims where property = 'P1' and {scope}"


def has_reference(check: str, scope: str = "true") -> str:
    """Entities with a statement in scope and none of those unreferenced."""
    return f"""
select entity_id from ({statements(scope)}) a where entity_id not in (
  select entity_id from ({statements(scope)}) b
  where statement_id not in ({referenced(check)}))"""


HAS = {
    "P1": "select entity_id from f_claims where property = 'P1'",
    "P4": "select entity_id from f_claims where property = 'P4'",
    "P7": "select entity_id from f_claims where property = 'P7'",
    "P1/P2": "select entity_id from quals where main_type <> 'novalue' "
    "and snak_type <> 'novalue'",
    "P1/Q5/P2": "select entity_id from quals where main_type <> 'novalue' "
    "and main = 'Q5' and snak_type <> 'novalue'",
    "P1/Q5/S*": has_reference("S*", _P5),
    "P1/P2/S*": has_reference("S*", _TAXED),
    "P1/Q5/P2/S248": has_reference("S248", f"{_P5} and {_TAXED}"),
    "Len": "select entity_id from f_terms where kind = 'label' and lang = 'en'",
    "Lfr": "select entity_id from f_terms where kind = 'label' and lang = 'fr'",
    "Lmul": "select entity_id from f_terms where kind = 'label' and lang = 'mul'",
    "Dde": "select entity_id from f_terms where kind = 'description' and lang = 'de'",
    "frwiki": "select entity_id from f_sitelinks where project_url = 'https://fr.example.org/'",
} | {f"P1/{check}": has_reference(check) for check in NODE_TESTS}

# Columns tied to the group: (entity, group) pairs that have them.
_GROUPED = "select entity_id, value from f_claims where property = 'P1' and snak_type <> 'novalue'"
HAS_PAIR = {
    "P1/?grouping/P2": "select entity_id, main as grp from quals "
    "where main_type <> 'novalue' and snak_type <> 'novalue'",
    "P1/?grouping/S*": f"""
select entity_id, value as grp from ({_GROUPED}) a where (entity_id, value) not in (
  select entity_id, value from f_claims where property = 'P1' and snak_type <> 'novalue'
    and statement_id not in ({referenced("S*")}))""",
}


def _cte_name(index: int) -> str:
    return f"has{index}"


def coverage(
    selected: str,
    edge_sql: str,
    columns: dict[str, str] | None = None,
    threshold: int = 1,
    no_group: bool = False,
    totals: bool = True,
    limit: int | None = None,
    only: str = "true",
    body: str | None = None,
) -> str:
    """Report rows: groups, then "no grouping", then totals.

    ``columns`` maps an output name to a column key. ``body`` replaces the final
    select over ``report`` (section, group_key, count, columns).
    """
    columns = columns or {}
    ctes = {"sel": selected, "edges": edge_sql}
    group_cells, sum_cells, names = [], [], []
    for i, (name, key) in enumerate(columns.items()):
        cte = _cte_name(i)
        if key in HAS_PAIR:
            ctes[cte] = f"select distinct entity_id, grp from ({HAS_PAIR[key]}) p"
            inside = f"(s.entity_id, e.grp) in (select entity_id, grp from {cte})"
        else:
            ctes[cte] = f"select distinct entity_id from ({HAS[key]}) p"
            inside = f"s.entity_id in (select entity_id from {cte})"
        group_cells.append(
            f", count(distinct case when {inside} then s.entity_id end) as {name}"
        )
        sum_cells.append(
            f", count(case when s.entity_id in (select entity_id from {cte}) then 1 end) as {name}"
        )
        names.append(f", {name}")
    ctes["raw"] = f"""
select e.grp, count(distinct s.entity_id) as count {"".join(group_cells)}
from sel s join edges e on e.entity_id = s.entity_id where {only} group by e.grp"""
    ctes["kept"] = (
        f"select * from raw where count >= {threshold} "
        + (f"order by count desc, grp limit {limit}" if limit else "")
    )
    parts = [f"select 0 as section, grp as group_key, count {''.join(names)} from kept"]
    if no_group:
        parts.append(
            f"select 1, 'None', count(*) {''.join(sum_cells)} from sel s "
            "where s.entity_id not in (select entity_id from edges)"
        )
    if totals:
        parts.append(f"select 2, '', count(*) {''.join(sum_cells)} from sel s")
    ctes["report"] = " union all ".join(parts)
    return sql(body or "select * from report", **ctes)


# Drill-downs


def labelled(rows: str, *ids: str, members: str, **ctes: str) -> str:
    """Distinct rows with a label next to each id column."""
    shown, joins = [], []
    for i, name in enumerate(ids):
        label = "entity_label" if name == "entity_id" else f"{name}_label"
        shown.append(f", l{i}.label as {label}")
        joins.append(f" left join labels l{i} on l{i}.entity_id = r.{name}")
    return sql(
        f"select r.* {''.join(shown)} from (select distinct * from ({rows}) x) r {''.join(joins)}",
        members=members,
        **ctes,
    )


def in_group(selected: str, edge_sql: str, test: str) -> str:
    return (
        f"select distinct s.entity_id from ({selected}) s join ({edge_sql}) e "
        f"on e.entity_id = s.entity_id where {test}"
    )


Q7 = in_group(ORDERS, HOME, "e.grp = 'Q7'")
UNKNOWN = in_group(
    ORDERS, edges("P9"), "starts_with(e.grp, 'http://www.wikidata.org/.well-known/genid/')"
)
UNKNOWN_YEAR = f"select distinct entity_id from ({ORDERS}) s where cast(substr(entity_id, 2) as bigint) % 13 = 0"
ALL_ORDERS = f"select distinct entity_id from ({ORDERS}) s"
ALL_DOCUMENTS = f"select distinct entity_id from ({DOCUMENTS}) s"
IN = "entity_id in (select entity_id from members)"

P1_VALUES = f"select entity_id, value from f_claims where property = 'P1' and {IN}"
PRIORITY = """
select reference_id, property as ref_property, value as ref_value from (
  select *, min(place) over (partition by reference_id) as best from (
    select *, case property when 'P248' then 1 when 'P854' then 2 when 'P813' then 4
      when 'P4656' then 4 when 'P1065' then 4 else 3 end as place
    from f_reference_snaks) s) t where place = best"""


def positive_reference(check: str, shown: str, columns: str, join: str) -> str:
    return f"""
select c.entity_id, c.value {columns} from f_claims c
join f_reference_nodes n on n.statement_id = c.statement_id
{join} ({shown}) v on v.reference_id = n.reference_id
where c.property = 'P1' and c.snak_type <> 'novalue'
  and c.entity_id in (select entity_id from members)
  and c.entity_id in ({has_reference(check)})"""


def negative_reference(check: str, scope: str = "true") -> str:
    return f"""
select m.entity_id, c.value from members m
left join (select entity_id, value from f_claims
  where property = 'P1' and snak_type <> 'novalue') c on c.entity_id = m.entity_id
where m.entity_id not in ({has_reference(check, scope)})"""


_QUALIFIED = "select entity_id, value, snak_type from quals where "
_ANY_OF = """
select n.reference_id, coalesce(a.value, b.value) as ref_value from f_reference_nodes n
left join f_reference_snaks a on a.reference_id = n.reference_id and a.property = 'P854'
left join f_reference_snaks b on b.reference_id = n.reference_id and b.property = 'P248'"""
_ALL_OF = """
select a.reference_id, a.value as "ref_P248", b.value as "ref_P854"
from f_reference_snaks a join f_reference_snaks b on b.reference_id = a.reference_id
where a.property = 'P248' and b.property = 'P854'"""

REF_IDS = ("entity_id", "value", "ref_property", "ref_value")
DRILLS = {
    "drill_positive_property": labelled(P1_VALUES, "entity_id", "value", members=Q7),
    "missing_property": labelled(
        "select entity_id from members where entity_id not in "
        "(select entity_id from truthy where property = 'P1')",
        "entity_id",
        members=ALL_ORDERS,
    ),
    "drill_positive_qualifier": labelled(
        _QUALIFIED + IN, "entity_id", "value", members=Q7
    ),
    "drill_negative_qualifier": labelled(
        "select entity_id from members where entity_id not in (select entity_id from quals)",
        "entity_id",
        members=Q7,
    ),
    "drill_positive_qualifier_group": labelled(
        _QUALIFIED + f"main = 'Q7' and {IN}", "entity_id", "value", members=Q7
    ),
    "drill_negative_qualifier_group": labelled(
        "select entity_id from members where entity_id not in "
        "(select entity_id from quals where main = 'Q7')",
        "entity_id",
        members=Q7,
    ),
    "drill_reference_priority": labelled(
        positive_reference("S*", PRIORITY, ", v.ref_property, v.ref_value", "left join"),
        *REF_IDS,
        members=Q7,
    ),
    "drill_reference_good": labelled(
        positive_reference("S!", PRIORITY, ", v.ref_property, v.ref_value", "left join"),
        *REF_IDS,
        members=ALL_ORDERS,
    ),
    "drill_reference_property": labelled(
        positive_reference(
            "S248",
            "select reference_id, value as ref_value from f_reference_snaks "
            "where property = 'P248'",
            ", v.ref_value",
            "join",
        ),
        "entity_id",
        "value",
        "ref_value",
        members=Q7,
    ),
    "drill_reference_any_of": labelled(
        positive_reference("S854;S248", _ANY_OF, ", v.ref_value", "left join"),
        "entity_id",
        "value",
        "ref_value",
        members=Q7,
    ),
    "drill_reference_all_of": labelled(
        positive_reference("S248+S854", _ALL_OF, ', v."ref_P248", v."ref_P854"', "join"),
        "entity_id",
        "value",
        "ref_P248",
        "ref_P854",
        members=ALL_ORDERS,
    ),
    "drill_negative_reference": labelled(
        negative_reference("S248"), "entity_id", "value", members=Q7
    ),
    "drill_negative_reference_scoped": labelled(
        negative_reference("S*", _TAXED), "entity_id", "value", members=Q7
    ),
    "drill_unknown_group": labelled(P1_VALUES, "entity_id", "value", members=UNKNOWN),
    "drill_unknown_group_negative": labelled(
        negative_reference("S*"), "entity_id", "value", members=UNKNOWN
    ),
    "drill_unknown_year": labelled(P1_VALUES, "entity_id", "value", members=UNKNOWN_YEAR),
    "drill_unknown_year_negative": labelled(
        negative_reference("S*"), "entity_id", "value", members=UNKNOWN_YEAR
    ),
    "drill_no_group": labelled(
        P1_VALUES,
        "entity_id",
        "value",
        members=f"{ALL_ORDERS} where entity_id not in (select entity_id from ({HOME}) e)",
    ),
    "drill_totals": labelled(P1_VALUES, "entity_id", "value", members=ALL_ORDERS),
    "drill_year_span": labelled(
        f"select entity_id, value from f_claims where property = 'P7' and {IN}",
        "entity_id",
        "value",
        members=in_group(CUSTOMERS, YEARS, "cast(e.grp as bigint) between 1990 and 1999"),
    ),
    "drill_positive_label": labelled(
        f"select entity_id from ({HAS['Lfr']}) h where {IN}",
        "entity_id",
        members=in_group(DOCUMENTS, SITES, "e.grp = 'https://fr.example.org/'"),
    ),
    "drill_positive_description": labelled(
        "select entity_id, text as value from f_terms "
        f"where kind = 'description' and lang = 'en' and {IN}",
        "entity_id",
        "value",
        members=ALL_DOCUMENTS,
    ),
    "drill_sitelink_group": labelled(
        "select entity_id, title as value from f_sitelinks "
        f"where project_url = 'https://en.example.org/' and {IN}",
        "entity_id",
        "value",
        members=in_group(DOCUMENTS, SITES, "e.grp = 'https://en.example.org/'"),
    ),
} | {
    name: labelled(
        f"select entity_id from members where entity_id not in ({HAS[key]})",
        "entity_id",
        members=ALL_DOCUMENTS,
    )
    for name, key in {
        "missing_label": "Len",
        "missing_description": "Dde",
        "missing_sitelink": "frwiki",
    }.items()
}


# Reports

REPORT = {"c0": "P1", "c1": "P1/P2", "c2": "P1/S*", "c3": "P1/S248"}
_HIGHER = "(select min(value) from truthy t where t.property = 'P5' and t.entity_id = group_key)"
_LABEL = "(select label from labels l where l.entity_id = group_key)"
_KIND = "case section when 0 then 'item' when 1 then 'none' else 'totals' end"
_LINK = f"case when section = 0 then 'Lists/' || coalesce({_LABEL}, group_key) end"
_PERCENT = "case when {0} = 0 then 0.0::double else round_even(1.0::double * {0} / greatest(count, 1) * 100.0::double, 2) end"
_KEYS = dict(zip(REPORT, ("P1", "P1/P2", "P1/S*", "P1/S248"), strict=True))


def report(body: str) -> str:
    return coverage(ORDERS, HOME, REPORT, threshold=20, no_group=True, body=body)


_LONG = " union all ".join(
    f"select 'dashboard' as dashboard, section, {_KIND} as kind, group_key, count, "
    f"'{key}' as column_key, {cell} as column_count, {_PERCENT.format(cell)} as percent from report"
    for cell, key in _KEYS.items()
)


def _markup_cell(cell: str, key: str) -> str:
    percent = _PERCENT.format(cell)
    return (
        f"'| {{{{Coverage cell|' || case when {cell} = 0 then '0' else cast({percent} as varchar) end "
        f"|| '|' || {cell} || '|column={key}|grouping=' || group_key || '}}}}\n'"
    )


_HEADERS = (
    "[[Property:P1|Supplier]]",
    "{{Property|P2}}",
    "{{Property|P1}}📚",
    "{{Property|P1}}📚{{Property|P248}}",
)
_TABLE_HEAD = (
    '{| class="wikitable sortable"\n'
    '! colspan="3" |Top groupings (Minimum 20 items)\n'
    '! colspan="4"|Top Properties (used at least 0 times per grouping)\n'
    "|-\n! \n! Name\n! Count\n"
    + "".join(f'! data-sort-type="number"|{header}\n' for header in _HEADERS)
)
_MARKUP_ROW = (
    "case when section = 2 then '|- class=\"sortbottom\"\n' else '|-\n' end || "
    f"case section when 0 then '| data-sort-value=\"' || coalesce({_HIGHER}, '') || '\"| {{{{Q|' "
    f"|| coalesce({_HIGHER}, '') || '}}}}\n' when 1 then '|\n' else '||\n' end || "
    "case section when 0 then '| {{Q|' || group_key || '}}\n' when 1 then '| No grouping\n' "
    "else '| ''''''Totals'''''' <small>(all items)</small>\n' end || "
    f"case section when 0 then '| [[' || {_LINK} || '|' || count || ']] \n' "
    "else '| ' || count || ' \n' end || "
    + " || ".join(_markup_cell(cell, key) for cell, key in _KEYS.items())
)


def multi(name: str, text: str, columns: dict[str, str]) -> str:
    """One dashboard of the batch as long rows."""
    rows = " union all ".join(
        f"select '{name}' as dashboard, section, group_key, count, '{key}' as column_key, "
        f"{cell} as column_count, {_PERCENT.format(cell)} as percent from r"
        for cell, key in columns.items()
    )
    return f"select * from (with r as ({text}) {rows}) m"


_P9 = "select distinct entity_id from f_claims where property = 'P9'"
_P4 = "select distinct entity_id from f_claims where property = 'P4'"
_SUPPLIED = "select entity_id from f_claims where property = 'P1'"
_BATCH = (
    ("orders", _P9, HOME, {"c0": "P1", "c1": "P1/P2"}, 100, True),
    ("customers", _P4, YEARS, {"c0": "P7"}, 20, False),
    ("supplied", _SUPPLIED, HOME, {"c0": "P1/S248", "c1": "P1"}, 20, False),
)


# A dashboard over the orders of customers below c3; the entities are a bag.
_TREE = (
    "select 'o' || cast(o_orderkey as varchar) as entity_id from orders join below "
    "on o_custkey = below.n"
)
_TREE_COLUMNS = {"c0": "P1/S!", "c1": "P1/?grouping/P2"}
_BELOW_C3 = (
    "with recursive below as (select 3::bigint as n union select c_custkey from customer "
    "join below on floor(c_custkey / 8) = below.n where c_custkey > 0) "
)


def _batch_rows(body: str | None) -> list[tuple[str, str, dict[str, str]]]:
    """(name, report SQL, columns) of the dashboards that have rows."""
    found = [
        (name, coverage(selected, edge_sql, columns, threshold=threshold, no_group=no_group, body=body), columns)
        for name, selected, edge_sql, columns, threshold, no_group in _BATCH
    ]
    tree = coverage(_TREE, HOME, _TREE_COLUMNS, threshold=2, no_group=True, body=body)
    return [*found, ("tree", tree, _TREE_COLUMNS)]


_FLEET = _BELOW_C3 + " union all ".join(
    f"select * from ({multi(name, text, columns)}) x" for name, text, columns in _batch_rows(None)
)
_OUTCOMES = _BELOW_C3 + " union all ".join(
    [
        f"select '{name}' as dashboard, 'reported' as outcome, cast(null as varchar) as error, n as groups "
        f"from ({text}) x"
        for name, text, _ in _batch_rows("select count(*) as n from report where section = 0")
    ]
    + [
        "select 'no values', 'empty', 'no values for P99', 0",
        "select 'no groups', 'empty', 'no groups found', 0",
        "select 'broken', 'failed', 'failed', 0",
    ]
)
_KINDS = " union all ".join(
    f"""
select '{name}' as dashboard, case min(value_type) when 'item' then 'item'
  when 'time' then 'year' end as kind from truthy_types where {test}"""
    for name, test in (
        ("orders", "entity_id like 'o%'"),
        ("customers", "entity_id like 'c%'"),
        ("both", "true"),
        ("nations", "entity_id like 'Q%'"),
    )
)
_TRUTHY_TYPES = """
select t.entity_id, c.value_type from truthy t join f_claims c using (statement_id)
where t.property in ('P3', 'P4') and t.snak_type = 'value'"""
_PATH_CHOICE = """
select a.entity_id from (
  select entity_id from (select distinct entity_id, value from truthy where property = 'P3') x
  where value = 'Q7'
  union all
  select o.entity_id from truthy o join truthy c on c.entity_id = o.value
  where o.property = 'P11' and c.property = 'P7' and c.value = 'Q7') a
join (
  select entity_id, value from (select distinct entity_id, value from truthy
    where property = 'P1' and snak_type <> 'novalue') p
  union all
  select p.entity_id, n.value from (select distinct entity_id, value from truthy
    where property = 'P1' and snak_type <> 'novalue') p
  join truthy n on n.entity_id = p.value where n.property = 'P5') b
on b.entity_id = a.entity_id"""


# Decade rebinning: the smallest span with at most 100 bins.
_REBIN_SPAN = """
select min(span) as span from (
  select span, count(distinct floor(cast(group_key as bigint) / span)) as bins
  from report, (select cast(pow(10, k) as bigint) as span from range(0, 12) t(k)) spans
  where section = 0 group by span) b where bins <= 100"""
_REBIN = f"""
select section, group_key, span, group_link, count, sourced from (
  select 0 as section, cast(start as varchar) || '/' || cast(span as varchar) as group_key, span,
    'Years/' || cast(start as varchar) as group_link,
    cast(sum(count) as bigint) as count, cast(sum(sourced) as bigint) as sourced
  from (select *, cast(floor(cast(group_key as bigint) / span) * span as bigint) as start
    from report, ({_REBIN_SPAN}) s where section = 0) b
  group by start, span
  union all
  select section, group_key, null, null, count, sourced from report where section = 2) u"""

_FOLD = """
select section, group_key, count, sourced from report
where section <> 0 or not starts_with(group_key, 'http://www.wikidata.org/.well-known/genid/')
union all
select 0, 'UNKNOWN_VALUE', cast(sum(count) as bigint),
  (select cast(sum(sourced) as bigint) from raw
   where starts_with(grp, 'http://www.wikidata.org/.well-known/genid/'))
from kept where starts_with(grp, 'http://www.wikidata.org/.well-known/genid/')
having sum(count) > 0"""

_HEADING = """
select distinct wide_year, span, case
  when span = 1 then cast(wide_year as varchar)
  when span >= 1000000 and wide_year % 1000000 = 0
    then cast(cast(floor(wide_year / 1000000) as bigint) as varchar) || ' Ma'
  when span >= 10000 and wide_year % 1000 = 0
    then cast(cast(floor(wide_year / 1000) as bigint) as varchar) || ' ka'
  else cast(wide_year as varchar) || 's' end as heading
from (
  select span, time_year * f * span as wide_year from
    (select distinct time_year from f_claims where property = 'P10') y,
    (select unnest([1, 10, 100, 10000, 1000000, 10000000])::bigint as span) s,
    (select unnest([1000, 1])::bigint as f) f) w"""

_HIGHER_CELLS = """
select entity_id, kind as higher_class, case kind
  when 'item' then '| data-sort-value="' || value || '"| {{Q|' || value || '}}
'
  when 'image' then '| data-sort-value="' || value || '"| [[File:' || value || '|center|100px]]
'
  else '| data-sort-value="land ' || value || '"| land ' || value || '
' end as cell
from (select entity_id, value, case cast(substr(value, 2, 10) as int) % 3 when 0 then 'item'
  when 1 then 'image' else 'text' end as kind from f_claims where property = 'P3') c"""

_COUNT_CELLS = """
select section, group_key, case when section <> 0 then '| ' || count || ' 
' when count % 2 = 0 then '| [[Lists/' || group_key || '|' || count || ']] 
' else '| [https://lists.example.org/' || group_key || ' ' || count || '] 
' end as cell from report"""

# Groups with a list: before the first foreign link, without a page.
_LISTED = """
select r.group_key, 'Lists/' || l.label as group_link, r.count
from report r join labels l on l.entity_id = r.group_key
where (-r.count, r.group_key) <
    (select (-f.count, f.group_key) from report f where f.group_key = 'Q24')
  and 'Lists/' || l.label not in
    (select 'Lists/' || n_name from nation where n_nationkey % 5 = 0)"""

_LIST_ROWS = f"""
select m.grp as group_key, m.entity_id, f.position, f.field, v.value
from (select s.entity_id, e.grp from (select distinct entity_id from sel) s
    join edges e on e.entity_id = s.entity_id
    where e.grp in (select group_key from ({_LISTED}) g)) m
cross join (values (0, 'label'), (1, 'description/de'), (2, 'P1'), (3, 'P1/P2')) f(position, field)
left join (
  select entity_id, 'label' as field, label as value from labels
  union select entity_id, 'description/de', text from f_terms
    where kind = 'description' and lang = 'de'
  union select entity_id, 'P1', value from truthy
    where property = 'P1' and snak_type <> 'novalue'
  union select entity_id, 'P1/P2', value from quals where snak_type <> 'novalue') v
on v.entity_id = m.entity_id and v.field = f.field"""


# Pages

_FIELDS = """
select doc_id as page, 'selector' as field,
  lang || case when doc_id % 3 = 0 then ' | ' || source else '' end as value from documents
union all
select doc_id, 'properties', 'P' || n_chars || ':size, L' || lang from documents
union all
select doc_id, 'grouping_property', 'P17' from documents"""
_PAGE = """'Head ' || source || '
{{Property dashboard
|selector=' || lang || case when doc_id % 3 = 0 then ' {{!}} ' || source else '' end || '
|properties = P' || n_chars || ':size, L' || lang ||
  case when doc_id % 2 = 0 then '
|OLD=1' else '' end || case when doc_id % 4 = 0 then '
|row_no_group=0' else '' end || '
|=dropped
|grouping_property=P1
|grouping_property=P17
}}
' || MIDDLE || '
{{Property dashboard end}}
|stats_for_no_group=1 ' || text"""


def _page(old: str = "stats_for_no_group", middle: str = "'old {{Q|1}}'") -> str:
    return _PAGE.replace("OLD", old).replace("MIDDLE", middle)


_BELOW = """
with recursive below as (
  select {0}::bigint as n union
  select c_custkey from customer join below on floor(c_custkey / 8) = below.n
  where c_custkey > 0) """

HAS_COLUMN = {
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
_SOURCES = "select 'd' || cast(doc_id as varchar) as entity_id, source as grp from documents"
_SUMS = {"has_p1": "P1", "taxed": "P1/P2", "sourced": "P1/S248"}

ORACLES = (
    {
        name: coverage(ORDERS, HOME, {"has": key}, threshold=20, no_group=True)
        for name, key in HAS_COLUMN.items()
    }
    | {
        name: coverage(DOCUMENTS, _SOURCES, {"has": key})
        for name, key in (
            ("coverage_label", "Len"),
            ("coverage_description", "Dde"),
            ("coverage_sitelink", "frwiki"),
        )
    }
    | DRILLS
    | {
        "select_entities": BIG_LINES,
        "select_entities_sql": sql(
            "select entity_id from f_claims where property = 'P3' and value = 'Q7'"
        ),
        "class_closure_set": _BELOW.format(1)
        + "select 'c' || cast(n as varchar) as class_id from below",
        "class_closure": _BELOW.format(3)
        + "select 'o' || cast(o_orderkey as varchar) as entity_id "
        "from orders join below on o_custkey = below.n",
        "select_by_path": _BELOW.format(3)
        + "select 'o' || cast(o_orderkey as varchar) as entity_id "
        "from orders join below on o_custkey = below.n",
        "select_by_path_choice": sql(_PATH_CHOICE),
        "detect_group_type_selected": sql(_KINDS, truthy_types=_TRUTHY_TYPES),
        "truthy_values": sql(
            "select entity_id, statement_id, rank, snak_type, value from truthy "
            "where property = 'P1'"
        ),
        "strip_prefix": sql(
            "select entity_id, value as local_id from f_claims where property = 'P3'"
        ),
        "label_fallback": sql("select entity_id, label from labels"),
        "detect_group_type": sql(
            "select property, case min(value_type) when 'item' then 'item' "
            "when 'time' then 'year' end as group_kind from f_claims "
            "where snak_type = 'value' group by property"
        ),
        "year_bin_floor": """
select cast(floor((o_orderkey % 400 - 150) / 10) * 10 as bigint) as start, count(*) as count
from orders group by 1""",
        "group_counts": coverage(ORDERS, HOME, threshold=450, totals=False),
        "group_counts_sitelink": coverage(DOCUMENTS, SITES),
        "path_grouping": coverage(
            ORDERS,
            "select distinct a.entity_id, b.value as grp from truthy a join truthy b "
            "on b.entity_id = a.value where a.property = 'P3' and b.property = 'P5'",
            {"has_p1": "P1"},
            no_group=True,
        ),
        "explicit_groups": coverage(
            ORDERS, HOME, {"has_p1": "P1"}, no_group=True, only="e.grp in ('Q1', 'Q2', 'Q3')"
        ),
        "sitelink_project_lookup": coverage(
            DOCUMENTS,
            SITES,
            {"has_fr": "frwiki"},
            only="e.grp in (select url from f_projects where code in ('frwiki', 'dewiki', 'xxwiki'))",
        ),
        "unknown_fold": coverage(ORDERS, edges("P9"), {"sourced": "P1/S*"}, body=_FOLD),
        "unknown_fold_many": coverage(ORDERS, edges("P1"), {"sourced": "P1/S*"}, body=_FOLD),
        "year_groups": coverage(
            CUSTOMERS, YEARS, {"has_p7": "P7", "has_p4": "P4"}, threshold=20
        ),
        "year_rebin": coverage(ORDERS, WIDE_YEARS, {"sourced": "P1/S248"}, body=_REBIN),
        "top_groups": coverage(ORDERS, HOME, limit=10, totals=False),
        "group_decorate": coverage(
            ORDERS,
            HOME,
            totals=False,
            body=f"select group_key, {_HIGHER} as higher_group, count from report",
        ),
        "group_link_id": coverage(
            ORDERS,
            HOME,
            totals=False,
            body="select group_key, 'Lists/' || group_key as group_link, count from report",
        ),
        "group_link_label": coverage(
            ORDERS,
            HOME,
            totals=False,
            body=f"select group_key, {_LINK} as group_link, count from report",
        ),
        "group_link_property": coverage(
            ORDERS,
            HOME,
            totals=False,
            body="select group_key, 'Lists/' || coalesce((select min(value) from truthy t "
            "where t.property = 'P8' and t.entity_id = group_key), group_key) as group_link, "
            "count from report",
        ),
        "label_coverage": coverage(
            DOCUMENTS, SITES, {"en": "Len", "fr": "Lfr", "mul": "Lmul"}, no_group=True
        ),
        "totals": coverage(BIG_LINES, HOME, body="select * from report where section = 2"),
        "totals_by_column": coverage(
            BIG_LINES, HOME, _SUMS, body="select * from report where section = 2"
        ),
        "no_group_total": coverage(
            BIG_LINES, HOME, no_group=True, body="select * from report where section = 1"
        ),
        "no_group_by_column": coverage(
            BIG_LINES, HOME, _SUMS, no_group=True, body="select * from report where section = 1"
        ),
        "coverage_report_long": report(_LONG),
        "coverage_report_wide": report(
            f"select section, {_KIND} as kind, group_key, case when section = 0 then "
            f"coalesce({_HIGHER}, '') end as higher_group, {_LINK} as group_link, count, "
            'c0 as "P1", c1 as "P1/P2", c2 as "P1/S*", c3 as "P1/S248" from report'
        ),
        "report_order": report(
            "select cast(row_number() over (order by section, count desc, group_key) as int) "
            "as place, section, group_key, count from report"
        ),
        "report_text_lines": report(
            f"select 'dashboard' as dashboard, 0 as place, '{_TABLE_HEAD}' as line union all "
            "select 'dashboard', row_number() over (order by section, count desc, group_key), "
            f"{_MARKUP_ROW} from report union all "
            "select 'dashboard', count(*) + 1, '|}\n' from report"
        ),
        "render_report": report(
            "select 'dashboard' as dashboard, '"
            + _TABLE_HEAD
            + f"' || string_agg({_MARKUP_ROW}, '' order by section, count desc, group_key) "
            "|| '|}\n' as report from report"
        ),
        "row_heading": sql(_HEADING),
        "higher_group_class": sql(_HIGHER_CELLS),
        "count_cell": coverage(ORDERS, HOME, no_group=True, body=_COUNT_CELLS),
        "multi_dashboard_report": sql(
            " union all ".join(
                multi(
                    name,
                    coverage(
                        selected, edge_sql, columns, threshold=threshold, no_group=no_group
                    ),
                    columns,
                )
                for name, selected, edge_sql, columns, threshold, no_group in _BATCH
            )
        ),
        "dashboards_as_data": _FLEET,
        "dashboard_outcomes": _OUTCOMES,
        "multi_dashboard_errors": (
            "select 'no values' as dashboard, 'no values for P99' as error "
            "union all select 'no groups', 'no groups found'"
        ),
        "member_lists_missing": coverage(ORDERS, HOME, totals=False, body=_LISTED),
        "member_lists": coverage(ORDERS, HOME, totals=False, body=_LIST_ROWS),
        "create_lists": "select 'lists' as dashboard, l.* from ("
        + coverage(ORDERS, HOME, totals=False, body=_LIST_ROWS)
        + ") l",
        "extract_dashboard_params": f"""
{_FIELDS}
union all
select doc_id, 'stats_for_no_group', '1' from documents where doc_id % 2 = 0
union all
select doc_id, 'row_no_group', '0' from documents where doc_id % 4 = 0""",
        "migrate_params": f"""
{_FIELDS}
union all
select doc_id, 'row_no_group', case when doc_id % 4 = 0 then '0' else '1' end
from documents where doc_id % 2 = 0""",
        "migrate_page_text": f"select doc_id as page, {_page('row_no_group')} as text from documents",
        "splice_report": "select doc_id as page, case when doc_id % 3 = 1 then "
        f"{_page()} else "
        + _page(middle="'costs $1 \\1 on page ' || doc_id")
        + " end as text from documents",
        "ingest_bindings": """
select c_custkey as document, c_name as name,
  case when c_acctbal > 0 then c_mktsegment end as segment
from customer where c_custkey % 7 <> 0
union all
select c_custkey, c_name || '-again', null from customer where c_custkey % 7 <> 0""",
        "ingest_result_files": """
select c_name as name, case when c_acctbal > 0 then c_mktsegment end as segment
from customer where c_custkey % 7 <> 0
union all
select c_name || '-again', null from customer where c_custkey % 7 <> 0""",
    }
)
