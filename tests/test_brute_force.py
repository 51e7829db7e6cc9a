"""Random graphs against a reading of the rules entity by entity."""

import random

import pytest

from factspan import Dashboard, GroupBy, Qualifier, Referenced, columns_from_text
from factspan.plans.coverage import Coverage
from factspan.spec import POOR_REFERENCE_PROPERTIES, Property, follows_group
from tests.graph import Graph, bag

KEYS = (
    "P1,P1/P2,P1/Q1/P2,P1/?grouping/P2,P1/S*,P1/S!,P1/S248,P1/S248=Q1,P1/S248;S854=Q2,"
    "P1/S248+S854,P1/Q1/S*,P1/P2/S*,P1/Q1/P2/S248,P1/?grouping/S*,P1/?grouping/S248"
)


def random_graph(seed):
    rng = random.Random(seed)
    g = Graph()
    ids = [f"Q{i}" for i in range(3)]
    for i in range(25):
        entity = f"e{i}"
        for _ in range(rng.randint(0, 2)):
            rank = rng.choice(["preferred", "normal", "normal", "deprecated"])
            g.claim(entity, "P17", rng.choice(ids), rank)
        for _ in range(rng.randint(0, 3)):
            snak = rng.choice(["value"] * 6 + ["somevalue", "novalue"])
            value = rng.choice(ids) if snak == "value" else None
            quals = [("P2", rng.choice(["x", None]))] if rng.random() < 0.5 else []
            refs = [
                [
                    (p, rng.choice(["Q1", "Q2"]))
                    for p in ("P248", "P854", "P143")
                    if rng.random() < 0.4
                ]
                for _ in range(rng.choice([0, 1, 1, 2]))
            ]
            g.claim(entity, "P1", value, "normal", snak, quals=quals, refs=refs)
    chosen = [f"e{rng.randrange(30)}" for _ in range(40)]
    return g, chosen


class Reader:
    """Reads the rows of a graph the slow way."""

    def __init__(self, g):
        self.claims = g.rows["claims"]
        self.quals = {(s, p) for s, p, snak, _ in g.rows["qualifiers"] if snak != "novalue"}
        self.nodes = {}
        for statement, node in g.rows["reference_nodes"]:
            self.nodes.setdefault(statement, []).append(node)
        self.snaks = {}
        for node, prop, value in g.rows["reference_snaks"]:
            self.snaks.setdefault(node, set()).add((prop, value))

    def groups(self, entity):
        rows = [c for c in self.claims if c[0] == entity and c[1] == "P17"]
        best = [c for c in rows if c[3] == "preferred"] or [c for c in rows if c[3] == "normal"]
        return {c[6] for c in best}

    def passes(self, node, check):
        snaks = self.snaks.get(node, set())
        props = {p for p, _ in snaks}
        if check.mode == "any":
            return True
        if check.mode == "good":
            return not props & set(POOR_REFERENCE_PROPERTIES)
        found = [(p in props) if v is None else ((p, v) in snaks) for p, v in check.parts]
        return all(found) if check.mode == "all_of" else any(found)

    def has(self, entity, column, group=None):
        if follows_group(column) and group is None:
            values = {c[6] for c in self.claims if c[0] == entity and c[6]}
            return any(self.has(entity, column, value) for value in values)
        rows = [c for c in self.claims if c[0] == entity and c[1] == column.property]
        if isinstance(column, Property):
            return bool(rows)
        if column.value:
            wanted = group if follows_group(column) else column.value
            rows = [c for c in rows if c[4] != "novalue" and c[6] == wanted]
        if column.qualifier:
            rows = [c for c in rows if (c[2], column.qualifier) in self.quals]
        if isinstance(column, Qualifier):
            return any(c[4] != "novalue" for c in rows)
        assert isinstance(column, Referenced)
        return bool(rows) and all(
            any(self.passes(n, column.check) for n in self.nodes.get(c[2], [])) for c in rows
        )


@pytest.mark.parametrize("seed", range(3))
def test_coverage_of_random_graphs(spark, seed):
    g, chosen = random_graph(seed)
    board = Dashboard(
        bag(spark, *chosen),
        GroupBy(("P17",), "item"),
        columns_from_text(KEYS),
        threshold=1,
        row_no_group=True,
    )
    plan = Coverage(g.facts(spark), board)
    found = {r.group_key: (r["count"], *[r[c] for c in plan.cells]) for r in plan.lines().collect()}

    reader, columns = Reader(g), board.columns

    def row(entities, group=None):
        cells = [sum(reader.has(e, c, group) for e in entities) for c in columns]
        return (len(entities), *cells)

    wanted = {"": row(chosen), "None": row([e for e in chosen if not reader.groups(e)])}
    for group in {x for e in chosen for x in reader.groups(e)}:
        wanted[group] = row(sorted({e for e in chosen if group in reader.groups(e)}), group)
    assert found == wanted
