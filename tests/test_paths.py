"""Path selectors against a walk over small graphs, one pair at a time."""

import random
from collections import Counter

import pytest

from factspan.operators import paths
from factspan.operators.paths import Chain, Choice, Repeat, Step, conditions_from_text, is_path_text
from factspan.operators.selection import class_closure, select_entities
from factspan.spec import SpecError
from tests.graph import Graph


def relation(path, edges, nodes):
    """Bag of (start, end) of a path."""
    if isinstance(path, Step):
        found = Counter((a, b) for p, a, b in edges if p == path.property)
        return Counter({(b, a): n for (a, b), n in found.items()}) if path.back else found
    if isinstance(path, Choice):
        return sum((relation(p, edges, nodes) for p in path.parts), Counter())
    if isinstance(path, Chain):
        found = relation(path.parts[0], edges, nodes)
        for part in path.parts[1:]:
            longer = Counter()
            for (a, b), n in found.items():
                for (c, d), m in relation(part, edges, nodes).items():
                    if b == c:
                        longer[a, d] += n * m
            found = longer
        return found
    inner = set(relation(path.path, edges, nodes))
    found = set(inner)
    while not path.once:
        more = found | {(a, d) for a, b in found for c, d in inner if b == c}
        if more == found:
            break
        found = more
    if path.least == 0:
        found |= {(n, n) for n in nodes}
    return Counter(found)


def picked(text, edges, nodes):
    chosen = None
    for condition in conditions_from_text(text):
        ends = Counter()
        every = nodes | ({condition.end} if condition.end else set())
        for (a, b), n in relation(condition.path, edges, every).items():
            if condition.end in (None, b):
                ends[a] += n
        chosen = ends if chosen is None else Counter({k: n * ends[k] for k, n in chosen.items()})
    return sorted(chosen.elements())


TEXTS = {
    6: ["wdt:P1/wdt:P2* wd:n3", "^(P1/P2?) n2", "P1 [] ; P2+ n6", "P1|P2 n1", "P2* elsewhere", "P1/P2? []"],
    0: ["(P1|^P2)+ n0", "((P1/P2?)+/P2)* n1", "P2/(P1/P2?)+ leaf1", "P1/(P2?)+ leaf1"],
}


@pytest.mark.parametrize("levels", [0, 6])
def test_paths_of_random_graphs(spark, monkeypatch, levels):
    # No level searched one by one: all by doubling.
    monkeypatch.setattr(paths.reaching, "__defaults__", (levels,))
    draw = random.Random(11)
    g, edges = Graph(), set()
    for _ in range(22):
        p, a, b = draw.choice(["P1", "P2"]), f"n{draw.randrange(8)}", f"n{draw.randrange(8)}"
        if (p, a, b) not in edges:
            edges.add((p, a, b))
            g.claim(a, p, b)
    for i in range(3):  # nodes that have no statement of P2
        edges.add(("P1", f"n{i}", f"leaf{i}"))
        g.claim(f"n{i}", "P1", f"leaf{i}")
    g.claim("n0", "P1", "n7", rank="deprecated")
    facts = g.facts(spark)
    # Nodes of the graph as a zero-length path to anywhere sees them.
    nodes = {x for _, a, b in edges for x in (a, b)}
    for text in TEXTS[levels]:
        found = sorted(r.entity_id for r in select_entities(facts, text).collect())
        assert found == picked(text, edges, nodes), text


def test_a_deep_chain_and_a_cycle(spark, monkeypatch):
    g = Graph()
    for i in range(1000):
        g.claim(f"c{i + 1}", "P279", f"c{i}")
    g.claim("c0", "P279", "c1000")  # closes the circle
    g.claim("e", "P31", "c1000")
    facts = g.facts(spark)
    rounds = []
    real = paths.written
    monkeypatch.setattr(paths, "written", lambda rows: rounds.append(1) or real(rows))
    found = select_entities(facts, "wdt:P31/wdt:P279* wd:c0")
    assert [r.entity_id for r in found.collect()] == ["e"]
    # Six levels, then about ten rounds of two tables each.
    assert len(rounds) < 40
    assert class_closure(facts, "c7", "P279").count() == 1001


def test_texts():
    assert is_path_text("wdt:P31/wdt:P279* wd:Q7889") and is_path_text("(^P1|P2) Q5")
    assert not is_path_text("select entity_id from {claims} where property = 'P31'")
    assert conditions_from_text("P1/^(P2|P3)+ Q5;P4 ?v") == [
        paths.Condition(
            Chain((Step("P1"), Repeat(Choice((Step("P2", True), Step("P3", True))), 1))), "Q5"
        ),
        paths.Condition(Step("P4"), None),
    ]
    for bad in ("P1", "P1/ Q5", "(P1 Q5", "P1 Q5 Q6", "P1 * Q5 |", "P1 'x'", "P1 Q5 ;; P2 Q6"):
        with pytest.raises(SpecError):
            conditions_from_text(bad)


def test_no_statements(spark):
    facts = Graph().facts(spark)
    assert select_entities(facts, "P1/P2* Q5").collect() == []
    # A path of no steps leads from the end to itself.
    assert [r.entity_id for r in select_entities(facts, "P2* Q5").collect()] == ["Q5"]
