"""Property paths in selectors: ``P31/P279* Q5`` and the like, compiled into joins."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.facts import Facts, has_value
from factspan.operators.selection import truthy, truthy_edges
from factspan.operators.tables import written
from factspan.spec import SpecError

# Levels that are searched one by one before paths are doubled.
LEVELS = 6


@dataclass(frozen=True)
class Step:
    """Statements of one property, from entity to value; ``back`` from value to entity."""

    property: str
    back: bool = False


@dataclass(frozen=True)
class Chain:
    parts: tuple


@dataclass(frozen=True)
class Choice:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    """A path any number of times from ``least`` (0 or 1) on; at most once if ``once``."""

    path: object
    least: int
    once: bool = False


Path = Step | Chain | Choice | Repeat


@dataclass(frozen=True)
class Condition:
    """Entities from which ``path`` leads to ``end``, or anywhere if that is None."""

    path: Path
    end: str | None


# Text form

_TOKEN = re.compile(r"\s*(?:(?:wdt:)?(P[0-9]+)|wd:(\w+)|(\w+)|(\?\w*|\[\])|([/|^*+();.]))")
_START = re.compile(r"[\s(^]*(?:wdt:)?P[0-9]+\b")


def is_path_text(text: str) -> bool:
    """Whether a selector is a path pattern and not SQL."""
    return _START.match(text) is not None


def _tokens(text: str) -> list[str]:
    found, place = [], 0
    text = text.rstrip()
    while place < len(text):
        token = _TOKEN.match(text, place)
        if token is None:
            raise SpecError(f"cannot read selector {text!r} at {text[place:]!r}")
        found.append(next(g for g in token.groups() if g))
        place = token.end()
    return found


class _Reader:
    """Reads tokens by the rules of a path: choices of chains of repeated steps."""

    def __init__(self, text: str):
        self.text, self.tokens = text, _tokens(text)

    def next(self) -> str | None:
        return self.tokens[0] if self.tokens else None

    def take(self, *wanted: str) -> str | None:
        return self.tokens.pop(0) if self.tokens and self.tokens[0] in wanted else None

    def fail(self) -> SpecError:
        return SpecError(f"cannot read selector {self.text!r} at {' '.join(self.tokens)!r}")

    def choice(self) -> Path:
        parts = [self.chain()]
        while self.take("|"):
            parts.append(self.chain())
        return parts[0] if len(parts) == 1 else Choice(tuple(parts))

    def chain(self) -> Path:
        parts = [self.repeated()]
        while self.take("/"):
            parts.append(self.repeated())
        return parts[0] if len(parts) == 1 else Chain(tuple(parts))

    def repeated(self) -> Path:
        back = self.take("^") is not None
        if self.take("("):
            path = self.choice()
            if not self.take(")"):
                raise self.fail()
        elif re.fullmatch(r"P[0-9]+", self.next() or ""):
            path = Step(self.tokens.pop(0))
        else:
            raise self.fail()
        # A question mark that stands alone is a repetition, one with a name a variable.
        sign = self.take("*", "+", "?")
        if sign:
            path = Repeat(path, 1 if sign == "+" else 0, once=sign == "?")
        return inverse(path) if back else path

    def conditions(self) -> list[Condition]:
        found = []
        while self.tokens:
            path, end = self.choice(), self.next()
            if end is None or end in set("/|^*+();."):
                raise self.fail()
            self.tokens.pop(0)
            found.append(Condition(path, None if end.startswith(("?", "[")) else end))
            if self.tokens and not self.take(";", "."):
                raise self.fail()
        if not found:
            raise self.fail()
        return found


def conditions_from_text(text: str) -> list[Condition]:
    """Read ``P31/P279* Q5 ; P17 Q30``: conditions that all hold, each a path and its end.

    Paths know ``/``, ``|``, ``^`` (backwards), ``*``, ``+``, ``?`` and parentheses; an
    end is an id, or a variable or ``[]`` for any. ``wdt:`` and ``wd:`` may be there.
    """
    return _Reader(text).conditions()


def inverse(path: Path) -> Path:
    """The path in the other direction."""
    if isinstance(path, Step):
        return Step(path.property, not path.back)
    if isinstance(path, Chain):
        return Chain(tuple(inverse(p) for p in reversed(path.parts)))
    if isinstance(path, Choice):
        return Choice(tuple(inverse(p) for p in path.parts))
    return Repeat(inverse(path.path), path.least, path.once)


# Evaluation, from the ends back to the starts


def _edges(facts: Facts, step: Step) -> DataFrame:
    """Distinct (start, end) of a step."""
    names = ("end", "start") if step.back else ("start", "end")
    return truthy_edges(facts, step.property).toDF(*names).select("start", "end")


def _may_be_empty(path: Path) -> bool:
    """Whether the path has a form of no steps, which leads from each node to itself."""
    if isinstance(path, Chain):
        return all(map(_may_be_empty, path.parts))
    if isinstance(path, Choice):
        return any(map(_may_be_empty, path.parts))
    return isinstance(path, Repeat) and (path.least == 0 or _may_be_empty(path.path))


def _properties(path: Path) -> set[str]:
    if isinstance(path, Step):
        return {path.property}
    parts = (path.path,) if isinstance(path, Repeat) else path.parts
    return set().union(*map(_properties, parts))


def _nodes(facts: Facts, path: Path) -> DataFrame:
    """All nodes that statements of the path's properties start or end at."""
    rows = truthy(facts, sorted(_properties(path))).filter(has_value())
    return written(rows.select(F.explode(F.array("entity_id", "value")).alias("end")).distinct())


def pairs(facts: Facts, path: Path, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (start, end) of a path, over the whole graph.

    A path of no steps leads from each of ``nodes`` to itself; these are all that
    statements of the path's properties start or end at, unless given.
    """
    if isinstance(path, Step):
        return _edges(facts, path)
    if nodes is None:
        nodes = _nodes(facts, path)
    if isinstance(path, Choice):
        return reduce(DataFrame.union, [pairs(facts, p, nodes) for p in path.parts]).distinct()
    if isinstance(path, Chain):
        found = pairs(facts, path.parts[-1], nodes)
        for part in reversed(path.parts[:-1]):
            step = pairs(facts, part, nodes).withColumnRenamed("end", "via")
            found = step.join(found.withColumnRenamed("start", "via"), "via")
            found = found.select("start", "end").distinct()
        return found
    inner = written(pairs(facts, path.path, nodes))
    return _repeated(path, inner, nodes)


def _repeated(path: Repeat, inner: DataFrame, ends: DataFrame) -> DataFrame:
    """Distinct (start, end) of a repeated path to some ``end``s, given its ``inner`` pairs."""
    found = inner.join(ends, "end", "left_semi") if path.once else reaching(inner, ends)
    found = found.select("start", "end")
    if _may_be_empty(path):
        found = found.union(ends.select(F.col("end").alias("start"), "end")).distinct()
    return found


def reaching(edges: DataFrame, ends: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Distinct (start, end): what leads to each of ``ends`` by one or more ``edges``.

    The first levels are searched one by one, which costs no more than what is found. If
    there are more, jumps of 1, 2, 4, ... edges are put before all that is known, so a
    depth of a thousand takes about ten rounds. Each round is written, so lineage stays
    short; cycles end the search.
    """
    edges = written(edges.select("start", "end"))
    known = written(_reaching_or_self(edges, ends, levels))
    # An end leads to itself if an edge from it leads to something that reaches it.
    onward = edges.join(ends.withColumnRenamed("end", "start"), "start", "left_semi")
    onward = onward.select(F.col("start").alias("self"), F.col("end").alias("start"))
    circle = onward.join(known.filter("start <> end"), "start").filter("self = end")
    circle = circle.select(F.col("self").alias("start"), "end")
    loops = edges.filter("start = end").join(ends, "end", "left_semi").select("start", "end")
    return known.filter("start <> end").union(circle.union(loops).distinct())


def _reaching_or_self(edges: DataFrame, ends: DataFrame, levels: int) -> DataFrame:
    step = edges.withColumnRenamed("end", "via")
    frontier = ends.select(F.col("end").alias("start"), "end")
    found = [frontier]
    for _ in range(levels):
        further = step.join(frontier.withColumnRenamed("start", "via"), "via")
        further = further.select("start", "end").distinct()
        known = reduce(DataFrame.union, found)
        frontier = written(further.join(known, ["start", "end"], "left_anti"))
        if frontier.isEmpty():
            return known
        found.append(frontier)
    reached = written(reduce(DataFrame.union, found))
    jumps, count = step, reached.count()
    while True:
        onward = jumps.join(reached.withColumnRenamed("start", "via"), "via")
        reached = written(reached.union(onward.select("start", "end")).distinct())
        before, count = count, reached.count()
        if count == before:
            return reached
        second = jumps.toDF("middle", "via")
        twice = jumps.withColumnRenamed("via", "middle").join(second, "middle")
        jumps = written(twice.select("start", "via").distinct())


def walked_back(facts: Facts, path: Path, ends: DataFrame) -> DataFrame:
    """(tag, node, times): where paths to the tagged ``ends`` (tag, node, times) start.

    Chains and choices keep how many ways lead to an end; a repeated path counts once
    for each pair of start and end.
    """
    if isinstance(path, Chain):
        return reduce(lambda rows, part: walked_back(facts, part, rows), reversed(path.parts), ends)
    if isinstance(path, Choice):
        parts = [walked_back(facts, part, ends) for part in path.parts]
        return _counted(reduce(DataFrame.union, parts))
    if isinstance(path, Step):
        relation = _edges(facts, path)
    else:
        ends = written(ends)
        inner = pairs(facts, path.path)
        relation = _repeated(path, inner, ends.select(F.col("node").alias("end")).distinct())
    found = relation.join(ends.withColumnRenamed("node", "end"), "end")
    return _counted(found.select("tag", F.col("start").alias("node"), "times"))


def _counted(rows: DataFrame) -> DataFrame:
    # Grouping takes a null tag (paths to anywhere) as a value of its own.
    return rows.groupBy("tag", "node").agg(F.sum("times").alias("times"))


def entities_to_ends(facts: Facts, path: Path, ends: Iterable[str | None]) -> DataFrame:
    """(end, entity_id, times): one search for all ``ends``; None asks for paths to anywhere.

    Paths to anywhere end at nodes that statements of the path's properties have.
    """
    ends = list(dict.fromkeys(ends))
    one = F.lit(1).cast("long").alias("times")
    parts = []
    named = [(end,) for end in ends if end is not None]
    if named:
        rows = facts.spark.createDataFrame(named, "tag string")
        parts.append(rows.select("tag", F.col("tag").alias("node"), one))
    if None in ends:
        values = _nodes(facts, path).withColumnRenamed("end", "node")
        parts.append(values.select(F.lit(None).cast("string").alias("tag"), "node", one))
    found = walked_back(facts, path, reduce(DataFrame.union, parts))
    return found.select(F.col("tag").alias("end"), F.col("node").alias("entity_id"), "times")


def all_of(parts: Iterable[DataFrame], keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` are in all parts, with the product of their ``times``."""
    rows = None
    for part in parts:
        if rows is None:
            rows = part.select(*keys, "times")
            continue
        both = rows.join(part.select(*keys, F.col("times").alias("_more")), keys)
        rows = both.select(*keys, (F.col("times") * F.col("_more")).alias("times"))
    return rows


def select_by_path(facts: Facts, text: str) -> DataFrame:
    """(entity_id, times) of the entities that a path selector picks."""
    conditions = conditions_from_text(text)
    return all_of([entities_to_ends(facts, c.path, [c.end]) for c in conditions], ["entity_id"])
