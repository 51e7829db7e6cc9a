"""Entity selection, best-rank values, paths, class closure, labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.facts import Facts, has_value
from factspan.operators.tables import written


def select_entities(facts: Facts, selector: DataFrame | str) -> DataFrame:
    """The selected entities, as often as the selector yields them.

    A text is SQL over the fact tables or a path pattern, see :mod:`factspan.operators.paths`.
    """
    if isinstance(selector, str):
        from factspan.operators import paths

        if paths.is_path_text(selector):
            rows = paths.select_by_path(facts, selector)
            again = F.explode(F.sequence(F.lit(1).cast("long"), "times"))
            return rows.select("entity_id", again).select("entity_id")
        named = {k: v for k, v in facts.tables().items() if "{%s}" % k in selector}
        selector = facts.spark.sql(selector, **named)
    return selector.select(F.col("entity_id").cast("string").alias("entity_id"))


def entities_with(facts: Facts, prop: str, value: str) -> DataFrame:
    """Entities whose best-rank ``prop`` is ``value``."""
    return truthy(facts, [prop]).filter(F.col("value") == value).select("entity_id")


def truthy(facts: Facts, properties: Sequence[str] | None = None) -> DataFrame:
    """Statements of the best rank: preferred ones, else normal ones.

    Normal statements are kept by an anti-join against the few
    (entity, property) pairs with a preferred one, so no entity's statements
    have to meet in one task.
    """
    claims = facts.claims
    if properties is not None:
        claims = claims.filter(F.col("property").isin(*properties))
    preferred = claims.filter(F.col("rank") == "preferred")
    outranked = preferred.select("entity_id", "property").distinct()
    normal = claims.filter(F.col("rank") == "normal")
    kept = normal.join(outranked, ["entity_id", "property"], "left_anti")
    return preferred.unionByName(kept)


def truthy_edges(facts: Facts, prop: str, column: str = "value") -> DataFrame:
    """Distinct (entity_id, value) of a property, known or unknown values."""
    rows = truthy(facts, [prop]).filter(has_value())
    return rows.select("entity_id", F.col(column).cast("string").alias("value")).distinct()


def follow_path(
    facts: Facts,
    path: Sequence[str],
    column: str = "value",
    start: Facts | None = None,
) -> DataFrame:
    """Distinct (entity_id, value) at the end of a chain of properties.

    ``column`` is what the last step yields; ``start`` has the facts of the
    first step, where they are cut down to some entities.
    """
    start = start or facts
    *inner, last = path
    if not inner:
        return truthy_edges(start, last, column)
    edges = truthy_edges(start, inner[0])
    steps = [*inner, last]
    for place, prop in enumerate(steps[1:], start=1):
        ends = column if place == len(inner) else "value"
        step = truthy_edges(facts, prop, ends).select(
            F.col("entity_id").alias("_via"), F.col("value").alias("_next")
        )
        edges = edges.withColumnRenamed("value", "_via").join(step, ["_via"], "inner")
        edges = edges.select("entity_id", F.col("_next").alias("value")).distinct()
    return edges


def among(facts: Facts, ids: DataFrame) -> Facts:
    """Facts about the entities of ``ids`` only; references stay whole."""
    tables = {
        name: getattr(facts, name).join(ids, "entity_id", "left_semi")
        for name in ("claims", "terms", "sitelinks")
    }
    return replace(facts, **tables)


def class_closure(facts: Facts, root: str, subclass_of: str) -> DataFrame:
    """``root`` and everything below it, as a set of ``class_id``."""
    from factspan.operators import paths

    top = facts.spark.createDataFrame([(root,)], "end string")
    edges = truthy_edges(facts, subclass_of).toDF("start", "end")
    below = paths.reaching(edges, top).select(F.col("start").alias("class_id"))
    return below.union(top).distinct()


def entities_of_class(
    facts: Facts, root: str, instance_of: str, subclass_of: str
) -> DataFrame:
    """Entities of ``root`` or a class below it; one row per class edge."""
    closure = class_closure(facts, root, subclass_of)
    edges = truthy_edges(facts, instance_of).withColumnRenamed("value", "class_id")
    found = edges.join(closure, ["class_id"], "inner")
    return found.select("entity_id")


def labels(facts: Facts, lang: str = "en") -> DataFrame:
    """(entity_id, label) in ``lang``, else in the language-neutral ``mul``."""
    wanted = [lang] if lang == "mul" else [lang, "mul"]
    own = F.min(F.when(F.col("lang") == lang, F.col("text")))
    shared = F.min(F.when(F.col("lang") == "mul", F.col("text")))
    return (
        facts.terms.filter((F.col("kind") == "label") & F.col("lang").isin(wanted))
        .groupBy("entity_id")
        .agg(F.coalesce(own, shared).alias("label"))
    )


def with_labels(
    rows: DataFrame, facts: Facts, columns: Sequence[str], lang: str = "en"
) -> DataFrame:
    """Add ``<column>_label`` for each id column; only labels of these ids are read.

    The ids of all columns are looked up as rows of one table and folded back.
    """
    rows = written(rows)
    # Places in a written table, so they are the same whenever a task is run again.
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    ids = F.array(*[F.col(c).cast("string") for c in columns])
    long = placed.select("*", F.posexplode(ids).alias("_which", "_id"))
    wanted = rows.select(F.explode(ids).alias("entity_id")).distinct()
    terms = facts.terms.join(wanted, "entity_id", "left_semi")
    known = labels(replace(facts, terms=terms), lang).withColumnsRenamed(
        {"entity_id": "_id", "label": "_label"}
    )
    names = ["entity_label" if c == "entity_id" else f"{c}_label" for c in columns]
    folded = [
        F.max(F.when(F.col("_which") == i, F.col("_label"))).alias(name)
        for i, name in enumerate(names)
    ]
    met = long.join(known, "_id", "left").groupBy("_place", *rows.columns).agg(*folded)
    order = [c for c in rows.columns if c not in columns]
    for column, name in zip(columns, names, strict=True):
        order += [column, name]
    return met.select(*order)
