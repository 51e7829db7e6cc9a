"""Mixing sources to target weights, with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspan.llm.common import written

# Hexadecimal digits of a key that name its range: 65,536 ranges a source.
_RANGE_DIGITS = 4
# Equal rows that one task puts out.
_COPIES = 4096
_SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    single = F.trim(F.regexp_replace(text, _SPACE, " "))
    gaps = F.length(single) - F.length(F.replace(single, F.lit(" ")))
    return F.coalesce(F.when(single == "", 0).otherwise(gaps + 1), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], percent: int, most: int) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Weights go round the sources by code point, null last. They share ``percent``
    of all sizes; a source stops at ``most`` times its size and the others share
    what it leaves. With sources in order of size per weight, those up to some
    place stop, and the first place whose level the next source does not reach
    settles all targets, so no repetition is needed.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    ratio = F.col("cap") / F.col("weight")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * percent / 100
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0.0)
    )
    placed = capped.withColumn("ratio", ratio).withColumn("share", left / weights_left)
    level = F.max(F.when(F.col("share") <= F.col("ratio"), F.col("share"))).over(everything)
    target = F.least(
        F.col("cap").cast("double"),
        F.coalesce(level * F.col("weight"), F.col("cap").cast("double")),
    )
    return placed.select("source", "source_size", target.alias("target"))


def mixed_to_weights(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    percent: int = 150,
    most: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``.

    ``size`` is the number of words, ``target`` the words its source is to give (see
    :func:`source_targets`), ``taken`` the words of the row that the mix takes,
    repeats counted. In each source, rows stand in the order of a hash of their id;
    the mix takes them from the start until the target's whole part is reached, and
    starts again if the source runs out (``most`` times at most). The row where
    the budget ends gives a part of its words.

    The order is found without sorting a source in one task: the first digits of
    the hash name a range, sums of the ranges give each its offset, and rows are
    sorted within their range alone. Rows of one id and size, or without id and of one
    size, are one row with a count until the end, when tasks of their own put them out
    again: however many there are, a range stays small.

    Null texts have no words. Null sources are one source, the last. Rows without
    doc_id and repeated rows are rows like others. Other columns are ignored; an
    empty table gives an empty result.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text").cast("string")).alias("size"), key.alias("key")
    )
    rows = rows.withColumn("part", F.substr("key", F.lit(1), F.lit(_RANGE_DIGITS)))
    equal = rows.groupBy("source", "part", "key", "doc_id", "size")
    rows = written(equal.agg(F.count(F.lit(1)).alias("copies")))
    words = F.col("size") * F.col("copies")
    ranges = rows.groupBy("source", "part").agg(F.sum(words).alias("words"))
    ranges = written(ranges)
    sizes = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, percent, most)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    met = offsets.alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source"))
    places = met.select("o.source", "part", "offset", "source_size", "target")
    joined = rows.alias("r").join(
        places.alias("p"), F.expr("r.part = p.part and r.source <=> p.source")
    )
    within = (
        Window.partitionBy("r.source", "r.part")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("offset") + F.coalesce(F.sum(words).over(within), F.lit(0))
    names = ["doc_id", "source", "size", "source_size", "target"]
    placed = joined.select(
        "doc_id", "r.source", "size", "source_size", "target", "copies", start.alias("start")
    )
    step = F.lit(_COPIES).cast("long")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, step))
    many = placed.filter(F.col("copies") > step).withColumn("at", at).repartition("doc_id", "size", "at")
    many = many.select(
        *names,
        F.least(step, F.col("copies") - F.col("at")).alias("copies"),
        (F.col("start") + F.col("at") * F.col("size")).alias("start"),
    )
    every = placed.filter(F.col("copies") <= step).unionByName(many)
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    every = every.withColumn("copy", copy)
    every = every.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    budget = F.floor("target")
    taken = F.lit(0)
    for epoch in range(most):
        rest = budget - F.col("source_size") * epoch - F.col("start")
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return every.select(*names, taken.cast("long").alias("taken"))
