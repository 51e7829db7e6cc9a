"""Where long windows of a text also occur in others, by winnowed anchors.

A window is a run of ``length`` symbols (words or bytes) of one text. The anchor
of a window is its least range of ``k`` symbols by hash, the leftmost of equal
ones, so equal windows have equal anchors at equal places, and neighbouring
windows mostly share their anchor. An occurrence is an anchor with its run of
windows. Occurrences meet by anchor:

* those with equal surroundings (all symbols of their windows) form a class and
  are decided by counts and least ranks alone, however many they are;
* an anchor with a few classes goes with their symbols to a task, where an engine
  compares them;
* an anchor with more classes than fit is split: their symbols are anchored anew
  with a longer k, until windows themselves are the keys.

So no group has to fit into a task, and the result is exact on every path (up to
chance collisions of 64-bit hashes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.common import (
    LARGEST,
    Rolling,
    likely,
    mixed,
    signed,
    sliced,
    sliding_min,
    with_maybe,
    written,
)

# Rows that a class which is broadcast has at least.
HOT = 1000

# Classes of one anchor that a task compares; anchors with more are split.
MOST_CLASSES = 64
# Classes that a task gets in all.
BLOCK_CLASSES = 1024
# Bytes of texts and windows that a task looks at in one go, as each byte may take
# a dozen 64-bit numbers; longer texts go in overlapping parts.
PART = 1 << 20

# (symbols, ends): the symbols of some units in a row, and where each unit ends.
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Kind:
    """What the symbols are, and how the classes of an anchor are compared.

    ``symbols`` reads texts; ``stored`` reads what ``store(texts, symbols, starts,
    stops)`` made of ranges of them.
    ``engine(rows, length, k, first)`` gets the classes of some anchors and
    yields (row, start, n): runs of windows that occur elsewhere.
    """

    symbols: Symbols
    store: Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray], list[bytes]]
    stored: Symbols
    engine: Callable


def levels(length: int) -> list[int]:
    """Lengths of anchors: of the first try, of split ones, and of whole windows."""
    return sorted({max(1, length * 2 // 5), max(1, length - max(1, length // 12)), length})


def anchors(symbols: np.ndarray, ends: np.ndarray, k: int, length: int) -> dict[str, np.ndarray]:
    """Occurrences in some units: unit, start, n, off, anchor, surroundings."""
    rolling = Rolling(symbols)
    counts = np.maximum(np.diff(ends) - length + 1, 0)
    if not counts.sum():
        return {}
    hashes = rolling.every(k)
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    places = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min((hashes >> bits << bits) | places, length - k + 1)
    unit = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(counts.sum()) + np.repeat(ends[:-1] - np.cumsum(counts) + counts, counts)
    chosen = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (unit[1:] != unit[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(starts)))
    start, place = starts[at], chosen[at]
    around = rolling.ranges(start, start + n + length - 1)
    off = place - start
    return {
        "unit": unit[at],
        "start": start - ends[:-1][unit[at]],
        "n": n,
        "off": off,
        "anchor": signed(hashes[place]),
        "around": signed(mixed(around + off.astype(np.uint64))),
    }


def _parts(symbols: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple]:
    """The units as (symbols, ends, first unit, offset); very long ones in parts."""
    sizes = np.diff(ends)
    if not len(sizes):
        return
    if sizes.max(initial=0) <= PART:
        yield symbols, ends, 0, 0
        return
    for unit, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        for offset in range(0, max(1, b - a), PART):
            part = symbols[a + offset : min(b, a + offset + PART + length - 1)]
            yield part, np.array([0, len(part)]), unit, offset


_OCCURRENCE = (
    "uid1 long, uid2 long, rank long, weight long, "
    "start int, n int, off int, anchor long, around long"
)


def _occurrences(units: DataFrame, symbols: Symbols, k: int, length: int) -> DataFrame:
    """Anchors of units (uid1, uid2, rank, weight, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _OCCURRENCE.split(", ")]
        for whole in batches:
            for batch in sliced(whole, "content", PART):
                flat, ends = symbols(batch.column("content"))
                for part, cuts, unit, offset in _parts(flat, ends, length):
                    found = anchors(part, cuts, k, length)
                    if not found:
                        continue
                    rows = pa.array(found["unit"] + unit)
                    found["start"] = found["start"] + offset
                    given = [batch.column(c).take(rows) for c in names[:4]]
                    own = [pa.array(found[c].astype(np.int32)) for c in ("start", "n", "off")]
                    keys = [pa.array(found[c]) for c in ("anchor", "around")]
                    yield pa.RecordBatch.from_arrays([*given, *own, *keys], names)

    return units.mapInArrow(run, _OCCURRENCE)


def _contents(units: DataFrame, wanted: DataFrame, kind: Kind, raw: bool, length: int) -> DataFrame:
    """The classes in ``wanted`` with their symbols, read from a unit that has them."""
    keys = ["uid1", "uid2"]
    per_unit = wanted.groupBy(keys).agg(
        F.collect_list(F.struct("start", "n", "off", "anchor", "around", "low", "total")).alias("c")
    )
    near = likely(units, [F.col(c) for c in keys], wanted.select(keys))
    joined = near.select(*keys, "content").join(per_unit, keys).select("content", "c")
    read = kind.stored if raw else kind.symbols
    schema = "anchor long, around long, n int, off int, rank long, weight long, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "content", PART):
                flat, ends = read(batch.column("content"))
                lists = batch.column("c")
                classes = lists.flatten()
                of = np.repeat(
                    np.arange(batch.num_rows),
                    pc.list_value_length(lists).to_numpy(zero_copy_only=False),
                )
                get = lambda name: classes.field(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                begin = ends[:-1][of] + get("start")
                stop = begin + get("n") + length - 1
                kept = kind.store(batch.column("content"), flat, begin, stop)
                names = ("anchor", "around", "n", "off", "low", "total")
                columns = [classes.field(name) for name in names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(kept, pa.binary())],
                    ["anchor", "around", "n", "off", "rank", "weight", "content"],
                )

    return joined.mapInArrow(run, schema)


def _compared(classes: DataFrame, kind: Kind, k: int, length: int, first: bool) -> DataFrame:
    """(anchor, around, at, n): runs of windows of a class that another class has."""
    blocks = max(1, -(-classes.count() // BLOCK_CLASSES))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    # A given number of tasks, as they have much to do for few bytes.
    dealt = dealt.repartition(max(1, blocks // 4), "block")

    def run(table: pa.Table) -> pa.Table:
        rows, at, n = kind.engine(table, length, k, first)
        rows = pa.array(rows, pa.int64())
        return pa.table(
            {
                "anchor": table.column("anchor").take(rows),
                "around": table.column("around").take(rows),
                "at": pa.array(at, pa.int32()),
                "n": pa.array(n, pa.int32()),
            }
        )

    return dealt.groupBy("block").applyInArrow(run, "anchor long, around long, at int, n int")


def repeated_windows(
    units: DataFrame,
    kind: Kind,
    length: int,
    first: bool,
    level: int = 0,
) -> DataFrame:
    """(uid1, uid2, start, n): runs of windows of a unit that also occur elsewhere.

    ``units`` has (uid1, uid2, rank, weight, content); rows with equal uids have
    equal contents. Elsewhere means at any other place, the same unit included;
    if ``first``, in a unit with a smaller rank.
    """
    k = levels(length)[level]
    raw = level > 0
    read = kind.stored if raw else kind.symbols
    all_found = written(_occurrences(units, read, k, length))
    met = F.min("rank") < F.max("rank") if first else F.sum("weight") > 1
    shared = all_found.groupBy("anchor").agg(met.alias("met")).filter("met").select("anchor")
    found = written(likely(all_found, [F.col("anchor")], shared))
    where = F.struct("rank", "uid1", "uid2", "start", "n", "off")
    classes = found.groupBy("anchor", "around").agg(
        F.min(where).alias("at"),
        F.max("rank").alias("high"),
        F.sum("weight").alias("total"),
        F.count(F.lit(1)).alias("members"),
    )
    names = ["anchor", "around", "total", "high", "members", "at.*"]
    classes = written(classes.select(*names).withColumnRenamed("rank", "low"))
    differ = (F.count(F.lit(1)) > 1) & (
        (F.min("low") < F.max("low")) if first else F.min("total") == 1
    )
    groups = classes.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("classes"), differ.alias("differ")
    )
    groups = groups.filter("differ").select("anchor", "classes")
    open_ones = classes.join(groups, "anchor")
    mixed_ones = written(_contents(units, open_ones, kind, raw, length).join(groups, "anchor"))
    few = mixed_ones.filter(F.col("classes") <= MOST_CLASSES).drop("classes")
    parts = [_compared(few, kind, k, length, first)]
    hot = mixed_ones.filter(F.col("classes") > MOST_CLASSES)
    if not hot.isEmpty():
        own = ["anchor as uid1", "around as uid2", "rank", "weight", "content"]
        smaller = hot.selectExpr(*own)
        split = repeated_windows(smaller, kind, length, first, level + 1)
        own = ["uid1 as anchor", "uid2 as around", "start as at", "n"]
        parts.append(split.selectExpr(*own))
    marks = written(parts[0] if len(parts) == 1 else parts[0].union(parts[1]))
    listed = marks.groupBy("anchor", "around").agg(
        F.collect_list(F.struct("at", "n")).alias("marks")
    )
    told = classes.join(listed, ["anchor", "around"], "left").select(
        "anchor", "around", "low", "total", "high", "members", "marks"
    )
    decided = F.col("high") > F.col("low") if first else F.col("total") > 1
    told = written(told.filter(decided | F.col("marks").isNotNull()))
    whole = F.col("rank") > F.col("low") if first else F.col("total") > 1
    moved = lambda m: F.struct((F.col("start") + m["at"]).alias("start"), m["n"].alias("n"))
    runs = F.when(whole, F.array(F.struct("start", "n"))).otherwise(F.transform("marks", moved))
    # Classes with more than a thousandth of all rows are a thousand at most: they are
    # broadcast, so that no task gets all rows of one.
    bound = max(found.count() // 1000, HOT)
    keys = ["anchor", "around"]
    hot = told.filter(F.col("members") > bound).drop("members")
    cold = told.filter(F.col("members") <= bound).drop("members")
    rest = found.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    known = found.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))
    return known.select("uid1", "uid2", F.inline(runs))


# Texts


def marked_texts(
    docs: DataFrame,
    kind: Kind,
    length: int,
    first: bool,
    carry: Sequence[str] = (),
    more: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The texts that may have repeated windows, with them in ``marks``, and the others.

    Both have (doc_id, text, row); ``row`` has the columns to ``carry`` along. Null texts
    are empty, null ids rank last. A text's key is its id with a hash of it. Only the
    former texts are shuffled; some of them have no marks. ``more`` gives further marks
    of the units; a range of fewer symbols than ``length`` has an ``n`` below 1.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*carry) if carry else F.lit(None).cast("boolean")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), row.alias("row")
    ).select(
        F.coalesce("doc_id", F.lit(LARGEST)).alias("uid1"), F.xxhash64("text").alias("uid2"), "*"
    )
    units = rows.select(
        "uid1",
        "uid2",
        F.col("uid1").alias("rank"),
        F.lit(1).cast("long").alias("weight"),
        F.col("text").alias("content"),
    )
    found = repeated_windows(units, kind, length, first)
    found = written(found if more is None else found.unionByName(more(units)))
    keys = ["uid1", "uid2"]
    listed = found.groupBy(keys).agg(F.collect_set(F.struct("start", "n")).alias("marks"))
    told = with_maybe(rows, [F.col(c) for c in keys], found.select(keys))
    near = told.filter("_maybe").join(listed, keys, "left")
    return near.select("doc_id", "text", "row", "marks"), told.filter("not _maybe").select(
        "doc_id", "text", "row"
    )


def covered(marks: pa.ListScalar, length: int) -> list[tuple[int, int]]:
    """Maximal runs [start, stop) of symbols that the marked windows cover, in order."""
    values = marks.values
    if values is None:
        return []
    start = values.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
    stop = start + values.field("n").to_numpy(zero_copy_only=False) + length - 1
    order = np.argsort(start, kind="stable")
    runs: list[tuple[int, int]] = []
    for a, b in zip(start[order].tolist(), stop[order].tolist(), strict=True):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs
