"""Near-duplicate documents by SuperMinHash signatures, banding and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspan.llm.common import (
    Rolling,
    likely,
    mixed,
    signed,
    sliced,
    split_words,
    word_hashes,
    written,
)
from factspan.llm.components import connected_components

# 32 bands of 4 ranks: two sets of similarity 0.8 share no band once in 2 * 10^7.
BANDS, ROWS = 32, 4

# Sets in a block of a family, and shingles that are multiplied at a time.
_BLOCK, _COLUMNS = 512, 4096

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, 257, dtype=np.uint64) * _GOLDEN


def super_min_hash(elements: np.ndarray, owner: np.ndarray, sets: int, size: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``size`` ranks for each set.

    ``elements`` are distinct hashes within a set, ``owner`` their sets. In step
    j an element draws a fraction r and the j-th place of its own random
    permutation, and offers rank j + r to that place. All elements go through
    step j before step j + 1, so a set is done, and leaves, once all its ranks
    are below j: later steps can't lower them. Big sets are done after a step or
    two, small ones after more, with few elements.
    """
    ranks = np.full((sets, size), np.uint64(0xFFFFFFFFFFFFFFFF))
    flat = ranks.reshape(-1)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    drawn = np.zeros((0, len(elements)), np.uint8)  # places that earlier steps swapped
    active = np.unique(owner)
    for step in range(size):
        x = mixed(elements + _STEPS[step])
        place = step + (((x & low) * np.uint64(size - step)) >> half).astype(np.int64)
        register = place
        for earlier in range(step - 1, -1, -1):  # follow the swaps back
            register = np.where(drawn[earlier] == register, earlier, register)
        rank = (np.uint64(step) << half) | (x >> half)
        np.minimum.at(flat, owner * size + register, rank)
        active = active[(ranks[active] >> half).max(axis=1) > step]
        if not len(active):
            break
        waiting = np.zeros(sets, bool)
        waiting[active] = True
        stay = waiting[owner]
        drawn = np.concatenate([drawn, place[None, :].astype(np.uint8)])[:, stay]
        elements, owner = elements[stay], owner[stay]
    return ranks


def shingle_sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, as sorted hashes; a shorter text is one shingle."""
    words, ends = split_words(batch.column("text"), lower=True)
    rolling = Rolling(word_hashes(words))
    every = rolling.every(width) if len(words) >= width else np.zeros(0, np.uint64)
    found = []
    for start, stop in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if stop - start >= width:
            found.append(np.unique(every[start : stop - width + 1]))
        elif stop > start:
            found.append(rolling.ranges(np.array([start]), np.array([stop])))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, print1, print2, bands) of each row; no bands for an empty set.

    The two prints together identify the set, so rows with equal sets need no
    comparison.
    """
    size = BANDS * ROWS
    salt = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                sets = shingle_sets(batch, width)
                counts = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                owner = np.repeat(np.arange(len(sets)), counts)
                ranks = super_min_hash(flat, owner, len(sets), size)
                key = np.tile(salt, (len(sets), 1))
                for row in range(ROWS):
                    key = mixed(key * _GOLDEN + ranks[:, row::ROWS])
                sums = [
                    np.concatenate([[0], np.cumsum(mixed(flat ^ np.uint64(c)))]).astype(np.uint64)
                    for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)
                ]
                ends = np.concatenate([[0], np.cumsum(counts)])
                prints = [signed(s[ends[1:]] - s[ends[:-1]]) for s in sums]
                some = counts > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))])
                bands = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(signed(key[some]).reshape(-1))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts), *map(pa.array, prints), bands],
                    ["doc_id", "n_shingles", "print1", "print2", "bands"],
                )

    schema = "doc_id long, n_shingles long, print1 long, print2 long, bands array<long>"
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, schema)


def _sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the documents in ``ids(doc_id)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                sets = [signed(s) for s in shingle_sets(batch, width)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), lists], ["node", "shingles"]
                )

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    near = likely(plain, [F.col("doc_id")], ids).join(ids, "doc_id", "left_semi")
    return near.mapInArrow(run, "node long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left_set"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right_set"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("left_set", "right_set"))
    union = F.size("left_set") + F.size("right_set") - F.col("common")
    rows = both.select("a", "b", "left_set", "right_set", common.alias("common"))
    return rows.filter(F.col("common") * 100 >= union * percent).select("a", "b").distinct()


def _ordered(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of (node, n) structs x and y whose sizes allow the similarity."""
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    fit = pairs.filter((F.col("x.node") != F.col("y.node")) & (small * 100 >= large * percent))
    a, b = F.least("x.node", "y.node"), F.greatest("x.node", "y.node")
    return fit.select(a.alias("a"), b.alias("b")).distinct()


class _Links:
    """Links found so far, and the candidate pairs that need no further check."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.links: DataFrame | None = None
        self.tested: DataFrame | None = None

    def check(self, met: DataFrame) -> None:
        pairs = _ordered(met, self.percent)
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = written(pairs)
        found = _verified(pairs, self.sets, self.percent)
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        self.links = written(found if self.links is None else self.links.union(found))

    def labelled(self, crowd: DataFrame) -> DataFrame:
        if self.links is None or self.links.isEmpty():
            return crowd.withColumn("component", F.col("x.node"))
        labels = connected_components(self.links).withColumnRenamed("node", "_node")
        joined = crowd.join(labels, F.col("x.node") == F.col("_node"), "left").drop("_node")
        return joined.withColumn("component", F.coalesce("component", "x.node"))

    def open_part(self, crowd: DataFrame) -> DataFrame:
        """Members (bucket, x, led, component) of buckets that may still hide a link.

        A member that has led was compared with all others, so only pairs of members
        that haven't matter, if they are in different components.
        """
        labelled = self.labelled(crowd)
        waiting = F.when(~F.col("led"), F.col("component"))
        state = labelled.groupBy("bucket").agg(
            F.min(waiting).alias("low"), F.max(waiting).alias("high")
        )
        still = state.filter("low <> high").select("bucket")
        return written(labelled.join(still, "bucket", "left_semi"))

    def round(self, crowd: DataFrame, slots: int) -> DataFrame:
        """Compare members with up to ``slots`` leaders of their bucket.

        Leaders are spread over components first: a component that has a bucket's
        other members as leaders need not lead itself.
        """
        inner = 1
        while inner * inner * 4 <= slots:
            inner *= 2
        slot = F.concat_ws(
            "/",
            F.pmod(F.xxhash64("component", F.lit(slots)), F.lit(slots // inner)),
            F.pmod(F.xxhash64("x.node", F.lit(slots)), F.lit(inner)),
        )
        crowd = crowd.withColumn("slot", slot)
        leaders = crowd.filter("not led").groupBy("bucket", "slot")
        leaders = written(leaders.agg(F.min(F.struct("x", "component")).alias("leader")))
        met = crowd.drop("slot").join(leaders.drop("slot"), "bucket")
        met = met.filter("component <> leader.component")
        self.check(met.select("x", F.col("leader.x").alias("y")))
        chosen = leaders.select("bucket", "slot", F.col("leader.x.node").alias("chosen"))
        leads = F.col("led") | (F.col("x.node") == F.col("chosen"))
        return crowd.join(chosen, ["bucket", "slot"], "left").select(
            "bucket", "x", F.coalesce(leads, F.lit(False)).alias("led")
        )


def _families(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame | None:
    """(node, family) of the members that share a rare shingle with another; None without any.

    Sets that have ``percent`` of their shingles in common differ in the rest; so
    among one more than that rest, in any common order, there is a shared one. In
    the order of rarity few others share it. Shingles that no other member has come
    first, and a member with too many of them is similar to no other. So similar
    members are always in one family, and most others in none.
    """
    own = sets.withColumn("key", F.xxhash64("shingles"))
    size = F.size("shingles").cast("long")
    flat = own.join(members, "node", "left_semi").select(
        "node", "key", size.alias("n"), F.explode("shingles").alias("shingle")
    )
    often = flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    whole = Window.partitionBy("node", "key")
    place = F.row_number().over(whole.orderBy("often", "shingle"))
    met = flat.join(often, "shingle").select(
        "*", place.alias("place"), F.count(F.lit(1)).over(whole).alias("m")
    )
    needed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    kept = met.filter(F.col("place") + F.col("n") - F.col("m") <= needed)
    rare = written(kept.select("shingle", "node").distinct())
    least = rare.groupBy("shingle").agg(F.min("node").alias("a"))
    pairs = rare.withColumnRenamed("node", "b").join(least, "shingle").select("a", "b")
    pairs = written(pairs.filter("a <> b").distinct())
    if pairs.isEmpty():
        return None
    return connected_components(pairs).withColumnRenamed("component", "family")


def _links_in(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Similar pairs of different components among some sets, by products of incidences."""
    component = table.column("component").to_numpy()
    if not len(component) or (component == component[0]).all():
        return []
    node = table.column("node").to_numpy()
    lists = table.column("shingles").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    tokens = lists.flatten().to_numpy()
    _, column, often = np.unique(tokens, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(n)), n)
    shared = often[column] > 1
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(n), len(n)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        part = np.zeros((len(n), _COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    union = n[:, None] + n[None, :] - common
    similar = (common * 100 >= union * percent) & (component[:, None] < component[None, :])
    return [(int(node[i]), int(node[j])) for i, j in np.argwhere(similar)]


def _dealt(sets: DataFrame, families: DataFrame, percent: int, packs: int) -> DataFrame:
    """(node, n, large, part, one, two): the pairs of blocks in which each member's sets are compared.

    Blocks of a large family hold members of one class of sizes. Similar sets have sizes
    whose logarithms differ by a class's width at most, so a block meets those of its own
    and the two next classes only, and what a member meets grows with those.
    """
    sized = families.join(sets.select("node", F.size("shingles").alias("n")).distinct(), "node")
    whole = families.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    # A little wider, so that no rounding parts sizes that are just similar.
    width = math.log(100 / percent) * (1 + 1e-9) + 1e-9 if percent > 0 else math.inf
    level = F.when(F.col("members") > _BLOCK, F.floor(F.log("n") / width)).otherwise(0).cast("long")
    rows = written(sized.join(whole, "family").select("node", "n", "family", "members", level.alias("level")))
    blocks = F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int").alias("blocks")
    levels = rows.groupBy("family", "level").agg(blocks)
    near = F.explode(F.sequence(F.col("level") - 1, F.col("level") + 1))
    # Where a member's level is told, and which blocks of its own and the next levels there are.
    beside = levels.select("family", F.col("level").alias("_level"), F.col("blocks").alias("_blocks"))
    met = levels.select("*", near.alias("_level")).join(beside, ["family", "_level"])
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block")
    met = met.select("family", "level", "blocks", "_level", other)
    rows = rows.withColumn("_key", F.xxhash64("node")).join(met, ["family", "level"])
    own = F.struct("level", F.pmod("_key", F.col("blocks")).cast("int").alias("block"))
    other = F.struct(F.col("_level").alias("level"), F.col("_block").alias("block"))
    pack = F.pmod(F.xxhash64("family"), F.lit(packs))
    large = F.col("members") > _BLOCK
    return rows.select(
        "node",
        "n",
        large.alias("large"),
        F.when(large, F.col("family")).otherwise(pack).alias("part"),
        F.least(own, other).alias("one"),
        F.greatest(own, other).alias("two"),
    )


def _links_of_families(
    sets: DataFrame, labelled: DataFrame, families: DataFrame, percent: int
) -> DataFrame:
    """All links between different components of a family's members.

    A family is compared block by block: no task gets more than two blocks, however
    large the family is, and only links leave it. Small families share tasks.
    """
    packs = max(1, families.count() // _BLOCK)
    rows = _dealt(sets, families, percent, packs)
    sets = sets.withColumn("n", F.size("shingles"))
    rows = rows.join(labelled, "node").join(sets, ["node", "n"]).select(
        "large",
        "part",
        "one",
        "two",
        "node",
        "component",
        "shingles",
    )

    def run(table: pa.Table) -> pa.Table:
        links = _links_in(table.combine_chunks(), percent)
        columns = [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)]
        return pa.table(dict(zip(("a", "b"), columns, strict=True)))

    keys = ["large", "part", "one", "two"]
    dealt = rows.repartition(max(4, 2 * packs), *keys)
    found = dealt.groupBy(*keys).applyInArrow(run, "a long, b long")
    return found.distinct()


def similar_links(
    docs: DataFrame, sketched: DataFrame, width: int, percent: int
) -> DataFrame | None:
    """Links (a, b) that join all similar documents of different sets; None without any.

    Documents that share a band are candidates. No bucket is paired in full: its
    members are compared with its least node, then, unless that put them all into
    one component, with up to eight others. What remains open are buckets of many
    texts with a large part in common but below the threshold. Their members are
    dealt anew into families by their rarest shingles, an exact filter that parts
    such texts, and families are compared in full, block by block. So no link that
    could unite two components is missed.
    """
    some = sketched.filter("n_shingles > 0 and doc_id is not null")
    first = some.groupBy("print1", "print2").agg(F.min("doc_id").alias("doc_id"))
    nodes = some.join(first, ["print1", "print2", "doc_id"], "left_semi")
    member = F.struct(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"))
    members = nodes.select(member.alias("x"), F.explode("bands").alias("bucket"))
    ends = members.groupBy("bucket").agg(F.min("x.node").alias("a"), F.max("x.node").alias("b"))
    crowd = members.join(ends.filter("a <> b").select("bucket"), "bucket", "left_semi")
    crowd = written(crowd.withColumn("led", F.lit(False)))
    if crowd.isEmpty():
        return None
    ids = crowd.select(F.col("x.node").alias("doc_id")).distinct()
    found = _Links(written(_sets_of(docs, ids, width)), percent)
    crowd = found.round(found.labelled(crowd), 1)
    crowd = found.open_part(crowd)
    if crowd.isEmpty():
        return found.links
    crowd = found.open_part(found.round(crowd, 8))
    if crowd.isEmpty():
        return found.links
    left = written(crowd.select(F.col("x.node").alias("node"), "component").distinct())
    families = _families(found.sets, left.select("node"), percent)
    if families is None:
        return found.links
    return found.links.union(_links_of_families(found.sets, left, families, percent))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs(doc_id, text)``.

    Two documents are linked if ``100 * intersection >= percent * union`` of their
    sets of lower-cased ``width``-word shingles; a shorter text is one shingle.
    ``component_id`` is the least doc_id of those linked directly or through others,
    ``kept`` whether it is the row's own.

    Null or empty texts have the empty set and are linked with nothing. Rows
    without doc_id take no part: their component is null and they are kept.
    Rows that repeat a doc_id are one document with several texts; whatever is
    linked with one of them is linked with it. Other columns are ignored. An
    empty table gives an empty result.
    """
    sketched = written(sketches(docs, width))
    some = sketched.filter("n_shingles > 0 and doc_id is not null")
    least = some.groupBy("print1", "print2").agg(F.min("doc_id").alias("node"))
    again = some.groupBy("doc_id").agg(F.count_distinct("print1", "print2").alias("texts"))
    links = similar_links(docs, sketched, width, percent)
    repeated = again.filter("texts > 1").select("doc_id")
    same = (
        some.join(repeated, "doc_id", "left_semi")
        .join(least, ["print1", "print2"])
        .select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    )
    links = same if links is None else links.union(same)
    labels = connected_components(links).withColumnRenamed("component", "linked")
    grouped = sketched.select("doc_id", "n_shingles", "print1", "print2").join(
        least, ["print1", "print2"], "left"
    )
    empty = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    grouped = grouped.withColumn("node", F.when(empty, F.col("doc_id")).otherwise(F.col("node")))
    rows = grouped.join(labels, "node", "left")
    component = F.when(empty, F.col("doc_id")).otherwise(F.coalesce("linked", "node"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept")
    )
