"""Benchmark items inside documents, by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.llm.common import Rolling, mixed, signed, sliced, split_words, word_hashes, written

# Minima of an item; one that a window shares makes a candidate.
HASHES = 48
# Shingles of items that tasks get in one go, about; more items go in several passes.
BLOCK_SHINGLES = 1 << 20

_FACTORS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def _shingles(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts in a row, in order, and where each text's end."""
    words, ends = split_words(batch.column("text"), lower=True)
    counts = np.maximum(np.diff(ends) - width + 1, 0)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    if not counts.sum():
        return np.zeros(0, np.uint64), cuts
    every = Rolling(word_hashes(words)).every(width)
    at = np.arange(counts.sum()) + np.repeat(ends[:-1] - cuts[:-1], counts)
    return every[at], cuts


@dataclass(frozen=True)
class Items:
    """Items of a block: their ids, distinct shingles, and minima by size class.

    A class holds the sizes from 2^c to 2^(c + 1) - 1. Documents are searched for it
    in windows of 2^(c + 2) shingles, one every 2^(c + 1), so each item is inside
    one of them, and shares a known part of it: at least 0.8 / 4.2 of all shingles
    if 0.8 of the item is there. That fixes the chance to miss it: 0.81^48 at most.
    """

    ids: np.ndarray
    sets: list[np.ndarray]
    sizes: np.ndarray
    classes: dict[int, list[tuple[np.ndarray, np.ndarray]]]

    @classmethod
    def of(cls, ids: list, sets: list[np.ndarray]) -> Items:
        sizes = np.array([len(s) for s in sets], np.int64)
        level = np.array([int(n).bit_length() - 1 for n in sizes], np.int64)
        classes = {}
        for c in np.unique(level).tolist():
            members = np.flatnonzero(level == c)
            tables = []
            for factor in _FACTORS:
                least = np.array([(sets[i] * factor).min() for i in members], np.uint64)
                order = np.argsort(least)
                tables.append((least[order], members[order]))
            classes[c] = tables
        return cls(np.array(ids, np.int64), sets, sizes, classes)

    def candidates(self, shingles: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) pairs that share a minimum in some window."""
        rows, items = [], []
        for c, tables in self.classes.items():
            size = 2 << c
            counts = -(-np.diff(cuts) // size)
            owner = np.repeat(np.arange(len(counts)), counts)
            turn = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = cuts[:-1][owner] + turn * size
            last = np.append(owner[1:] != owner[:-1], True)
            for factor, (least, members) in zip(_FACTORS, tables, strict=True):
                low = np.minimum.reduceat(shingles * factor, starts)
                pair = np.minimum(low, np.append(low[1:], low[-1:]))
                window = np.where(last, low, pair)
                a = np.searchsorted(least, window, "left")
                hit = np.flatnonzero(least[np.minimum(a, len(least) - 1)] == window)
                n = np.searchsorted(least, window[hit], "right") - a[hit]
                at = np.repeat(a[hit], n) + np.arange(n.sum())
                at -= np.repeat(np.cumsum(n) - n, n)
                rows.append(np.repeat(owner[hit], n))
                items.append(members[at])
        pairs = np.unique(np.concatenate(rows) * len(self.ids) + np.concatenate(items))
        return pairs // len(self.ids), pairs % len(self.ids)

    def leaks(self, batch: pa.RecordBatch, width: int, percent: int) -> Iterator[tuple]:
        """(text, item, shared) of the items whose shingles are in the text to ``percent``."""
        shingles, cuts = _shingles(batch, width)
        if not len(shingles) or not self.classes:
            return
        rows, items = self.candidates(shingles, cuts)
        text, own = -1, np.zeros(0, np.uint64)
        for row, item in zip(rows.tolist(), items.tolist(), strict=True):
            if row != text:
                text, own = row, np.sort(shingles[cuts[row] : cuts[row + 1]])
            wanted = self.sets[item]
            place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            shared = int((own[place] == wanted).sum())
            if 100 * shared >= percent * len(wanted):
                yield row, item, shared


def item_sets(items: DataFrame, width: int) -> DataFrame:
    """(item_id, shingles) of the items that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                flat, cuts = _shingles(batch, width)
                sets = [np.unique(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(signed(np.concatenate(sets)))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id"), lists], ["item_id", "shingles"]
                )

    plain = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    sets = plain.filter("item_id is not null and text is not null")
    return sets.mapInArrow(run, "item_id long, shingles array<long>").filter("size(shingles) > 0")


def item_blocks(items: DataFrame, width: int) -> Iterator[Items]:
    """The distinct items in blocks of a bounded number of shingles."""
    sets = written(item_sets(items, width).distinct())
    total = sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    for block in range(blocks):
        some = sets.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = some.orderBy("item_id").collect()
        yield Items.of(
            [r.item_id for r in rows],
            [np.array(r.shingles, np.int64).view(np.uint64) for r in rows],
        )


def leaks(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): benchmark items that documents contain.

    An item is in a document if at least ``percent`` of its distinct ``width``-word
    shingles, in lower case, are somewhere in the whole text. Candidates come from
    shared minima of windows, by size class of the items (see :class:`Items`); each
    is verified by exact containment of shingles. Documents are searched in place:
    nothing is shuffled.

    Null and short texts (fewer than ``width`` words) contain nothing, and such items
    are contained nowhere. Rows without item_id are left out; rows without doc_id
    are reported without it. Repeated documents are reported each; repeated items
    once, and an item_id with several texts for each text. Other columns are
    ignored; an empty table on either side gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for block in item_blocks(items, width):

        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in sliced(whole):
                    rows = list(block.leaks(batch, width, percent))
                    text, item, shared = (
                        np.array([r[i] for r in rows], np.int64) for i in range(3)
                    )
                    columns = [
                        batch.column("doc_id").take(pa.array(text)),
                        *map(pa.array, (block.ids[item], block.sizes[item], shared)),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        columns, ["doc_id", "item_id", "n_shingles", "n_shared"]
                    )

        schema = "doc_id long, item_id long, n_shingles long, n_shared long"
        part = plain.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def without_leaks(
    docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text contains no item.

    Containment is as in :func:`leaks`; rows without doc_id are judged by their text
    like others.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    for block in item_blocks(items, width):

        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in sliced(whole):
                    clean = np.ones(batch.num_rows, bool)
                    for row, _, _ in block.leaks(batch, width, percent):
                        clean[row] = False
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
