"""Repeated passages of words, by seed and extend."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.common import sliced, split_words, word_hashes
from factspan.llm.repeats import Kind, covered, marked_texts


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, ends = split_words(texts)
    return word_hashes(words), ends


def _stored(contents: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.binary_length(contents).to_numpy(zero_copy_only=False) // 8
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return np.frombuffer(b"".join(contents.to_pylist()), np.uint64), ends


def _store(_: pa.Array, words: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
    return [words[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def _padded(words: np.ndarray, begin: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
    """Rows of ``sizes`` words from ``begin`` on (backwards if step is -1), cut to equal width."""
    width = int(sizes.max(initial=0))
    at = begin[:, None] + step * np.arange(width)
    inside = np.arange(width) < sizes[:, None]
    return np.where(inside, words[np.clip(at, 0, max(len(words) - 1, 0))], 0), inside


def extended(table: pa.Table, length: int, k: int, first: bool) -> tuple:
    """Extend seeds to both sides: (row, start, n) of maximal repeats over the length.

    Rows with the same anchor are matched at it; words to the left and to the
    right are compared until they differ. What then reaches ``length`` words
    covers a run of windows. ``first``: only matches of a smaller rank count.
    """
    table = table.combine_chunks()
    words, ends = _stored(table.column("content").combine_chunks())
    off = table.column("off").to_numpy().astype(np.int64)
    n = table.column("n").to_numpy().astype(np.int64)
    rank = table.column("rank").to_numpy()
    _, group = np.unique(table.column("anchor").to_numpy(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group)
    base = np.cumsum(sizes) - sizes
    # Ordered pairs of rows with the same anchor; anchors have few rows here.
    partners = sizes[group[order]]
    one = np.repeat(order, partners)
    seat = np.arange(len(one)) - np.repeat(np.cumsum(partners) - partners, partners)
    two = order[base[group[one]] + seat]
    fit = rank[two] < rank[one] if first else one != two
    one, two = one[fit], two[fit]
    anchor = ends[:-1] + off
    reach = []
    for begin, size, step in (
        (anchor - 1, off, -1),
        (anchor + k, np.diff(ends) - off - k, 1),
    ):
        side, inside = _padded(words, begin, size, step)
        same = (side[one] == side[two]) & inside[one] & inside[two]
        reach.append(np.logical_and.accumulate(same, axis=1).sum(axis=1))
    left, right = reach
    low = np.maximum(off[one] - left, 0)
    high = np.minimum(off[one] + k + right - length, n[one] - 1)
    long = low <= high
    return one[long], low[long], (high - low + 1)[long]


WORDS = Kind(_symbols, _store, _stored, extended)


def without_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, kept, n_words, n_removed): every document without its repeated passages.

    Each word is removed that lies in a window of ``length`` words which also starts
    in a document with a smaller doc_id, judged on the input. ``kept`` has the
    other words joined by one space.

    Null and empty texts have no words. Rows without doc_id count as the last
    ones: they lose what any other has, and no other loses anything for them.
    Rows that repeat a doc_id are one document with several texts, none of which
    is smaller than another. Other columns are ignored; an empty table gives an
    empty result.
    """
    near, far = marked_texts(docs, WORDS, length, first=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                words, ends = split_words(batch.column("text"))
                words = words.to_pylist()
                kept, removed = [], []
                for row, marks in enumerate(batch.column("marks")):
                    own = words[ends[row] : ends[row + 1]]
                    left, at = [], 0
                    for start, stop in covered(marks, length):
                        left += own[at:start]
                        at = stop
                    left += own[at:]
                    kept.append(" ".join(left))
                    removed.append(len(own) - len(left))
                columns = [
                    batch.column("doc_id"),
                    pa.array(kept, pa.string()),
                    pa.array(np.diff(ends)),
                    pa.array(removed, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "kept", "n_words", "n_removed"]
                )

    edited = near.mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long")
    whole = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    counted = F.length("kept") - F.length(F.replace("kept", F.lit(" "))) + 1
    same = far.select("doc_id", whole.alias("kept")).select(
        "doc_id",
        "kept",
        F.when(F.col("kept") == "", 0).otherwise(counted).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_removed"),
    )
    return edited.union(same)
