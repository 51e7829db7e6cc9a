"""Repeated byte strings, by a run-length index over candidate segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.llm.common import Rolling, likely, mixed, signed, sliced, written
from factspan.llm.repeats import Kind, covered, marked_texts

_SYMBOLS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each ends."""
    width = np.int64 if texts.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at.astype(np.int64) - at[0]


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, ends = _bytes(texts)
    return _SYMBOLS[flat], ends


def _store(texts: pa.Array, _: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
    flat = _bytes(texts)[0].tobytes()
    return [flat[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


@dataclass(frozen=True)
class RunIndex:
    """A run-compressed Burrows-Wheeler transform with samples at its run heads.

    ``run_heads`` are the ranks where a run begins and ``run_symbols`` its symbol.
    ``samples`` are the text positions at the heads, in text order, each with the
    position of the suffix ranked before it and their common length. All other
    positions follow from these: where the transform repeats its symbol, a
    position's neighbour and common length are those of the position to the left,
    one symbol on. In a repetitive text there are far fewer runs than symbols.
    """

    size: int
    run_heads: np.ndarray
    run_symbols: np.ndarray
    samples: np.ndarray
    neighbours: np.ndarray
    lengths: np.ndarray

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the text itself, from left to right.

        For each position, the longest match with the suffix ranked before it, and
        where that suffix starts.
        """
        spans = np.diff(np.append(self.samples, self.size))
        on = np.arange(self.size) - np.repeat(self.samples, spans)
        return np.repeat(self.lengths, spans) - on, np.repeat(self.neighbours, spans) + on


def run_index(flat: np.ndarray, ends: np.ndarray) -> RunIndex:
    """Index the segments flat[ends[i]:ends[i + 1]], each closed by an end mark of its own."""
    count = len(ends) - 1
    sizes = np.diff(ends)
    text = np.empty(len(flat) + count, np.int64)
    marks = ends[1:] + np.arange(count)
    inside = np.ones(len(text), bool)
    inside[marks] = False
    text[inside] = flat.astype(np.int64) + count
    text[marks] = np.arange(count)
    order, size = _suffixes(text, 256 + count, int(sizes.max(initial=0)) + 1), len(text)
    transform = text[order - 1]
    heads = np.flatnonzero(np.append(True, transform[1:] != transform[:-1]))
    here, before = order[heads], order[heads - 1]
    lengths = _common(text, here, before)
    lengths[0] = 0
    at = np.argsort(here)
    return RunIndex(size, heads, transform[heads], here[at], before[at], lengths[at])


def _suffixes(text: np.ndarray, symbols: int, longest: int) -> np.ndarray:
    """Suffixes in order, by doubling; none agrees with another over ``longest`` symbols."""
    size = len(text)
    bits = max(1, int(symbols).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(size, np.int64)
    for i in range(depth):
        key <<= bits
        key[: size - i] |= text[i:]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        if depth >= longest or rank[order[-1]] == size - 1:
            return order
        key = rank * (size + 1)
        key[: size - depth] += rank[depth:] + 1
        depth *= 2


def _common(text: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Lengths of the common starts of suffixes, by bisection over hashes of ranges."""
    rolling = Rolling(mixed(text.astype(np.uint64) + np.uint64(1)))
    low = np.zeros(len(one), np.int64)
    high = len(text) - np.maximum(one, two)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = rolling.ranges(one, one + middle) == rolling.ranges(two, two + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def matched(table: pa.Table, length: int, k: int, first: bool) -> tuple:
    """(row, start, n): runs of windows of ``length`` bytes that another place has too.

    A window is equal to another one if it is so to a neighbour in rank order.
    ``first``: only windows that a smaller rank has too.
    """
    table = table.combine_chunks()
    contents = table.column("content").combine_chunks()
    flat, ends = _bytes(contents)
    index = run_index(flat, ends)
    match, neighbour = index.stream()
    long = np.flatnonzero(match >= length)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends) + 1)
    begin = ends[:-1] + np.arange(len(ends) - 1)
    hit = np.zeros(len(owner), bool)
    if first:
        # Equal windows hang together by neighbours: pass least ranks along.
        rank = table.column("rank").to_numpy()[owner]
        least = _least_of_equal(rank, long, neighbour[long])
        hit = rank > least
    else:
        hit[long] = hit[neighbour[long]] = True
    found = np.flatnonzero(hit)
    new = np.ones(len(found), bool)
    new[1:] = (np.diff(found) > 1) | (owner[found[1:]] != owner[found[:-1]])
    at = np.flatnonzero(new)
    row = owner[found[at]]
    return row, found[at] - begin[row], np.diff(np.append(at, len(found)))


def _least_of_equal(rank: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least rank in each chain of neighbours, by pointer jumping to the chain's start."""
    root = np.arange(len(rank))
    root[one] = two
    while True:
        further = root[root]
        if np.array_equal(further, root):
            break
        root = further
    least = rank.copy()
    np.minimum.at(least, root, rank)
    return least[root]


BYTES = Kind(_symbols, _store, _symbols, matched)


def _whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs without the characters that they begin or end in the middle of."""
    inner = []
    for start, stop in runs:
        while start < stop and data[start] & 0xC0 == 0x80:
            start += 1
        while start < stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        if start < stop:
            inner.append((start, stop))
    return inner


def _short_windows(flat: np.ndarray, ends: np.ndarray, words: int, length: int) -> tuple:
    """(text, start, stop) of each ``words`` words in a row of less than ``length`` bytes."""
    gap = (flat == 0x20) | ((flat >= 0x09) & (flat <= 0x0D))
    begins, closes = ~gap, ~gap
    begins[1:] &= gap[:-1]
    closes[:-1] &= gap[1:]
    # Where one text ends and the next starts, so do their words.
    inner = ends[(ends > 0) & (ends < len(flat))]
    begins[inner], closes[inner - 1] = ~gap[inner], ~gap[inner - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    if len(start) < words:
        start = stop = start[:0]
    else:
        start, stop = start[: len(start) - words + 1], stop[words - 1 :]
    text = np.searchsorted(ends, start, "right") - 1
    short = (stop - start < length) & (stop <= ends[text + 1])
    return text[short], start[short], stop[short]


def repeated_words(units: DataFrame, words: int, length: int, first: bool) -> DataFrame:
    """(uid1, uid2, start, n): strings of ``words`` words that also occur elsewhere.

    Only those of less than ``length`` bytes, as longer ones are found by their bytes.
    Elsewhere is as in :func:`repeated_windows`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "content"):
                flat, ends = _bytes(batch.column("content"))
                text, start, stop = _short_windows(flat, ends, words, length)
                spans = zip(start.tolist(), stop.tolist(), strict=True)
                data = memoryview(flat)
                hashes = np.fromiter(
                    (xxhash.xxh3_64_intdigest(data[a:b]) for a, b in spans), np.uint64, len(start)
                )
                names = ["uid1", "uid2", "rank"]
                columns = [batch.column(c).take(pa.array(text)) for c in names]
                columns += [
                    pa.array((start - ends[text]).astype(np.int32)),
                    pa.array((stop - start - length + 1).astype(np.int32)),
                    pa.array(signed(hashes)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*names, "start", "n", "key"])

    schema = "uid1 long, uid2 long, rank long, start int, n int, key long"
    windows = written(units.mapInArrow(run, schema))
    met = F.min("rank") < F.max("rank") if first else F.count(F.lit(1)) > 1
    shared = windows.groupBy("key").agg(F.min("rank").alias("low"), met.alias("met"))
    shared = written(shared.filter("met").select("key", "low"))
    near = likely(windows, [F.col("key")], shared.select("key")).join(shared, "key")
    near = near.filter("rank > low") if first else near
    return near.select("uid1", "uid2", "start", "n")


def without_repeats(
    docs: DataFrame,
    length: int = 400,
    first: bool = False,
    whole_characters: bool = False,
    carry: Sequence[str] = (),
    words: int | None = None,
) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, row): documents without repeated bytes.

    Each byte of the UTF-8 text is removed that lies in a string of ``length`` bytes
    which also starts anywhere else, in the same document too; matches never cross
    documents, and all is judged on the input. With ``first`` only strings that
    start in a document with a smaller doc_id are removed, so one copy stays.
    ``kept`` is binary, as a cut may split a character, unless cuts are held to
    ``whole_characters``; ``n_spans`` counts the maximal removed runs. ``row`` has the
    columns to ``carry`` along. Strings of ``words`` whole words with the white space
    between them are removed in the same way, if given, however few bytes they have.

    Null texts are empty. Rows without doc_id count as the last ones. Rows that
    repeat a doc_id are documents of their own, but none is smaller than another;
    equal rows are copies. Other columns are ignored; an empty table gives an empty
    result.
    """
    more = words and (lambda units: repeated_words(units, words, length, first))
    near, far = marked_texts(docs, BYTES, length, first, carry, more or None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                flat, ends = _bytes(batch.column("text"))
                flat = flat.tobytes()
                kept, removed, spans = [], [], []
                for place, marks in enumerate(batch.column("marks")):
                    own = flat[ends[place] : ends[place + 1]]
                    runs = covered(marks, length)
                    runs = _whole_characters(own, runs) if whole_characters else runs
                    cuts = [0, *(x for span in runs for x in span), len(own)]
                    left = b"".join(own[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                    kept.append(left)
                    removed.append(len(own) - len(left))
                    spans.append(len(runs))
                counts = [pa.array(c, pa.int64()) for c in (np.diff(ends), removed, spans)]
                columns = [batch.column("doc_id"), pa.array(kept, pa.binary()), *counts]
                yield pa.RecordBatch.from_arrays(
                    [*columns, batch.column("row")],
                    ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "row"],
                )

    none = F.lit(0).cast("long")
    same = far.select(
        "doc_id",
        F.col("text").cast("binary").alias("kept"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        none.alias("n_removed"),
        none.alias("n_spans"),
        "row",
    )
    nullable = [T.StructField(f.name, f.dataType, True) for f in same.schema]
    return near.mapInArrow(run, T.StructType(nullable)).union(same)
