"""Quality of texts by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.common import id_remainder, least_by_hash, sliced, split_words, written

# Labelled rows that the model is fitted on, at most: those with the least hash.
TRAINING_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1

# Kinds of bytes that are counted: a share of the text each.
_KINDS = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "space": (0x20, 0x09, 0x0B, 0x0C, 0x0D),
    "line": (0x0A,),
    "stop": (0x2E, 0x2C),
    "bar": (0x7C,),
    "mark": (0x21, 0x3F),
    "sign": tuple(b"#$%&*@^~_=+<>\\`"),
    "bracket": tuple(b"()[]{}"),
    "wide": range(0x80, 0x100),
}
_KIND_OF = np.full(256, len(_KINDS), np.int64)
for _at, _members in enumerate(_KINDS.values()):
    _KIND_OF[list(_members)] = _at

FEATURES = (
    *_KINDS,
    "words",
    "word_length",
    "longest_word",
    "distinct_words",
    "commonest_word",
    "repeats_before",
    "words_a_line",
    "distinct_lines",
)


def _variety(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the items of each text: how many are distinct, how often the commonest occurs."""
    distinct, most = np.zeros(len(ends) - 1), np.zeros(len(ends) - 1)
    for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if b > a:
            own = np.sort(codes[a:b])
            steps = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[row], most[row] = len(steps) - 1, np.diff(steps).max()
    return distinct, most


def features(batch: pa.RecordBatch) -> np.ndarray:
    """One row of ``FEATURES`` for each whole text."""
    texts = pc.fill_null(batch.column("text"), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = len(sizes)
    data = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    owner = np.repeat(np.arange(rows) * (len(_KINDS) + 1), sizes)
    kinds = np.bincount(owner + _KIND_OF[data], minlength=rows * (len(_KINDS) + 1))
    shares = kinds.reshape(rows, -1)[:, :-1] / np.maximum(sizes, 1)[:, None]
    words, ends = split_words(texts)
    n = np.diff(ends)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(lengths)])
    per = np.maximum(n, 1)
    longest = np.zeros(rows)
    longest[n > 0] = np.maximum.reduceat(lengths, ends[:-1][n > 0]) if len(lengths) else 0
    distinct, most = _variety(codes, ends)
    again = np.zeros(len(codes) + 1)
    again[2:] = np.cumsum(codes[1:] == codes[:-1]) if len(codes) else 0
    inner = again[np.maximum(ends[1:], ends[:-1])] - again[np.minimum(ends[:-1] + 1, ends[1:])]
    lists = pc.split_pattern(texts, "\n")
    lines = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    line_codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    other, _ = _variety(line_codes, np.concatenate([[0], np.cumsum(lines)]))
    own = [
        np.log1p(n),
        (total[ends[1:]] - total[ends[:-1]]) / per,
        np.log1p(longest),
        distinct / per,
        most / per,
        inner / per,
        np.log1p(n / np.maximum(lines, 1)),
        other / np.maximum(lines, 1),
    ]
    return np.column_stack([shares, *own])


@dataclass(frozen=True)
class Additive:
    """Bin edges and lookup tables: one for each feature, one for each chosen pair."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: a sum of one bin of each table."""
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], "right") for p in self.pairs for f in p}
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[f], coarse[g]]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return -g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over ordered bins: its value in each bin, from sums of g and h."""
    if depth == 0 or len(g) == 1:
        return np.full(len(g), _step(g.sum(), h.sum()))
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1)
    cut = int(gain.argmax()) + 1
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _square(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree with one cut on either side of a table: four values, and its gain."""
    best, value = -1.0, np.zeros_like(g)
    cum_g, cum_h = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (g, h))
    rows, columns = g.shape
    for a in range(1, rows):
        for b in range(1, columns):
            parts = []
            for r0, r1 in ((0, a), (a, rows)):
                for c0, c1 in ((0, b), (b, columns)):
                    box = [t[r1, c1] - t[r0, c1] - t[r1, c0] + t[r0, c0] for t in (cum_g, cum_h)]
                    parts.append((slice(r0, r1), slice(c0, c1), *box))
            gain = sum(p[2] ** 2 / (p[3] + 1) for p in parts)
            if gain > best:
                best, value = gain, np.zeros_like(g)
                for r, c, box_g, box_h in parts:
                    value[r, c] = _step(box_g, box_h)
    return value, best


def fitted(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting: the features take turns, each with a shallow tree at a low rate.

    Then the pairs that explain most of what is left get tables of their own.
    """
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    count = len(FEATURES)
    if not 0 < y.sum() < len(y):
        none = [np.zeros(0)] * count
        return Additive(base, none, [np.zeros(1)] * count, [], none, [])
    edges = [_edges(x[:, f], BINS) for f in range(count)]
    bins = [np.searchsorted(edges[f], x[:, f], "right") for f in range(count)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for f in range(count):
            p = 1 / (1 + np.exp(-total))
            size = len(tables[f])
            tree = RATE * _tree(
                np.bincount(bins[f], p - y, size), np.bincount(bins[f], p * (1 - p), size)
            )
            tables[f] += tree
            total += tree[bins[f]]
    pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(count)]
    coarse = [np.searchsorted(pair_edges[f], x[:, f], "right") for f in range(count)]

    def sums(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        shape = (len(pair_edges[f]) + 1, len(pair_edges[g]) + 1)
        cell = coarse[f] * shape[1] + coarse[g]
        return tuple(
            np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (p - y, p * (1 - p))
        )

    gains = {(f, g): _square(*sums(f, g))[1] for f in range(count) for g in range(f)}
    pairs = sorted(gains, key=gains.get, reverse=True)[:PAIRS]
    pair_tables = [np.zeros((len(pair_edges[f]) + 1, len(pair_edges[g]) + 1)) for f, g in pairs]
    for _ in range(PAIR_ROUNDS):
        for table, (f, g) in zip(pair_tables, pairs, strict=True):
            value = RATE * _square(*sums(f, g))[0]
            table += value
            total += value[coarse[f], coarse[g]]
    return Additive(base, edges, tables, pairs, pair_edges, pair_tables)


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                x = features(batch)
                flat = pa.array(x.ravel())
                lists = pa.FixedSizeListArray.from_arrays(flat, x.shape[1]).cast(pa.list_(pa.float64()))
                columns = [batch.column("doc_id"), batch.column("held_out"), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "x"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, x array<double>")


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    fold: int = 0,
    threshold: float = 0.3,
    training_rows: int = TRAINING_ROWS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text)``.

    ``score`` is the probability of quality 1 that the text alone suggests, whole and
    as it is; ``predicted`` is 1 from ``threshold`` on. The model learns from
    ``labels(doc_id, quality)`` of documents that aren't held out, i.e. whose
    crc32(doc_id as text) mod ``folds`` is not ``fold``; from ``training_rows`` of
    them at most, those with the least hash of their id. Features of all documents
    are computed once.

    Null texts count as empty ones. Rows without doc_id aren't held out and have no
    label. Repeated rows are scored each. Labels that are null don't count; of
    several for one document the highest does. Without labels of both kinds, every
    score is the share of label 1 (0.5 without any). Other columns are ignored; an
    empty table gives an empty result.
    """
    held = F.coalesce(id_remainder("doc_id", folds) == fold, F.lit(False))
    rows = docs.select(
        F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string")
    )
    found = written(_featured(rows))
    known = labels.filter("quality is not null and doc_id is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max("quality").alias("quality"))
    learnt = found.filter("not held_out").join(known, "doc_id")
    sample = written(least_by_hash(learnt, "doc_id", training_rows))
    sample = sample.select("x", "quality").toPandas()
    x = np.array(sample["x"].tolist()).reshape(-1, len(FEATURES))
    model = fitted(x, (sample["quality"].to_numpy() > 0).astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            score = model.scores(flat.reshape(-1, len(FEATURES)))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score"])

    scored = found.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
