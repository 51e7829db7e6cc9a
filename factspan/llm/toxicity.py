"""Toxicity grades of texts by cumulative-link ordinal regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.llm.common import least_by_hash, sliced, split_words, written

# Labelled rows that the model is fitted on, at most: those with the least hash.
TRAINING_ROWS = 16_000
BEGINNINGS = (4, 5, 6)
GRADES = 4
_EDGE = " .,;:!?\"'()[]{}|*#$%&-"


def _feature_names(word: str) -> list[int]:
    """A word as hashes of itself and of its beginnings, without case and edge signs."""
    word = word.strip(_EDGE).lower()
    if not word:
        return []
    parts = [word, *(f"{word[:n]}\0" for n in BEGINNINGS if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(p) >> 1 for p in parts]


def _counts(batch: pa.RecordBatch, wanted: dict[int, int] | None) -> tuple:
    """(row, feature, count) of a batch's texts; of the ``wanted`` features as numbers."""
    words, ends = split_words(batch.column("text"))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names, owner = [], []
    for place, word in enumerate(coded.dictionary.to_pylist()):
        for name in _feature_names(word):
            if wanted is None or name in wanted:
                names.append(name if wanted is None else wanted[name])
                owner.append(place)
    kinds = len(coded.dictionary)
    per = np.bincount(np.array(owner, np.int64), minlength=kinds)
    of = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    names = np.array(names, np.int64)
    telling = per[codes] > 0 if len(codes) else np.zeros(0, bool)
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends))[telling]
    codes = codes[telling]
    repeats = per[codes]
    flat = np.repeat(of[codes], repeats) + np.arange(repeats.sum())
    flat -= np.repeat(np.cumsum(repeats) - repeats, repeats)
    row, feature = np.repeat(row, repeats), names[flat]
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    at = np.flatnonzero(new)
    return row[at], feature[at], np.diff(np.append(at, len(row)))


@dataclass(frozen=True)
class Ordinal:
    """P(grade >= k) = sigmoid(weights . x - thresholds[k - 1]); weights are shared."""

    features: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, row: np.ndarray, feature: np.ndarray, count: np.ndarray, rows: int):
        """P(grade >= 1), P(grade >= 2), ... of each row."""
        value = self.weights[feature] * np.log2(1 + count)
        total = np.bincount(row, value, rows)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - total[:, None], -30, 30)))


def _telling(sample: DataFrame, rows: int, toxic: int) -> list[int]:
    """The features whose presence tells about the label, by the G statistic.

    All that do are kept; there are no more of them than the sample's texts have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                row, feature, _ = _counts(batch, None)
                names, place = np.unique(feature, return_inverse=True)
                label = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
                with_label = np.bincount(place, label[row], len(names)).astype(np.int64)
                columns = [names, with_label, np.bincount(place, minlength=len(names))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["feature", "toxic", "n"]
                )

    parts = sample.mapInArrow(run, "feature long, toxic long, n long")
    sums = parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    share = F.lit(toxic / rows)
    p = F.least(F.lit(1 - 1e-9), F.col("toxic") / F.col("n"))
    gain = F.col("n") * (p * F.log(p / share) + (1 - p) * F.log((1 - p) / (1 - share)))
    scored = sums.filter((F.col("n") >= 4) & (F.col("toxic") / F.col("n") > share))
    scored = scored.withColumn("gain", gain).filter("gain > 8")
    return [row.feature for row in scored.select("feature").orderBy("feature").collect()]


def _regressed(row, feature, value, grade, size: int, grades: int, steps: int = 400) -> tuple:
    """Weights and ordered thresholds of the cumulative-link likelihood, by Adam.

    Thresholds are a first one plus positive gaps, so they stay in order.
    """
    rows = len(grade)
    params = np.zeros(size + grades - 1)
    params[size] = 2.0
    first, second = np.zeros_like(params), np.zeros_like(params)
    above = grade[:, None] >= np.arange(1, grades)
    for step in range(1, steps + 1):
        weights, start = params[:size], params[size]
        gaps = np.exp(np.clip(params[size + 1 :], -5, 5))
        thresholds = start + np.concatenate([[0], np.cumsum(gaps)])
        total = np.bincount(row, weights[feature] * value, rows)
        c = 1 / (1 + np.exp(np.clip(thresholds - total[:, None], -30, 30)))
        # A row of grade g has probability c[g] - c[g + 1], with c[0] = 1 and c[last + 1] = 0.
        full = np.column_stack([np.ones(rows), c, np.zeros(rows)])
        at = np.arange(rows)
        p = np.maximum(full[at, grade] - full[at, grade + 1], 1e-9)
        slope = full * (1 - full)
        by_total = (slope[at, grade] - slope[at, grade + 1]) / p
        by_threshold = np.zeros((rows, grades - 1))
        for k in range(grades - 1):
            by_threshold[:, k] = np.where(
                grade == k + 1, -slope[:, k + 1], np.where(grade == k, slope[:, k + 1], 0)
            )
        by_threshold = (by_threshold / p[:, None]).sum(axis=0)
        gradient = np.empty_like(params)
        gradient[:size] = -np.bincount(feature, by_total[row] * value, size) + 0.005 * weights
        tails = np.cumsum(by_threshold[::-1])[::-1]
        gradient[size] = -tails[0]
        gradient[size + 1 :] = -tails[1:] * gaps
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params -= 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(np.clip(params[size + 1 :], -5, 5))
    return params[:size], params[size] + np.concatenate([[0], np.cumsum(gaps)])


def fitted(row, feature, count, toxic: np.ndarray, names: list[int], grades: int) -> Ordinal:
    """Fit on labels 0 and 1; toxic rows get grades 1 to ``grades`` - 1.

    The labels have no severity. A first fit with two grades finds the weight of
    each feature; a toxic row's severity is how much toxic weight it has in all, and
    its grade tells in which part of the toxic rows, by severity, it is.
    """
    if not names:
        share = np.clip(toxic.mean() if len(toxic) else 0.0, 1e-3, 1 - 1e-3)
        return Ordinal({}, np.zeros(1), np.full(grades - 1, -np.log(share / (1 - share))))
    value, size = np.log2(1 + count), len(names)
    weights, _ = _regressed(row, feature, value, (toxic > 0).astype(int), size, 2)
    severity = np.bincount(row, np.maximum(weights[feature], 0) * value, len(toxic))
    cuts = np.quantile(severity[toxic > 0], np.arange(1, grades - 1) / (grades - 1))
    grade = np.where(toxic > 0, 1 + np.searchsorted(cuts, severity, "right"), 0)
    weights, thresholds = _regressed(row, feature, value, grade, size, grades)
    return Ordinal({name: i for i, name in enumerate(names)}, weights, thresholds)


def _trained(docs: DataFrame, labels: DataFrame, rows: int, grades: int) -> Ordinal:
    known = labels.filter("toxic is not null and doc_id is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # Which rows are taken needs no texts; these are then fetched for the few.
    chosen = written(least_by_hash(known, "doc_id", rows))
    sample = written(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    names = _telling(sample, n, toxic) if 0 < toxic < n else []
    wanted = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                row, feature, count = _counts(batch, wanted)
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))
                    for values in (feature, count)
                ]
                columns = [batch.column("toxic"), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["toxic", "feature", "n"])

    schema = "toxic int, feature array<int>, n array<int>"
    table = sample.mapInArrow(run, schema).toArrow().combine_chunks()
    label = table.column("toxic").to_numpy().astype(float)
    sizes = np.array([len(x) for x in table.column("feature")], np.int64)
    flat = [pc.list_flatten(table.column(c)).to_numpy() for c in ("feature", "n")]
    return fitted(np.repeat(np.arange(n), sizes), *flat, label, names, grades)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))


def severities(
    docs: DataFrame,
    labels: DataFrame,
    grades: int = GRADES,
    training_rows: int = TRAINING_ROWS,
) -> DataFrame:
    """(doc_id, toxicity, severity, grade) of every row of ``docs(doc_id, text)``.

    ``toxicity`` is the probability of a grade above 0, ``severity`` the expected
    grade, ``grade`` the likeliest one. Whole texts are scored by the words and word
    beginnings they have, however often, with weights that all thresholds share.
    The model learns from ``labels(doc_id, toxic)``, from ``training_rows`` documents at
    most, those with the least hash of their id.

    Null and empty texts have no features and get what the thresholds alone say.
    Rows without doc_id have no label. Repeated rows are scored each. Null labels
    don't count; of several for one document the highest does. Without labels of
    both kinds every text gets the same. Other columns are ignored; an empty table
    gives an empty result.
    """
    plain = _plain(docs)
    model = _trained(plain, labels, training_rows, grades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                row, feature, count = _counts(batch, model.features)
                c = model.chances(row, feature, count, batch.num_rows)
                share = np.column_stack([1 - c[:, :1], c[:, :-1] - c[:, 1:], c[:, -1:]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(c[:, 0]),
                        pa.array(c.sum(axis=1)),
                        pa.array(share.argmax(axis=1).astype(np.int32)),
                    ],
                    ["doc_id", "toxicity", "severity", "grade"],
                )

    return plain.mapInArrow(run, "doc_id long, toxicity double, severity double, grade int")


def without_toxic(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.6,
    grades: int = GRADES,
    training_rows: int = TRAINING_ROWS,
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose ``toxicity`` is below the threshold.

    The model is that of :func:`severities`; rows without doc_id are judged by their
    text like others.
    """
    model = _trained(_plain(docs), labels, training_rows, grades)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                row, feature, count = _counts(batch, model.features)
                toxicity = model.chances(row, feature, count, batch.num_rows)[:, 0]
                yield batch.filter(pa.array(toxicity < threshold))

    return docs.mapInArrow(run, schema)
