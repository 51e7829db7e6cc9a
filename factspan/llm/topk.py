"""Exact top-k search by inner product, with blocks of vectors pruned by bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspan.llm.common import written

# Vectors in a block, in a range of blocks, and ranges at most; queries in a pack,
# and packs that one task scores against a range.
BLOCK, RANGE, MOST_RANGES, PACK, PACKS_A_TASK = 512, 4096, 2048, 512, 16

_VISIT = "range int, pack long, ids binary, matrix binary, theta binary, last binary"
_FOUND = "query_id long, query_row long, vec_id long, row long, score long"


def _usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vec_id, row) and vectors of a batch, the latter filled up with zeros."""
    lists = batch.column("vector")
    values = lists.flatten().to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    rows = np.zeros((len(sizes), width), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rows[owner, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row")]
    return np.column_stack(ids).astype(np.int64), rows


def _rows(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, width)


def _products(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Exact integer products; floating point only where it is exact."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0))
    if largest * queries.shape[1] < 2**52:
        return (queries.astype(np.float64) @ block.T.astype(np.float64)).astype(np.int64)
    return queries @ block.T


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest product a query can have in each block: its term maxima, summed up."""
    q = queries.astype(np.float64)
    found = np.maximum(q, 0) @ high.T.astype(np.float64)
    found += np.minimum(q, 0) @ low.T.astype(np.float64)
    return found + 1e-9 * np.abs(found)  # for the rounding of very large terms


def blocks(vectors: DataFrame, ranges: int, width: int) -> DataFrame:
    """Forward indexes: blocks of vectors in ranges of ids, with their term extremes.

    ``least`` is the smallest vec_id of a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        for batch in batches:
            ids, rows = _matrix(batch, width)
            for a in range(0, len(ids), BLOCK):
                part = rows[a : a + BLOCK]
                values = [ids[a : a + BLOCK], part, part.max(axis=0), part.min(axis=0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place], pa.int32()), pa.array([ids[a, 0]], pa.int64())]
                    + [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values],
                    ["range", "least", "ids", "matrix", "high", "low"],
                )

    dealt = vectors.repartitionByRange(ranges, "vec_id", "row")
    dealt = dealt.sortWithinPartitions("vec_id", "row")
    schema = "range int, least long, ids binary, matrix binary, high binary, low binary"
    return dealt.mapInArrow(run, schema)


def _extremes(found: DataFrame, width: int) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """Term extremes and smallest vec_id of each range: ``MOST_RANGES`` rows at most."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        high = np.stack([_rows(x, width)[0] for x in table.column("high").to_pylist()]).max(axis=0)
        low = np.stack([_rows(x, width)[0] for x in table.column("low").to_pylist()]).min(axis=0)
        least = min(table.column("least").to_pylist())
        return pa.table(
            {
                "range": pa.array([key[0].as_py()], pa.int32()),
                "least": [least],
                "high": [high.tobytes()],
                "low": [low.tobytes()],
            }
        )

    rows = found.select("range", "least", "high", "low").groupBy("range")
    rows = rows.applyInArrow(run, "range int, least long, high binary, low binary").collect()
    return {r["range"]: (_rows(r.high, width)[0], _rows(r.low, width)[0], r.least) for r in rows}


def _may_hold(bounds: np.ndarray, least, theta, last) -> np.ndarray:
    """If vectors with these bounds and ids can be among the best: scores are integers.

    ``theta`` and ``last`` are score and vec_id of the k-th so far. An equal score counts
    with an id up to ``last`` only, so ties don't open every range.
    """
    bounds = np.floor(bounds)
    return (bounds > theta) | ((bounds == theta) & (least <= last))


def _visits(queries: DataFrame, extremes: dict, width: int, seed: bool) -> DataFrame:
    """Packs of queries with the ranges they visit.

    In the seeding round each query visits the range with its highest bound; then all
    others whose bound reaches ``theta``, its k-th best score so far.
    """
    names = np.array(sorted(extremes), np.int32)
    high = np.stack([extremes[r][0] for r in names])
    low = np.stack([extremes[r][1] for r in names])
    least = np.array([extremes[r][2] for r in names], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, PACK):
                batch = whole.slice(at, PACK)
                ids, rows = _matrix(batch, width)
                theta = batch.column("theta").to_numpy(zero_copy_only=False).astype(np.float64)
                last = batch.column("last").to_numpy(zero_copy_only=False).astype(np.int64)
                bounds = _bounds(rows, high, low)
                best = bounds.argmax(axis=1)
                go = np.zeros(bounds.shape, bool)
                go[np.arange(len(ids)), best] = True
                if not seed:
                    go = _may_hold(bounds, least, theta[:, None], last[:, None]) & ~go
                for place in np.flatnonzero(go.any(axis=0)):
                    some = go[:, place]
                    values = [ids[some], rows[some], theta[some], last[some]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[place]]), pa.array([number], pa.int64())]
                        + [pa.array([v.tobytes()], pa.binary()) for v in values],
                        ["range", "pack", "ids", "matrix", "theta", "last"],
                    )
                number += 1

    return queries.select("vec_id", "row", "vector", "theta", "last").mapInArrow(run, _VISIT)


def _best(query: np.ndarray, vec: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple:
    """The k best of each query, ties to the smaller id."""
    order = np.lexsort((row, vec, -score, query))
    query, vec, row, score = query[order], vec[order], row[order], score[order]
    first = np.searchsorted(query, query, "left")
    top = np.arange(len(query)) - first < k
    return query[top], vec[top], row[top], score[top]


def _searched(visits: DataFrame, found: DataFrame, width: int, k: int) -> DataFrame:
    """Rows of ``_FOUND``: the best of each query in the ranges it visits.

    A task orders the blocks of its range by their summed term maxima, scores them
    through the forward indexes, and leaves out queries whose bound is below their
    k-th score. Many packs in one range are dealt over several tasks.
    """
    visits = written(visits)
    load = visits.groupBy("range").agg(F.count(F.lit(1)).alias("packs"))
    load = load.select("range", F.ceil(F.col("packs") / PACKS_A_TASK).cast("int").alias("slots"))
    sent = visits.join(load, "range").withColumn("slot", F.pmod(F.xxhash64("pack"), "slots"))
    every = F.sequence(F.lit(0).cast("long"), F.col("slots") - F.lit(1).cast("long"))
    spread = found.join(load, "range").select("*", F.explode(every).alias("slot"))

    def run(key: tuple, packs: pa.Table, parts: pa.Table) -> pa.Table:
        index = [
            (_rows(r["ids"], 2), _rows(r["matrix"], width), r["high"], r["low"], r["least"])
            for r in parts.to_pylist()
        ]
        out: list[tuple] = []
        for pack in packs.to_pylist():
            ids = _rows(pack["ids"], 2)
            rows = _rows(pack["matrix"], width)
            theta = np.frombuffer(pack["theta"], np.float64).copy()
            last = np.frombuffer(pack["last"], np.int64).copy()
            best = tuple(np.zeros(0, np.int64) for _ in range(4))
            if index:
                high = np.stack([_rows(x[2], width)[0] for x in index])
                low = np.stack([_rows(x[3], width)[0] for x in index])
                bounds = _bounds(rows, high, low)
                for place in np.argsort(-bounds.max(axis=0), kind="stable"):
                    names, block, _, _, least = index[place]
                    live = np.flatnonzero(_may_hold(bounds[:, place], least, theta, last))
                    if not len(live):
                        continue
                    scores = _products(rows[live], block)
                    hit = _may_hold(scores, names[None, :, 0], theta[live, None], last[live, None])
                    hit &= names[None, :, 1] != ids[live, None, 1]
                    q, v = np.nonzero(hit)
                    more = (live[q], names[v, 0], names[v, 1], scores[q, v])
                    best = _best(*[np.concatenate(x) for x in zip(best, more, strict=True)], k)
                    counts = np.bincount(best[0], minlength=len(ids))
                    full = np.flatnonzero(counts == k)
                    at = np.cumsum(counts)[full] - 1
                    # The k-th here replaces one that is worse.
                    score, vec = best[3][at].astype(np.float64), best[1][at]
                    better = (score > theta[full]) | ((score == theta[full]) & (vec < last[full]))
                    theta[full[better]], last[full[better]] = score[better], vec[better]
            out.append((ids[best[0], 0], ids[best[0], 1], *best[1:]))
        columns = [np.concatenate([o[i] for o in out] or [[]]).astype(np.int64) for i in range(5)]
        names = ("query_id", "query_row", "vec_id", "row", "score")
        return pa.table(dict(zip(names, columns, strict=True)))

    left = sent.select("range", "slot", "ids", "matrix", "theta", "last")
    left = left.groupBy("range", "slot")
    right = spread.selectExpr("range as r", "slot as s", "least", "ids", "matrix", "high", "low")
    return left.cogroup(right.groupBy("r", "s")).applyInArrow(run, _FOUND)


def top_k(
    vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query.

    Components x count as floor(``scale`` * x). Queries are the vectors whose vec_id
    is divisible by ``every``; candidates all vectors but the query itself; ties go
    to the smaller vec_id.

    Vectors that are null or have null or non-finite components take no part, nor do
    rows without vec_id. Shorter vectors are filled up with zeros, empty ones score 0.
    Rows that repeat a vec_id are queries and candidates each, so a query id has ``k`` rows
    for each of its rows, and finds its other rows.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    given = F.col(column).cast("array<double>")
    whole = vectors.filter(F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"), given.alias("given")
    )
    floors = F.transform("given", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = whole.filter(_usable(F.col("given"))).select("vec_id", floors.alias("vector"))
    # Numbers of rows are written with them, so they are the same for all readers.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], result)
    width = max(1, width)
    ranges = min(MOST_RANGES, -(-n // RANGE))
    found = written(blocks(rows, ranges, width))
    extremes = _extremes(found, width)
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    none = {"theta": F.lit(float("-inf")), "last": F.lit(0).cast("long")}
    seeds = _visits(queries.withColumns(none), extremes, width, seed=True)
    best = written(_searched(seeds, found, width, k))
    worst = F.max(F.struct((-F.col("score")).alias("score"), "vec_id"))
    levels = best.groupBy(F.col("query_row").alias("row")).agg(
        F.when(F.count(F.lit(1)) >= k, worst).alias("worst")
    )
    known = queries.join(levels, "row", "left").select(
        *rows.columns,
        F.coalesce(-F.col("worst.score").cast("double"), none["theta"]).alias("theta"),
        F.coalesce("worst.vec_id", none["last"]).alias("last"),
    )
    more = _searched(_visits(known, extremes, width, seed=False), found, width, k)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    ranked = best.union(more).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
