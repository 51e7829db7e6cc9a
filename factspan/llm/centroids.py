"""Centroid clustering of integer vectors with tables of squared differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.llm.common import written

# Vectors in a block: its tables have a row for each value that occurs in a dimension,
# so at most so many per dimension.
BLOCK = 8192

# Components beyond this have squared distances that 64 bits may not hold.
LARGEST_PART = 1 << 27

_BLOCKS = "ids array<long>, parts binary, starts binary, codes binary"


def _usable(vector: Column, width: int, scale: int) -> Column:
    """``width`` finite components that stay within ``LARGEST_PART`` when scaled."""
    most = LARGEST_PART / scale
    fits = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= most), F.lit(False))
    return F.coalesce((F.size(vector) == width) & F.forall(vector, fits), F.lit(False))


def _coded(rows: DataFrame, width: int, scale: int) -> DataFrame:
    """Blocks of vectors as codes into the values that occur in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for place in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(place, BLOCK)
                flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
                whole_parts = np.floor(flat.astype(np.float64) * scale).astype(np.int64)
                matrix = whole_parts.reshape(-1, width)
                parts, codes, starts = [], np.empty(matrix.shape, np.int32), [0]
                for d in range(width):
                    occurring, code = np.unique(matrix[:, d], return_inverse=True)
                    codes[:, d] = code + starts[-1]
                    parts.append(occurring)
                    starts.append(starts[-1] + len(occurring))
                ids = pa.array([batch.column("vec_id").to_pylist()], pa.list_(pa.int64()))
                data = (np.concatenate(parts), np.array(starts, np.int64), codes)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array([x.tobytes()], pa.binary()) for x in data)],
                    ["ids", "parts", "starts", "codes"],
                )

    return rows.mapInArrow(run, _BLOCKS)


class Block:
    """A block's vectors, and their distances from centroids by table lookups."""

    def __init__(self, parts: bytes, starts: bytes, codes: bytes):
        self.parts = np.frombuffer(parts, np.int64)
        starts = np.frombuffer(starts, np.int64)
        self.dimension = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.codes = np.frombuffer(codes, np.int32).reshape(-1, len(starts) - 1)

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """One row per vector, one column per centroid."""
        # The table: a row per (dimension, occurring value), a column per centroid.
        table = self.parts[:, None] - centroids[:, self.dimension].T
        table *= table
        found = np.zeros((len(self.codes), len(centroids)), np.int64)
        for d in range(self.codes.shape[1]):
            found += table[self.codes[:, d]]
        return found

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each vector; the smaller number wins a tie."""
        found = self.distances(centroids)
        cluster = found.argmin(axis=1)
        return cluster, found[np.arange(len(found)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and component sums of the clusters."""
        vectors = self.parts[self.codes]
        total = np.zeros((k, vectors.shape[1]), np.int64)
        for c in np.unique(cluster):
            total[c] = vectors[cluster == c].sum(axis=0)
        return np.bincount(cluster, minlength=k), total


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Block]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row["ids"], Block(row["parts"], row["starts"], row["codes"])


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means; empty ones stay."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, block in _each_block(batches):
            cluster, _ = block.nearest(centroids)
            more, parts = block.sums(cluster, k)
            sizes += more
            total += parts
        full = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(full, pa.int32()),
                pa.array(sizes[full]),
                pa.array(total[full].tolist(), pa.list_(pa.int64())),
            ],
            ["cluster", "n", "parts"],
        )

    # k * width rows a task; k * width rows reach the driver.
    found = blocks.mapInArrow(run, "cluster int, n long, parts array<long>")
    by_part = found.select("cluster", "n", F.posexplode("parts").alias("place", "part"))
    sums = by_part.groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(20,0)")).alias("total")
    )
    moved = centroids.copy()
    for row in sums.collect():
        moved[row.cluster, row.place] = int(row.total) // row.n
    return moved


def _assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _each_block(batches):
            cluster, distance = block.nearest(centroids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance)],
                ["vec_id", "cluster", "distance"],
            )

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def start_vectors(rows: DataFrame, k: int, seed: int) -> list[list[float]]:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    place = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")), 256)
    few = rows.select(F.col("vec_id").isNull().alias("last"), place.alias("place"), "vector")
    return [list(row.vector) for row in few.orderBy("last", "place", "vector").limit(k).collect()]


def centroid_clusters(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    width: int = 64,
    scale: int = 1024,
    seed: int = 3,
    column: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, centroid, cluster_inertia, inertia) of each vector.

    A component x becomes the integer floor(scale * x). Every round tabulates the
    squared difference of each dimension, occurring integer and centroid, block by
    block; a vector's distances are sums of looked up rows. Ties go to the smaller
    cluster. A centroid moves to the exact floor of its vectors' mean; an empty one
    stays. After the last round vectors are assigned once more. Sums are added up in
    tasks, so ``k * width`` numbers a task are shuffled and reach the driver.

    Vectors that are null, have not ``width`` components, or have one that is null, not
    finite or beyond 2^27 when scaled take no part and have no row. Rows that repeat a
    vec_id are vectors of their own; those without one come last as starts. With fewer
    vectors than ``k`` there are as many clusters; an empty table gives an empty
    result. Inertia beyond 64 bits is null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col(column).alias("vector"))
    rows = rows.filter(_usable(F.col("vector"), width, scale))
    starts = np.array(start_vectors(rows, k, seed), np.float64).reshape(-1, width)
    centroids = np.floor(starts * scale).astype(np.int64)
    blocks = written(_coded(rows, width, scale))
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(blocks, centroids)
    found = written(_assigned(blocks, centroids))
    exact = F.sum(F.col("distance").cast("decimal(20,0)"))
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(exact.alias("total")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    whole = fits(sum(inertia.values()))
    told = [(c, centroids[c].tolist(), fits(x), whole) for c, x in inertia.items()]
    # k rows at most.
    schema = "cluster int, centroid array<long>, cluster_inertia long, inertia long"
    return found.join(F.broadcast(spark.createDataFrame(told, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "centroid", "cluster_inertia", "inertia"
    )
