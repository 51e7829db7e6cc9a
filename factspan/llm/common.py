"""Words, hashes, shared folders and pre-filters that the operators have in common."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Bytes of text that a Python task works on at a time.
SLICE_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)
LARGEST = (1 << 63) - 1


# Shared folders


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a temporary one.
    The folder goes when the driver ends.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        top = tempfile.mkdtemp(prefix="factspan-llm-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(rows: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """``rows`` as a parquet table in the shared folder, read back.

    It cuts the lineage and outlives executors; readers fetch only the columns
    they name. A reader takes up to 4,096 rows of a row group at once: where rows are
    large, ``group_bytes`` ends a group after the row that fills it.
    """
    spark = rows.sparkSession
    path = shared_folder(spark)
    schema = rows.schema
    sizes = {}
    if group_bytes is not None:
        sizes = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1}
        sizes |= {"parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}
    rows.write.options(compression="zstd", **sizes).parquet(path)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made and nothing reads any more.

    The files of shuffles that led to them go too, once the driver has collected
    what referred to them.
    """
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        freed(spark)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """The files of a job's shuffles go as soon as it has ended.

    For jobs whose plans are run once, such as those that :func:`written` starts.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def freed(spark: SparkSession) -> None:
    """Let go of the files of shuffles that nothing here refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


# Pre-filter

_FILTER_ROWS = 1 << 17


def with_maybe(rows: DataFrame, keys: list[Column], wanted: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: false if their key is surely not in ``wanted``.

    ``wanted`` has just the key columns. A bit map of fixed size (2^17 longs) is
    broadcast, so its size doesn't depend on the data. Some other rows pass and
    none is lost: an exact join has to follow, which is spared the shuffle of
    most rows that match nothing.
    """
    word = F.pmod(F.col("_hash"), F.lit(_FILTER_ROWS)).cast("int").alias("_word")
    hashed = wanted.select(F.xxhash64(*[F.col(c) for c in wanted.columns]).alias("_hash"))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(_hash, 58) as int))")
    bits = hashed.select(word, bit.alias("_bit")).groupBy("_word")
    bits = bits.agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumn("_hash", F.xxhash64(*keys)).select("*", word)
    met = marked.join(F.broadcast(bits), "_word", "left")
    inside = "(shiftrightunsigned(_bits, cast(shiftrightunsigned(_hash, 58) as int)) & 1L) = 1"
    maybe = F.coalesce(F.expr(inside), F.lit(False))
    return met.withColumn("_maybe", maybe).drop("_hash", "_word", "_bits")


def likely(rows: DataFrame, keys: list[Column], wanted: DataFrame) -> DataFrame:
    """The rows whose key may be in ``wanted``; see :func:`with_maybe`."""
    return with_maybe(rows, keys, wanted).filter("_maybe").drop("_maybe")


# Words


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator:
    """Parts of a batch with about ``most`` bytes of text each; one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and where each text's words start and end."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[full], minlength=len(counts))
        flat = flat.filter(pa.array(full))
    return flat, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    hashes = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()),
        np.uint64,
        len(coded.dictionary),
    )
    return hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else hashes


# Hashes


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes half of the output's."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    ups = np.full(length, _ODD, np.uint64)
    downs = np.full(length, inverse, np.uint64)
    ups[0] = downs[0] = _ONE
    return np.multiply.accumulate(ups), np.multiply.accumulate(downs)


class Rolling:
    """Polynomial hashes of all ranges of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        length = 1 << max(16, int(len(symbols)).bit_length())
        ups, self.downs = _powers(length)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * ups[: len(symbols)], out=self.sums[1:])

    def every(self, k: int) -> np.ndarray:
        """Of all ranges of ``k`` symbols, by where they start."""
        x = self.sums[k:] - self.sums[:-k]
        x *= self.downs[: len(x)]
        return mixed(x)

    def ranges(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        x = (self.sums[stops] - self.sums[starts]) * self.downs[starts]
        return mixed(x + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's longs."""
    return np.ascontiguousarray(x).view(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by where they start."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def least_by_hash(rows: DataFrame, column: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the least hash of ``column``.

    The share of hashes that holds about as many is cut out first, so that not every
    task offers ``most`` rows of its own.
    """
    place = F.pmod(F.xxhash64(column), F.lit(1 << 30))
    share = min(1.0, 1.2 * (most + 100) / max(1, rows.count()))
    few = rows.withColumn("_place", place).filter(F.col("_place") <= int(share * (1 << 30)))
    return few.orderBy("_place", *rows.columns).limit(most).drop("_place")


def id_remainder(spark_column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; null for null."""
    return F.pmod(F.crc32(F.col(spark_column).cast("string")), F.lit(modulus))
