"""A corpus pipeline: each stage works on all that the one before it kept.

Toxic documents go, one of each group of near copies stays, passages that an earlier
document has are cut, documents with benchmark items go, and the sources are mixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.llm.common import likely, with_maybe, written
from factspan.llm.decontaminate import without_leaks
from factspan.llm.mixture import mixed_to_weights
from factspan.llm.neardup import near_duplicates
from factspan.llm.runindex import without_repeats
from factspan.llm.toxicity import without_toxic

# What a passage has to share with an earlier document to be cut: so many bytes, a little
# less than fifty words of running text, or over fifty words of whatever length.
PASSAGE_BYTES, PASSAGE_WORDS = 240, 51


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier toxic than not go.

    Each row is judged by its own whole text, so repeated rows fare alike. Null and empty
    texts have no features and stay unless the thresholds alone say otherwise. An empty
    table stays empty; all columns are kept, whatever their names.
    """
    return without_toxic(docs, _table(spark, sf_dir, "labels"), threshold=0.6)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the least id, ids before none.

    Rows are judged, not ids: of equal rows and of copies without id one stays, and each
    of several texts under one id is judged by itself. Of rows that tie in id, one stays.
    Texts without words are copies of nothing and stay. An empty table stays empty; all
    columns are kept, whatever their names.
    """
    # The given columns are wrapped, so no name of theirs meets one of ours.
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("place"),
    )
    # The places of rows stay as they are once written.
    rows = written(rows)
    found = near_duplicates(rows.select(F.col("place").alias("doc_id"), "text"))
    gone = written(found.filter("not kept").select(F.col("doc_id").alias("place"), "component_id"))
    heads = gone.select(F.col("component_id").alias("place"), "component_id").distinct()
    linked = gone.union(heads)
    few = likely(rows.select("place", "id"), [F.col("place")], linked.select("place"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "place")
    best = linked.join(few, "place").groupBy("component_id").agg(F.min(order).alias("best"))
    cut = linked.select("place").join(best.select("best.place"), "place", "left_anti")
    cut = written(cut)
    told = with_maybe(rows.select("row", "place"), [F.col("place")], cut)
    near = told.filter("_maybe").join(cut, "place", "left_anti")
    return told.filter("not _maybe").select("row.*").union(near.select("row.*"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut; emptied documents go.

    Rows without id come last, and of equal ids none is smaller, so passages among them
    stay. Null and empty texts stay as they are. ``n_chars`` of a cut text is its new
    length, if there is such a column. An empty table stays empty; other columns are
    kept, whatever their names.
    """
    row = F.struct(F.struct("*").alias("given"), F.col("text").isNull().alias("none"))
    given = docs.select("doc_id", "text", row.alias("whole"))
    cut = without_repeats(
        given,
        PASSAGE_BYTES,
        first=True,
        whole_characters=True,
        carry=["whole"],
        words=PASSAGE_WORDS,
    )
    cut = cut.filter("n_removed = 0 or n_removed < n_bytes")
    given = F.col("row")["whole"]["given"]
    kept = F.col("kept").cast("string")
    new = {"text": F.when(~F.col("row")["whole"]["none"], kept)}
    if "n_chars" in docs.columns:
        length = F.length(kept).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(given["n_chars"])
    return cut.select(*[new.get(c, given[c]).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Each row is judged by its own whole text; null and empty texts contain nothing, and
    items of fewer than five words are in nothing. Without documents or items nothing
    changes; all columns are kept, whatever their names.
    """
    return without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each.

    Rows without words, as null and empty texts, are not taken. Null sources are one
    source. Rows that repeat an id are rows like others. An empty table gives an empty
    result; of the given columns doc_id and source stay.
    """
    return mixed_to_weights(docs).filter("taken > 0")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

# The toxicity model is not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table is written before the next reads it."""
    docs = _table(spark, sf_dir, "documents")
    *inner, (_, last) = STAGES
    for _, stage in inner:
        docs = written(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
