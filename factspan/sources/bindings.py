"""SPARQL-JSON result documents as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factspan.operators.tables import written

_BINDING = "map<string, struct<value: string>>"
_SCHEMA = f"results struct<bindings: array<{_BINDING}>>"

# Brackets around a binding: the document, its results, the list of bindings.
_AROUND = 3
_SPLIT = ["file", "block"]


def _occurrences(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, value): the texts between closing braces, in order of places.

    Spark deals a file's byte ranges (``block``) to tasks, as it does with lines.
    """
    text = spark.read.text(path, lineSep="}")
    return written(
        text.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
            "value",
        )
    )


def _marks(pieces: DataFrame) -> DataFrame:
    """(file, block, place, quotes, inside, outer, inner) of each piece.

    ``quotes`` are the piece's quotation marks, ``inside`` those before it in its block.
    ``outer`` and ``inner`` tell how many brackets are open after it, counted from the
    start of the block, if that start is outside or inside a string.
    """
    # No piece ends within an escape, as none ends in a brace.
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    strings = r'"[^"]*("|\z)'
    outside = F.regexp_replace(plain, strings, "")
    inside = F.regexp_replace(F.regexp_replace(plain, r'^[^"]*("|\z)', ""), strings, "")
    opened = lambda t: _occurrences(t, "{[") - _occurrences(t, "]")
    odd = _occurrences(plain, '"') % 2
    rows = pieces.select(
        *_SPLIT,
        "place",
        odd.alias("quotes"),
        # The brace that ends the piece counts outside strings only.
        (opened(outside) - (1 - odd)).alias("_out"),
        (opened(inside) - odd).alias("_in"),
    )
    here = Window.partitionBy(*_SPLIT).orderBy("place")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    through = here.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    starts_out = F.col("inside") == 0
    return rows.select(
        *_SPLIT,
        "place",
        "quotes",
        "inside",
        F.sum(F.when(starts_out, F.col("_out")).otherwise(F.col("_in"))).over(through).alias("outer"),
        F.sum(F.when(starts_out, F.col("_in")).otherwise(F.col("_out"))).over(through).alias("inner"),
    )


def _numbered(marks: DataFrame) -> DataFrame:
    """(file, block, place, number, is_end): the binding that a piece is part of.

    Blocks pass on by prefix sums, one row a block, whether they end in a string, how many
    brackets are open, and how many bindings have ended.
    """
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = marks.groupBy(*_SPLIT).agg(
        F.sum("quotes").alias("quotes"),
        F.max_by("outer", "place").alias("outer"),
        F.max_by("inner", "place").alias("inner"),
    )
    sums = sums.withColumn("string", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    change = F.when(F.col("string") == 0, F.col("outer")).otherwise(F.col("inner"))
    starts = sums.withColumn("depth", F.coalesce(F.sum(change).over(earlier), F.lit(0)))
    met = marks.join(starts.select(*_SPLIT, "string", "depth"), _SPLIT)
    depth = F.col("depth") + F.when(F.col("string") == 0, F.col("outer")).otherwise(F.col("inner"))
    outside = (F.col("inside") + F.col("quotes") + F.col("string")) % 2 == 0
    met = met.withColumn("is_end", (outside & (depth == _AROUND)).cast("int"))
    before = Window.partitionBy(*_SPLIT).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum("is_end").over(before), F.lit(0))
    met = written(met.select(*_SPLIT, "place", "is_end", ended.alias("ended")))
    blocks = met.groupBy(*_SPLIT).agg(F.sum("is_end").alias("ends"))
    blocks = blocks.withColumn("passed", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    number = (F.col("passed") + F.col("ended")).alias("number")
    return met.join(blocks, _SPLIT).select(*_SPLIT, "place", number, "is_end")


def read_bindings(spark: SparkSession, path: str, variables: Sequence[str]) -> DataFrame:
    """One row per binding of the result files under ``path``.

    An absent variable is null; a document without bindings gives no row, a damaged one
    those that end before the damage. A file of any size is read by many tasks, a byte
    range each, and a binding that lies in two ranges is put together.
    """
    pieces = _pieces(spark, path)
    numbered = _numbered(written(_marks(pieces)))
    whole = pieces.join(numbered, [*_SPLIT, "place"]).groupBy("file", "number")
    part = F.struct("block", "place", "value")
    whole = whole.agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("is_end").alias("is_end"))
    text = F.concat(F.array_join(F.col("parts")["value"], "}"), F.lit("}"))
    # What is before a document's first binding, or the comma between two.
    text = F.regexp_replace(text, r'(?s)^.*?"bindings"\s*:\s*\[\s*(?=\{)', "")
    text = F.regexp_replace(text, r"^[\s,]+", "")
    rows = whole.filter("is_end = 1").select(F.from_json(text, _BINDING).alias("_row"))
    return rows.select(*[F.col("_row")[v]["value"].alias(v) for v in variables])


def parse_bindings(
    documents: DataFrame, column: str, variables: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Like :func:`read_bindings` for documents held in a text column, one a row."""
    parsed = documents.withColumn("_doc", F.from_json(F.col(column), _SCHEMA))
    rows = parsed.select(*keep, F.explode(F.col("_doc")["results"]["bindings"]).alias("_row"))
    return rows.select(*keep, *[F.col("_row")[v]["value"].alias(v) for v in variables])
