"""Small tables with the awkward cases: nulls, empty and long texts, ties, copies, clashes."""

import random

import pytest

# Extra columns whose names the operators use themselves.
EXTRA = "marks long, row string, rank int, n_removed long, _word int, node long, score double"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))


def small_documents() -> list[tuple]:
    base, passage = prose(1, 120), prose(2, 90)
    rows = [(10 + i, prose(10 + i, 30 + 7 * i), "a") for i in range(12)]
    rows += [(30, base, "a"), (31, base, "b"), (32, base.upper() + "  ", "b")]
    rows += [(40 + i, base.replace("w1 ", f"x{i} "), None) for i in range(6)]
    rows += [(50 + i, f"{prose(90 + i, 20)} {passage} {prose(70 + i, 25)}", "c") for i in range(4)]
    rows += [(60, None, "a"), (61, "", "a"), (62, " \n\t ", None), (63, "one two", "b")]
    rows += [(64, "one two", "b"), (65, "ein wort \x1f zwei", "b")]
    rows += [(66, "la " * 700, "a"), (67, "la " * 300 + passage, "a")]
    rows += [(68, "é" * 900, "d"), (69, "xé" + "é" * 500 + "\n" + prose(5, 60), "d")]
    rows += [(70, prose(3, 5000), "a"), (71, prose(3, 5000) + " tail", "a")]
    rows += [(10, rows[0][1], "a"), (72, base, "z"), (72, passage, "z")]
    rows += [(None, base, "a"), (None, None, None), (None, prose(4, 70), "b")]
    return rows


def frame(spark, rows, schema: str, extra: bool = True):
    if not extra:
        return spark.createDataFrame(rows, schema)
    width = len(EXTRA.split(","))
    return spark.createDataFrame([(*r, *[None] * width) for r in rows], f"{schema}, {EXTRA}")


@pytest.fixture(scope="session")
def documents(spark):
    return frame(spark, small_documents(), "doc_id long, text string, source string").repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return frame(spark, [], "doc_id long, text string, source string")
