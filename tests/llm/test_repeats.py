"""Near copies, passages, byte strings and benchmark items against brute force."""

import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factspan.llm import neardup, repeats
from factspan.llm.components import connected_components
from factspan.llm.decontaminate import leaks, without_leaks
from factspan.llm.neardup import near_duplicates, super_min_hash
from factspan.llm.runindex import run_index, without_repeats
from factspan.llm.substring import without_passages
from tests.llm.conftest import frame, prose, small_documents

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def shingles(text, width):
    w = words(text, lower=True)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near(rows, width, percent):
    """Rows as the operator returns them, from all pairs of texts."""
    sets = [(d, shingles(t, width)) for d, t, *_ in rows]
    up = {d: d for d, _ in sets if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None in (a, b) or not x or not y:
                continue
            if 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((top(a), top(b)))
                up[high] = low
    return sorted(
        [(d, len(s), top(d), top(d) == d) if d is not None else (None, len(s), None, True) for d, s in sets],
        key=str,
    )


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(documents, width):
    found = [tuple(r) for r in near_duplicates(documents, width, 80).collect()]
    assert sorted(found, key=str) == near(small_documents(), width, 80)


def test_chains_and_many_texts_below_the_threshold(spark):
    """A shared beginning puts all into one bucket; only some pairs are similar."""
    rows = [(i, f"a b c d e f g h i j {prose(i, 7)}", None) for i in range(60)]
    step = prose(500, 60).split()
    rows += [(100 + i, " ".join(step[i : i + 50]), None) for i in range(10)]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    found = [tuple(r) for r in near_duplicates(docs, 4, 80).collect()]
    assert sorted(found, key=str) == near(rows, 4, 80)


def test_large_families_are_compared_by_size(spark, monkeypatch):
    """A member meets those of like size, and no similar pair is lost, at the edge of a class either."""
    monkeypatch.setattr(neardup, "_BLOCK", 16)
    draw = random.Random(4)
    sets, node = [], 0
    for size in (10, 12, 15, 16, 19, 20, 24, 25, 40, 50, 80, 100):
        for _ in range(10):
            sets.append((node, [0, *draw.sample(range(1, 140), size - 1)]))
            node += 1
    for whole in (20, 25, 80, 100, 40):
        shingles = list(range(1000 * whole, 1000 * whole + whole))
        sets += [(node, shingles), (node + 1, shingles[: whole * 4 // 5])]
        node += 2
    # A node of several texts, one of them empty.
    sets += [(0, []), (1, sets[60][1])]
    table = spark.createDataFrame(sets, "node long, shingles array<long>")
    nodes = table.select("node").distinct()
    families = nodes.select("node", F.lit(0).cast("long").alias("family"))
    labelled = nodes.select("node", F.col("node").alias("component"))
    found = {(r.a, r.b) for r in neardup._links_of_families(table, labelled, families, 80).collect()}
    some = [(n, set(s)) for n, s in sets if s]
    wanted = {
        (a, b) for a, x in some for b, y in some if a < b and len(x & y) * 100 >= len(x | y) * 80
    }
    assert found == wanted and len(wanted) >= 6
    dealt = neardup._dealt(table, families, 80, 1)
    # In blocks of 16 alone each of the sets would be in nine pairs.
    assert dealt.count() < 5 * len(sets)


def test_signatures_agree_as_often_as_sets_do():
    draw = np.random.default_rng(3)
    common = draw.integers(0, 2**63, 80).astype(np.uint64)
    sets = [np.concatenate([common, draw.integers(0, 2**63, 20).astype(np.uint64)]) for _ in "ab"]
    owner = np.repeat([0, 1], 100)
    agree = []
    for turn in range(30):
        salted = np.concatenate(sets) ^ np.uint64(turn * 7919)
        ranks = super_min_hash(salted, owner, 2, 128)
        agree.append((ranks[0] == ranks[1]).mean())
    assert abs(np.mean(agree) - 80 / 120) < 0.02


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 52), (52, 51), (7, 7), (60, 60)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {i: 1 for i in range(1, 41)} | {50: 50, 51: 50, 52: 50}


def rank(doc_id):
    return 2**63 - 1 if doc_id is None else doc_id


def passages(rows, length):
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, rank(d)), rank(d))
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < rank(d):
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, kept, len(w), sum(gone)))
    return sorted(out, key=str)


def byte_strings(rows, length, first):
    data = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = defaultdict(list)
    for d, b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]].append(rank(d))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 2, int)
        for i in range(len(b) - length + 1):
            others = seen[b[i : i + length]]
            if (min(others) < rank(d)) if first else len(others) > 1:
                gone[i + 1 : i + 1 + length] = 1
        kept = bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)
        out.append((d, kept, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum())))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [64, 1])
def test_passages(documents, monkeypatch, most):
    """With one class an anchor, every group that differs is split into longer anchors."""
    monkeypatch.setattr(repeats, "MOST_CLASSES", most)
    found = [tuple(r) for r in without_passages(documents, 50).collect()]
    assert sorted(found, key=str) == passages(small_documents(), 50)


@pytest.mark.parametrize(("most", "first"), [(64, False), (1, False), (64, True), (1, True)])
def test_byte_strings(documents, monkeypatch, most, first):
    monkeypatch.setattr(repeats, "MOST_CLASSES", most)
    found = without_repeats(documents, 400, first).drop("row").collect()
    found = [(d, bytes(k), *rest) for d, k, *rest in found]
    assert sorted(found, key=str) == byte_strings(small_documents(), 400, first)


def test_classes_of_many_rows_are_dealt_with_where_they_are(documents, monkeypatch):
    wanted = sorted(map(str, without_passages(documents, length=50).collect()))
    monkeypatch.setattr(repeats, "HOT", 1)  # every class with two rows is a hot one
    assert sorted(map(str, without_passages(documents, length=50).collect())) == wanted



def test_long_texts_go_in_parts(documents, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 1000)
    symbols = np.random.default_rng(1).integers(0, 3, 5000).astype(np.uint64)
    cuts = np.array([0, 2500, 5000])
    parts = list(repeats._parts(symbols, cuts, 50))
    starts = []
    for part, ends, unit, offset in parts:
        found = repeats.anchors(part, ends, 20, 50)
        for a, n in zip(found["start"] + offset, found["n"], strict=True):
            starts += [(unit, s) for s in range(a, a + n)]
    assert sorted(starts) == [(u, s) for u in (0, 1) for s in range(2500 - 49)]


def test_cuts_at_whole_characters(documents):
    for row in without_repeats(documents, 401, True, whole_characters=True).collect():
        bytes(row.kept).decode()


def test_run_index_of_a_repetitive_text():
    text = np.frombuffer(b"abracadabra" * 30 + b"x" + b"abracadabra" * 20, np.uint8)
    ends = np.array([0, 331, len(text)])
    index = run_index(text, ends)
    assert len(index.run_heads) < 60 < index.size
    match, neighbour = index.stream()
    marked = bytes(text[:331]) + b"\xfe" + bytes(text[331:]) + b"\xff"
    for at, (n, other) in enumerate(zip(match.tolist(), neighbour.tolist(), strict=True)):
        if n > 0:
            assert marked[at : at + n] == marked[other : other + n]
    best = [max((match[p], *match[neighbour == p])) for p in (0, 100, 340)]
    for p, n in zip((0, 100, 340), best, strict=True):
        assert n == max(
            next((k for k in range(600) if marked[p + k : p + k + 1] != marked[q + k : q + k + 1]
                  or marked[p + k] in b"\xfe\xff"), 0)
            for q in range(len(marked)) if q != p
        )


def items():
    inner = prose(15, 30 + 35).split()
    long = prose(3, 5000).split()
    return [
        (1, " ".join(long[1000:1030])),
        (2, " ".join(long[4000:4012]).upper()),
        (3, prose(77, 25)),
        (4, "one two"),
        (5, None),
        (6, ""),
        (None, " ".join(long[:20])),
        (7, " ".join([*inner[:9], "other", *inner[10:24]])),
        (1, " ".join(long[1000:1030])),
        (8, " ".join(long[200:1100])),
    ]


def contained(rows, width, percent):
    out = []
    wanted = {(i, t) for i, t in items() if i is not None and len(words(t)) >= width}
    for d, t, *_ in rows:
        own = shingles(t, width) if len(words(t)) >= width else set()
        for i, text in wanted:
            s = shingles(text, width)
            if 100 * len(s & own) >= percent * len(s):
                out.append((d, i, len(s), len(s & own)))
    return sorted(out, key=str)


def test_leaks(spark, documents):
    bench = frame(spark, items(), "item_id long, text string")
    found = [tuple(r) for r in leaks(documents, bench).collect()]
    want = contained(small_documents(), 5, 80)
    assert len(want) > 4 and sorted(found, key=str) == want
    clean = without_leaks(documents, bench)
    assert clean.columns == documents.columns
    bad = Counter(d for d, *_ in want)
    kept = [r.doc_id for r in clean.collect()]
    assert not set(kept) & set(bad)
    assert len(kept) == len(small_documents()) - len({(d, t) for d, t, _ in small_documents() if d in bad})


def test_empty_tables(spark, documents, no_documents):
    bench = frame(spark, [], "item_id long, text string")
    assert near_duplicates(no_documents).collect() == []
    assert without_passages(no_documents).collect() == []
    assert without_repeats(no_documents).collect() == []
    assert leaks(no_documents, bench).collect() == []
    assert leaks(documents, bench).collect() == []
    assert without_leaks(documents, bench).count() == len(small_documents())


