"""Clusters against a plain implementation in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from factspan.llm import centroids
from factspan.llm.centroids import Block, centroid_clusters

WIDTH = 64
SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, parts int"


def drawn(seed, spread=1.0):
    draw = random.Random(seed)
    return [round(draw.gauss(0, spread), 3) for _ in range(WIDTH)]


def vectors():
    rows = [(i, drawn(i % 40, 0.3)) for i in range(150)]  # copies of some
    rows += [(1000 + i, [0.25] * WIDTH) for i in range(60)]  # a hot vector
    rows += [(7, drawn(900)), (7, drawn(901)), (None, drawn(902)), (None, drawn(902))]
    rows += [(300, drawn(1) + [0.0]), (301, [0.5]), (302, []), (303, None)]
    rows += [(304, [None, *drawn(2)[1:]]), (305, [math.nan, *drawn(2)[1:]])]
    rows += [(306, [-math.inf, *drawn(2)[1:]]), (307, [2.0**18, *drawn(2)[1:]])]
    rows += [(308, [131072.0, -131072.0] * 32)]
    return rows


def brute(rows, k, rounds, scale, seed):
    kept = []
    for vec_id, v in rows:
        fine = v is not None and len(v) == WIDTH and None not in v
        if fine and all(math.isfinite(x) and abs(x) * scale <= 1 << 27 for x in v):
            v = [float(np.float32(x)) for x in v]
            kept.append((vec_id, v, [math.floor(scale * x) for x in v]))

    def place(row):
        text = hashlib.sha256(f"{seed}:{row[0]}".encode()).hexdigest()
        return (row[0] is None, "" if row[0] is None else text, row[1])

    middles = [q for _, _, q in sorted(kept, key=place)[:k]]

    def near(q):
        gaps = [sum((a - b) ** 2 for a, b in zip(q, m, strict=True)) for m in middles]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(rounds):
        members = {}
        for _, _, q in kept:
            members.setdefault(near(q)[0], []).append(q)
        for c, qs in members.items():
            middles[c] = [sum(parts) // len(qs) for parts in zip(*qs, strict=True)]
    found = [(vec_id, *near(q)) for vec_id, _, q in kept]
    inertia = {c: sum(d for _, b, d in found if b == c) for _, c, _ in found}
    whole = sum(inertia.values())
    return sorted(((i, c, d, middles[c], inertia[c], whole) for i, c, d in found), key=str)


@pytest.mark.parametrize("k, rounds, block", [(8, 4, 8192), (3, 10, 16), (500, 2, 50)])
def test_clusters(spark, monkeypatch, k, rounds, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = vectors()
    table = spark.createDataFrame([(*r, 0, "x", "y", 1) for r in rows], SCHEMA).repartition(5)
    found = centroid_clusters(table, k=k, rounds=rounds)
    got = sorted(([*tuple(r)] for r in found.collect()), key=lambda r: str(tuple(r)))
    assert [tuple(r) for r in got] == brute(rows, k, rounds, 1024, 3)


def test_no_vectors(spark):
    assert centroid_clusters(spark.createDataFrame([], SCHEMA)).collect() == []
    useless = [(1, None, 0, "", "", 0), (2, [1.0], 0, "", "", 0)]
    assert centroid_clusters(spark.createDataFrame(useless, SCHEMA)).collect() == []


def test_a_table_row_for_each_occurring_value():
    parts = np.array([-3, 4, 0, 5, 9], np.int64)  # two values in dimension 0, three in 1
    codes = np.array([[0, 2], [1, 4], [0, 3]], np.int32)
    block = Block(parts.tobytes(), np.array([0, 2, 5], np.int64).tobytes(), codes.tobytes())
    middles = np.array([[0, 0], [4, 9]])
    assert block.distances(middles).tolist() == [[9, 130], [97, 0], [34, 65]]
    assert block.nearest(np.array([[0, 0], [0, 0]]))[0].tolist() == [0, 0, 0]
