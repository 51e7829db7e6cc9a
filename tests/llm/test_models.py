"""Scores, searches, mixtures and renderings against brute force or held-out labels."""

import math
import random
import re
import string
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factspan.llm import hmm, mixture, topk
from factspan.llm.chat import escaped, perspectives, unescaped
from factspan.llm.hmm import CLASSES, STATES, Model, expected, language_scores, log_likelihoods
from factspan.llm.mixture import mixed_to_weights
from factspan.llm.quality import fitted, quality_scores
from factspan.llm.topk import top_k
from factspan.llm.toxicity import severities, without_toxic
from tests.llm.conftest import frame, prose, small_documents

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Top-k


def vectors():
    draw = random.Random(5)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 1.5]) for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 340)]
    rows += [(340, None), (341, [1.0, None]), (342, [float("nan")] * 6), (343, [math.inf] * 6)]
    rows += [(344, []), (345, [2.0]), (None, [1.0] * 6), (20, rows[20][1])]
    # Rows that repeat an id, with other vectors.
    rows += [(40, rows[60][1]), (41, rows[3][1]), (41, rows[4][1])]
    return rows


@pytest.mark.parametrize("small", [True, False])
def test_top_k(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 16), ("RANGE", 64), ("PACK", 4), ("PACKS_A_TASK", 1)):
            monkeypatch.setattr(topk, name, value)
    table = spark.createDataFrame([(*r, 1, 2) for r in vectors()], "vec_id long, embedding array<float>, rank int, score long")
    found = sorted(tuple(r) for r in top_k(table, k=20).collect())
    ints = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in vectors()
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    want = []
    for own, (q, query) in enumerate(ints):
        if q % 20 == 0:
            scored = [
                (-sum(a * b for a, b in zip(query, v)), c)
                for place, (c, v) in enumerate(ints)
                if place != own
            ]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scored)[:20], 1)]
    assert found == sorted(want)
    assert top_k(table.limit(0)).collect() == []


# Language model


def test_base_scores_and_likelihoods(documents):
    rows = small_documents()
    tokens = [(d, [w for w in words((t or "").translate(LOWER))] + [""]) for d, t, *_ in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, ws in tokens:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want.append((str(d), held(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6)))
    found = language_scores(documents).collect()
    got = [
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
        for r in found
    ]
    assert sorted(got) == sorted(want)
    assert all(math.isfinite(r.score) for r in found)
    again = {(r.doc_id, r.n_tokens, round(r.score, 6)) for r in language_scores(documents).collect()}
    assert again == {(r.doc_id, r.n_tokens, round(r.score, 6)) for r in found}


def model(seed: int) -> Model:
    draw = np.random.default_rng(seed)
    share = lambda x: x / x.sum(axis=1, keepdims=True)
    emit = np.zeros((CLASSES, STATES))
    emit[:5] = draw.random((5, STATES))
    return Model(
        share(draw.random((2, STATES))),
        share(draw.random((STATES, STATES))),
        emit / emit.sum(axis=0),
        np.full(CLASSES, 1 / CLASSES),
    )


def test_forward_recursion_sums_over_all_paths():
    m = model(1)
    codes = np.array([0, 3, 1, 4, 2, 2, 0], np.uint16)
    start, size = np.array([0, 4]), np.array([4, 3])
    found = log_likelihoods(codes, start, size, m)
    for a, n, got in zip(start, size, found, strict=True):
        total = 0.0
        paths = [((), 1.0)]
        for t in range(n):
            paths = [
                (
                    (*p, s),
                    w * (m.move[p[-1], s] if p else m.start[0, s]) * m.emit[codes[a + t], s],
                )
                for p, w in paths
                for s in range(STATES)
            ]
        total = sum(w for _, w in paths)
        assert math.isclose(got, math.log10(total), rel_tol=1e-9)
    # All sequences of one length have probability one in all.
    every = np.array([[a, b, c] for a in range(5) for b in range(5) for c in range(5)], np.uint16)
    sums = log_likelihoods(every.ravel(), np.arange(125) * 3, np.full(125, 3), m)
    assert math.isclose((10**sums).sum(), 1, rel_tol=1e-9)


def test_baum_welch_counts_are_posteriors():
    m = model(2)
    codes = np.array([0, 3, 1, 4, 2], np.uint16)
    counts = expected(codes, np.array([0, 3]), np.array([3, 2]), np.array([0, 1]), m)
    first, moved = counts[: 2 * STATES], counts[2 * STATES : 2 * STATES + STATES**2]
    assert np.allclose(first.reshape(2, STATES).sum(axis=1), 1, atol=1e-5)
    assert np.isclose(moved.sum(), 3, atol=1e-5)
    shown = counts[2 * STATES + STATES**2 :].reshape(CLASSES, STATES).sum(axis=1)
    assert np.allclose(shown[:5], 1, atol=1e-5)


def test_words_of_one_ending_have_counts_of_their_own(spark, monkeypatch):
    """No word is frequent enough for a class: only counts by word tell xabc from yabc."""
    monkeypatch.setattr(hmm, "FREQUENT", 0)
    draw = random.Random(6)
    text = lambda side: " ".join(
        f"{side}abc" if draw.random() < 0.1 else f"{side}{draw.randrange(30)}" for _ in range(60)
    )
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, text("xy"[k % 2])) for k, i in enumerate(train)]
    own = text("x")
    rows += [(held[0], own), (held[1], own.replace("xabc", "yabc"))]
    found = {r.doc_id: r for r in language_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gain = [found[i].score - found[i].base_score for i in held]
    assert own.count("xabc") > 2 and gain[0] > gain[1] + 1


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {name for name in names if name.startswith("shuffle_")}


def test_shuffles_of_training_do_not_stay_on_disk(spark):
    rows = [(i, prose(i, 40)) for i in range(40)]
    before = _shuffle_files(spark)
    scores = language_scores(spark.createDataFrame(rows, "doc_id long, text string"))
    until = time.time() + 10
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert scores.count() == scores.count() == 40


def test_words_in_many_buckets(spark, monkeypatch):
    """Texts in chunks of their own, a few words to a bucket: scores as with a single one."""
    rows = [(i, f"{prose(i, 30)} own{i}") for i in range(24)] + [(24, None), (25, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = sorted(tuple(r) for r in language_scores(table).collect())
    monkeypatch.setattr(hmm, "CHUNK_BYTES", 1)
    monkeypatch.setattr(hmm, "BUCKET_PLACES", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        apart = sorted(tuple(r) for r in language_scores(table).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r[:5] for r in whole] == [r[:5] for r in apart]
    for a, b in zip(whole, apart, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-4)


# Classifiers


def labelled():
    draw = random.Random(9)
    docs, marks = [], []
    for i in range(400):
        bad, toxic = draw.random() < 0.3, draw.random() < 0.3
        text = " | ".join(words(prose(i, 40))) if bad else prose(i, 60)
        if toxic:
            at = draw.randrange(10, len(text))
            text = f"{text[:at]} " + " ".join(draw.choice(["vileword", "nastything"]) for _ in range(draw.randrange(1, 6))) + text[at:]
        docs.append((i, text, "a"))
        marks.append((i, int(not bad), int(toxic)))
    docs += [(None, "no id", "a"), (None, None, None), (900, None, "a"), (901, "", "a"), (3, docs[3][1], "a")]
    marks += [(None, 1, 1), (5, None, None), (7, marks[7][1], marks[7][2]), (999, 1, 1)]
    return docs, marks


@pytest.fixture(scope="module")
def labelled_tables(spark):
    docs, marks = labelled()
    return (
        frame(spark, docs, "doc_id long, text string, source string"),
        spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, text string"),
    )


def test_quality_on_held_out_rows(spark, labelled_tables):
    docs, labels = labelled_tables
    found = quality_scores(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert all(r.predicted == int(r.score >= 0.3) for r in found)
    truth = {i: q for i, q, _ in labelled()[1] if q is not None}
    tested = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert len(tested) > 50 and np.mean([p == q for p, q in tested]) > 0.95
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).collect() == []


def test_pairs_learn_what_single_features_cannot():
    draw = np.random.default_rng(4)
    x = np.zeros((4000, 19))
    x[:, :2] = draw.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = fitted(x[:3000], y[:3000])
    assert ((m.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_toxicity_grades(labelled_tables):
    docs, labels = labelled_tables
    found = severities(docs, labels, training_rows=300).collect()
    truth = {i: t for i, _, t in labelled()[1] if t is not None}
    pairs = [(r.toxicity > 0.5, truth[r.doc_id]) for r in found if r.doc_id in truth]
    assert np.mean([p == bool(t) for p, t in pairs]) > 0.97
    assert all(0 <= r.severity <= 3 and r.grade in range(4) for r in found)
    counts = {i: len(re.findall("vileword|nastything", t or "")) for i, t, _ in labelled()[0]}
    few = [r.severity for r in found if counts.get(r.doc_id) == 1]
    many = [r.severity for r in found if counts.get(r.doc_id) == 5]
    assert np.mean(few) + 0.5 < np.mean(many)
    clean = without_toxic(docs, labels, training_rows=300)
    assert clean.columns == docs.columns
    kept = Counter(r.doc_id for r in clean.collect())
    assert sum(truth.get(d, 0) for d in kept) < 4 and kept[None] == 2 and kept[3] in (0, 2)
    assert severities(docs.limit(0), labels).collect() == []
    assert {r.grade for r in severities(docs, labels.limit(0)).collect()} == {0}


# Mixture


def shares(sizes, weights, percent, most):
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        level = (sum(sizes.values()) * percent / 100 - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > most * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in free}
        target |= {s: most * sizes[s] for s in above}
        free -= above
    return target


@pytest.mark.parametrize(("percent", "most"), [(150, 2), (40, 1), (290, 3), (500, 2)])
def test_mixture(spark, documents, percent, most):
    rows = mixed_to_weights(documents, (5, 2, 1), percent, most).collect()
    sizes = Counter()
    for d, t, s in small_documents():
        sizes[s] += len(words(t))
    want = shares(sizes, (5, 2, 1), percent, most)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= most * r.size
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
    got = sorted((str(r.doc_id), r.size) for r in rows)
    assert got == sorted((str(d), len(words(t))) for d, t, _ in small_documents())
    again = mixed_to_weights(documents.repartition(3), (5, 2, 1), percent, most).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_mixture_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixture, "_COPIES", 8)
    rows = [(None, "x " * (i % 3), "a") for i in range(100)] + [(7, "y y", "a")] * 50
    rows += [(i, "z", "b") for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixed_to_weights(table, (5, 2), 100, 2).collect()
    got = Counter((r.doc_id, r.source, r["size"]) for r in found)
    assert got == Counter((d, s, len(t.split())) for d, t, s in rows)
    for source, total in (("a", 199), ("b", 20)):
        mine = [r for r in found if r.source == source]
        assert {r.source_size for r in mine} == {total}
        assert sum(r.taken for r in mine) == math.floor(mine[0].target + 1e-9)
        assert all(0 <= r.taken <= 2 * r["size"] for r in mine)


def test_mixture_of_nothing(spark, no_documents):
    assert mixed_to_weights(no_documents).collect() == []
    rows = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixed_to_weights(rows).collect()] == [0, 0]


# Dialogues


def test_perspectives(spark):
    turns = [
        (1, 0, "system", "Be <|im_start|> kind & brief"), (1, 1, "ann", "hi"), (1, 2, "bob", None),
        (1, 2, "ann", "again"), (1, None, None, "last"), (1, 1, "ann", "hi"), (2, 0, "system", "x"),
        (None, 0, "cid", "é" * 3),
    ]
    turns += [(3, i, "ab"[i % 2], f"t{i}") for i in range(150)]
    table = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, piece int")
    views = {(r.conv_id, r.speaker, r.piece): r for r in perspectives(table).collect()}
    assert {k for k in views if k[0] != 3} == {
        (1, s, p) for s in ("ann", "bob", "unknown") for p in (0, None)
    } | {(None, "cid", 0)}
    assert views[1, "ann", 0].rendered == (
        "<|im_start|>system\nBe &lt;|im_start|> kind &amp; brief<|im_end|>\n"
        "<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>assistant\nagain<|im_end|>\n"
        "<|im_start|>user name=bob\n<|im_end|>\n"
    )
    for (_, speaker, _), r in views.items():
        parts = [r.rendered[s.start : s.stop] for s in r.spans]
        assert all(p.endswith("<|im_end|>") for p in parts)
        assert len(parts) == r.rendered.count("<|im_start|>assistant\n")
        assert f"name={speaker}\n" not in r.rendered
    assert [views[3, "a", p].n_turns for p in (0, 1, 2)] == [64, 64, 22]
    assert perspectives(table.limit(0)).collect() == []
    back = spark.createDataFrame([("a &lt;| <| & &amp;|",)], "t string")
    assert back.select(unescaped(escaped(F.col("t")))).first()[0] == "a &lt;| <| & &amp;|"
