"""The pipeline on a small corpus with planted cases, and the registered queries."""

import os

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import prose


def corpus():
    docs, labels = [], []
    for i in range(200):
        toxic = i % 10 == 3
        text = prose(1000 + i, 120, 3000) + (" vileword nastything" * 2 if toxic else "")
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(toxic)))
    passage, item = prose(7, 70, 3000), prose(8, 30, 3000)
    plant = {
        300: docs[5][1].replace("w1", "y1", 1),
        301: docs[5][1],
        302: f"{prose(31, 40)} {passage} {prose(32, 40)}",
        303: f"{prose(33, 40)} {passage} {prose(34, 40)}",
        304: f"{prose(35, 60)} {item} {prose(36, 60)}",
        305: prose(37, 30) + " vileword nastything vileword",
    }
    docs += [(i, t, "en", "s1", len(t)) for i, t in plant.items()]
    docs += [(306, None, None, None, None), (307, "", "en", "s1", 0), (None, prose(38, 50), "en", "s2", 1)]
    return docs, labels, [(1, item), (2, prose(9, 20, 3000)), (3, None)], passage


def test_stages(spark, tmp_path):
    docs, labels, bench, passage = corpus()
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "benchmark": (bench, "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    toxic = {i for i, _, t in labels if t} | {305}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        now = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen.append({r.doc_id: r for r in now.collect()})
        if name != "mixture":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first, near, cut, clean, mix = seen
    everything = {d[0] for d in docs}
    assert set(first) == everything - toxic
    assert set(near) == set(first) - {300, 301}
    assert passage in cut[302].text and passage not in cut[303].text
    assert cut[303].n_chars == len(cut[303].text) and set(cut) == set(near)
    assert cut[306].text is None and cut[307].text == ""
    unchanged = set(cut) - {303}
    assert all(cut[i].text == near[i].text and cut[i].n_chars == near[i].n_chars for i in unchanged)
    assert set(clean) == set(cut) - {304}
    assert set(mix) <= set(clean) and all(r.taken > 0 for r in mix.values())
    whole = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {tuple(r) for r in mix.values()}


def test_passages_of_short_words_are_cut(spark):
    """Over 50 words in less than 240 bytes: digits, a repeated word; 50 words stay."""
    digits = " ".join(str(i * i % 10) for i in range(51))
    fifty = " ".join(f"{i * i * i % 10}" for i in range(50))
    same = "la " * 59 + "la"
    texts = {
        1: f"{prose(1, 9)}\n{digits}\tend", 2: f"start {digits} {prose(2, 9)}",
        3: f"{prose(3, 9)} {fifty} a", 4: f"{prose(4, 9)} {fifty} b",
        5: same, 6: f"é {same}", 7: digits[1:], 8: f"x{digits}",
    }
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    ).repartition(3)
    found = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert found == texts | {2: f"start  {prose(2, 9)}", 6: "é "}


def test_near_copies_are_judged_by_row(spark):
    a, b, c, d = (prose(i, 40, 3000) for i in range(50, 54))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d), (None, c), (9, None), (9, "")]
    rows += [(8, d.replace("w1", "y1", 1)), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    kept = [(1, a), (2, b), (3, c), (8, rows[10][1]), (9, None), (9, ""), (9, "")]
    assert sorted(found, key=str) == sorted(kept, key=str)


CLASHING = "_hash, _word, _bits, _maybe, _null, row, id, place, kept, whole, given, marks, uid1, _rest, best"


def test_columns_of_any_name_and_empty_tables(spark, tmp_path):
    docs, labels, bench, _ = corpus()
    spark.createDataFrame(labels[:40], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = CLASHING.split(", ")
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, t, s, *[f"{n}{i}" for n in names]) for i, t, _, s, _ in docs[195:]]
    table = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (table, table.limit(0)):
            found = stage(spark, given, str(tmp_path))
            assert found.columns == table.columns, name
            for r in found.collect():
                assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names], name
    assert corpus_pipeline.mixture(spark, table.limit(0), str(tmp_path)).collect() == []


def test_every_operator_has_a_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(os.path.dirname(corpus_pipeline.__file__))
