"""Alignments against byte ranges compared one by one."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from factspan.llm import alignment, common
from factspan.llm.alignment import TOKENIZERS, tokenizer_alignment, tokenizers_in
from tests.llm.conftest import frame, small_documents

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no vocabulary files here")

SCHEMA = "doc_id long, text string, source string"


def texts():
    draw = random.Random(5)
    words = ["Straße", "the", "don't", "über-all", "1234567", "naïve", "\U0001f600", "日本語", "a", "  "]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(30))), "a") for i in range(40)]
    rows += [
        (100, "<|endoftext|> and </s> <s> <unk> <0x41>", "a"),
        (101, "low ▁ line", "a"),  # reads as a space: the bytes differ
        (102, "tabs\t\tand\nlines\r\n\r\n  end  ", "a"),
        (103, "\x00\x01 \x7f", "a"),
        (104, "é é ﬁ ​", "a"),
        (105, " leading", "a"),
        (106, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "a"),
    ]
    return rows + small_documents()


def brute(rows):
    both = tokenizers_in(TOKENIZERS)
    tables = both.bytes_a.to_pylist(), both.bytes_b.to_pylist()
    docs, counts = [], Counter()
    for doc_id, text, *_ in rows:
        links, groups, n = [], [], (0, 0)
        if text:
            sides, spans = both.encode([text]), []
            for ids, table in zip(sides, tables, strict=True):
                place, found = 0, []
                for i in ids:
                    found.append((i, place, place + len(table[i])))
                    place += len(table[i])
                spans.append(found)
            joined = [b"".join(table[i] for i, *_ in s) for s, table in zip(spans, tables, strict=True)]
            if joined == [b" " + text.encode()] * 2:
                a, b = spans
                n = len(a), len(b)
                low = 0
                for i, start, stop in a:
                    while b[low][2] <= start:
                        low += 1
                    j = low
                    while j < len(b) and b[j][1] < stop:
                        links.append((i, b[j][0]))
                        j += 1
                cuts = sorted({e for *_, e in a} & {e for *_, e in b})
                last = 0
                for cut in cuts:
                    inside = [[str(i) for i, s, e in side if last <= s and e <= cut] for side in spans]
                    groups.append("|".join(",".join(x) for x in inside))
                    last = cut
        docs.append((doc_id, *n, links, groups))
        counts.update(set(links))
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    return sorted(
        (
            (
                doc_id,
                n_a,
                n_b,
                len(groups),
                len(links),
                sum(counts[x] == highest[x[0]] for x in links),
                sum(counts[x] for x in links),
                hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else None,
            )
            for doc_id, n_a, n_b, links, groups in docs
        ),
        key=str,
    )


@pytest.mark.parametrize("most", [common.SLICE_BYTES, 300])
def test_alignment(spark, monkeypatch, most):
    # Small chunks too: a pair then is in many dictionaries.
    monkeypatch.setattr(alignment, "sliced", lambda batch: common.sliced(batch, most=most))
    rows = texts()
    table = frame(spark, rows, SCHEMA).repartition(3)
    found = [
        tuple(bytes(x).hex() if isinstance(x, bytes | bytearray) else x for x in r)
        for r in tokenizer_alignment(table).collect()
    ]
    assert sorted(found, key=str) == brute(rows)


def test_a_task_holds_few_chunks(spark, monkeypatch):
    """Chunks are read a small row group at a time, and none's answers are collected in the JVM."""
    kept = []
    run = alignment.written
    monkeypatch.setattr(alignment, "written", lambda rows, *more: kept.append(run(rows, *more)) or kept[-1])
    monkeypatch.setattr(alignment, "sliced", lambda batch: common.sliced(batch, most=300))
    monkeypatch.setattr(alignment, "_GROUP_BYTES", 1)
    found = tokenizer_alignment(frame(spark, texts(), SCHEMA).coalesce(1))
    sizes = []
    for file in kept[0].inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file://")).metadata
        sizes += [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    assert len(sizes) > 3 and set(sizes) == {1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan


def test_no_texts(spark, no_documents):
    assert tokenizer_alignment(no_documents).collect() == []
    rows = frame(spark, [(1, None, "a"), (2, "", "a")], SCHEMA)
    assert [tuple(r)[1:] for r in tokenizer_alignment(rows).collect()] == [(0,) * 6 + (None,)] * 2


def test_ids_of_equal_bytes():
    both = tokenizers_in(TOKENIZERS)
    a, b = both.bytes_a.to_pylist(), both.bytes_b.to_pylist()
    assert len(both.same) == len(a) == 50257
    for i in range(0, len(a), 97):
        assert (b[both.same[i]] == a[i]) if both.same[i] >= 0 else (a[i] not in b)
    # Letters are pieces and fallback bytes; the piece is the one that texts get.
    letter = a.index(b"a")
    assert not both.b.is_byte(int(both.same[letter]))
