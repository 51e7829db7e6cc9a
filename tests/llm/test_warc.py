"""Archives written by tasks, read back, and read frame by frame."""

import base64
import hashlib
import os
import struct
from collections import defaultdict

import pytest
import zstandard

from factspan.llm import warc
from factspan.llm.warc import archive_of, read_archives, record, records_of, unpacked, write_archives

SCHEMA = "page_id long, url string, html string, digest string, row int, first string, payload int"


def pages():
    body = "<html><body>" + "<p>one line of many</p>\n" * 40
    rows = [(i, f"http://h{i % 3}/p{i}", f"{body}<p>{i}</p>") for i in range(60)]
    rows += [(100 + i, f"http://copy/{i}", body) for i in range(50)]  # a hot payload
    rows += [(200 + i, None if i else "http://e/", "") for i in range(3)] + [(210, "u", None)]
    rows += [(220, "http://é/ a\r\nb?q=1%20&x=<y>", "née\r\n\r\nWARC/1.1\r\n")]
    rows += [(230, "a", "twin"), (230, "a", "twin"), (229, "b", "twin")]  # one id twice
    rows += [(None, "n", "nameless"), (None, "m", "nameless"), (240, "x", "known"), (None, "y", "known")]
    rows += [(250, "big", "long " * 200_000), (-5, "minus", "minus")]
    return rows


def brute(rows, least=0):
    groups = defaultdict(list)
    for i, (page_id, _, html) in enumerate(rows):
        payload = (html or "").encode()
        groups[payload if len(payload) >= least else (i, payload)].append(page_id)
    found = []
    for key, ids in groups.items():
        payload = key if isinstance(key, bytes) else key[1]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first, *others = sorted(ids, key=lambda x: (x is None, -(x or 0)))
        found.append((first, len(payload), digest, "response", None))
        found += [(i, len(payload), digest, "revisit", first) for i in others]
    return sorted(found, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "f", 2) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("least, size", [(0, warc.ARCHIVE_BYTES), (5, 4000), (1 << 30, 4000)])
def test_archives(spark, tmp_path, least, size):
    rows = pages()
    where = str(tmp_path / "archives")
    folder, index = write_archives(table(spark, rows), where, least_bytes=least, archive_bytes=size)
    records = read_archives(index, folder)
    columns = "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    found = records.collect()
    assert sorted(((tuple(r[c] for c in columns)) for r in found), key=str) == brute(rows, least)
    assert all(r.intact for r in found)
    payloads = {(p, (h or "").encode()) for p, _, h in rows}
    assert {(r.page_id, bytes(r.payload)) for r in found if r.payload is not None} <= payloads
    # The index leads to every record's own frame.
    for row in index.collect():
        data = (tmp_path / "archives" / row.archive).read_bytes()
        magic, length = struct.unpack_from("<II", data)
        known = None
        if magic == warc.DICTIONARY_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(data[8 : 8 + length])
            known = zstandard.ZstdCompressionDict(content)
        frame = data[row.place : row.place + row.size]
        ((fields, _),) = records_of(zstandard.ZstdDecompressor(dict_data=known).decompress(frame))
        assert fields["warc-record-id"] == row.record_id and fields["warc-type"] == row.record_type


def test_files_that_no_ended_task_wrote_are_not_read(spark, tmp_path):
    where = tmp_path / "archives"
    folder, index = write_archives(table(spark, pages()), str(where))
    (where / f"{'0' * 32}.warc.zst").write_bytes(b"half a file")
    assert read_archives(index, folder).count() == len(pages())


def test_no_pages(spark):
    folder, index = write_archives(table(spark, []))
    assert index.collect() == [] and read_archives(index, folder).collect() == []


def test_a_dictionary_saves_most_of_what_records_share():
    shared = os.urandom(600).hex()
    records = [record(i, i, f"http://a/{i}", f"{shared}{i}".encode(), None, "2000") for i in range(400)]
    data, places = archive_of(records)
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC and len(places) == 401
    plain = sum(len(zstandard.compress(r)) for r in records)
    assert len(data) < plain / 3
    assert unpacked(data) == b"".join(records)
    # Too few records for a dictionary: frames only.
    few, places = archive_of(records[:1])
    assert places[0] == 0 and unpacked(few) == records[0]
    assert archive_of([]) == (b"", [0])


def test_fields_stay_on_their_lines():
    ((fields, block),) = records_of(record(1, 2, "http://a/\r\nWARC-Type: x y", b"p", (None, 9), "d"))
    assert fields["warc-type"] == "revisit" and fields["warc-refers-to"] == "<urn:page::9>"
    assert block.endswith(b"Content-Length: 1\r\n\r\n")
