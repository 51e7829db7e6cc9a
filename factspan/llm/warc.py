"""WARC archives in Zstandard frames with a dictionary of their own, written and read by tasks."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.llm.common import shared_folder, sliced, with_maybe, written

# Bytes of payload in an archive, and of its dictionary, at most.
ARCHIVE_BYTES, DICTIONARY_BYTES = 8 << 20, 64 << 10

# Bytes of archives that a task reads, about.
TASK_BYTES = 32 << 20

# Fixed values of the format: the version, the profile of records that repeat a payload,
# and the numbers that start a skippable frame with a dictionary and a Zstandard frame.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528

_INDEX = "archive string, place long, size long, record_id string, record_type string"
_RECORDS = (
    "page_id long, url string, record_type string, record_id string, refers_to long, "
    "payload binary, payload_bytes long, payload_digest string, intact boolean"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Records


def record_id(page_id: int | None, row: int) -> str:
    """A name that tells the page, and that no other record of the run has."""
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def _page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+):\d+>", name or "")
    return int(found[1]) if found else None


def record(
    page_id: int | None,
    row: int,
    url: str | None,
    payload: bytes,
    refers_to: tuple[int | None, int] | None,
    date: str,
) -> bytes:
    """A response with its payload, or a revisit that refers to one and has just its head.

    Both have the head of the answer, so a revisit still tells the payload's size.
    """
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if refers_to else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id(page_id, row)),
        ("WARC-Date", date),
    ]
    if url is not None:
        # White space, controls and letters beyond ASCII would not be a URI.
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to:
        fields += [("WARC-Refers-To", record_id(*refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode().split("\r\n")[1:] if line)
    return {name.lower(): value.strip() for name, value in pairs}


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record in uncompressed data."""
    place = 0
    while place < len(data):
        if not data.startswith(VERSION + b"\r\n", place):
            raise ValueError(f"no record at byte {place}")
        stop = data.index(b"\r\n\r\n", place)
        fields = _fields(data[place:stop])
        end = stop + 4 + int(fields["content-length"])
        yield fields, data[stop + 4 : end]
        place = end + 4


# Archives


def _dictionary(records: list[bytes], most: int):
    """A dictionary trained on all records; None where they are too few or too much alike."""
    import zstandard

    size = min(most, sum(map(len, records)) // 16)
    try:
        return zstandard.train_dictionary(size, records, k=512, d=8)
    except (zstandard.ZstdError, ValueError):
        return None


def archive_of(records: list[bytes], most: int = DICTIONARY_BYTES) -> tuple[bytes, list[int]]:
    """The archive of some records, and where each one's frame starts (and the last ends).

    A skippable frame with the compressed dictionary comes first, then a frame for
    each record, so any record can be read by itself. Without a dictionary the
    archive has just the frames.
    """
    import zstandard

    found = _dictionary(records, most)
    parts = []
    if found is not None:
        packed = zstandard.ZstdCompressor(level=19).compress(found.as_bytes())
        parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        found.precompute_compress(level=3)
    packer = zstandard.ZstdCompressor(level=3, dict_data=found)
    places = [len(parts[0]) if parts else 0]
    for one in records:
        parts.append(packer.compress(one))
        places.append(places[-1] + len(parts[-1]))
    return b"".join(parts), places


def unpacked(archive: bytes) -> bytes:
    """The records of an archive, uncompressed, in a row."""
    import zstandard

    found, start = None, 0
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_MAGIC:
        start = 8 + struct.unpack_from("<I", archive, 4)[0]
        content = archive[8:start]
        if struct.unpack_from("<I", content)[0] == FRAME_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(content)
        found = zstandard.ZstdCompressionDict(content)
    reader = zstandard.ZstdDecompressor(dict_data=found)
    with reader.stream_reader(memoryview(archive)[start:], read_across_frames=True) as stream:
        return stream.read()


# Equal payloads


def with_first_records(rows: DataFrame, least_bytes: int) -> DataFrame:
    """Staged rows with ``first`` (page_id, row): the record they repeat, null for responses.

    Of rows with equal payloads that with the largest page_id stays a response. Groups
    of more than a thousandth of all rows are a thousand at most; they are broadcast, so
    that no task gets all copies of one. Other rows that surely repeat nothing are not
    shuffled.
    """
    able = rows.filter(F.octet_length("payload") >= least_bytes)
    groups = able.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "row")).alias("first")
    )
    groups = written(groups.filter("n > 1"))
    bound = max(rows.count() // 1000, 1)
    hot = F.broadcast(groups.filter(F.col("n") > bound).drop("n"))
    cold = groups.filter(F.col("n") <= bound).drop("n")
    copies = rows.join(hot, "digest")
    rest = rows.join(hot, "digest", "left_anti")
    told = with_maybe(rest, [F.col("digest")], cold.select("digest"))
    alone = told.filter("not _maybe").drop("_maybe")
    alone = alone.withColumn("first", F.lit(None).cast(groups.schema["first"].dataType))
    met = told.filter("_maybe").drop("_maybe").join(cold, "digest", "left")
    every = copies.unionByName(met).unionByName(alone)
    own = F.col("first")["row"] == F.col("row")
    return every.withColumn("first", F.when(~own, F.col("first")))


# Writing and reading


def _qualified(spark: SparkSession, folder: str) -> str:
    """A folder's name as every machine understands it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(place)
    name = system.makeQualified(place).toString()
    return name.removeprefix("file:") if re.match("file:/[^/]", name) else name


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = "2000-01-01T00:00:00Z",
    url: str = "url",
    html: str = "html",
) -> tuple[str, DataFrame]:
    """Write a record for each page; (folder, index) of the archives.

    Each task packs its rows into archives of about ``archive_bytes`` of payload, with a
    dictionary trained on all of an archive's records. Of records with equal payloads
    of ``least_bytes`` or more, that with the largest page_id is a response and the
    others are revisits that refer to it; of rows that repeat this page_id one is.

    The index has (archive, place, size, record_id, record_type) of each record, as
    far as tasks have ended: archives of lost or repeated tasks are not in it. ``folder``
    is one that all machines share, by default a new one that goes with the driver.
    Null payloads are empty. Rows without page_id come last among equal ones. An empty
    table gives no archive; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder.rstrip("/") if folder else _qualified(spark, shared_folder(spark))
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col(url).cast("string").alias("url"),
        payload.alias("payload"),
        F.unhex(F.sha2(payload, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    # The numbers of rows stay as they are once written.
    decided = with_first_records(written(rows), least_bytes).drop("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = FileSystem.from_uri(folder)
        system.create_dir(path)
        for whole in batches:
            for batch in sliced(whole, "payload", archive_bytes):
                names, kinds, records = [], [], []
                for row in batch.to_pylist():
                    first = row["first"] and (row["first"]["page_id"], row["first"]["row"])
                    names.append(record_id(row["page_id"], row["row"]))
                    kinds.append("revisit" if first else "response")
                    records.append(
                        record(row["page_id"], row["row"], row["url"], row["payload"], first, date)
                    )
                data, places = archive_of(records)
                name = f"{uuid.uuid4().hex}.warc.zst"
                with system.open_output_stream(f"{path}/{name}", compression=None) as out:
                    out.write(data)
                sizes = [b - a for a, b in zip(places[:-1], places[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(names)),
                        pa.array(places[:-1], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(names),
                        pa.array(kinds),
                    ],
                    ["archive", "place", "size", "record_id", "record_type"],
                )

    return folder, written(decided.mapInArrow(run, _INDEX))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records of the archives in ``index``, read back from their files.

    ``payload`` is null for revisits; their size and digest are what their heads tell.
    A response's size and digest are those of the payload as read, and ``intact`` says
    whether its head tells the same digest. ``refers_to`` is the page of the record
    that a revisit repeats.
    """
    archives = index.groupBy("archive").agg(F.sum("size").alias("size"))
    total = archives.agg(F.count("archive"), F.sum("size")).first()
    if not total[0]:
        return index.sparkSession.createDataFrame([], _RECORDS)
    # Names are few bytes; what tasks read goes by the files behind them.
    parts = max(index.sparkSession.sparkContext.defaultParallelism, total[1] // TASK_BYTES)
    files = archives.select("archive").repartition(min(total[0], parts), "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("page_id", pa.int64()),
                ("url", pa.string()),
                ("record_type", pa.string()),
                ("record_id", pa.string()),
                ("refers_to", pa.int64()),
                ("payload", pa.binary()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("intact", pa.bool_()),
            ]
        )
        system, path = FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive"):
                with system.open_input_stream(f"{path}/{name}", compression=None) as file:
                    content = file.read()
                rows = []
                for fields, block in records_of(unpacked(content)):
                    told = fields["warc-payload-digest"].removeprefix("sha1:")
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind, own = fields["warc-type"], fields["warc-record-id"]
                    is_response = kind == "response"
                    size = len(payload) if is_response else int(_fields(head)["content-length"])
                    digest = sha1_base32(payload) if is_response else told
                    rows.append(
                        (
                            _page_of(own),
                            fields.get("warc-target-uri"),
                            kind,
                            own,
                            _page_of(fields.get("warc-refers-to")),
                            payload if is_response else None,
                            size,
                            digest,
                            digest == told,
                        )
                    )
                columns = zip(*rows, strict=True)
                arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return files.mapInArrow(run, _RECORDS)
