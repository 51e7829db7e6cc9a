"""Alignment of two tokenizers over a corpus: groups of tokens, links, counts of id pairs."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.common import sliced, written

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"

_CHUNKS = (
    "chunk string, doc_id array<long>, n_a array<long>, n_b array<long>, "
    "n_groups array<long>, n_links array<long>, groups array<binary>, "
    "same_doc array<int>, same_a array<int>, same_n array<int>, "
    "odd_a array<int>, odd_b array<int>, odd_docs array<int>, "
    "odd_doc array<int>, odd_at array<int>, odd_n array<int>"
)
_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
    "count_sum long, groups binary"
)

# A chunk is a row of up to half a megabyte; readers and writers hold a row group at a time.
_GROUP_BYTES = 4 << 20


# Vocabularies


def _flat(lists: list) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with the bytes of every id, and A's ids mapped to B's of equal bytes."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(f"{folder}/{BYTE_BPE}")
        # Strings of special tokens inside texts are plain text.
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}")
        known, symbols = self.a.get_vocab(with_added_tokens=True), _byte_of_symbol()
        bytes_a = [b""] * (max(known.values()) + 1)
        for token, number in known.items():
            bytes_a[number] = bytes(symbols[symbol] for symbol in token)
        size = self.b.get_piece_size()
        single = [self.b.is_byte(number) for number in range(size)]
        pieces = [self.b.id_to_piece(number) for number in range(size)]
        bytes_b = [
            bytes([int(piece[3:5], 16)]) if one else piece.replace("▁", " ").encode()
            for piece, one in zip(pieces, single, strict=True)
        ]
        self.bytes_a, self.bytes_b = (pa.array(x, pa.large_binary()) for x in (bytes_a, bytes_b))
        self.sizes_a, self.sizes_b = (
            np.array([len(x) for x in table], np.int64) for table in (bytes_a, bytes_b)
        )
        # Of pieces with equal bytes the one that isn't a byte's fallback is the usual one.
        usual = {}
        for number in sorted(range(size), key=lambda i: (not single[i], -i)):
            usual[bytes_b[number]] = number
        self.same = np.array([usual.get(x, -1) for x in bytes_a], np.int64)
        # How an id is written where groups are told: what follows says if it is a side's last.
        a, b = ([str(i).encode() for i in range(len(table))] for table in (bytes_a, bytes_b))
        texts = [x + b"," for x in a] + [x + b"|" for x in a]
        texts += [x + b"," for x in b] + [x + b";" for x in b]
        self.marked = pa.array(texts, pa.large_binary())
        self.text_sizes = np.array([len(x) for x in texts], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's and B's ids of all texts, one text's after another's."""
        found = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return _flat([e.ids for e in found]), _flat(self.b.encode(texts, num_threads=1))


@lru_cache(maxsize=2)
def tokenizers_in(folder: str) -> Tokenizers:
    return Tokenizers(folder)


# Groups and links of units

# Both tokenizers end a token before a space between two characters that are no white
# space: such a place can't lie within a word of A's pattern, and no piece of B has a
# space after another character. What lies between two such places is a unit: it
# always has the same tokens, so its groups and links are found once.
_CUT = re.compile(r"(?<=\S) (?=\S)")

# Units whose tokens a worker remembers, and their characters in all, at most.
MOST_UNITS, MOST_CHARACTERS = 1 << 18, 1 << 23

# Units encoded in one call of a tokenizer.
RUN = 64


def _joined(table: pa.Array, ids: np.ndarray) -> memoryview:
    """The entries of some ids in a row."""
    data = table.take(pa.array(ids)).buffers()[2]
    return memoryview(data).cast("B") if data else memoryview(b"")


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _group_texts(
    both: Tokenizers, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int
) -> tuple[memoryview, np.ndarray]:
    """``a1,a2|b1;`` of every group in a row, and where each group's text ends."""
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    first = _ends(n_a + n_b)
    order = np.empty(len(a) + len(b), np.int64)
    rank_a = np.arange(len(a)) - _ends(n_a)[group_a]
    rank_b = np.arange(len(b)) - _ends(n_b)[group_b]
    last_a, last_b = rank_a == n_a[group_a] - 1, rank_b == n_b[group_b] - 1
    size_a, size_b = len(both.sizes_a), len(both.sizes_b)
    order[first[group_a] + rank_a] = a + size_a * last_a
    order[first[group_b] + n_a[group_b] + rank_b] = 2 * size_a + b + size_b * last_b
    return _joined(both.marked, order), _ends(both.text_sizes[order])[first]


# What is known of units: (tokens of A, tokens of B, groups, links, faithful) of each, the
# texts of their groups, and their links as pairs a * |B| + b in a row.
_Found = tuple[np.ndarray, list[bytes], np.ndarray]


def aligned(both: Tokenizers, units: list[str]) -> _Found:
    """The groups and links of some units, each read with a space before it.

    Units are encoded in runs, joined by their spaces. If any differs from the bytes of
    its tokens, each half is done by itself, down to that unit.
    """
    runs = [" ".join(units[i : i + RUN]) for i in range(0, len(units), RUN)]
    wanted = (" " + " ".join(runs)).encode()
    unit_ends = _ends(pc.binary_length(pa.array(units)).to_numpy().astype(np.int64) + 1)
    a, b = both.encode(runs)
    end_a, end_b = np.cumsum(both.sizes_a[a]), np.cumsum(both.sizes_b[b])
    # Where tokens of both end, a group ends. Where a token of either ends, a link ends:
    # between two such places lies one token of each, and no other link has that place.
    merged = np.concatenate([end_a, end_b])
    merged.sort(kind="stable")
    again = np.concatenate([[False], merged[1:] == merged[:-1]])
    either, common = merged[~again], merged[again]
    joined = _joined(both.bytes_a, a) == wanted == _joined(both.bytes_b, b)
    if not (joined and np.isin(unit_ends[1:], common, assume_unique=True).all()):
        if len(units) == 1:
            return np.zeros((1, 5), np.int64), [b""], np.zeros(0, np.int64)
        half = len(units) // 2
        parts = zip(aligned(both, units[:half]), aligned(both, units[half:]), strict=True)
        counts, texts, links = parts
        return np.concatenate(counts), texts[0] + texts[1], np.concatenate(links)
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    data, group_ends = _group_texts(both, a, b, group_a, group_b, len(common))
    firsts = [np.searchsorted(ends, unit_ends, "right") for ends in (end_a, end_b, common, either)]
    bounds = group_ends[firsts[2]].tolist()
    # A unit's text is that of its groups, less the last semicolon.
    texts = [bytes(data[x : y - 1]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    id_a, id_b = a[np.searchsorted(end_a, either)], b[np.searchsorted(end_b, either)]
    counts = np.stack([*map(np.diff, firsts), np.ones(len(units), np.int64)], axis=1)
    return counts, texts, id_a * len(both.sizes_b) + id_b


class Units:
    """Remembers the groups and links of units; forgets all when there are too many."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.clear()

    def clear(self) -> None:
        # A unit that is asked for the first time gets the next place.
        self.index: dict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.characters = 0
        self.counts, self.texts, self.links = np.zeros((0, 5), np.int64), [], np.zeros(0, np.int64)

    def places(self, units: Iterable[str], count: int) -> np.ndarray:
        """Where each unit is; those not known yet are aligned first."""
        if len(self.index) > MOST_UNITS or self.characters > MOST_CHARACTERS:
            self.clear()
        known = len(self.index)
        places = np.fromiter(map(self.index.__getitem__, units), np.int64, count)
        new = list(islice(self.index, known, None))
        if new:
            self.characters += sum(map(len, new))
            counts, texts, links = aligned(self.both, new)
            self.counts = np.concatenate([self.counts, counts])
            self.texts += texts
            self.links = np.concatenate([self.links, links])
        return places


@lru_cache(maxsize=2)
def units_in(folder: str) -> Units:
    return Units(tokenizers_in(folder))


# Texts


def _summed(owner: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros((size, *values.shape[1:]), np.int64)
    np.add.at(total, owner, values)
    return total


def aligned_texts(known: Units, texts: list[str]) -> dict[str, np.ndarray | list]:
    """What a chunk of texts has of each column of the chunk table."""
    both, count = known.both, len(texts)
    split = [_CUT.split(t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, count)
    places = known.places(chain.from_iterable(split), sizes.sum())
    ends = _ends(sizes)
    text = np.repeat(np.arange(count), sizes)
    # One unit whose bytes differ makes the text differ.
    fine = np.ones(count, bool)
    fine[text[known.counts[places, 4] == 0]] = False
    kept = fine[text]
    counts = _summed(text[kept], known.counts[places[kept], :4], count)
    digests = [
        hashlib.sha256(b";".join([known.texts[i] for i in places[x:y].tolist()])).digest()
        if ok and y > x
        else None
        for ok, x, y in zip(fine, ends[:-1].tolist(), ends[1:].tolist(), strict=True)
    ]
    # A text's distinct units and how often it has them, then their links.
    width = max(len(known.texts), 1)
    distinct, often = np.unique(text[kept] * width + places[kept], return_counts=True)
    owner, unit = distinct // width, distinct % width
    link_ends = _ends(known.counts[:, 3])
    n = known.counts[unit, 3]
    at = np.repeat(link_ends[unit] - _ends(n)[:-1], n) + np.arange(n.sum())
    width_a, width_b = len(both.sizes_a), len(both.sizes_b)
    keys = np.repeat(owner, n) * (width_a * width_b) + known.links[at]
    keys, inverse = np.unique(keys, return_inverse=True)
    links = _summed(inverse, np.repeat(often, n), len(keys))
    doc, pair = keys // (width_a * width_b), keys % (width_a * width_b)
    id_a, id_b = pair // width_b, pair % width_b
    # The fast path: pairs of ids with equal bytes are counted by A's id alone.
    same = both.same[id_a] == id_b
    odd = ~same
    pairs, odd_at, odd_docs = np.unique(pair[odd], return_inverse=True, return_counts=True)
    return {
        "n_a": counts[:, 0],
        "n_b": counts[:, 1],
        "n_groups": counts[:, 2],
        "n_links": counts[:, 3],
        "groups": digests,
        "same_doc": doc[same],
        "same_a": id_a[same],
        "same_n": links[same],
        "odd_a": pairs // width_b,
        "odd_b": pairs % width_b,
        "odd_docs": odd_docs,
        "odd_doc": doc[odd],
        "odd_at": odd_at,
        "odd_n": links[odd],
    }


def _chunks(docs: DataFrame, folder: str) -> DataFrame:
    """One row per chunk of texts, with its links counted by text and by pair of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = units_in(folder)
        for whole in batches:
            for batch in sliced(whole):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                found = aligned_texts(known, texts)
                ids = pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64()))
                columns = [pa.array([uuid.uuid4().hex]), ids]
                for name, values in found.items():
                    kind = pa.int64() if name.startswith("n_") else pa.int32()
                    kind = pa.binary() if name == "groups" else kind
                    columns.append(pa.ListArray.from_arrays([0, len(values)], pa.array(values, kind)))
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "doc_id", *found])

    return docs.mapInArrow(run, _CHUNKS)


# Counts of pairs


def _vector(rows: DataFrame, size: int) -> np.ndarray:
    """(a, n) rows, one per id of A at most, as a vector of the vocabulary's length."""
    found = np.zeros(size, np.int64)
    for row in rows.collect():
        found[row.a] = row.n
    return found


def _same_counts(chunks: DataFrame, size: int) -> np.ndarray:
    """How many texts link each id of A to the id of B with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids = batch.column("same_a").flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(ids, minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["a", "n"])

    counted = chunks.select("same_a").mapInArrow(run, "a int, n long")
    return _vector(counted.groupBy("a").agg(F.sum("n").alias("n")), size)


def _ints(rows: pa.Table, row: int, name: str) -> np.ndarray:
    value = rows.column(name)[row]
    return value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0, np.int64)


def tokenizer_alignment(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text.

    A is the byte-level vocabulary and reads a space and the text; B is the vocabulary of
    pieces. Both cover the same bytes: places where tokens of both end cut them into
    groups, and tokens that share a byte are linked. A pair of ids counts the texts in
    which it is linked. ``n_best`` are the links whose pair has the highest count of its
    A id, ``count_sum`` adds up the counts over links, ``groups`` is the sha256 of
    ``a1,a2|b1;a3|b2`` (null without tokens).

    A vector maps each id of A to the id of B with the same bytes. Links between such
    two, as in all groups of one token each with the usual piece, are counted in vectors
    of the vocabulary's length; other pairs are counted in a table. Chunks of texts have a
    dictionary of their pairs, so a pair is shuffled once a chunk, however many texts
    have it. Texts are cut into units that both tokenizers treat alone; a worker aligns a
    unit once and remembers it. ``folder`` has the vocabulary files on every machine.

    Texts that are null, empty, or differ from the joined bytes of their tokens have no
    tokens: zeros. Each row is a text of its own, also if it repeats a doc_id or has none.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chunks = written(_chunks(rows, folder), _GROUP_BYTES)
    size = len(tokenizers_in(folder).sizes_a)
    same = _same_counts(chunks, size)
    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("odd_a", "odd_b", "odd_docs")).alias("at", "pair"))
    listed = listed.select("chunk", "at", "pair.odd_a", "pair.odd_b", "pair.odd_docs")
    pairs = written(listed.groupBy("odd_a", "odd_b").agg(F.sum("odd_docs").alias("n")))
    highest = pairs.groupBy(F.col("odd_a").alias("a")).agg(F.max("n").alias("n"))
    best = np.maximum(same, _vector(highest, size))
    answers = listed.join(pairs, ["odd_a", "odd_b"]).select(F.col("chunk").alias("of"), "at", "n")
    asked = chunks.drop("odd_b", "odd_docs")

    def run(asked: pa.Table, told: pa.Table) -> pa.Table:
        parts = []
        for row in range(asked.num_rows):
            ints = lambda name: _ints(asked, row, name)  # noqa: B023, E731
            ids = asked.column("doc_id")[row].values
            n_best, count_sum = (np.zeros(len(ids), np.int64) for _ in range(2))
            counts = np.zeros(len(ints("odd_a")), np.int64)
            counts[told.column("at").to_numpy()] = told.column("n").to_numpy()
            at = ints("odd_at")
            for text, a, n, often in (
                (ints("same_doc"), ints("same_a"), same[ints("same_a")], ints("same_n")),
                (ints("odd_doc"), ints("odd_a")[at], counts[at], ints("odd_n")),
            ):
                np.add.at(count_sum, text, n * often)
                np.add.at(n_best, text, np.where(n == best[a], often, 0))
            read = [asked.column(c)[row].values for c in ("n_a", "n_b", "n_groups", "n_links")]
            columns = [ids, *read, pa.array(n_best), pa.array(count_sum), asked.column("groups")[row].values]
            parts.append(pa.table(dict(zip(_COLUMNS, columns, strict=True))))
        return pa.concat_tables(parts)

    # Chunks and answers are sorted and stream by: a task has one chunk's at a time.
    return asked.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(run, _RESULT)
