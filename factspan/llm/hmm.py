"""A hidden Markov language model, trained by Baum-Welch counts over all partitions.

Every word of the training documents has state counts of its own. Words are dealt into
buckets; counts are summed up by bucket and joined to the dictionary of each chunk of
documents, so the vocabulary has no limit and no task or driver holds all of it. What
a chunk and a bucket have in common travels as one row of packed columns. The rounds
that find a starting point work on classes of words: frequent ones by themselves,
others by their endings. With equal states the model is the unigram base itself;
what it gains comes from the latent states alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.common import dropped, freed, id_remainder, sliced, split_words, tidy, written

# Frequent words and word endings that are classes of their own in the first rounds.
FREQUENT, ENDINGS = 2048, 2048
END, UNKNOWN = FREQUENT + ENDINGS, FREQUENT + ENDINGS + 1
CLASSES = FREQUENT + ENDINGS + 2
STATES = 8
# Rounds by class over one sixteenth of the training documents each, then rounds by
# word over all.
SLICES, SHORT_ROUNDS, FULL_ROUNDS = 16, 8, 2
# Tokens that each word has besides its own, in the states' shares of all tokens.
PRIOR = 2.0
# Bytes of text whose words share a dictionary; tokens that are trained on together.
CHUNK_BYTES, PIECE, BATCH_TOKENS = 24 << 20, 256, 1 << 20
# Places of words in the dictionaries of chunks that make a bucket of words.
BUCKET_PLACES = 1 << 18


@dataclass(frozen=True)
class Model:
    """``start`` has a row for texts and one for later pieces of them; rows sum to 1."""

    start: np.ndarray  # 2 x states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states
    mass: np.ndarray  # unigram probability of each class


# Packed columns


def _pack(x: np.ndarray) -> bytes:
    """The numbers of an array, or of its rows, byte by byte: first bytes, second bytes, ..."""
    size = x.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), size).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes, kind: type, width: int = 1) -> np.ndarray:
    size = np.dtype(kind).itemsize * width
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    found = np.ascontiguousarray(raw.reshape(size, -1).T).view(kind)
    return found if width > 1 else found.reshape(-1)


_KINDS = {"pos": np.int32, "code": np.int32, "c": np.int64, "class": np.uint16, "n": np.float32}


def _columns(rows: pa.Table, name: str) -> list[np.ndarray]:
    """A packed column, row by row."""
    width = STATES if name == "n" else 1
    return [_unpack(blob, _KINDS[name], width) for blob in rows.column(name).to_pylist()]


def _column(rows: pa.Table, name: str) -> np.ndarray:
    """A packed column of all rows."""
    none = np.empty((0, STATES) if name == "n" else 0, _KINDS[name])
    return np.concatenate([none, *_columns(rows, name)])


# Corpus counts


def _one(values: pa.Array) -> pa.ListArray:
    """A single row that lists the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def chunks(docs: DataFrame) -> DataFrame:
    """Documents in chunks: their tokens as numbers of the chunk's own dictionary.

    ``docs`` has (doc_id, held_out, text). ``counts`` has how often each word of
    the dictionary occurs in documents that aren't held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in sliced(whole, most=CHUNK_BYTES):
                words, ends = split_words(batch.column("text"), lower=True)
                coded = words.dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                types = len(coded.dictionary)
                order = np.argsort(-np.bincount(codes, minlength=types), kind="stable")
                place = np.empty(types, np.int32)
                place[order] = np.arange(types, dtype=np.int32)
                codes = place[codes] if types else codes.astype(np.int32)
                held = batch.column("held_out").to_numpy(zero_copy_only=False)
                learnt = np.repeat(~held, np.diff(ends))
                row = {
                    "chunk": pa.array([number], pa.int64()),
                    "ids": _one(batch.column("doc_id")),
                    "held": _one(batch.column("held_out")),
                    "sizes": _one(pa.array(np.diff(ends))),
                    "tokens": pa.array([_pack(codes)], pa.binary()),
                    "words": _one(coded.dictionary.take(pa.array(order))),
                    "counts": _one(pa.array(np.bincount(codes[learnt], minlength=types))),
                }
                yield pa.RecordBatch.from_pydict(row)
                number += 1

    schema = (
        "chunk long, ids array<long>, held array<boolean>, sizes array<long>, "
        "tokens binary, words array<string>, counts array<long>"
    )
    return docs.mapInArrow(run, schema)


def _words(found: DataFrame) -> DataFrame:
    """(word, c, at): how often training documents have it, its places in dictionaries.

    Words of held-out documents alone are left out.
    """
    words = F.arrays_zip("words", "counts").alias("w")
    rows = found.select("chunk", F.posexplode(words).alias("pos", "w"))
    rows = rows.select(F.col("w.words").alias("word"), F.col("w.counts").alias("n"), "chunk", "pos")
    # A dictionary has a word once, so counting before the shuffle would save nothing.
    at = F.collect_list(F.struct("chunk", "pos")).alias("at")
    return rows.repartition("word").groupBy("word").agg(F.sum("n").alias("c"), at).filter("c > 0")


def _classes(known: DataFrame) -> DataFrame:
    """(c, class, at): the most frequent words, ties by spelling, have their own."""
    top = known.orderBy(F.col("c").desc(), "word").limit(FREQUENT).select("word").collect()
    rows = [(row.word, i) for i, row in enumerate(sorted(top))]
    own = known.sparkSession.createDataFrame(rows, "word string, own int")
    ending = F.lit(FREQUENT) + F.pmod(F.xxhash64(F.expr("right(word, 3)")), F.lit(ENDINGS))
    joined = known.join(F.broadcast(own), "word", "left")
    return joined.select("c", F.coalesce("own", ending).cast("int").alias("class"), "at")


def _places(known: DataFrame) -> DataFrame:
    """Where the words are, packed: a row for each chunk and bucket of words that meet.

    ``code`` is a word's number in its bucket, ``pos`` its number in the chunk's dictionary.
    """

    def bucket(number: int, words: list[tuple]) -> pa.RecordBatch:
        c, kind, sizes, chunk, pos = (np.concatenate(x) for x in zip(*words, strict=True))
        code = np.repeat(np.arange(len(c), dtype=np.int32), sizes)
        order = np.argsort(chunk, kind="stable")
        chunk, code = chunk[order], code[order]
        found = {"pos": pos[order], "code": code, "c": c[code], "class": kind[code]}
        starts = np.flatnonzero(np.diff(chunk, prepend=-1))
        row = {"chunk": pa.array(chunk[starts]), "bucket": pa.array(np.full(len(starts), number))}
        for name, x in found.items():
            parts = np.split(x.astype(_KINDS[name]), starts[1:])
            row[name] = pa.array([_pack(part) for part in parts], pa.binary())
        return pa.RecordBatch.from_pydict(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, words, places = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            at = batch.column("at")
            numbers = [batch.column("c"), batch.column("class"), pc.list_value_length(at)]
            numbers += at.flatten().flatten()
            words.append(tuple(x.to_numpy(zero_copy_only=False) for x in numbers))
            places += len(words[-1][-1])
            if places >= BUCKET_PLACES:
                yield bucket(number, words)
                number, words, places = number + 1, [], 0
        if places:
            yield bucket(number, words)

    schema = "chunk long, bucket long, pos binary, code binary, c binary, class binary"
    return known.mapInArrow(run, schema)


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, int]:
    """A chunk's tokens with an end mark after each text, the texts' sizes, the mark's number."""
    sizes = np.array(row["sizes"][0], np.int64) + 1
    stops = np.cumsum(sizes)
    inside = np.ones(int(sizes.sum()), bool)
    inside[stops - 1] = False
    codes = np.full(len(inside), row["types"][0], np.int32)
    codes[inside] = _unpack(row["tokens"][0], np.int32)
    return codes, sizes, row["types"][0]


def _by_chunk(found: DataFrame, rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(key, packed rows of a chunk's dictionary, the chunk)`` for each chunk."""
    slim = found.withColumnRenamed("chunk", "part")
    return rows.groupBy("chunk").cogroup(slim.groupBy("part")).applyInArrow(run, schema)


def _coded(found: DataFrame, places: DataFrame, ends: int) -> DataFrame:
    """Each training document with its classes."""

    def run(key: tuple, numbers: pa.Table, rows: pa.Table) -> pa.Table:
        row = rows.slice(0, 1).to_pydict()
        codes, sizes, types = _tokens(row)
        kind = np.full(types + 1, UNKNOWN, np.uint16)
        kind[types] = END if ends else UNKNOWN
        kind[_column(numbers, "pos")] = _column(numbers, "class")
        flat = kind[codes].tobytes()
        stops = np.cumsum(sizes)
        learnt = np.flatnonzero(~np.array(row["held"][0], bool))
        spans = zip((stops - sizes)[learnt], stops[learnt], strict=True)
        return pa.table(
            {
                "doc_id": pa.array(row["ids"][0], pa.int64()).take(pa.array(learnt)),
                "n_tokens": sizes[learnt],
                "classes": pa.array([flat[2 * a : 2 * b] for a, b in spans], pa.binary()),
            }
        )

    numbers = places.select("chunk", "pos", "class")
    return _by_chunk(found, numbers, run, "doc_id long, n_tokens long, classes binary")


# Training


def first_model(mass: np.ndarray) -> Model:
    """States that stay mostly and differ a little, by fixed pseudo-random factors."""
    random = np.random.default_rng(7)
    move = np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
    emit = mass[:, None] * np.exp(random.normal(0, 0.7, (len(mass), STATES)))
    start = np.full((2, STATES), 1 / STATES)
    return Model(start, move, _emissions(emit, mass), mass)


def _emissions(weights: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Columns that sum to 1; an unknown token has its unigram share in every state."""
    emit = weights.copy()
    emit[UNKNOWN] = 0
    total = emit.sum(axis=0)
    emit *= (1 - mass[UNKNOWN]) / np.where(total > 0, total, 1)
    emit[UNKNOWN] = mass[UNKNOWN]
    return emit


def estimated(counts: np.ndarray, mass: np.ndarray) -> Model:
    """The model of Baum-Welch counts, with one unigram token's worth of prior a state."""
    start, move, emit = _unpacked(counts)
    share = lambda x: (x + 0.1) / (x + 0.1).sum(axis=1, keepdims=True)
    return Model(share(start), share(move), _emissions(emit + mass[:, None], mass), mass)


def _unpacked(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = 2 * STATES, 2 * STATES + STATES * STATES
    return (
        counts[:a].reshape(2, STATES),
        counts[a:b].reshape(STATES, STATES),
        counts[b:].reshape(-1, STATES),
    )


def expected(codes: np.ndarray, start: np.ndarray, size: np.ndarray, later: np.ndarray, m: Model):
    """Baum-Welch counts of sequences codes[start:start + size]; ``later``: not a text's first."""
    order = np.argsort(-size, kind="stable")
    start, size, later = start[order], size[order], later[order]
    move, emit = m.move.astype(np.float32), m.emit.astype(np.float32)
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    seen, alphas, scales = [], [], []
    alpha = m.start.astype(np.float32)[later]
    for t in range(steps):
        n = active[t]
        seen.append(codes[start[:n] + t])
        if t:
            alpha = alpha[:n] @ move
        alpha = alpha * emit[seen[t]]
        scale = np.maximum(alpha.sum(axis=1, keepdims=True), np.float32(1e-30))
        alpha /= scale
        alphas.append(alpha)
        scales.append(scale)
    moved = np.zeros((STATES, STATES))
    beta = np.ones((active[-1], STATES), np.float32)
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            n = active[t + 1]
            ahead = emit[seen[t + 1]] * beta / scales[t + 1]
            moved += alphas[t][:n].T @ ahead
            beta = np.ones((active[t], STATES), np.float32)
            beta[:n] = ahead @ move.T
        alphas[t] *= beta
    first = np.zeros((2, STATES))
    for kind in (0, 1):
        first[kind] = alphas[0][later == kind].sum(axis=0)
    weight, code = np.concatenate(alphas), np.concatenate(seen)
    shown = np.stack(
        [np.bincount(code, weight[:, s], len(emit)) for s in range(STATES)], axis=1
    )
    return np.concatenate([first.ravel(), (moved * m.move).ravel(), shown.ravel()])


def _pieces(codes: np.ndarray, stops: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
    """Codes with the pieces that the documents which stop there are trained in."""
    counts = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(sizes)), counts)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (stops - sizes)[owner] + turn * PIECE
    size = np.minimum(PIECE, stops[owner] - start)
    room = max(1, BATCH_TOKENS // PIECE)
    for a in range(0, len(start), room):
        b = a + room
        yield codes, start[a:b], size[a:b], (turn[a:b] > 0).astype(np.int64)


def baum_welch(sequences: DataFrame, model: Model) -> Model:
    """One round: counts of every partition are added up, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * STATES + STATES * STATES + CLASSES * STATES)
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("classes").to_pylist()), np.uint16)
            sizes = batch.column("n_tokens").to_numpy()
            for piece in _pieces(codes, np.cumsum(sizes), sizes):
                total += expected(*piece, model)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(total[some])], ["entry", "n"]
        )

    parts = sequences.select("n_tokens", "classes").mapInArrow(run, "entry int, n double")
    rows = parts.groupBy("entry").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(2 * STATES + STATES * STATES + CLASSES * STATES)
    counts[rows["entry"].to_numpy()] = rows["n"].to_numpy()
    return estimated(counts, model.mass)


# Training by word


@dataclass(frozen=True)
class WordModel:
    """What all words have in common; their counts by state are a table.

    A word's weight in a state is its unigram probability times the state's share of
    its tokens, with ``PRIOR`` tokens in the states' shares of all tokens added; the
    weights of a state are scaled so that they and the unknown word's sum to 1.
    """

    start: np.ndarray  # 2 x states
    move: np.ndarray  # states x states
    share: np.ndarray  # of all tokens, by state
    scale: np.ndarray  # by state
    end: np.ndarray  # emission of the end mark, by state
    unknown: float
    total: float  # what counts of unigrams are divided by

    def emissions(self, numbers: pa.Table) -> np.ndarray:
        n = _column(numbers, "n").astype(float)
        base = (_column(numbers, "c") + 0.5) / self.total
        base = base / (n.sum(axis=1) + PRIOR)
        return base[:, None] * (n + PRIOR * self.share) * self.scale


def word_counts(found: DataFrame, rows: DataFrame, total: float, local: Callable) -> DataFrame:
    """(bucket, code, n, sums): Baum-Welch counts of words over all training documents, by state.

    ``rows`` has (chunk, bucket, pos, code, c) and what ``local`` needs to give (start,
    move, emissions of these rows, of the end mark). Bucket -1 has starts, moves and the
    end mark. ``sums`` are those that :func:`word_model` adds up, of a bucket's words.
    """
    special = 2 + STATES

    def run(key: tuple, numbers: pa.Table, chunk: pa.Table) -> pa.Table:
        row = chunk.slice(0, 1).to_pydict()
        codes, sizes, types = _tokens(row)
        start, move, own, end = local(numbers)
        places = _columns(numbers, "pos")
        at = np.concatenate([np.empty(0, np.int32), *places])
        emit = np.zeros((types + 1, STATES))
        emit[at], emit[types] = own, end
        m = Model(start, move, emit, emit[:, 0])
        learnt = ~np.array(row["held"][0], bool)
        counted = np.zeros(STATES * (special + types + 1))
        for piece in _pieces(codes, np.cumsum(sizes)[learnt], sizes[learnt]):
            counted += expected(*piece, m)
        counted = counted.reshape(-1, STATES).astype(np.float32)
        few = np.concatenate([counted[:special], counted[-1:]])
        parts = [(-1, np.arange(special + 1, dtype=np.int32), np.zeros(special + 1, np.int64), few)]
        buckets = numbers.column("bucket").to_pylist()
        met = zip(buckets, _columns(numbers, "code"), _columns(numbers, "c"), places, strict=True)
        for bucket, code, c, pos in met:
            n = counted[special:-1][pos]
            some = n.any(axis=1)
            if some.any():
                parts.append((bucket, code[some], c[some], n[some]))
        columns = [pa.array([part[0] for part in parts], pa.int64())]
        columns += [pa.array([_pack(part[i]) for part in parts], pa.binary()) for i in (1, 2, 3)]
        return pa.Table.from_arrays(columns, ["bucket", "code", "c", "n"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        codes = _columns(rows, "code")
        size = 1 + max(int(code[-1]) for code in codes)
        n, c = np.zeros((size, STATES)), np.zeros(size, np.int64)
        # A word is in each row once.
        for code, more, times in zip(codes, _columns(rows, "n"), _columns(rows, "c"), strict=True):
            n[code] += more
            c[code] = times
        some = np.flatnonzero(n.any(axis=1))
        n = n[some].astype(np.float32)
        exact = n.astype(float)
        base = (c[some] + 0.5) / total / (exact.sum(axis=1) + PRIOR)
        sums = [[base.sum()], exact.sum(axis=0), base @ exact]
        return pa.table(
            {
                "bucket": pa.array([key[0].as_py()], pa.int64()),
                "code": pa.array([_pack(some.astype(np.int32))], pa.binary()),
                "n": pa.array([_pack(n)], pa.binary()),
                "sums": _one(pa.array(np.concatenate(sums))),
            }
        )

    parts = _by_chunk(found, rows, run, "bucket long, code binary, c binary, n binary")
    schema = "bucket long, code binary, n binary, sums array<double>"
    return parts.groupBy("bucket").applyInArrow(add, schema)


def word_model(counts: DataFrame, ends: int, n: int, v: int) -> WordModel:
    """The model of Baum-Welch counts by word; only sums by state come to the driver."""
    total = n + 0.5 * (v + 1)
    few = np.zeros((3 + STATES, STATES))
    for row in counts.filter("bucket < 0").collect():
        few[_unpack(row.code, _KINDS["code"])] = _unpack(row.n, _KINDS["n"], STATES)
    sums = [F.sum(F.col("sums")[i]) for i in range(1 + 2 * STATES)]
    found = np.array([x or 0.0 for x in counts.filter("bucket >= 0").agg(*sums).first()])
    held, seen, weighed = found[0], found[1 : 1 + STATES] + few[-1], found[1 + STATES :]
    share = seen / seen.sum() if seen.sum() > 0 else np.full(STATES, 1 / STATES)
    unknown = 0.5 / total
    last = (few[-1] + PRIOR * share) * ((ends + 0.5) / total / (few[-1].sum() + PRIOR))
    last = last if ends else np.zeros(STATES)
    whole = weighed + PRIOR * share * held + last
    scale = (1 - unknown) / np.where(whole > 0, whole, 1)
    shares = lambda x: (x + 0.1) / (x + 0.1).sum(axis=1, keepdims=True)
    end = last * scale if ends else np.full(STATES, unknown)
    return WordModel(shares(few[:2]), shares(few[2:-1]), share, scale, end, unknown, total)


def _with_counts(places: DataFrame, counts: DataFrame) -> DataFrame:
    """``places`` with their words' counts by state; words without any are left out."""

    def run(key: tuple, met: pa.Table, counted: pa.Table) -> pa.Table:
        known, n = _column(counted, "code"), _column(counted, "n")
        rows = []
        triples = zip(*(_columns(met, name) for name in ("pos", "code", "c")), strict=True)
        for chunk, (pos, code, c) in zip(met.column("chunk").to_pylist(), triples, strict=True):
            at = np.searchsorted(known, code)
            some = at < len(known)
            some[some] = known[at[some]] == code[some]
            if some.any():
                rows.append((chunk, pos[some], code[some], c[some], n[at[some]]))
        columns = [pa.array([row[0] for row in rows], pa.int64())]
        columns += [pa.array([key[0].as_py()] * len(rows), pa.int64())]
        columns += [pa.array([_pack(row[i]) for row in rows], pa.binary()) for i in (1, 2, 3, 4)]
        return pa.Table.from_arrays(columns, ["chunk", "bucket", "pos", "code", "c", "n"])

    schema = "chunk long, bucket long, pos binary, code binary, c binary, n binary"
    known = counts.filter("bucket >= 0").select(F.col("bucket").alias("of"), "code", "n")
    met = places.select("chunk", "bucket", "pos", "code", "c")
    return met.groupBy("bucket").cogroup(known.groupBy("of")).applyInArrow(run, schema)


def trained_words(
    found: DataFrame, places: DataFrame, first: Model, ends: int, n: int, v: int
) -> tuple[WordModel, DataFrame]:
    """Full rounds from the model of classes on: the model, and the counts by word."""
    rows, counts = places, None
    local = lambda t: (
        first.start, first.move, first.emit[_column(t, "class")], first.emit[END]
    )
    for _ in range(FULL_ROUNDS):
        before, counts = counts, written(word_counts(found, rows, n + 0.5 * (v + 1), local))
        if before is not None:
            dropped(before)
        # The shuffles of this round go before those of the next are written.
        rows = None
        freed(found.sparkSession)
        model = word_model(counts, ends, n, v)
        rows = _with_counts(places, counts)
        local = lambda t, m=model: (m.start, m.move, m.emissions(t), m.end)
    return model, counts


# Scores


def log_likelihoods(codes: np.ndarray, start: np.ndarray, size: np.ndarray, m: Model) -> np.ndarray:
    """log10 of each sequence's probability, by the scaled forward recursion."""
    found = np.zeros(len(start))
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    steps = int(size.max(initial=0))
    active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    total = np.zeros(len(start))
    alpha = np.repeat(m.start[:1], len(start), axis=0)
    for t in range(steps):
        n = active[t]
        alpha = alpha[:n] @ m.move if t else alpha
        alpha = alpha * m.emit[codes[start[:n] + t]]
        scale = alpha.sum(axis=1, keepdims=True)
        alpha /= scale
        total[:n] += np.log10(scale[:, 0])
    found[order] = total
    return found


def _scores(found: DataFrame, rows: DataFrame, model: WordModel, ends: int) -> DataFrame:
    def run(key: tuple, numbers: pa.Table, chunk: pa.Table) -> pa.Table:
        row = chunk.slice(0, 1).to_pydict()
        codes, sizes, types = _tokens(row)
        at = _column(numbers, "pos")
        count = np.zeros(types + 1, np.int64)
        count[at], count[types] = _column(numbers, "c"), ends
        emit = np.full((types + 1, STATES), model.unknown)
        emit[at], emit[types] = model.emissions(numbers), model.end
        base = np.log10((count + 0.5) / model.total)
        starts = np.cumsum(sizes) - sizes
        m = Model(model.start, model.move, emit, emit[:, 0])
        return pa.table(
            {
                "doc_id": pa.array(row["ids"][0], pa.int64()),
                "held_out": pa.array(row["held"][0], pa.bool_()),
                "n_tokens": sizes,
                "n_known": np.add.reduceat((count > 0).astype(np.int64)[codes], starts),
                "base_score": np.add.reduceat(base[codes], starts),
                "score": log_likelihoods(codes, starts, sizes, m),
            }
        )

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, "
        "base_score double, score double"
    )
    return _by_chunk(found, rows.drop("bucket", "code"), run, schema)


def language_scores(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """Score whole texts of ``docs(doc_id, text)`` by a hidden Markov model.

    Documents whose crc32(doc_id as text) mod ``folds`` is ``fold`` are held out;
    all others train. Tokens are words, A-Z in lower case, and an end mark. Returns
    doc_id, held_out, n_tokens, n_known (tokens that occur in training),
    train_tokens, base_score (unigram, log10) and score (the model's log10
    probability of the text).

    Null texts are empty and have one token, the end. Rows without doc_id train.
    Repeated rows count as often as they occur. Without training documents all
    tokens are unknown and both scores are 0. Other columns are ignored; an empty
    table gives an empty result.
    """
    held = F.coalesce(id_remainder("doc_id", folds) == fold, F.lit(False))
    rows = docs.select(
        F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string")
    )
    with tidy(rows.sparkSession):
        whole = written(chunks(rows))
        words = written(_words(whole))
        known = _classes(words)
        places = written(_places(known))
        # Spelling is of no use any more.
        found = written(whole.select("*", F.size("words").alias("types")).drop("words", "counts"))
        dropped(whole)
        train = found.select(F.explode("held").alias("held"))
        ends = train.filter("not held").count()
        shares = known.groupBy("class").agg(
            F.sum("c").alias("c"), F.count(F.lit(1)).alias("types")
        ).toPandas()
        dropped(words)
        n = int(shares["c"].sum()) + ends
        v = int(shares["types"].sum()) + (ends > 0)
        mass = np.zeros(CLASSES)
        mass[shares["class"].to_numpy(dtype=int)] = shares["c"] + 0.5 * shares["types"]
        mass[END] = ends + 0.5 if ends else 0
        mass[UNKNOWN] = 0.5
        mass /= n + 0.5 * (v + 1)
        training = written(_coded(found, places, ends))
        part = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SLICES))
        first = first_model(mass)
        for turn in range(SHORT_ROUNDS):
            first = baum_welch(training.filter(part == turn), first)
        dropped(training)
        model, counts = trained_words(found, places, first, ends, n, v)
    scores = _scores(found, _with_counts(places, counts), model, ends)
    return scores.withColumn("train_tokens", F.lit(n).cast("long"))
