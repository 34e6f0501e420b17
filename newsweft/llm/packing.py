"""Lexical retrieval packing: fixed-length sequences of documents that share words.

Documents are dealt to shards of about ``SHARD`` documents by lexical likeness, so that documents which share words meet
however large the corpus is: each has ``HASHES`` weighted MinHash values over its distinct token ids (the weight of an id is
its squared idf in all texts), Spark range-partitions and sorts all by these values, and each partition is cut at every ``SHARD`` rows.
The hash of (doc_id, text) and a row's place come last in the order, so documents with one key are spread over
as many shards as they fill. A task streams its shards and holds one: a BM25 inverted index over the shard's token ids. The first unused document is the seed of
a window of ``WINDOW`` tokens; its BM25 neighbours that are not used yet fill the window in the order of their scores.
The document that overflows is cut; its rest opens the next window and is its seed. What is left at the end of a
shard is cut into sequences of lengths that are powers of two, so no sequence needs padding.

Scores within a shard use the shard's own statistics: they order neighbours and exclude nothing. A neighbour in another shard
is not reached; README has the share of the neighbour score that this leaves.

Defined results: a null or empty text is the end id alone; rows with a null id and repeated rows are
packed like any other, each on its own; ties go to the least (doc_id, hash of the text, position in the shard); other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.llm.common import cut_lineage, texts
from newsweft.llm.tokens import PieceEncoder

WINDOW = 2048
SHARD = 512
SEQUENCES = 20  # bits of a sequence's number in its shard
HASHES = 4
SLICE = 256  # texts of one outgoing batch
END = 1
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ShardIndex:
    """BM25 inverted index over the distinct terms of each document of a shard."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        self.n = n
        self.terms, tfs = [], []
        for ids in docs:
            t, c = np.unique(ids, return_counts=True)
            self.terms.append(t.astype(np.int64))
            tfs.append(c)
        sizes = np.array([len(t) for t in self.terms])
        term = np.concatenate(self.terms)
        tf = np.concatenate(tfs).astype(np.float32)
        doc = np.repeat(np.arange(n), sizes)
        length = np.array([max(1, len(d)) for d in docs], dtype=np.float32)
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order], tf[order], doc[order]
        df = np.bincount(term)
        norm = K1 * (1 - B + B * length / length.mean())
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.impact = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.doc = doc
        self.first = np.concatenate([[0], np.cumsum(df)])
        self.df = df
        # long postings lists are kept as rows of a matrix, which add up faster
        common = np.flatnonzero(df > max(1, n // 8))
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), n), dtype=np.float32)
        long = self.row[term] >= 0
        self.dense[self.row[term[long]], doc[long]] = self.impact[long]
        # a term of a single document finds no neighbour
        self.terms = [t[df[t] > 1] for t in self.terms]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents of the shard for the seed's terms."""
        terms = self.terms[seed]
        rows = self.row[terms]
        total = self.dense[rows[rows >= 0]].sum(axis=0, dtype=np.float32).astype(np.float64)
        terms = terms[rows < 0]
        sizes = self.df[terms]
        ends = np.cumsum(sizes)
        if len(ends):
            at = np.arange(ends[-1]) + np.repeat(self.first[terms] - (ends - sizes), sizes)
            total += np.bincount(self.doc[at], weights=self.impact[at], minlength=self.n)
        return total


def fill_windows(docs: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); every document is cut without a gap."""
    index = ShardIndex(docs)
    unused = np.ones(len(docs), dtype=bool)
    sequences: list[list[tuple[int, int, int]]] = []
    current: list[tuple[int, int, int]] = []
    room, first = window, 0
    seed, scores = -1, None
    while True:
        if scores is not None and unused.any():
            doc = int(np.argmax(np.where(unused, scores, -1.0)))
        else:
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                break
            doc = first
        unused[doc] = False
        start, size = 0, len(docs[doc])
        while start < size:
            take = min(room, size - start)
            current.append((doc, start, take))
            start, room = start + take, room - take
            if room == 0:
                sequences.append(current)
                current, room = [], window
        # the first document of an open window is its seed
        head = current[0][0] if current else -1
        if head != seed or scores is None:
            seed = head
            scores = index.scores(seed) if seed >= 0 and unused.any() else None
    rest = [list(p) for p in current]
    total = sum(p[2] for p in rest)
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        piece: list[tuple[int, int, int]] = []
        while want:
            doc, start, size = rest[0]
            take = min(want, size)
            piece.append((doc, start, take))
            want -= take
            if take == size:
                rest.pop(0)
            else:
                rest[0] = [doc, start + take, size - take]
        sequences.append(piece)
    return sequences


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                ids = pa.array([encoder.encode(t).tobytes() for t in some.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("row_hash"), ids], names=["doc_id", "row_hash", "ids"])

    return run


@cache
def _layout(path: str) -> tuple[str, int]:
    """Type of the ids as ``PieceEncoder`` writes them, and the size of the vocabulary: tasks that do not encode need no encoder."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    size = len({**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec.get("added_tokens") or []}})
    return "<u2" if size <= 65_536 else "<u4", size


def _counted(path: str):
    """Token ids with the number of texts of the task that have them, and the number of its texts under id -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, size = _layout(path)
        counts, n = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for ids in batch.column("ids").to_pylist():
                counts[np.unique(np.frombuffer(ids, dtype=dtype))] += 1
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int64()), pa.array(np.append(counts[found], n), pa.int64())], names=["token", "n"])

    return run


def _weights(coded: DataFrame, path: str) -> np.ndarray:
    """Squared idf by token id over all texts, of which ``ids`` has the token ids; an id beyond the end is in none."""
    # at most as many rows as the vocabulary has entries
    found = {r.token: r.n for r in coded.select("ids").mapInArrow(_counted(path), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    n = found.pop(-1, 0)
    df = np.zeros(max(found, default=0) + 1)
    df[list(found)] = list(found.values())
    return (np.log1p((n - df + 0.5) / (df + 0.5)) ** 2).astype(np.float32)


def _tables(weights: np.ndarray, size: int) -> np.ndarray:
    """-log(uniform hash) / weight of every token id below ``size``, a row for each hash."""
    token = np.arange(size, dtype=np.uint64)
    weight = weights[np.minimum(np.arange(size), len(weights) - 1)]
    rows = []
    for k in range(HASHES):
        mixed = (token + np.uint64(1 + (k << 32))) * np.uint64(0x9E3779B185EBCA87)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        uniform = ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(11)).astype(np.float64) + 0.5
        rows.append(-np.log(uniform / 2**53) / weight)
    return np.array(rows, dtype=np.float32)


def _minhash(ids: np.ndarray, tables: np.ndarray) -> bytes:
    """The ``HASHES`` token ids that are least in the tables, big-endian, so that keys are ordered as their bytes."""
    if not len(ids):
        return b""
    return np.array([ids[np.argmin(table[ids])] for table in tables], dtype=">u4").tobytes()


def _keyed(path: str, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, size = _layout(path)
        tables = _tables(weights, size)
        for batch in batches:
            keys = pa.array([_minhash(np.frombuffer(ids, dtype=dtype), tables) for ids in batch.column("ids").to_pylist()], pa.binary())
            columns = [*[batch.column(c) for c in ("doc_id", "row_hash", "ids", "place")], keys]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_hash", "ids", "place", "key"])

    return run


def _dealt(shard: int):
    """Every ``shard`` rows of a sorted partition are a shard, numbered by partition and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            numbers = base + (seen + np.arange(batch.num_rows, dtype=np.int64)) // shard
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), batch.column("ids"), pa.array(numbers)], names=["doc_id", "row_hash", "ids", "shard"])

    return run


def _packer(path: str, end: int, window: int, shard_of: int = SHARD):
    """Pieces of the shards of a sorted partition; one Python worker a task deals and packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = _layout(path)[0]
        tail = np.array([end], dtype=dtype)
        held: list[tuple] = []
        now = None

        def close() -> pa.RecordBatch:
            held.sort(key=lambda row: (row[0] is None, row[0] or 0, row[1]))
            docs = [np.concatenate([np.frombuffer(ids, dtype=dtype), tail]) for _, _, ids in held]
            rows: list[list] = [[] for _ in range(7)]
            for number, pieces in enumerate(fill_windows(docs, window)):
                offset = 0
                for doc, start, size in pieces:
                    crc = zlib.crc32(docs[doc][start : start + size].astype("<u4").tobytes())
                    for column, value in zip(rows, (held[doc][0], start, size, crc, len(docs[doc]), (now, number), offset)):
                        column.append(value)
                    offset += size
            # a shard has fewer sequences than tokens; its number leaves the lower bits to them
            rows[5] = [(shard << SEQUENCES) + number for shard, number in rows[5]]
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in _dealt(shard_of)(batches):
            for name, row_hash, ids, shard in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "row_hash", "ids", "shard")]):
                if held and shard != now:
                    yield close()
                    held = []
                now = shard
                held.append((name, row_hash, ids))
        if held:
            yield close()

    return run


def _ranged(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, row_hash, ids) in ranges of keys, sorted in each."""
    rows = texts(documents).withColumn("row_hash", F.xxhash64("text"))
    coded = cut_lineage(rows.mapInArrow(_encoded(path), "doc_id long, row_hash long, ids binary"))
    # rows of one key, even of one id and text, are spread by their place in the checkpoint, which does not move
    placed = coded.withColumn("place", F.monotonically_increasing_id())
    keyed = placed.mapInArrow(_keyed(path, _weights(coded, path)), "doc_id long, row_hash long, ids binary, place long, key binary")
    order = ["key", "salt", "place"]
    ranged = keyed.withColumn("salt", F.xxhash64("doc_id", "row_hash")).repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "row_hash", "ids")


def deal(documents: DataFrame, path: str, shard: int = SHARD) -> DataFrame:
    """(doc_id, row_hash, ids, shard): every row's token ids as bytes and the number of its shard, the rows of a shard together.

    ``path`` is the tokenizer's file, at the same place on every executor.
    """
    return _ranged(documents, path).mapInArrow(_dealt(shard), "doc_id long, row_hash long, ids binary, shard long")


def pack(documents: DataFrame, path: str, end: int = END, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` is the tokenizer's file, at the same place on every executor.
    """
    return _ranged(documents, path).mapInArrow(_packer(path, end, window, shard), PIECES)
