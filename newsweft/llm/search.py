"""Exact BM25 top-k search with block-max pruning, run per shard and merged with global statistics.

Terms are runs of letters, digits and underscores in lower case, kept as 64-bit hashes. Every text is read once: a task
turns its documents into shards of about ``SHARD`` bytes of text, one row of postings each, kept in the checkpoint folder. The
number of documents, the mean length and the document frequency of every query term are counted over all shards before a
query runs, so scores are the same whichever shard a document lies in.

Queries are dealt to blocks of about ``QUERIES``, one row each, also kept. All shards meet all blocks in a cartesian product: a
task gets one lane of shards (there are ``LANES`` at most) and reads the blocks of one partition from the one copy that is stored, so
nothing is written again for a further shard or block. It holds the k best of every query so far and carries them from shard to
shard, as a bound to begin with, so a lane returns k rows a query at most. The lanes are merged by (score, id).

A shard is an inverted index in blocks of ``BLOCK`` documents, documents alike (same commonest term, same least term hash)
side by side; queries with the same common terms are side by side too. A block keeps the postings of terms in many of its documents
as rows of a matrix as well, in single precision, with the greatest impact of each row. For ``BATCH`` queries at once the other postings are added up
exactly; the greatest sum of a query in the block and the weighted block maxima of the rows add up to an upper bound. Blocks
whose bound is below the k-th best score are left out. For the others one product gives what the rows add, and documents
that may be among the k best, by a margin for single precision, are scored exactly: no document that belongs to the result is left out.

The work still grows with the number of queries times the number of documents, as every query asks all documents; what is
written, held in a task or returned by the search does not.

Defined results: a query without a term, or that shares no term with any document, has no rows; fewer than k matches give
fewer rows; scores have six decimals and ties go to the smaller id; rows with a null id take no part; a null text is empty; repeated rows are
documents of their own, and a repeated query id is one query with the least of its texts; other columns are ignored. A query
row finds itself like any other document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweft.llm.common import cut_lineage, texts

K1, B = 1.2, 0.75
BLOCK = 2048  # documents in a block of the index
SHARD = 20_000_000  # bytes of text in a shard, half more in the last of a task
DOCS = 16_384  # documents in a shard at most
QUERIES = 4096  # queries in a block
LANES = 12  # lanes of shards; each returns its k best of a query
BATCH = 256  # queries whose common terms are scored by one product
LINES = 32  # queries whose other terms are added up at once
DENSE = 32  # a term in more than 1/32 of a block's documents is kept as a row of a matrix
PRODUCT = 500  # such a term is scored by the product if more than 1/500 of the pairs of a query and a document share it
MATRIX = 50_000_000  # bytes of that matrix in both precisions at most; the rarer of these terms stay with the others
EXACT = 4096  # documents scored exactly at once
DIGITS = 6  # decimals of a score
SLACK = 1e-9  # bounds and scores add up in different orders
WORD = re.compile(r"\w+")
ASCII = bytes(ord(chr(i).lower()) if WORD.match(chr(i)) else 32 for i in range(128)) + bytes(128)


def _terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct terms and how often each occurs."""
    import xxhash

    # an ASCII text gives the same words as bytes, several times as fast
    counts = Counter(text.encode().translate(ASCII).split() if text.isascii() else WORD.findall(text.lower()))
    keys = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, counts)), dtype=">u8").astype(np.uint64).view(np.int64)
    tf = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    order = np.argsort(keys)
    return keys[order], tf[order]


def _joined(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Postings(NamedTuple):
    """Documents of a shard in the order of the index and, block by block, their postings, sorted by term and document."""

    names: np.ndarray
    lengths: np.ndarray
    parts: np.ndarray  # terms of each block
    terms: np.ndarray
    counts: np.ndarray  # postings of each term
    doc: np.ndarray  # place in the block
    tf: np.ndarray

    @classmethod
    def of(cls, names: list[int], docs: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> Postings:
        alike = [(int(key[np.argmax(tf)]), int(key[0]), name) if len(key) else (0, 0, name) for name, (key, tf) in zip(names, docs)]
        order = sorted(range(len(docs)), key=alike.__getitem__)
        lengths = np.array([docs[i][1].sum() for i in order], dtype=np.int64)
        found = [cls._part([docs[i] for i in order[start : start + block]]) for start in range(0, len(order), block)]
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * 4
        return cls(np.array([names[i] for i in order], dtype=np.int64), lengths, np.array([len(f[0]) for f in found], dtype=np.int64), *columns)

    @staticmethod
    def _part(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        term, tf = (np.concatenate(c) for c in zip(*docs))
        by = np.argsort(term, kind="stable")
        term = term[by]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
        doc = np.repeat(np.arange(len(docs)), [len(key) for key, _ in docs])
        return term[first], np.diff(np.append(first, len(term))), doc[by], tf[by]


class DocBlock:
    """A block of documents of a shard: its postings, and rows of those of common terms."""

    def __init__(self, names: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, doc: np.ndarray, tf: np.ndarray, wanted: np.ndarray, mean: float):
        self.names, self.doc, self.size = names, doc, counts.astype(np.int64)
        n = len(names)
        norm = K1 * (1 - B + B * np.maximum(1, lengths) / mean)
        self.impact = tf * (K1 + 1) / (tf + norm[doc])
        self.start = np.cumsum(self.size) - self.size
        common = np.flatnonzero(self.size > n // DENSE)
        common = common[np.argsort(-self.size[common], kind="stable")[: MATRIX // (12 * max(1, n))]]
        self.common, self.row = common, np.full(len(terms), -1)
        self.row[common] = np.arange(len(common))
        take = _joined(self.start[common], self.size[common])
        self.dense = np.zeros((len(common), n))
        self.dense[np.repeat(np.arange(len(common)), self.size[common]), doc[take]] = self.impact[take]
        self.rough = self.dense.astype(np.float32)
        self.greatest = self.rough.max(axis=1, initial=0)
        # all parts of a score are positive, so the error of single precision is a share of the sum
        self.error = (len(common) + 8) * 2.0**-23
        # the term here of each wanted term, one more than its place
        self.known = np.zeros(len(wanted), np.int32)
        at = np.searchsorted(wanted, terms)
        held = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == terms) if len(wanted) else at[:0]
        self.known[at[held]] = held + 1

    def _light(self, term: np.ndarray, weight: np.ndarray, query: np.ndarray, m: int) -> np.ndarray:
        """What the other terms add to the score of every document, a line for each of ``m`` queries."""
        n, size = len(self.names), self.size[term]
        take = _joined(self.start[term], size)
        place = np.repeat(query * n, size)
        place += self.doc[take]
        part = self.impact[take]
        part *= np.repeat(weight, size)
        return np.bincount(place, weights=part, minlength=m * n).reshape(m, n)

    def update(self, terms: np.ndarray, weights: np.ndarray, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Put the documents of this block among the k best of some queries, a line of ``ids`` and ``scores`` each.

        Scores fall along a line, zeros stand behind the last document. ``terms`` are positions among the wanted terms, ``query`` the line that asks.
        """
        (m, k), n = scores.shape, len(self.names)
        term = self.known[terms]
        held = np.flatnonzero(term)
        term, query, weights = term[held] - 1, query[held], weights[held]
        row = self.row[term]
        # a row is worth its product if enough of these queries ask for it
        uses = np.bincount(row[row >= 0], minlength=len(self.rough))
        dense = np.append(uses * self.size[self.common] * PRODUCT > m * n, False)[row]
        held = np.flatnonzero(~dense)
        term, asks, other = term[held], query[held], weights[held]
        cuts = np.searchsorted(asks, np.arange(0, m + LINES, LINES))
        light = np.empty((m, n))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            some = light[i * LINES : (i + 1) * LINES]
            some[:] = self._light(term[a:b], other[a:b], asks[a:b] - i * LINES, len(some))
        held = np.flatnonzero(dense)
        of, row, worth = query[held], row[held], weights[held]
        weight = np.zeros((m, len(self.rough)), np.float32)
        weight[of, row] = worth
        # a part of the scores gives a bound to begin with
        new = np.flatnonzero(scores[:, -1] == 0)
        least = np.maximum(scores[:, -1], 10.0**-DIGITS)
        if n >= k and len(new):
            least[new] = np.maximum(least[new], self._kth(light[new], k))
        bound = light.max(axis=1) + (weight @ self.greatest) * (1 + self.error)
        asked = np.flatnonzero(bound * (1 + SLACK) + 10.0**-DIGITS >= least)
        if not len(asked):
            return
        used = np.flatnonzero(weight[asked].any(axis=0))
        # queries that are alike leave rows of the others out
        fewer = len(used) < 0.8 * len(self.rough)
        total = (weight[np.ix_(asked, used)] @ self.rough[used] if fewer else weight[asked] @ self.rough) + light[asked]
        least = least[asked]
        near = total >= self._floor(least)
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > 2 * k)
        if len(many):  # these have k better ones here
            near[many] = total[many] >= self._floor(np.maximum(least[many], self._kth(total[many], k)))
        line, doc = np.nonzero(near)
        line = asked[line]
        starts = np.searchsorted(of, np.arange(m + 1))
        for some in range(0, len(line), EXACT):
            here, place = line[some : some + EXACT], doc[some : some + EXACT]
            sizes = np.diff(starts)[here]
            take = _joined(starts[here], sizes)
            common = worth[take] * self.dense[row[take], np.repeat(place, sizes)]
            total = light[here, place] + np.bincount(np.repeat(np.arange(len(here)), sizes), weights=common, minlength=len(here))
            self._enter(here, self.names[place], np.round(total, DIGITS), ids, scores)

    def _floor(self, least: np.ndarray) -> np.ndarray:
        """The least sum in single precision that a score may have to round to ``least``, a column."""
        return ((least - 0.6 * 10.0**-DIGITS) * (1 - self.error))[:, None]

    def _kth(self, totals: np.ndarray, k: int) -> np.ndarray:
        """What k documents of each line reach at least."""
        return np.partition(totals, totals.shape[1] - k, axis=1)[:, -k] * (1 - self.error) - 10.0**-DIGITS

    @staticmethod
    def _enter(line: np.ndarray, name: np.ndarray, total: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Put rounded scores among the k best of their lines; sums taken in another order tie."""
        k = scores.shape[1]
        hit = np.flatnonzero(total >= np.maximum(scores[line, -1], 10.0**-DIGITS))
        lines = np.unique(line[hit])
        old = np.flatnonzero(scores[lines].ravel())
        line = np.concatenate([line[hit], np.repeat(lines, k)[old]])
        name = np.concatenate([name[hit], ids[lines].ravel()[old]])
        total = np.concatenate([total[hit], scores[lines].ravel()[old]])
        by = np.lexsort([name, -total, line])
        line, name, total = line[by], name[by], total[by]
        rank = np.arange(len(line)) - np.searchsorted(line, line)
        kept = np.flatnonzero(rank < k)
        ids[line[kept], rank[kept]], scores[line[kept], rank[kept]] = name[kept], total[kept]


class BlockMaxIndex:
    """Inverted index of one shard over the terms that queries ask for."""

    def __init__(self, names: list[int], docs: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, mean: float, block: int = BLOCK):
        self._fill(Postings.of(names, docs, block), wanted, mean, block)

    @classmethod
    def over(cls, postings: Postings, wanted: np.ndarray, mean: float, block: int = BLOCK) -> BlockMaxIndex:
        index = cls.__new__(cls)
        index._fill(postings, wanted, mean, block)
        return index

    def _fill(self, postings: Postings, wanted: np.ndarray, mean: float, block: int) -> None:
        self.postings, self.wanted, self.mean, self.block = postings, wanted, mean, block

    def blocks(self) -> Iterator[DocBlock]:
        """One block after the other, so a task holds the rows of one."""
        p = self.postings
        ends = np.cumsum(p.parts, dtype=np.int64)
        places = np.append(0, np.cumsum(p.counts, dtype=np.int64))
        for i, (a, b) in enumerate(zip(ends - p.parts, ends)):
            docs, terms, some = slice(i * self.block, (i + 1) * self.block), slice(a, b), slice(places[a], places[b])
            yield DocBlock(p.names[docs], p.lengths[docs], p.terms[terms], p.counts[terms], p.doc[some], p.tf[some], self.wanted, self.mean)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents; ``terms`` are positions among the wanted terms."""
        ids, scores = np.zeros((1, k), np.int64), np.zeros((1, k))
        for block in self.blocks():
            block.update(terms, weights, np.zeros(len(terms), np.int64), ids, scores)
        found = np.count_nonzero(scores)
        return ids[0, :found], scores[0, :found]


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers from zero up in as few bytes each as the greatest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _numbers(row: pa.StructScalar, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(row[name].as_buffer(), dtype=kind)


def _narrowed(row: pa.StructScalar, name: str, n: int) -> np.ndarray:
    return _numbers(row, name, f"u{row[name].as_buffer().size // n}") if n else np.zeros(0, np.uint8)


SHARDS = "n long, words long, names binary, lengths binary, parts binary, terms binary, counts binary, doc binary, tf binary"
BLOCKS = "block int, query_id binary, size binary, asked binary, idf binary, at binary, times binary"


def _rows_of(batch: pa.RecordBatch) -> Iterator[pa.StructScalar]:
    return iter(pa.array(batch.to_struct_array()))


def _shard_rows(limit: int) -> Callable:
    """Rows ``SHARDS`` of the texts of a task, a row for about ``limit`` bytes of text."""

    def close(names: list[int], docs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        found = Postings.of(names, docs)
        numbers = [[len(found.names)], [int(found.lengths.sum())]]
        blobs = [found.names.tobytes(), _narrow(found.lengths), _narrow(found.parts), found.terms.tobytes(), _narrow(found.counts), _narrow(found.doc), _narrow(found.tf)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in numbers] + [pa.array([x], pa.binary()) for x in blobs], names=["n", "words", *Postings._fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, names, docs, held = None, [], [], 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                names.append(name)
                docs.append(_terms(text))
                held += len(text)
                if held >= limit or len(names) >= DOCS:
                    if full:
                        yield close(*full)
                    full, names, docs, held = (names, docs), [], [], 0
        # a small rest goes with the shard before it
        if full and max(held / limit, len(names) / DOCS) < 0.5:
            full, names, docs = None, full[0] + names, full[1] + docs
        if full:
            yield close(*full)
        if names:
            yield close(names, docs)

    return run


def _postings(row: pa.StructScalar) -> Postings:
    names, terms = _numbers(row, "names", "i8"), _numbers(row, "terms", "i8")
    counts = _narrowed(row, "counts", len(terms))
    size = int(counts.sum(dtype=np.int64))
    lengths, parts = _narrowed(row, "lengths", len(names)), _narrowed(row, "parts", -(-len(names) // BLOCK))
    return Postings(names, lengths.astype(np.int64), parts.astype(np.int64), terms, counts, _narrowed(row, "doc", size), _narrowed(row, "tf", size))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of every shard."""
    for batch in batches:
        for row in _rows_of(batch):
            terms = _numbers(row, "terms", "i8")
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(_narrowed(row, "counts", len(terms)).astype(np.int64))], names=["term", "n"])


def _query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, text in zip(batch.column("query_id").to_pylist(), batch.column("text").to_pylist()):
            key, tf = _terms(text)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), name, dtype=np.int64)), pa.array(key), pa.array(tf)], names=["query_id", "term", "tf"])


def _block_row(number: float) -> Callable:
    """One row ``BLOCKS`` of the terms of a block of queries, queries with the same common terms side by side."""

    def run(rows: pa.Table) -> pa.Table:
        query, term, tf, n = (rows.column(c).to_numpy() for c in ("query_id", "term", "tf", "n"))
        terms, first, at, uses = np.unique(term, return_index=True, return_inverse=True, return_counts=True)
        idf = np.log1p((number - n[first] + 0.5) / (n[first] + 0.5))
        names, line, sizes = np.unique(query, return_inverse=True, return_counts=True)
        top = np.argsort(-uses, kind="stable")[:64]
        bit = np.zeros(len(terms), np.uint64)
        bit[top] = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)[: len(top)]
        has = np.zeros(len(names), np.uint64)
        np.bitwise_or.at(has, line, bit[at])
        order = np.argsort(has, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by = np.lexsort([at, rank[line]])
        blobs = [names[order].tobytes(), sizes[order].astype(np.int64).tobytes(), terms.tobytes(), idf.tobytes(), at[by].astype(np.int32).tobytes(), _narrow(tf[by])]
        return pa.table([pa.array([rows.column("block")[0].as_py()], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], names=["block", "query_id", "size", "asked", "idf", "at", "times"])

    return run


class _Block:
    """Queries of a block and the k best of each so far."""

    def __init__(self, row: pa.StructScalar, k: int):
        self.names, self.wanted = _numbers(row, "query_id", "i8").copy(), _numbers(row, "asked", "i8").copy()
        self.terms = _numbers(row, "at", "i4").copy()
        self.weights = _narrowed(row, "times", len(self.terms)) * _numbers(row, "idf", "f8")[self.terms]
        self.edges = np.concatenate([[0], np.cumsum(_numbers(row, "size", "i8"))])
        self.ids, self.scores = np.zeros((len(self.names), k), np.int64), np.zeros((len(self.names), k))

    def search(self, postings: Postings, mean: float) -> None:
        for block in BlockMaxIndex.over(postings, self.wanted, mean).blocks():
            for start in range(0, len(self.names), BATCH):
                edges = self.edges[start : start + BATCH + 1]
                some = slice(edges[0], edges[-1])
                query = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
                block.update(self.terms[some], self.weights[some], query, self.ids[start : start + BATCH], self.scores[start : start + BATCH])

    def rows(self) -> pa.RecordBatch:
        query, rank = np.nonzero(self.scores)
        found = [self.names[query], self.ids[query, rank], self.scores[query, rank]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "doc_id", "score"])


def _searcher(k: int, mean: float) -> Callable:
    """The k best of each query over the shards that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Block] = {}
        for batch in batches:
            for row in _rows_of(batch):
                name = row["block"].as_py()
                if name not in blocks:
                    blocks[name] = _Block(row, k)
                blocks[name].search(_postings(row), mean)
        for block in blocks.values():
            yield block.rows()

    return run


def _row_by_row(frame: DataFrame) -> DataFrame:
    """A checkpoint whose Python workers get large rows one at a time, so a worker holds one shard and not a batch of them."""
    conf, name = frame.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = conf.get(name)
    conf.set(name, "1")
    try:
        return cut_lineage(frame)
    finally:
        conf.set(name, rows)


def lane_best(documents: DataFrame, queries: DataFrame, k: int, shard: int, block: int) -> DataFrame:
    """(query_id, doc_id, score): the k best of every lane of shards."""
    docs = texts(documents).filter("doc_id is not null")
    asked = queries.filter("query_id is not null").groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("docs")).first()
    # small input partitions are read together, a large one gives several shards
    tasks = max(LANES, math.ceil((size.bytes or 0) / shard), math.ceil(size.docs / DOCS))
    shards = cut_lineage(docs.coalesce(tasks).mapInArrow(_shard_rows(shard), SHARDS))
    whole = shards.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    number, words = whole.n or 0, whole.words or 0
    mean = max(1.0, words / max(1, number))
    counted = shards.select("terms", "counts").mapInArrow(_term_rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    blocks = max(1, math.ceil(asked.count() / block))
    weighted = asked.mapInArrow(_query_rows, "query_id long, term long, tf long").join(counted, "term")
    dealt = weighted.select("query_id", "term", "tf", "n", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    asking = cut_lineage(dealt.groupBy("block").applyInArrow(_block_row(float(number)), BLOCKS).repartitionById(blocks, "block"))
    pairs = shards.drop("n", "words").coalesce(LANES).crossJoin(asking.hint("shuffle_replicate_nl"))
    return _row_by_row(pairs.mapInArrow(_searcher(k, mean), "query_id long, doc_id long, score double"))


def top_k(documents: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents for each row of ``queries`` (query_id, text)."""
    best = lane_best(documents, queries, k, shard, block)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
