"""Near-duplicate documents: SimHash candidates and an exact join, verified by 5-word Jaccard similarity.

A text is lower-cased (A-Z), cut into words at ASCII white space and into distinct ``SHINGLE``-word
shingles; a shorter text is one shingle, a text without words has none.  Two texts link if
their shingle sets have a Jaccard similarity of 4/5 or more, equal sets included.

1. Texts with equal sets are folded to one key, a hash of the set. Each has a 64-bit SimHash fingerprint of its shingles.
2. ``simhash.links`` (generalised pigeonhole) finds the fingerprints within two bits; these pairs of keys are candidates.
   A link may be up to some ten bits apart, so the next steps find what lies beyond.
3. All shingles have one order: those seen often in a sample of the texts last, the rest by hash.  Sets of n and m
   shingles that link share one of the first n - ceil(4n/5) + 1 (and m likewise) in that order, whatever the order is,
   so the sample decides what the join costs and not what it finds.
4. The first shingles are shuffled by value; those of a single key go no further.
5. Every key is compared with two others of its groups, the least and the one before it by size, and what
   links among these and the SimHash candidates is one component.  In a crowd of near copies this leaves few components, and no pairs of one
   component are made afterwards.
6. Every set has ``MARKS`` marks, the parities of its shingles per mark.  Two sets differ in at least as many shingles
   as marks, and sets that link differ in at most (n + m) / 9 shingles, so the join of keys of different components that
   share a first shingle leaves pairs whose marks differ more.  The others are counted: a pair that shares c first
   shingles has at most c + max(rest of n, rest of m) in common; if that is too little it is left, else it is verified.
7. Verification is by the full sets, and components are built on verified links only.

Nothing is estimated: recall against brute force is 1 (tested).  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.llm import simhash
from newsweft.llm.common import cut_lineage, set_aside, texts
from newsweft.llm.components import components

SHINGLE = 5
SEED = 42
SAMPLE = 8192  # texts whose shingles are counted for the order
COMMON = 200_000  # shingles that the order puts last, at most
SMALL = 2_000_000  # rows of two longs that a join sends to every executor, at most; more are shuffled with the texts
SLICE = 256  # texts of one outgoing batch
MARKS = 1024  # parities of a set; more tell longer texts apart, none changes what is found
PRINT = "doc_id long, text_hash long, key long, n long, fp long, marks array<long>"


# ---------------------------------------------------------------- shingles


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words), SEED)] if words else [], dtype=np.uint64).view(np.int64)
    each = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    mixed = np.zeros(len(words) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        mixed = (mixed ^ each[k : k + len(mixed)]) * np.uint64(0x9E3779B185EBCA87)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def _key(shingles: np.ndarray) -> int:
    import xxhash

    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash: a bit is set if more than half of the shingles' hashes have it."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), 65_536):
        counts += np.unpackbits(shingles[at : at + 65_536].astype(">i8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(shingles)).astype(np.uint8)).view(">i8")[0])


def marks(shingles: np.ndarray) -> np.ndarray:
    """``MARKS`` bits as longs: bit i is set if an odd number of shingles falls on it."""
    places = (shingles.view(np.uint64) % np.uint64(MARKS)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=MARKS) & 1).astype(bool)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
        sets = [shingle_set(t) for t in some.column("text").to_pylist()]
        columns = [some.column("doc_id"), some.column("text_hash"), pa.array([_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
        columns.append(pa.array([fingerprint(s) for s in sets], pa.int64()))
        columns.append(pa.array([marks(s) for s in sets], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "key", "n", "fp", "marks"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            sets = [shingle_set(t) for t in batch.column("text").slice(at, SLICE).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets), pa.int64())], names=["shingle"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            sets = [shingle_set(t) for t in batch.column("text").slice(at, SLICE).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])


def _first_size(n):
    """How many first shingles of a set of n are looked at."""
    return n - (4 * n + 4) // 5 + 1


def _first(common: np.ndarray):
    """First shingles of every set; ``common`` comes sorted by hash, with the place of each in the order."""
    values, places = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                keys, sizes, out = [], [], []
                for text in batch.column("text").slice(at, SLICE).to_pylist():
                    shingles = shingle_set(text)
                    n = len(shingles)
                    if not n:
                        continue
                    if len(values):
                        found = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
                        place = np.where(values[found] == shingles, places[found], 0)
                        first = shingles[np.lexsort((shingles, place))][: _first_size(n)]
                    else:
                        first = shingles[: _first_size(n)]
                    keys.append(np.full(len(first), _key(shingles)))
                    sizes.append(np.full(len(first), n))
                    out.append(first)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (out, keys, sizes)], names=["shingle", "key", "n"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shingle, key): each once, without the shingles of a single key."""
    held = None  # the rows of the last shingle may go on in the next batch
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "key", "n")])
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        rows = rows[:, np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])] if rows.shape[1] else rows
        cut = np.searchsorted(rows[0], rows[0, -1]) if rows.shape[1] else 0
        held, done = rows[:, cut:], rows[:, :cut]
        yield from _several(done)
    if held is not None:
        yield from _several(held)


def _several(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    if rows.shape[1] > 1:
        same = rows[0, 1:] == rows[0, :-1]
        rows = rows[:, np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        if rows.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["shingle", "key", "n"])


def _common_shingles(rows: DataFrame, count: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of two or more texts of a sample, sorted, with their number of texts."""
    some = rows.filter(F.pmod(F.col("text_hash"), F.lit(max(1, -(-count // sample)))) == 0).dropDuplicates(["text_hash"])
    often = some.select("text").mapInArrow(_exploded, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    top = often.orderBy(F.desc("n"), "shingle").limit(COMMON).toPandas()
    order = np.argsort(top["shingle"].to_numpy(dtype=np.int64))
    return top["shingle"].to_numpy(dtype=np.int64)[order], top["n"].to_numpy(dtype=np.int64)[order]


# ---------------------------------------------------------------- links


def _enough(common: Column) -> Column:
    """``common`` of the sets of ``n`` and ``m`` shingles is a Jaccard similarity of 4/5 or more."""
    return 9 * common >= 4 * (F.col("n") + F.col("m"))


def _close_marks(one: str, other: str) -> Column:
    """The marks of the sets of ``n`` and ``m`` shingles leave a Jaccard similarity of 4/5 or more possible."""
    differ = reduce(add, [F.bit_count(F.get(one, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))) for i in range(MARKS // 64)])
    return 9 * differ <= F.col("n") + F.col("m")


def _possible(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shared first shingles leave a link possible; one row per shared shingle comes in."""
    rest = lambda n: F.col(n) - _first_size_column(n)
    counted = pairs.groupBy("a", "b", "n", "m").agg(F.count("*").alias("c"))
    return counted.filter(_enough(F.col("c") + F.greatest(rest("n"), rest("m")))).select("a", "b", "n", "m")


def _first_size_column(n: str) -> Column:
    return F.col(n) - F.floor((4 * F.col(n) + 4) / 5) + 1


def _sent_if_small(keys: DataFrame) -> DataFrame:
    """``keys`` for a join with the texts: a counted small table spares the shuffle of the texts."""
    keys = cut_lineage(keys)
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def _verified(pairs: DataFrame, prints: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    pairs = cut_lineage(pairs)
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    chosen = prints.join(needed, "key", "left_semi").groupBy("key").agg(F.min("text_hash").alias("text_hash")).select("text_hash")
    found = rows.join(_sent_if_small(chosen), "text_hash", "left_semi").select("text").mapInArrow(_whole, "key long, shingles array<long>")
    sets = cut_lineage(found.groupBy("key").agg(F.first("shingles").alias("shingles")))
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return cut_lineage(pairs.join(left, "a").join(right, "b").filter(_enough(common)).select("a", "b"))


def similar(prints: DataFrame) -> DataFrame:
    """(a, b, n, m): pairs of keys whose fingerprints are linked.

    The least key stands for a fingerprint; the other keys of it meet that one only, so many keys of one fingerprint make no pairs.
    """
    keys = prints.filter("n > 0").select("key", "n", "fp").distinct()
    heads = cut_lineage(keys.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("head")))
    linked = simhash.links(heads.select("fp"))
    across = linked.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("one")), "a").join(heads.withColumnRenamed("fp", "b"), "b")
    both = keys.join(heads, "fp").select("key", "n", "head").union(across.select("one.key", "one.n", "head")).filter("key <> head.key")
    pairs = both.select(F.greatest("key", "head.key").alias("a"), F.least("key", "head.key").alias("b"), F.col("n"), F.col("head.n").alias("m"))
    return _ordered(pairs.filter("5 * n >= 4 * m and 5 * m >= 4 * n")).distinct()


def links(rows: DataFrame, prints: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(a, b): verified links between keys; their components are those of all links."""
    common = _common_shingles(rows, prints.count(), sample)
    entries = rows.select("text").mapInArrow(_first(common), "shingle long, key long, n long")
    by_value = entries.repartition("shingle").sortWithinPartitions("shingle", "key")
    shared = cut_lineage(by_value.mapInArrow(_shared, "shingle long, key long, n long"))

    # a link between the two components of a pair makes every other pair of them needless
    order = Window.partitionBy("shingle").orderBy("n", "key")
    before, least = F.lag(F.struct("key", "n")).over(order), F.first(F.struct("key", "n")).over(order)
    near = shared.select("key", "n", before.alias("before"), least.alias("least")).select("key", "n", F.explode(F.array_distinct(F.array("before", "least"))).alias("x"))
    near = near.filter(F.col("x").isNotNull() & (F.col("x.key") != F.col("key")))
    near = near.select(F.greatest("key", "x.key").alias("a"), F.least("key", "x.key").alias("b"), F.col("n"), F.col("x.n").alias("m"))
    near = near.filter("5 * n >= 4 * m and 5 * m >= 4 * n")
    first = _verified(_possible(_ordered(near)).union(similar(prints)).distinct(), prints, rows)

    roots = components(first).withColumnRenamed("node", "key")
    labelled = shared.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = labelled.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("shingle")
    open_ = labelled.join(mixed, "shingle", "left_semi")
    marked = prints.select("key", "marks").join(open_.select("key").distinct(), "key", "left_semi").distinct()
    open_ = cut_lineage(open_.join(marked, "key").select("shingle", "key", "n", "root", "marks"))
    other = open_.select("shingle", F.col("key").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("marks").alias("its"))
    alike = F.expr("a > b and root <> other and 5 * n >= 4 * m and 5 * m >= 4 * n") & _close_marks("marks", "its")
    met = open_.withColumnRenamed("key", "a").join(other, "shingle").filter(alike).select("a", "b", "n", "m")
    return first.union(_verified(_possible(met), prints, rows))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Sizes of a pair in one order, so that its rows count together."""
    return pairs.select("a", "b", F.least("n", "m").alias("n"), F.greatest("n", "m").alias("m"))


def near_duplicates(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text_hash, component_id): one row per document and text, copies included."""
    rows = texts(documents).withColumn("text_hash", F.xxhash64("text"))
    prints = cut_lineage(rows.mapInArrow(_sets, PRINT).distinct())
    roots = components(links(rows, prints, sample)).withColumnRenamed("node", "key")
    folded = prints.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    named = folded.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = cut_lineage(named.join(least, "root").select("key", "component_id"))
    return prints.join(ids, "key").select("doc_id", "text_hash", "component_id")


def keep_first(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``documents`` whose id names their component: one of each group stays.

    Rows with a null id are kept.  Repeated rows of a kept document stay as they are.
    """
    documents, columns = set_aside(documents, "doc_id", "text")
    gone = near_duplicates(documents, sample).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text")).distinct()
    own = (F.col("doc_id") == F.col("_gone_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_gone_text"))
    return documents.join(_sent_if_small(gone), own, "left_anti").select(*columns)
