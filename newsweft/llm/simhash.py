"""Near-duplicate documents by SimHash and the generalised pigeonhole principle.

Fingerprints.  A text is lower-cased (A-Z), cut into words at ASCII white space and into
3-word shingles, repeats included; each is hashed with XXH64 (seed 42) and a bit of the
fingerprint is set if more than half of the hashes have it.  A text of one or two words
is one shingle; a text without words (null, empty, blank) has fingerprint zero.

Links.  Two fingerprints link at ``RADIUS`` = 2 or fewer differing bits.

1. Equal fingerprints are folded to one representative (map-side combined count and least id).
2. The 64 bits are grouped into three partitions of correlated bits: the 64 x 64 table of
   common set bits is a sum over all representatives, correlated bits are put together, so
   that what a frequent value of one partition hides the other partitions tell apart.
3. Thresholds (t0, t1, t2), each -1 to 2 with sum 2 - 3 + 1 = 0, suffice: a pair within two bits
   agrees within t_i on some partition i.  For each representative a dynamic program over the
   partitions takes the thresholds with the fewest estimated candidates, from the counts of its own
   three values and the mean collision rate; -1 leaves a partition with a frequent value out.
4. It probes the index of partition values, and the candidates are verified on all 64 bits.
5. A representative whose probes would meet more than ``DENSE`` index entries (the exact sum of the
   counts it hits) lies in a dense group.  Its links to other dense ones are found without pairs: two
   fingerprints are within two bits exactly if some word is within one bit of both, so
   each is hung on its 65 such words and those that share one are joined to the least.
   Links to the others come from the others' probes, which see the whole index.
6. Components by star contraction; the least document id names a component.

No link is lost and no step emits all pairs of a group.  Rows with the same id and text
count as one; a null id takes part and is returned, but never names a component that has
another id.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.llm.common import cut_lineage, texts
from newsweft.llm.components import components

RADIUS = 2
PARTS = 3
DENSE = 2000
SEED = 42


# ---------------------------------------------------------------- fingerprints


def _fingerprint(text: str) -> int:
    import xxhash

    data = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only
    words = data.split()  # bytes.split() cuts at 0x20 and 0x09-0x0D only
    if not words:
        return 0
    if len(words) < 3:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b"%b %b %b" % three, SEED) for three in zip(words, words[1:], words[2:])]
    counts = np.zeros(64, dtype=np.int64)
    array = np.array(hashes, dtype=">u8")
    for at in range(0, len(array), 65_536):
        counts += np.unpackbits(array[at : at + 65_536].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(array)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [_fingerprint(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long, one row per input row."""
    return texts(documents).mapInArrow(_fingerprints, "doc_id long, fp long")


# ---------------------------------------------------------------- partitions


def _common_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64))
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(fp), 65_536):
            bits = ((fp[at : at + 65_536, None] >> np.arange(64)) & 1).astype(np.float64)
            total += bits.T @ bits
    pairs = np.arange(64 * 64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs // 64, pa.int32()), pa.array(pairs % 64, pa.int32()), pa.array(total.ravel())], names=["i", "j", "n"])


def bit_groups(prints: DataFrame) -> list[list[int]]:
    """Three groups of bits (22, 21 and 21), correlated bits together."""
    together = np.zeros((64, 64))
    rows = prints.select("fp").mapInArrow(_common_bits, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 4,096 sums
    for row in rows:
        together[row.i, row.j] = row.n
    count = max(1, prints.count())
    mean = np.diag(together) / count
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    correlation = np.abs((together / count - np.outer(mean, mean)) / np.outer(spread, spread))
    left, groups = set(range(64)), []
    for size in (22, 21, 21):
        rest = sorted(left)
        first = max(rest, key=lambda b: (correlation[b, rest].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _mask(group: list[int]) -> int:
    value = sum(1 << b for b in group)
    return value - (1 << 64) if value >= 1 << 63 else value


def allocate(counts: np.ndarray, widths: list[int], rate: float) -> np.ndarray:
    """Thresholds per row: an array (n, 3) of -1..2 that sum to RADIUS - PARTS + 1.

    ``counts`` (n, 3): index entries that share the row's value in each partition.
    Estimated cost of threshold t in partition i: own entries for t >= 0, and for every further bit the
    flipped values at the mean collision ``rate`` plus one look-up each.
    """
    n = len(counts)
    cost = np.empty((n, PARTS, RADIUS + 2))
    for i, w in enumerate(widths):
        own = counts[:, i]
        cost[:, i, 0] = 0
        cost[:, i, 1] = own + 1
        cost[:, i, 2] = own + 1 + w * (1 + rate)
        cost[:, i, 3] = own + 1 + (w + w * (w - 1) / 2) * (1 + rate)
    goal = RADIUS - PARTS + 1
    low = -PARTS
    sums = goal - low + RADIUS + 1  # sums from -3 up to more than the goal
    best = np.full((n, sums), np.inf)
    best[:, -low] = 0.0  # nothing chosen: sum 0
    choice = []
    for i in range(PARTS):
        after = np.full((n, sums), np.inf)
        took = np.zeros((n, sums), dtype=np.int8)
        for t in range(-1, RADIUS + 1):
            for s in range(sums):
                if not 0 <= s - t < sums:
                    continue
                c = best[:, s - t] + cost[:, i, t + 1]
                better = c < after[:, s]
                after[better, s] = c[better]
                took[better, s] = t
        best = after
        choice.append(took)
    out = np.empty((n, PARTS), dtype=np.int8)
    at = np.full(n, goal - low)
    for i in reversed(range(PARTS)):
        out[:, i] = choice[i][np.arange(n), at]
        at = at - out[:, i]
    return out


def _probes(groups: list[list[int]], rate: float):
    masks = [_mask(g) for g in groups]
    flips = []
    for g in groups:
        one = [_mask([b]) for b in g]
        two = [_mask([a, b]) for x, a in enumerate(g) for b in g[x + 1 :]]
        flips.append([np.array([0], dtype=np.int64), np.array([0, *one], dtype=np.int64), np.array([0, *one, *two], dtype=np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(PARTS)], axis=1).astype(np.float64)
            for at in range(0, len(fp), 8192):
                some = fp[at : at + 8192]
                levels = allocate(counts[at : at + 8192], [len(g) for g in groups], rate)
                for i in range(PARTS):
                    for t in range(RADIUS + 1):
                        own = some[levels[:, i] == t]
                        if len(own):
                            flip = flips[i][t]
                            values = ((own & masks[i])[:, None] ^ flip).ravel()
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(values), i, dtype=np.int32)), pa.array(values), pa.array(np.repeat(own, len(flip)))], names=["part", "value", "probe"]
                            )

    return run


# ---------------------------------------------------------------- links


def _values(fp: Column, groups: list[list[int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("part"), fp.bitwiseAND(F.lit(_mask(g))).alias("value")) for i, g in enumerate(groups)]))


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b): edges between distinct fingerprints whose components are those of all links.

    ``prints`` has one row per distinct ``fp``.  Edges of dense groups are stars (see the
    module's text), so an edge may join two fingerprints that link through a third one.
    """
    groups = bit_groups(prints)
    index = prints.select("fp", _values(F.col("fp"), groups).alias("v")).select("fp", "v.part", "v.value")
    counts = index.groupBy("part", "value").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("n")).first()
    rate = float(total.pairs or 0) / max(1, total.n or 1) / 2**16
    own = index.join(counts, ["part", "value"]).groupBy("fp").agg(*[F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"c{i}") for i in range(PARTS)])
    probes = cut_lineage(own.mapInArrow(_probes(groups, rate), "part int, value long, probe long"))
    met = probes.join(counts, ["part", "value"]).groupBy("probe").agg(F.sum("n").alias("met"))
    crowded = cut_lineage(met.filter(F.col("met") > dense).select(F.col("probe").alias("fp")))
    sparse = probes.join(crowded.select(F.col("fp").alias("probe")), "probe", "left_anti")
    near = (
        sparse.join(index, ["part", "value"])
        .filter((F.col("fp") != F.col("probe")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("probe"))) <= RADIUS))
        .select(F.col("probe").alias("a"), F.col("fp").alias("b"))
    )
    around = F.array(F.lit(0).cast("long"), *[F.lit(_mask([b])).cast("long") for b in range(64)])
    hung = crowded.select("fp", F.explode(F.transform(around, lambda x: F.col("fp").bitwiseXOR(x))).alias("middle"))
    least = hung.groupBy("middle").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1")
    stars = hung.join(least, "middle").filter("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return near.union(stars).distinct()


def near_duplicates(documents: DataFrame, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id): one row per document, copies included."""
    prints = cut_lineage(fingerprints(documents).distinct())
    folded = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(folded.select("fp"), dense))
    named = folded.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # star contraction leaves one row per fingerprint, so only the document side of this join can be hot: adaptive execution splits it
    ids = cut_lineage(named.join(least, "root").select("fp", "component_id"))
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_first(documents: DataFrame, dense: int = DENSE) -> DataFrame:
    """The rows of ``documents`` whose id names their component: one of each group stays.

    Rows with a null id are kept.  Repeated rows of a kept document stay as they are.
    """
    classes = near_duplicates(documents, dense)
    gone = classes.filter("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
