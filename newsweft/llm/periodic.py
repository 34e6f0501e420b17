"""Periodic runs of words, by uniting suffix classes in order of falling common prefix.

A run is a stretch of consecutive words with smallest period q, of length ``max(shortest, exponent * q)`` or more,
that no neighbouring word extends with the same period.  Per text:

1. Two starts of a run that lie one period apart have as many words in common as the run is long without its first
   period, so at least ``least_common(shortest, exponent)``.  Only places whose next words of that number occur twice in the
   text can matter: a table of hash counts leaves the others out, then the words themselves decide.
2. Prefix doubling over those places gives their suffix order and, level by level, the classes of equal prefixes; the
   common prefix of two neighbours in the order is read off the levels.
3. Kruskal over the neighbours, longest common prefix first: each union merges two ordered sets of positions, the smaller
   into the larger.  Two positions p < q that become neighbours in a set at common prefix l, with q - p small enough,
   are the seed of a run of period q - p that reaches l words beyond q.  It is maximal on the right since l is exact, and
   kept if the words before p and q differ.  Its period is the smallest, since a smaller one would put a position between
   p and q in the set; and every run is found this way, since between its first two periods no other position can lie in
   their class (a primitive word does not occur inside its own square but at the ends).

Several texts are worked on at once: a word's number belongs to its text, so nothing is shared between texts. Memory
is that of ``WORDS`` words or of the longest text, whichever is more; steps take n log n or n log^2 n of a text's words.

Defined results: null and empty texts have no words and no runs; null ids and repeated rows pass through, one result
row each; columns other than doc_id and text are left behind, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsweft.llm.common import texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHORTEST, EXPONENT = 6, 4
WORDS = 400_000  # words of a block of texts, unless one text has more
CHUNK = 2000
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def least_common(shortest: int, exponent: int) -> int:
    """Words that two starts one period apart share at least, in any run."""
    return min(max(shortest - q, (exponent - 1) * q) for q in range(1, shortest + 1))


class Positions:
    """An ordered set of positions in chunks, so that an insertion moves few of them."""

    __slots__ = ("chunks", "tops", "size")

    def __init__(self, position: int):
        self.chunks, self.tops, self.size = [[position]], [position], 1

    def __iter__(self):
        for chunk in self.chunks:
            yield from chunk

    def add(self, x: int) -> tuple[int, int]:
        """Insert ``x``; its neighbours below and above, -1 where there is none."""
        at = bisect_left(self.tops, x)
        if at == len(self.tops):
            at -= 1
            self.tops[at] = x
        chunk = self.chunks[at]
        i = bisect_left(chunk, x)
        below = chunk[i - 1] if i else self.chunks[at - 1][-1] if at else -1
        above = chunk[i] if i < len(chunk) else self.chunks[at + 1][0] if at + 1 < len(self.chunks) else -1
        chunk.insert(i, x)
        self.size += 1
        if len(chunk) > 2 * CHUNK:
            self.chunks[at : at + 1] = [chunk[:CHUNK], chunk[CHUNK:]]
            self.tops[at : at + 1] = [chunk[CHUNK - 1], chunk[-1]]
        return below, above


def _repeated(words: np.ndarray, least: int) -> np.ndarray:
    """Places whose next ``least`` words may occur twice; none that do is missed."""
    n = len(words) - least + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(least):
        h = (h ^ words[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    slots = (h >> np.uint64(64 - max(16, int(n).bit_length() + 3))).astype(np.int64)
    return np.flatnonzero(np.bincount(slots)[slots] > 1)


def _suffix_order(words: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places with a repeated prefix and those right behind such a prefix, in suffix order, and their ranks at prefix lengths
    ``least``, twice that, four times that and so on, until no rank is shared.  Words that end a text are unique."""
    places = _repeated(words, least)
    places = np.unique(np.concatenate([places, places + least]))
    places = places[places + least <= len(words)]
    order = places[np.lexsort([words[places + j] for j in reversed(range(least))])]
    rank = np.full(len(words) + least, -1, dtype=np.int64)
    starts = np.zeros(len(order), dtype=bool)
    starts[:1] = True
    for j in range(least):
        column = words[order + j]
        starts[1:] |= column[1:] != column[:-1]
    levels, length = [], least
    while True:
        first = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
        rank[order] = first
        levels.append(rank.astype(np.int32 if len(words) < 2**31 else np.int64))
        shared = ~starts
        shared[:-1] |= ~starts[1:]
        at = np.flatnonzero(shared)
        if not len(at):
            return order, levels
        # a shared prefix ends inside its text, and the place behind it is ranked
        key = first[at] * np.int64(len(order) + 1) + rank[order[at] + length]
        moved = np.argsort(key, kind="stable")
        order[at], key = order[at][moved], key[moved]
        starts[at] = np.concatenate([[True], key[1:] != key[:-1]])
        length *= 2


def _common(a: np.ndarray, b: np.ndarray, words: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """Exact number of words that the suffixes at a and b have in common, given that it is ``least`` or more."""
    shared = np.zeros(len(a), dtype=np.int64)
    for k in reversed(range(len(levels))):
        rank = levels[k]
        same = rank[a + shared] == rank[b + shared]
        shared[same] += least << k
    going = np.ones(len(a), dtype=bool)
    for _ in range(least - 1):
        going &= words[a + shared] == words[b + shared]
        shared[going] += 1
    return shared


def runs_of(texts_words: list[list[str]], shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start, then period."""
    least = least_common(shortest, exponent)
    sizes = np.array([len(w) for w in texts_words], dtype=np.int64)
    bases = np.cumsum(sizes + 1) - sizes  # a word that no text has stands before each text, and some behind the last
    total = int((sizes + 1).sum()) + least + 1
    words = -1 - np.arange(total)
    for base, some in zip(bases.tolist(), texts_words):
        numbers: dict[str, int] = {}
        # a word's number is the place where its text has it first
        words[base : base + len(some)] = np.fromiter(map(numbers.setdefault, some, count(base)), dtype=np.int64, count=len(some))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts_words]
    if total < least + 2:
        return out
    order, levels = _suffix_order(words, least)
    if not len(order):
        return out
    first = levels[0]
    left = np.flatnonzero(first[order[:-1]] == first[order[1:]])
    a, b = order[left], order[left + 1]
    shared = _common(a, b, words, levels, least)
    falling = np.argsort(-shared, kind="stable")
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    seeds: list[tuple[int, int, int]] = []
    ratio = exponent - 1

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for p, q, common in zip(a[falling].tolist(), b[falling].tolist(), shared[falling].tolist()):
        p, q = root(p), root(q)
        large, small = sets.pop(p, None) or Positions(p), sets.pop(q, None) or Positions(q)
        if large.size < small.size:
            p, q, large, small = q, p, small, large
        parent[q], sets[p] = p, large
        reach = common // ratio  # the longest period that this common prefix allows
        inside = list(small)
        for i, x in enumerate(inside):
            below, above = large.add(x)
            # neighbours that the smaller set had among itself are not new
            if 0 <= below and x - below <= reach and not (i and below == inside[i - 1]):
                seeds.append((below, x, common))
            if 0 <= above and above - x <= reach and not (i + 1 < len(inside) and inside[i + 1] < above):
                seeds.append((x, above, common))
    if seeds:
        p, q, common = np.array(seeds, dtype=np.int64).T
        good = (words[p - 1] != words[q - 1]) & (common + q - p >= shortest)
        p, q, common = p[good], q[good], common[good]
        owner = np.searchsorted(bases, p, side="right") - 1
        for number, start, length, period in sorted(zip(owner.tolist(), (p - bases[owner]).tolist(), (common + q - p).tolist(), (q - p).tolist()), key=lambda r: (r[0], r[1], r[3])):
            out[number].append((start, length, period))
    return out


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return " ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return " ".join([words[i] for i in kept.tolist()])


def find_runs(
    documents: DataFrame, change: Callable[[int | None, list[str]], list[str]] | None = None, shortest: int = SHORTEST, exponent: int = EXPONENT, block: int = WORDS
) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text without its repetitions, for every row.

    ``change(doc_id, words)`` may return other words to work on in place of a text's own.
    """
    if exponent < 2 or shortest < 2:
        raise ValueError("a run has two periods and two words at least")

    def finish(names: list, held: list[list[str]]) -> pa.RecordBatch:
        found = runs_of(held, shortest, exponent)
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
        columns = [
            pa.array(names, pa.int64()),
            pa.array([len(w) for w in held], pa.int64()),
            pa.array(rows, RUNS),
            pa.array([collapse(w, r) for w, r in zip(held, found)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = WORD.findall(text.as_py())
                words = change(name, words) if change else words
                if held and size + len(words) > block:
                    yield finish(names, held)
                    names, held, size = [], [], 0
                names.append(name)
                held.append(words)
                size += len(words)
        if held:
            yield finish(names, held)

    return texts(documents).mapInArrow(run, SCHEMA)
