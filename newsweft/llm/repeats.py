"""Repeated passages across documents: prefix-free parsing and suffix order of its dictionary.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller id is removed.

Parsing.  A rolling hash of ``TRIGGER`` bytes ends a phrase wherever it is 0 modulo ``PERIOD``, so equal passages fall
into equal phrases. A phrase is taken with the ``LENGTH`` - 1 bytes that follow it, so every window (``LENGTH``-byte
string) that starts in it lies in it, and phrases overlap as the method asks. The dictionary has each distinct
phrase once, with the least document that has it: windows of later occurrences are repeats without being looked at.

Dictionary.  What is left are windows of first occurrences that may stand in another phrase as well: around edits,
and where passages begin and end. Each window has an anchor, the least hash of its ``GRAM``-byte strings, which depends
on the window alone; a window whose anchor occurs in the first occurrence of one distinct phrase only has no twin elsewhere. A home
tells its anchors once it knows which of its phrases are first occurrences, so an anchor goes with a small number and not with names
of phrases, and anchors of copies do not travel. Runs of windows with one
shared anchor travel as the text that they cover, to the range of that anchor. The suffixes that begin there, cut to ``LENGTH``
bytes, are ordered by their hash, equal neighbours are checked byte by byte (if two strings share a hash, the suffixes
themselves are sorted), and each class of equal ones gets its least document. The parse tells where each suffix stands. Only
classes matter here, so the corpus order is made of everything that can repeat, not of the corpus.
Windows of anchors that occur in more than ``HOT`` phrases go to ranges of their own hashes instead, one entry per home and window.

Scale.  Documents are dealt by id to homes of about ``HOME`` bytes and checkpointed once, compressed, by home. What a home
sends out is one packed row per range, with one entry per distinct phrase and anchor, so a passage in a third of all rows
costs one entry per home; what comes back is what the home asked about. Ranges and homes grow in number
with the input, not in size. Phrases and windows of frequent anchors are compared by 128-bit hashes, other windows by their bytes.

Defined results: a null or empty text has no bytes; texts under ``LENGTH`` bytes lose nothing; a document's own
repeats are not repeats; rows with the same id are one document for the comparison and are returned each;
rows with a null id come before all others, as one document, and lose nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.llm.common import cut_lineage, keep_partitions, texts

LENGTH = 50
TRIGGER = 12
PERIOD = 128  # a power of two
GRAM = 24
HOME = 8_000_000  # bytes of text in a home; smaller ones leave too little in a packed row to compress
CHUNK = 200_000  # bytes parsed at once: the arrays of a chunk stay in the cache
RUN = 4096  # windows in a run
HOT = 256
NO_ID = -(1 << 63)

DOCS = "home int, doc_id long, data binary"
SENT = "bucket int, home int, kind int, data binary"
BACK = "home int, kind int, data binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
# kinds of rows: phrases, anchors, runs of windows, windows of frequent anchors
PHRASES, ANCHORS, RUNS, WINDOWS = range(4)
NAME = np.dtype([("a", "<u8"), ("b", "<u8"), ("low", "<i8"), ("high", "<i8")])
ANCHOR = np.dtype([("key", "<u8"), ("n", "<u2")])
HELD = np.dtype([("key", "<u8"), ("phrase", "<u8")])
RUN_OF = np.dtype([("key", "<u8"), ("low", "<i8"), ("row", "<u4"), ("start", "<u4"), ("size", "<u2")])
FIRST = np.dtype([("a", "<u8"), ("b", "<u8"), ("low", "<i8")])
SHARED = np.dtype([("key", "<u8"), ("hot", "u1")])
FOUND = np.dtype([("row", "<u4"), ("start", "<u4"), ("size", "<u4")])

_rng = np.random.default_rng(20240501)
CODES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size``-byte string, by doubling; one value per start."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if n > 2 * CHUNK:
        return np.concatenate([rolling(data[at : at + CHUNK + size - 1], size) for at in range(0, n, CHUNK)])
    h, have, out, done, power = CODES[data], 1, None, 0, BASE
    while True:
        if size & have:
            part = h[done : done + n]
            out = part if out is None else out * np.uint64(power) + part
            done += have
        if have * 2 > size:
            return _mix(out)
        h = h[:-have] * np.uint64(power) + h[have:]
        power = power * power % (1 << 64)
        have *= 2


def least_of(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every run of ``size`` values."""
    have = 1
    while have * 2 <= size:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    if have < size:
        values = np.minimum(values[: len(values) - (size - have)], values[size - have :])
    return values


def _joined(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _breaks(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


class Parse:
    """Phrases and anchors of some texts laid end to end; nothing crosses from one to the next."""

    def __init__(self, docs: list[tuple[int, int, bytes]]):
        import xxhash

        self.data = data = b"".join(d for _, _, d in docs)
        self.array = np.frombuffer(data, dtype=np.uint8)
        self.rows = np.array([r for r, _, _ in docs], dtype=np.int64)
        self.orders = np.array([o for _, o, _ in docs], dtype=np.int64)
        lengths = np.array([len(d) for _, _, d in docs], dtype=np.int64)
        self.first = np.cumsum(lengths) - lengths
        windows = np.maximum(lengths - LENGTH + 1, 0)
        self.at = _joined(self.first, windows)  # the start of every window
        trigger = rolling(self.array, TRIGGER)
        hit = self.at[(trigger[self.at] & np.uint64(PERIOD - 1)) == 0]
        self.starts = np.union1d(self.first[windows > 0], hit)
        self.doc = np.searchsorted(self.first, self.starts, side="right") - 1
        # empty texts share their first byte with the next one; the last of equal firsts is the one that has bytes
        ends = np.minimum(np.append(self.starts[1:], len(data)), self.first[self.doc] + windows[self.doc])
        self.sizes = ends - self.starts
        names = b"".join([xxhash.xxh3_128_digest(data[s : e + LENGTH - 1]) for s, e in zip(self.starts.tolist(), ends.tolist())])
        self.names = np.frombuffer(names, dtype="<u8").reshape(-1, 2)
        self.order = self.orders[self.doc]

    def phrase_of(self) -> np.ndarray:
        """The phrase of every window."""
        return np.repeat(np.arange(len(self.starts)), self.sizes)

    def anchors(self) -> np.ndarray:
        """The anchor of every window, mixed once more, since least values crowd at the low end of the ranges.

        40 bits of the hash do, as a false twin costs a comparison only.
        """
        if not len(self.at):
            return np.zeros(0, dtype=np.uint64)
        gram = rolling(self.array, GRAM)
        return _mix(least_of(gram, LENGTH - GRAM + 1)[self.at]) & np.uint64(0xFFFFFFFFFF000000)

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """128-bit hashes of the windows at some positions."""
        import xxhash

        data = self.data
        return np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[p : p + LENGTH]) for p in at.tolist()]), dtype="<u8").reshape(-1, 2)


def _docs(table: pa.Table) -> Iterator[tuple[int, int, int | None, bytes]]:
    """(row, order, id, bytes), numbered in an order that does not depend on the run."""
    import zstandard

    opener = zstandard.ZstdDecompressor()
    table = table.sort_by([("doc_id", "ascending"), ("data", "ascending")])
    for row, (name, data) in enumerate(zip(table.column("doc_id").to_pylist(), table.column("data").to_pylist())):
        yield row, NO_ID if name is None else name, name, opener.decompress(data)


def _chunks(table: pa.Table) -> Iterator[Parse]:
    docs: list[tuple[int, int, bytes]] = []
    held = 0
    for row, order, _, data in _docs(table):
        docs.append((row, order, data))
        held += len(data)
        if held >= CHUNK:
            yield Parse(docs)
            docs, held = [], 0
    if docs:
        yield Parse(docs)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    closer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data = [closer.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("home"), batch.column("doc_id"), pa.array(data, pa.binary())], names=["home", "doc_id", "data"])


def _squeezed(rows: np.ndarray, text: bytes = b"") -> bytes:
    """Entries column by column and byte by byte, as high bytes of sorted keys compress well; then the text.

    Most names have one document, so ``high`` is kept as its distance from ``low``.
    """
    import zstandard

    if "high" in rows.dtype.names:
        rows = rows.copy()
        rows["high"] -= rows["low"]
    planes = b"".join(np.ascontiguousarray(rows[n]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for n in rows.dtype.names) if len(rows) else b""
    return len(rows).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3 if text else 1).compress(planes + text)


def _opened(data: bytes, kind: np.dtype) -> tuple[np.ndarray, bytes]:
    import zstandard

    n = int.from_bytes(data[:8], "little")
    raw, at = zstandard.ZstdDecompressor().decompress(data[8:]), 0
    rows = np.empty(n, dtype=kind)
    for name in kind.names:
        width = kind[name].itemsize
        rows[name] = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T.copy().view(kind[name]).ravel()
        at += n * width
    if "high" in kind.names:
        rows["high"] += rows["low"]
    return rows, raw[at:]


def _folded(rows: np.ndarray, keys: list[str]) -> np.ndarray:
    """One row per key, with the least ``low`` and the greatest ``high``; sorted by key."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort([rows[k] for k in reversed(keys)])]
    first = np.flatnonzero(_breaks(*[rows[k] for k in keys]))
    out = rows[first].copy()
    out["low"] = np.minimum.reduceat(rows["low"], first)
    out["high"] = np.maximum.reduceat(rows["high"], first)
    return out


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"data": pa.binary()}
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), kinds.get(n, pa.int32())) for c, n in zip(columns, names)], names=names)


def _range_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _dealt(rows: np.ndarray, key: str, home: int, kind: int, buckets: int) -> list[tuple]:
    """One packed row per range; ``rows`` are sorted by ``key``."""
    bucket = _range_of(rows[key], buckets)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    return [(int(b[0]), home, kind, _squeezed(r)) for r, b in zip(np.split(rows, cut), np.split(bucket, cut)) if len(r)]


def _parsed(buckets: int):
    """Step 1, per home: distinct phrases with their documents."""

    def run(table: pa.Table) -> pa.Table:
        home = table.column("home")[0].as_py()
        phrases = []
        for parse in _chunks(table):
            row = np.empty(len(parse.starts), dtype=NAME)
            row["a"], row["b"], row["low"], row["high"] = parse.names[:, 0], parse.names[:, 1], parse.order, parse.order
            phrases.append(_folded(row, ["a", "b"]))
        return _table(_dealt(_folded(np.concatenate(phrases), ["a", "b"]), "a", home, PHRASES, buckets), ["bucket", "home", "kind", "data"])

    return run


def _anchored(buckets: int):
    """Step 3, per home: distinct anchors of the phrases that no smaller document has, and how many of these have each.

    Rows of one id are in one home, so a phrase is counted once.
    """

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        known, held = Known(back), [np.empty(0, dtype=HELD)]
        for parse in _chunks(docs) if docs.num_rows else ():
            key, phrase = parse.anchors(), parse.phrase_of()
            new = _breaks(key, phrase) & ~known.copied(parse)[phrase]
            row = np.empty(int(new.sum()), dtype=HELD)
            row["key"], row["phrase"] = key[new], parse.names[phrase[new], 0]
            held.append(row)
        rows = np.concatenate(held)
        rows = rows[np.lexsort([rows["phrase"], rows["key"]])]
        rows = rows[_breaks(rows["key"], rows["phrase"])]
        first = np.flatnonzero(_breaks(rows["key"]))
        out = np.empty(len(first), dtype=ANCHOR)
        out["key"], out["n"] = rows["key"][first], np.minimum(np.diff(np.append(first, len(rows))), HOT + 1)
        home = (docs if docs.num_rows else back).column("home")[0].as_py()
        return _table(_dealt(out, "key", home, ANCHORS, buckets), ["bucket", "home", "kind", "data"])

    return run


def _by_home(rows: np.ndarray, home: np.ndarray, kind: int) -> list[tuple]:
    order = np.argsort(home, kind="stable")
    rows, home = rows[order], home[order]
    cut = np.flatnonzero(np.diff(home)) + 1
    return [(int(h[0]), kind, _squeezed(r)) for r, h in zip(np.split(rows, cut), np.split(home, cut)) if len(r)]


def _gathered(table: pa.Table, kind: int, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, bytes]:
    """All entries of a kind, the home of each, and their texts one after the other."""
    parts, homes, texts_ = [np.empty(0, dtype=dtype)], [np.empty(0, dtype=np.int64)], []
    for home, of, data in zip(table.column("home").to_pylist(), table.column("kind").to_pylist(), table.column("data").to_pylist()):
        if of == kind:
            rows, text = _opened(data, dtype)
            parts.append(rows)
            homes.append(np.full(len(rows), home, dtype=np.int64))
            texts_.append(text)
    return np.concatenate(parts), np.concatenate(homes), b"".join(texts_)


def _least_names(table: pa.Table, kind: int) -> list[tuple]:
    """For each home the names that a smaller document than one of its own has."""
    rows, home, _ = _gathered(table, kind, NAME)
    if not len(rows):
        return []
    order = np.lexsort([rows["b"], rows["a"]])
    rows, home = rows[order], home[order]
    first = np.flatnonzero(_breaks(rows["a"], rows["b"]))
    low = np.repeat(np.minimum.reduceat(rows["low"], first), np.diff(np.append(first, len(rows))))
    tell = low < rows["high"]
    send = np.empty(int(tell.sum()), dtype=FIRST)
    send["a"], send["b"], send["low"] = rows["a"][tell], rows["b"][tell], low[tell]
    return _by_home(send, home[tell], kind)


def _shared_anchors(table: pa.Table) -> list[tuple]:
    rows, home, _ = _gathered(table, ANCHORS, ANCHOR)
    if not len(rows):
        return []
    order = np.argsort(rows["key"], kind="stable")
    rows, home = rows[order], home[order]
    first = np.flatnonzero(_breaks(rows["key"]))
    number = np.repeat(np.add.reduceat(rows["n"].astype(np.int64), first), np.diff(np.append(first, len(rows))))
    shared, hot = number > 1, number > HOT
    send = np.empty(int(shared.sum()), dtype=SHARED)
    send["key"], send["hot"] = rows["key"][shared], hot[shared]
    return _by_home(send, home[shared], ANCHORS)


def _compared(table: pa.Table) -> pa.Table:
    """Steps 2 and 4, per range."""
    return _table(_least_names(table, PHRASES) + _shared_anchors(table), ["home", "kind", "data"])


def _repeated_runs(table: pa.Table) -> list[tuple]:
    """Windows of runs that a smaller document has, as (row, start, size), for each home."""
    rows, home, text = _gathered(table, RUNS, RUN_OF)
    if not len(rows):
        return []
    array = np.frombuffer(text, dtype=np.uint8)
    spans = rows["size"].astype(np.int64) + LENGTH - 1
    first = np.cumsum(spans) - spans
    at = _joined(first, rows["size"].astype(np.int64))
    run = np.repeat(np.arange(len(rows)), rows["size"])
    h = rolling(array, LENGTH)[at]
    order = np.argsort(h, kind="stable")  # by hash
    group = np.flatnonzero(_breaks(h[order]))
    sizes = np.diff(np.append(group, len(order)))
    low = rows["low"][run[order]]
    twins = np.minimum.reduceat(low, group) < np.maximum.reduceat(low, group)  # other hashes occur in one document
    order = order[np.repeat(twins, sizes)]
    if not len(order):
        return []
    at, run, h = at[order], run[order], h[order]
    padded = np.lib.stride_tricks.sliding_window_view(array, 8)
    columns = [padded[at + i].copy().view(">u8").ravel() for i in (*range(0, LENGTH - 8, 8), LENGTH - 8)]
    first_of = _breaks(*columns)
    if (first_of != _breaks(h)).any():  # two strings share a hash: the order of the suffixes themselves decides
        order = np.lexsort(columns[::-1])
        at, run = at[order], run[order]
        first_of = _breaks(*[c[order] for c in columns])
    first_of = np.flatnonzero(first_of)
    low = np.repeat(np.minimum.reduceat(rows["low"][run], first_of), np.diff(np.append(first_of, len(run))))
    gone = low < rows["low"][run]
    at, run = at[gone], run[gone]
    start = rows["start"][run].astype(np.int64) + (at - first[run])
    found = _as_runs(rows["row"][run].astype(np.int64), start, home[run])
    send = np.empty(len(found), dtype=FOUND)
    for name in FOUND.names:
        send[name] = found[name]
    return _by_home(send, found["home"], RUNS)


def _as_runs(row: np.ndarray, start: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Single windows put together to (home, row, start, size)."""
    order = np.lexsort([start, row, home])
    row, start, home = row[order], start[order], home[order]
    new = _breaks(home, row)
    new[1:] |= start[1:] != start[:-1] + 1
    first = np.flatnonzero(new)
    out = np.empty(len(first), dtype=[("home", "<i8"), *FOUND.descr])
    out["home"], out["row"], out["start"] = home[first], row[first], start[first]
    out["size"] = np.diff(np.append(first, len(row)))
    return out


def _decided(table: pa.Table) -> pa.Table:
    """Step 6, per range."""
    return _table(_repeated_runs(table) + _least_names(table, WINDOWS), ["home", "kind", "data"])


class Known:
    """What came back to a home: least documents of phrases and windows, shared anchors, repeated windows."""

    def __init__(self, table: pa.Table):
        self.phrases = self._sorted(table, PHRASES)
        self.windows = self._sorted(table, WINDOWS)
        anchors = _gathered(table, ANCHORS, SHARED)[0]
        anchors = anchors[np.argsort(anchors["key"])]
        self.anchors, self.hot = anchors["key"], anchors["hot"].astype(bool)
        runs = _gathered(table, RUNS, FOUND)[0]
        self.runs = runs[np.argsort(runs["row"], kind="stable")]

    @staticmethod
    def _sorted(table: pa.Table, kind: int) -> np.ndarray:
        rows = _gathered(table, kind, FIRST)[0]
        return rows[np.lexsort([rows["b"], rows["a"]])]

    @staticmethod
    def earlier(known: np.ndarray, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Whether a document before ``order`` has the name (a, b)."""
        if not len(known) or not len(a):
            return np.zeros(len(a), dtype=bool)
        where = np.minimum(np.searchsorted(known["a"], a), len(known) - 1)
        return (known["a"][where] == a) & (known["b"][where] == b) & (known["low"][where] < order)

    def copied(self, parse: Parse) -> np.ndarray:
        """Per phrase: whether a smaller document has it."""
        return self.earlier(self.phrases, parse.names[:, 0], parse.names[:, 1], parse.order)

    def undecided(self, parse: Parse, copied: np.ndarray, anchored: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows outside copied phrases whose anchor is shared: their numbers, anchors, and whether it is frequent.

        If the homes have not told their anchors, any anchor may be shared.
        """
        number = np.flatnonzero(~copied[parse.phrase_of()])
        if not anchored:
            return number, parse.anchors()[number], np.zeros(len(number), dtype=bool)
        if not len(self.anchors) or not len(number):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        key = parse.anchors()[number]
        where = np.minimum(np.searchsorted(self.anchors, key), len(self.anchors) - 1)
        shared = self.anchors[where] == key
        return number[shared], key[shared], self.hot[where[shared]]


def _asked(buckets: int, anchored: bool = False):
    """Step 5, per home: runs of undecided windows with their text, and windows of frequent anchors."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        known, runs, texts_, windows = Known(back), [], [], []
        for parse in _chunks(docs) if docs.num_rows else ():
            number, key, hot = known.undecided(parse, known.copied(parse), anchored)
            at = parse.at[number]
            doc = np.searchsorted(parse.first, at, side="right") - 1
            if hot.any():
                names = parse.hashes(at[hot])
                row = np.empty(len(names), dtype=NAME)
                row["a"], row["b"] = names[:, 0], names[:, 1]
                row["low"] = row["high"] = parse.orders[doc[hot]]
                windows.append(_folded(row, ["a", "b"]))
            at, key, doc = at[~hot], key[~hot], doc[~hot]
            if not len(at):
                continue
            new = _breaks(key)
            new[1:] |= at[1:] != at[:-1] + 1
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(at)))
            pieces = -(-sizes // RUN)  # long runs are cut
            begin = _joined(np.zeros(len(first), dtype=np.int64), pieces) * RUN + np.repeat(first, pieces)
            size = np.minimum(np.repeat(first + sizes, pieces) - begin, RUN)
            row = np.empty(len(begin), dtype=RUN_OF)
            row["key"], row["low"], row["size"] = key[begin], parse.orders[doc[begin]], size
            row["row"], row["start"] = parse.rows[doc[begin]], at[begin] - parse.first[doc[begin]]
            order = np.argsort(row["key"], kind="stable")
            runs.append(row[order])
            texts_.append((parse.array, at[begin][order], size[order] + LENGTH - 1))
        home = (docs if docs.num_rows else back).column("home")[0].as_py()
        out = []
        if runs:
            parts: dict[int, list] = {}
            for row, (array, at, size) in zip(runs, texts_):
                bucket = _range_of(row["key"], buckets)
                cut = np.flatnonzero(np.diff(bucket)) + 1
                for b, r, a, z in zip(np.split(bucket, cut), np.split(row, cut), np.split(at, cut), np.split(size, cut)):
                    parts.setdefault(int(b[0]), []).append((r, array[_joined(a, z)].tobytes()))
            for bucket, some in parts.items():
                out.append((bucket, home, RUNS, _squeezed(np.concatenate([r for r, _ in some]), b"".join([t for _, t in some]))))
        if windows:
            out += _dealt(_folded(np.concatenate(windows), ["a", "b"]), "a", home, WINDOWS, buckets)
        return _table(out, ["bucket", "home", "kind", "data"])

    return run


def _removed(docs: pa.Table, back: pa.Table) -> pa.Table:
    """Step 7, per home: what is left of each document."""
    known, out = Known(back), []
    names = {row: name for row, _, name, _ in _docs(docs)} if docs.num_rows else {}
    for parse in _chunks(docs) if docs.num_rows else ():
        copied = known.copied(parse)
        edge = np.zeros(len(parse.array) + LENGTH + 1, dtype=np.int64)
        np.add.at(edge, parse.starts[copied], 1)
        np.add.at(edge, parse.starts[copied] + parse.sizes[copied] + LENGTH - 1, -1)
        if known.hot.any():
            number, _, hot = known.undecided(parse, copied)
            at = parse.at[number[hot]]
            name = parse.hashes(at)
            at = at[known.earlier(known.windows, name[:, 0], name[:, 1], parse.orders[np.searchsorted(parse.first, at, side="right") - 1])]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
        low, high = np.searchsorted(known.runs["row"], [parse.rows[0], parse.rows[-1] + 1])
        runs = known.runs[low:high]
        at = parse.first[runs["row"] - parse.rows[0]] + runs["start"]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + runs["size"] + LENGTH - 1, -1)
        gone = np.cumsum(edge)[: len(parse.array)] > 0
        for row, a, b in zip(parse.rows.tolist(), parse.first.tolist(), [*parse.first[1:].tolist(), len(parse.array)]):
            some = gone[a:b]
            kept = parse.array[a:b][~some].tobytes() if some.any() else parse.data[a:b]
            spans = int(some[0]) + int((some[1:] & ~some[:-1]).sum()) if len(some) else 0
            out.append((names[row], b - a, int(some.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    titles = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    columns = list(zip(*out)) if out else [[] for _ in titles]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=titles)


def _without_bytes(docs: pa.Table, back: pa.Table) -> pa.Table:
    return _removed(docs, back).drop_columns(["kept"])


def remove_repeats(documents: DataFrame, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes that are left.

    One row per input row.
    """
    rows = texts(documents)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    homes = max(1, math.ceil(size / HOME))
    packed = rows.withColumn("home", F.pmod(F.xxhash64("doc_id"), F.lit(homes)).cast("int")).mapInArrow(_pack, DOCS)
    docs = keep_partitions(packed.repartition(homes, "home"))
    sent = docs.groupBy("home").applyInArrow(_parsed(homes), SENT)
    phrases = cut_lineage(sent.groupBy("bucket").applyInArrow(_compared, BACK))
    first = docs.groupBy("home").cogroup(phrases.groupBy("home")).applyInArrow(_anchored(homes), SENT)
    known = phrases.union(cut_lineage(first.groupBy("bucket").applyInArrow(_compared, BACK)))
    asked = docs.groupBy("home").cogroup(known.groupBy("home")).applyInArrow(_asked(homes, anchored=True), SENT)
    told = cut_lineage(asked.groupBy("bucket").applyInArrow(_decided, BACK))
    every = docs.groupBy("home").cogroup(known.union(told).groupBy("home"))
    schema = RESULT if with_bytes else RESULT.rsplit(",", 1)[0]
    return every.applyInArrow(_removed if with_bytes else _without_bytes, schema)
