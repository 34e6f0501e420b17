"""Token ids in files of patched frame-of-reference blocks.

A segment is one row of a table of files: a directory of documents (ids and lengths) and a payload.
The payload holds the segment's ids in blocks of ``BLOCK``:

    magic "NWT1" | ids in a block u32 | ids u64 | blocks u32 | start of each block u64 ...
    block: minimum u32 | width u8 | exceptions u16 | packed bits | positions u16 ... | values u32 ...

Each block subtracts its minimum and packs the rest at the width (in bits) that holds the share ``PERCENTILE`` of
its values; larger values are exceptions: their position and their value stand after the packed bits, and
their packed bits hold the low part. The block starts make any block readable by itself. All numbers are little-endian.

Segments are written in ascending (doc_id, hash of the text) order: the documents are range-partitioned, every task
encodes its range in order and closes a segment once it holds ``SEGMENT`` ids, and Spark's own writer
commits the files, so a lost executor leaves no half file. A document lies in one segment.

Defined results: a null or empty text is the end id alone; null ids come first; repeated rows are
written one by one; an empty table gives no segment; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsweft.llm.common import ready, texts
from newsweft.llm.tokens import PieceEncoder
from newsweft.session import ensure_checkpoint_dir

MAGIC = b"NWT1"
BLOCK = 1024
PERCENTILE = 90
SEGMENT = 1 << 20
END = 0
HEAD = struct.Struct("<4sIQI")
BLOCK_HEAD = struct.Struct("<IBH")
FILES = "part int, before long, n_ids long, doc_ids binary, known binary, counts binary, payload binary"


def _bits(values: int) -> int:
    return int(values).bit_length()


def pack_ids(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The payload of a segment."""
    n = len(ids)
    blocks = -(-n // block)
    if not blocks:
        return HEAD.pack(MAGIC, block, 0, 0)
    full = np.full(blocks * block, ids[-1], dtype=np.uint32)
    full[:n] = ids
    full = full.reshape(blocks, block)
    low = full.min(axis=1)
    rest = full - low[:, None]
    level = np.partition(rest, block * PERCENTILE // 100 - 1, axis=1)[:, block * PERCENTILE // 100 - 1]
    width = np.array([_bits(v) for v in level])
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        for at in range(0, len(which), 64):
            some = which[at : at + 64]
            spread = ((rest[some][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            rows = np.packbits(spread.reshape(len(some), -1), axis=1, bitorder="little")
            for i, row in zip(some, rows):
                packed[i] = row.tobytes()
    over = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    counts = over.sum(axis=1)
    where = np.nonzero(over)[1].astype("<u2")
    values = rest[over].astype("<u4")
    ends = np.cumsum(counts)
    body, starts, at = [], [], HEAD.size + 8 * blocks
    for i in range(blocks):
        a, b = int(ends[i] - counts[i]), int(ends[i])
        piece = BLOCK_HEAD.pack(int(low[i]), int(width[i]), int(counts[i])) + packed[i] + where[a:b].tobytes() + values[a:b].tobytes()
        starts.append(at)
        body.append(piece)
        at += len(piece)
    return HEAD.pack(MAGIC, block, n, blocks) + np.array(starts, dtype="<u8").tobytes() + b"".join(body)


def unpack_ids(payload: bytes) -> np.ndarray:
    """The ids of a segment."""
    magic, block, n, blocks = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    starts = np.frombuffer(payload, dtype="<u8", count=blocks, offset=HEAD.size)
    heads = [BLOCK_HEAD.unpack_from(payload, int(s)) for s in starts]
    out = np.zeros((blocks, block), dtype=np.uint32)
    width = np.array([h[1] for h in heads], dtype=np.int64)
    for w in np.unique(width):
        if not w:
            continue
        which, size = np.flatnonzero(width == w), block * int(w) // 8
        for at in range(0, len(which), 64):
            some = which[at : at + 64]
            raw = np.stack([np.frombuffer(payload, dtype=np.uint8, count=size, offset=int(starts[i]) + BLOCK_HEAD.size) for i in some])
            spread = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(some), block, int(w))
            wide = np.zeros((len(some), block, 32 if w > 16 else 16), dtype=np.uint8)
            wide[:, :, :w] = spread
            out[some] = np.packbits(wide, axis=2, bitorder="little").reshape(len(some), -1).view("<u4" if w > 16 else "<u2")
    for i, (low, w, count) in enumerate(heads):
        if count:
            at = int(starts[i]) + BLOCK_HEAD.size + block * w // 8
            where = np.frombuffer(payload, dtype="<u2", count=count, offset=at)
            out[i, where] = np.frombuffer(payload, dtype="<u4", count=count, offset=at + 2 * count)
    out += np.array([h[0] for h in heads], dtype=np.uint32)[:, None]
    return out.ravel()[:n]


def _writer(path: str, end: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = PieceEncoder.of(path)
        part = TaskContext.get().partitionId()
        tail = np.array([end], dtype=encoder.dtype)
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = before = 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            row = {
                "part": part,
                "before": before,
                "n_ids": len(flat),
                "doc_ids": np.array([n or 0 for n in names], dtype="<i8").tobytes(),
                "known": np.array([n is not None for n in names], dtype=np.uint8).tobytes(),
                "counts": np.array([len(x) for x in ids], dtype="<u8").tobytes(),
                "payload": pack_ids(flat),
            }
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), *[(c, pa.binary()) for c in ("doc_ids", "known", "counts", "payload")]]))

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(np.concatenate([encoder.encode(text), tail]))
                names.append(name)
                held += len(ids[-1])
                if held >= segment:
                    yield close()
                    before += held
                    ids, names, held = [], [], 0
        if ids:
            yield close()

    return run


def write_files(documents: DataFrame, folder: str, path: str, end: int = END, segment: int = SEGMENT) -> None:
    """Encode ``documents`` with the tokenizer at ``path`` and write the segments to ``folder``."""
    rows = texts(documents).withColumn("row_hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "row_hash").sortWithinPartitions("doc_id", "row_hash").select("doc_id", "text")
    ordered.mapInArrow(_writer(path, end, segment), FILES).write.parquet(folder)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack_ids(row["payload"]).astype("<u4")
            counts = np.frombuffer(row["counts"], dtype="<u8").astype(np.int64)
            ends = np.cumsum(counts)
            names = np.frombuffer(row["doc_ids"], dtype="<i8")
            known = np.frombuffer(row["known"], dtype=np.uint8).astype(bool)
            crc = [zlib.crc32(ids[e - c : e].tobytes()) for c, e in zip(counts, ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.int64(), mask=~known),
                    pa.array(ends - counts + row["base"], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    The ids before a segment are those of earlier parts (one row per writing task is summed) and those
    before it in its own part.
    """
    ready(spark)
    files = spark.read.schema(FILES).parquet(folder)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    return files.join(bases, "part").select((F.col("earlier") + F.col("before")).alias("base"), "doc_ids", "known", "counts", "payload").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor reaches."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
