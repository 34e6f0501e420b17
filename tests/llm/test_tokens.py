"""BPE, token files and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
from brute import odd_rows, prose, table  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from newsweft.llm import bpe, packing, tokenfile  # noqa: E402
from newsweft.llm.bpe import PrefixBpe  # noqa: E402
from newsweft.llm.queries import op1_bpe, op8_tokenfile, op9_packing, tokenizer  # noqa: E402
from newsweft.llm.tokens import PieceEncoder  # noqa: E402

WORDS, BYTES = tokenizer("word_bpe_49k.json"), tokenizer("byte_bpe_50k.json")


def scrambled(number):
    rnd = random.Random(7)
    letters = "aabcdehilnorstu'.,!? \n\t\x85\xa0 ​ÉéßİΣσς中文🙂½²9 0~_-<|>/\x00\x1c"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(number)]
    return [*texts, "<|endoftext|> x<|startoftext|>", "</w>", "a" * 400, "DON'T we'll", "a  b   c", "  x ", "\n \n", "ﬁ é", *(prose(i) for i in range(20))]


@pytest.fixture()
def sf_dir(spark, tmp_path):
    table(spark, odd_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_prefix_encoder_equals_library():
    mine, library = PrefixBpe.of(WORDS), Tokenizer.from_file(WORDS)
    for text in scrambled(1500):
        ids, decoded = mine.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert decoded == library.decode(want, skip_special_tokens=False) == mine.decode(want)


def test_piece_encoder_equals_library():
    mine, library = PieceEncoder(BYTES, cache=50), Tokenizer.from_file(BYTES)
    texts = scrambled(1500)
    for text, ids in zip(texts, map(mine.encode, texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    for text in texts[::10]:
        assert mine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_op1(spark, sf_dir):
    library = Tokenizer.from_file(WORDS)
    want = []
    for i, t, *_ in odd_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in op1_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_decode_of_ids(spark, sf_dir):
    coded = bpe.encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), WORDS)
    again = bpe.decode(coded, WORDS)
    assert sorted(map(str, again.collect())) == sorted(map(str, coded.select("doc_id", "decoded").collect()))


@pytest.mark.parametrize("high", [1, 2, 300, 70_000, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 5000])
def test_blocks_round_trip(n, high):
    rnd = np.random.default_rng(n)
    ids = rnd.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[::97] = high - 1
    assert (tokenfile.unpack_ids(tokenfile.pack_ids(ids)) == ids).all()


def test_blocks_are_smaller_than_words():
    ids = np.random.default_rng(1).zipf(1.5, 100_000).clip(0, 50_000).astype(np.uint32)
    assert len(tokenfile.pack_ids(ids)) < 2 * len(ids)


def coded(end):
    library = Tokenizer.from_file(BYTES)
    return [(i, t or "", [*library.encode(t or "", add_special_tokens=False).ids, end]) for i, t, *_ in odd_rows()]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_op8(spark, sf_dir):
    got = [tuple(r) for r in op8_tokenfile(spark, sf_dir).select("start", "doc_id", "n_tokens", "ids_crc32").orderBy("start").collect()]
    docs = coded(0)
    assert [g[1] for g in got] == sorted((d[0] for d in docs), key=lambda x: -1 if x is None else x)
    assert sorted((str(i), n, c) for _, i, n, c in got) == sorted((str(i), len(x), crc(x)) for i, _, x in docs)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n


def test_small_segments_and_parts(spark, sf_dir):
    folder = tokenfile.shared_folder(spark, "test")
    tokenfile.write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, BYTES, segment=100)
    assert spark.read.parquet(folder).count() > 5
    got = tokenfile.read_files(spark, folder)
    want = op8_tokenfile(spark, sf_dir)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def pieces_hold(rows, docs, window=2048):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    wanted = {}
    for i, _, ids in docs:
        wanted.setdefault(i, []).append(ids)
    for i, copies in wanted.items():
        pieces = by_doc.pop(i)
        for ids in copies:
            for start in sorted({p.start for p in pieces}):
                for p in [p for p in pieces if p.start == start and p.doc_tokens == len(ids)][:1]:
                    assert crc(ids[p.start : p.start + p.length]) == p.ids_crc32
        assert sum(p.length for p in pieces) == sum(map(len, copies))
    assert not by_doc
    return padding


def test_op9(spark, sf_dir):
    rows = op9_packing(spark, sf_dir).collect()
    assert pieces_hold(rows, coded(1)) == 0


def test_neighbours_share_words():
    """Documents over one vocabulary are packed together."""
    rnd = np.random.default_rng(3)
    docs = [rnd.integers(1000 * (i % 4), 1000 * (i % 4) + 60, 100).astype("<u2") for i in range(200)]
    sequences = packing.fill_windows(docs, 2048)
    mixed = sum(len({d % 4 for d, _, _ in s}) for s in sequences)
    assert mixed <= len(sequences) + 8
    covered = sorted((d, start, size) for s in sequences for d, start, size in s)
    assert sum(size for _, _, size in covered) == 200 * 100


def test_empty_tables(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    for query in (op1_bpe, op8_tokenfile, op9_packing):
        assert query(spark, str(tmp_path)).count() == 0


def test_shards_are_many(spark):
    docs = [(i, prose(i, 60), "en", "a") for i in range(60)]
    frame = packing.pack(table(spark, docs), BYTES, shard=10, window=64)
    assert frame.select(F.col("sequence_id").bitwiseAND(~((1 << packing.SEQUENCES) - 1))).distinct().count() > 3
    library = Tokenizer.from_file(BYTES)
    assert pieces_hold(frame.collect(), [(i, t, [*library.encode(t, add_special_tokens=False).ids, 1]) for i, t, *_ in docs], 64) == 0
