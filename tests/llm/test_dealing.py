"""Packing: documents that share words meet in a shard at every size."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from brute import prose, table  # noqa: E402

from newsweft.llm import packing  # noqa: E402
from newsweft.llm.queries import tokenizer  # noqa: E402


@pytest.mark.parametrize("size", [200, 1600])
def test_related_documents_share_a_shard(spark, size):
    """Pairs with most words in common: by hash they would share one of size / 20 shards by chance only."""
    rows = []
    for pair in range(size // 2):
        words = prose(pair, 60, 4000).split(" ")
        for half in range(2):
            rnd = random.Random(2 * pair + half)
            own = [w if rnd.random() < 0.9 else prose(9000 + rnd.randrange(9999), 1, 4000) for w in words]
            rnd.shuffle(own)
            rows.append((pair + half * size, " ".join(own), "en", "a"))
    out = packing.pack(table(spark, rows), tokenizer("byte_bpe_50k.json"), window=64, shard=20).collect()
    shard = {r.doc_id: r.sequence_id >> packing.SEQUENCES for r in out}
    together = sum(shard[p] == shard[p + size] for p in range(size // 2))
    assert len(set(shard.values())) >= size // 40
    assert together >= 0.5 * size // 2


def test_weights_count_every_text(spark):
    """Rare words of 9,000 texts have the weights of all of them, not of some."""
    path = tokenizer("byte_bpe_50k.json")
    encoder = packing.PieceEncoder.of(path)
    texts = [f"common {prose(i % 50, 1, 4000)} {i}" for i in range(9000)]
    df = np.zeros(encoder.tokenizer.get_vocab_size())
    for text in texts:
        df[np.unique(encoder.encode(text))] += 1
    rows = spark.createDataFrame([(i, i, encoder.encode(t).tobytes()) for i, t in enumerate(texts)], "doc_id long, row_hash long, ids binary").repartition(5)
    got = packing._weights(rows, path)
    want = np.log1p((len(texts) - df + 0.5) / (df + 0.5)) ** 2
    assert np.allclose(got, want[: len(got)], rtol=1e-5) and not df[len(got) :].any()


def test_one_key_is_split(spark):
    """Equal texts have one key and still fill several shards of bounded size."""
    rows = [(i, "the same words", "en", "a") for i in range(300)]
    out = packing.pack(table(spark, rows), tokenizer("byte_bpe_50k.json"), window=64, shard=20).collect()
    shards = {}
    for r in out:
        shards.setdefault(r.sequence_id >> packing.SEQUENCES, set()).add(r.doc_id)
    assert sum(map(len, shards.values())) == 300 and max(map(len, shards.values())) <= 80


def test_a_task_packs_in_one_worker_without_an_encoder(spark, capsys, monkeypatch):
    """After the shuffle one Python step deals and packs; steps that do not encode know the layout of the ids without the tokenizer."""
    path = tokenizer("byte_bpe_50k.json")
    out = packing.pack(table(spark, [(i, prose(i, 40), "en", "a") for i in range(60)]), path, window=64, shard=20)
    out.explain()
    plan = capsys.readouterr().out
    assert plan[: plan.index("Exchange rangepartitioning")].count("MapInArrow") == 1
    encoder = packing.PieceEncoder.of(path)
    coded = [encoder.encode(prose(i, 40)) for i in range(30)]
    monkeypatch.setattr(packing.PieceEncoder, "of", None)
    batch = pa.RecordBatch.from_arrays([pa.array([ids.tobytes() for ids in coded], pa.binary())], names=["ids"])
    counts = {t: n for b in packing._counted(path)([batch]) for t, n in zip(b.column("token").to_pylist(), b.column("n").to_pylist())}
    assert counts.pop(-1) == 30 and sum(counts.values()) == sum(len(set(ids.tolist())) for ids in coded)
    assert packing._layout(path) == (encoder.dtype, encoder.tokenizer.get_vocab_size())
    assert packing._layout(tokenizer("word_bpe_49k.json"))[0] == "<u2"
