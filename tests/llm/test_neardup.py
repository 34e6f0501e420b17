"""The pipeline's near-duplicate stage against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from brute import odd_rows, prose, table

from newsweft.llm import neardup


def shingles(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(words)} - {b""} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def linked(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if linked(sets[a], sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [r for i, r in enumerate(rows) if r[0] is None or r[0] == least[find(i)]]


def near_copies():
    """Edits on both sides of 0.8, chains, a crowd, and a phrase that unrelated texts share."""
    rnd = random.Random(4)
    rows = odd_rows()
    for f in range(8):
        base = prose(900 + f, 100 + 40 * f, 3000).split(" ")
        for i in range(10):
            words = list(base)
            for _ in range(rnd.randrange(1, 9)):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(9999)}"
            rows.append((1000 * (f + 1) + i, " ".join(words[rnd.randrange(8) :]), "en", "s"))
    chain = prose(77, 120, 3000).split(" ")
    for i in range(12):
        chain = chain[4:] + [f"c{i}{j}" for j in range(4)]
        rows.append((20_000 - i, " ".join(chain), "en", "s"))
    crowd = prose(78, 150, 3000).split(" ")
    for i in range(60):
        rows.append((30_000 + i, " ".join([*crowd[:75], f"x{i}", *crowd[76:]]), "en", "s"))
    phrase = prose(79, 12, 3000)
    rows += [(40_000 + i, f"{phrase} {prose(5000 + i, 30, 3000)} {phrase}", "en", "s") for i in range(40)]
    return rows


@pytest.mark.parametrize("sample", [1, 20, 8192])
def test_stage_keeps_one_of_each_group(spark, sample):
    rows = near_copies()
    frame = table(spark, rows)
    out = neardup.keep_first(frame, sample)
    assert out.columns == frame.columns
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(str((r[0], r[1])) for r in kept(rows))


def test_simhash_finds_candidates(spark):
    """All texts within two bits of another are in a candidate pair, and the stage asks SimHash for them."""
    rows = [r for r in near_copies() if r[1] and r[1].split()]
    sets = {neardup._key(s): s for s in (neardup.shingle_set(r[1]) for r in rows)}
    prints = spark.createDataFrame([(0, 0, k, len(s), neardup.fingerprint(s), []) for k, s in sets.items()], neardup.PRINT)
    bits = {k: neardup.fingerprint(s) for k, s in sets.items()}
    close = {k for k in bits for j in bits if j != k and ((bits[j] ^ bits[k]) & ((1 << 64) - 1)).bit_count() <= 2 and 5 * min(len(sets[j]), len(sets[k])) >= 4 * max(len(sets[j]), len(sets[k]))}
    pairs = neardup.similar(prints).collect()
    assert len(close) > 10 and close == {k for r in pairs for k in (r.a, r.b)}
    asked = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(neardup.simhash, "links", lambda prints, links=neardup.simhash.links: asked.append(prints) or links(prints))
        neardup.keep_first(table(spark, rows[:40])).count()
    assert asked


def test_pipeline_stage_drops_near_copies(spark):
    text = prose(1, 100, 3000).split(" ")
    rows = [(1, " ".join(text), "en", "a"), (2, " ".join([*text[:50], "other", *text[51:]]), "en", "b"), (3, prose(2, 100, 3000), "en", "a")]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()) == [1, 3]


def test_marks_bound_the_difference_from_below():
    rnd = random.Random(9)
    pool = [int.from_bytes(rnd.randbytes(8), "little", signed=True) for _ in range(5000)]
    for size in (0, 1, 7, 200, 3000):
        one = np.unique(np.array(rnd.sample(pool, size), dtype=np.int64))
        for changed in (0, 1, 40, 900):
            other = np.unique(np.array([*one[changed:], *rnd.sample(pool, min(changed, size))], dtype=np.int64))
            differ = sum(int(x).bit_count() for x in (neardup.marks(one) ^ neardup.marks(other)).view(np.uint64))
            assert differ <= len(np.setxor1d(one, other))
            assert len(neardup.marks(other)) == neardup.MARKS // 64


def test_a_crowd_of_texts_below_the_threshold_makes_few_pairs(spark):
    """All share rare phrases, no two are similar: the join leaves none of the n * n / 2 pairs."""
    phrase = prose(11, 40, 3000)
    rows = [(i, f"{phrase} {prose(7000 + i, 60, 3000)}", "en", "s") for i in range(300)]
    frame = table(spark, rows)
    assert neardup.keep_first(frame, 1).count() == 300
    pairs = []
    plain = neardup._possible
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(neardup, "_possible", lambda met: pairs.append(met) or plain(met))
        neardup.keep_first(frame, 1).count()
    assert pairs[-1].count() < 300


def test_no_rows(spark):
    assert neardup.keep_first(table(spark, [])).count() == 0


def test_prints_leave_in_small_batches():
    """However many texts come at once, the sets of a slice only are held."""
    count = 3 * neardup.SLICE + 5
    columns = [pa.array(range(count), pa.int64()), pa.array(range(count), pa.int64()), pa.array([prose(i, 12) for i in range(count)])]
    out = list(neardup._sets([pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "text"])]))
    assert max(b.num_rows for b in out) == neardup.SLICE
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(count))
    assert [k for b in out for k in b.column("key").to_pylist()] == [neardup._key(neardup.shingle_set(t)) for t in columns[2].to_pylist()]
