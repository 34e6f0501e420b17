"""Near duplicates, repeated passages, search and the pipeline against plain models."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from brute import best, classes, odd_rows, prose, repeats, simhash, table

from newsweft.llm import repeats as repeat_ops
from newsweft.llm import search, simhash as near
from newsweft.llm.components import components
from newsweft.llm.queries import QUERIES, op2_simhash, op4_repeats, op5_search


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def edited(text, seed, edits=3):
    rnd = random.Random(seed)
    words = text.split(" ")
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(99)}"
    return " ".join(words)


def families():
    rows = odd_rows()
    for f in range(6):
        base = "\n".join(prose(f * 50 + j, 40, 3000) for j in range(4))
        rows += [(1000 * (f + 1) + i, base if i % 4 == 0 else edited(base, f * 100 + i, 1 + i % 3), "en", f"s{i % 6}") for i in range(8)]
    return rows


@pytest.fixture()
def write(spark, tmp_path):
    def run(rows):
        table(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        labels = [(r[0], 1, 0) for r in rows if r[0] is not None]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return run


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op2(spark, write):
    rows = families()
    got = sorted({(str(r.doc_id), r.fingerprint, r.component_id) for r in op2_simhash(spark, write(rows)).collect()})
    prints = [(i, simhash(t)) for i, t, *_ in rows]
    want = sorted({(str(i), f"{p:016x}", c) for (i, p), c in zip(prints, classes(prints))})
    assert got == want


@pytest.mark.parametrize("dense", [0, 5, 2000])
def test_links_of_crowded_fingerprints(spark, dense):
    """Balls around a few centres, all links found whichever way a fingerprint goes."""
    rnd = random.Random(dense)
    prints = set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        prints.add(centre)
        for _ in range(60):
            value = centre
            for _ in range(rnd.randrange(0, 5)):
                value ^= 1 << rnd.randrange(64)
            prints.add(value)
    prints |= {rnd.getrandbits(64) for _ in range(100)}
    values = sorted(prints)
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    roots = components(near.links(frame, dense)).collect()
    number = {signed(v): i for i, v in enumerate(values)}
    group = {r.node: r.root for r in roots}
    got = {}
    for v in number:
        got.setdefault(group.get(v, v), set()).add(number[v])
    want = {}
    for i, c in enumerate(classes(list(enumerate(values)))):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_thresholds_are_optimal():
    rnd = np.random.default_rng(2)
    counts = rnd.integers(1, 5000, (300, 3)).astype(float)
    chosen = near.allocate(counts, [22, 21, 21], 0.5)
    assert (chosen.sum(axis=1) == near.RADIUS - near.PARTS + 1).all()

    def cost(row, levels):
        own = lambda i, t: 0 if t < 0 else row[i] + 1 + [0, w := [22, 21, 21][i], w + w * (w - 1) / 2][t] * 1.5
        return sum(own(i, t) for i, t in enumerate(levels))

    every = [(a, b, -a - b) for a in range(-1, 3) for b in range(-1, 3) if -1 <= -a - b <= 2]
    for row, levels in zip(counts, chosen):
        assert cost(row, levels) == pytest.approx(min(cost(row, e) for e in every))


def test_keep_first(spark):
    rows = families()
    frame = table(spark, rows)
    kept = near.keep_first(frame)
    assert kept.columns == frame.columns
    prints = [(i, simhash(t)) for i, t, *_ in rows]
    want = [r for r, c in zip(rows, classes(prints)) if r[0] is None or r[0] == c]
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str((r[0], r[1])) for r in want)


def boundary_rows():
    """Passages of 49, 50, 51 and more bytes in other surroundings, self-repeats, zero bytes."""
    rnd = random.Random(9)
    text = lambda n, letters="abcdefgh ": "".join(rnd.choice(letters) for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 90, 400)] + ["é" * 40, "\0" * 60, "ab" * 100]
    rows = [(i, text(rnd.randrange(0, 300)) + rnd.choice(passages) + text(rnd.randrange(0, 300)) + rnd.choice(passages), "en", "a") for i in range(150)]
    rows += [(500 + i, text(200, "ab"), "en", "a") for i in range(10)]
    return rows


@pytest.mark.parametrize("home, chunk, run, hot", [(20_000, 3_000, 7, 3), (20_000, 500, 4096, 0), (8_000_000, 1_000_000, 4096, 256)])
def test_repeats(spark, home, chunk, run, hot):
    """The steps on one machine, with homes, chunks and runs of several sizes."""
    rows = families() + boundary_rows()
    got = run_steps([r[:2] for r in rows], home, chunk, run, hot)
    assert sorted(map(str, got)) == sorted(map(str, repeats([r[:2] for r in rows])))


@pytest.mark.parametrize("home, chunk, run, hot", [(20_000, 3_000, 7, 3), (20_000, 500, 4096, 0), (8_000_000, 1_000_000, 4096, 256)])
def test_repeats_by_anchors(monkeypatch, home, chunk, run, hot):
    """As above, with the step that tells anchors; the anchors of copies are not sent, those of new phrases in a few bytes."""
    import pyarrow as pa
    import zstandard

    for name, value in (("CHUNK", chunk), ("RUN", run), ("HOT", hot)):
        monkeypatch.setattr(repeat_ops, name, value)
    rows = [r[:2] for r in families() + boundary_rows()]
    rows += [(None, "n" * 30 + prose(7, 40)), (None, prose(7, 40)), (901, prose(7, 40)), (901, prose(7, 40) + " again"), (902, "m" + prose(7, 40))]
    rows += [(1000 + i, prose(9, 3_000)) for i in range(20)]
    homes = max(1, sum(len((t or "").encode()) for _, t in rows) // home)
    packer = zstandard.ZstdCompressor()
    schema = pa.schema([("home", pa.int32()), ("doc_id", pa.int64()), ("data", pa.binary())])
    data = [((i or 0) % homes, i, packer.compress((t or "").encode())) for i, t in rows]
    docs = pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*data), schema)], schema=schema)
    groups = lambda t, k: [t.filter(pa.compute.equal(t.column(k), v)) for v in t.column(k).unique()]
    both = lambda back: [(d, back.filter(pa.compute.equal(back.column("home"), d.column("home")[0]))) for d in groups(docs, "home")]
    sent = pa.concat_tables([repeat_ops._parsed(homes)(d) for d in groups(docs, "home")])
    phrases = pa.concat_tables([repeat_ops._compared(b) for b in groups(sent, "bucket")])
    anchors = pa.concat_tables([repeat_ops._anchored(homes)(d, b) for d, b in both(phrases)])
    known = pa.concat_tables([phrases, *[repeat_ops._compared(b) for b in groups(anchors, "bucket")]])
    asked = pa.concat_tables([repeat_ops._asked(homes, anchored=True)(d, b) for d, b in both(known)])
    told = pa.concat_tables([known, *[repeat_ops._decided(b) for b in groups(asked, "bucket")]])
    out = pa.concat_tables([repeat_ops._without_bytes(d, b) for d, b in both(told)])
    got = list(zip(*[out.column(c).to_pylist() for c in out.column_names]))
    assert sorted(map(str, got)) == sorted(map(str, repeats(rows)))
    # an entry is some four bytes, and homes that hold copies only have none to tell
    held = sum(len(repeat_ops._opened(d, repeat_ops.ANCHOR)[0]) for d in anchors.column("data").to_pylist())
    assert repeat_ops.ANCHOR.itemsize <= 10 and held <= 0.15 * sum(len((t or "").encode()) for _, t in {t: (i, t) for i, t in rows}.values())


def run_steps(rows, home, chunk, run, hot):
    """remove_repeats with the shuffles done by hand, so that its constants can be small."""
    import pyarrow as pa
    import zstandard

    kept = {n: getattr(repeat_ops, n) for n in ("CHUNK", "RUN", "HOT")}
    for name, value in (("CHUNK", chunk), ("RUN", run), ("HOT", hot)):
        setattr(repeat_ops, name, value)
    try:
        homes = max(1, sum(len((t or "").encode()) for _, t in rows) // home)
        packer = zstandard.ZstdCompressor()
        data = [(hash(i) % homes, i, packer.compress((t or "").encode())) for i, t in rows]
        schema = pa.schema([("home", pa.int32()), ("doc_id", pa.int64()), ("data", pa.binary())])
        docs = pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*data), schema)], schema=schema)
        groups = lambda t, k: [t.filter(pa.compute.equal(t.column(k), v)) for v in t.column(k).unique()]
        both = lambda back: [(d, back.filter(pa.compute.equal(back.column("home"), d.column("home")[0]))) for d in groups(docs, "home")]
        sent = pa.concat_tables([repeat_ops._parsed(homes)(d) for d in groups(docs, "home")])
        known = pa.concat_tables([repeat_ops._compared(b) for b in groups(sent, "bucket")])
        asked = pa.concat_tables([repeat_ops._asked(homes)(d, b) for d, b in both(known)])
        told = pa.concat_tables([known, *[repeat_ops._decided(b) for b in groups(asked, "bucket")]])
        out = pa.concat_tables([repeat_ops._without_bytes(d, b) for d, b in both(told)])
        return list(zip(*[out.column(c).to_pylist() for c in out.column_names]))
    finally:
        for name, value in kept.items():
            setattr(repeat_ops, name, value)


def test_op4(spark, write):
    rows = families() + boundary_rows()
    got = op4_repeats(spark, write(rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, repeats([r[:2] for r in rows])))


def test_repeats_with_bytes(spark):
    rows = [(1, "x" * 10 + "y" * 60, "en", "a"), (2, "z" * 60 + "y" * 55, "en", "a")]
    got = {r.doc_id: bytes(r.kept) for r in repeat_ops.remove_repeats(table(spark, rows), with_bytes=True).collect()}
    assert got == {1: b"x" * 10 + b"y" * 60, 2: b"z" * 60}


@pytest.mark.parametrize("shard", [2_000, 48_000_000])
def test_top_k(spark, shard):
    rows = families()
    frame = table(spark, rows)
    asked = [(r[0], r[1]) for r in rows if r[0] is not None and (r[0] % 7 == 0 or r[0] < 20)]
    got = search.top_k(frame, spark.createDataFrame(asked, "query_id long, text string"), 5, shard=shard * 10, block=20).collect()
    want = {}
    for q, rank, i, score in best([r[:2] for r in rows], sorted(set(asked), key=str), 5):
        want[q, rank] = (i, score)
    assert {(r.query_id, r["rank"]) for r in got} == set(want)
    for r in got:
        i, score = want[r.query_id, r["rank"]]
        assert r.score == pytest.approx(score, abs=2e-6)
        near_tie = [j for (q, _), (j, s) in want.items() if q == r.query_id and abs(s - score) < 2e-6]
        assert r.doc_id == i or r.doc_id in near_tie or len(near_tie) > 1


def test_search_rows_grow_with_queries_only(spark):
    """Many shards and blocks: a lane returns k rows a query at most, and nothing is written again for a shard or block."""
    rows = [(i, f"alpha beta w{i % 7} v{i % 11} u{i}", "en", "a") for i in range(600)]
    asked = spark.createDataFrame([(r[0], r[1]) for r in rows if r[0] % 20 == 0], "query_id long, text string")
    frame = table(spark, rows).repartition(3)
    lanes = search.lane_best(frame, asked, 5, shard=200, block=4)
    assert lanes.count() <= 30 * 5 * search.LANES
    plan = search.top_k(frame, asked, 5, shard=200, block=4)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "CoGroups" not in plan


def test_shards_keep_their_postings():
    """A row of a shard gives back the postings it was made of, whatever the sizes of its numbers."""
    texts = ["", "a b a", "b " * 300 + "c", "", "naïve a"]
    batch = pa.table({"doc_id": pa.array([5, 4, 3, 2, 70_000], pa.int64()), "text": texts}).to_batches()
    made = list(search._shard_rows(10**6)(iter(batch)))
    assert [m.num_rows for m in made] == [1] and made[0]["words"].to_pylist() == [3 + 301 + 2]
    want = search.Postings.of([5, 4, 3, 2, 70_000], [search._terms(t) for t in texts])
    for row in search._rows_of(made[0]):
        for name, value in search._postings(row)._asdict().items():
            assert value.tolist() == getattr(want, name).tolist(), name
    empty = list(search._shard_rows(10**6)(iter(pa.table({"doc_id": pa.array([1], pa.int64()), "text": [""]}).to_batches())))
    assert [search._postings(r).doc.tolist() for r in search._rows_of(empty[0])] == [[]]


def test_words_of_ascii_texts():
    """The faster way for ASCII texts gives the terms of the expression."""
    from collections import Counter

    import xxhash

    text = "".join(map(chr, range(128))) + " A_b1\x0bC-d\x1cE\x00f aa AA"
    for some in (text, text + " É é"):
        want = Counter(xxhash.xxh3_64_intdigest(w) for w in re.findall(r"\w+", some.lower()))
        key, tf = search._terms(some)
        assert dict(zip(key.view(np.uint64).tolist(), tf.tolist())) == want


@pytest.mark.parametrize("block, dense", [(4, 16), (32, 16), (8, 2)])
def test_block_max_index(block, dense, monkeypatch):
    """Random texts: the k best are those of scoring everything, whatever is kept as rows."""
    monkeypatch.setattr(search, "DENSE", dense)
    rnd = np.random.default_rng(block)
    docs = []
    for _ in range(300):
        keys, tf = np.unique(rnd.zipf(1.3, 60).clip(0, 400), return_counts=True)
        docs.append((keys, tf))
    wanted = np.arange(0, 401, 2)
    index = search.BlockMaxIndex(list(range(300)), list(docs), wanted, 60.0, block=block)
    for _ in range(40):
        terms = np.unique(rnd.integers(0, len(wanted), 12))
        weights = rnd.random(len(terms)) * 5
        scores = np.zeros(300)
        for i, (keys, tf) in enumerate(docs):
            for t, w in zip(terms, weights):
                n = int(tf[keys == wanted[t]].sum())
                scores[i] += w * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * int(tf.sum()) / 60.0)) if n else 0
        want = sorted((-round(x, 6), i) for i, x in enumerate(scores) if x > 0)[:7]
        ids, found = index.search(terms, weights, 7)
        assert [(i, pytest.approx(-s, abs=2e-6)) for s, i in want] == list(zip(ids.tolist(), found.tolist()))


def test_pruning_leaves_blocks_unscored(monkeypatch):
    """A query that one block answers does not score the others."""
    docs = [(np.array([1, 2, 100 + i // 8]), np.array([1, 1, 1])) for i in range(800)]
    wanted = np.array([1, 2, *range(100, 200)])
    index = search.BlockMaxIndex(list(range(800)), docs, wanted, 3.0, block=8)
    scored = []
    real = np.round
    monkeypatch.setattr(np, "round", lambda x, d: scored.append(len(x)) or real(x, d))
    ids, _ = index.search(np.array([0, 1, 2]), np.array([0.01, 0.01, 9.0]), 8)
    assert sorted(ids) == list(range(8)) and sum(scored) < 200


def test_few_documents_are_scored_exactly(monkeypatch):
    """Texts with scores side by side: no block can be left out, and yet only those near the k best are scored in double precision."""
    rnd = np.random.default_rng(5)
    docs = []
    for _ in range(800):
        keys, tf = np.unique(rnd.zipf(1.2, 200).clip(0, 900), return_counts=True)
        docs.append((keys, tf))
    wanted = np.arange(901)
    scored = []
    real = np.round
    monkeypatch.setattr(np, "round", lambda x, d: scored.append(len(x)) or real(x, d))
    index = search.BlockMaxIndex(list(range(800)), docs, wanted, 200.0, block=100)
    terms, weights = docs[17][0], 1.0 + rnd.random(len(docs[17][0]))
    ids, scores = index.search(terms, weights, 5)
    assert sum(scored) < 100
    impact = lambda tf, size: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / 200.0))
    exact = [sum(w * impact(dict(zip(*d)).get(t, 0), d[1].sum()) for t, w in zip(terms, weights)) for d in docs]
    assert ids.tolist() == sorted(range(800), key=lambda i: (-round(exact[i], 6), i))[:5] and ids[0] == 17
    assert scores.tolist() == pytest.approx([exact[i] for i in ids], abs=2e-6)


def test_block_of_queries_keeps_its_terms(monkeypatch):
    """The row of a block gives back terms and weights of each query, queries with the same common terms side by side, and the k best of several shards."""
    asked = {7: {3: 2, 5: 1, 900: 300}, 8: {3: 1}, 9: {4: 1, 6: 1}, 10: {3: 1, 5: 2}}
    df = {3: 40, 4: 2, 5: 9, 6: 1, 900: 3}
    rows = [(0, q, t, tf, df[t]) for q, terms in asked.items() for t, tf in terms.items()]
    table_ = pa.table(dict(zip(("block", "query_id", "term", "tf", "n"), map(list, zip(*reversed(rows))))))
    made = search._block_row(100.0)(table_).to_batches()[0]
    block = search._Block(next(search._rows_of(made)), 2)
    got = {q: dict(zip(block.wanted[block.terms[a:b]].tolist(), block.weights[a:b])) for q, a, b in zip(block.names.tolist(), block.edges, block.edges[1:])}
    assert got == {q: {t: pytest.approx(tf * np.log1p((100 - df[t] + 0.5) / (df[t] + 0.5))) for t, tf in terms.items()} for q, terms in asked.items()}
    assert block.names.tolist() in ([9, 8, 10, 7], [9, 8, 7, 10])
    monkeypatch.setattr(search, "BATCH", 3)
    for docs in ([(1, {3: 1, 4: 1}), (2, {900: 1})], [(3, {3: 1, 4: 1}), (0, {3: 5, 4: 1})]):
        arrays = [tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(d.items()))) for _, d in docs]
        block.search(search.Postings.of([i for i, _ in docs], arrays), 2.0)
    best_ = {}
    for q, i in zip(*(block.rows().column(c).to_pylist() for c in ("query_id", "doc_id"))):
        best_.setdefault(q, []).append(i)
    assert best_ == {7: [2, 0], 8: [0, 1], 9: [1, 3], 10: [0, 1]}


def test_empty_tables(spark, write):
    sf_dir = write([])
    for query in (op2_simhash, op4_repeats, op5_search):
        assert query(spark, sf_dir).count() == 0


def test_pipeline(spark, write):
    import corpus_pipeline
    from brute import counts

    rows = families()
    sf_dir = write(rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and corpus_pipeline.ORACLE_SQL is None
    columns, kept = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        if kept is None:
            kept = sorted(str((r.doc_id, r.text)) for r in docs.collect())
            passing = [r for r in rows if (c := counts(r[1]))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
            assert kept == sorted(str((r[0], r[1])) for r in passing)
    left = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == left


def test_every_query_is_here():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
