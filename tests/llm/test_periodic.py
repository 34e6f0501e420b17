"""Periodic runs against a plain search over all periods."""

import random
import re
import time

from newsweft.llm import periodic
from newsweft.llm.queries import planted_period

from llm import brute


def plain_runs(words, shortest=6, exponent=4):
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            run = words[i : i + length]
            smaller = any(run[g:] == run[: length - g] for g in range(1, q))
            if length >= max(shortest, exponent * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def mixed(rnd):
    words = []
    while len(words) < rnd.randint(0, 80):
        if rnd.random() < 0.4:
            words.append(rnd.choice("abc"))
        else:
            unit = [rnd.choice("abcd"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(1, 5))]
            words += (unit * rnd.randint(1, 7))[: rnd.randint(1, 30)]
    return words


def test_blocks_of_texts_at_all_thresholds():
    rnd = random.Random(3)
    for _ in range(400):
        block = [mixed(rnd) for _ in range(rnd.randint(1, 4))]
        for shortest, exponent in ((6, 4), (4, 2), (2, 2), (9, 3), (2, 5)):
            assert periodic.runs_of(block, shortest, exponent) == [plain_runs(w, shortest, exponent) for w in block]


def test_long_texts_take_near_linear_time():
    started = time.time()
    for period in (1, 7, 5000):
        words = [str(i) for i in range(period)] * (300_000 // period)
        assert periodic.runs_of([words]) == [[(0, len(words), period)]]
    assert time.time() - started < 60


def test_positions_stay_ordered_beyond_one_chunk():
    numbers = list(range(20_000))
    random.Random(1).shuffle(numbers)
    held, plain = periodic.Positions(numbers[0]), [numbers[0]]
    for x in numbers[1:]:
        below, above = held.add(x)
        if len(plain) < 500:
            plain = sorted(plain + [x])
            i = plain.index(x)
            assert (below, above) == (plain[i - 1] if i else -1, plain[i + 1] if i + 1 < len(plain) else -1)
    assert list(held) == sorted(numbers) and held.size == len(numbers)


def test_rows_through_spark(spark):
    rnd = random.Random(5)
    rows = brute.odd_rows() + [(100 + i, " \n ".join(mixed(rnd)), "en", "a") for i in range(60)] + [(100, "a b " * 30, None, None)] * 3
    docs = brute.table(spark, rows).withColumnRenamed("value", "runs").withColumnRenamed("home", "collapsed").withColumnRenamed("fp", "n_words")
    found = periodic.find_runs(docs.repartition(3), planted_period, block=500).collect()
    want = []
    for name, text, *_ in rows:
        words = planted_period(name, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        runs = plain_runs(words)
        want.append((name, len(words), runs, plain_collapse(words, runs)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(bool(r[2]) for r in want) > 20
    assert periodic.find_runs(docs.limit(0)).collect() == []
