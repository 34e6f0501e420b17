"""The stored index of ids: what a lookup reads, and that it says what the item files say."""

import datetime as dt
import random

from pyspark.sql import functions as F

from helpers import item, items
from newsweft.functions.times import RETENTION_HOURS
from newsweft.rules import book
from newsweft.sources.seen import NEEDED, SeenIds
from newsweft.sources.store import TableStore
from newsweft.streaming.engine import Monitor

T0 = dt.datetime(2026, 9, 18, 12, 0, 0)
STORED = "id string, published timestamp, anchor_id string"


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


def leaves(frame, metric):
    frame.collect()
    found = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(found.apply(i).metrics().apply(metric).value() for i in range(found.size()))


def saved(spark, path, batches):
    store, seen = TableStore(spark, str(path)), SeenIds(TableStore(spark, str(path)), 64)
    for version, batch in enumerate(batches):
        table = spark.createDataFrame(batch, STORED)
        store.save(version, {"items": table, "seen": seen.rows(table)})
    return store, seen


def plain(batches, asked, since):
    return sorted({i for b in batches for i, at, anchor in b if i in asked and (at >= since - NEEDED or anchor)})


def test_lookups_equal_the_items(spark, tmp_path):
    rnd = random.Random(3)
    batches = [[(f"i{rnd.randrange(400)}", T0 + dt.timedelta(hours=24 * b - rnd.randrange(3000)), rnd.choice([None, None, "a"])) for _ in range(120)] for b in range(3)]
    store, seen = saved(spark, tmp_path, batches)
    asked = [f"i{k}" for k in range(0, 500, 3)]
    wanted = spark.createDataFrame([(i,) for i in [*asked, *asked[:5]]], "id string")
    for since in (T0, T0 + dt.timedelta(hours=900), T0 - dt.timedelta(hours=4000)):
        assert seen.covered(since) and ids(seen.lookup(wanted, since)) == plain(batches, asked, since)
    # A compaction, a batch behind it, and a payload that lands too late for what the compaction kept.
    newest = T0 + dt.timedelta(hours=200)
    more = spark.createDataFrame([("new", newest, None), ("i1", newest, None)], STORED)
    store.save(3, {"items": more, **seen.whole(more, newest, 3)})
    last = spark.createDataFrame([("last", newest, None)], STORED)
    store.save(4, {"items": last, "seen": seen.rows(last)})
    batches += [[("new", newest, None), ("i1", newest, None)], [("last", newest, None)]]
    wanted = wanted.union(spark.createDataFrame([("new",), ("last",), ("i1",)], "id string"))
    assert seen.versions() == [3, 4] and seen.versions(3) == [0, 1, 2]
    assert ids(seen.lookup(wanted, newest)) == plain(batches, [*asked, "new", "last", "i1"], newest)
    assert seen.covered(newest - NEEDED) and not seen.covered(newest - NEEDED - dt.timedelta(hours=1))
    store.save(5, {"items": last})  # a version from a program without the index
    assert not seen.covered(newest)
    redone = ids(seen.whole(last, newest, 6)["seen"].distinct())
    assert redone == sorted(i for i, in {(i, at, bool(anchor)): (i,) for b in batches for i, at, anchor in b if at >= newest - 2 * NEEDED or anchor}.values())


def test_a_batch_opens_no_more_buckets_than_it_has_ids(spark, tmp_path):
    batch = [(f"i{k}", T0, None) for k in range(2000)]
    _, seen = saved(spark, tmp_path, [batch])
    for asked in (["i1"], ["i1", "i2", "nothing"], [f"x{k}" for k in range(8)]):
        buckets = {r[0] for r in spark.createDataFrame([(i,) for i in asked], "id string").select(seen.bucket("id")).collect()}
        assert 1 <= leaves(seen.scan(sorted(buckets), T0), "numPartitions") <= len(asked)


def test_repeats_are_dropped_through_the_index(spark, classifier, tmp_path):
    monitor = Monitor.create(spark, str(tmp_path), book.sources(spark), classifier, maintain_every=2)
    given = [
        [item("a", "Harbour bridge collapse"), item("b", "Ferry strike market")],
        [item("a", "Harbour bridge collapse"), item("c", "Flood in the village")],  # compaction
        [item("b", "Ferry strike market"), item("c", "Flood in the village"), item("d", "Night blaze factory", at=T0 + dt.timedelta(hours=1))],
    ]
    for batch, rows in enumerate(given):
        table = items(spark, rows)
        if batch:
            known = set(ids(monitor.known_ids(T0, batch)))
            assert monitor.seen.covered(T0, batch)
            assert set(ids(monitor.repeated_ids(table, T0, batch))) == known & {r[0] for r in rows}
        monitor.process_items(table, batch)
    assert [ids(monitor.store.read(v, "items")) for v in range(3)] == [["a", "b"], ["c"], ["d"]]
    late = T0 - dt.timedelta(hours=3 * RETENTION_HOURS)
    assert not monitor.seen.covered(late, 3) and ids(monitor.repeated_ids(items(spark, given[0]), late, 3)) == ["a", "b", "c", "d"]
    assert monitor.items().filter(F.col("id").isNull()).count() == 0
