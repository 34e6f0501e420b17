"""The stored index of words: what a lookup reads, and assignment through it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import item, items
from newsweft.operators import stories
from newsweft.operators.assign import assign
from newsweft.operators.similarity import story_sizes
from newsweft.rules import book
from newsweft.session import cut_lineage
from newsweft.sources.postings import POSTINGS, PostingIndex
from newsweft.sources.store import TableStore
from newsweft.streaming.engine import Monitor

T0 = dt.datetime(2026, 9, 18, 12, 0, 0)
NO_TOKENS = "story_id string, token string, n bigint"


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def saved(spark, path, batches, buckets=64):
    """An index of batches of (story, token, n), and all of them as one table."""
    store = TableStore(spark, str(path))
    index = PostingIndex(store, buckets)
    for version, batch in enumerate(batches):
        tokens = spark.createDataFrame(batch, NO_TOKENS)
        found = index.lookup(tokens, version)
        store.save(version, index.added(tokens, cut_lineage(found.postings)))
    whole = spark.createDataFrame([r for b in batches for r in b], NO_TOKENS).groupBy("story_id", "token").agg(F.sum("n").alias("n"))
    return store, index, whole


def words(spark, *tokens):
    return spark.createDataFrame([(t,) for t in tokens], "token string")


def partitions_read(frame):
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return [leaves.apply(i).metrics().apply("numPartitions").value() for i in range(leaves.size())]


@pytest.fixture(scope="module")
def batches():
    rnd = random.Random(4)
    made = []
    for _ in range(3):
        pairs = {(f"s{rnd.randrange(30)}", f"w{min(rnd.randrange(400), rnd.randrange(400))}") for _ in range(300)}
        made.append([(s, w, rnd.randint(1, 3)) for s, w in sorted(pairs)])
    return made


def test_lookups_equal_the_whole_table(spark, tmp_path, batches):
    store, index, whole = saved(spark, tmp_path, batches)
    for asked in (("w0", "w1", "w17"), ("w399", "none"), ()):
        found = index.lookup(words(spark, *asked))
        wanted = whole.filter(F.col("token").isin(list(asked)))
        assert rows(found.postings.select("story_id", "token", "n")) == rows(wanted)
        assert rows(found.frequencies.select("token", "df")) == rows(wanted.groupBy("token").count())
        assert rows(found.sizes.select("story_id", "n_tokens", "n_total")) == rows(story_sizes(whole).select("story_id", "n_tokens", "n_total"))


def test_a_batch_opens_no_more_partitions_than_it_has_words(spark, tmp_path, batches):
    store, index, _ = saved(spark, tmp_path, batches[:1])
    for asked in (("w1",), ("w1", "w2", "w3"), tuple(f"w{i}" for i in range(10))):
        assert 1 <= partitions_read(index.scan("postings", POSTINGS, words(spark, *asked)))[0] <= len(asked)
    folders = spark.read.parquet(f"{tmp_path}/postings").select("bucket").distinct().count()
    assert folders > 40


def test_lookups_start_from_the_last_compaction(spark, tmp_path, batches):
    store, index, whole = saved(spark, tmp_path, batches)
    store.save(3, index.whole(whole.filter("story_id <> 's1'")))
    tokens = spark.createDataFrame([("s1", "w1", 1), ("s2", "w1", 4)], NO_TOKENS)
    store.save(4, index.added(tokens, cut_lineage(index.lookup(tokens, 4).postings)))
    assert index.versions() == [3, 4] and index.versions(4) == [3] and index.versions(3) == [0, 1, 2]
    both = whole.filter("story_id <> 's1'").unionByName(tokens).groupBy("story_id", "token").agg(F.sum("n").alias("n"))
    assert rows(index.lookup(words(spark, "w1")).postings.select("story_id", "token", "n")) == rows(both.filter("token = 'w1'"))
    assert rows(index.sizes().select("story_id", "n_tokens", "n_total")) == rows(story_sizes(both).select("story_id", "n_tokens", "n_total"))


def made_items(rnd, batch):
    names = "harbour bridge collapse ferry strike market flood village rescue minister troops border night blaze factory".split()
    out = []
    for i in range(14):
        at = T0 + dt.timedelta(hours=batch, minutes=i)
        place = rnd.choice([None, None, ("Lyon", 45.76, 4.84), ("Lima", -12.05, -77.04)])
        anchor = rnd.choice([None, None, None, "ukraine-war"])
        key = rnd.choice([None, None, None, None, "usgs-1"])
        out.append(item(f"{batch}-{i}", " ".join(rnd.sample(names, rnd.randint(2, 6))), rnd.choice(["Other", "Diplomacy", "NaturalDisaster"]), at, place, anchor=anchor, event_key=key))
    return out


def test_batches_through_the_index_equal_those_through_the_state(spark, classifier, tmp_path):
    rnd, hot_df = random.Random(8), 2
    monitor = Monitor.create(spark, str(tmp_path), book.sources(spark), classifier, maintain_every=2, hot_df=hot_df)
    for batch in range(3):
        table = cut_lineage(items(spark, made_items(rnd, batch)))
        before = monitor.state(batch)
        want = assign(table, before, monitor.anchors, F.col("fetched"), monitor.known_ids(T0, batch), hot_df)
        monitor.process_items(table, batch)
        got = monitor.store.read(batch, "items")
        columns = ["id", "story_id", "tier", F.round("score", 6).alias("score")]
        assert rows(got.select(*columns).fillna(-1.0)) == rows(want.items.select(*columns).fillna(-1.0))
    state = monitor.state()
    assert rows(monitor.index.sizes().select("story_id", "n_tokens", "n_total")) == rows(story_sizes(state.tokens).select("story_id", "n_tokens", "n_total"))
    assert {r["tier"] for r in monitor.items().select("tier").distinct().collect()} == {"event", "anchor", "similar", "new"}


def test_stored_postings_of_the_given_state(spark, tmp_path):
    state = stories.empty_state(spark)
    index = PostingIndex(TableStore(spark, str(tmp_path)))
    found = index.lookup(words(spark, "a"))
    assert found.postings.count() == found.frequencies.count() == found.sizes.count() == 0
    assert state.tokens.columns == ["story_id", "token", "n"]
