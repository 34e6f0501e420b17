import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import item, items
from newsweft.operators import stories
from newsweft.operators.health import backoff_factor, health_by_kind, health_totals, poll_plan, source_status
from newsweft.plans import queries as q
from newsweft.plans.reports import probe, source_table
from newsweft.rules import book
from newsweft.schemas import RAW_PAYLOADS
from newsweft.sources.store import TableStore, load_snapshot, restore_items, save_snapshot
from newsweft.streaming.engine import Monitor, compose_redirects, payload_stream, source_health_stream

T0 = dt.datetime(2026, 9, 18, 12, 0, 0)


def hours(n):
    return dt.timedelta(hours=n)


def rss(*entries):
    body = "".join(f"<item><title>{t}</title><link>{u}</link><pubDate>{at:%a, %d %b %Y %H:%M:%S} GMT</pubDate></item>" for t, u, at in entries)
    return f"<rss><channel>{body}</channel></rss>"


FIRST = [
    ("bbc", T0, 200, 5, None, rss(("Massive earthquake jolts northern Chile desert", "https://n/1", T0), ("Kherson shelled by artillery overnight", "https://n/2", T0))),
    ("npr", T0, 503, 9, None, None),
]
SECOND = [
    ("cbs", T0 + hours(1), 200, 5, None, rss(("Earthquake jolts northern Chile, roofs damaged", "https://n/3", T0 + hours(1)),
                                             ("Massive earthquake jolts northern Chile desert", "https://n/1", T0),
                                             ("Genocide warning as troops enter Greece", "https://n/4", T0 + hours(1)))),
    ("npr", T0 + hours(1), 200, 9, None, rss(("Kherson ferry sunk by missile strike", "https://n/5", T0 + hours(1)))),
]


def land(spark, rows, folder):
    spark.createDataFrame(rows, RAW_PAYLOADS).coalesce(1).write.mode("append").parquet(folder)


def assignment(monitor):
    return {r["url"]: r["story_id"] for r in monitor.items().collect()}


@pytest.fixture(scope="module")
def streamed(spark, classifier, tmp_path_factory):
    base = tmp_path_factory.mktemp("stream")
    landing = str(base / "landing")
    monitor = Monitor.create(spark, str(base / "state"), book.sources(spark), classifier)
    for rows in (FIRST, SECOND):
        land(spark, rows, landing)
        query = monitor.start(payload_stream(spark, landing), str(base / "checkpoint"))
        query.awaitTermination(180)
        assert query.exception() is None
    return monitor


def test_stream_assigns_across_batches(streamed):
    got = assignment(streamed)
    assert set(got) == {f"https://n/{i}" for i in range(1, 6)}
    assert got["https://n/1"] == got["https://n/3"]
    assert got["https://n/2"] == got["https://n/5"] == "ukraine-war"
    assert streamed.store.versions() == [0, 1]


def test_stream_alerts_once_per_story(streamed):
    alerts = {r["title"]: r["reason"] for r in streamed.store.read_all("alerts").collect()}
    assert alerts == {"Kherson shelled by artillery overnight": "Europe", "Genocide warning as troops enter Greece": "Critical"}


def test_stream_fetch_log(streamed):
    log = {(r["source_id"], r["fetched"]): (r["ok"], r["n_items"], r["error"]) for r in streamed.store.read_all("fetch_log").collect()}
    assert log[("npr", T0)] == (False, 0, "HTTP 503") and log[("npr", T0 + hours(1))] == (True, 1, None)
    assert log[("cbs", T0 + hours(1))] == (True, 3, None)


def test_repeating_a_batch_changes_nothing(spark, streamed):
    before = assignment(streamed)
    streamed.process(spark.createDataFrame(SECOND, RAW_PAYLOADS), 1)
    assert assignment(streamed) == before and streamed.store.versions() == [0, 1]


def test_batch_equals_stream(spark, classifier, streamed, tmp_path):
    monitor = Monitor.create(spark, str(tmp_path / "state"), book.sources(spark), classifier)
    monitor.process(spark.createDataFrame(FIRST + SECOND, RAW_PAYLOADS), 0)
    assert assignment(monitor) == assignment(streamed)
    table = {r["story_id"]: (r["n_items"], r["severity"]) for r in stories.story_table(monitor.state(), monitor.anchors).collect()}
    other = {r["story_id"]: (r["n_items"], r["severity"]) for r in stories.story_table(streamed.state(), streamed.anchors).collect()}
    assert table == other


def test_reports_over_the_stored_state(spark, streamed):
    now = F.lit(T0 + hours(2))
    assigned = streamed.items()
    view = q.story_view(streamed.state(), assigned, streamed.anchors, now)
    report = probe(streamed.store.read_all("fetch_log"), streamed.sources, assigned, assigned, view, now)
    assert report["funnel"].collect()[0].asDict() == {"seen": 5, "kept": 5, "stories": 3, "located": 3, "videos": 0}
    assert {r["source_id"]: r["state"] for r in report["sources"].collect()} == {"bbc": "ok", "npr": "ok", "cbs": "ok"}
    assert [(r["kind"], r["ok"], r["total"]) for r in report["kinds"].collect()] == [("News", 3, 3)]
    assert report["stories"].count() == 3 and report["timeline"].count() >= 1


def test_redirects_compose(spark):
    old = spark.createDataFrame([("a", "b"), ("x", "y")], "story_id string, target_id string")
    new = spark.createDataFrame([("b", "c")], "story_id string, target_id string")
    assert {tuple(r) for r in compose_redirects(old, new).collect()} == {("a", "c"), ("x", "y"), ("b", "c")}


def test_uncommitted_and_damaged_versions_are_skipped(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert store.latest() is None and store.read_all("t") is None
    store.save(0, {"t": spark.range(3)})
    store.write(1, {"t": spark.range(9)})
    assert store.versions() == [0] and store.read_all("t").count() == 3
    store.commit(1, ["t"])
    store.save(2, {"t": spark.range(1)})
    for f in (tmp_path / "t" / "version=2").glob("*.parquet"):
        f.write_bytes(b"broken")
    assert store.readable(["t"]) == 1 and store.read(1, "t").count() == 9


def test_snapshot_round_trip(spark, tmp_path):
    rows = [(f"s{i}", item(f"i{i}{k:03d}", "A headline", at=T0 - hours(i) - dt.timedelta(minutes=k))) for i in range(3) for k in range(260 if i == 0 else 2)]
    rows.append(("stale", item("z", "old", at=T0 - hours(1500))))
    a = items(spark, [r[1] for r in rows]).join(spark.createDataFrame([(r[1][0], r[0]) for r in rows], "id string, story_id string"), "id")
    table = stories.story_table(stories.build(a), stories.anchor_stories(spark))
    store = TableStore(spark, str(tmp_path))
    assert load_snapshot(store, F.lit(T0)) is None
    save_snapshot(store, 0, table, a, F.lit(T0))
    loaded, kept = load_snapshot(store, F.lit(T0))
    assert {r["story_id"] for r in loaded.collect()} == {"s0", "s1", "s2"}
    assert {r["story_id"]: r["count"] for r in kept.groupBy("story_id").count().collect()} == {"s0": 250, "s1": 2, "s2": 2}
    assert kept.filter("id = 'i0255'").count() == 0
    # Much later everything is stale.
    assert load_snapshot(store, F.lit(T0 + hours(2000)))[0].count() == 0
    merged = restore_items(kept, a.filter("story_id = 's1'"))
    assert merged.count() == 254


LOG = "source_id string, fetched timestamp, ok boolean, n_items bigint, latency_ms bigint, error string"


def test_source_health(spark):
    rows = [
        ("bbc", T0, True, 5, 10, None), ("bbc", T0 + hours(1), True, 7, 20, None),
        ("npr", T0, True, 4, 10, None), ("npr", T0 + hours(1), False, 0, 30, "HTTP 500"),
        ("usgs", T0, False, 0, 1, "timeout"), ("usgs", T0 + hours(1), False, 0, 1, "HTTP 503"),
    ]
    log = spark.createDataFrame(rows, LOG)
    status = {r["source_id"]: r.asDict() for r in source_status(log).collect()}
    assert (status["bbc"]["items_total"], status["bbc"]["last_items"], status["bbc"]["healthy"]) == (12, 7, True)
    assert (status["npr"]["last_items"], status["npr"]["last_error"], status["npr"]["last_ok"], status["npr"]["healthy"]) == (0, "HTTP 500", T0, False)
    sources = book.sources(spark)
    plan = {r["source_id"]: (r["factor"], r["wait_s"], r["next_poll_at"]) for r in poll_plan(source_status(log), sources).collect()}
    assert plan["bbc"][:2] == (1, 240) and plan["npr"][0] == 2 and plan["usgs"] == (8, 1440, T0 + hours(1) + dt.timedelta(seconds=1440))
    assert health_totals(source_status(log)).collect()[0].asDict() == {"ok": 1, "total": 3}
    assert {(r["kind"], r["ok"], r["total"]) for r in health_by_kind(source_status(log), sources).collect()} == {("News", 1, 2), ("Alert", 0, 1)}
    shown = {r["source_id"]: (r["state"], r["age"], r["failed"]) for r in source_table(log, sources, F.lit(T0 + hours(3))).collect()}
    assert shown == {"bbc": ("ok", "2h", "0/2"), "npr": ("HTTP 500", "3h", "1/2"), "usgs": ("HTTP 503", "—", "2/2")}
    df = spark.createDataFrame([("e", 81, 100), ("e", 80, 100), ("e", 50, 100), (None, 99, 100), ("e", 0, 0)], "e string, f int, n int")
    assert [r[0] for r in df.select(backoff_factor(F.col("e"), F.col("f"), F.col("n"))).collect()] == [8, 4, 2, 1, 2]


def test_health_stream(spark, tmp_path):
    spark.createDataFrame([("bbc", T0, True, 5, 10, None), ("bbc", T0 + hours(1), False, 0, 1, "HTTP 500")], LOG).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
    query = source_health_stream(stream).writeStream.outputMode("update").format("memory").queryName("health").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    row = spark.sql("SELECT * FROM health").collect()[0]
    assert (row["fetches"], row["failures"], row["items_total"], row["last_ok"]) == (2, 1, 5, T0)


def test_a_batch_writes_the_stories_it_touched(spark, classifier, tmp_path):
    monitor = Monitor.create(spark, str(tmp_path), book.sources(spark), classifier, maintain_every=3)
    monitor.process(spark.createDataFrame(FIRST, RAW_PAYLOADS), 0)
    monitor.process(spark.createDataFrame(SECOND, RAW_PAYLOADS), 1)
    touched = monitor.store.read(1, "items").select("story_id").distinct().count()
    assert monitor.store.read(1, "core_added").count() == touched
    assert monitor.store.latest(table="core") is None
    added = {tuple(r) for r in stories.story_table(monitor.state(), monitor.anchors).select("story_id", "n_items").collect()}
    monitor.process(spark.createDataFrame(SECOND, RAW_PAYLOADS), 2)  # repeats only, and the compaction
    assert monitor.store.latest(table="core") == 2 and monitor.store.read(2, "items").count() == 0
    whole = {tuple(r) for r in stories.story_table(monitor.state(), monitor.anchors).select("story_id", "n_items").collect()}
    assert added == whole
    known = monitor.known_ids(T0 + hours(2000), 3)
    assert {r["id"] for r in known.collect()} == {r["id"] for r in monitor.items().filter("anchor_id is not null").collect()}
