import datetime as dt
import math
import random

from pyspark.sql import functions as F

from helpers import item, items
from newsweft.operators import stories
from newsweft.operators.alerts import first_report_alerts
from newsweft.plans import queries as q

T0 = dt.datetime(2026, 9, 18, 12, 0, 0)


def hours(n):
    return dt.timedelta(hours=n)


def assigned(spark, rows):
    """rows: (story_id, item tuple)."""
    ids = spark.createDataFrame([(r[1][0], r[0]) for r in rows], "id string, story_id string")
    return items(spark, [r[1] for r in rows]).join(ids, "id")


def random_rows(seed, n=120, story_count=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + dt.timedelta(minutes=rng.randint(0, 400))
        fetched = T0 + dt.timedelta(minutes=rng.randint(0, 5) * 100)
        place = rng.choice([None, ("A", 10, 10), ("B", 20, 20), ("C", 30, 30)])
        rows.append((f"s{rng.randrange(story_count)}", item(f"i{i:03d}", f"title number {i} {rng.choice('abcdef') * 4}", rng.choice(["Other", "Health"]), at,
                    place, rng.choice(["Article", "Alert", "Video"]), severity=rng.randint(0, 4), source=rng.choice("xyz"), fetched=fetched)))
    return rows


def plain_title(rows):
    """Titles by the sequential rule: an alert newer than everything before renames."""
    state = {}
    for story, it in sorted(rows, key=lambda r: (r[1][7], r[1][6], r[1][0])):
        if story not in state:
            state[story] = [it[3], it[6]]
            continue
        if it[6] > state[story][1]:
            state[story][1] = it[6]
            if it[1] == "Alert":
                state[story][0] = it[3]
    return {s: t for s, (t, _) in state.items()}


def summary(spark, state):
    table = stories.story_table(state, stories.anchor_stories(spark))
    return {r["story_id"]: r.asDict(True) for r in table.collect()}


def test_titles_follow_the_sequential_rule(spark):
    for seed in (1, 2, 3):
        rows = random_rows(seed)
        got = summary(spark, stories.build(assigned(spark, rows)))
        assert {s: r["title"] for s, r in got.items()} == plain_title(rows)


def test_batches_merge_to_the_same_state(spark):
    rows = sorted(random_rows(5), key=lambda r: (r[1][7], r[1][6], r[1][0]))
    # A later batch arrives after the earlier one, whatever its items' times.
    whole = stories.build(assigned(spark, rows))
    parts = stories.merge(stories.merge(stories.build(assigned(spark, rows[:40])), stories.build(assigned(spark, rows[40:41]))), stories.build(assigned(spark, rows[41:])))
    for name in ("core", "tokens", "places", "sources"):
        a, b = getattr(whole, name), getattr(parts, name)
        columns = [c for c in a.columns if c not in ("retitled_at", "retitle")]
        left, right = a.select(*columns), b.select(*columns)
        assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0, name
    assert {s: r["title"] for s, r in summary(spark, parts).items()} == plain_title(rows)


def test_founder_severity_times_and_counts(spark):
    rows = [
        ("s", item("b", "second", "Health", T0 + hours(1), kind="Video", severity=3, source="y")),
        ("s", item("a", "first", "Economy", T0, severity=1, source="x")),
        ("s", item("c", "older", "Economy", T0 - hours(2), fetched=T0 + hours(3), severity=0, source="x")),
    ]
    r = summary(spark, stories.build(assigned(spark, rows)))["s"]
    assert (r["title"], r["category"], r["severity"], r["n_items"], r["n_videos"], r["n_sources"]) == ("first", "Economy", 3, 3, 1, 2)
    assert (r["first_seen"], r["last_update"]) == (T0 - hours(2), T0 + hours(1))


def test_focus_first_point_newest_radius(spark):
    first = item("a", "x", at=T0, place=("P", 1, 1))
    second = item("b", "x", at=T0 + hours(1), place=("P", 9, 9))
    second = second[:10] + ({"name": "P", "point": {"lat": 9.0, "lon": 9.0}, "radius_deg": 7.0, "bbox": [1.0, 2.0, 3.0, 4.0]},) + second[11:]
    rows = [("s", first), ("s", second), ("s", item("c", "x", at=T0 + hours(2), place=("Q", 5, 5))), ("t", item("d", "x")),
            ("u", item("e", "x", at=T0, place=("Z", 1, 1))), ("u", item("f", "x", at=T0, place=("Y", 2, 2)))]
    got = summary(spark, stories.build(assigned(spark, rows)))
    f = got["s"]["focus"]
    assert (f["name"], f["point"], f["radius_deg"], f["bbox"]) == ("P", {"lat": 1.0, "lon": 1.0}, 7.0, [1.0, 2.0, 3.0, 4.0])
    assert got["t"]["focus"] is None
    assert got["u"]["focus"]["name"] == "Y"


def test_anchor_is_pinned_home_and_keeps_its_title(spark):
    rows = [("ukraine-war", item("a", "Kyiv news", "UkraineWar", T0, ("Kyiv", 50.45, 30.52), "Alert")),
            ("ukraine-war", item("b", "More", "UkraineWar", T0 + hours(1), ("Kyiv", 50.45, 30.52), "Alert"))]
    anchors = stories.anchor_stories(spark)
    state = stories.build(assigned(spark, rows))
    table = {r["story_id"]: r.asDict(True) for r in stories.story_table(state, anchors, keep_empty_anchors=True).collect()}
    assert len(table) == 17 and table["ukraine-war"]["focus"]["name"] == "Ukraine" and table["ukraine-war"]["title"] == "Russia-Ukraine war"
    assert table["haiti"]["n_items"] == 0 and table["haiti"]["focus"]["name"] == "Haiti"
    epoch = F.lit(T0 + hours(5))
    moved = stories.story_table(state, anchors, anchor_epoch=epoch).collect()[0]
    assert moved["last_update"] == T0 + hours(5) and moved["first_seen"] == T0


def test_heat_matches_the_worked_example(spark):
    rows = [("s", item("a", "x", at=T0, source="p")), ("s", item("b", "x", at=T0 - hours(6), source="q")), ("s", item("c", "x", at=T0 - hours(12), source="p"))]
    a = assigned(spark, rows)
    view = q.story_view(stories.build(a), a, stories.anchor_stories(spark), F.lit(T0)).collect()[0]
    assert abs(view["heat"] - 5.185450) < 1e-6


def test_heat_counts_sixty_items_and_whole_minutes(spark):
    rows = [("s", item(f"{i:03d}", "x", at=T0 - dt.timedelta(seconds=90 * i), source=f"src{i}", severity=0)) for i in range(80)]
    a = assigned(spark, rows)
    view = q.story_view(stories.build(a), a, stories.anchor_stories(spark), F.lit(T0)).collect()[0]
    want = sum(1 / (1 + (90 * i // 60) / 60 / 6) for i in range(60)) * math.sqrt(80)
    assert abs(view["heat"] - want) < 1e-9


def test_live_items_is_cut_before_the_shuffle(spark):
    rows = [("s", item(f"{i:02d}", "x", at=T0 + hours(i))) for i in range(10)]
    kept = stories.live_items(assigned(spark, rows), 3)
    assert sorted(r["id"] for r in kept.collect()) == ["07", "08", "09"]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


EUROPE, CHILE = ("Greece", 39.07, 21.82), ("Chile", -35.68, -71.54)


def test_alert_rules(spark):
    rows = [
        ("e2", item("a", "elevated in Europe", place=EUROPE, severity=2)),
        ("e1", item("b", "watch in Europe", place=EUROPE, severity=1)),
        ("c4", item("c", "critical in Chile", place=CHILE, severity=4)),
        ("c3", item("d", "severe in Chile", place=CHILE, severity=3)),
        ("n4", item("e", "critical nowhere", severity=4)),
        ("n3", item("f", "severe nowhere", severity=3)),
        ("dr", item("g", "drought", place=EUROPE, severity=4, event_key="gdacs-DR-1")),
        ("fl", item("h", "flood", place=EUROPE, severity=3, event_key="gdacs-FL-1")),
        # Only the first report of a story alerts, however severe the next one is.
        ("q", item("i", "quiet", severity=0)), ("q", item("j", "loud", severity=4, at=T0 + hours(1))),
        ("ukraine-war", item("k", "anchor's first", place=EUROPE, severity=2, anchor="ukraine-war")),
        ("old", item("l", "known story", severity=4)),
    ]
    before = spark.createDataFrame([("old",)], "story_id string")
    got = {r["story_id"]: r for r in first_report_alerts(assigned(spark, rows), before).collect()}
    assert {s: r["reason"] for s, r in got.items()} == {"e2": "Europe", "c4": "Critical", "n4": "Critical", "fl": "Europe", "ukraine-war": "Europe"}
    assert got["n4"]["place"] == "unlocated" and got["e2"]["place"] == "Greece"


def test_filters_search_and_ranks(spark):
    rows = [
        ("a", item("a1", "Flooding in Nepal", "NaturalDisaster", T0, ("Nepal", 28.39, 84.12), severity=3)),
        ("b", item("b1", "Central bank raises rates", "Economy", T0 - hours(1), severity=0)),
        ("c", item("c1", "Quake in Greece", "Earthquake", T0 - hours(2), EUROPE, severity=4)),
        ("old", item("d1", "Old story", "Economy", T0 - hours(1441), severity=4)),
    ]
    a = assigned(spark, rows)
    now = F.lit(T0)
    view = q.story_view(stories.build(a), a, stories.anchor_stories(spark), now)

    def ids(df):
        return [r["story_id"] for r in df.collect()]

    assert ids(q.ranked(q.visible(view, now))) == ["a", "b", "c"]
    assert ids(q.ranked(q.visible(view, now), "severity")) == ["c", "a", "b"]
    assert ids(q.ranked(q.visible(view, now), "heat", 1)) == ["a"]  # 3.00 against 2.89
    assert ids(q.visible(view, now, category="Economy")) == ["b"]
    assert sorted(ids(q.visible(view, now, min_severity=3))) == ["a", "c"]
    assert ids(q.visible(view, now, zone="Europe")) == ["c"]
    assert ids(q.visible(view, now, needle="nepal", assigned=a)) == ["a"]
    assert ids(q.visible(view, now, needle="GREECE", assigned=a)) == ["c"]
    assert q.position_of(q.visible(view, now), "c").collect()[0]["position"] == 3
    assert q.worst_severity(view, now).collect()[0]["worst"] == 4
    header = q.overview(view, None, now).collect()[0]
    assert (header["active"], header["severe"], header["items"], header["last_age"]) == (3, 2, 4, "0s")
    assert [(r["category"], r["n"]) for r in q.category_counts(q.visible(view, now)).collect()] == [("Earthquake", 1), ("NaturalDisaster", 1), ("Economy", 1)]
    assert [r["id"] for r in q.ticker(a, now, 2).collect()] == ["a1", "b1"]
    assert {r["story_id"] for r in q.markers(q.visible(view, now)).collect()} == {"a", "c"}


def test_timeline(spark):
    rows = [("s", item("a", "one", at=T0, kind="Video")), ("s", item("b", "two", at=T0 + hours(20), severity=3)), ("s", item("c", "three", at=T0 + hours(1)))]
    a = assigned(spark, rows)
    got = q.timeline(a, "s", F.lit(T0 + hours(24))).collect()
    assert [(r["id"], r["age"], r["severity"]) for r in got] == [("b", "4h", "SEVERE"), ("c", "23h", None), ("a", "1d", None)]
    assert [r["id"] for r in q.timeline(a, "s", F.lit(T0), kind="Video").collect()] == ["a"]
    assert {(str(r["day"]), r["first_id"], r["n_items"]) for r in q.timeline_days(a).collect()} == {("2026-09-18", "c", 2), ("2026-09-19", "b", 1)}


def test_state_without_titles_differs_in_titles_only(spark):
    a = assigned(spark, random_rows(8, 60))
    full, plain = summary(spark, stories.build(a)), summary(spark, stories.build(a, titles=False))
    assert {s: {k: v for k, v in r.items() if k != "title"} for s, r in full.items()} == {
        s: {k: v for k, v in r.items() if k != "title"} for s, r in plain.items()
    }
