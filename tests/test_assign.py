import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import item, items, score
from newsweft.operators import merge, stories
from newsweft.operators.assign import assign, backfill
from newsweft.operators.leaders import members_of
from newsweft.operators.similarity import best_story, scored_pairs

T0 = dt.datetime(2026, 9, 18, 12, 0, 0)
CHILE, JAPAN = ("Chile", -35.0, -71.0), ("Japan", 36.0, 138.0)


def hours(n):
    return dt.timedelta(hours=n)


def run(spark, rows, state=None, known=None, now=T0, hot_df=2000):
    return assign(items(spark, rows), state or stories.empty_state(spark), stories.anchor_stories(spark), F.lit(now), known, hot_df)


def groups(result):
    by = {}
    for r in result.items.select("id", "story_id").collect():
        by.setdefault(r["story_id"], set()).add(r["id"])
    return sorted(map(sorted, by.values()))


def test_reference_scenarios_in_one_batch(spark):
    rows = [
        # similar headlines join, unrelated ones do not
        item("a1", "Massive earthquake jolts northern Chile desert", "Earthquake", T0),
        item("a2", "Earthquake jolts northern Chile, roofs damaged", "Earthquake", T0 + hours(1)),
        item("b1", "Interest rates raised once more by central bank", "Economy", T0),
        # same words on opposite sides of the planet stay apart
        item("c1", "Sudden tremor rattles harbour towns", "Earthquake", T0, CHILE),
        item("c2", "Sudden tremor rattles harbour towns today", "Earthquake", T0, JAPAN),
        # registry events: one key is one story
        item("d1", "M 4.6 - 31 km W of Talca", "Earthquake", T0, event_key="usgs-a"),
        item("d2", "M 4.7 - 28 km W of Talca", "Earthquake", T0, event_key="usgs-b"),
        item("e1", "Orange alert for tropical cyclone", "NaturalDisaster", T0, event_key="gdacs-TC-1"),
        item("e2", "Red alert for tropical cyclone", "NaturalDisaster", T0, event_key="gdacs-TC-1"),
        # anchors
        item("f1", "Kharkiv hit by Russian drone strike before dawn", "UkraineWar", T0, anchor="ukraine-war"),
        item("f2", "Zelensky visits the front line", "UkraineWar", T0, anchor="ukraine-war"),
        # repeats of one id count once
        item("a1", "Massive earthquake jolts northern Chile desert", "Earthquake", T0, fetched=T0 + hours(2)),
        # too old, unless anchored; an event key does not save it
        item("g1", "Wildfire spreads over empty steppe", "NaturalDisaster", T0 - hours(1446)),
        item("g2", "Old war report", "UkraineWar", T0 - hours(1446), anchor="ukraine-war"),
        item("g3", "Old hazard", "NaturalDisaster", T0 - hours(1446), event_key="eonet-1"),
        item("g4", "Just inside whole hours limit", "Other", T0 - hours(1440) - dt.timedelta(minutes=59)),
        # an anchored item with an event key goes to the event
        item("h1", "Quake near Kharkiv", "Earthquake", T0, event_key="usgs-k", anchor="ukraine-war"),
        # an unknown anchor is a free item
        item("i1", "Zebra crossing painted purple", "Other", T0, anchor="no-such-anchor"),
        # no words: each founds its own story
        item("j1", "", "Other", T0), item("j2", "of the", "Other", T0),
    ]
    result = run(spark, rows)
    assert groups(result) == sorted([["a1", "a2"], ["b1"], ["c1"], ["c2"], ["d1"], ["d2"], ["e1", "e2"], ["f1", "f2", "g2"], ["g4"], ["h1"], ["i1"], ["j1"], ["j2"]])
    tiers = {r["id"]: r["tier"] for r in result.items.collect()}
    assert (tiers["a1"], tiers["a2"], tiers["e1"], tiers["f1"], tiers["h1"]) == ("new", "similar", "event", "anchor", "event")


def test_known_ids_are_not_stored_twice(spark):
    first = run(spark, [item("a", "Flooding displaces thousands", "NaturalDisaster", T0)])
    again = run(spark, [item("a", "Flooding displaces thousands", "NaturalDisaster", T0)], first.state, first.items.select("id"))
    assert again.items.count() == 0 and again.state.core.collect()[0]["n_items"] == 1


def test_free_items_may_join_anchors_but_never_events(spark):
    first = run(spark, [
        item("a", "Front line village shelled overnight near river", "UkraineWar", T0, anchor="ukraine-war"),
        item("b", "Bridge collapse blocks harbour traffic", "Other", T0, event_key="eonet-9"),
    ])
    second = run(spark, [
        item("c", "Village shelled overnight near river crossing", "UkraineWar", T0 + hours(1)),
        item("d", "Bridge collapse blocks harbour traffic", "Other", T0 + hours(1)),
    ], first.state, first.items.select("id"))
    got = {r["id"]: (r["story_id"], r["tier"]) for r in second.items.collect()}
    assert got["c"] == ("ukraine-war", "similar") and got["d"] == ("s-d", "new")


WORDS = [f"word{i}" for i in range(14)]


def random_items(seed, n=60, prefix="i", start=T0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        title = " ".join(rng.sample(WORDS, rng.randint(1, 6)))
        place = rng.choice([None, CHILE, JAPAN, ("Near Chile", -36.0, -72.0), ("Off Chile", -38.5, -72.0)])
        rows.append(item(f"{prefix}{k:03d}", title, rng.choice(["Earthquake", "Other", "Health", "NaturalDisaster"]), start + hours(rng.randint(0, 90)), place))
    return rows


def as_model(row):
    place = row[10]
    return {"id": row[0], "tokens": row[11], "category": row[8], "published": row[6], "point": place and (place["point"]["lat"], place["point"]["lon"])}


def inputs(spark, rows):
    df = items(spark, rows)
    return df.select("id", "tokens", "category", F.col("place.point.lat").alias("lat"), F.col("place.point.lon").alias("lon"), "published")


@pytest.mark.parametrize("hot_df", [2000, 3])
def test_scored_pairs_equal_all_pairs(spark, hot_df):
    old, new = random_items(1, 50, "o"), random_items(2, 60, "n", T0 + hours(20))
    rng = random.Random(9)
    homes = {r[0]: f"st{rng.randrange(25)}" for r in old}
    joined = items(spark, old).join(spark.createDataFrame(list(homes.items()), "id string, story_id string"), "id")
    state = stories.build(joined)
    table = stories.story_table(state, stories.anchor_stories(spark))
    profiles = table.select("story_id", "category", F.col("focus.point.lat").alias("lat"), F.col("focus.point.lon").alias("lon"), "last_update")
    counts = {}
    for r in state.tokens.collect():
        counts.setdefault(r["story_id"], {})[r["token"]] = r["n"]
    model = {
        r["story_id"]: {"counts": counts[r["story_id"]], "category": r["category"], "last_update": r["last_update"],
                        "point": None if r["lat"] is None else (r["lat"], r["lon"])}
        for r in profiles.collect()
    }
    want = {}
    for row in new:
        for story, s in model.items():
            value = round(score(as_model(row), s), 9)
            if value >= 0.34:
                want[(row[0], story)] = value
    pairs = scored_pairs(inputs(spark, new), profiles, state.tokens, hot_df=hot_df)
    got = {(r["id"], r["story_id"]): r["score"] for r in pairs.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)
    best = {r["id"]: r["score"] for r in best_story(pairs).collect()}
    assert best == {i: max(v for (j, _), v in got.items() if j == i) for i in {i for i, _ in got}}


def test_leader_rounds_equal_sequential_greedy(spark):
    rng = random.Random(3)
    for _ in range(2):
        n = 60
        edges = {(f"{b:03d}", f"{a:03d}") for a in range(n) for b in range(a + 1, n) if rng.random() < 0.06}
        founders, members = [], set()
        for v in (f"{i:03d}" for i in range(n)):
            if any((v, f) in edges for f in founders):
                members.add(v)
            else:
                founders.append(v)
        got = members_of(spark.createDataFrame(list(edges), "id string, earlier string"))
        assert {r["id"] for r in got.collect()} == members


def sequential(rows):
    """The batch contract for free items: founders frozen at their first item."""
    founders, home = [], {}
    seen = {}
    for row in sorted(rows, key=lambda r: (r[7], r[6], r[0])):
        m = as_model(row)
        key = (tuple(sorted(m["tokens"])), m["category"], m["point"], m["published"].date())
        if key in seen:
            home[row[0]] = seen[key]
            continue
        ranked = sorted(((-round(score(m, f), 9), -f["last_update"].timestamp(), f["id"]) for f in founders if round(score(m, f), 9) >= 0.34))
        if ranked:
            home[row[0]] = ranked[0][2]
        else:
            home[row[0]] = row[0]
            founders.append({"id": row[0], "counts": dict.fromkeys(m["tokens"], 1), "category": m["category"], "point": m["point"], "last_update": m["published"]})
        seen[key] = home[row[0]]
    return home


@pytest.mark.parametrize("hot_df", [2000, 0])
def test_one_batch_equals_sequential_founders(spark, hot_df):
    rows = random_items(11, 70) + random_items(12, 10, "z")
    rows += [r[:0] + (f"copy{i}",) + r[1:] for i, r in enumerate(rows[:15])]
    got = {r["id"]: r["story_id"][2:] for r in run(spark, rows, now=T0 + hours(100), hot_df=hot_df).items.collect()}
    assert got == sequential(rows)


def test_batches_of_one_follow_the_moving_centroid(spark):
    rows = sorted(random_items(21, 4), key=lambda r: (r[7], r[6], r[0]))
    model, home = {}, {}
    for row in rows:
        m = as_model(row)
        ranked = sorted((-round(score(m, s), 9), -s["last_update"].timestamp(), k) for k, s in model.items() if round(score(m, s), 9) >= 0.34)
        key = ranked[0][2] if ranked else f"s-{row[0]}"
        home[row[0]] = key
        s = model.setdefault(key, {"counts": {}, "category": m["category"], "last_update": m["published"], "places": {}, "point": None})
        for t in m["tokens"]:
            s["counts"][t] = s["counts"].get(t, 0) + 1
        s["last_update"] = max(s["last_update"], m["published"])
        if row[10]:
            n, _, first = s["places"].get(row[10]["name"], (0, None, m["point"]))
            s["places"][row[10]["name"]] = (n + 1, m["published"], first)
            name = min(s["places"], key=lambda p: (-s["places"][p][0], -s["places"][p][1].timestamp(), p))
            s["point"] = s["places"][name][2]
    state, got = stories.empty_state(spark), {}
    from newsweft.session import cut_lineage

    for row in rows:
        result = run(spark, [row], state, now=T0 + hours(100))
        state = result.state.map(cut_lineage)
        got.update({r["id"]: r["story_id"] for r in result.items.collect()})
    assert got == home


def test_backfill_carries_the_state(spark):
    rows = [
        item("a", "Massive earthquake jolts northern Chile desert", "Earthquake", T0),
        item("b", "Earthquake jolts northern Chile, roofs damaged", "Earthquake", T0 + hours(30)),
        item("a", "Massive earthquake jolts northern Chile desert", "Earthquake", T0, fetched=T0 + hours(31)),
        item("c", "Interest rates raised once more by central bank", "Economy", T0 + hours(31)),
    ]
    result = backfill(items(spark, rows), stories.empty_state(spark), stories.anchor_stories(spark))
    assert {r["id"]: r["story_id"] for r in result.items.collect()} == {"a": "s-a", "b": "s-a", "c": "s-c"}
    assert {r["story_id"]: r["n_items"] for r in result.state.core.collect()} == {"s-a": 2, "s-c": 1}


# ---------------------------------------------------------------- merging


def merged_model(table, words):
    """Pairs and components by brute force."""
    from helpers import PHYSICAL, distance

    pairs = {}
    for a in table:
        for b in table:
            if (a["first_seen"], a["story_id"]) < (b["first_seen"], b["story_id"]) and a["category"] == b["category"]:
                wa, wb = words.get(a["story_id"], {}), words.get(b["story_id"], {})
                total = sum(wa.values()) + sum(wb.values())
                overlap = 2 * sum(min(n, wb.get(t, 0)) for t, n in wa.items()) / max(total, 1)
                near = a["lat"] is None or b["lat"] is None or distance((a["lat"], a["lon"]), (b["lat"], b["lon"])) < (400 if a["category"] in PHYSICAL else 800)
                if overlap > 0.55 and near:
                    pairs[(a["story_id"], b["story_id"])] = overlap
    root = {r["story_id"]: r["story_id"] for r in table}
    rank = {r["story_id"]: (r["first_seen"], r["story_id"]) for r in table}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b], key=lambda s: rank[s])
            for s in (a, b):
                if root[s] != low:
                    root[s], changed = low, True
    return pairs, {s: r for s, r in root.items() if s != r}


@pytest.mark.parametrize("seed", [1])
def test_pairs_and_moves_equal_brute_force(spark, seed):
    rows = random_items(seed, 140)
    rng = random.Random(seed)
    homes = [(r[0], f"st{rng.randrange(90):02d}") for r in rows]
    joined = items(spark, rows).join(spark.createDataFrame(homes, "id string, story_id string"), "id")
    state = stories.build(joined)
    table = stories.story_table(state, stories.anchor_stories(spark))
    open_stories = merge.mergeable(table)
    words = {}
    for r in state.tokens.collect():
        words.setdefault(r["story_id"], {})[r["token"]] = r["n"]
    pairs, moves = merged_model([r.asDict() for r in open_stories.collect()], words)
    got = {(r["a"], r["b"]): r["overlap"] for r in merge.overlap_pairs(open_stories, state.tokens).collect()}
    assert got.keys() == pairs.keys() and all(abs(got[k] - pairs[k]) < 1e-9 for k in pairs)
    links = merge.overlap_classes(open_stories, state.tokens).collect()
    head = {r["b"]: r["a"] for r in links if r["link"] == "copy"}
    between = {(r["a"], r["b"]) for r in links if r["link"] == "pair"}
    assert all(head.get(a, a) == head.get(b, b) or tuple(sorted((head.get(a, a), head.get(b, b)))) in {tuple(sorted(p)) for p in between} for a, b in pairs)
    assert between <= pairs.keys()
    found = {r["story_id"]: r["target_id"] for r in merge.merge_moves(table, state.tokens).collect()}
    assert found == moves and len(moves) > 5


def test_equal_stories_give_members_not_pairs(spark):
    """10,000 equal stories: one row each, and no task joins them with each other."""
    n = 10_000
    open_stories = spark.range(n).select(
        F.format_string("s%05d", "id").alias("story_id"), F.lit("Other").alias("category"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
        (F.lit(T0) + F.make_dt_interval(secs=F.col("id"))).alias("first_seen"),
    )
    postings = open_stories.select("story_id", F.explode(F.array(*[F.lit(w) for w in "storm surge floods harbour".split()])).alias("token"), F.lit(2).cast("bigint").alias("n"))
    links = merge.overlap_classes(open_stories, postings)
    assert links.groupBy("link", "a").count().collect()[0].asDict() == {"link": "copy", "a": "s00000", "count": n - 1}
    moves = merge.fold_copies(open_stories, postings)
    assert moves.count() == n - 1 and moves.select("target_id").distinct().count() == 1


def test_maintenance_retires_and_folds(spark):
    rows = [
        ("s-a", item("a", "Storm surge floods harbour district homes", "NaturalDisaster", T0 - hours(5))),
        ("s-b", item("b", "Storm surge floods harbour district homes", "NaturalDisaster", T0, kind="Alert")),
        ("s-c", item("c", "Storm surge floods harbour district", "NaturalDisaster", T0 - hours(1), kind="Alert")),
        ("s-old", item("o", "Local bridge closed for repairs", "Other", T0 - hours(1441))),
        ("s-edge", item("e", "Museum reopens western wing", "Other", T0 - hours(1440))),
        ("ukraine-war", item("u", "Quiet day", "UkraineWar", T0 - hours(2000), anchor="ukraine-war")),
        ("ev-x", item("x", "Storm surge floods harbour district homes", "NaturalDisaster", T0, event_key="x")),
    ]
    joined = items(spark, [r[1] for r in rows]).join(spark.createDataFrame([(r[1][0], r[0]) for r in rows], "id string, story_id string"), "id")
    anchors = stories.anchor_stories(spark)
    state, moves = merge.maintain(stories.build(joined), anchors, F.lit(T0))
    assert {r["story_id"]: r["target_id"] for r in moves.collect()} == {"s-b": "s-a", "s-c": "s-a"}
    table = {r["story_id"]: r for r in stories.story_table(state, anchors).collect()}
    assert set(table) == {"s-a", "s-edge", "ukraine-war", "ev-x"}
    folded = table["s-a"]
    assert (folded["n_items"], folded["first_seen"], folded["last_update"]) == (3, T0 - hours(5), T0)
    assert folded["title"] == "Storm surge floods harbour district homes"
    counts = {r["token"]: r["n"] for r in state.tokens.filter("story_id = 's-a'").collect()}
    assert counts["storm"] == 3 and counts["homes"] == 2


def test_all_pairs_lists_the_pairs_of_copies(spark):
    """Three equal stories and one that shares most of their words: every pair is listed, older first."""
    words = {"s-c": "storm surge floods harbour", "s-a": "storm surge floods harbour", "s-b": "storm surge floods harbour", "s-d": "storm surge floods harbour homes", "s-e": "other words"}
    rows = [(s, "Other", None, None, T0 + hours(i)) for i, s in enumerate(words)]
    open_stories = spark.createDataFrame(rows, "story_id string, category string, lat double, lon double, first_seen timestamp")
    postings = spark.createDataFrame([(s, w, 1) for s, text in words.items() for w in text.split()], "story_id string, token string, n bigint")
    got = sorted((r["a"], r["b"], round(r["overlap"], 6)) for r in merge.all_pairs(open_stories, postings).collect())
    assert got == sorted([("s-c", "s-a", 1.0), ("s-c", "s-b", 1.0), ("s-a", "s-b", 1.0), *[(s, "s-d", 0.888889) for s in ("s-a", "s-b", "s-c")]])
    assert {r[:2] for r in got} == {(r["a"], r["b"]) for r in merge.overlap_pairs(open_stories, postings).collect()}
