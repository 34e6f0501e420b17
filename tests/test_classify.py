import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import column
from newsweft.functions import grading
from newsweft.functions.geo import zone_of
from newsweft.operators.classify import Classifier, with_terms
from newsweft.operators.dictmatch import TermPattern, keyword_hits
from newsweft.plans.reports import explain
from newsweft.operators import geojoin
from newsweft.rules import book, feeds, places, vocabulary
from newsweft.rules.book import RuleBook

GOLDEN = [
    # headline, noise, category, score, anchor, anchor score, severity, places, toll
    ("Kharkiv hit by Russian drone strike before dawn", False, "UkraineWar", 14, "ukraine-war", 4, "ELEV", ["Kharkiv", "Russia"], None),
    ("Zelensky visits front line near Pokrovsk", False, "UkraineWar", 11, "ukraine-war", 5, "ELEV", ["Pokrovsk"], None),
    ("Odesa wakes to explosions, Ukraine says attack repelled", False, "UkraineWar", 3, "ukraine-war", 4, "ELEV", ["Odesa", "Ukraine"], None),
    ("Massive earthquake jolts northern Chile desert", False, "Earthquake", 10, None, None, "SEVERE", ["Chile"], None),
    ("Interest rates raised once more by central bank", False, "Economy", 14, None, None, "INFO", [], None),
    ("Israel strikes southern Lebanon as Hezbollah vows response", False, "MiddleEast", 15, "lebanon-israel", 5, "ELEV", ["Southern Lebanon", "Israel", "Lebanon"], None),
    ("At least 12 killed as flood hits Nepal valley", False, "NaturalDisaster", 8, None, None, "SEVERE", ["Nepal"], "12 killed"),
    ("Couple rescued after deadline passes", False, "Other", 0, None, None, "SEVERE", [], None),
    ("Premier League clashes end in dramatic collapse", True, "ArmedConflict", 6, None, None, "SEVERE", [], None),
    ("Papua New Guinea volcano erupts, 1,200 displaced", False, "NaturalDisaster", 9, None, None, "ELEV", ["Papua New Guinea", "Guinea"], None),
    ("President and parliament agree budget", False, "Politics", 14, None, None, "INFO", [], None),
    ("Cholera outbreak in Sudan, 40 dead", False, "Health", 18, "sudan-war", 2, "SEVERE", ["Sudan"], "40 dead"),
    ("Ransomware attack hits U.S. hospital", False, "Cyber", 9, None, None, "ELEV", ["United States"], None),
    ("Massacre reported after overnight assault", False, "Other", 0, None, None, "CRIT", [], None),
]


def test_table_sizes():
    assert len(vocabulary.CATEGORY_RULES) == 43
    assert sum(len(k.split(";")) for _, _, k in vocabulary.CATEGORY_RULES) == 262
    assert len(vocabulary.ANCHORS) == 17
    assert sum(len(a[3].split(";")) for a in vocabulary.ANCHORS) == 81
    assert sum(len(a[4].split(";")) for a in vocabulary.ANCHORS) == 96
    assert len(vocabulary.NOISE_TERMS) == 53 and len(set(vocabulary.STOP_WORDS)) == 139
    assert len(places.GAZETTEER) == 229 and sum(len(g[1].split(";")) for g in places.GAZETTEER) == 559
    assert len(feeds.SOURCES) == 43 and sum(s[7] for s in feeds.SOURCES) == 6


def test_golden_headlines(spark, classifier):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, t string")
    rows = {r["i"]: r for r in explain(df, "t", classifier).collect()}
    for i, (_, noise, category, score, anchor, anchor_score, _, places, toll) in enumerate(GOLDEN):
        r = rows[i]
        assert (r["noise"], r["category"], r["score"], r["anchor"], r["anchor_score"]) == (noise, category, score, anchor, anchor_score)
        assert r["place"] == (places[0] if places else None)
        assert r["also"] == ", ".join(places[1:])
        assert r["toll"] == toll


def test_severity_uses_the_final_category(spark):
    final = {g[0]: (g[6], "UkraineWar" if g[4] == "ukraine-war" else g[2]) for g in GOLDEN}
    df = spark.createDataFrame([(t, c, s) for t, (s, c) in final.items()], "t string, c string, want string")
    got = df.select("t", "want", grading.severity_label(grading.severity_from_text(F.col("t"), F.col("c"))).alias("got")).collect()
    assert [r["t"] for r in got if r["got"] != r["want"]] == []


def test_word_boundaries_are_ascii_only(spark):
    pattern = TermPattern(["coup", "coup attempt", "u.s.", "m23"])
    given = ["a coup attempt", "coups", "coup_x", "écoup", "u.s.", "u.s.a", "the u.s., m23-held", "xcoup coup", ""]
    got = column(spark, given, pattern.matched)
    assert [sorted(g) for g in got] == [
        ["coup", "coup attempt"], [], ["coup"], ["coup"], ["u.s."], [], ["m23", "u.s."], ["coup"], [],
    ]


def test_category_ties_go_to_the_later_category_and_hits_are_capped(spark, classifier):
    given = ["army vote", "troops treaty", "inflation recession central bank interest rates", "zzz"]
    rows = column(spark, given, lambda c: classifier.category(classifier.positions(c)))
    assert [(r["category"], r["score"]) for r in rows] == [("Politics", 4), ("Politics", 5), ("Economy", 21), ("Other", 0)]


def test_anchor_ties_go_to_the_earlier_anchor(spark, classifier):
    given = ["gaza and hezbollah", "junta resistance", "mali junta", "nuclear"]
    rows = column(spark, given, lambda c: classifier.anchor(classifier.positions(c)))
    assert [r and r["anchor_id"] for r in rows] == ["gaza-war", "myanmar", "sahel", None]


def test_lookup_and_nearest(spark, classifier):
    got = column(spark, [" Kiev ", "BURMA", "u.s.", "Atlantis", None], lambda c: classifier.place_by_name(c)["name"])
    assert got == ["Kyiv", "Myanmar", "United States", None, None]
    df = spark.createDataFrame([(-35.0, -71.0), (49.9, 36.0)], "lat double, lon double")
    place = classifier.nearest_place(F.struct("lat", "lon"))
    assert [(r["p"]["name"], r["p"]["point"]["lat"], r["p"]["radius_deg"]) for r in df.select(place.alias("p")).collect()] == [
        ("Chile", -35.0, 2.0), ("Kharkiv", 49.9, 0.7)
    ]


def _brute(text, term):
    return re.search(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])", text.lower(), re.A) is not None


def test_pattern_and_join_agree_with_brute_force(spark):
    rng = random.Random(7)
    terms = ["red", "red sea", "sea", "red sea fleet", "a", "a-b", "b", "u.s", "fleet", "se"]
    pieces = ["red", "sea", "fleet", "a", "b", "u", "s", "se", "redsea", "é"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "  ", "-", ".", ", ", "_", ""]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    want = {(i, t) for i, x in enumerate(texts) for t in terms if _brute(x, t)}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    pattern = TermPattern(terms)
    by_pattern = {(r["i"], r["x"]) for r in df.select("i", F.explode(pattern.matched(F.col("t"))).alias("x")).collect()}
    dictionary = spark.createDataFrame([(t,) for t in terms], "term string")
    by_join = {(r["i"], r["term"]) for r in keyword_hits(df, "i", "t", dictionary).collect()}
    assert by_pattern == want
    assert by_join == want
    assert {(r["i"], r["term"]) for r in keyword_hits(df, "i", "t", dictionary, small=0).collect()} == want


def test_join_counts_overlapping_terms_and_keeps_every_dictionary_row(spark):
    df = spark.createDataFrame([(1, "Red sea, red SEA fleet; redsea red"), (2, ""), (3, None), (4, "sea" * 50_000 + " red sea")], "i int, t string")
    rows = [("red sea", 1), ("red sea", 2), ("red", 3), ("red sea fleet", 4), ("sea, red", 5), ("nothing", 6)]
    dictionary = spark.createDataFrame(rows, "term string, row int")
    want = {(1, "red sea", 1, 2, 0), (1, "red sea", 2, 2, 0), (1, "red", 3, 3, 0), (1, "red sea fleet", 4, 1, 2), (1, "sea, red", 5, 1, 1)}
    want |= {(4, "red sea", 1, 1, 1), (4, "red sea", 2, 1, 1), (4, "red", 3, 1, 1)}
    for small in (0, 200_000):
        assert {tuple(r) for r in keyword_hits(df, "i", "t", dictionary, small=small).collect()} == want


def test_join_ships_no_windows_with_a_small_dictionary(spark):
    df = spark.createDataFrame([(1, "red sea")], "i int, t string").repartition(2)
    dictionary = spark.createDataFrame([("red sea",)], "term string")
    plan = keyword_hits(df, "i", "t", dictionary)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 2


def test_matching_needs_no_shuffle(spark, classifier):
    df = with_terms(spark.range(10).select(F.col("id").cast("string").alias("t")), F.col("t"), classifier)
    plan = df.filter(~classifier.is_noise(F.col("_terms"))).select(classifier.category(F.col("_terms")).alias("c"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text
    assert text.count("regexp_extract_all") == 1


def test_rule_tables_can_be_replaced(spark):
    rules = spark.createDataFrame([(0, "Health", 5, "flu"), (0, "Health", 5, "cough"), (1, "Cyber", 6, "worm")], book.RULE_SCHEMA)
    noise = spark.createDataFrame([("spam",)], "term string")
    gaz = spark.createDataFrame([(5, "Ys", ["ys", "kêr-is"], 48.0, -4.5, 1.0, 3)], book.GAZETTEER_SCHEMA)
    own = Classifier(RuleBook.from_tables(rules=rules, noise=noise, gazetteer=gaz))
    rows = column(spark, ["flu and cough in Ys", "worm spam"], lambda c: F.struct(own.category(own.positions(c)).alias("c"), own.is_noise(own.positions(c)).alias("n"), own.best_place(own.positions(c))["name"].alias("p")))
    assert [(r["c"]["category"], r["c"]["score"], r["n"], r["p"]) for r in rows] == [("Health", 10, False, "Ys"), ("Cyber", 6, True, None)]
    with pytest.raises(ValueError):
        book.small_rows(spark.range(30), "ids", limit=20)


def test_zones_of_the_gazetteer(spark):
    zone = zone_of(F.col("lat"), F.col("lon"))
    got = {r["z"]: r["count"] for r in book.gazetteer(spark).groupBy(zone.alias("z")).count().collect()}
    assert got == {"Europe": 64, "Africa": 42, "Middle East": 41, "Asia": 37, "Americas": 36, "Oceania": 7, "Other": 2}


def test_place_joins_equal_the_row_forms(spark, classifier):
    rng = random.Random(11)
    aliases = [a for g in places.GAZETTEER for a in g[1].split(";")]
    texts = [" and ".join(rng.choice(aliases + ["nothing", "x"]) for _ in range(rng.randint(0, 5))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    row = {r["id"]: r["p"] for r in df.select("id", classifier.places(classifier.positions(F.col("t")))["name"].alias("p")).collect()}
    join = {}
    for r in geojoin.ranked_places_join(df, "id", "t", book.gazetteer(spark)).orderBy("id", "rank").collect():
        join.setdefault(r["id"], []).append(r["name"])
    assert {i: p for i, p in row.items() if p} == join
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(900, None, 1.0)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    row = {r["id"]: r["n"] for r in df.select("id", classifier.nearest_place(F.struct("lat", "lon"))["name"].alias("n")).collect() if r["n"]}
    join = {r["id"]: r["name"] for r in geojoin.nearest_place_join(df, "id", book.gazetteer(spark)).collect()}
    assert row == join and len(row) == 300


def test_regions_in_any_number(spark):
    rng = random.Random(12)
    boxes = [(f"r{i}", *sorted(rng.uniform(-180, 240) for _ in "ab"), *sorted(rng.uniform(-90, 90) for _ in "ab")) for i in range(1500)]
    spots = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)] + [(99, None, None)]
    found = geojoin.within_regions(spark.createDataFrame(spots, "id long, lat double, lon double"), spark.createDataFrame(boxes, book.REGION_SCHEMA))
    want = {(i, b[0]) for i, lat, lon in spots if lat is not None for b in boxes if b[1] <= lon <= b[2] and b[3] <= lat <= b[4]}
    assert {(r["id"], r["region"]) for r in found.collect()} == want


def test_nearest_by_cells_equals_the_scan(spark, classifier):
    """100,000 points, corners and edges of cells, poles, the date line and odd coordinates; few entries per point."""
    import numpy as np

    from newsweft.operators.classify import CELL_DEG, _on_globe

    rng = np.random.default_rng(7)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 99_000))), rng.uniform(-180, 180, 99_000)
    near = [(p.lat + rng.normal(0, 2), p.lon + rng.normal(0, 2)) for p in classifier.book.gazetteer for _ in range(4)]
    edges = [(float(a), float(o)) for a in range(-90, 91, 3 * CELL_DEG) for o in range(-180, 181, 15)]
    points = [*zip(lat.tolist(), lon.tolist()), *near, *edges, (91.5, 20.0), (10.0, 200.0), (-100.0, -540.0)]
    entries = np.array([_on_globe(p.lat, p.lon) for p in classifier.book.gazetteer])
    want = []
    for start in range(0, len(points), 10_000):
        at = np.array([_on_globe(a, o) for a, o in points[start : start + 10_000]])
        want += (((at[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)).round(13).argmin(axis=1).tolist()
    df = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(points)], "id int, lat double, lon double")
    got = {r["id"]: r["n"] for r in df.select("id", classifier.nearest_place(F.struct("lat", "lon"))["name"].alias("n")).collect()}
    names = [p.name for p in classifier.book.gazetteer]
    assert [i for i in range(len(points)) if got[i] != names[want[i]]] == []
    sizes = [len(x) for x in classifier.near_lists]
    assert min(sizes) >= 1 and max(sizes) < 20
