import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from newsweft.operators.enrich import enrich
from newsweft.rules import book
from newsweft.schemas import RAW_PAYLOADS
from newsweft.plans import workload
from newsweft.sources.payloads import fetch_log, parse_payloads, read_feed_files
from newsweft.sources.registry import list_sources, select_sources

RSS = """<rss><channel><title>Channel</title><item>
<title>Flood hits Nepal &amp; India</title><link>https://example.org/1</link><pubDate>Fri, 18 Sep 2026 06:16:34 GMT</pubDate>
<description><![CDATA[<p>Heavy &#8217;rain&#8217; &amp;amp; more</p>]]></description><category>World</category><category>x</category><author>joe</author>
<enclosure type="image/png" url="https://example.org/picture-7.png"/></item>
<item><title>Earthquake strikes Japan, 3 dead</title><guid>https://example.org/2</guid><media:content url="https://a/b.jpg" medium="IMAGE"/></item>
<item><title>No link here</title><guid>tag:x</guid></item>
<item><title>Podcast flood talk</title><link>https://example.org/4</link><enclosure url="https://example.org/p.mp3" type="audio/mpeg"/></item>
<item><title>Truncated flood in Chile</title><link>https://example.org/3</link><pubDate>Fri, 18 Sep 2026 06:16:34 EST</pubDate><descr"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>yt:video:abc</id><yt:videoId>abc</yt:videoId><title type="html">War in Ukraine report</title>
<link rel="alternate" href="https://www.youtube.com/watch?v=abc"/><author><name>Chan</name><uri>u</uri></author><published>2026-09-18T06:16:34+00:00</published>
<media:group><media:title>t</media:title><media:description>Desc here</media:description>
<media:community><media:statistics views="123"/></media:community></media:group></entry>
<entry><title>Flood in Italy</title><link href="https://example.org/v"/><media:group><media:thumbnail url="https://t/1.jpg" width="4"/></media:group><yt:videoId>zz</yt:videoId></entry></feed>"""
GDACS = """<rss><channel>
<item><title>Cyclone warning raised to red off Madagascar</title><link>https://g/1</link><gdacs:alertlevel>Red</gdacs:alertlevel><gdacs:eventtype>TC</gdacs:eventtype>
<gdacs:eventid>1234</gdacs:eventid><geo:Point><geo:lat>-17.10</geo:lat><geo:long>48.99</geo:long></geo:Point><gdacs:bbox>40 50 -20 -10</gdacs:bbox>
<gdacs:severity unit="km/h" value="200">200 km/h</gdacs:severity><gdacs:country>Madagascar, Mozambique</gdacs:country></item>
<item><title>Green flood alert in Thailand</title><link>https://g/2</link><gdacs:alertlevel>Green</gdacs:alertlevel></item>
<item><title>Orange earthquake alert</title><link>https://g/3</link><gdacs:alertlevel>Orange</gdacs:alertlevel><gdacs:eventtype>EQ</gdacs:eventtype>
<gdacs:eventid>9</gdacs:eventid><geo:lat>36</geo:lat><geo:long>140</geo:long><gdacs:bbox>1 2 3</gdacs:bbox></item></channel></rss>"""
USGS = json.dumps({"features": [
    {"id": "us1", "properties": {"title": "M 6.1 - 40 km N of Lae, Papua New Guinea", "url": "https://u/1", "mag": 6.1, "tsunami": 1,
                                 "time": 1789712194000, "place": "40 km N of Lae, Papua New Guinea"}, "geometry": {"coordinates": [149.5, -6.2, 35.6]}},
    {"id": "us2", "properties": {"title": "M 4.6 - x", "url": "https://u/2", "mag": 4.6, "tsunami": 0, "time": None, "place": None},
     "geometry": {"coordinates": [140, 36, 10]}},
    {"id": "us3", "properties": {"title": "", "url": "https://u/3"}},
    {"id": "us4", "properties": {"title": "M 5.0 - nowhere", "url": "https://u/4", "mag": 5.0}, "geometry": None}]})
EONET = json.dumps({"events": [
    {"id": "E1", "title": "Wildfire X", "link": "https://e/1", "categories": [{"title": "Wildfires"}],
     "geometry": [{"date": "2026-09-01T00:00:00Z", "coordinates": [1, 2]}, {"date": "2026-09-10T00:00:00Z", "coordinates": [-71.0, -35.0]}]},
    {"id": "E2", "title": "Iceberg", "categories": [], "geometry": []}]})
GDELT = json.dumps({"articles": [{"title": "Clashes erupt near border", "url": "https://n/1", "seendate": "20260918T061634Z", "domain": "n.com", "sourcecountry": "Ukraine"}]})
BLUESKY = json.dumps({"feed": [
    {"post": {"uri": "at://did/app.bsky.feed.post/rk1", "author": {"handle": "reuters.com"}, "indexedAt": "2026-09-18T06:16:34.123Z", "replyCount": 3,
              "record": {"text": "Loud blasts wake the old harbour quarter tonight. Residents describe shelling and drone strike. https://t.co/x"},
              "embed": {"external": {"uri": "https://art/1", "thumb": "https://th/1"}, "images": [{"thumb": "https://img/1"}]}}},
    {"reason": {"$type": "repost"}, "post": {"record": {"text": "A repost that would otherwise be long enough"}}},
    {"post": {"uri": "at://d/p/k2", "record": {"text": "Too short"}}},
    {"post": {"uri": "at://d/p/k3", "record": {"text": "Troops seize the airport after an overnight ambush"}}}]})
MASTODON = json.dumps([
    {"content": "<p>Sirens over Odesa #Ukraine</p><p>Drone attack on the port at dawn</p>", "account": {"acct": "me"}, "url": "https://m/1",
     "created_at": "2026-09-18T06:16:34.000Z", "card": None, "media_attachments": [{"preview_url": "https://p/1", "url": "x"}], "reblog": None},
    {"reblog": {"id": 1}, "content": "<p>Boosted post that is long enough to count</p>", "url": "https://m/2"}])
TELEGRAM = """<html><div class="tgme_widget_message_wrap"><div class="m" data-post="chan/12"><div class="tgme_widget_message_text js-message_text" dir="auto">Missile strike on <b>Odesa</b> port kills 3 people, a spokesperson adds</div>
<time datetime="2026-09-18T06:16:34+00:00">x</time><video class="tgme_widget_message_video"></video></div></div>
<div class="tgme_widget_message_wrap"><div class="js-message_text">short</div></div><div class="tgme_widget_message_wrap"><p>no text</p></div>"""

BODIES = {
    "bbc": RSS, "yt-bbc": ATOM, "gdacs": GDACS, "usgs": USGS, "eonet": EONET, "gdelt-conflict": GDELT, "bsky-reuters": BLUESKY, "masto-gaza": MASTODON,
    "tg-disclosetv": TELEGRAM,
}
FETCHED = dt.datetime(2026, 9, 18, 7, 0, 0)
AT = dt.datetime(2026, 9, 18, 6, 16, 34)


@pytest.fixture(scope="module")
def payloads(spark):
    rows = [(s, FETCHED, 200, 5, None, b) for s, b in BODIES.items()]
    rows += [("gdelt-disaster", FETCHED, 200, 1, None, "Please limit requests"), ("npr", FETCHED, 503, 5, None, "x"), ("cbs", FETCHED, 200, 5, None, "  "),
             ("fox", FETCHED, None, 5, "dns error: no such host", None)]
    return spark.createDataFrame(rows, RAW_PAYLOADS)


@pytest.fixture(scope="module")
def drafts(spark, payloads, classifier):
    rows = parse_payloads(payloads, book.sources(spark), classifier).collect()
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source_id"], []).append(r.asDict(True))
    return by_source


def facts(d):
    return {f["k"]: f["v"] for f in d["facts"]}


def test_rss(drafts):
    first, second, podcast, cut = drafts["bbc"]
    assert (first["kind"], first["title"], first["url"], first["published"]) == ("Article", "Flood hits Nepal & India", "https://example.org/1", AT)
    assert first["snippet"] == "Heavy 'rain' &amp; more"
    assert first["thumbnail"] == "https://example.org/picture-7.png" and facts(first) == {"feed-category": "World"}
    assert (second["url"], second["published"], second["thumbnail"]) == ("https://example.org/2", FETCHED, "https://a/b.jpg")
    assert podcast["thumbnail"] is None
    assert (cut["title"], cut["url"], cut["published"]) == ("Truncated flood in Chile", "https://example.org/3", AT + dt.timedelta(hours=5))


def test_atom_and_video(drafts):
    one, two = drafts["yt-bbc"]
    assert (one["kind"], one["title"], one["snippet"], one["published"]) == ("Video", "War in Ukraine report", "Desc here", AT)
    assert one["thumbnail"] == "https://i.ytimg.com/vi/abc/hqdefault.jpg"
    assert facts(one) == {"channel": "Chan", "views": "123"}
    assert two["thumbnail"] == "https://t/1.jpg" and facts(two) == {"channel": "YouTube · BBC News"}


def test_hazard_alerts(drafts):
    cyclone, quake = drafts["gdacs"]
    assert (cyclone["severity"], cyclone["event_key"], cyclone["category_override"]) == (4, "gdacs-TC-1234", "NaturalDisaster")
    assert cyclone["place"] == {"name": "Madagascar", "point": {"lat": -17.1, "lon": 48.99}, "radius_deg": 5.0, "bbox": [40.0, 50.0, -20.0, -10.0]}
    assert facts(cyclone) == {"alert": "Red", "event": "tropical cyclone", "scale": "200 km/h", "country": "Madagascar, Mozambique"}
    assert (quake["severity"], quake["category_override"], quake["place"]["name"], quake["place"]["radius_deg"], quake["place"]["bbox"]) == (3, "Earthquake", "Japan", 1.5, None)


def test_earthquakes(drafts):
    one, two, nowhere = drafts["usgs"]
    assert (one["severity"], one["event_key"], one["published"]) == (4, "usgs-us1", AT)
    assert one["snippet"] == "Magnitude 6.1 earthquake at 36 km depth, tsunami evaluation issued."
    assert one["place"]["name"] == "Papua New Guinea" and abs(one["place"]["radius_deg"] - 6.1 / 3) < 1e-9
    assert facts(one) == {"magnitude": "6.1", "depth": "36 km", "tsunami": "yes"}
    assert (two["severity"], two["published"], two["place"]["name"]) == (1, FETCHED, "Japan")
    assert nowhere["place"] is None and nowhere["severity"] == 2


def test_natural_events(drafts):
    fire, ice = drafts["eonet"]
    assert (fire["published"], fire["place"]["name"], fire["place"]["point"]) == (dt.datetime(2026, 9, 10), "Chile", {"lat": -35.0, "lon": -71.0})
    assert (fire["snippet"], fire["severity"], facts(fire)) == ("Wildfires tracked by NASA EONET.", 2, {"event": "wildfires"})
    assert (ice["url"], ice["place"], ice["published"]) == ("https://eonet.gsfc.nasa.gov/api/v3/events/E2", None, FETCHED)


def test_index_and_social(drafts):
    (article,) = drafts["gdelt-conflict"]
    assert (article["place"]["name"], article["published"], facts(article)) == ("Ukraine", AT, {"outlet": "n.com", "source country": "Ukraine"})
    post, own = drafts["bsky-reuters"]
    assert (post["title"], post["url"], post["thumbnail"]) == ("Loud blasts wake the old harbour quarter tonight.", "https://art/1", "https://img/1")
    assert facts(post) == {"handle": "@reuters.com", "post": "https://bsky.app/profile/reuters.com/post/rk1", "replies": "3"}
    assert own["url"] == "https://bsky.app/profile/unknown/post/k3" and own["published"] == FETCHED
    (toot,) = drafts["masto-gaza"]
    assert (toot["url"], toot["thumbnail"], facts(toot)) == ("https://m/1", "https://p/1", {"account": "@me", "post": "https://m/1"})
    (message,) = drafts["tg-disclosetv"]
    assert (message["kind"], message["url"], message["published"]) == ("Video", "https://t.me/chan/12", AT)


def test_enrichment(spark, payloads, classifier):
    sources = book.sources(spark)
    items = {r["url"]: r for r in enrich(parse_payloads(payloads, sources, classifier), sources, classifier).collect()}
    cyclone = items["https://g/1"]
    assert (cyclone["category"], cyclone["severity"], cyclone["source"]) == ("NaturalDisaster", 4, "GDACS alerts")
    assert items["https://u/2"]["category"] == "Earthquake"
    # EST puts this one after the fetch; it is clamped to five minutes past it.
    assert items["https://example.org/3"]["published"] == FETCHED + dt.timedelta(minutes=5)
    message = items["https://t.me/chan/12"]
    assert message["anchor_id"] == "ukraine-war" and {f["k"]: f["v"] for f in message["facts"]}["anchor"] == "ukraine-war"
    quake = items["https://example.org/2"]
    assert {f["k"]: f["v"] for f in quake["facts"]} == {"toll": "3 dead"} and quake["place"]["name"] == "Japan"
    assert items["https://example.org/4"]["relevance"] == 8


def test_gates(spark, classifier):
    from newsweft.schemas import DRAFTS

    def draft(source, title, url="https://x/1", key=None):
        return (source, FETCHED, "Article", title, "", url, AT, None, None, None, [], key, None)

    rows = [
        draft("bbc", "Premier League clashes end in dramatic collapse", "u1"),
        draft("gdacs", "Premier League clashes end in dramatic collapse", "u2", "k"),
        draft("bbc", "Couple rescued after deadline passes", "u3"),
        draft("un-news", "Couple rescued after deadline passes", "u4"),
        draft("bbc", "Kherson market opens", "u5"),
        draft("bbc", "vote", "u6"),
        draft("bbc", "  ", "u7"),
        draft("bbc", "Earthquake", " "),
    ]
    got = enrich(spark.createDataFrame(rows, DRAFTS), book.sources(spark), classifier).select("url").collect()
    assert sorted(r["url"] for r in got) == ["u2", "u4", "u5", "u6"]


def test_fetch_log(spark, payloads, classifier):
    sources = book.sources(spark)
    kept = parse_payloads(payloads, sources, classifier).select("source_id", "fetched")
    log = {r["source_id"]: r for r in fetch_log(payloads, sources, kept).collect()}
    assert {s: r["error"] for s, r in log.items() if not r["ok"]} == {
        "gdelt-disaster": "rate limited", "npr": "HTTP 503", "cbs": "empty body", "fox": "dns error"
    }
    assert log["bbc"]["n_items"] == 4 and log["usgs"]["n_items"] == 3 and log["npr"]["n_items"] == 0


def test_parse_needs_no_shuffle(spark, payloads, classifier):
    text = parse_payloads(payloads, book.sources(spark), classifier)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text


def test_registry(spark):
    sources = book.sources(spark)
    assert select_sources(sources).count() == 37 and select_sources(sources, include_opt_in=True).count() == 43
    assert [r["source_id"] for r in select_sources(sources, only=["bbc"]).collect()] == ["bbc"]
    with pytest.raises(ValueError):
        select_sources(sources, only=["tg-warmonitors"])
    assert list_sources(sources).count() == 43


def test_xml_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS[: RSS.index("<item><title>Truncated")] + "</channel></rss>")
    rows = read_feed_files(spark, str(tmp_path)).select(F.col("title")[0].alias("t")).collect()
    assert sorted(r["t"] for r in rows)[0] == "Earthquake strikes Japan, 3 dead" and len(rows) == 4


CUT = {
    "bbc": """<rss><channel><item rdf:about="x"><title>Bridge &nbsp; A & B closed</title><link>https://example.org/9</link>
<media:content url="https://a/v.mp4" medium="video"><media:thumbnail url="https://a/t.jpg"/><media:description>Told inside</media:description></media:content>
<category>World</category><pubDate>Fri, 18 Sep 2026 06:16:34 GMT</pubDate><dc:creator>some""",
    "npr": """<rss><channel><item><title>Whole record</title><link>https://example.org/8</link>
<media:content url="https://a/v.mp4" medium="video"><media:thumbnail url="https://a/u.jpg"/><media:description>Told inside</media:description></media:content></item></channel></rss>""",
    "yt-bbc": """<feed><entry><title>Ferry stuck off Crete</title><link rel="alternate" href="https://www.youtube.com/watch?v=q1"/>
<yt:videoId>q1</yt:videoId><published>2026-09-18T06:16:34+00:00</published><media:group><media:description>Long wait</media:descr""",
    "gdacs": """<rss><channel><item><title>Red volcano notice</title><link>https://g/7</link><gdacs:alertlevel>Red</gdacs:alertlevel>
<gdacs:eventtype>VO</gdacs:eventtype><gdacs:eventid>77</gdacs:eventid><geo:Point><geo:lat>14.5</geo:lat><geo:long>121</geo:long></geo:Point><gdacs:bbox>120 122 14 15</gdacs:bbox><gdacs:sev""",
}


def test_cut_and_nested_records(spark, classifier):
    rows = [(s, FETCHED, 200, 5, None, b) for s, b in CUT.items()]
    found = {r["source_id"]: r.asDict(True) for r in parse_payloads(spark.createDataFrame(rows, RAW_PAYLOADS), book.sources(spark), classifier).collect()}
    assert sorted(found) == sorted(CUT)
    news, whole, video, hazard = (found[k] for k in ("bbc", "npr", "yt-bbc", "gdacs"))
    assert (news["title"], news["url"], news["published"], facts(news)) == ("Bridge A & B closed", "https://example.org/9", AT, {"feed-category": "World"})
    assert (news["thumbnail"], news["snippet"]) == ("https://a/t.jpg", "Told inside")
    assert (whole["thumbnail"], whole["snippet"]) == ("https://a/u.jpg", "Told inside")
    assert (video["kind"], video["url"], video["published"], video["thumbnail"]) == ("Video", "https://www.youtube.com/watch?v=q1", AT, "https://i.ytimg.com/vi/q1/hqdefault.jpg")
    assert (hazard["severity"], hazard["event_key"], hazard["place"]["bbox"]) == (4, "gdacs-VO-77", [120.0, 122.0, 14.0, 15.0])


NESTED = {
    "bbc": """<rss><channel><item><x:box><y:inner><media:thumbnail width="3" url="https://a/deep.jpg?a=1&amp;b=2"/></y:inner><media:title>Bridge & tunnel reopen</media:title></x:box>
<title>Second title</title><x:where><link>https://example.org/n1</link></x:where><x:more><y:text><description>Told <b>in a</b> deep place<!-- not <title>this</title> --></description></y:text></x:more>
<x:meta><category><![CDATA[World & more]]></category></x:meta><x:when><pubDate>Fri, 18 Sep 2026 06:16:34 GMT</pubDate></x:when></item>
<item><!-- <link>https://example.org/no</link> --><title>Quay &amp; dock</title><link>https://example.org/n2</link><x:a note="1 > 0"><enclosure url='https://a/e.png'/></x:a>
<content:encoded><![CDATA[<p><title>no</title> R&D said</p>]]></content:encoded></item>
<item><title>Cut inside</title><link>https://example.org/n3</link><description><![CDATA[<p>open <category>Wrong</category>""",
    "yt-bbc": """<feed><entry><title>Ferry</title><x:credit><name>Someone</name></x:credit><author><uri>u</uri><name>Desk &amp; Co</name></author>
<link rel="alternate" href="https://www.youtube.com/watch?v=q1"/><x:one><x:two><yt:videoId>q1</yt:videoId><media:statistics views="9"/></x:two></x:one></entry></feed>""",
    "gdacs": """<rss><channel><item><x:all><title>Red volcano notice</title><link>https://g/7</link><x:grade><gdacs:alertlevel>Red</gdacs:alertlevel></x:grade><gdacs:eventtype>VO</gdacs:eventtype>
<gdacs:eventid>7</gdacs:eventid><x:at><geo:lat>14.5</geo:lat><geo:long>121</geo:long></x:at></x:all></item></channel></rss>""",
}


def test_fields_under_any_parent(spark, classifier):
    rows = [(s, FETCHED, 200, 5, None, b) for s, b in NESTED.items()]
    drafts = parse_payloads(spark.createDataFrame(rows, RAW_PAYLOADS), book.sources(spark), classifier).collect()
    found = {r["url"]: r.asDict(True) for r in drafts}
    assert len(found) == 5
    deep = found["https://example.org/n1"]
    assert (deep["title"], deep["snippet"], deep["thumbnail"], deep["published"]) == ("Bridge & tunnel reopen", "deep place", "https://a/deep.jpg?a=1&b=2", AT)
    assert facts(deep) == {"feed-category": "World & more"}
    plain = found["https://example.org/n2"]
    assert (plain["title"], plain["snippet"], plain["thumbnail"]) == ("Quay & dock", "no R&D said", "https://a/e.png")
    assert (found["https://example.org/n3"]["title"], facts(found["https://example.org/n3"])) == ("Cut inside", {})
    video = found["https://www.youtube.com/watch?v=q1"]
    assert facts(video) == {"channel": "Desk & Co", "views": "9"} and video["thumbnail"] == "https://i.ytimg.com/vi/q1/hqdefault.jpg"
    hazard = found["https://g/7"]
    assert (hazard["event_key"], hazard["place"]["point"]) == ("gdacs-VO-7", {"lat": 14.5, "lon": 121.0})


def test_long_records_are_read_in_one_pass(spark, classifier):
    """Long texts, many tags and many comparison signs: time goes with the length."""
    body = "<rss><channel><item><title>Long</title><link>https://example.org/l</link><description>" + "a > b " * 200_000 + "<br/>" * 50_000 + " end</description></item></channel></rss>"
    rows = parse_payloads(spark.createDataFrame([("bbc", FETCHED, 200, 5, None, body)], RAW_PAYLOADS), book.sources(spark), classifier).collect()
    assert [(r["title"], r["snippet"]) for r in rows] == [("Long", "end")]


def test_payloads_shuffle_rows_not_texts(spark, tmp_path):
    """The one exchange of a payload view lies below its records, and formats that read the same columns have it in common."""
    rows = [(i, i % 3, ("view", "click", "error")[i % 3], float(i), "2024-01-01 00:00:00") for i in range(45)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts string").write.parquet(f"{tmp_path}/events.parquet")
    made = workload.payloads(spark, str(tmp_path), "feed")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("<item><title>") < plan.index("Exchange hashpartitioning")  # above it
    assert sorted(b.count("<item>") for (b,) in made.select("body").collect()) == [5, 20, 20]
