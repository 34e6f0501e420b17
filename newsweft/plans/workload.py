"""Views over the given tables that let every operator run on them.

``news`` turns each row of ``events`` into a news item: the headline is a template
chosen by the event, filled with a place and a number taken from the row.  Payload
views pack the same rows into the eight wire formats, twenty reports per payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.functions import grading, text
from newsweft.operators.classify import Classifier
from newsweft.operators.enrich import read_rules
from newsweft.operators.stories import EVENT_PREFIX
from newsweft.rules.book import local_table
from newsweft.rules.feeds import SOURCES
from newsweft.session import gather, spread
from newsweft.schemas import PLACE, RAW_PAYLOADS

NOW = "2024-01-31 00:00:00"

HEADLINES = [
    "Kharkiv hit by Russian drone strike before dawn",
    "Zelensky visits front line near Pokrovsk",
    "Odesa wakes to explosions, Ukraine says attack repelled",
    "Massive earthquake jolts northern Chile desert",
    "Interest rates raised once more by central bank",
    "Israel strikes southern Lebanon as Hezbollah vows response",
    "At least 12 killed as flood hits Nepal valley",
    "Couple rescued after deadline passes",
    "Premier League clashes end in dramatic collapse",
    "Papua New Guinea volcano erupts, 1,200 displaced",
    "President and parliament agree budget",
    "Cholera outbreak in Sudan, 40 dead",
    "Ransomware attack hits U.S. hospital",
    "Massacre reported after overnight assault",
    "Magnitude 5.{d} earthquake shakes {place}",
    "Flooding in {place} leaves {n} dead and many missing",
    "Protesters clash with police in {place} after election",
    "Hackers claim data breach at {place} ministry",
    "Refugees stranded near {place} as drought deepens",
    "Storm surge warning issued for {place}",
    "{place} and France sign trade treaty",
]

# Lower or upper case on purpose: matching ignores case.
PLACES = [
    "Greece", "Turkey", "Japan", "Poland", "California", "Italy", "Spain", "Hawaii", "Germany", "Brazil", "Kyiv", "Gaza",
    "PHILIPPINES", "Mexico", "haiti", "Taiwan", "Iran", "South Sudan", "Guinea", "Papua New Guinea", "Paris", "Tonga", "Nowhere",
]

# Names as sources write them: odd case and blanks, aliases, unknown ones.
NAMES = ["Kyiv", "kiev", "  UKRAINE ", "u.s.", "United States", "burma", "Atlantis", "uk government", "West bank", "Tonga "]

KINDS = {"view": "Article", "click": "Article", "signup": "Report", "purchase": "Video", "error": "Alert"}
SOURCE_KINDS = {"view": "News", "click": "Social", "signup": "Humanitarian", "purchase": "Video", "error": "Alert"}

DOCUMENT_TERMS = ["the", "that", "license", "copyright", "in the", "of the", "and the", "is on", "le", "de la", "und", "la", "not found", "http"]


# Tables whose rows cost much work (long texts): a small one is spread over the cores.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def now_literal() -> Column:
    return F.lit(NOW).cast("timestamp")


def choose(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def mapped(key: Column, table_: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in table_.items() for x in p]), key)


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, id, user_id, event_type, value, template, title, published, kind, event_key."""
    return _news(spread(events(spark, sf_dir), "event_id"))


def _news(e: DataFrame, *kept: str) -> DataFrame:
    whole = F.floor("value").cast("bigint")
    filled = F.replace(
        F.replace(F.replace(choose(HEADLINES, F.col("event_id")), F.lit("{place}"), choose(PLACES, F.col("user_id"))),
                  F.lit("{n}"), (whole % 90 + 1).cast("string")),
        F.lit("{d}"), (whole % 10).cast("string"),
    )
    template = (F.col("event_id") % len(HEADLINES)).cast("int")
    key = (
        F.when((template == 14) & (F.col("event_type") != "view"), F.concat(F.lit("usgs-"), F.col("user_id").cast("string")))
        .when((template == 18) & (F.col("event_type") == "error"), F.concat(F.lit("gdacs-DR-"), F.col("user_id").cast("string")))
    )
    return e.select(
        "event_id",
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        "user_id",
        "event_type",
        "value",
        template.alias("template"),
        filled.alias("title"),
        F.col("ts").alias("published"),
        mapped(F.col("event_type"), KINDS).alias("kind"),
        key.alias("event_key"),
        *kept,
    )


def read_news(spark: SparkSession, sf_dir: str, classifier: Classifier) -> DataFrame:
    """``news`` with the matched terms and the rule readings."""
    return read_rules(news(spark, sf_dir), F.col("title"), classifier)


def news_items(spark: SparkSession, sf_dir: str, classifier: Classifier, noise: bool = False) -> DataFrame:
    """``news`` as items in the library's item schema (no veto, no gate); with ``noise`` the veto's mark comes along."""
    read = read_news(spark, sf_dir, classifier)
    guess, anchor = F.col("_read.guess"), F.col("_read.anchor")
    category = F.coalesce(anchor["category"], guess["category"])
    return read.select(
        "id",
        "kind",
        F.col("event_type").alias("source"),
        "title",
        F.lit("").alias("snippet"),
        F.concat(F.lit("https://news.example/"), "id").alias("url"),
        "published",
        (F.col("published") + F.expr("INTERVAL 5 MINUTES")).alias("fetched"),
        category.alias("category"),
        grading.severity_from_text(F.col("title"), category).cast("int").alias("severity"),
        classifier.best_place(F.col("_terms")).alias("place"),
        text.tokenize(F.col("title")).alias("tokens"),
        grading.facts_array(("toll", text.toll(F.col("title"))), ("anchor", anchor["anchor_id"])).alias("facts"),
        guess["score"].alias("relevance"),
        "event_key",
        F.lit(None).cast("string").alias("thumbnail"),
        F.lit(None).cast("string").alias("language"),
        anchor["anchor_id"].alias("anchor_id"),
        "user_id",
        "template",
        "event_id",
        *([F.col("_read.noise").alias("noise")] if noise else []),
    )


def keyed_stories(items: DataFrame) -> DataFrame:
    """Items with a story id that needs no similarity: event key, anchor, else source and template."""
    own = F.concat(F.lit("s-"), "source", F.lit("-"), F.col("template").cast("string"))
    return items.withColumn(
        "story_id", F.coalesce(F.concat(F.lit(EVENT_PREFIX), "event_key"), "anchor_id", own)
    )


def user_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as assigned items: one story per user, severity from the value."""
    e = events(spark, sf_dir)
    value = F.col("value")
    severity = F.when(value >= 100, 4).when(value >= 50, 3).when(value >= 20, 2).when(value >= 5, 1).otherwise(0)
    return e.select(
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("story_id"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.col("event_type").alias("source"),
        mapped(F.col("event_type"), KINDS).alias("kind"),
        F.col("ts").alias("published"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("fetched"),
        severity.alias("severity"),
        F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("title"),
        F.lit("Other").alias("category"),
        F.array(F.lit("event"), F.col("event_type")).alias("tokens"),
        F.lit(None).cast(PLACE).alias("place"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point on the globe per event."""
    e = events(spark, sf_dir)
    return e.select(
        "event_id",
        ((F.col("event_id") * 37) % 17000 / 100.0 - 85.0).alias("lat"),
        ((F.col("event_id") * 73) % 36000 / 100.0 - 180.0).alias("lon"),
    )


def event_fetch_log(spark: SparkSession, sf_dir: str, sources: DataFrame) -> DataFrame:
    """``events`` as a fetch log over the registered sources; an ``error`` event is a failed fetch."""
    e = events(spark, sf_dir)
    failed = F.col("event_type") == "error"
    return e.select(
        choose([s[0] for s in SOURCES], F.col("user_id")).alias("source_id"),
        F.col("ts").alias("fetched"),
        (~failed).alias("ok"),
        F.when(failed, 0).otherwise(F.floor("value") % 50).cast("bigint").alias("n_items"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
        F.when(failed, F.concat(F.lit("HTTP "), (F.floor("value") % 100 + 400).cast("string"))).alias("error"),
    )


# ------------------------------------------------------------------ payloads

PER_PAYLOAD = 20
HAZARD_CODES = ["EQ", "TC", "FL", "VO", "DR", "WF", "TS", "XX"]


def _xml_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _mail_date(c: Column) -> Column:
    return F.concat(F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def _iso_date(c: Column) -> Column:
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def _records(parser: str) -> Column:
    """One report of ``news`` in a wire format."""
    title, at, number = F.col("title"), F.col("published"), F.col("event_id").cast("string")
    lat = ((F.col("event_id") * 37) % 17000 / 100.0 - 85.0)
    lon = ((F.col("event_id") * 73) % 36000 / 100.0 - 180.0)
    link = F.concat(F.lit("https://news.example/"), number)
    level = F.when(F.col("value") >= 60, "Red").when(F.col("value") >= 20, "Orange").otherwise("Green")
    magnitude = F.floor(F.col("value")) % 80 / 10.0
    span = F.concat(F.lit("10 "), (F.col("event_id") % 15 * 2 + 10).cast("string"), F.when(F.col("event_id") % 4 == 0, " 5").otherwise(" 5 7"))
    bbox = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<gdacs:bbox>"), span, F.lit("</gdacs:bbox>"))).otherwise("")
    post = F.concat(title, F.lit(". Read the full report at https://t.example/"), number, F.lit(" #news #world"))
    boxed = F.col("event_id") % 3 == 0  # fields under parents that no feed format names
    if parser == "feed":
        return F.concat(
            F.lit("<item><title>"), _xml_text(title), F.lit("</title><link>"), link, F.lit("</link><pubDate>"), _mail_date(at),
            F.lit("</pubDate>"), F.when(boxed, "<x:box><x:inner>").otherwise(""),
            F.lit("<description><![CDATA[<p>Report &amp; photos: "), F.col("event_type"), F.lit("</p>]]></description><category>"),
            F.col("event_type"), F.lit("</category>"), F.when(boxed, '<media:thumbnail url="').otherwise('<enclosure type="image/png" url="'),
            F.lit("https://img.example/"), number, F.lit('.png"/>'), F.when(boxed, "</x:inner></x:box>").otherwise(""), F.lit("</item>"),
        )
    if parser == "atom":
        return F.concat(
            F.lit("<entry><yt:videoId>v"), number, F.lit("</yt:videoId><title>"), _xml_text(title),
            F.lit('</title><link rel="alternate" href="https://www.youtube.com/watch?v='), number,
            F.lit('"/><author><name>Desk '), F.col("event_type"), F.lit("</name></author><published>"), _iso_date(at),
            F.lit("</published><media:group><media:description>Clip</media:description></media:group></entry>"),
        )
    if parser == "gdacs":
        return F.concat(
            F.lit("<item><title>"), _xml_text(title), F.lit("</title><link>"), link, F.lit("</link><pubDate>"), _mail_date(at),
            F.lit("</pubDate><gdacs:alertlevel>"), level, F.lit("</gdacs:alertlevel><gdacs:eventtype>"),
            choose(HAZARD_CODES, F.col("event_id")), F.lit("</gdacs:eventtype><gdacs:eventid>"), number, F.lit("</gdacs:eventid>"), bbox, F.lit("<geo:Point><geo:lat>"), lat.cast("string"), F.lit("</geo:lat><geo:long>"), lon.cast("string"),
            F.lit("</geo:long></geo:Point><gdacs:country>Chile, Peru</gdacs:country></item>"),
        )
    if parser == "usgs":
        return F.to_json(F.struct(
            number.alias("id"),
            F.struct(
                title.alias("title"), link.alias("url"), magnitude.alias("mag"), F.lit(0).alias("tsunami"),
                F.unix_millis(at).alias("time"), F.concat(F.lit("9 km S of "), F.col("event_type"), F.lit(", Chile")).alias("place"),
            ).alias("properties"),
            F.struct(F.array(lon, lat, F.lit(10.0)).alias("coordinates")).alias("geometry"),
        ))
    if parser == "eonet":
        return F.to_json(F.struct(
            number.alias("id"), title.alias("title"), link.alias("link"), F.array(F.struct(F.lit("Wildfires").alias("title"))).alias("categories"),
            F.array(
                F.struct(F.lit("2020-01-01T00:00:00Z").alias("date"), F.array(F.lit(0.0), F.lit(0.0)).alias("coordinates")),
                F.struct(_iso_date(at).alias("date"), F.array(lon, lat).alias("coordinates")),
            ).alias("geometry"),
        ))
    if parser == "gdelt":
        return F.to_json(F.struct(
            title.alias("title"), link.alias("url"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'").alias("seendate"),
            F.concat("event_type", F.lit(".example")).alias("domain"), choose(NAMES, F.col("event_id")).alias("sourcecountry"),
        ))
    if parser == "bluesky":
        return F.to_json(F.struct(
            F.when(F.col("event_type") == "click", F.lit("repost")).alias("reason"),
            F.struct(
                F.concat(F.lit("at://did/app.bsky.feed.post/"), number).alias("uri"),
                F.struct(F.concat("event_type", F.lit(".example")).alias("handle")).alias("author"),
                _iso_date(at).alias("indexedAt"),
                F.struct(post.alias("text")).alias("record"),
            ).alias("post"),
        ))
    if parser == "mastodon":
        return F.to_json(F.struct(
            F.when(F.col("event_type") == "click", F.lit("boost")).alias("reblog"),
            F.concat(F.lit("<p>"), _xml_text(title), F.lit(".</p><p>More to follow #breaking</p>")).alias("content"),
            F.struct(F.col("event_type").alias("acct")).alias("account"),
            link.alias("url"),
            _iso_date(at).alias("created_at"),
        ))
    return F.concat(
        F.lit('tgme_widget_message_wrap"><div data-post="desk/'), number, F.lit('"><div class="js-message_text" dir="auto">'), _xml_text(title),
        F.lit('.<br/>Stay tuned</div><time datetime="'), _iso_date(at), F.lit('"></time></div>'),
    )


_WRAP = {
    "feed": ("<rss><channel>", "", "</channel></rss>"),
    "atom": ("<feed>", "", "</feed>"),
    "gdacs": ("<rss><channel>", "", "</channel></rss>"),
    "usgs": ('{"features":[', ",", "]}"),
    "eonet": ('{"events":[', ",", "]}"),
    "gdelt": ('{"articles":[', ",", "]}"),
    "bluesky": ('{"feed":[', ",", "]}"),
    "mastodon": ("[", ",", "]"),
    "telegram": ("<html>", "", "</html>"),
}

_SOURCE_OF = {
    "feed": "bbc", "atom": "yt-bbc", "gdacs": "gdacs", "usgs": "usgs", "eonet": "eonet", "gdelt": "gdelt-conflict",
    "bluesky": "bsky-reuters", "mastodon": "masto-gaza", "telegram": "tg-disclosetv",
}


def payloads(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """``news`` packed into payloads of one format, at most 20 reports each."""
    head, glue, tail = _WRAP[fmt]
    # Rows of a payload meet before its records are written, so no text is shuffled and formats share the shuffle of the rows.
    number = F.floor(F.col("event_id") / PER_PAYLOAD)
    rows = gather(events(spark, sf_dir).withColumn("_n", number), "_n")
    rows = _news(rows, "_n").withColumn("_record", _records(fmt))
    # A payload holds 20 reports whatever the data looks like, so the list stays short.
    packed = rows.groupBy("_n").agg(F.sort_array(F.collect_list(F.struct("event_id", "_record"))).alias("r"))
    body = F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["_record"]), glue), F.lit(tail))
    made = packed.select(
        F.lit(_SOURCE_OF[fmt]).alias("source_id"),
        F.lit(NOW).cast("timestamp").alias("fetched"),
        F.lit(200).alias("http_status"),
        F.lit(5).cast("bigint").alias("latency_ms"),
        F.lit(None).cast("string").alias("error"),
        body.alias("body"),
    )
    return made.select(*[c.split()[0] for c in RAW_PAYLOADS.split(", ")])


def document_dictionary(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(t,) for t in DOCUMENT_TERMS], "term string")

