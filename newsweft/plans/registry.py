"""The registered queries: every operator on the given tables.

Each takes (spark, sf_dir) and returns a DataFrame over whole tables.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.functions import geo, grading, text, times
from newsweft.functions.geo import zone_of
from newsweft.operators import alerts, geojoin, health, language, merge, stories
from newsweft.operators.assign import assign, route_exact, unseen, young_enough
from newsweft.operators.classify import Classifier
from newsweft.operators.dictmatch import TermPattern, keyword_hits
from newsweft.operators.enrich import MIN_RELEVANCE, UNGATED_KINDS, enrich
from newsweft.operators.similarity import best_story, scored_pairs
from newsweft.plans import queries as q
from newsweft.plans import reports, workload
from newsweft.plans.workload import keyed_stories, news, news_items, now_literal, read_news, stamp, table
from newsweft.rules import book
from newsweft.schemas import PLACE
from newsweft.session import cut_lineage, new_folder, spread
from newsweft.sources.payloads import fetch_log, parse_payloads
from newsweft.sources.postings import PostingIndex
from newsweft.sources.registry import select_sources
from newsweft.sources.store import SAVED_ITEMS, SAVED_STORIES, TableStore, load_snapshot, restore_items, save_snapshot

CUT = "2024-01-16 00:00:00"  # splits the news into earlier stories and later items
LATE = "2024-03-16 00:00:00"  # a clock at which part of the news is past retention
RELOADED = "2024-03-29 00:00:00"  # a clock at which part of a snapshot's stories is stale
ENTRIES = 229  # entries of the gazetteer


@lru_cache(maxsize=1)
def classifier() -> Classifier:
    return Classifier()


def _terms() -> Column:
    return F.col("_terms")


# ------------------------------------------------------------------ dictionaries


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    read = read_news(spark, sf, classifier())
    return read.groupBy(F.col("_read.guess.category").alias("category")).agg(F.count("*").alias("n"))


def category_scores(spark: SparkSession, sf: str) -> DataFrame:
    guess = F.col("_read.guess")
    return read_news(spark, sf, classifier()).select("event_id", guess["category"].alias("category"), guess["score"].alias("score"))


def anchor_routing(spark: SparkSession, sf: str) -> DataFrame:
    anchor = F.col("_read.anchor")
    routed = read_news(spark, sf, classifier()).filter(anchor.isNotNull())
    named = book.anchors(spark).select("anchor_id", "title", "home")
    counts = routed.groupBy(anchor["anchor_id"].alias("anchor_id")).agg(
        F.count("*").alias("n"), F.sum(anchor["score"].cast("bigint")).alias("score")
    )
    return counts.join(named, "anchor_id")


def noise_veto(spark: SparkSession, sf: str) -> DataFrame:
    kept = F.col("event_key").isNotNull() | ~F.col("_read.noise")
    return read_news(spark, sf, classifier()).filter(~kept).select("event_id", "title")


def relevance_gate(spark: SparkSession, sf: str) -> DataFrame:
    kind = workload.mapped(F.col("event_type"), workload.SOURCE_KINDS)
    guess = F.col("_read.guess")
    passed = kind.isin("Alert", "Humanitarian") | F.col("_read.anchor").isNotNull() | (guess["score"] >= 4)
    return read_news(spark, sf, classifier()).filter(passed).groupBy("event_type", guess["category"].alias("category")).agg(
        F.count("*").alias("n"), F.sum(guess["score"]).alias("score")
    )


def locate_best(spark: SparkSession, sf: str) -> DataFrame:
    place = classifier().best_place(_terms())
    return read_news(spark, sf, classifier()).select("event_id", place["name"].alias("place")).filter("place is not null")


def locate_all_rank(spark: SparkSession, sf: str) -> DataFrame:
    names = F.transform(classifier().places(_terms()), lambda p: p["name"])
    return read_news(spark, sf, classifier()).select("event_id", F.array_join(names, "|").alias("places"))


def _named_events(spark: SparkSession, sf: str) -> DataFrame:
    return workload.events(spark, sf).withColumn("name", workload.choose(workload.NAMES, F.col("event_id")))


def name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = geojoin.lookup_names(_named_events(spark, sf), "name", classifier())
    return found.groupBy("name", F.col("place.name").alias("place"), "event_type").agg(F.count("*").alias("n"))


def name_lookup_join(spark: SparkSession, sf: str) -> DataFrame:
    found = geojoin.lookup_names_join(_named_events(spark, sf), "name", book.gazetteer(spark))
    return found.groupBy("name", F.col("entry.name").alias("place"), "event_type").agg(F.count("*").alias("n"))


def nearest_place(spark: SparkSession, sf: str) -> DataFrame:
    found = geojoin.label_points(spread(workload.points(spark, sf), "event_id"), "lat", "lon", classifier())
    return found.select("event_id", F.col("place.name").alias("place"), F.col("place.radius_deg").alias("radius_deg"))


def _document_dictionary_hits(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_hits(table(spark, sf, "documents"), "doc_id", "text", workload.document_dictionary(spark))


def dict_hits_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _document_dictionary_hits(spark, sf).select("doc_id", "term", "n")


def dict_pattern_documents(spark: SparkSession, sf: str) -> DataFrame:
    pattern = TermPattern(workload.DOCUMENT_TERMS)
    return table(spark, sf, "documents").select("doc_id", F.explode(pattern.matched(F.col("text"))).alias("term"))


def rules_on_documents(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.explain(table(spark, sf, "documents").select("doc_id", "text"), "text", classifier())
    return found.select("doc_id", "noise", "category", "score", "anchor", "place", "severity")


def explain_news(spark: SparkSession, sf: str) -> DataFrame:
    return reports.explain(news(spark, sf).select("event_id", "title"), "title", classifier()).drop("title")


# ------------------------------------------------------------------ scalar functions


def severity_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", grading.severity_from_text(F.col("text"), F.lit("Other")).alias("severity"))


def severity_news(spark: SparkSession, sf: str) -> DataFrame:
    category = F.coalesce("_read.anchor.category", "_read.guess.category")
    graded = read_news(spark, sf, classifier()).withColumn("severity", grading.severity_from_text(F.col("title"), category))
    return graded.groupBy("severity", grading.severity_label(F.col("severity")).alias("label")).agg(F.count("*").alias("n"))


def toll_news(spark: SparkSession, sf: str) -> DataFrame:
    return news(spark, sf).select("event_id", text.toll(F.col("title")).alias("toll")).filter("toll is not null")


def toll_documents(spark: SparkSession, sf: str) -> DataFrame:
    # Documents hold numbers but few casualty words; the sentence around each event adds them.
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.col("text"), F.lit(" ("), F.col("n_chars").cast("string"), F.lit(") people missing or dead")).alias("text"))
    return docs.select("doc_id", text.toll(F.col("text")).alias("toll"))


def tokens_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(text.tokenize(F.col("text"))).alias("n_tokens"))


def top_tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select(F.explode(text.tokenize(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(100)


def item_id_fnv(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.fnv1a_hex(F.col("url")).alias("id"))


def clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(text.clean_text(F.col("html"))).alias("digest"))


def page_snippets(spark: SparkSession, sf: str) -> DataFrame:
    cut = text.cut_at_word(text.clean_text(F.col("html")), 420)
    return table(spark, sf, "pages").select("page_id", F.char_length(cut).alias("n"), F.md5(cut).alias("digest"))


def page_restatements(spark: SparkSession, sf: str) -> DataFrame:
    title = text.clean_text(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    body = text.clean_text(F.regexp_extract("html", "(?s)<h1>(.*?)</article>", 1))
    return table(spark, sf, "pages").select("page_id", text.restates(title, body).alias("restates"))


def social_posts(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").withColumn("_p", F.explode(F.array(text.split_social(F.col("text")))))
    return said.select("conv_id", "turn", F.md5("_p.title").alias("title"), F.md5("_p.snippet").alias("snippet"))


def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    e = workload.events(spark, sf)
    forms = [
        F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")),
        F.concat(F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000")),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")),
        F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" EST")),
        F.lit("no date"),
    ]
    raw = F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int"))
    return e.select("event_id", stamp(times.parse_date(raw)).alias("parsed"))


def ages(spark: SparkSession, sf: str) -> DataFrame:
    return workload.events(spark, sf).select("event_id", times.ago(now_literal(), F.col("ts")).alias("age"))


def short_errors(spark: SparkSession, sf: str) -> DataFrame:
    log = workload.event_fetch_log(spark, sf, book.sources(spark)).filter(F.col("error").isNotNull())
    long = F.concat("error", F.lit(": error sending request for url (https://"), F.col("source_id"), F.lit(".example/a/long/path/to/a/feed.xml)"))
    bare = F.concat(F.lit("E: error sending request for url (https://"), F.col("source_id"), F.lit(".example/a/long/path/to/a/feed.xml)"))
    chosen = F.when(F.col("latency_ms") % 2 == 0, long).otherwise(bare)
    return log.groupBy(text.short_error(chosen).alias("error")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ places


def zone_counts(spark: SparkSession, sf: str) -> DataFrame:
    return workload.points(spark, sf).groupBy(geo.zone_of(F.col("lat"), F.col("lon")).alias("zone")).agg(F.count("*").alias("n"))


def region_counts(spark: SparkSession, sf: str) -> DataFrame:
    return geojoin.within_regions(workload.points(spark, sf), book.regions(spark)).groupBy("region").agg(F.count("*").alias("n"))


def density_grid(spark: SparkSession, sf: str) -> DataFrame:
    return geojoin.density(workload.points(spark, sf), 36, 18)


def nearest_marker(spark: SparkSession, sf: str) -> DataFrame:
    pins = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("marker_id"),
        ((F.col("c_custkey") * 911) % 17000 / 100.0 - 85.0).alias("lat"),
        ((F.col("c_custkey") * 577) % 36000 / 100.0 - 180.0).alias("lon"),
    )
    found = geojoin.nearest_marker(spread(workload.points(spark, sf), "event_id"), pins, 4.0, id_col="event_id")
    return found.select("event_id", "marker_id", F.round("d2", 4).alias("d2"))


def view_windows(spark: SparkSession, sf: str) -> DataFrame:
    p = workload.points(spark, sf)
    window = geo.view_window(F.struct("lat", "lon"), F.lit(6.5))
    return p.select("event_id", *[F.round(window[i], 4).alias(n) for i, n in enumerate(["west", "east", "south", "north"])])


# ------------------------------------------------------------------ items and routing


def dedupe_new_items(spark: SparkSession, sf: str) -> DataFrame:
    items = news(spark, sf).withColumn("fetched", F.col("published"))
    repeated = items.unionByName(items.withColumn("fetched", F.col("published") + F.expr("INTERVAL 1 HOUR")))
    known = items.filter(F.col("published") < CUT)
    return unseen(repeated, known).groupBy("event_type").agg(
        F.count("*").alias("n"), stamp(F.min("fetched")).alias("first"), stamp(F.max("fetched")).alias("last")
    )


def age_gate(spark: SparkSession, sf: str) -> DataFrame:
    items = news_items(spark, sf, classifier())
    kept = young_enough(items, F.lit(LATE).cast("timestamp"))
    return kept.groupBy(F.col("anchor_id").isNotNull().alias("anchored")).agg(F.count("*").alias("n"), stamp(F.min("published")).alias("oldest"))


def assign_exact_tiers(spark: SparkSession, sf: str) -> DataFrame:
    routed = route_exact(news_items(spark, sf, classifier()), stories.anchor_stories(spark))
    return routed.groupBy(F.coalesce("tier", F.lit("free")).alias("tier"), "story_id").agg(F.count("*").alias("n"))


def enriched_items(spark: SparkSession, sf: str) -> DataFrame:
    source_ids = {"view": "bbc", "click": "bsky-ap", "signup": "un-news", "purchase": "yt-ap", "error": "usgs"}
    drafts = news(spark, sf).select(
        workload.mapped(F.col("event_type"), source_ids).alias("source_id"),
        (F.col("published") - F.expr("INTERVAL 1 HOUR")).alias("fetched"),
        "kind",
        F.concat(F.lit("  "), "title", F.lit(" ")).alias("title"),
        F.concat("title", F.lit(", a spokesperson adds")).alias("snippet"),
        F.concat(F.lit("https://news.example/"), F.col("event_id").cast("string")).alias("url"),
        "published",
        F.lit(None).cast(PLACE).alias("place"),
        F.lit(None).cast("int").alias("severity"),
        F.lit(None).cast("string").alias("category_override"),
        F.array().cast("array<struct<k:string,v:string>>").alias("facts"),
        "event_key",
        F.lit(None).cast("string").alias("thumbnail"),
    )
    items = enrich(drafts, book.sources(spark), classifier())
    return items.select(
        "url", "source", "title", "snippet", stamp(F.col("published")).alias("published"), "category", "severity",
        F.col("place.name").alias("place"), grading.fact(F.col("facts"), "toll").alias("toll"), "anchor_id", "relevance",
    )


# ------------------------------------------------------------------ stories


def _one_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Assigned items for queries that read them once: filters reach the scan."""
    return keyed_stories(news_items(spark, sf, classifier()))


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Assigned items, materialised once: the story tables are several aggregations over them."""
    return cut_lineage(_one_pass(spark, sf))


def _news_view(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    assigned = _keyed(spark, sf)
    view = q.story_view(stories.build(assigned), assigned, stories.anchor_stories(spark), now_literal())
    return view, assigned


def story_table(spark: SparkSession, sf: str) -> DataFrame:
    found = stories.story_table(stories.build(_keyed(spark, sf)), stories.anchor_stories(spark), keep_empty_anchors=True)
    return found.select(
        "story_id", "title", "category", "severity", "n_items", "n_videos", "n_sources",
        stamp(F.col("first_seen")).alias("first_seen"), stamp(F.col("last_update")).alias("last_update"),
    )


def retitle(spark: SparkSession, sf: str) -> DataFrame:
    items = cut_lineage(_one_pass(spark, sf).select("story_id", "fetched", "published", "id", "kind", "title"))
    named = items.select("story_id").distinct().join(stories.retitle_state(items), "story_id", "left")
    return named.select("story_id", "retitle", stamp(F.col("retitled_at")).alias("retitled_at"))


def story_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return stories.build(_one_pass(spark, sf)).tokens


def focus_place(spark: SparkSession, sf: str) -> DataFrame:
    found = stories.story_table(stories.build(_keyed(spark, sf)), stories.anchor_stories(spark))
    f = F.col("focus")
    return found.filter(f.isNotNull()).select(
        "story_id", f["name"].alias("place"), f["point"]["lat"].alias("lat"), f["point"]["lon"].alias("lon"), f["radius_deg"].alias("radius_deg")
    )


def focus_edges(spark: SparkSession, sf: str) -> DataFrame:
    state = stories.build(_keyed(spark, sf))
    return q.focus_edges(state, stories.story_table(state, stories.anchor_stories(spark))).select("story_id", "name", "n")


def first_report_alerts(spark: SparkSession, sf: str) -> DataFrame:
    assigned = _keyed(spark, sf)
    earlier = assigned.filter(F.col("published") < "2024-01-01 06:00:00").select("story_id").distinct()
    found = alerts.first_report_alerts(assigned.filter(F.col("published") >= "2024-01-01 06:00:00"), earlier)
    return found.select("story_id", "item_id", "title", "place", "severity", "reason")


def first_reports_all(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.first_report_alerts(_one_pass(spark, sf)).select("story_id", "item_id", "title", "place", "severity", "reason")


def visible_filtered(spark: SparkSession, sf: str) -> DataFrame:
    view, _ = _news_view(spark, sf)
    shown = q.visible(view, now_literal(), min_severity=2, zone="Europe")
    return q.ranked(shown, "severity").select("story_id", "category", "severity", F.round("heat", 4).alias("heat"))


def story_search(spark: SparkSession, sf: str) -> DataFrame:
    view, assigned = _news_view(spark, sf)
    return q.visible(view, now_literal(), needle="GREECE", assigned=assigned).select("story_id", "title")


def story_list(spark: SparkSession, sf: str) -> DataFrame:
    view, assigned = _news_view(spark, sf)
    seen = assigned.groupBy("story_id").agg(F.min("fetched").alias("seen_at"))
    rows = q.story_list(q.visible(view, now_literal()), now_literal(), q.unread_counts(assigned, seen))
    return rows.withColumn("heat", F.round("heat", 4)).drop("last_update")


def category_header(spark: SparkSession, sf: str) -> DataFrame:
    view, _ = _news_view(spark, sf)
    return q.category_counts(q.visible(view, now_literal()), limit=9).select("category", "n")


def overview(spark: SparkSession, sf: str) -> DataFrame:
    view, _ = _news_view(spark, sf)
    status = health.source_status(workload.event_fetch_log(spark, sf, book.sources(spark)))
    row = q.overview(view, status, now_literal())
    return row.select("active", "severe", "items", "worst", "last_age", "sources_ok", "sources_total")


def map_markers(spark: SparkSession, sf: str) -> DataFrame:
    view, _ = _news_view(spark, sf)
    return q.markers(q.visible(view, now_literal()), "heat", selected="ukraine-war").select("story_id", "category", "severity", "lat", "lon")


def probe_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Kept: ids that pass the noise veto and the relevance gate of ``enrich``, each once; all counts are of one reading."""
    read = cut_lineage(keyed_stories(news_items(spark, sf, classifier(), noise=True)))
    view = q.story_view(stories.build(read, titles=False), read, stories.anchor_stories(spark), now_literal())
    kind = workload.mapped(F.col("source"), workload.SOURCE_KINDS)
    relevant = kind.isin(*UNGATED_KINDS) | F.col("anchor_id").isNotNull() | (F.col("relevance") >= MIN_RELEVANCE)
    kept = read.filter(F.col("event_key").isNotNull() | ~F.col("noise")).filter(relevant)
    return q.funnel(read, kept.select("id").distinct(), view)


def probe_stories(spark: SparkSession, sf: str) -> DataFrame:
    view, _ = _news_view(spark, sf)
    return reports.top_stories(q.visible(view, now_literal())).drop("last_update")


def probe_timeline(spark: SparkSession, sf: str) -> DataFrame:
    view, assigned = _news_view(spark, sf)
    return reports.sample_timeline(q.visible(view, now_literal()), assigned, now_literal()).drop("published")


def story_timeline(spark: SparkSession, sf: str) -> DataFrame:
    rows = q.timeline(_one_pass(spark, sf), "ukraine-war", now_literal(), kind="Article")
    return rows.drop("published", "language", "snippet")


def visible_by_category(spark: SparkSession, sf: str) -> DataFrame:
    view, _ = _news_view(spark, sf)
    return q.visible(view, now_literal(), category="NaturalDisaster").select("story_id", "title", "severity")


def zone_places(spark: SparkSession, sf: str) -> DataFrame:
    return q.zone_places(stories.build(_keyed(spark, sf)))


def zone_of_gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    """Events by the zone of the entry they point to, entry by entry."""
    entries = book.gazetteer(spark).select("ord", "name", zone_of(F.col("lat"), F.col("lon")).alias("zone"))
    pointed = workload.events(spark, sf).select((F.col("event_id") % ENTRIES).cast("int").alias("ord"))
    return pointed.join(entries, "ord").groupBy("name", "zone").agg(F.count("*").alias("n"))


def item_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that the detail view shows, for the newest item of each kind."""
    assigned = _keyed(spark, sf)
    newest = assigned.groupBy("kind").agg(F.max(F.struct("published", "id")).alias("x")).select("x.id")
    return q.item_details(assigned, newest).select("id", "story_id", "title", "kind", "category", "severity", stamp(F.col("published")).alias("published"), F.col("place.name").alias("place"))


def alert_sink(spark: SparkSession, sf: str) -> DataFrame:
    """First reports written as a committed version and read back."""
    store = TableStore(spark, new_folder(spark, "alerts"))
    store.save(0, {"alerts": alerts.first_report_alerts(_one_pass(spark, sf))})
    return store.read(0, "alerts").select("story_id", "item_id", "title", "place", "severity", "reason")


def snapshot_reload(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot written and loaded again a month later, when some of its stories are stale."""
    assigned = workload.user_timelines(spark, sf)
    table_ = stories.story_table(stories.build(assigned, titles=False), stories.anchor_stories(spark))
    store = TableStore(spark, new_folder(spark, "snapshot"))
    save_snapshot(store, 0, table_, assigned, now_literal())
    loaded = load_snapshot(store, F.lit(RELOADED).cast("timestamp"))
    return loaded[1].groupBy("story_id").agg(F.count("*").alias("n"), F.min("id").alias("oldest_id"))


def retired_state(spark: SparkSession, sf: str) -> DataFrame:
    """Stories that a maintenance run on a late clock keeps; anchors stay."""
    state = merge.retire(stories.build(_keyed(spark, sf)), stories.anchor_stories(spark), F.lit(LATE).cast("timestamp"))
    return state.core.select("story_id", stamp(F.col("last_update")).alias("last_update"))


# ------------------------------------------------------------------ user timelines (large stories)


def _user_view(spark: SparkSession, sf: str) -> DataFrame:
    assigned = workload.user_timelines(spark, sf)
    return q.story_view(stories.build(assigned, titles=False), assigned, stories.anchor_stories(spark), now_literal())


def _rank(spark: SparkSession, sf: str, sort: str) -> DataFrame:
    view = q.visible(_user_view(spark, sf), now_literal())
    return q.ranked(view, sort, 100).select("story_id", F.round("heat", 4).alias("heat"), "severity", stamp(F.col("last_update")).alias("last_update"))


def heat_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _rank(spark, sf, "heat")


def latest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _rank(spark, sf, "latest")


def severity_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _rank(spark, sf, "severity")


def rank_position(spark: SparkSession, sf: str) -> DataFrame:
    return q.position_of(q.visible(_user_view(spark, sf), now_literal()), "000042", "heat")


def trim_story_items(spark: SparkSession, sf: str) -> DataFrame:
    kept = stories.live_items(workload.user_timelines(spark, sf), 25)
    return kept.groupBy("story_id").agg(F.count("*").alias("n"), F.min("id").alias("oldest_id"), stamp(F.min("published")).alias("oldest"))


def ticker(spark: SparkSession, sf: str) -> DataFrame:
    return q.ticker(workload.user_timelines(spark, sf), now_literal(), 40).select("id", "story_id", stamp(F.col("published")).alias("published"))


def timeline_days(spark: SparkSession, sf: str) -> DataFrame:
    return q.timeline_days(workload.user_timelines(spark, sf)).withColumn("day", F.col("day").cast("string"))


def unread_counts(spark: SparkSession, sf: str) -> DataFrame:
    assigned = workload.user_timelines(spark, sf)
    marks = assigned.filter(F.col("kind") == "Video").groupBy("story_id").agg(F.max("fetched").alias("seen_at"))
    return q.unread_counts(assigned, marks)


def snapshot_rows(spark: SparkSession, sf: str) -> DataFrame:
    assigned = workload.user_timelines(spark, sf)
    table_ = stories.story_table(stories.build(assigned, titles=False), stories.anchor_stories(spark))
    fresh = table_.filter(~times.is_stale(F.col("last_update"), now_literal()))
    kept = fresh.orderBy(F.desc("last_update"), "story_id").limit(SAVED_STORIES).select("story_id")
    items = stories.live_items(assigned.join(F.broadcast(kept), "story_id", "left_semi"), SAVED_ITEMS)
    return items.groupBy("story_id").agg(F.count("*").alias("n"), F.min("id").alias("oldest_id"))


def restore_merge(spark: SparkSession, sf: str) -> DataFrame:
    assigned = workload.user_timelines(spark, sf)
    merged = restore_items(assigned.filter(F.col("published") < "2024-01-20"), assigned.filter(F.col("published") >= "2024-01-10"))
    return merged.groupBy("story_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


# ------------------------------------------------------------------ similarity


def _best_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Later free items, and earlier stories by source and template."""
    items = _keyed(spark, sf).filter(F.col("event_key").isNull() & F.col("anchor_id").isNull())
    later = items.filter(F.col("published") >= CUT).select(
        "id", "tokens", "category", F.col("place.point.lat").alias("lat"), F.col("place.point.lon").alias("lon"), "published"
    )
    state = stories.build(items.filter(F.col("published") < CUT))
    table_ = stories.story_table(state, stories.anchor_stories(spark))
    profiles = table_.select("story_id", "category", F.col("focus.point.lat").alias("lat"), F.col("focus.point.lon").alias("lon"), "last_update")
    return cut_lineage(later), cut_lineage(profiles), cut_lineage(state.tokens)


def similarity_best(spark: SparkSession, sf: str) -> DataFrame:
    later, profiles, postings = _best_inputs(spark, sf)
    return best_story(scored_pairs(later, profiles, postings)).withColumn("score", F.round("score", 6))


def similarity_best_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The same result through the path for frequent words."""
    later, profiles, postings = _best_inputs(spark, sf)
    return best_story(scored_pairs(later, profiles, postings, hot_df=20)).withColumn("score", F.round("score", 6))


def _weekly_stories(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stories per source, template and week, so that many of them converge."""
    week = F.floor(F.dayofmonth("published") / 8).cast("string")
    items = _keyed(spark, sf).filter(F.col("event_key").isNull() & F.col("anchor_id").isNull())
    assigned = items.withColumn("story_id", F.concat_ws("-", F.lit("w"), "source", F.col("template").cast("string"), week))
    state = stories.build(assigned)
    return cut_lineage(stories.story_table(state, stories.anchor_stories(spark))), cut_lineage(state.tokens)


def merge_pairs(spark: SparkSession, sf: str) -> DataFrame:
    table_, postings = _weekly_stories(spark, sf)
    found = merge.all_pairs(merge.mergeable(table_), postings)
    return found.select("a", "b", F.round("overlap", 6).alias("overlap"))


def merged_state(spark: SparkSession, sf: str) -> DataFrame:
    """The stories that are left after their duplicates are folded in."""
    week = F.floor(F.dayofmonth("published") / 8).cast("string")
    items = _keyed(spark, sf).filter(F.col("event_key").isNull() & F.col("anchor_id").isNull())
    anchors = stories.anchor_stories(spark)
    state = stories.build(items.withColumn("story_id", F.concat_ws("-", F.lit("w"), "source", F.col("template").cast("string"), week))).map(cut_lineage)
    moves = cut_lineage(merge.merge_moves(stories.story_table(state, anchors), state.tokens))
    core = stories.rekey(state, moves).core
    return core.select("story_id", "n_items", "n_videos", "severity", stamp(F.col("first_seen")).alias("first_seen"), stamp(F.col("last_update")).alias("last_update"))


def index_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """What the stored index of words, written in two versions, holds on the words of six headlines."""
    items = _keyed(spark, sf)
    index = PostingIndex(TableStore(spark, new_folder(spark, "index")))
    for version in (0, 1):
        tokens = cut_lineage(stories.build(items.filter(F.pmod("event_id", F.lit(3)).isin([0, 1]) == (version == 0)), titles=False).tokens)
        index.store.save(version, index.added(tokens, index.lookup(tokens, version).postings))
    found = index.lookup(items.filter("template < 6").select(F.explode("tokens").alias("token")))
    return found.postings.join(found.frequencies, "token").join(found.sizes, "story_id").select("story_id", "token", "n", "df", "n_tokens", "n_total")


def merge_moves(spark: SparkSession, sf: str) -> DataFrame:
    table_, postings = _weekly_stories(spark, sf)
    return merge.merge_moves(table_, postings)


def story_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """The whole news table through all four tiers."""
    anchors = stories.anchor_stories(spark)
    result = assign(news_items(spark, sf, classifier()), stories.empty_state(spark), anchors, now_literal())
    return result.items.select("id", "story_id", "tier", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ sources and health


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return workload.event_fetch_log(spark, sf, book.sources(spark))


def source_health(spark: SparkSession, sf: str) -> DataFrame:
    s = health.source_status(_log(spark, sf))
    return s.select(
        "source_id", "fetches", "failures", "items_total", "last_items", stamp(F.col("last_ok")).alias("last_ok"), "last_error", "latency_ms", "healthy"
    )


def poll_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = health.poll_plan(health.source_status(_log(spark, sf)), book.sources(spark))
    return plan.select("source_id", "factor", "wait_s", stamp(F.col("next_poll_at")).alias("next_poll_at"))


def health_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return health.health_by_kind(health.source_status(_log(spark, sf)), book.sources(spark))


def source_table(spark: SparkSession, sf: str) -> DataFrame:
    return reports.source_table(_log(spark, sf), book.sources(spark), now_literal())


def source_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Fetches of the sources that are on by default."""
    active = select_sources(book.sources(spark))
    return _log(spark, sf).join(active, "source_id").groupBy("source_id", "name").agg(F.count("*").alias("fetches"))


def _drafts(spark: SparkSession, sf: str, fmt: str) -> DataFrame:
    return parse_payloads(workload.payloads(spark, sf, fmt), book.sources(spark), classifier()).withColumn("published", stamp(F.col("published")))


def _facts(c: str = "facts") -> Column:
    return F.array_join(F.transform(c, lambda f: F.concat(f["k"], F.lit("="), f["v"])), ";").alias("facts")


def feed_parse_rss(spark: SparkSession, sf: str) -> DataFrame:
    return _drafts(spark, sf, "feed").select("kind", "title", "snippet", "url", "published", "thumbnail", _facts())


def feed_parse_atom(spark: SparkSession, sf: str) -> DataFrame:
    return _drafts(spark, sf, "atom").select("kind", "title", "snippet", "url", "published", "thumbnail", _facts())


def feed_parse_hazards(spark: SparkSession, sf: str) -> DataFrame:
    return _drafts(spark, sf, "gdacs").select(
        "title", "url", "published", "severity", "category_override", "event_key", F.col("place.name").alias("place"),
        F.col("place.point.lat").alias("lat"), F.col("place.point.lon").alias("lon"), F.col("place.radius_deg").alias("radius_deg"), _facts(),
    )


def feed_parse_quakes(spark: SparkSession, sf: str) -> DataFrame:
    return _drafts(spark, sf, "usgs").select(
        "title", "snippet", "url", "published", "severity", "event_key", F.col("place.name").alias("place"),
        F.round("place.radius_deg", 4).alias("radius_deg"), _facts(),
    )


def feed_parse_natural(spark: SparkSession, sf: str) -> DataFrame:
    return _drafts(spark, sf, "eonet").select(
        "title", "snippet", "url", "published", "severity", "event_key", F.col("place.point.lat").alias("lat"), F.col("place.point.lon").alias("lon"), _facts()
    )


def feed_parse_index(spark: SparkSession, sf: str) -> DataFrame:
    return _drafts(spark, sf, "gdelt").select("title", "url", "published", F.col("place.name").alias("place"), _facts())


def feed_parse_author(spark: SparkSession, sf: str) -> DataFrame:
    return _drafts(spark, sf, "bluesky").select("title", "snippet", "url", "published", _facts())


def feed_parse_hashtag(spark: SparkSession, sf: str) -> DataFrame:
    return _drafts(spark, sf, "mastodon").select("title", "snippet", "url", "published", _facts())


def feed_parse_channel(spark: SparkSession, sf: str) -> DataFrame:
    return _drafts(spark, sf, "telegram").select("kind", "title", "snippet", "url", "published", _facts())


def feed_union(spark: SparkSession, sf: str) -> DataFrame:
    """All formats dispatched in one pass, counted per source."""
    parts = [workload.payloads(spark, sf, f) for f in ("feed", "atom", "gdacs", "usgs", "eonet", "gdelt", "bluesky", "mastodon", "telegram")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    drafts = parse_payloads(every, book.sources(spark), classifier())
    return drafts.groupBy("source_id", "kind").agg(F.count("*").alias("n"))


def payload_log(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads with failures in them: rate limits, bad status, empty bodies."""
    good = workload.payloads(spark, sf, "gdelt")
    # The payload's first article number tells the payloads apart.
    number = F.regexp_extract("body", r"news\.example/(\d+)", 1).cast("bigint") / workload.PER_PAYLOAD
    turn = F.floor(number) % 4
    broken = good.withColumn("_turn", turn).withColumns({
        "body": F.when(F.col("_turn") == 0, "Please limit requests").when(F.col("_turn") == 1, " ").otherwise(F.col("body")),
        "http_status": F.when(F.col("_turn") == 2, 503).otherwise(200),
    })
    return fetch_log(broken.drop("_turn"), book.sources(spark)).groupBy("source_id", "ok", "error").agg(F.count("*").alias("n"))


def language_flag(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return language.foreign(docs.withColumnRenamed("doc_id", "id"), language.train(docs)).withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        category_counts, category_scores, anchor_routing, noise_veto, relevance_gate, locate_best, locate_all_rank, name_lookup,
        name_lookup_join, nearest_place, dict_hits_documents, dict_pattern_documents, rules_on_documents, explain_news,
        severity_documents, severity_news, toll_news, toll_documents, tokens_per_doc, top_tokens, item_id_fnv, clean_pages,
        page_snippets, page_restatements, social_posts, parsed_dates, ages, short_errors, zone_counts, region_counts, density_grid,
        nearest_marker, view_windows, dedupe_new_items, age_gate, assign_exact_tiers, enriched_items, story_table, retitle,
        story_centroids, focus_place, focus_edges, first_report_alerts, first_reports_all, visible_filtered, story_search, story_list,
        category_header, overview, map_markers, probe_funnel, probe_stories, probe_timeline, story_timeline, visible_by_category,
        zone_places, zone_of_gazetteer, item_detail, alert_sink, snapshot_reload, retired_state, heat_rank, latest_rank,
        severity_rank, rank_position, trim_story_items, ticker, timeline_days, unread_counts, snapshot_rows, restore_merge,
        similarity_best, similarity_best_pruned, merge_pairs, merge_moves, merged_state, index_lookup, story_assignment, source_health, poll_plan, health_by_kind,
        source_table, source_selection, feed_parse_rss, feed_parse_atom, feed_parse_hazards, feed_parse_quakes, feed_parse_natural,
        feed_parse_index, feed_parse_author, feed_parse_hashtag, feed_parse_channel, feed_union, payload_log, language_flag,
    )
}
