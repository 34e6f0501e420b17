"""Read queries over stories and their items.

``story_view`` builds one row per story with everything the lists need; the other
functions filter, rank and summarise it.  ``now`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions import grading
from newsweft.functions.geo import zone_of
from newsweft.functions.text import cut_plain, short_title
from newsweft.functions.times import ago, is_stale, whole_minutes
from newsweft.operators import stories
from newsweft.operators.stories import HEAT_ITEMS, LIVE_ITEMS, StoryState, live_items

SEARCH_ITEMS = 40
TICKER_ITEMS = 3
TICKER_HOURS = 6
MAP_MARKERS = 60


def live_summary(assigned: DataFrame, now: Column, keep: int = LIVE_ITEMS) -> DataFrame:
    """Per story over its newest ``keep`` items: counts, sources and the recency part of heat."""
    live = live_items(assigned, keep)
    hours = whole_minutes(now, F.col("published")) / 60.0
    recency = F.when(hours < 0, 1.0).otherwise(1.0 / (1.0 + hours / 6.0))
    # Grouped by the key the window is already partitioned by: no further shuffle.
    return live.groupBy("story_id").agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("kind") == "Video").alias("n_videos"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.sum(F.when(F.col("recency") <= HEAT_ITEMS, recency)).alias("recency_sum"),
    )


def heat(recency_sum: Column, n_sources: Column, severity: Column, last_update: Column, now: Column) -> Column:
    """Recency, times the root of distinct sources, times severity weight, damped by idle time."""
    idle = whole_minutes(now, last_update) / 60.0
    staleness = 1.0 / (1.0 + F.greatest(idle / 12.0, F.lit(0.0)))
    return recency_sum * F.sqrt(n_sources) * grading.severity_weight(severity) * staleness


def story_view(state: StoryState, assigned: DataFrame, anchors: DataFrame, now: Column, anchor_epoch: Column | None = None) -> DataFrame:
    """Stories with counts over their live items, sources and heat."""
    table = stories.story_table(state, anchors, anchor_epoch=anchor_epoch).drop("n_items", "n_videos", "n_sources")
    joined = table.join(live_summary(assigned, now), "story_id")
    return joined.withColumn("n_sources", F.size("sources")).withColumn(
        "heat", heat(F.col("recency_sum"), F.col("n_sources"), F.col("severity"), F.col("last_update"), now)
    )


def matching_stories(assigned: DataFrame, needle: str) -> DataFrame:
    """Story ids whose newest 40 items name the needle in title or place."""
    low = needle.lower()
    recent = live_items(assigned, SEARCH_ITEMS)
    hit = F.contains(F.lower("title"), F.lit(low)) | F.coalesce(F.contains(F.lower("place.name"), F.lit(low)), F.lit(False))
    return recent.filter(hit).select("story_id").distinct()


def visible(
    view: DataFrame,
    now: Column,
    category: str | None = None,
    min_severity: int | None = None,
    zone: str | None = None,
    needle: str = "",
    assigned: DataFrame | None = None,
) -> DataFrame:
    """Stories with items and a recent update that pass the given filters."""
    shown = view.filter((F.col("n_items") > 0) & ~is_stale(F.col("last_update"), now))
    if category is not None:
        shown = shown.filter(F.col("category") == category)
    if min_severity is not None:
        shown = shown.filter(F.col("severity") >= min_severity)
    if zone is not None:
        shown = shown.filter(zone_of(F.col("focus.point.lat"), F.col("focus.point.lon")) == zone)
    if needle:
        if assigned is None:
            raise ValueError("a search reads the assigned items")
        by_item = matching_stories(assigned, needle).withColumn("_hit", F.lit(True))
        in_title = F.contains(F.lower("title"), F.lit(needle.lower()))
        shown = shown.join(by_item, "story_id", "left").filter(in_title | F.col("_hit")).drop("_hit")
    return shown


def rank_order(sort: str) -> list[Column]:
    """Sort keys: ``heat``, ``latest`` or ``severity``; every order ends with the story id."""
    latest = [F.desc("last_update"), F.asc("story_id")]
    return {"heat": [F.desc("heat"), *latest], "latest": latest, "severity": [F.desc("severity"), *latest]}[sort]


def ranked(shown: DataFrame, sort: str = "latest", limit: int | None = None) -> DataFrame:
    ordered = shown.orderBy(*rank_order(sort))
    return ordered if limit is None else ordered.limit(limit)


def position_of(shown: DataFrame, story_id: str, sort: str = "latest") -> DataFrame:
    """1-based place of a story in the list: one more than the stories that sort before it.

    Counting needs one aggregate; numbering the whole list would need a single task.
    """
    keys = {"heat": ["heat", "last_update"], "latest": ["last_update"], "severity": ["severity", "last_update"]}[sort]
    own = shown.filter(F.col("story_id") == story_id).select(F.col("story_id").alias("_id"), *[F.col(k).alias(f"_{k}") for k in keys])
    before, tied = F.lit(False), F.lit(True)
    for k in keys:
        before = before | (tied & (F.col(k) > F.col(f"_{k}")))
        tied = tied & (F.col(k) == F.col(f"_{k}"))
    before = before | (tied & (F.col("story_id") < F.col("_id")))
    # ``own`` is a single row.
    return shown.join(F.broadcast(own), F.lit(True)).groupBy(F.col("_id").alias("story_id")).agg((F.count_if(before) + 1).alias("position"))


def story_list(shown: DataFrame, now: Column, unread: DataFrame | None = None, title_chars: int = 60) -> DataFrame:
    """Display rows of the story list."""
    rows = shown if unread is None else shown.join(unread, "story_id", "left")
    count = F.lit(0).cast("bigint") if unread is None else F.coalesce("unread", F.lit(0))
    return rows.select(
        "story_id",
        grading.heat_band(F.col("heat")).alias("band"),
        grading.category_tag(F.col("category")).alias("tag"),
        short_title(F.col("title"), title_chars).alias("title"),
        count.alias("unread"),
        cut_plain(F.coalesce("focus.name", F.lit("unlocated")), 18).alias("place"),
        "n_items",
        "n_sources",
        ago(now, F.col("last_update")).alias("age"),
        "n_videos",
        grading.severity_label(F.col("severity")).alias("severity"),
        "heat",
        "last_update",
    )


def unread_counts(assigned: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Items that arrived after the reader's bookmark (story_id, seen_at); all items without one."""
    joined = assigned.select("story_id", "fetched").join(bookmarks.select("story_id", "seen_at"), "story_id", "left")
    later = F.col("seen_at").isNull() | (F.col("fetched") > F.col("seen_at"))
    return joined.groupBy("story_id").agg(F.count_if(later).alias("unread"))


def timeline(assigned: DataFrame, story_id: str, now: Column, kind: str | None = None) -> DataFrame:
    """Rows of one story's timeline, newest first (at most the live 400)."""
    own = assigned.filter(F.col("story_id") == story_id).orderBy(F.desc("published"), "id").limit(LIVE_ITEMS)
    if kind is not None:
        own = own.filter(F.col("kind") == kind)
    shown_facts = F.filter("facts", lambda f: ~f["k"].isin("anchor", "post"))
    return own.select(
        "id",
        ago(now, F.col("published")).alias("age"),
        "kind",
        cut_plain(F.col("source"), 22).alias("source"),
        F.when(F.col("severity") >= grading.SEVERE, grading.severity_label(F.col("severity"))).alias("severity"),
        "language",
        "title",
        "snippet",
        F.col("place.name").alias("place"),
        F.array_join(F.transform(shown_facts, lambda f: F.concat(f["k"], F.lit(": "), f["v"])), "  ·  ").alias("facts"),
        "published",
    ).orderBy(F.desc("published"), "id")


def timeline_days(assigned: DataFrame) -> DataFrame:
    """Day separators: per story and day the first item shown under it and how many follow.

    A separator stands where the date changes in newest-first order, which is the newest
    item of each date; as an aggregate it combines on the map side for hot stories.
    """
    newest = F.max(F.struct("published", "id"))
    return assigned.groupBy("story_id", F.to_date("published").alias("day")).agg(
        newest["id"].alias("first_id"), F.count("*").alias("n_items")
    )


def item_detail(assigned: DataFrame, item_id: str) -> DataFrame:
    return assigned.filter(F.col("id") == item_id)


def item_details(assigned: DataFrame, ids: DataFrame) -> DataFrame:
    """The items named in ``ids`` (column ``id``), in one pass."""
    return assigned.join(ids.select("id"), "id", "left_semi")


def ticker(assigned: DataFrame, now: Column, limit: int) -> DataFrame:
    """Newest items across stories: three per story, published within six hours."""
    recent = F.col("published") > now - F.expr(f"INTERVAL {TICKER_HOURS} HOURS")
    # The six-hour filter commutes with "newest three", so it runs first and can prune the scan.
    top = live_items(assigned.filter(recent), TICKER_ITEMS)
    return top.drop("recency").orderBy(F.desc("published"), "id").limit(limit)


def category_counts(shown: DataFrame, limit: int | None = 9) -> DataFrame:
    """Stories per category, most first, then category order."""
    counts = shown.groupBy("category").agg(F.count("*").alias("n")).withColumn("cat_ord", grading.category_ord(F.col("category")))
    ordered = counts.orderBy(F.desc("n"), "cat_ord")
    return ordered if limit is None else ordered.limit(limit)


def worst_severity(view: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    recent = (F.col("n_items") > 0) & ~is_stale(F.col("last_update"), now, hours)
    return view.agg(F.coalesce(F.max(F.when(recent, F.col("severity"))), F.lit(0)).alias("worst"))


def overview(view: DataFrame, status: DataFrame | None, now: Column) -> DataFrame:
    """Header row: active, severe or worse, items, worst severity, age of the last item, sources ok/total."""
    shown = (F.col("n_items") > 0) & ~is_stale(F.col("last_update"), now)
    recent = (F.col("n_items") > 0) & ~is_stale(F.col("last_update"), now, 12)
    row = view.agg(
        F.count_if(shown).alias("active"),
        F.count_if(shown & (F.col("severity") >= grading.SEVERE)).alias("severe"),
        F.coalesce(F.sum("n_items"), F.lit(0)).alias("items"),
        F.coalesce(F.max(F.when(recent, F.col("severity"))), F.lit(0)).alias("worst"),
        F.max("last_update").alias("last_update"),
    ).withColumn("last_age", ago(now, F.col("last_update")))
    if status is None:
        return row
    totals = status.agg(F.count_if("healthy").alias("sources_ok"), F.count("*").alias("sources_total"))
    return row.crossJoin(totals)  # one row each


def totals(view: DataFrame) -> DataFrame:
    return view.agg(F.count("*").alias("stories"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("items"))


def funnel(items_seen: DataFrame, assigned: DataFrame, view: DataFrame) -> DataFrame:
    """Seen, kept, stories, located stories, videos; one row."""
    seen = items_seen.agg(F.count("*").alias("seen"))
    kept = assigned.agg(F.count("*").alias("kept"))
    summary = view.agg(
        F.count_if(F.col("n_items") > 0).alias("stories"),
        F.count_if((F.col("n_items") > 0) & F.col("focus").isNotNull()).alias("located"),
        F.coalesce(F.sum("n_videos"), F.lit(0)).alias("videos"),
    )
    return seen.crossJoin(kept).crossJoin(summary)  # one row each


def markers(shown: DataFrame, sort: str = "latest", selected: str | None = None) -> DataFrame:
    """Map markers: the top 60 visible stories that have a focus, plus the selected one."""
    columns = ["story_id", "title", "category", "severity", F.col("focus.point.lat").alias("lat"), F.col("focus.point.lon").alias("lon")]
    top = ranked(shown, sort, MAP_MARKERS).filter(F.col("focus").isNotNull()).select(*columns)
    if selected is None:
        return top
    own = shown.filter((F.col("story_id") == selected) & F.col("focus").isNotNull()).select(*columns)
    return top.unionByName(own).dropDuplicates(["story_id"])


def zone_places(state: StoryState) -> DataFrame:
    """Every place a story names, with its first point and count."""
    return state.places.select("story_id", "name", F.col("first.lat").alias("lat"), F.col("first.lon").alias("lon"), "n")


def focus_edges(state: StoryState, table: DataFrame) -> DataFrame:
    """Lines from a story's focus to its other places (at least 0.01 degrees apart on an axis)."""
    focus = table.filter(F.col("focus").isNotNull()).select(
        "story_id", F.col("focus.point.lat").alias("f_lat"), F.col("focus.point.lon").alias("f_lon")
    )
    apart = (F.abs(F.col("lat") - F.col("f_lat")) >= 0.01) | (F.abs(F.col("lon") - F.col("f_lon")) >= 0.01)
    return zone_places(state).join(focus, "story_id").filter(apart)
