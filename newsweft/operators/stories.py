"""Story state as mergeable aggregates, and the story table built from it.

A story is never held as one object.  Four tables describe all stories, each the
result of an aggregation with a combinable form, so a hot story (a war that owns a
third of all items) is pre-aggregated on every task before anything is shuffled:

* ``core``    one row per story: founder, times, severity, counts, title state
* ``tokens``  one row per (story, token)
* ``places``  one row per (story, place name)
* ``sources`` one row per (story, source)

``build`` makes them from assigned items and ``merge`` adds a later batch.
Assigned items are items with ``story_id``; arrival order is (fetched, published, id).
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsweft.rules.book import RuleBook, local_table
from newsweft.schemas import PLACE

EVENT_PREFIX = "ev-"
LIVE_ITEMS = 400  # fixed value: items a story keeps
HEAT_ITEMS = 60  # fixed value: newest items that count for heat
DEFAULT_RADIUS = 3.0

ARRIVAL = "struct<fetched:timestamp,published:timestamp,id:string>"

CORE = (
    f"story_id string, founder struct<arrival:{ARRIVAL},title:string,category:string>, first_seen timestamp, "
    "last_update timestamp, severity int, n_items bigint, n_videos bigint, retitled_at timestamp, retitle string"
)
TOKENS = "story_id string, token string, n bigint"
PLACES = (
    f"story_id string, name string, n bigint, last_published timestamp, "
    f"first struct<arrival:{ARRIVAL},lat:double,lon:double>, "
    f"newest struct<published:timestamp,id:string,radius_deg:double,bbox:array<double>>"
)
SOURCES = "story_id string, source string, n bigint"


def arrival() -> Column:
    return F.struct("fetched", "published", "id")


@dataclass(frozen=True)
class StoryState:
    core: DataFrame
    tokens: DataFrame
    places: DataFrame
    sources: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def map(self, change) -> "StoryState":
        return StoryState(**{name: change(table) for name, table in self.tables().items()})


def empty_state(spark: SparkSession) -> StoryState:
    def none(schema: str) -> DataFrame:
        return spark.createDataFrame([], schema)

    return StoryState(none(CORE), none(TOKENS), none(PLACES), none(SOURCES))


# ------------------------------------------------------------------ titles


def retitle_state(assigned: DataFrame) -> DataFrame:
    """Per story: newest Alert that was newer than everything before it, in arrival order.

    Only alerts that set a new maximum of ``published`` rename a story, which is a
    running maximum over arrival order.  To keep a hot story off a single task the
    rows are range-partitioned by (story, arrival); every (story, slice) reduces to
    its maximum and its last renaming alert, and the slices combine in order: an
    alert of a later slice counts only when it beats the maximum before the slice.

    Stories without an Alert have no row: their items are left before the sort.
    """
    spark = assigned.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    alerted = assigned.filter(F.col("kind") == "Alert").select("story_id").distinct()
    ranged = (
        assigned.select("story_id", "fetched", "published", "id", "kind", "title")
        .join(alerted, "story_id", "left_semi")
        .repartitionByRange(slices, "story_id", "fetched", "published", "id")
        .withColumn("_slice", F.spark_partition_id())
    )
    before = Window.partitionBy("story_id", "_slice").orderBy("fetched", "published", "id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    marked = ranged.withColumn("_max", F.max("published").over(before))
    founder_or_record = F.col("_max").isNull() | (F.col("published") > F.col("_max"))
    renames = (F.col("kind") == "Alert") & founder_or_record
    per_slice = marked.groupBy("story_id", "_slice").agg(
        F.max("published").alias("_top"),
        F.max(F.when(renames, F.col("published"))).alias("_at"),
        F.max_by(F.when(renames, F.col("title")), F.when(renames, F.col("published"))).alias("_title"),
        F.min(arrival()).alias("_first"),
    )
    earlier = Window.partitionBy("story_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    combined = per_slice.withColumn("_seen", F.max("_top").over(earlier))
    # The founder of the story itself sets the title, it does not rename it; both agree for alerts.
    valid = F.col("_at").isNotNull() & (F.col("_seen").isNull() | (F.col("_at") > F.col("_seen")))
    return combined.groupBy("story_id").agg(
        F.max(F.when(valid, F.col("_at"))).alias("retitled_at"),
        F.max_by(F.when(valid, F.col("_title")), F.when(valid, F.col("_at"))).alias("retitle"),
    )


# ------------------------------------------------------------------ build and merge


def build(assigned: DataFrame, titles: bool = True) -> StoryState:
    """State of the stories that these items make up.

    Without ``titles`` the renaming pass is left out and stories keep their founder's
    title; rankings that show no title need no second pass over the items.
    """
    facts = assigned.groupBy("story_id").agg(
        F.min(F.struct(arrival().alias("arrival"), F.col("title").alias("title"), F.col("category").alias("category"))).alias("founder"),
        F.min("published").alias("first_seen"),
        F.max("published").alias("last_update"),
        F.max("severity").alias("severity"),
        F.count("*").alias("n_items"),
        F.count_if(F.col("kind") == "Video").alias("n_videos"),
    )
    if titles:
        core = facts.join(retitle_state(assigned), "story_id", "left")
    else:
        core = facts.withColumns({"retitled_at": F.lit(None).cast("timestamp"), "retitle": F.lit(None).cast("string")})
    tokens = (
        assigned.select("story_id", F.explode("tokens").alias("token")).groupBy("story_id", "token").agg(F.count("*").alias("n"))
    )
    placed = assigned.filter(F.col("place").isNotNull()).select("*", F.col("place.name").alias("name"))
    places = placed.groupBy("story_id", "name").agg(
        F.count("*").alias("n"),
        F.max("published").alias("last_published"),
        F.min(F.struct(arrival().alias("arrival"), F.col("place.point.lat").alias("lat"), F.col("place.point.lon").alias("lon"))).alias("first"),
        F.max_by(
            F.struct("published", "id", F.col("place.radius_deg").alias("radius_deg"), F.col("place.bbox").alias("bbox")),
            F.struct("published", "id"),
        ).alias("newest"),
    )
    sources = assigned.groupBy("story_id", "source").agg(F.count("*").alias("n"))
    return StoryState(core, tokens, places, sources)


def combine(parts: list[StoryState]) -> StoryState:
    """One state from states whose items arrived in the given order."""

    def stack(name: str) -> DataFrame:
        tables = [getattr(p, name).withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
        result = tables[0]
        for t in tables[1:]:
            result = result.unionByName(t)
        return result

    # Parts per story are few (one per batch or merged story), so this window stays small.
    before = Window.partitionBy("story_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return _reduce(stack("core"), before, stack("tokens"), stack("places"), stack("sources"))


def rekey(state: StoryState, moves: DataFrame) -> StoryState:
    """Fold stories into others: ``moves`` has (story_id, target_id).

    A folded story's items arrive at the target after its own, newest first, so it
    renames the target only when its newest item is the renaming alert.
    """
    renamed = moves.select("story_id", "target_id")

    def moved(table: DataFrame) -> DataFrame:
        return (
            table.join(renamed, "story_id", "left")
            .withColumn("_home", F.col("target_id").isNull())
            .withColumn("story_id", F.coalesce("target_id", "story_id"))
            .drop("target_id")
        )

    core = moved(state.core)
    keeps_title = F.col("_home") | (F.col("retitled_at") == F.col("last_update"))
    core = core.withColumns({c: F.when(keeps_title, F.col(c)) for c in ("retitled_at", "retitle")})
    core = core.withColumn("_part", F.struct((~F.col("_home")).alias("late"), F.col("founder.arrival").alias("arrival")))
    before = Window.partitionBy("story_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    rest = [moved(t).withColumn("_part", ~F.col("_home")) for t in (state.tokens, state.places, state.sources)]
    return _reduce(core, before, *rest)


def _reduce(core: DataFrame, before, tokens: DataFrame, places: DataFrame, sources: DataFrame) -> StoryState:
    seen = core.withColumn("_seen", F.max("last_update").over(before))
    # A renaming alert of a later part counts only when it beats everything before that part.
    valid = F.col("_seen").isNull() | (F.col("retitled_at") > F.col("_seen"))
    merged_core = seen.groupBy("story_id").agg(
        F.min_by("founder", "_part").alias("founder"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_update").alias("last_update"),
        F.max("severity").alias("severity"),
        F.sum("n_items").alias("n_items"),
        F.sum("n_videos").alias("n_videos"),
        F.max(F.when(valid, F.col("retitled_at"))).alias("retitled_at"),
        F.max_by(F.when(valid, F.col("retitle")), F.when(valid, F.col("retitled_at"))).alias("retitle"),
    )
    merged_places = places.groupBy("story_id", "name").agg(
        F.sum("n").alias("n"),
        F.max("last_published").alias("last_published"),
        F.min_by("first", F.struct("_part", "first")).alias("first"),
        F.max_by("newest", F.struct("newest.published", "newest.id")).alias("newest"),
    )
    return StoryState(
        merged_core,
        tokens.groupBy("story_id", "token").agg(F.sum("n").alias("n")),
        merged_places,
        sources.groupBy("story_id", "source").agg(F.sum("n").alias("n")),
    )


def merge(old: StoryState, new: StoryState) -> StoryState:
    """Old state plus a later batch."""
    return combine([old, new])


# ------------------------------------------------------------------ anchors and focus


def anchor_stories(spark: SparkSession, book: RuleBook | None = None) -> DataFrame:
    """Named situations with their pinned home place; they exist before their first item."""
    b = book or RuleBook()
    rows = []
    for a in b.anchors:
        p = b.lookup(a.home)
        home = None if p is None else {"name": p.name, "point": {"lat": p.lat, "lon": p.lon}, "radius_deg": p.radius_deg, "bbox": None}
        rows.append((a.id, a.title, a.category, home))
    return local_table(spark, rows, f"anchor_id string, title string, category string, home {PLACE}")


def top_places(places: DataFrame) -> DataFrame:
    """Most frequent place of each story: (n, last_published, name) descending."""
    best = places.groupBy("story_id").agg(
        F.min_by(F.struct("name", "first", "newest"), F.struct(-F.col("n"), -F.unix_micros("last_published"), F.col("name"))).alias("best")
    )
    radius = F.coalesce("best.newest.radius_deg", F.lit(DEFAULT_RADIUS))
    focus = F.struct(
        F.col("best.name").alias("name"),
        F.struct(F.col("best.first.lat").alias("lat"), F.col("best.first.lon").alias("lon")).alias("point"),
        radius.alias("radius_deg"),
        F.col("best.newest.bbox").alias("bbox"),
    )
    return best.select("story_id", focus.alias("focus"))


def story_table(
    state: StoryState, anchors: DataFrame, keep_empty_anchors: bool = False, anchor_epoch: Column | None = None
) -> DataFrame:
    """One row per story: title, category, times, severity, counts, home, focus.

    An anchor keeps its own title, category and home.  With ``keep_empty_anchors``
    the placeholders that have no item yet are listed with ``n_items`` 0.
    ``anchor_epoch`` is the time the anchors were set up: their first_seen is never
    later and their last_update never earlier.
    """
    named = anchors.select(
        F.col("anchor_id").alias("story_id"), "anchor_id", F.col("title").alias("_title"), F.col("category").alias("_category"), "home"
    )
    counted = state.sources.groupBy("story_id").agg(F.count("*").alias("n_sources"))
    facts = (
        state.core.join(counted, "story_id", "left")
        .join(top_places(state.places), "story_id", "left")
        .join(named, "story_id", "left")
        .select(
            "story_id",
            F.coalesce("_title", "retitle", "founder.title").alias("title"),
            F.coalesce("_category", "founder.category").alias("category"),
            "anchor_id",
            "first_seen",
            "last_update",
            "severity",
            "n_items",
            "n_videos",
            F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
            "home",
            F.coalesce("home", "focus").alias("focus"),
        )
    )
    if keep_empty_anchors:
        # Anchors with items are found by a semi join against the small anchor table first.
        busy = state.core.select("story_id").join(named.select("story_id"), "story_id", "left_semi")
        zero = F.lit(0).cast("bigint")
        empty = named.join(busy, "story_id", "left_anti").select(
            "story_id",
            F.col("_title").alias("title"),
            F.col("_category").alias("category"),
            "anchor_id",
            F.lit(None).cast("timestamp").alias("first_seen"),
            F.lit(None).cast("timestamp").alias("last_update"),
            F.lit(0).alias("severity"),
            zero.alias("n_items"),
            zero.alias("n_videos"),
            zero.alias("n_sources"),
            "home",
            F.col("home").alias("focus"),
        )
        facts = facts.unionByName(empty)
    if anchor_epoch is not None:
        is_anchor = F.col("anchor_id").isNotNull()
        facts = facts.withColumn(
            "first_seen", F.when(is_anchor, F.least("first_seen", anchor_epoch)).otherwise(F.col("first_seen"))
        ).withColumn("last_update", F.when(is_anchor, F.greatest("last_update", anchor_epoch)).otherwise(F.col("last_update")))
    return facts


def live_items(assigned: DataFrame, keep: int = LIVE_ITEMS) -> DataFrame:
    """Newest ``keep`` items of each story, with their rank in ``recency`` (1 = newest).

    Spark cuts each group on the map side before the shuffle (window group limit),
    so a hot story sends at most ``keep`` rows per task.
    """
    newest = Window.partitionBy("story_id").orderBy(F.desc("published"), "id")
    return assigned.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= keep)

