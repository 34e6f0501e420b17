"""Assign a batch of items to stories: event id, named situation, similarity, new story.

Batch contract
--------------
Items of a batch arrive in the order (fetched, published, id).

1. An item with an event key goes to the story ``ev-<key>``.
2. An item with a known anchor goes to the anchor's story.
3. Other items go to the best story as it stands after 1 and 2 of this batch, when
   the score reaches 0.34.  Event stories never take free items.
4. The rest compare with each other: an item founds a story unless an earlier
   founder matches it; members take their best founder.

Copies (same words, category, place and day) are compared once: they go where the
first of them goes.  A batch of one item follows the reference rule exactly; inside
a larger batch the word counts of a story do not move between its items.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions.times import RETENTION_HOURS, whole_hours
from newsweft.operators import stories
from newsweft.operators.leaders import choose_founders
from newsweft.operators.similarity import HOT_DF, best_story, scored_pairs
from newsweft.operators.stories import EVENT_PREFIX, StoryState
from newsweft.session import cut_lineage
from newsweft.sources.postings import Found, after

FOUNDED_PREFIX = "s-"


def first_arrivals(items: DataFrame) -> DataFrame:
    """One row per item id, the first to arrive (partial aggregation, then one shuffle on id)."""
    columns = items.columns
    row = F.struct(*columns)
    return items.groupBy("id").agg(F.min_by(row, F.struct("fetched", "published", "title")).alias("r")).select("r.*")


def unseen(items: DataFrame, known: DataFrame | None) -> DataFrame:
    """Batch without repeats and without ids that some story already holds."""
    fresh = first_arrivals(items)
    return fresh if known is None else fresh.join(known.select("id"), "id", "left_anti")


def young_enough(items: DataFrame, now: Column) -> DataFrame:
    """Age gate in whole hours; anchored items pass at any age."""
    return items.filter(F.col("anchor_id").isNotNull() | (whole_hours(now, F.col("published")) <= RETENTION_HOURS))


def route_exact(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """Tiers 1 and 2: adds ``story_id`` and ``tier``; both null for free items."""
    known = anchors.select("anchor_id", F.lit(True).alias("_known"))
    routed = items.join(known, "anchor_id", "left")
    event = F.col("event_key").isNotNull()
    return (
        routed.withColumn(
            "story_id",
            F.when(event, F.concat(F.lit(EVENT_PREFIX), "event_key")).when(F.col("_known"), F.col("anchor_id")),
        )
        .withColumn("tier", F.when(event, "event").when(F.col("_known"), "anchor"))
        .drop("_known")
        .select(*items.columns, "story_id", "tier")
    )


def _copy_key() -> Column:
    """Copies agree on words, category, place and day; items without words have no copies."""
    return F.struct(
        F.when(F.size("tokens") == 0, F.col("id")).alias("only"),
        F.sort_array("tokens").alias("words"),
        "category",
        F.col("place.point.lat").alias("lat"),
        F.col("place.point.lon").alias("lon"),
        F.to_date("published").alias("day"),
    )


def profiles_of(state: StoryState, anchors: DataFrame) -> DataFrame:
    """What the similarity join reads of each open, non-event story."""
    table = stories.story_table(state, anchors).filter(~F.col("story_id").startswith(EVENT_PREFIX) & (F.col("n_items") > 0))
    return table.select(
        "story_id", "category", F.col("focus.point.lat").alias("lat"), F.col("focus.point.lon").alias("lon"), "last_update"
    )


@dataclass(frozen=True)
class Assignment:
    """``items`` with story_id, tier and score, and the story state after the batch."""

    items: DataFrame
    state: StoryState


def assign(
    items: DataFrame,
    state: StoryState,
    anchors: DataFrame,
    now: Column,
    known: DataFrame | None = None,
    hot_df: int = HOT_DF,
    found: Found | None = None,
) -> Assignment:
    """Route one batch; see the module text for the contract.

    With ``found``, what an index holds on the words of the batch, the state's own postings are not read.
    """
    batch = cut_lineage(route_exact(young_enough(unseen(items, known), now), anchors))
    exact = batch.filter(F.col("story_id").isNotNull()).withColumn("score", F.lit(None).cast("double"))
    free = batch.filter(F.col("story_id").isNull()).drop("story_id", "tier")

    before = stories.merge(state, stories.build(exact))
    keyed = free.withColumn("_copy", _copy_key())
    firsts = keyed.groupBy("_copy").agg(F.min(stories.arrival()).alias("arrival"))
    reps = cut_lineage(
        firsts.select(
            F.col("arrival.id").alias("id"),
            F.col("_copy.words").alias("tokens"),
            F.col("_copy.category").alias("category"),
            F.col("_copy.lat").alias("lat"),
            F.col("_copy.lon").alias("lon"),
            F.col("arrival.published").alias("published"),
            "arrival",
            "_copy",
        )
    )
    held = None if found is None else after(found, stories.build(exact, titles=False).tokens)
    postings = (before.tokens if held is None else held.postings).filter(~F.col("story_id").startswith(EVENT_PREFIX))
    known_sizes = {} if held is None else {"sizes": held.sizes, "frequencies": held.frequencies}
    matched = cut_lineage(best_story(scored_pairs(reps, profiles_of(before, anchors), postings, hot_df=hot_df, **known_sizes)))

    rest = cut_lineage(reps.join(matched, "id", "left_anti"))
    singles = rest.select(
        F.col("id").alias("story_id"), "category", "lat", "lon", F.col("published").alias("last_update"), "arrival"
    )
    single_words = rest.select(F.col("id").alias("story_id"), F.explode("tokens").alias("token"), F.lit(1).cast("bigint").alias("n"))
    edges = scored_pairs(rest, singles, single_words, earlier_only=True, hot_df=hot_df)
    joined = choose_founders(edges)

    decided = (
        reps.select("id", "_copy")
        .join(matched.select("id", F.col("story_id").alias("_match"), F.col("score").alias("_match_score")), "id", "left")
        .join(joined.select("id", F.col("story_id").alias("_founder"), F.col("score").alias("_founder_score")), "id", "left")
        .select(
            "_copy",
            F.col("id").alias("_first"),
            F.coalesce("_match", F.concat(F.lit(FOUNDED_PREFIX), F.coalesce("_founder", "id"))).alias("story_id"),
            F.coalesce("_match_score", "_founder_score").alias("score"),
            (F.col("_match").isNull() & F.col("_founder").isNull()).alias("_founds"),
        )
    )
    placed = (
        keyed.join(decided, "_copy")
        .withColumn("tier", F.when(F.col("_founds") & (F.col("id") == F.col("_first")), "new").otherwise("similar"))
        .drop("_copy", "_first", "_founds")
    )
    done = cut_lineage(exact.unionByName(placed))
    return Assignment(done, stories.merge(state, stories.build(done)))


def backfill(
    items: DataFrame,
    state: StoryState,
    anchors: DataFrame,
    every: str = "1 day",
    hot_df: int = HOT_DF,
) -> Assignment:
    """Assign a long history slice by slice (by ``fetched``), the state carried along.

    Slices keep each similarity join small: most items of a slice meet a story that
    an earlier slice has founded.  A slice is read with literal time bounds, which a reader can
    prune; ids are kept as long as an item of that age could come again.
    """
    window = F.window("fetched", every)
    first, last = items.agg(F.min(window["start"]), F.max(window["start"])).first()
    if first is None:
        raise ValueError("no items to assign")
    step = F.expr(f"INTERVAL {every}")
    starts = F.explode(F.sequence(F.lit(first), F.lit(last), step)).alias("start")
    bounds = items.sparkSession.range(1).select(starts).select("start", (F.col("start") + step).alias("end")).collect()
    done: list[DataFrame] = []
    known: DataFrame | None = None
    for start, end in bounds:
        part = items.filter((F.col("fetched") >= F.lit(start)) & (F.col("fetched") < F.lit(end)))
        if part.isEmpty():
            continue
        result = assign(part, state, anchors, F.lit(end), known, hot_df)
        state = result.state.map(cut_lineage)
        done.append(result.items)
        ids = result.items.select("id", "published", "anchor_id")
        wanted = (F.col("published") >= F.lit(end) - F.expr(f"INTERVAL {RETENTION_HOURS + 1} HOURS")) | F.col("anchor_id").isNotNull()
        known = cut_lineage((ids if known is None else known.unionByName(ids)).filter(wanted))
    return Assignment(reduce(DataFrame.unionByName, done), state)
