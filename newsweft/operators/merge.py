"""Fold near-identical stories and retire idle ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.functions import grading
from newsweft.functions.geo import distance_km
from newsweft.functions.times import RETENTION_HOURS, is_stale
from newsweft.operators import stories
from newsweft.operators.stories import EVENT_PREFIX, StoryState
from newsweft.session import cut_lineage

MERGE_OVERLAP = 0.55  # fixed value: Dice overlap two stories must exceed
# For overlap above 0.55 the smaller story has at least 0.55 / 1.45 of the larger one's words,
# and the shared weight exceeds 0.275 * (A + B) >= PREFIX_SHARE * A.
_SIZE_RATIO = MERGE_OVERLAP / (2 - MERGE_OVERLAP)
PREFIX_SHARE = MERGE_OVERLAP / 2 * (1 + _SIZE_RATIO)


def mergeable(story_table: DataFrame) -> DataFrame:
    """Stories that may be folded: no anchors, no event stories, not empty."""
    return story_table.filter(
        F.col("anchor_id").isNull() & ~F.col("story_id").startswith(EVENT_PREFIX) & (F.col("n_items") > 0)
    ).select(
        "story_id", "category", F.col("focus.point.lat").alias("lat"), F.col("focus.point.lon").alias("lon"), "first_seen"
    )


def _seniority() -> Column:
    return F.struct("first_seen", "story_id")


def overlap_pairs(open_stories: DataFrame, postings: DataFrame) -> DataFrame:
    """Pairs (a, b, overlap), a older, same category, overlap above 0.55, near in space.

    Prefix filter: with words ordered from rare to frequent, a story keeps words until
    the rest weighs at most PREFIX_SHARE of it.  Two stories whose kept words are
    disjoint share at most that rest, which is too little.  So the self-join runs on
    kept words only and frequent words mostly stay out; kept pairs are then verified.
    """
    words = postings.join(open_stories.select("story_id", "category"), "story_id")
    frequency = words.groupBy("category", "token").agg(F.count("*").alias("df"))
    totals = words.groupBy("story_id").agg(F.sum("n").alias("total"))
    rare_first = Window.partitionBy("story_id").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        words.join(frequency, ["category", "token"])
        .join(totals, "story_id")
        .withColumn("before", F.coalesce(F.sum("n").over(rare_first), F.lit(0)))
    )
    # Kept while the weight from this word on is still more than the share that may be left out.
    kept = ranked.filter(F.col("total") - F.col("before") > PREFIX_SHARE * F.col("total"))
    index = kept.select("story_id", "category", "token", "total").join(open_stories.drop("category"), "story_id")
    a = index.select(*[F.col(c).alias(f"a_{c}") for c in index.columns])
    b = index.select(*[F.col(c).alias(f"b_{c}") for c in index.columns])
    older = F.struct("a_first_seen", "a_story_id") < F.struct("b_first_seen", "b_story_id")
    km = distance_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    alike = (F.least("a_total", "b_total") > _SIZE_RATIO * F.greatest("a_total", "b_total") - 1e-6)
    near = grading.near_in_space(F.col("a_category"), km)
    pairs = (
        a.join(b, (F.col("a_category") == F.col("b_category")) & (F.col("a_token") == F.col("b_token")) & older)
        .filter(alike & near)
        .select("a_story_id", "b_story_id", "a_total", "b_total")
        .distinct()
    )
    left = postings.select(F.col("story_id").alias("a_story_id"), "token", F.col("n").alias("a_n"))
    right = postings.select(F.col("story_id").alias("b_story_id"), "token", F.col("n").alias("b_n"))
    shared = (
        pairs.join(left, "a_story_id")
        .join(right, ["b_story_id", "token"])
        .groupBy("a_story_id", "b_story_id")
        .agg(F.sum(F.least("a_n", "b_n")).alias("shared"), F.first("a_total").alias("a_total"), F.first("b_total").alias("b_total"))
    )
    overlap = 2.0 * F.col("shared") / (F.col("a_total") + F.col("b_total"))
    return shared.select(F.col("a_story_id").alias("a"), F.col("b_story_id").alias("b"), overlap.alias("overlap")).filter(
        F.col("overlap") > MERGE_OVERLAP
    )


def fold_copies(open_stories: DataFrame, postings: DataFrame) -> DataFrame:
    """Moves (story_id, target_id) of stories with equal words, category and place to the oldest.

    Equal stories always merge (overlap 1, distance 0 or unknown); folding them by a
    grouping first keeps a large group of equals out of the pair join.
    """
    word = F.concat_ws("\u0001", "token", F.col("n").cast("string"))
    # A sum of two hashes does not depend on word order and needs no collected list.
    marks = postings.withColumn("w", word).groupBy("story_id").agg(
        F.sum(F.xxhash64("w").cast("decimal(38,0)")).alias("h1"),
        F.sum(F.xxhash64(F.reverse("w"), F.lit(7)).cast("decimal(38,0)")).alias("h2"),
        F.count("*").alias("words"),
        F.sum("n").alias("total"),
    )
    keyed = open_stories.join(marks, "story_id")
    group = ["category", "lat", "lon", "h1", "h2", "words", "total"]
    oldest = keyed.groupBy(*group).agg(F.min(_seniority()).alias("o"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"g.{c}")) for c in group]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return (
        keyed.alias("k")
        .join(oldest.alias("g"), condition)
        .select(F.col("k.story_id").alias("story_id"), F.col("g.o.story_id").alias("target_id"))
        .filter(F.col("story_id") != F.col("target_id"))
    )


def overlap_classes(open_stories: DataFrame, postings: DataFrame) -> DataFrame:
    """All links (a, b, overlap, link) without the pairs among copies.

    ``copy``: b has the words, category and place of the older a, which stands for its class; ``pair``: two of these
    representatives overlap.  A group of n equal stories gives n - 1 rows, and every pair of ``overlap_pairs`` follows from them.
    """
    copies = cut_lineage(fold_copies(open_stories, postings))
    singles = open_stories.join(copies, "story_id", "left_anti")
    words = postings.join(singles.select("story_id"), "story_id", "left_semi")
    pairs = overlap_pairs(singles, words).withColumn("link", F.lit("pair"))
    return copies.select(F.col("target_id").alias("a"), F.col("story_id").alias("b"), F.lit(1.0).alias("overlap"), F.lit("copy").alias("link")).unionByName(pairs)


def all_pairs(open_stories: DataFrame, postings: DataFrame) -> DataFrame:
    """Every pair of ``overlap_pairs``, those of copies included, written out from the links between classes.

    Only representatives meet by their words; a class of n equal stories gives its n (n - 1) / 2 pairs by its members.
    """
    links = cut_lineage(overlap_classes(open_stories, postings))
    copies = links.filter("link = 'copy'").select(F.col("a").alias("head"), F.col("b").alias("story_id"))
    ranks = open_stories.select("story_id", _seniority().alias("rank"))
    member = cut_lineage(ranks.join(copies, "story_id", "left").select(F.coalesce("head", "story_id").alias("head"), "story_id", "rank"))
    within = copies.select(F.col("head").alias("a"), F.col("head").alias("b"), F.lit(1.0).alias("overlap")).distinct()
    classes = links.filter("link = 'pair'").select("a", "b", "overlap").unionByName(within)
    x = member.select(F.col("head").alias("a"), F.col("story_id").alias("x"), F.col("rank").alias("x_rank"))
    y = member.select(F.col("head").alias("b"), F.col("story_id").alias("y"), F.col("rank").alias("y_rank"))
    older = F.col("x_rank") < F.col("y_rank")
    met = classes.join(x, "a").join(y, "b").filter((F.col("a") != F.col("b")) | older)
    return met.select(F.when(older, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(older, F.col("y")).otherwise(F.col("x")).alias("b"), "overlap")


def fold_components(pairs: DataFrame, seniority: DataFrame) -> DataFrame:
    """Moves (story_id, target_id): every component of the pair graph to its oldest story.

    Each story points at the oldest story it knows of; rounds take the oldest pointer
    among neighbours and then jump (pointer of pointer), so depth shrinks by halves.
    """
    ranks = seniority.select("story_id", _seniority().alias("rank"))
    edges = cut_lineage(
        pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    )
    if edges.isEmpty():
        return pairs.select(F.col("a").alias("story_id"), F.col("b").alias("target_id")).limit(0)
    roots = cut_lineage(edges.select(F.col("x").alias("story_id")).distinct().join(ranks, "story_id").withColumn("root", F.col("rank")).drop("rank"))
    while True:
        heard = edges.join(roots, edges["y"] == roots["story_id"]).groupBy(F.col("x").alias("story_id")).agg(F.min("root").alias("heard"))
        stepped = roots.join(heard, "story_id").select("story_id", "root", F.least("root", "heard").alias("next"))
        jump = roots.select(F.col("story_id").alias("_at"), F.col("root").alias("_jump"))
        jumped = stepped.join(jump, F.col("next.story_id") == F.col("_at")).select(
            "story_id", F.least("next", "_jump").alias("root"), (F.least("next", "_jump") != F.col("root")).alias("moved")
        )
        state = cut_lineage(jumped)
        roots = state.select("story_id", "root")
        if state.filter("moved").isEmpty():
            break
    return roots.select("story_id", F.col("root.story_id").alias("target_id")).filter(F.col("story_id") != F.col("target_id"))


def merge_moves(table: DataFrame, postings: DataFrame) -> DataFrame:
    """All moves (story_id, target_id) of one maintenance run."""
    open_stories = cut_lineage(mergeable(table))
    copies = cut_lineage(fold_copies(open_stories, postings))
    singles = open_stories.join(copies, "story_id", "left_anti")
    words = postings.join(singles.select("story_id"), "story_id", "left_semi")
    components = cut_lineage(fold_components(overlap_pairs(singles, words), singles))
    onward = components.select(F.col("story_id").alias("target_id"), F.col("target_id").alias("_last"))
    moved_copies = copies.join(onward, "target_id", "left").select("story_id", F.coalesce("_last", "target_id").alias("target_id"))
    return moved_copies.unionByName(components)


def retire(state: StoryState, anchors: DataFrame, now: Column, hours: int = RETENTION_HOURS) -> StoryState:
    """Drop stories idle for more than the retention; anchors stay."""
    ids = anchors.select(F.col("anchor_id").alias("story_id"), F.lit(True).alias("_anchor"))
    live = (
        state.core.join(ids, "story_id", "left")
        .filter(F.col("_anchor") | ~is_stale(F.col("last_update"), now, hours))
        .select("story_id")
    )
    return state.map(lambda t: t.join(live, "story_id", "left_semi"))


def maintain(state: StoryState, anchors: DataFrame, now: Column) -> tuple[StoryState, DataFrame]:
    """Retire, then fold duplicates.  Returns the new state and the moves.

    Trimming to the newest items is a read-side rule (``stories.live_items``): item rows
    are never deleted, so a trimmed item cannot come back as a new one.
    """
    kept = retire(state, anchors, now).map(cut_lineage)
    moves = cut_lineage(merge_moves(stories.story_table(kept, anchors), kept.tokens))
    return (stories.rekey(kept, moves), moves)
