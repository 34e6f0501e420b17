"""Best story for each item by shared words, category, place and time.

Inputs
------
items      ``id, tokens, category, lat, lon, published``; tokens are distinct
profiles   ``story_id, category, lat, lon, last_update``
postings   ``story_id, token, n``

Candidates come from an inverted index (an equi-join on token); no pair without a
shared word is scored; with the usual threshold none can reach it, as all bonuses together are 0.28 < 0.34.

Frequent words would make that join quadratic, so for words in more than ``hot_df``
stories the join is cut back in an exact way:

* A pair that is not near in space needs a lexical score of the threshold less 0.12.  From
  each item the most frequent words are set aside as long as their summed best
  possible contribution over *light* postings (``n`` at most 2, in a story of at least
  4 words) stays below that.  Set-aside words are joined with the other postings only,
  which are few: repeated words and very short stories.
* A pair that is near in space (600 km) may need less, so set-aside words are also
  joined with light postings, but within the same neighbourhood of the globe.

Every pair that can reach the threshold is found by one of the three joins, and is
then scored in full.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions import grading
from newsweft.functions.geo import EARTH_RADIUS_KM, distance_km

HOT_DF = 2_000
ITEMS_PER_TASK = 5_000  # an item has few bytes and many candidates, so tasks are cut by items
LIGHT_N = 2
LIGHT_STORY = 4
NEAR_KM = 600.0
CATEGORY_HELP = 0.12  # the most that a pair far apart in space gains over its lexical score
_SIZES = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48, 64]


def story_sizes(postings: DataFrame) -> DataFrame:
    """Distinct tokens and total occurrences of each story."""
    return postings.groupBy("story_id").agg(F.count("*").alias("n_tokens"), F.sum("n").alias("n_total"))


def globe_cell(lat: Column, lon: Column) -> list[Column]:
    """Cell of a 600 km cube grid around the globe; points within 600 km are in touching cells."""
    phi, lam = F.radians(lat), F.radians(lon)
    axes = (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    return [F.floor(a * (EARTH_RADIUS_KM / NEAR_KM)).cast("int") for a in axes]


def _cell_key(parts: list[Column]) -> Column:
    return F.concat_ws("/", *parts)


def _sized(postings: DataFrame, sizes: DataFrame) -> DataFrame:
    """Postings with the size of their story and the ``heavy`` mark."""
    heavy = (F.col("n") > LIGHT_N) | (F.col("n_tokens") < LIGHT_STORY)
    return postings.join(sizes.select("story_id", "n_tokens"), "story_id").withColumn("heavy", heavy)


def hot_words(sized: DataFrame, hot_df: int) -> DataFrame:
    """Words in more than ``hot_df`` stories, with their best light contribution per item size."""
    light = F.when(~F.col("heavy"), grading.token_weight(F.col("n")))
    bounds = [F.coalesce(F.max(light / (size + F.sqrt("n_tokens"))), F.lit(0.0)) for size in _SIZES]
    return (
        sized.groupBy("token")
        .agg(F.count("*").alias("df"), F.array(*bounds).alias("bounds"))
        .filter(F.col("df") > hot_df)
    )


def _split_words(items: DataFrame, hot: DataFrame, threshold: float) -> DataFrame:
    """One row per item word with ``aside``: true for the words set aside."""
    needed = threshold - CATEGORY_HELP
    slot = reduce(lambda acc, i: F.when(F.col("n_item") >= _SIZES[i], i).otherwise(acc), range(1, len(_SIZES)), F.lit(0))
    words = items.select("id", F.size("tokens").alias("n_item"), F.explode("tokens").alias("token"))
    known = words.join(hot, "token", "left").withColumn("bound", F.get("bounds", slot))
    # The group is one item's own words, so collecting it is bounded by the text.
    per_item = known.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "bound")), asc=False).alias("w")
    )
    summed = F.aggregate(
        "w",
        F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<token:string,aside:boolean>>").alias("out")),
        lambda acc, x: F.struct(
            # An infrequent word ends the run: its bound counts as infinite.
            (acc["sum"] + F.coalesce(x["bound"], F.lit(1e9))).alias("sum"),
            F.array_append(
                acc["out"],
                F.struct(
                    x["token"].alias("token"),
                    (acc["sum"] + F.coalesce(x["bound"], F.lit(1e9)) < needed - 1e-9).alias("aside"),
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return per_item.select("id", F.inline(summed))


def candidate_pairs(items: DataFrame, profiles: DataFrame, sized: DataFrame, hot: DataFrame, threshold: float = grading.JOIN_THRESHOLD) -> DataFrame:
    """Distinct (id, story_id) that can reach the threshold, found without joining frequent light postings."""
    words = _split_words(items, hot, threshold)
    tiers = F.when(F.col("aside"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    by_word = words.select("id", "token", F.explode(tiers).alias("heavy")).join(
        sized.select("story_id", "token", "heavy"), ["token", "heavy"]
    )
    around = [F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)])).alias(n) for n in "xyz"]
    x, y, z = globe_cell(F.col("lat"), F.col("lon"))
    placed = (
        items.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .select("id", x.alias("cx"), y.alias("cy"), z.alias("cz"))
        .select("*", around[0]).select("*", around[1]).select("*", around[2])
        .select("id", _cell_key([F.col("cx") + F.col("x"), F.col("cy") + F.col("y"), F.col("cz") + F.col("z")]).alias("cell"))
    )
    located = profiles.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "story_id", _cell_key(globe_cell(F.col("lat"), F.col("lon"))).alias("cell")
    )
    near_words = words.filter("aside").select("id", "token").join(placed, "id")
    near_postings = sized.filter(~F.col("heavy")).join(hot.select("token"), "token", "left_semi").join(located, "story_id")
    by_place = near_words.join(near_postings.select("story_id", "token", "cell"), ["token", "cell"])
    return by_word.select("id", "story_id").unionByName(by_place.select("id", "story_id")).distinct()


def _shared_weight(items: DataFrame, postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sum of token weights over the words an item and a story share."""
    words = items.select("id", F.explode("tokens").alias("token"))
    weights = postings.select("story_id", "token", grading.token_weight(F.col("n")).alias("w"))
    shared = pairs.join(words, "id").join(weights, ["story_id", "token"])
    return shared.groupBy("id", "story_id").agg(F.sum("w").alias("shared"))


def scored_pairs(
    items: DataFrame,
    profiles: DataFrame,
    postings: DataFrame,
    earlier_only: bool = False,
    hot_df: int = HOT_DF,
    threshold: float = grading.JOIN_THRESHOLD,
    sizes: DataFrame | None = None,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """All (id, story_id, score, last_update) with a score of at least the threshold.

    With ``earlier_only`` items and profiles carry ``arrival`` and only stories that
    arrived before the item count.  With ``sizes`` (of whole stories) the postings need only be those of the items' words;
    with ``frequencies`` (token, df) only words that these call frequent are looked at as such.
    """
    tasks = -(-items.count() // ITEMS_PER_TASK)
    items = items.repartition(tasks, "id") if tasks > 1 else items
    sizes = story_sizes(postings) if sizes is None else sizes
    sized = _sized(postings, sizes)
    frequent = sized if frequencies is None else sized.join(frequencies.filter(F.col("df") > hot_df), "token", "left_semi")
    hot = hot_words(frequent, hot_df)
    pairs = candidate_pairs(items, profiles, sized, hot, threshold)
    if earlier_only:
        pairs = (
            pairs.join(items.select("id", F.col("arrival").alias("_later")), "id")
            .join(profiles.select("story_id", "arrival"), "story_id")
            .filter("arrival < _later")
            .select("id", "story_id")
        )
    shared = _shared_weight(items, postings, pairs)
    i = items.select(
        "id", F.size("tokens").alias("n_item"), F.col("category").alias("i_category"), F.col("lat").alias("i_lat"),
        F.col("lon").alias("i_lon"), "published",
    )
    s = profiles.join(sizes, "story_id")
    joined = shared.join(i, "id").join(s, "story_id")
    km = distance_km(F.col("i_lat"), F.col("i_lon"), F.col("lat"), F.col("lon"))
    lexical = grading.lexical_score(F.col("shared"), F.col("n_item"), F.col("n_tokens"))
    score = grading.similarity(lexical, F.col("i_category"), F.col("category"), km, F.col("published"), F.col("last_update"))
    # Rounding removes the last-bit noise of sums taken in another order, so ties are ties.
    return joined.select("id", "story_id", F.round(score, 9).alias("score"), "last_update").filter(F.col("score") >= threshold)


def best_story(pairs: DataFrame) -> DataFrame:
    """One story per item: highest score, then latest update, then story id."""
    rank = F.struct(-F.col("score"), -F.unix_micros("last_update"), F.col("story_id"))
    return pairs.groupBy("id").agg(F.min_by(F.struct("story_id", "score"), rank).alias("b")).select(
        "id", F.col("b.story_id").alias("story_id"), F.col("b.score").alias("score")
    )
