"""Founders among items that match no existing story.

In arrival order an item founds a story unless an earlier founder matches it.  That
is the first maximal independent set of the "matches an earlier item" graph, found
in rounds: items without earlier neighbours are founders, their neighbours are
members, and both leave the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.session import cut_lineage


def members_of(edges: DataFrame) -> DataFrame:
    """Items (``id``) that join an earlier founder; ``edges`` has (id, earlier)."""
    left = cut_lineage(edges.select("id", "earlier").distinct())
    found: list[DataFrame] = []
    while not left.isEmpty():
        roots = left.select(F.col("earlier")).distinct().join(left.select(F.col("id").alias("earlier")).distinct(), "earlier", "left_anti")
        joined = cut_lineage(left.join(roots, "earlier", "left_semi").select("id").distinct())
        found.append(joined)
        left = cut_lineage(
            left.join(joined, "id", "left_anti").join(joined.select(F.col("id").alias("earlier")), "earlier", "left_anti")
        )
    if not found:
        return edges.select("id").limit(0)
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def choose_founders(edges: DataFrame) -> DataFrame:
    """Best founder of each member: (id, story_id, score).

    ``edges`` is the result of ``scored_pairs`` with the earlier item's id as ``story_id``.
    Items that do not appear in the result found their own story.
    """
    kept = cut_lineage(edges)
    members = members_of(kept.select("id", F.col("story_id").alias("earlier")))
    to_founders = kept.join(members.select(F.col("id").alias("story_id")), "story_id", "left_anti").join(members, "id", "left_semi")
    from newsweft.operators.similarity import best_story

    return best_story(to_founders)
