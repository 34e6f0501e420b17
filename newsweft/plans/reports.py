"""Report queries: decision trace, probe, source table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions import grading, text
from newsweft.functions.times import ago
from newsweft.operators.classify import Classifier
from newsweft.operators.enrich import read_rules
from newsweft.operators.health import health_by_kind, source_status
from newsweft.plans import queries


def explain(df: DataFrame, text_col: str, classifier: Classifier | None = None) -> DataFrame:
    """Every decision about every text, next to the input columns."""
    c = classifier or Classifier()
    content = F.col(text_col)
    read = read_rules(df, content, c)
    guess, anchor = F.col("_read.guess"), F.col("_read.anchor")
    places = F.transform(c.places(F.col("_terms")), lambda p: p["name"])
    return (
        read.withColumn("_places", places)
        .select(
            *df.columns,
            F.col("_read.noise").alias("noise"),
            guess["category"].alias("category"),
            guess["score"].alias("score"),
            anchor["anchor_id"].alias("anchor"),
            anchor["score"].cast("bigint").alias("anchor_score"),
            grading.severity_label(grading.severity_from_text(content, guess["category"])).alias("severity"),
            F.get("_places", F.lit(0)).alias("place"),
            F.array_join(F.slice("_places", 2, 5), ", ").alias("also"),
            text.toll(content).alias("toll"),
            F.array_join(text.tokenize(content), " ").alias("tokens"),
        )
    )


def source_table(fetch_log: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Source-health rows."""
    status = source_status(fetch_log)
    state = F.when(F.col("last_error").isNotNull(), F.col("last_error")).when(F.col("last_ok").isNotNull(), F.lit("ok")).otherwise(
        F.lit("starting")
    )
    return status.join(sources.select("source_id", "name", "kind"), "source_id").select(
        "source_id",
        "name",
        F.lower("kind").alias("kind"),
        state.alias("state"),
        F.coalesce(ago(now, F.col("last_ok")), F.lit("—")).alias("age"),
        "last_items",
        "items_total",
        F.concat_ws("/", F.col("failures").cast("string"), F.col("fetches").cast("string")).alias("failed"),
        "latency_ms",
    )


def top_stories(shown: DataFrame, limit: int = 18) -> DataFrame:
    return queries.ranked(shown, "latest", limit).select(
        "story_id",
        grading.category_tag(F.col("category")).alias("tag"),
        text.cut_plain(F.col("title"), 44).alias("title"),
        "n_items",
        "n_sources",
        text.cut_plain(F.coalesce("focus.name", F.lit("—")), 20).alias("place"),
        grading.severity_label(F.col("severity")).alias("severity"),
        "last_update",
    )


def sample_timeline(shown: DataFrame, assigned: DataFrame, now: Column, limit: int = 8) -> DataFrame:
    """Newest items of the top story."""
    top = queries.ranked(shown, "latest", 1).select("story_id")
    # One row, so the join is a lookup.
    own = assigned.join(F.broadcast(top), "story_id").orderBy(F.desc("published"), "id").limit(limit)
    return own.select(
        "story_id", ago(now, F.col("published")).alias("age"), "kind",
        text.cut_plain(F.col("source"), 24).alias("source"), text.cut_plain(F.col("title"), 78).alias("title"), "published", "id",
    )


def probe(fetch_log: DataFrame, sources: DataFrame, items_seen: DataFrame, assigned: DataFrame, view: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The probe report as tables: sources, kinds, funnel, top stories, sample timeline."""
    shown = queries.visible(view, now)
    return {
        "sources": source_table(fetch_log, sources, now),
        "kinds": health_by_kind(source_status(fetch_log), sources),
        "funnel": queries.funnel(items_seen, assigned, view),
        "stories": top_stories(shown),
        "timeline": sample_timeline(shown, assigned, now),
    }
