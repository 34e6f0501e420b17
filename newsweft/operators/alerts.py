"""First-report alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions.geo import zone_of
from newsweft.functions.grading import CRITICAL, ELEVATED


def alert_reason(severity: Column, place: Column, event_key: Column) -> Column:
    """``Critical`` anywhere, ``Europe`` from Elevated on; droughts never; else null."""
    drought = F.coalesce(event_key.startswith("gdacs-DR-"), F.lit(False))
    zone = zone_of(place["point"]["lat"], place["point"]["lon"])
    return F.when(
        ~drought,
        F.when(severity >= CRITICAL, "Critical").when((severity >= ELEVATED) & (zone == "Europe"), "Europe"),
    )


def first_reports(assigned: DataFrame, stories_before: DataFrame | None = None) -> DataFrame:
    """The first item (by arrival) of every story that had none before this batch.

    A minimum per story combines on the map side, so a hot story costs one row per task.
    """
    row = F.struct("id", "title", "place", "severity", "event_key", "fetched")
    first = assigned.groupBy("story_id").agg(F.min_by(row, F.struct("fetched", "published", "id")).alias("r"))
    if stories_before is not None:
        first = first.join(stories_before.select("story_id"), "story_id", "left_anti")
    return first.select("story_id", F.col("r.id").alias("item_id"), "r.title", "r.place", "r.severity", "r.event_key", F.col("r.fetched").alias("raised_at"))


def first_report_alerts(assigned: DataFrame, stories_before: DataFrame | None = None) -> DataFrame:
    """Alert rows: story_id, item_id, title, place, severity, reason, raised_at."""
    first = first_reports(assigned, stories_before)
    reason = alert_reason(F.col("severity"), F.col("place"), F.col("event_key"))
    return (
        first.withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select(
            "story_id", "item_id", "title", F.coalesce("place.name", F.lit("unlocated")).alias("place"), "severity", "reason", "raised_at"
        )
    )
