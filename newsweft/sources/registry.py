"""Selecting sources from the registry table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_sources(sources: DataFrame, include_opt_in: bool = False, only: list[str] | None = None) -> DataFrame:
    """Active sources; raises when nothing is left."""
    active = sources if include_opt_in else sources.filter(~F.col("opt_in"))
    if only:
        active = active.filter(F.col("source_id").isin(*only))
    if active.isEmpty():
        raise ValueError("no sources selected")
    return active


def list_sources(sources: DataFrame) -> DataFrame:
    """The listing report: id, kind, interval, opt-in mark and name."""
    mark = F.when(F.col("opt_in"), F.lit("opt-in")).otherwise(F.lit("on"))
    return sources.select("source_id", F.lower("kind").alias("kind"), "interval_s", mark.alias("state"), "name", "url").orderBy("source_id")
