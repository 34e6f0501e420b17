"""Source health from the fetch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_status(fetch_log: DataFrame) -> DataFrame:
    """Running totals per source; one partial aggregation, one shuffle of one row per source and task.

    ``fetch_log``: source_id, fetched, ok, n_items, latency_ms, error.
    """
    last = F.max(F.struct("fetched", "ok", "n_items", "latency_ms", "error"))  # fetches of one instant are ordered by their result
    totals = fetch_log.groupBy("source_id").agg(
        F.count("*").alias("fetches"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n_items"))), F.lit(0)).alias("items_total"),
        F.max(F.when(F.col("ok"), F.col("fetched"))).alias("last_ok"),
        F.max("fetched").alias("last_fetch"),
        last.alias("last"),
    )
    ok = F.col("last.ok")
    return totals.select(
        "source_id",
        "fetches",
        "failures",
        "items_total",
        F.when(ok, F.col("last.n_items")).otherwise(F.lit(0)).alias("last_items"),
        "last_ok",
        F.when(~ok, F.coalesce("last.error", F.lit("failed"))).alias("last_error"),
        F.col("last.latency_ms").alias("latency_ms"),
        "last_fetch",
    ).withColumn("healthy", F.col("last_ok").isNotNull() & F.col("last_error").isNull())


def backoff_factor(last_error: Column, failures: Column, fetches: Column) -> Column:
    """1 without an error; else 8, 4 or 2 by the share of failures."""
    share = failures / F.greatest(fetches, F.lit(1))
    return F.when(last_error.isNull(), 1).when(share > 0.8, 8).when(share > 0.5, 4).otherwise(2)


def poll_plan(status: DataFrame, sources: DataFrame) -> DataFrame:
    """When each source is due again."""
    factor = backoff_factor(F.col("last_error"), F.col("failures"), F.col("fetches"))
    wait = F.col("interval_s") * factor
    return status.join(sources.select("source_id", "interval_s"), "source_id").select(
        "source_id", factor.alias("factor"), wait.alias("wait_s"),
        (F.col("last_fetch") + F.make_interval(secs=wait)).alias("next_poll_at"),
    )


def health_totals(status: DataFrame) -> DataFrame:
    """One row: healthy sources and all sources."""
    return status.agg(F.count_if("healthy").alias("ok"), F.count("*").alias("total"))


def health_by_kind(status: DataFrame, sources: DataFrame) -> DataFrame:
    """Healthy and all sources per kind."""
    return (
        status.join(sources.select("source_id", "kind"), "source_id")
        .groupBy("kind")
        .agg(F.count_if("healthy").alias("ok"), F.count("*").alias("total"))
    )
