"""Shared pieces of the operators: input texts, worker set-up, digests."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.session import cut_lineage

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> None:
    """Let the workers of a local session import this package; a cluster ships it by itself."""
    context = spark.sparkContext
    if context.master.startswith("local["):
        context.environment.setdefault("PYTHONPATH", ROOT)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(frame: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty; every other column is left behind."""
    ready(frame.sparkSession)
    return frame.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def set_aside(frame: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``frame`` with each column that is not ``used`` under a name that no operator uses, and what to select for the old names."""
    inside = [c if c in used else f"in__{i}" for i, c in enumerate(frame.columns)]
    return frame.toDF(*inside), [F.col(i).alias(c) for i, c in zip(inside, frame.columns)]


def sha256(value: Column) -> Column:
    """Lowercase hex of SHA-256 over the UTF-8 bytes."""
    return F.sha2(value.cast("binary"), 256)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined in the order given."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def keep_partitions(frame: DataFrame) -> DataFrame:
    """A checkpoint whose partitioning later groupings by the same key use without another shuffle.

    Adaptive plans do not report their partitioning, so this one job runs without.
    """
    conf = frame.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(frame)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


__all__ = ["cut_lineage", "documents", "keep_partitions", "ready", "set_aside", "sha256", "spans_text", "texts"]
