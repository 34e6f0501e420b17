"""Structured Streaming: landed payloads to items, stories and alerts.

Each micro-batch runs the batch operators in ``foreachBatch`` and commits one version: the
rows of the stories it touched and of the index of their words, and every ``maintain_every`` batches, after retiring and folding, the whole
state.  A batch that is run again finds its version committed and does nothing, or replaces what the failed run wrote.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsweft.operators.alerts import first_report_alerts
from newsweft.operators.assign import assign
from newsweft.operators.classify import Classifier
from newsweft.operators.enrich import MIN_RELEVANCE, enrich
from newsweft.operators.language import flag_foreign
from newsweft.operators.merge import maintain
from newsweft.operators.similarity import HOT_DF
from newsweft.operators.stories import StoryState, anchor_stories, build, combine, empty_state
from newsweft.functions.times import RETENTION_HOURS
from newsweft.schemas import RAW_PAYLOADS
from newsweft.session import cut_lineage
from newsweft.sources.payloads import fetch_log, parse_payloads
from newsweft.sources.postings import INDEX_TABLES, PostingIndex
from newsweft.sources.seen import SEEN_TABLES, SeenIds
from newsweft.sources.store import TableStore

STATE_TABLES = ["core", "tokens", "places", "sources"]
KEPT_STATES = 2  # compacted states that stay readable


def payload_stream(spark: SparkSession, path: str, file_format: str = "parquet", max_files: int | None = None) -> DataFrame:
    """The landing folder as a stream; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(RAW_PAYLOADS).format(file_format)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


@dataclass
class Monitor:
    """The stateful job: one call per micro-batch."""

    spark: SparkSession
    store: TableStore
    sources: DataFrame
    classifier: Classifier
    anchors: DataFrame
    min_relevance: int = MIN_RELEVANCE
    language_model: DataFrame | None = None
    maintain_every: int = 8
    hot_df: int = HOT_DF

    @staticmethod
    def create(spark: SparkSession, path: str, sources: DataFrame, classifier: Classifier | None = None, **options) -> "Monitor":
        c = classifier or Classifier()
        return Monitor(spark, TableStore(spark, path), sources, c, anchor_stories(spark, c.book), **options)

    @property
    def index(self) -> PostingIndex:
        return PostingIndex(self.store)

    @property
    def seen(self) -> SeenIds:
        return SeenIds(self.store)

    def state(self, before: int | None = None) -> StoryState:
        """The last compacted state and what later batches added to it."""
        base = self.store.latest(before, "core")
        parts = [] if base is None else [StoryState(**{name: self.store.read(base, name) for name in STATE_TABLES})]
        for version in self.store.between(-1 if base is None else base, before, "core_added"):
            parts.append(StoryState(**{name: self.store.read(version, f"{name}_added") for name in STATE_TABLES}))
        if not parts:
            return empty_state(self.spark)
        return parts[0] if len(parts) == 1 else combine(parts)

    def redirects(self, before: int | None = None) -> DataFrame:
        version = self.store.latest(before, "redirects")
        if version is None:
            return self.spark.createDataFrame([], "story_id string, target_id string")
        return self.store.read(version, "redirects")

    def known_ids(self, since: datetime | None, before: int) -> DataFrame | None:
        """Ids that a new item may repeat: older items are turned away by their age, unless anchored."""
        stored = self.store.read_all("items", before - 1)
        if stored is None or since is None:
            return None
        needed = (F.col("published") >= F.lit(since) - F.expr(f"INTERVAL {RETENTION_HOURS + 1} HOURS")) | F.col("anchor_id").isNotNull()
        return stored.filter(needed).select("id")

    def repeated_ids(self, items: DataFrame, since: datetime | None, before: int) -> DataFrame | None:
        """The known ids among those of ``items``, from the buckets that they fall into."""
        if since is None or not self.seen.covered(since, before):
            return self.known_ids(since, before)
        return self.seen.lookup(items, since, before)

    def items(self) -> DataFrame | None:
        """All items with the story they belong to now (folded stories resolved)."""
        stored = self.store.read_all("items")
        if stored is None:
            return None
        moved = stored.join(self.redirects(), "story_id", "left")
        return moved.withColumn("story_id", F.coalesce("target_id", "story_id")).drop("target_id")

    def process(self, payloads: DataFrame, batch_id: int) -> None:
        """One micro-batch; safe to repeat."""
        if self.store.has(batch_id):
            return
        enriched = enrich(parse_payloads(payloads, self.sources, self.classifier), self.sources, self.classifier, self.min_relevance)
        if self.language_model is not None:
            enriched = flag_foreign(enriched, self.language_model)
        # Items are kept, bodies are not: the log reads the durable landing files a second time instead.
        self.process_items(cut_lineage(enriched), batch_id, payloads)

    def process_items(self, items: DataFrame, batch_id: int, landed: DataFrame | None = None) -> None:
        """The stateful half, for items from any source."""
        if self.store.has(batch_id):
            return
        before = self.state(batch_id)
        oldest, newest = items.agg(F.min("fetched"), F.max("fetched")).first()
        held = self.index.lookup(items.select(F.explode("tokens").alias("token")), batch_id)
        found = replace(held, postings=cut_lineage(held.postings))
        result = assign(items, before, self.anchors, F.col("fetched"), self.repeated_ids(items, oldest, batch_id), self.hot_df, found)
        tables = {"items": result.items, "alerts": first_report_alerts(result.items, before.core)}
        compact = bool(self.maintain_every) and (batch_id + 1) % self.maintain_every == 0
        if compact and newest is not None:
            state, moves = maintain(result.state, self.anchors, F.lit(newest))
            tables |= {**state.tables(), **self.index.whole(state.tokens), "redirects": compose_redirects(self.redirects(batch_id), moves)}
            tables |= self.seen.whole(result.items, newest, batch_id)
        else:
            # only the stories that the batch touched: one row each
            touched = build(result.items)
            tables |= {f"{name}_added": table for name, table in touched.tables().items()}
            tables |= self.index.added(touched.tokens, found.postings)
            tables["seen"] = self.seen.rows(result.items)
        if landed is not None:
            named = self.sources.select("source_id", F.col("name").alias("source"))
            counts = items.select("source", "fetched").join(named, "source")
            tables["fetch_log"] = fetch_log(landed, self.sources, counts)
        self.store.save(batch_id, tables)
        if compact:
            self.expire(batch_id)

    def expire(self, batch_id: int) -> None:
        """Drop the states that lie ``KEPT_STATES`` compactions back; items, alerts and logs stay."""
        last = batch_id - KEPT_STATES * self.maintain_every
        for version in range(max(0, last - self.maintain_every + 1), last + 1):
            self.store.expire(version, [n + end for n in STATE_TABLES for end in ("", "_added")] + INDEX_TABLES + SEEN_TABLES)

    def start(self, payloads: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Start the stream; ``trigger`` as in ``DataStreamWriter.trigger`` (default: what is there now)."""
        writer = payloads.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def compose_redirects(old: DataFrame, moves: DataFrame) -> DataFrame:
    """Earlier redirects followed through new moves, plus the new moves."""
    onward = moves.select(F.col("story_id").alias("target_id"), F.col("target_id").alias("_next"))
    followed = old.join(onward, "target_id", "left").select("story_id", F.coalesce("_next", "target_id").alias("target_id"))
    return followed.unionByName(moves.select("story_id", "target_id"))


def source_health_stream(log_stream: DataFrame) -> DataFrame:
    """Running totals per source for ``outputMode("update")``."""
    return log_stream.groupBy("source_id").agg(
        F.count("*").alias("fetches"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.sum(F.when(F.col("ok"), F.col("n_items")).otherwise(F.lit(0))).alias("items_total"),
        F.max(F.struct("fetched", "ok", "n_items", "latency_ms", "error")).getField("error").alias("last_error"),  # the order of the batch form
        F.max(F.when(F.col("ok"), F.col("fetched"))).alias("last_ok"),
    )
