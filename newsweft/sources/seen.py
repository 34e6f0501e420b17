"""Ids of stored items on disk, by buckets, so that a batch looks only where its own ids can be.

``seen`` holds ``id, published, anchored``, partitioned by the bucket of the id: a version adds the ids of its items. Every
compaction writes all ids that may still be asked for as one version, and ``seen_base`` says from when on they are complete:
a new item as old as ids left out would be turned away by its age, unless its payload lands very late. A batch with so late a
payload, or a state from before there was this index, is not ``covered``, and the item files are read instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions.times import RETENTION_HOURS
from newsweft.sources.store import TableStore

BUCKETS = 256
SEEN = "id string, published timestamp, anchored boolean"
SEEN_TABLES = ["seen", "seen_base"]
NEEDED = timedelta(hours=RETENTION_HOURS + 1)  # an item published that long before its fetch is too old to be new


@dataclass
class SeenIds:
    store: TableStore
    buckets: int = BUCKETS

    def bucket(self, name: Column | str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    def versions(self, before: int | None = None) -> list[int]:
        """The last compaction and the versions after it."""
        base = self.store.latest(before, "seen_base")
        return self.store.between(-1 if base is None else base - 1, before, "seen")

    def covered(self, since: datetime, before: int | None = None) -> bool:
        """Whether all ids that items fetched at ``since`` or later may repeat are in the index."""
        base = self.store.latest(before, "seen_base")
        held = self.store.between(-1 if base is None else base, before, "seen")
        if held != self.store.between(-1 if base is None else base, before, "items"):
            return False
        if base is None:
            return True
        complete_from = self.store.read(base, "seen_base").first()["complete_from"]
        return complete_from is None or since - NEEDED >= complete_from

    def lookup(self, ids: DataFrame, since: datetime, before: int | None = None) -> DataFrame:
        """Those of ``ids`` (column ``id``) that an item already has; as many numbers as there are buckets reach the driver."""
        wanted = ids.select("id").distinct()
        buckets = [r[0] for r in wanted.select(self.bucket("id")).distinct().collect()]
        return self.scan(buckets, since, before).join(wanted, "id", "left_semi").select("id").distinct()

    def scan(self, buckets: list[int], since: datetime, before: int | None = None) -> DataFrame:
        rows = self.store.read_buckets("seen", SEEN, self.versions(before), buckets)
        return rows.filter((F.col("published") >= F.lit(since - NEEDED)) | F.col("anchored"))

    def rows(self, items: DataFrame) -> DataFrame:
        """Index rows of items with ``id, published, anchor_id``."""
        return items.select("id", "published", F.col("anchor_id").isNotNull().alias("anchored"), self.bucket("id").alias("bucket"))

    def whole(self, items: DataFrame, newest: datetime, before: int) -> dict[str, DataFrame]:
        """Index tables of a compaction: the ids up to version ``before`` and those of ``items``.

        Ids stay for twice the retention before ``newest``; those of anchored items, which pass at any age, stay for good.
        """
        complete_from = newest - 2 * NEEDED
        if self.covered(newest - NEEDED, before):
            old = self.store.read_buckets("seen", SEEN, self.versions(before), list(range(self.buckets)))
            old = old.withColumn("bucket", self.bucket("id"))
        else:
            stored = self.store.read_all("items", before - 1)
            old = self.rows(items.limit(0) if stored is None else stored)
        both = old.unionByName(self.rows(items)).filter((F.col("published") >= F.lit(complete_from)) | F.col("anchored"))
        marker = self.store.spark.createDataFrame([(self.buckets, complete_from)], "buckets int, complete_from timestamp")
        return {"seen": both, "seen_base": marker}
