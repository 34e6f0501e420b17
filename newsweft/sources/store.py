"""Versioned tables in a shared folder, with a manifest that names complete versions.

A version's tables are written first and its manifest row last, so a job that dies in
between leaves no visible version; writing the same version again replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsweft.functions.times import is_stale
from newsweft.operators.stories import live_items

FORMAT = 1  # other formats are ignored, not migrated
SAVED_STORIES = 400  # fixed values of the snapshot
SAVED_ITEMS = 250

MANIFEST = "version bigint, format int, tables array<string>"


class TableStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _folder(self, version: int, table: str) -> str:
        return f"{self.path}/{table}/version={version}"

    def _exists(self, folder: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def manifest(self) -> DataFrame:
        """One row per complete version of this format."""
        folder = f"{self.path}/_manifest"
        if not self._exists(folder):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(folder).filter(F.col("format") == FORMAT).dropDuplicates(["version"])

    def versions(self) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        return [r["version"] for r in self.manifest().select("version").orderBy("version").collect()]

    def latest(self, before: int | None = None, table: str | None = None) -> int | None:
        """Newest complete version, of those that have ``table`` if one is named."""
        rows = self.manifest()
        if before is not None:
            rows = rows.filter(F.col("version") < before)
        if table is not None:
            rows = rows.filter(F.array_contains("tables", table))
        return rows.agg(F.max("version")).first()[0]

    def has(self, version: int) -> bool:
        return not self.manifest().filter(F.col("version") == version).isEmpty()

    def between(self, first: int, before: int | None, table: str) -> list[int]:
        """Complete versions after ``first`` that have ``table``; as many as there are between two compactions."""
        rows = self.manifest().filter((F.col("version") > first) & F.array_contains("tables", table))
        if before is not None:
            rows = rows.filter(F.col("version") < before)
        return [r["version"] for r in rows.select("version").orderBy("version").collect()]

    def write(self, version: int, tables: dict[str, DataFrame]) -> None:
        """Write the tables of a version; not visible before ``commit``.  A table with a column ``bucket`` is partitioned by it."""
        for name, table in tables.items():
            writer = table.repartition("bucket").write.partitionBy("bucket") if "bucket" in table.columns else table.write
            writer.mode("overwrite").parquet(self._folder(version, name))

    def commit(self, version: int, tables: list[str]) -> None:
        row = self.spark.createDataFrame([(version, FORMAT, sorted(tables))], MANIFEST)
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/_manifest/version={version}")

    def save(self, version: int, tables: dict[str, DataFrame]) -> None:
        self.write(version, tables)
        self.commit(version, list(tables))

    def read(self, version: int, table: str) -> DataFrame:
        return self.spark.read.parquet(self._folder(version, table))

    def read_all(self, table: str, up_to: int | None = None) -> DataFrame | None:
        """An append-only table: the rows of all complete versions, named as literals so that no other folder is read."""
        complete = self.between(-1, None if up_to is None else up_to + 1, table)
        if not complete:
            return None
        rows = self.spark.read.parquet(f"{self.path}/{table}")
        return rows.filter(F.col("version").isin(complete)).drop("version")

    def read_buckets(self, table: str, schema: str, versions: list[int], buckets: list[int]) -> DataFrame:
        """Rows of some buckets of some versions; versions and buckets are literals, so no other folder is read."""
        if not versions or not buckets:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, version long, bucket int").parquet(f"{self.path}/{table}")
        return rows.filter(F.col("version").isin(versions) & F.col("bucket").isin(buckets)).drop("version", "bucket")

    def expire(self, version: int, tables: list[str]) -> None:
        """Delete the given tables of one version; a version without them is left alone."""
        for name in tables:
            folder = self._folder(version, name)
            if self._exists(folder):
                target = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def readable(self, names: list[str]) -> int | None:
        """Newest version whose tables can be read to the last row; broken ones are skipped."""
        for version in reversed(self.versions()):
            try:
                for name in names:
                    self.read(version, name).write.format("noop").mode("overwrite").save()
                return version
            except Exception as error:  # a damaged version must not stop the restore
                print(f"skipping version {version}: {str(error).splitlines()[0]}")
        return None


def save_snapshot(store: TableStore, version: int, table: DataFrame, assigned: DataFrame, now: Column) -> None:
    """Newest 400 stories that are not stale, with their newest 250 items each."""
    fresh = table.filter((F.col("n_items") > 0) & ~is_stale(F.col("last_update"), now))
    kept = fresh.orderBy(F.desc("last_update"), "story_id").limit(SAVED_STORIES)
    # 400 ids: a proven bound for the semi join's broadcast.
    items = assigned.join(F.broadcast(kept.select("story_id")), "story_id", "left_semi")
    store.save(version, {"stories": kept, "items": live_items(items, SAVED_ITEMS).drop("recency")})


def load_snapshot(store: TableStore, now: Column) -> tuple[DataFrame, DataFrame] | None:
    """Stories and items of the newest readable snapshot, stale stories left out."""
    version = store.readable(["stories", "items"])
    if version is None:
        return None
    table = store.read(version, "stories").filter(~is_stale(F.col("last_update"), now))
    items = store.read(version, "items").join(table.select("story_id"), "story_id", "left_semi")
    return table, items


def restore_items(restored: DataFrame, existing: DataFrame) -> DataFrame:
    """Restored items added to existing ones; a repeated (story, item) counts once."""
    columns = existing.columns
    both = existing.withColumn("_late", F.lit(0)).unionByName(restored.select(*columns).withColumn("_late", F.lit(1)))
    first = Window.partitionBy("story_id", "id").orderBy("_late")
    return both.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n", "_late")
