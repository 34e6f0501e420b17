"""The inverted index of stories on disk, by buckets of words.

Three tables of the versioned store:

* ``postings``   ``story_id, token, n``, partitioned by the bucket of the token: occurrences a version adds;
* ``word_sizes`` ``token, df``, partitioned alike: stories that a version adds to a word;
* ``sizes``      ``story_id, n_tokens, n_total``: distinct words and occurrences that a version adds to a story.

A lookup reads the buckets of the words it is asked for, in the versions since the last compaction, and no other folder; a story's size and a
word's document frequency come from their sums, so no posting of another word is read.  What a batch adds follows from
the postings found for its own words: a pair that is not among them is new to its story.  A compaction writes the whole
state as one version, and lookups start from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.sources.store import TableStore

BUCKETS = 256
POSTINGS = "story_id string, token string, n bigint"
WORD_SIZES = "token string, df bigint"
SIZES = "story_id string, n_tokens bigint, n_total bigint"
INDEX_TABLES = ["postings", "word_sizes", "sizes"]


@dataclass(frozen=True)
class Found:
    """Postings of the words asked for, their document frequencies, and the sizes of all stories."""

    postings: DataFrame
    frequencies: DataFrame
    sizes: DataFrame


@dataclass
class PostingIndex:
    store: TableStore
    buckets: int = BUCKETS

    def bucket(self, token: Column | str) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def versions(self, before: int | None = None) -> list[int]:
        """The last compaction and the versions after it."""
        base = self.store.latest(before, "index_base")
        return self.store.between(-1 if base is None else base - 1, before, "postings")

    def scan(self, table: str, schema: str, words: DataFrame, before: int | None = None) -> DataFrame:
        """Rows of ``table`` in the buckets of ``words`` (column ``token``); as many numbers as there are buckets reach the driver."""
        buckets = [r[0] for r in words.select(self.bucket("token")).distinct().collect()]
        return self.store.read_buckets(table, schema, self.versions(before), buckets)

    def lookup(self, words: DataFrame, before: int | None = None) -> Found:
        """What the index holds on ``words``."""
        wanted = words.select("token").distinct()
        postings = self.scan("postings", POSTINGS, wanted, before).join(wanted, "token", "left_semi")
        frequencies = self.scan("word_sizes", WORD_SIZES, wanted, before).join(wanted, "token", "left_semi")
        return Found(
            postings.groupBy("story_id", "token").agg(F.sum("n").alias("n")), frequencies.groupBy("token").agg(F.sum("df").alias("df")), self.sizes(before)
        )

    def sizes(self, before: int | None = None) -> DataFrame:
        versions = self.versions(before)
        if not versions:
            return self.store.spark.createDataFrame([], SIZES)
        rows = self.store.spark.read.schema(f"{SIZES}, version long").parquet(f"{self.store.path}/sizes").filter(F.col("version").isin(versions))
        return rows.groupBy("story_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_total").alias("n_total"))

    def added(self, tokens: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
        """Index tables of a batch: its (story_id, token, n) against the postings found for its words."""
        pairs = tokens.join(found.select("story_id", "token", F.lit(True).alias("known")), ["story_id", "token"], "left").withColumn("new", F.col("known").isNull().cast("bigint"))
        return {
            "postings": tokens.select("story_id", "token", "n", self.bucket("token").alias("bucket")),
            "word_sizes": pairs.groupBy("token").agg(F.sum("new").alias("df")).filter("df > 0").withColumn("bucket", self.bucket("token")),
            "sizes": pairs.groupBy("story_id").agg(F.sum("new").alias("n_tokens"), F.sum("n").alias("n_total")),
        }

    def whole(self, tokens: DataFrame) -> dict[str, DataFrame]:
        """Index tables of a whole state, from which later lookups start."""
        marker = self.store.spark.createDataFrame([(self.buckets,)], "buckets int")
        return {**self.added(tokens, tokens.limit(0)), "index_base": marker}


def after(found: Found, tokens: DataFrame) -> Found:
    """What an index would hold on the same words after ``tokens`` (story_id, token, n) are added."""
    pairs = tokens.join(found.postings.select("story_id", "token", F.lit(True).alias("known")), ["story_id", "token"], "left")
    new = F.count_if(F.col("known").isNull())
    summed = lambda table, keys, *counts: table.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
    return Found(
        summed(found.postings.unionByName(tokens), ["story_id", "token"], "n"),
        summed(found.frequencies.unionByName(pairs.groupBy("token").agg(new.alias("df"))), ["token"], "df"),
        summed(found.sizes.unionByName(pairs.groupBy("story_id").agg(new.alias("n_tokens"), F.sum("n").alias("n_total"))), ["story_id"], "n_tokens", "n_total"),
    )
