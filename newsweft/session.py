"""Session helpers: defaults for local runs and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FEW_SPLITS = 8
ROWS_PER_SPLIT = 100_000


def local_session(cores: str = "*", name: str = "newsweft", **conf: str) -> SparkSession:
    """A session for tests and benches.  A cluster brings its own session."""
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="newsweft-checkpoint-")
    context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor reaches."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a table of few splits enough partitions for heavy per-row work.

    They grow with the rows, so a task has at most some ``ROWS_PER_SPLIT`` of them: a table of short rows has few
    splits by its bytes. Tables with as many splits are left alone, so no shuffle is added to those.
    """
    wanted = _splits(df)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)


def gather(df: DataFrame, key: str) -> DataFrame:
    """Rows of one ``key`` in one split, as many splits as ``spread`` gives; a grouping by the key shuffles nothing more."""
    return df.repartition(_splits(df), key)


def _splits(df: DataFrame) -> int:
    return max(FEW_SPLITS, -(-df.count() // ROWS_PER_SPLIT))
