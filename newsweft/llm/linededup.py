"""Cross-site boilerplate lines: how many distinct sites a line is spread over.

A line is a ``\\n``-separated piece of a text, compared without white space (0x20, 0x09-0x0D) at its ends; lines with nothing
else are left alone.  A line of ``min_chars`` code points or more is boilerplate on ``min_sites`` sites; a shorter one is more likely
to be met by chance, so it takes ``min_sites * ceil(min_chars / length) ** 2`` sites.

1. One aggregation per line hash (two 64-bit hashes) merges a HyperLogLog sketch of the sites
   and the least document id that has the line.  Partial sketches are merged on the map side, so a line
   in a third of all rows costs one row per task.
2. A line whose estimate is within ``band`` of the number it takes gets an exact distinct count;
   others are decided by the estimate.
3. A boilerplate line stays in the document with the least id that has it and is removed from all others.  Its rows are found by
   a join with the boilerplate table: broadcast up to ``SMALL`` lines (counted), salted beyond that, so that a line in a third of all rows
   lies in ``SALTS`` tasks.

Only DataFrame functions are used.  Defined results: a null site counts for no site; a null or empty text
has one empty line and nothing to remove; rows with a null id take no part and keep their text;
repeated rows are treated alike; all columns of the input are kept, but n_lines and n_removed are the new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.llm.common import cut_lineage, set_aside

MIN_SITES = 5
MIN_CHARS = 20
BAND = 0.5
SMALL = 1_000_000  # boilerplate lines that may be broadcast: three longs each
SALTS = 32
BLANKS = " \t\n\x0b\x0c\r"


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_table(documents: DataFrame, site: str = "source") -> DataFrame:
    """(h1, h2, chars, site, doc_id, row_hash, pos): one row per line that is not blank."""
    line = F.btrim(F.col("line"), F.lit(BLANKS))
    return (
        documents.filter("doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(site).cast("string").alias("site"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row_hash"), F.posexplode(_split(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "site", "row_hash", "pos", line.alias("line"))
        .filter("line <> ''")
        .select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.length("line").alias("chars"), "site", "doc_id", "row_hash", "pos")
    )


def sites_needed(chars: Column, min_sites: int, min_chars: int) -> Column:
    """Sites that make a line of so many characters boilerplate."""
    return min_sites * F.greatest(F.ceil(F.lit(min_chars) / chars), F.lit(1)) * F.greatest(F.ceil(F.lit(min_chars) / chars), F.lit(1))


def _for_lines(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """A table of lines made ready to be joined with all lines, and the join's columns."""
    if found.count() <= SMALL:
        return F.broadcast(found), ["h1", "h2"]
    return found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h1", "h2", "salt"]


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, band: float = BAND) -> DataFrame:
    """(h1, h2, first_id) of the boilerplate lines."""
    spread = (
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", F.lit(12)).alias("sketch"), F.min("doc_id").alias("first_id"), F.max("chars").alias("chars"))
        .select("h1", "h2", "first_id", F.hll_sketch_estimate("sketch").alias("sites"), sites_needed(F.col("chars"), min_sites, min_chars).alias("needed"))
        .filter(F.col("sites") >= F.col("needed") * (1 - band))
    )
    spread = cut_lineage(spread)
    sure = spread.filter(F.col("sites") > F.col("needed") * (1 + band))
    near = spread.filter(F.col("sites") <= F.col("needed") * (1 + band))
    wanted, keys = _for_lines(near.select("h1", "h2", "needed"))
    exact = (
        lines.select("h1", "h2", "site", F.pmod("doc_id", F.lit(SALTS)).cast("int").alias("salt"))
        .join(wanted, keys)
        .groupBy("h1", "h2")
        .agg(F.count_distinct("site").alias("sites"), F.max("needed").alias("needed"))
        .filter(F.col("sites") >= F.col("needed"))
    )
    return sure.select("h1", "h2", "first_id").union(near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "first_id"))


def _rebuilt(documents: DataFrame, site: str, min_sites: int, min_chars: int) -> tuple[DataFrame, list[Column]]:
    """All rows with the text rebuilt and ``lines``, ``removed``; and the input's columns."""
    documents, columns = set_aside(documents, "doc_id", "text", site)
    lines = line_table(documents, site)
    found, keys = _for_lines(cut_lineage(boilerplate(lines, min_sites, min_chars)))
    gone = (
        lines.select("h1", "h2", "doc_id", "row_hash", "pos", F.pmod("doc_id", F.lit(SALTS)).cast("int").alias("salt"))
        .join(found, keys)
        .filter("doc_id > first_id")
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set("pos").alias("gone"))
        .select(F.col("doc_id").alias("gone_id"), F.col("row_hash").alias("gone_row"), "gone")
    )
    rows = documents.withColumn("row_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = rows.join(gone, (F.col("doc_id").cast("long") == F.col("gone_id")) & (F.col("row_hash") == F.col("gone_row")), "left")
    split = joined.withColumn("lines", _split(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    rebuilt = split.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in documents.columns], F.size("lines").cast("long").alias("lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed")
    )
    return rebuilt, columns


def drop_boilerplate(documents: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows of ``documents`` with the text rebuilt, and two columns: n_lines, n_removed."""
    rebuilt, columns = _rebuilt(documents, site, min_sites, min_chars)
    kept = [c for name, c in zip(documents.columns, columns) if name.lower() not in ("n_lines", "n_removed")]
    return rebuilt.select(*kept, F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"))


def without_boilerplate(documents: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows of ``documents`` with their columns and the text rebuilt."""
    rebuilt, columns = _rebuilt(documents, site, min_sites, min_chars)
    return rebuilt.select(*columns)
