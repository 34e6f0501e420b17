"""Draft to item: noise veto, relevance gate, category, place, severity, facts, id.

The whole step is map-only.  Filters run before the columns they make needless:
required fields, then noise, then relevance, then places, tokens and ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions import grading, text
from newsweft.operators.classify import Classifier, with_terms
from newsweft.schemas import ITEM_COLUMNS

MIN_RELEVANCE = 4
UNGATED_KINDS = ("Alert", "Humanitarian")


def match_text(title: Column, snippet: Column) -> Column:
    """The text that all rules read."""
    return F.concat(text.strip(title), F.lit(" "), F.coalesce(snippet, F.lit("")))


def read_rules(df: DataFrame, content: Column, classifier: Classifier, name: str = "_read") -> DataFrame:
    """Add ``name`` = ``struct<noise, guess, anchor>`` and the matched terms in ``_terms``."""
    found = with_terms(df, content, classifier)
    terms = F.col("_terms")
    return found.withColumn(
        name,
        F.explode(
            F.array(
                F.struct(
                    classifier.is_noise(terms).alias("noise"),
                    classifier.category(terms).alias("guess"),
                    classifier.anchor(terms).alias("anchor"),
                )
            )
        ),
    )


def enrich(
    drafts: DataFrame,
    sources: DataFrame,
    classifier: Classifier | None = None,
    min_relevance: int = MIN_RELEVANCE,
) -> DataFrame:
    """Turn drafts into items (schema ``newsweft.schemas.ITEMS``).

    ``language`` is left null here; :func:`newsweft.operators.language.flag_foreign` fills it.
    """
    c = classifier or Classifier()
    defs = sources.select(
        "source_id", F.col("name").alias("_source"), F.col("kind").alias("_source_kind"), F.col("force_category").alias("_force")
    )
    ready = (
        drafts.filter(~text.is_blank(F.col("title")) & ~text.is_blank(F.col("url")))
        .withColumn("title", text.strip(F.col("title")))
        .withColumn("snippet", F.coalesce("snippet", F.lit("")))
        .join(defs, "source_id")
    )
    read = read_rules(ready, match_text(F.col("title"), F.col("snippet")), c)
    guess, anchor = F.col("_read.guess"), F.col("_read.anchor")
    relevant = F.col("_source_kind").isin(*UNGATED_KINDS) | anchor.isNotNull() | (guess["score"] >= min_relevance)
    kept = read.filter(F.col("event_key").isNotNull() | ~F.col("_read.noise")).filter(relevant)

    content = match_text(F.col("title"), F.col("snippet"))
    category = F.coalesce("_force", anchor["category"], guess["category"])
    final = kept.select(
        text.fnv1a_hex(F.col("url")).alias("id"),
        "kind",
        F.col("_source").alias("source"),
        "title",
        F.when(text.restates(F.col("title"), F.col("snippet")), "").otherwise(F.col("snippet")).alias("snippet"),
        "url",
        F.least("published", F.col("fetched") + F.expr("INTERVAL 5 MINUTES")).alias("published"),
        "fetched",
        F.coalesce("category_override", category).alias("category"),
        F.coalesce("severity", grading.severity_from_text(content, category)).cast("int").alias("severity"),
        F.coalesce("place", c.best_place(F.col("_terms"))).alias("place"),
        text.tokenize(content).alias("tokens"),
        F.concat(
            F.coalesce("facts", F.array().cast("array<struct<k:string,v:string>>")),
            grading.facts_array(("toll", text.toll(content)), ("anchor", anchor["anchor_id"])),
        ).alias("facts"),
        guess["score"].cast("bigint").alias("relevance"),
        "event_key",
        "thumbnail",
        F.lit(None).cast("string").alias("language"),
        anchor["anchor_id"].alias("anchor_id"),
    )
    return final.select(*[F.col(n).cast(t).alias(n) for n, t in ITEM_COLUMNS])
