"""Severity, category and ranking scalars as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweft.functions.binding import let
from newsweft.functions.text import has_text
from newsweft.rules.vocabulary import (
    CATEGORIES,
    CRITICAL_TERMS,
    ELEVATED_TERMS,
    SEVERE_TERMS,
    SEVERITIES,
)

CATEGORY_ORDER = {name: i for i, (name, _, _) in enumerate(CATEGORIES)}
INFO, WATCH, ELEVATED, SEVERE, CRITICAL = range(5)


def _lookup(key: Column, pairs: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def category_ord(category: Column) -> Column:
    return _lookup(category, CATEGORY_ORDER)


def category_label(category: Column) -> Column:
    return _lookup(category, {n: label for n, label, _ in CATEGORIES})


def category_tag(category: Column) -> Column:
    return _lookup(category, {n: tag for n, _, tag in CATEGORIES})


def severity_weight(severity: Column) -> Column:
    return _lookup(severity, {level: w for level, _, w in SEVERITIES})


def severity_label(severity: Column) -> Column:
    return _lookup(severity, {level: label for level, label, _ in SEVERITIES})


def is_physical(category: Column) -> Column:
    """Events of these categories happen at one place and time."""
    return category.isin("Earthquake", "NaturalDisaster")


def severity_from_text(text: Column, category: Column) -> Column:
    """Severity read from the wording (plain substrings), else from the category."""


    # Plain substring tests scan bytes; one long regular expression is many times slower.
    def worded(lower: Column) -> Column:
        def says(terms: list[str]) -> Column:
            return reduce(lambda a, b: a | b, [F.contains(lower, F.lit(t)) for t in terms])

        return F.when(says(CRITICAL_TERMS), CRITICAL).when(says(SEVERE_TERMS), SEVERE).when(says(ELEVATED_TERMS), ELEVATED)

    by_category = (
        F.when(category.isin("UkraineWar", "MiddleEast", "ArmedConflict", "Terrorism"), ELEVATED)
        .when(category.isin("Other", "Politics", "Economy"), INFO)
        .otherwise(WATCH)
    )
    return F.coalesce(let(F.lower(text), worded), by_category)


def severity_from_alert_level(level: Column) -> Column:
    low = F.lower(level)
    return F.when(low == "red", CRITICAL).when(low == "orange", SEVERE).when(low == "green", WATCH).otherwise(INFO)


def severity_from_magnitude(magnitude: Column, tsunami: Column) -> Column:
    return (
        F.when(tsunami | (magnitude >= 7), CRITICAL)
        .when(magnitude >= 6, SEVERE)
        .when(magnitude >= 5, ELEVATED)
        .otherwise(WATCH)
    )


# Hazard codes and their names.
HAZARD_LABELS = {
    "EQ": "earthquake", "TC": "tropical cyclone", "FL": "flood", "VO": "volcano",
    "DR": "drought", "WF": "wildfire", "TS": "tsunami",
}


def hazard_label(code: Column) -> Column:
    return F.coalesce(_lookup(code, HAZARD_LABELS), F.lit("hazard"))


def hazard_category(code: Column) -> Column:
    return F.when(code == "EQ", "Earthquake").otherwise("NaturalDisaster")


def heat_band(heat: Column) -> Column:
    """0 (quiet) to 4 (hottest)."""
    return F.when(heat > 14, 4).when(heat > 7, 3).when(heat > 3, 2).when(heat > 1, 1).otherwise(0)


def fact(facts: Column, key: str) -> Column:
    """Value of the first fact with this key."""
    return F.get(F.filter(facts, lambda f: f["k"] == key), F.lit(0))["v"]


def facts_array(*pairs: tuple[str, Column]) -> Column:
    """Facts in the given order; pairs with a blank value are left out."""
    made = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in pairs])
    return F.filter(made, lambda f: has_text(f["v"]))


# Terms of the item-to-story score, each on its own so it can be tested.
JOIN_THRESHOLD = 0.34


def lexical_score(shared_weight: Column, item_tokens: Column, story_tokens: Column) -> Column:
    """``shared_weight`` is the sum of ``1 + ln(1 + n)`` over shared tokens."""
    return F.when(item_tokens == 0, 0.0).otherwise(
        F.least(F.lit(1.0), shared_weight / (item_tokens + F.sqrt(story_tokens)))
    )


def token_weight(n: Column) -> Column:
    return 1.0 + F.log1p(n)


def category_bonus(item: Column, story: Column) -> Column:
    return F.when(item == story, 0.12).when(item == "Other", 0.0).otherwise(-0.15)


def geo_bonus(km: Column) -> Column:
    """0 when either side has no place (null distance)."""
    return F.when(km < 150, 0.16).when(km < 600, 0.08).when(km > 3000, -0.12).otherwise(0.0)


def time_penalty(published: Column, last_update: Column) -> Column:
    gap = F.abs(F.timestamp_diff("HOUR", last_update, published))
    return F.when(gap > 72, -0.20).when(gap > 36, -0.08).otherwise(0.0)


def similarity(lexical: Column, item_category: Column, story_category: Column, km: Column,
               published: Column, last_update: Column) -> Column:
    """Full score in 0..1; two physical events far apart never match."""
    apart = is_physical(item_category) & is_physical(story_category) & F.coalesce(km > 600, F.lit(False))
    total = lexical + category_bonus(item_category, story_category) + geo_bonus(km) + time_penalty(published, last_update)
    return F.when(apart, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def near_in_space(a_category: Column, km: Column) -> Column:
    """Merge guard: 400 km for physical events, else 800 km; unknown distance counts as near."""
    limit = F.when(is_physical(a_category), 400.0).otherwise(800.0)
    return F.coalesce(km < limit, F.lit(True))
