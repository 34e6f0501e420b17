"""Fixtures and a plain sequential model that small Spark results are checked against."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import functions as F

from newsweft.rules.vocabulary import STOP_WORDS
from newsweft.schemas import ITEMS


def column(spark, values, build, kind="string"):
    """Apply a column builder to single values; results in input order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()]


def tokens(text):
    out = []
    for raw in re.split(r"[^\w]+|_", text):
        word = raw.lower()
        if len(raw.encode()) >= 3 and word not in STOP_WORDS and not word.isdigit() and word not in out:
            out.append(word)
    return out


def item(id, title, category="Other", at=None, place=None, kind="Article", event_key=None, anchor=None, severity=2, source="test", fetched=None):
    at = at or dt.datetime(2026, 9, 18, 12, 0, 0)
    where = None
    if place is not None:
        name, lat, lon = place
        where = {"name": name, "point": {"lat": float(lat), "lon": float(lon)}, "radius_deg": 2.0, "bbox": None}
    facts = [{"k": "anchor", "v": anchor}] if anchor else []
    return (
        id, kind, source, title, "", f"https://example.org/{id}", at, fetched or at, category, severity, where, tokens(title), facts, 10,
        event_key, None, None, anchor,
    )


def items(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


# ---------------------------------------------------------------- sequential model


def distance(a, b):
    (la, lo), (lb, lp) = a, b
    p1, p2 = math.radians(la), math.radians(lb)
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


PHYSICAL = ("Earthquake", "NaturalDisaster")


def score(one, story):
    """``one``: tokens, category, point, published; ``story``: counts, category, point, last_update."""
    if not one["tokens"] or not story["counts"]:
        return 0.0
    shared = sum(1 + math.log(1 + story["counts"][t]) for t in one["tokens"] if t in story["counts"])
    total = min(1.0, shared / (len(one["tokens"]) + math.sqrt(len(story["counts"]))))
    total += 0.12 if one["category"] == story["category"] else 0.0 if one["category"] == "Other" else -0.15
    if one["point"] and story["point"]:
        d = distance(one["point"], story["point"])
        if one["category"] in PHYSICAL and story["category"] in PHYSICAL and d > 600:
            return 0.0
        total += 0.16 if d < 150 else 0.08 if d < 600 else -0.12 if d > 3000 else 0.0
    gap = int(abs((one["published"] - story["last_update"]).total_seconds()) // 3600)
    total += -0.20 if gap > 72 else -0.08 if gap > 36 else 0.0
    return max(0.0, min(1.0, total))
