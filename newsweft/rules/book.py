"""Rule tables as DataFrames, and the small bundle that the operators read.

Every table can be replaced: pass DataFrames with the documented columns to
:meth:`RuleBook.from_tables`.  Rule tables are small by contract and their size
is checked before they are read to the driver; a dictionary beyond the limit
goes through :func:`newsweft.operators.dictmatch.keyword_hits`, which joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from newsweft.rules import feeds, places, vocabulary

MAX_RULE_ROWS = 20_000

CATEGORY_SCHEMA = "category string, label string, tag string, cat_ord int"
SEVERITY_SCHEMA = "severity int, label string, weight double"
RULE_SCHEMA = "rule_id int, category string, weight int, keyword string"
ANCHOR_SCHEMA = "anchor_id string, anchor_ord int, category string, title string, home string"
ANCHOR_TERM_SCHEMA = "anchor_id string, decisive boolean, term string"
GAZETTEER_SCHEMA = "ord int, name string, aliases array<string>, lat double, lon double, radius_deg double, weight int"
REGION_SCHEMA = "region string, lon_min double, lon_max double, lat_min double, lat_max double"
SOURCE_SCHEMA = (
    "source_id string, name string, kind string, url string, parser string, interval_s int, "
    "force_category string, opt_in boolean"
)


def local_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Rows kept in the plan with a known size, so the optimizer itself may broadcast them."""
    fields = StructType.fromDDL(schema)
    columns = [list(c) for c in zip(*rows)] or [[] for _ in fields]
    arrow = to_arrow_schema(fields)
    return spark.createDataFrame(
        pa.table([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow), schema=fields
    )


def _terms(text: str) -> list[str]:
    return [t.strip().lower() for t in text.split(";") if t.strip()]


def categories(spark: SparkSession) -> DataFrame:
    rows = [(n, label, tag, i) for i, (n, label, tag) in enumerate(vocabulary.CATEGORIES)]
    return local_table(spark, rows, CATEGORY_SCHEMA)


def severities(spark: SparkSession) -> DataFrame:
    return local_table(spark, vocabulary.SEVERITIES, SEVERITY_SCHEMA)


def category_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, c, w, k) for i, (c, w, words) in enumerate(vocabulary.CATEGORY_RULES) for k in _terms(words)]
    return local_table(spark, rows, RULE_SCHEMA)


def anchors(spark: SparkSession) -> DataFrame:
    rows = [(a, i, c, t, home) for i, (a, c, t, _, _, home) in enumerate(vocabulary.ANCHORS)]
    return local_table(spark, rows, ANCHOR_SCHEMA)


def anchor_terms(spark: SparkSession) -> DataFrame:
    rows = [
        (a, decisive, term)
        for a, _, _, strong, weak, _ in vocabulary.ANCHORS
        for decisive, words in ((True, strong), (False, weak))
        for term in _terms(words)
    ]
    return local_table(spark, rows, ANCHOR_TERM_SCHEMA)


def noise_terms(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(t,) for t in vocabulary.NOISE_TERMS], "term string")


def gazetteer(spark: SparkSession) -> DataFrame:
    rows = [(i, n, _terms(a), lat, lon, r, w) for i, (n, a, lat, lon, r, w) in enumerate(places.GAZETTEER)]
    return local_table(spark, rows, GAZETTEER_SCHEMA)


def regions(spark: SparkSession) -> DataFrame:
    return local_table(spark, places.REGIONS, REGION_SCHEMA)


def sources(spark: SparkSession) -> DataFrame:
    return local_table(spark, feeds.SOURCES, SOURCE_SCHEMA)


def small_rows(df: DataFrame, what: str, limit: int = MAX_RULE_ROWS) -> list:
    """Rows of a rule table, after checking that it really is small."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; join it with keyword_hits instead")
    return rows


@dataclass(frozen=True)
class Place:
    ord: int
    name: str
    aliases: tuple[str, ...]
    lat: float
    lon: float
    radius_deg: float
    weight: int


@dataclass(frozen=True)
class Anchor:
    id: str
    category: str
    title: str
    home: str
    decisive: tuple[str, ...]
    supporting: tuple[str, ...]


@dataclass(frozen=True)
class RuleBook:
    """Dictionaries used by enrichment.  ``rules`` holds (category, weight, keywords)."""

    rules: tuple[tuple[str, int, tuple[str, ...]], ...] = field(
        default_factory=lambda: tuple((c, w, tuple(_terms(k))) for c, w, k in vocabulary.CATEGORY_RULES)
    )
    anchors: tuple[Anchor, ...] = field(
        default_factory=lambda: tuple(
            Anchor(a, c, t, home, tuple(_terms(s)), tuple(_terms(w))) for a, c, t, s, w, home in vocabulary.ANCHORS
        )
    )
    noise: tuple[str, ...] = tuple(vocabulary.NOISE_TERMS)
    gazetteer: tuple[Place, ...] = field(
        default_factory=lambda: tuple(
            Place(i, n, tuple(_terms(a)), lat, lon, r, w)
            for i, (n, a, lat, lon, r, w) in enumerate(places.GAZETTEER)
        )
    )

    @staticmethod
    def from_tables(
        rules: DataFrame | None = None,
        anchors: DataFrame | None = None,
        anchor_terms: DataFrame | None = None,
        noise: DataFrame | None = None,
        gazetteer: DataFrame | None = None,
    ) -> "RuleBook":
        """A book whose given tables replace the built-in ones (schemas above)."""
        parts: dict = {}
        if rules is not None:
            grouped: dict[int, tuple[str, int, list[str]]] = {}
            for r in sorted(small_rows(rules, "rules"), key=lambda r: r["rule_id"]):
                grouped.setdefault(r["rule_id"], (r["category"], r["weight"], []))[2].append(r["keyword"].lower())
            parts["rules"] = tuple((c, w, tuple(k)) for c, w, k in grouped.values())
        if (anchors is None) != (anchor_terms is None):
            raise ValueError("pass anchors and anchor_terms together")
        if anchors is not None:
            terms = small_rows(anchor_terms, "anchor terms")

            def of(anchor_id: str, decisive: bool) -> tuple[str, ...]:
                return tuple(t["term"].lower() for t in terms if t["anchor_id"] == anchor_id and t["decisive"] == decisive)

            parts["anchors"] = tuple(
                Anchor(a["anchor_id"], a["category"], a["title"], a["home"], of(a["anchor_id"], True), of(a["anchor_id"], False))
                for a in sorted(small_rows(anchors, "anchors"), key=lambda a: a["anchor_ord"])
            )
        if noise is not None:
            parts["noise"] = tuple(r["term"].lower() for r in small_rows(noise, "noise"))
        if gazetteer is not None:
            ordered = sorted(small_rows(gazetteer, "gazetteer"), key=lambda g: g["ord"])
            parts["gazetteer"] = tuple(
                Place(i, g["name"], tuple(a.lower() for a in g["aliases"]), g["lat"], g["lon"], g["radius_deg"], g["weight"])
                for i, g in enumerate(ordered)
            )
        return RuleBook(**parts)

    def lookup(self, name: str) -> Place | None:
        """First gazetteer entry whose name or alias equals ``name``."""
        low = name.strip().lower()
        return next((p for p in self.gazetteer if p.name.lower() == low or low in p.aliases), None)
