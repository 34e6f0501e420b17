"""Category scores, anchors, noise and places of a text, all map-only.

One regular expression over all dictionaries reads the text once; everything
else works on the short array of matched terms inside the same row.
"""

from __future__ import annotations

import json
import math
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions.binding import let
from newsweft.functions.grading import CATEGORY_ORDER
from newsweft.operators.dictmatch import TermPattern
from newsweft.rules.book import RuleBook
from newsweft.rules.vocabulary import CATEGORIES
from newsweft.schemas import PLACE

_HIT_CAP = 3  # fixed value: keyword hits of one rule beyond the third do not count
CELL_DEG = 3  # cells of the lists of nearest entries


def _on_globe(lat: float, lon: float) -> tuple[float, float, float]:
    phi, lam = math.radians(lat), math.radians(lon)
    return math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi)


def _literal(rows: list, kind: str) -> Column:
    """A constant array column; folded once by the optimizer."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


class Classifier:
    """Column builders over one :class:`RuleBook`."""

    def __init__(self, book: RuleBook | None = None) -> None:
        self.book = book or RuleBook()
        b = self.book
        terms = set(b.noise)
        terms.update(k for _, _, words in b.rules for k in words)
        terms.update(t for a in b.anchors for t in a.decisive + a.supporting)
        terms.update(t for p in b.gazetteer for t in p.aliases)
        self.pattern = TermPattern(terms)

    def positions(self, text: Column) -> Column:
        """All dictionary terms found, longest per position, in text order."""
        return self.pattern.positions(text)

    # The methods below take the column made by ``positions``.

    def is_noise(self, positions: Column) -> Column:
        marks = self.pattern.expand(positions, {t: [1] for t in self.book.noise}, "int")
        return F.size(marks) > 0

    def category_scores(self, positions: Column) -> Column:
        """Score of every category with a hit, ``array<struct<score, cat_ord>>``."""
        payload: dict[str, list] = {}
        number = 0
        for rule, (category, weight, words) in enumerate(self.book.rules):
            for word in words:
                payload.setdefault(word, []).append({"kw": number, "cat": CATEGORY_ORDER[category], "rule": rule, "w": weight})
                number += 1
        # A keyword counts once however often it occurs.
        found = F.array_distinct(self.pattern.expand(positions, payload, "struct<kw:int,cat:int,rule:int,w:bigint>"))

        def scores(hits: Column) -> Column:
            def score(c: Column) -> Column:
                rules = F.array_distinct(
                    F.transform(F.filter(hits, lambda h: h["cat"] == c), lambda h: F.struct(h["rule"].alias("rule"), h["w"].alias("w")))
                )
                total = F.aggregate(
                    rules,
                    F.lit(0).cast("bigint"),
                    lambda acc, r: acc + r["w"] * F.least(F.size(F.filter(hits, lambda h: h["rule"] == r["rule"])), F.lit(_HIT_CAP)),
                )
                return F.struct(total.alias("score"), c.alias("cat_ord"))

            return F.transform(F.array_distinct(F.transform(hits, lambda h: h["cat"])), score)

        return let(found, scores)

    def category(self, positions: Column) -> Column:
        """Best category, ``struct<category, score>``; ties go to the later category."""
        names = _literal([n for n, _, _ in CATEGORIES], "string")

        def named(best: Column) -> Column:
            return F.struct(
                F.when(best["score"] > 0, F.element_at(names, best["cat_ord"] + 1)).otherwise(F.lit("Other")).alias("category"),
                best["score"].alias("score"),
            )

        none = F.struct(F.lit(0).cast("bigint").alias("score"), F.lit(len(CATEGORIES) - 1).alias("cat_ord"))
        return let(F.coalesce(F.array_max(self.category_scores(positions)), none), named)

    def anchor(self, positions: Column) -> Column:
        """Best qualifying anchor, ``struct<anchor_id, category, score>`` or null; ties go to the earlier one."""
        payload: dict[str, list] = {}
        for number, a in enumerate(self.book.anchors):
            for strong, words in ((1, a.decisive), (0, a.supporting)):
                for word in words:
                    payload.setdefault(word, []).append({"a": number, "strong": strong, "t": word})
        found = F.array_distinct(self.pattern.expand(positions, payload, "struct<a:int,strong:int,t:string>"))

        table = _literal([{"id": a.id, "category": a.category} for a in self.book.anchors], "struct<id:string,category:string>")

        def winner(hits: Column) -> Column:
            def score(a: Column) -> Column:
                strong = F.size(F.filter(hits, lambda h: (h["a"] == a) & (h["strong"] == 1)))
                weak = F.size(F.filter(hits, lambda h: (h["a"] == a) & (h["strong"] == 0)))
                return F.when((strong > 0) | (weak >= 2), F.struct((strong * 2 + weak).alias("score"), (-a).alias("rank")))

            return F.array_max(F.array_compact(F.transform(F.array_distinct(F.transform(hits, lambda h: h["a"])), score)))

        def named(best: Column) -> Column:
            row = F.element_at(table, 1 - best["rank"])
            made = F.struct(row["id"].alias("anchor_id"), row["category"].alias("category"), best["score"].alias("score"))
            return F.when(best.isNotNull(), made)

        return F.when(F.size(positions) > 0, let(let(found, winner), named))

    @cached_property
    def _places(self) -> Column:
        rows = [
            {"name": p.name, "point": {"lat": p.lat, "lon": p.lon}, "radius_deg": p.radius_deg, "bbox": None}
            for p in self.book.gazetteer
        ]
        return _literal(rows, PLACE)

    def places(self, positions: Column) -> Column:
        """Every gazetteer place named in the text, best first, as ``array<place>``.

        Rank: weight descending, position ascending, alias length descending, table order.
        """
        payload: dict[str, list] = {}
        for p in self.book.gazetteer:
            for alias in p.aliases:
                payload.setdefault(alias, []).append({"w": -p.weight, "len": -len(alias), "ord": p.ord})
        kind = "struct<w:int,len:int,ord:int>"
        rows = self.pattern.payload_rows(payload, kind)
        hits = F.flatten(
            F.transform(
                positions,
                lambda t, i: F.transform(
                    rows(t),
                    lambda h: F.struct(h["w"].alias("w"), i.alias("at"), h["len"].alias("len"), h["ord"].alias("ord")),
                ),
            )
        )
        # sort_array, not array_sort: the latter compares through an interpreted lambda.
        ranked = F.array_distinct(F.transform(F.sort_array(hits), lambda h: h["ord"]))
        return F.transform(ranked, lambda o: F.element_at(self._places, o + 1))

    def best_place(self, positions: Column) -> Column:
        return F.get(self.places(positions), F.lit(0))

    def place_by_name(self, name: Column) -> Column:
        """First gazetteer entry whose name or alias equals the trimmed, lower-cased name."""
        table: dict[str, int] = {}
        for p in reversed(self.book.gazetteer):
            for key in (p.name.lower(), *p.aliases):
                table[key] = p.ord
        index = F.from_json(F.lit(json.dumps(table)), "map<string,int>")
        return F.element_at(self._places, F.try_element_at(index, F.lower(F.trim(name))) + 1)

    @cached_property
    def near_lists(self) -> list[list[int]]:
        """Per cell of ``CELL_DEG`` degrees, the entries that can be the nearest one to some point of the cell.

        A cell lies in a cap around its centre. Entry a is nearer than b on one side of the plane halfway between them, so b is
        left out when that plane leaves the whole cap on a's side. The one entry of a gazetteer is in all lists.
        """
        entries = np.array([_on_globe(p.lat, p.lon) for p in self.book.gazetteer]).reshape(-1, 3)
        lists: list[list[int]] = []
        for south in range(-90, 90, CELL_DEG):
            half = CELL_DEG / 2
            centres = np.array([_on_globe(south + half, west + half) for west in range(-180, 180, CELL_DEG)])
            corners = np.array([_on_globe(lat, -180) for lat in (south, south + CELL_DEG)])
            reach = math.sqrt(max(((corners - centres[0]) ** 2).sum(axis=1))) + 1e-9  # the longest chord from a centre
            chords = np.sqrt(np.maximum(0.0, 2 - 2 * centres @ entries.T))
            for centre, chord in zip(centres, chords):
                some = np.flatnonzero(chord <= chord.min(initial=4.0) + 2 * reach)
                apart = entries[some][:, None, :] - entries[some][None, :, :]
                ahead = apart @ centre > np.sqrt((apart**2).sum(axis=2)) * reach
                lists.append(some[~ahead.any(axis=0)].tolist())
        return lists

    def nearest_place(self, point: Column) -> Column:
        """The query point, labelled with the nearest entry's name; radius at most 2 degrees."""
        # The straight chord between points on the globe grows with the great-circle distance,
        # and needs no trigonometry per entry.
        axes = [_on_globe(p.lat, p.lon) for p in self.book.gazetteer]
        table = _literal([{"x": x, "y": y, "z": z} for x, y, z in axes], "struct<x:double,y:double,z:double>")
        lists = _literal([*self.near_lists, list(range(len(axes)))], "array<int>")
        columns, rows = 360 // CELL_DEG, 180 // CELL_DEG
        row = F.least(F.floor((point["lat"] + 90) / CELL_DEG), F.lit(rows - 1))
        column = F.least(F.floor((point["lon"] + 180) / CELL_DEG), F.lit(columns - 1))
        # Coordinates off the usual ranges are asked of every entry.
        usual = point["lat"].between(-90, 90) & point["lon"].between(-180, 180)
        cell = F.when(usual, row * columns + column).otherwise(rows * columns).cast("int")

        def closest(at: Column) -> Column:
            def chord(o: Column) -> Column:
                def squared(e: Column) -> Column:
                    dx, dy, dz = e["x"] - at["x"], e["y"] - at["y"], e["z"] - at["z"]
                    return F.struct((dx * dx + dy * dy + dz * dz).alias("d2"), o.alias("ord"))

                return let(F.get(table, o), squared)

            return F.array_min(F.transform(at["near"], chord))["ord"]

        phi, lam = F.radians(point["lat"]), F.radians(point["lon"])
        at = F.struct(
            (F.cos(phi) * F.cos(lam)).alias("x"), (F.cos(phi) * F.sin(lam)).alias("y"), F.sin(phi).alias("z"), F.get(lists, cell).alias("near")
        )

        def labelled(row: Column) -> Column:
            return F.struct(
                row["name"].alias("name"),
                F.struct(point["lat"].alias("lat"), point["lon"].alias("lon")).alias("point"),
                F.least(row["radius_deg"], F.lit(2.0)).alias("radius_deg"),
                F.lit(None).cast("array<double>").alias("bbox"),
            )

        found = F.element_at(self._places, let(at, closest) + 1)
        return F.when(point["lat"].isNotNull() & point["lon"].isNotNull(), let(found, labelled))


def with_terms(df: DataFrame, text: Column, classifier: Classifier, name: str = "_terms") -> DataFrame:
    """Add the matched terms as a column that later filters cannot duplicate.

    A plain projection would be copied into every filter that is pushed below it,
    and the dictionary match would run twice.  Exploding a one-element array keeps
    the match a single evaluation per row, and still needs no shuffle.
    """
    return df.withColumn(name, F.explode(F.array(classifier.positions(text))))
