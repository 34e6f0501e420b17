"""Joins on places: name lookup, nearest entry, regions, nearest marker, density."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.functions.geo import grid_cell, in_box
from newsweft.operators.classify import Classifier
from newsweft.operators.dictmatch import keyword_hits
from newsweft.session import cut_lineage

REGION_CELL = 10.0  # degrees
CROWD = 4  # markers in a marker's cell, on average, of the narrowest cells
MOST_HALVINGS = 12  # of the width of the cells of markers
NEAREST_WIDTHS = (0.02, 0.16, 2.5)  # cells in radii of the globe: some 130 km, 1,000 km, and the globe


def lookup_names(df: DataFrame, name_col: str, classifier: Classifier) -> DataFrame:
    """Adds ``place``: first gazetteer entry with this display name or alias."""
    return df.withColumn("place", classifier.place_by_name(F.col(name_col)))


def lookup_names_join(df: DataFrame, name_col: str, gazetteer: DataFrame) -> DataFrame:
    """The same as an equi-join, for a gazetteer of any size."""
    keys = gazetteer.select("*", F.explode(F.array_union(F.array(F.lower("name")), "aliases")).alias("_key"))
    first = keys.groupBy("_key").agg(F.min_by(F.struct("name", "lat", "lon", "radius_deg"), "ord").alias("entry"))
    return df.withColumn("_key", F.lower(F.trim(name_col))).join(first, "_key", "left").drop("_key")


def label_points(df: DataFrame, lat: str, lon: str, classifier: Classifier) -> DataFrame:
    """Adds ``place``, the point labelled by the nearest gazetteer entry."""
    point = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    return df.withColumn("place", classifier.nearest_place(point))


def within_regions(points: DataFrame, regions: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points with every region box that holds them, for any number of boxes.

    Boxes are listed in every ``REGION_CELL`` degree cell that they touch, so the range join is
    an equi-join on the cell of the point; each pair meets in that one cell only.
    """

    def cell(c: Column) -> Column:
        return F.floor(c / REGION_CELL).cast("int")

    listed = (
        regions.filter("lon_min <= lon_max and lat_min <= lat_max")
        .withColumn("_cx", F.explode(F.sequence(cell(F.col("lon_min")), cell(F.col("lon_max")))))
        .withColumn("_cy", F.explode(F.sequence(cell(F.col("lat_min")), cell(F.col("lat_max")))))
    )
    placed = points.withColumn("_cx", cell(F.col(lon))).withColumn("_cy", cell(F.col(lat)))
    inside = in_box(F.col(lat), F.col(lon), F.col("lon_min"), F.col("lon_max"), F.col("lat_min"), F.col("lat_max"))
    return placed.join(listed, ["_cx", "_cy"]).filter(inside).drop("_cx", "_cy")


def ranked_places_join(df: DataFrame, id_col: str, text_col: str, gazetteer: DataFrame) -> DataFrame:
    """(id, rank, name, ord): every place named in a text, best first, for a gazetteer of any size.

    Rank: weight descending, position ascending, alias length descending, table order.
    """
    aliases = gazetteer.select("ord", "name", "weight", F.explode(F.transform("aliases", F.lower)).alias("alias"))
    hits = keyword_hits(df, id_col, text_col, aliases, "alias")
    order = F.struct((-F.col("weight")).alias("w"), F.col("first_at").alias("at"), (-F.length("alias")).alias("len"), F.col("ord").alias("ord"))
    best = hits.groupBy(id_col, "ord", "name").agg(F.min(order).alias("order"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("order"))
    return best.select(id_col, rank.alias("rank"), "name", "ord")


def nearest_place_join(points: DataFrame, id_col: str, gazetteer: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(id, ord, name): the nearest entry of each point, for a gazetteer of any size.

    Entries are listed by cells of a cube grid around the globe, at ever coarser levels; a point looks into the 27
    cells around its own. What a level finds within one cell's width is the nearest of all; points that find
    none go to the next level, the last of which holds the globe. Ties go to the first entry.
    """

    def axes(a: str, o: str) -> list[Column]:
        phi, lam = F.radians(F.col(a)), F.radians(F.col(o))
        return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]

    left = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(id_col, *[c.alias(n) for c, n in zip(axes(lat, lon), "xyz")])
    entries = gazetteer.select("ord", "name", *[c.alias(n) for c, n in zip(axes("lat", "lon"), ("ex", "ey", "ez"))])
    found = []
    for width in NEAREST_WIDTHS:
        near = left
        for n in "xyz":
            around = F.array(*[F.floor(F.col(n) / width) + d for d in (-1, 0, 1)])
            near = near.withColumn(f"c{n}", F.explode(around))
        listed = entries.select("*", *[F.floor(F.col(f"e{n}") / width).alias(f"c{n}") for n in "xyz"])
        squared = sum(((F.col(f"e{n}") - F.col(n)) ** 2 for n in "xyz"), F.lit(0.0))
        best = (
            near.join(listed, ["cx", "cy", "cz"])
            .withColumn("d2", squared)
            .groupBy(id_col)
            .agg(F.min(F.struct("d2", "ord", "name")).alias("best"))
        )
        if width < NEAREST_WIDTHS[-1]:
            best = best.filter(F.col("best.d2") <= width * width)
        best = cut_lineage(best)
        found.append(best.select(id_col, "best.ord", "best.name"))
        left = left.join(best.select(id_col), id_col, "left_anti")
    return reduce(DataFrame.unionByName, found)


def density(points: DataFrame, nx: int, ny: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points per cell of an equirectangular world grid."""
    cell = grid_cell(F.col(lat), F.col(lon), nx, ny)
    return points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(cell["cx"].alias("cx"), cell["cy"].alias("cy")).agg(
        F.count("*").alias("n")
    )


def nearest_marker(points: DataFrame, markers: DataFrame, max_deg: float, id_col: str = "id") -> DataFrame:
    """Nearest marker within ``max_deg`` degrees (latitude counts double), per point.

    Markers at one position are one, the least of them. Both sides are cut into cells; only the 3 x 3 cells around a point
    can hold a marker within a cell's width, so this is an equi-join for any number of markers. The first cells are
    so narrow that a marker has few others in its own; what is found within the width is the nearest of all, and points
    that find none go to cells of twice the width, up to ``max_deg``. So a point meets a few markers however many there are.
    ``points``: id, lat, lon.  ``markers``: marker_id, lat, lon.
    """
    located = markers.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    pins = cut_lineage(located.groupBy("lat", "lon").agg(F.min(F.struct("marker_id")).alias("first")).select("first.marker_id", F.col("lat").alias("m_lat"), F.col("lon").alias("m_lon")))

    def cells(lat: str, lon: str, width: float) -> list[Column]:
        return [F.floor(F.col(lon) / width), F.floor(F.col(lat) * 2 / width)]

    def crowd(width: float) -> float:
        cx, cy = cells("m_lat", "m_lon", width)
        counts = pins.groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count("*").alias("n"))
        return counts.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0

    halvings = 0
    while halvings < MOST_HALVINGS and crowd(max_deg / 2**halvings) > CROWD:
        halvings += 1
    left = points.select(id_col, "lat", "lon").filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    steps = [F.lit(d) for d in (-1, 0, 1)]
    dx, dy = F.col("m_lon") - F.col("lon"), (F.col("m_lat") - F.col("lat")) * 2
    found = []
    for level in range(halvings, -1, -1):
        width = max_deg / 2**level
        reach = width * (1 - 1e-9) if level else max_deg
        cx, cy = cells("m_lat", "m_lon", width)
        listed = pins.withColumn("cx", F.explode(F.array(*[cx + d for d in steps]))).withColumn("cy", F.explode(F.array(*[cy + d for d in steps])))
        cx, cy = cells("lat", "lon", width)
        near = left.withColumns({"cx": cx, "cy": cy}).join(listed, ["cx", "cy"]).withColumn("d2", dx * dx + dy * dy).filter(F.col("d2") <= reach * reach)
        best = near.groupBy(id_col).agg(F.min_by("marker_id", F.struct("d2", "marker_id")).alias("marker_id"), F.min("d2").alias("d2"))
        if level:
            best = cut_lineage(best)
            left = cut_lineage(left.join(best.select(F.col(id_col).alias("_found")), F.col(id_col).eqNullSafe(F.col("_found")), "left_anti"))
        found.append(best)
    return reduce(DataFrame.unionByName, found)
