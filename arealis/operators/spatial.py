"""Spatial joins as equi-joins on grid cells.

Polygons are small in number but may be large in extent, points and pixels are many. A
polygon is cut into the grid cells it covers; a cell that no edge enters needs no further
test, and one that an edge does enter carries only the edges a ray from it can meet. Points
find their cell by arithmetic, so the join is an ordinary equi-join with the cell index. The
planner cannot see how far the cutting multiplies rows, so the index is measured: within
``BROADCAST_BYTES`` it is broadcast, beyond that both sides are shuffled and AQE splits cells
that hold many points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.geometry import (odd_crossings, point_segment_distance, ring_edges,
                                  segment_distance, strictly_within)
from ..functions.numeric import as_col, finite
from ..session import cut_lineage


def _index(v: Column, cell: float | Column) -> Column:
    return F.floor(v / (cell if isinstance(cell, Column) else F.lit(float(cell)))).cast("bigint")


def edge_cells(edges: DataFrame, cell: float, pad: float, e: dict[str, Column]) -> DataFrame:
    """``edges`` with the cells (ix, iy) within ``pad`` of them.

    A long edge is cut into pieces of a few cells, so that its cells lie along it and do not fill its box.
    """
    span = F.greatest(F.abs(e["x2"] - e["x1"]), F.abs(e["y2"] - e["y1"]))
    n = F.greatest(F.ceil(span / (4.0 * cell)), F.lit(1)).cast("bigint")
    at = lambda a, b, k: e[a] + (e[b] - e[a]) * (k / F.col("__n"))
    cut = edges.withColumn("__n", n).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
    k = F.col("__k")
    ends = {c: (at(f"{c}1", f"{c}2", k), at(f"{c}1", f"{c}2", k + 1)) for c in "xy"}
    # cut points are rounded, so pieces reach a little further than they are long
    slack = pad + cell * 1e-6
    for c in "xy":
        a, b = ends[c]
        cut = cut.withColumn(f"__{c}", F.sequence(_index(F.least(a, b) - slack, cell), _index(F.greatest(a, b) + slack, cell)))
    return (cut.withColumn("ix", F.explode("__x")).withColumn("iy", F.explode("__y"))
            .drop("__n", "__k", "__x", "__y"))


BROADCAST_BYTES = 64 * 1024 * 1024


def sized(index: DataFrame, bytes_per_row: Column) -> DataFrame:
    """The index with the join strategy that its measured size allows."""
    total = index.agg(F.sum(bytes_per_row).alias("b")).first()["b"] or 0
    return F.broadcast(index) if total <= BROADCAST_BYTES else index.hint("merge")


def suggest_cell(polygons: DataFrame, rings: str = "rings", per_side: int = 8) -> float:
    """Cell size that cuts the average polygon into about ``per_side`` cells a side."""
    pts = F.flatten(rings)
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    side = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    mean = polygons.agg(F.avg(side).alias("s")).first()["s"]
    return (mean / per_side) if mean else 1.0


LEVEL_SIDE = 32  # cells a side of a polygon at most


def _extent(rings: str) -> tuple[Column, Column]:
    pts = F.flatten(rings)
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)


def polygon_cells(polygons: DataFrame, keys: list[str], cell: float, rings: str = "rings") -> DataFrame:
    """(level, ix, iy, keys, edges): the cells each polygon covers; ``edges`` is NULL for cells that lie wholly inside.

    A polygon much larger than the others has cells twice, four times .. as wide (its ``level``), so that none has
    more than ``LEVEL_SIDE`` a side. Edges go to the rows of cells that they touch, and only these are gathered.
    """
    side = F.greatest(*_extent(rings)) / (float(cell) * LEVEL_SIDE)
    level = F.when(side > 1, F.ceil(F.log2(side))).otherwise(0).cast("int")
    size = float(cell) * F.pow(F.lit(2.0), F.col("level"))
    parts = polygons.select(*keys, rings, level.alias("level"), F.monotonically_increasing_id().alias("__part"))
    edges = parts.select(*keys, "level", "__part", F.explode(ring_edges(rings)).alias("e"))
    slack = size * 1e-9  # a point on a cell border may be rounded to either side
    low, high = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    rows = edges.withColumn("iy", F.explode(F.sequence(_index(low - slack, size), _index(high + slack, size))))
    rows = rows.groupBy(*keys, "level", "__part", "iy").agg(
        F.collect_list("e").alias("__row"),
        _index(F.min(F.least("e.x1", "e.x2")), F.max(size)).alias("__cx0"),
        _index(F.max(F.greatest("e.x1", "e.x2")), F.max(size)).alias("__cx1"))
    rows = rows.withColumn("ix", F.explode(F.sequence("__cx0", "__cx1")))
    x0, x1 = F.col("ix") * size - slack, (F.col("ix") + 1) * size + slack
    entered = F.exists("__row", lambda e: (F.greatest(e["x1"], e["x2"]) >= x0)
                       & (F.least(e["x1"], e["x2"]) <= x1))
    centre = odd_crossings(F.col("__row"), (F.col("ix") + 0.5) * size, (F.col("iy") + 0.5) * size)
    ahead = F.filter("__row", lambda e: F.greatest(e["x1"], e["x2"]) >= x0)
    return (rows.withColumn("__in", entered).where(F.col("__in") | centre)
            .select("level", "ix", "iy", *keys, F.when(F.col("__in"), ahead).alias("edges")))


def points_in_polygons(points: DataFrame, polygons: DataFrame, keys: list[str], lon: str = "lon",
                       lat: str = "lat", rings: str = "rings", cell: float | None = None) -> DataFrame:
    """Every (point, polygon) pair with the point strictly inside; boundary points are out."""
    cell = cell or suggest_cell(polygons, rings)
    cells = cut_lineage(polygon_cells(polygons, keys, cell, rings))
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    # a few whole numbers: each level is twice as wide as the one before
    levels = cells.agg(F.collect_set("level").alias("l")).scalar()
    size = float(cell) * F.pow(F.lit(2.0), F.col("level"))
    placed = points.where(finite(lon).isNotNull() & finite(lat).isNotNull()).withColumn(
        "level", F.explode(levels)).withColumns({"ix": _index(x, size), "iy": _index(y, size)})
    inside = F.col("edges").isNull() | strictly_within(F.col("edges"), x, y)
    weight = F.lit(64) + F.coalesce(F.size("edges"), F.lit(0)) * 40
    for k in keys:
        weight = weight + F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0))
    return placed.join(sized(cells, weight), ["level", "ix", "iy"]).where(inside).drop("level", "ix", "iy", "edges")


def locate_points(points: DataFrame, polygons: DataFrame, point_key: str, area: str, ordinal: str,
                  lon: str = "lon", lat: str = "lat", rings: str = "rings",
                  cell: float | None = None) -> DataFrame:
    """All points with the first polygon (by ``ordinal``) that holds them, else NULL."""
    first = cut_lineage(_first_of_equal(polygons, area, ordinal, rings))
    hits = points_in_polygons(points.select(point_key, lon, lat), first, [area, ordinal],
                              lon, lat, rings, cell)
    first = hits.groupBy(point_key).agg(F.min_by(area, ordinal).alias(area))
    return points.join(first, point_key, "left")


def _first_of_equal(polygons: DataFrame, area: str, ordinal: str, rings: str) -> DataFrame:
    """Of polygons with equal rings the first by ``ordinal``, the only one of them that can win a point."""
    return polygons.groupBy(rings).agg(F.min_by(F.struct(area, ordinal), ordinal).alias("__p")).select(
        f"__p.{area}", f"__p.{ordinal}", rings)


def dissolve(polygons: DataFrame, area: str, key: Column, carry: list[str] = ()) -> DataFrame:
    """Sub-areas relabelled with their area.

    Parts stay separate rows: a point is in the area when it is in any part, so no union of
    geometries and no gathering of an area's parts is needed.
    """
    rest = [c for c in polygons.columns if c != area]
    return polygons.select(key.alias(area), *rest, *[c for c in carry if c not in rest])


def nearest_polygon(points: DataFrame, polygons: DataFrame, point_key: str, area: str,
                    ordinal: str, max_distance: float, x: str = "x", y: str = "y",
                    rings: str = "rings", cell: float | None = None) -> DataFrame:
    """All points with the nearest polygon within ``max_distance`` (0 inside), else the empty
    key (NULL for keys that are not strings); ties go to the smallest ``ordinal``. Coordinates
    are planar."""
    e = {k: F.col(f"e.{k}") for k in ("x1", "y1", "x2", "y2")}
    placed = points.select(point_key, x, y).where(finite(x).isNotNull() & finite(y).isNotNull())
    string_key = isinstance(polygons.schema[area].dataType, StringType)
    polygons = cut_lineage(_first_of_equal(polygons, area, ordinal, rings))
    inside = cut_lineage(points_in_polygons(placed, polygons, [area, ordinal], x, y, rings).groupBy(point_key).agg(
        F.min_by(F.struct(area, F.lit(0.0).alias("distance")), ordinal).alias("b")))
    left = placed.join(inside, point_key, "left_anti")
    # of polygons that share an edge only the first can win it, so copies drop out here
    edges = cut_lineage(polygons.select(area, ordinal, F.explode(ring_edges(rings)).alias("e"))
                        .groupBy("e").agg(F.min_by(F.struct(area, ordinal), ordinal).alias("__p"))
                        .select(f"__p.{area}", f"__p.{ordinal}", "e"))
    dist = point_segment_distance(F.col(x), F.col(y), e["x1"], e["y1"], e["x2"], e["y2"])
    parts = [inside]
    # what lies within a radius is nearest of all; only points without such an edge look further
    for radius in (max_distance / 8, max_distance):
        size = float(cell or radius)
        spread = edge_cells(edges, size, float(radius), e)
        near = (left.withColumns({"ix": _index(F.col(x), size), "iy": _index(F.col(y), size)})
                .join(sized(spread, F.lit(120)), ["ix", "iy"])
                .select(point_key, area, ordinal, dist.alias("distance")))
        found = cut_lineage(near.groupBy(point_key).agg(
            F.min_by(F.struct(area, "distance"), F.struct("distance", ordinal)).alias("b"))
            .where(F.col("b.distance") <= radius))
        parts.append(found)
        left = left.join(found, point_key, "left_anti")
    best = reduce(lambda p, q: p.unionByName(q), parts)
    found = F.col(f"b.{area}")
    if string_key:
        found = F.coalesce(found, F.lit(""))
    return points.join(best, point_key, "left").select(
        *points.columns, found.alias(area), F.col("b.distance").alias("distance"))


def zonal_mean(pixels: DataFrame, polygons: DataFrame, area: str, raster: str = "raster_id",
               value: str = "value", lon: str = "lon", lat: str = "lat", rings: str = "rings",
               cell: float | None = None) -> DataFrame:
    """Mean of the pixels whose centre lies in each polygon, per raster; an area without any
    pixel of a raster stays with NULL. Missing pixels are left out."""
    seen = pixels.where(finite(value).isNotNull())
    inside = points_in_polygons(seen.select(raster, lon, lat, value), polygons, [area], lon, lat,
                                rings, cell)
    means = inside.groupBy(area, raster).agg(F.avg(value).alias(value),
                                             F.count(F.lit(1)).alias("n_pixels"))
    from .rasters import zone_grid

    grid = zone_grid(polygons, pixels, area, raster)
    return grid.join(means, [area, raster], "left").withColumn(
        "n_pixels", F.coalesce("n_pixels", F.lit(0)))


def sample_raster(points: DataFrame, pixels: DataFrame, x0: float, y0: float, dx: float, dy: float,
                  lon: str = "lon", lat: str = "lat", value: str = "value",
                  nodata: float | None = None, by: list[str] = ()) -> DataFrame:
    """Points with the value of the pixel they fall in, from rasters of one grid.

    ``by`` names further pixel columns (raster, year) to carry; with several rasters a point
    gives one row for each. Nodata and absurdly large values are missing.
    """
    def cell(df, x, y):
        return df.withColumns({"__col": F.floor((F.col(x) - x0) / dx).cast("bigint"),
                               "__row": F.floor((F.col(y) - y0) / dy).cast("bigint")})

    v = F.col(value).cast("double")
    v = F.when(F.abs(v) <= 1e19, v)
    if nodata is not None:
        v = F.when(v != nodata, v)
    grid = cell(pixels, lon, lat).select("__col", "__row", *by, v.alias(f"__{value}"))
    return (cell(points, lon, lat).join(grid, ["__col", "__row"], "left")
            .withColumnRenamed(f"__{value}", value).drop("__col", "__row"))


def sample_mean(points: DataFrame, pixels: DataFrame, point_key: str, x0: float, y0: float,
                dx: float, dy: float, value: str = "value", rescale: Column | None = None,
                **kw) -> DataFrame:
    """Mean over the years of the value at each point, optionally divided by ``rescale``."""
    sampled = sample_raster(points, pixels, x0, y0, dx, dy, value=value, **kw)
    out = sampled.groupBy(point_key).agg(F.avg(value).alias(value))
    return out.withColumn(value, F.col(value) / rescale) if rescale is not None else out


def choose_rasters(rasters: DataFrame, stems: list[str], raster: str = "raster_id") -> DataFrame:
    """One raster per stem: the first in name order that is the stem, starts with ``stem_``
    or holds ``_stem``."""
    low = F.lower(raster)
    tagged = rasters.select(raster).distinct().select(raster, F.explode(F.array(
        *[F.lit(s) for s in stems])).alias("stem"))
    stem = F.col("stem")
    fits = ((low == stem) | F.startswith(low, F.concat(stem, F.lit("_")))
            | F.contains(low, F.concat(F.lit("_"), stem)))
    return tagged.where(fits).groupBy("stem").agg(F.min(raster).alias(raster))


def _held(polygons: DataFrame, area: str, rings: str, reach: float) -> DataFrame:
    """(src, dst): a ring of src begins inside dst and not within ``reach`` of its outline.

    Such a corner lies that far inside the box of dst, which is looked up first: boxes meet corners by cells about as
    wide as the box. Only areas that this leaves are tested with their edges.
    """
    polygons = polygons.withColumnRenamed(area, "dst")
    corner = polygons.select(F.col("dst").alias("src"), F.explode(rings).alias("ring")).select(
        "src", F.get("ring", F.lit(0))["x"].alias("lon"), F.get("ring", F.lit(0))["y"].alias("lat"))
    cell, pts, margin = suggest_cell(polygons, rings, per_side=1), F.flatten(rings), reach / 2.0
    at = {"x": F.transform(pts, lambda p: p["x"]), "y": F.transform(pts, lambda p: p["y"])}
    box = polygons.select("dst", *[(end(at[c]) + d).alias(f"{c}{k}") for c in "xy" for k, (end, d) in enumerate(
        ((F.array_min, margin), (F.array_max, -margin)))]).where("x0 < x1 and y0 < y1")
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / float(cell)
    size = float(cell) * F.pow(F.lit(2.0), F.col("level"))
    box = box.withColumn("level", F.greatest(F.ceil(F.log2(side)), F.lit(0)).cast("int"))
    levels = box.agg(F.collect_set("level").alias("l")).scalar()
    for c in "xy":
        box = box.withColumn(f"i{c}", F.explode(F.sequence(_index(F.col(f"{c}0"), size), _index(F.col(f"{c}1"), size))))
    placed = corner.where(finite("lon").isNotNull() & finite("lat").isNotNull()).withColumn(
        "level", F.explode(levels)).withColumns({"ix": _index(F.col("lon"), size), "iy": _index(F.col("lat"), size)})
    maybe = cut_lineage(placed.join(box, ["level", "ix", "iy"]).where(
        "src <> dst and lon > x0 and lon < x1 and lat > y0 and lat < y1").select("src", "lon", "lat", "dst").distinct())
    if maybe.isEmpty():
        return maybe.select("src", "dst")
    return points_in_polygons(maybe.select("src", "lon", "lat").distinct(), polygons.join(maybe.select("dst").distinct(), "dst", "left_semi"),
                              ["dst"], rings=rings, cell=cell).where("src <> dst").select("src", "dst")


def queen_contiguity(polygons: DataFrame, area: str, rings: str = "rings", tolerance: float = 0.01,
                     cell: float | None = None) -> DataFrame:
    """Row-standardised neighbour table (src, dst, w).

    Areas are neighbours when their outlines come within twice the tolerance of each other,
    or one holds the other. Edges meet by grid cell, so only edges that lie close are
    compared, an edge of several outlines once. An area without neighbours has no row.
    """
    reach = 2.0 * tolerance
    names = ("x1", "y1", "x2", "y2")
    # of an edge's two directions one: outlines that share it share its corners
    turned = (F.col("e.x1") > F.col("e.x2")) | ((F.col("e.x1") == F.col("e.x2")) & (F.col("e.y1") > F.col("e.y2")))
    one_way = [F.when(turned, F.col(f"e.{b}")).otherwise(F.col(f"e.{a}")).alias(a) for a, b in zip(names, ("x2", "y2", "x1", "y1"))]
    of_area = polygons.select(area, F.explode(ring_edges(rings)).alias("e")).select(area, *one_way)
    # read for the cell size and by both sides of the join
    edges = cut_lineage(of_area.select(*names).distinct())
    if cell is None:
        span = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
        cell = (edges.agg(F.avg(span).alias("s")).first()["s"] or 0.0) + reach
    # most neighbours share a corner, which needs no distances; each area is there once, however many parts meet
    corners = polygons.select(F.col(area).alias("src"), F.explode(F.array_distinct(F.flatten(rings))).alias("c")).select(
        "src", "c.x", "c.y")
    met = (corners.join(corners.withColumnRenamed("src", "dst").hint("merge"), ["x", "y"])
           .where("src < dst").select("src", "dst"))
    spread = edge_cells(edges, float(cell), float(tolerance), {c: F.col(c) for c in names})
    other = spread.select("ix", "iy", *[F.col(c).alias(f"b_{c}") for c in names])
    near = segment_distance(tuple(F.col(c) for c in names), tuple(F.col(f"b_{c}") for c in names))
    apart = F.lit(False)
    for p, q in (("x1", "x2"), ("y1", "y2")):  # boxes further apart than the reach
        apart = apart | (F.greatest(p, q) + reach < F.least(f"b_{p}", f"b_{q}")) | (
            F.greatest(f"b_{p}", f"b_{q}") + reach < F.least(p, q))
    for p in ("1", "2"):  # edges with a common corner have met
        for q in ("1", "2"):
            apart = apart | ((F.col(f"x{p}") == F.col(f"b_x{q}")) & (F.col(f"y{p}") == F.col(f"b_y{q}")))
    one, two = [F.col(c) for c in names], [F.col(f"b_{c}") for c in names]
    # the exact distance is an aggregate input, evaluated once; a filter would evaluate it again
    close = cut_lineage(spread.join(other.hint("merge"), ["ix", "iy"]).where((F.struct(*one) < F.struct(*two)) & ~apart)
                        .groupBy(*one, *two).agg(F.min(near).alias("__d")).where(F.col("__d") <= reach + 1e-12).drop("__d"))
    held = _held(polygons, area, rings, reach).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    half = met.unionByName(held)
    if not close.isEmpty():
        ends = of_area.distinct()
        half = half.unionByName(
            close.join(ends.withColumnRenamed(area, "src"), list(names))
            .join(ends.select(F.col(area).alias("dst"), *[F.col(c).alias(f"b_{c}") for c in names]), [f"b_{c}" for c in names])
            .where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
    half = half.distinct()
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return standardise_edges(half.select(F.explode(both).alias("p")).select("p.*", F.lit(1.0).alias("w")))


def standardise_edges(edges: DataFrame) -> DataFrame:
    """Weights of each source divided by their sum."""
    sums = edges.groupBy("src").agg(F.sum("w").alias("__s"))
    return edges.join(sums, "src").select("src", "dst", (F.col("w") / F.col("__s")).alias("w"))


def spatial_lag(df: DataFrame, edges: DataFrame, key: str, columns: list[str],
                prefix: str = "w_") -> DataFrame:
    """Neighbours' weighted mean of each column; a missing value counts as the column mean and
    an area without neighbours gets 0."""
    stats = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("s")).scalar()
    filled = df.select(F.col(key).alias("dst"), *[
        F.coalesce(F.col(c).cast("double"), stats[c]).alias(f"{prefix}{c}") for c in columns])
    lags = edges.join(filled, "dst").groupBy(F.col("src").alias(key)).agg(
        *[F.sum(F.col("w") * F.col(f"{prefix}{c}")).alias(f"{prefix}{c}") for c in columns])
    out = df.join(lags, key, "left")
    return out.withColumns({f"{prefix}{c}": F.coalesce(f"{prefix}{c}", F.lit(0.0)) for c in columns})
