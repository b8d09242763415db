"""Rasters packed into tiles and scan lines: points read a pixel by its place, zones add up runs.

A raster row costs as many records as it has chunks, not pixels, and both packings are made once for all zones and
points that use them. Zonal sums come from prefix sums: an outline crosses a scan line in a few places, and
between an entry and an exit the sum is a difference, however many pixels lie there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import ring_edges
from ..functions.numeric import finite
from .spatial import sized

SIDE = 64  # pixels a side of a tile
ABSENT = float("inf")
CHUNK = 4_096  # pixels of a scan line in one record


# -- tiles

def _grid(df: DataFrame, x: str, y: str, x0: float, y0: float, dx: float, dy: float, side: int) -> DataFrame:
    """``df`` with its tile and the place in it."""
    col, row = F.floor((F.col(x) - x0) / dx).cast("bigint"), F.floor((F.col(y) - y0) / dy).cast("bigint")
    return df.withColumns({"__tx": F.floor(col / side).cast("bigint"), "__ty": F.floor(row / side).cast("bigint"),
                           "__at": (F.pmod(row, F.lit(side)) * side + F.pmod(col, F.lit(side))).cast("int")})


def pack_tiles(pixels: DataFrame, x0: float, y0: float, dx: float, dy: float, lon: str = "lon", lat: str = "lat",
               value: str = "value", nodata: float | None = None, by: list[str] = (), side: int = SIDE) -> DataFrame:
    """A row per tile: ``__tx``, ``__ty``, ``layers`` (an array of the ``by`` columns and ``pixels``).

    ``pixels`` has one value a place, row by row: infinity where there is no pixel, null where its value is missing
    (nodata, absurdly large). Of several pixels in a place the largest value stands.
    """
    v = F.col(value).cast("double")
    v = F.when((F.abs(v) <= 1e19) & ~F.isnan(v), v)
    if nodata is not None:
        v = F.when(v != nodata, v)
    placed = _grid(pixels, lon, lat, x0, y0, dx, dy, side).where(F.col("__at").isNotNull())
    each = placed.select("__tx", "__ty", *by, F.struct(F.col("__at").alias("at"), v.alias("v")).alias("p"))
    lists = each.groupBy("__tx", "__ty", *by).agg(F.collect_list("p").alias("p"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def dense(ats, values):
        out = []
        for at, v in zip(ats, values):
            # missing ones first, so that a place with any value has it
            known = np.array([np.nan if x is None else x for x in v], float)
            order = np.argsort(np.where(np.isnan(known), -np.inf, known), kind="stable")
            tile: list = [ABSENT] * (side * side)
            for k in order:
                tile[at[k]] = None if np.isnan(known[k]) else known[k]
            out.append(tile)
        return _series(out)

    layer = F.struct(*by, dense(F.col("p.at"), F.col("p.v")).alias("pixels"))
    return lists.select("__tx", "__ty", layer.alias("layer")).groupBy("__tx", "__ty").agg(F.collect_list("layer").alias("layers"))


def _series(lists: list):
    import pandas as pd

    return pd.Series(lists, dtype=object)


def sample_tiles(points: DataFrame, tiles: DataFrame, x0: float, y0: float, dx: float, dy: float, lon: str = "lon",
                 lat: str = "lat", value: str = "value", side: int = SIDE) -> DataFrame:
    """Points with the value of the pixel they fall in, a row for every layer that has one there, else one of nulls."""
    by = [f.name for f in tiles.schema["layers"].dataType.elementType.fields if f.name != "pixels"]
    placed = _grid(points, lon, lat, x0, y0, dx, dy, side)
    joined = placed.join(tiles, ["__tx", "__ty"], "left")
    read = F.transform("layers", lambda g: F.struct(*[g[c].alias(c) for c in by], F.get(g["pixels"], F.col("__at")).alias("v")))
    there = F.filter(read, lambda g: g["v"].isNull() | (g["v"] != ABSENT))
    return joined.withColumn("__g", F.explode_outer(there)).select(
        *points.columns, *[F.col(f"__g.{c}").alias(c) for c in by], F.col("__g.v").alias(value))


# -- scan lines

def pack_lines(pixels: DataFrame, width: float, raster: str = "raster_id", value: str = "value", lon: str = "lon",
               lat: str = "lat") -> DataFrame:
    """A row per raster, scan line and chunk of ``width`` degrees or metres: ``y``, ``chunk``, ``xs``, ``vs``.

    Pixels without a value are left out, but every raster is there with at least one, maybe empty, row.
    """
    x, y = finite(lon), finite(lat)
    kept = finite(value).isNotNull() & x.isNotNull() & y.isNotNull()
    each = pixels.select(raster, F.when(kept, y).alias("y"), F.when(kept, F.floor(x / width)).cast("bigint").alias("chunk"),
                         F.when(kept, F.struct(x.alias("x"), finite(value).alias("v"))).alias("p"))
    lists = each.groupBy(raster, "y", "chunk").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return lists.select(raster, "y", "chunk", F.col("p.x").alias("xs"), F.col("p.v").alias("vs"))


def runs(lines: DataFrame, polygons: DataFrame, area: str, height: float, rings: str = "rings") -> DataFrame:
    """``(y, area, from, to)``: open stretches of each scan line strictly inside a polygon.

    Between an odd and an even crossing a line is inside, less what an edge touches there (corners, level edges).
    """
    bucket = lambda c: F.floor(c / height).cast("bigint")
    e = {k: F.col(f"e.{k}") for k in ("x1", "y1", "x2", "y2")}
    low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    parts = polygons.select(area, rings, F.monotonically_increasing_id().alias("__part"))
    edges = parts.select(area, "__part", F.explode(ring_edges(rings)).alias("e")).withColumn(
        "b", F.explode(F.sequence(bucket(low), bucket(high))))
    levels = lines.where(F.col("y").isNotNull()).select("y").distinct().withColumn("b", bucket(F.col("y")))
    y = F.col("y")
    met = edges.join(levels, "b").where(y.between(low, high))
    at = e["x1"] + (y - e["y1"]) * ((e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)))
    crossing = (e["y1"] > y) != (e["y2"] > y)
    level = e["y1"] == e["y2"]
    touched = F.struct(F.when(level, F.least(e["x1"], e["x2"])).otherwise(at).alias("a"),
                       F.when(level, F.greatest(e["x1"], e["x2"])).otherwise(at).alias("b"))
    found = met.groupBy(area, "__part", "y").agg(
        F.sort_array(F.collect_list(F.when(crossing, at))).alias("c"),
        F.sort_array(F.collect_set(F.when(~crossing, touched))).alias("t")).where(F.size("c") > 0)
    pairs = F.transform(F.sequence(F.lit(1), (F.size("c") / 2).cast("int")),
                        lambda k: F.struct(F.get("c", 2 * k - 2).alias("a"), F.get("c", 2 * k - 1).alias("b")))
    run = found.select("y", area, "t", F.explode(pairs).alias("r"))
    inside = F.filter("t", lambda t: (t["b"] >= F.col("r.a")) & (t["a"] <= F.col("r.b")))
    # touched stretches cut a run: it goes from one's end to the next one's beginning
    start = F.concat(F.array(F.col("r.a")), F.transform(inside, lambda t: t["b"]))
    end = F.concat(F.transform(inside, lambda t: t["a"]), F.array(F.col("r.b")))
    return run.select("y", area, F.explode(F.arrays_zip(start.alias("from"), end.alias("to"))).alias("s")).select(
        "y", area, "s.from", "s.to").where(F.col("from") < F.col("to"))


def zonal_mean_of_lines(lines: DataFrame, polygons: DataFrame, area: str, width: float, height: float,
                        raster: str = "raster_id", value: str = "value", rings: str = "rings") -> DataFrame:
    """``(area, raster, value, n_pixels)`` from ``pack_lines(..., width)``: the mean over pixels strictly inside.

    A chunk is met by the runs of all zones on it at once, so its pixels are moved at most once; ``height`` is the width
    of the strips in which edges and lines meet (a few lines). Zones that meet no pixel of a raster have a null and 0.
    """
    spans = runs(lines, polygons, area, height, rings)
    chunk = F.explode(F.sequence(F.floor(F.col("from") / width).cast("bigint"), F.floor(F.col("to") / width).cast("bigint")))
    zone = polygons.schema[area].dataType
    of = spans.withColumn("chunk", chunk).groupBy("y", "chunk").agg(
        F.collect_list(F.struct(area, "from", "to")).alias("spans"))
    met = lines.join(sized(of, F.size("spans") * 48 + 40), ["y", "chunk"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple, list] = {}
            for row in batch.to_pylist():
                xs, sums = np.array(row["xs"]), np.concatenate([[0.0], np.cumsum(row["vs"])])
                first = np.searchsorted(xs, [s["from"] for s in row["spans"]], "right")
                last = np.searchsorted(xs, [s["to"] for s in row["spans"]], "left")
                for s, a, b in zip(row["spans"], first.tolist(), last.tolist()):
                    if b > a:
                        of = total.setdefault((s[area], row[raster]), [0.0, 0])
                        of[0] += float(sums[b] - sums[a])
                        of[1] += b - a
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in total], kinds[0]), pa.array([k[1] for k in total], kinds[1]),
                     pa.array([v[0] for v in total.values()], pa.float64()), pa.array([v[1] for v in total.values()], pa.int64())],
                    [area, raster, "s", "n"])

    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([T.StructField(area, zone), lines.schema[raster], T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    kinds = to_arrow_type(zone), to_arrow_type(lines.schema[raster].dataType)
    sums = met.select("xs", "vs", "spans", raster).mapInArrow(fn, schema)
    means = sums.groupBy(area, raster).agg((F.sum("s") / F.sum("n")).alias(value), F.sum("n").alias("n_pixels"))
    return zone_grid(polygons, lines, area, raster).join(means, [area, raster], "left").withColumn(
        "n_pixels", F.coalesce("n_pixels", F.lit(0).cast("bigint")))


def zone_grid(polygons: DataFrame, rasters: DataFrame, area: str, raster: str, keys: int = 16) -> DataFrame:
    """Every zone with every raster, as rows: rasters are dealt to a few numbers that each zone has all of."""
    dealt: Column = F.pmod(F.xxhash64(raster), F.lit(keys))
    names = rasters.select(raster).distinct().withColumn("__k", dealt)
    areas = polygons.select(area).distinct().withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(keys - 1)).cast("array<bigint>")))
    return areas.join(names, "__k").drop("__k")
