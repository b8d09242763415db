"""Packed rasters against the long form of the same pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.operators import rasters as RA
from arealis.operators import spatial as S

POLYGONS = "area string, rings array<array<struct<x:double,y:double>>>"
PIXELS = "raster_id string, lon double, lat double, value double"


def test_runs_hold_the_pixels_that_points_in_polygons_holds(spark):
    rng = np.random.default_rng(8)
    star = [(float(10 + (3 + 5 * (k % 2)) * math.cos(k * math.pi / 5)), float(10 + (3 + 5 * (k % 2)) * math.sin(k * math.pi / 5))) for k in range(10)]
    hole = [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)], [(2.0, 2.0), (5.0, 2.0), (5.0, 5.0), (2.0, 5.0)]]
    steps = [[(12.0, 0.0), (18.0, 0.0), (18.0, 3.0), (15.0, 3.0), (15.0, 6.0), (12.0, 6.0)]]  # corners and sides on scan lines
    shapes = spark.createDataFrame([("star", [star]), ("hole", hole), ("steps", steps), ("far", [[(90.0, 90.0), (91.0, 90.0), (90.0, 91.0)]]),
                                    ("steps", [[(12.0, 7.0), (14.0, 7.0), (13.0, 9.0)]])], POLYGONS)
    lattice = [("a", x / 2, y / 2, float(x * y)) for x in range(-4, 42) for y in range(-4, 42)]
    loose = [("b", *map(float, rng.uniform(-1, 20, 2)), float(v)) for v in range(800)]
    odd = [("c", None, 1.0, 5.0), ("c", 1.0, float("nan"), 5.0), ("d", 3.0, 1.0, None), ("a", 1.0, 1.0, float("nan"))]
    pixels = spark.createDataFrame(lattice + loose + odd, PIXELS)
    want = {(r.area, r.raster_id): (r.n_pixels, r.value) for r in S.zonal_mean(pixels, shapes, "area").collect()}
    for width, height in ((3.0, 1.0), (100.0, 7.0)):
        lines = RA.pack_lines(pixels, width)
        got = {(r.area, r.raster_id): (r.n_pixels, r.value) for r in RA.zonal_mean_of_lines(lines, shapes, "area", width, height).collect()}
        assert got.keys() == want.keys() and len(got) == 16
        for k, (n, v) in want.items():
            assert got[k][0] == n and got[k][1] == (v if v is None else pytest.approx(v)), k


def test_tiles_read_what_the_long_form_reads(spark):
    rows = [(x + 0.5, y + 0.5, t, float(x - y) if (x + y) % 3 else -9.0) for x in range(-3, 9) for y in range(-3, 9) for t in (2001, 2002)
            if not (t == 2002 and x > 4)]
    pixels = spark.createDataFrame(rows + [(50.5, 50.5, 2001, 1e30)], "lon double, lat double, year int, value double")
    points = spark.createDataFrame([(i, (i * 37 % 140) / 10 - 4, (i * 53 % 140) / 10 - 4) for i in range(200)] + [(900, None, 1.0), (901, 50.2, 50.9)],
                                   "pid int, lon double, lat double")
    key = lambda r: tuple((v is not None, v or 0) for v in (r.pid, r.year, r.value))
    want = sorted(map(key, S.sample_raster(points, pixels, 0.0, 0.0, 1.0, 1.0, nodata=-9.0, by=["year"]).select("pid", "year", "value").collect()))
    for side in (1, 4, 64):
        tiles = RA.pack_tiles(pixels, 0.0, 0.0, 1.0, 1.0, nodata=-9.0, by=["year"], side=side)
        assert sorted(map(key, RA.sample_tiles(points, tiles, 0.0, 0.0, 1.0, 1.0, side=side).select("pid", "year", "value").collect())) == want
    assert tiles.count() == 4 and len(want) > 200


def test_several_pixels_in_a_place(spark):
    pixels = spark.createDataFrame([(0.5, 0.5, None), (0.2, 0.7, 3.0), (0.1, 0.1, 7.0), (1.5, 0.5, None)], "lon double, lat double, value double")
    tiles = RA.pack_tiles(pixels, 0.0, 0.0, 1.0, 1.0, side=2)
    points = spark.createDataFrame([(1, 0.9, 0.9), (2, 1.9, 0.0), (3, 0.0, 1.5)], "pid int, lon double, lat double")
    assert {r.pid: r.value for r in RA.sample_tiles(points, tiles, 0.0, 0.0, 1.0, 1.0, side=2).collect()} == {1: 7.0, 2: None, 3: None}
    assert RA.sample_tiles(points, tiles.where(F.lit(False)), 0.0, 0.0, 1.0, 1.0, side=2).count() == 3
