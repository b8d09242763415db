import pytest
from pyspark.sql import functions as F

from arealis.functions.geometry import box_rings, to_metres
from arealis.operators import spatial as S


def polygons(spark, shapes):
    rows = [(k, i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for i, (k, rings) in enumerate(shapes)]
    return spark.createDataFrame(rows, "area string, ordinal int, rings array<array<struct<x:double,y:double>>>")


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLE = [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "pid int, lon double, lat double")


@pytest.mark.parametrize("cell", [0.3, 1.0, 50.0])
def test_holes_edges_and_overlaps(spark, cell):
    polys = polygons(spark, [("ring", [SQUARE, HOLE]), ("inner", [HOLE])])
    pts = points(spark, [(0.5, 0.5), (2, 2), (4, 2), (1, 2), (9, 9), (2, 0.5)])
    got = {r.pid: r.area for r in S.locate_points(pts, polys, "pid", "area", "ordinal", cell=cell).collect()}
    assert got == {0: "ring", 1: "inner", 2: None, 3: None, 4: None, 5: "ring"}


def test_first_polygon_wins_where_two_cover(spark):
    polys = polygons(spark, [("b", [SQUARE]), ("a", [SQUARE])])
    assert S.locate_points(points(spark, [(2, 2)]), polys, "pid", "area", "ordinal").first().area == "b"


def test_nearest_within_distance(spark):
    polys = polygons(spark, [("w", [SQUARE]), ("e", [[(6, 0), (8, 0), (8, 4), (6, 4)]])])
    pts = points(spark, [(5, 2), (5.5, 2), (2, 2), (20, 2)]).withColumnsRenamed({"lon": "x", "lat": "y"})
    got = {r.pid: (r.area, r.distance) for r in S.nearest_polygon(pts, polys, "pid", "area", "ordinal", 3.0).collect()}
    assert got == {0: ("w", 1.0), 1: ("e", 0.5), 2: ("w", 0.0), 3: ("", None)}


def test_islands_and_containment_in_contiguity(spark):
    far = [(50, 50), (51, 50), (51, 51)]
    speck = [(1.5, 1.5), (2.0, 1.5), (2.0, 2.0)]
    gap = [(4.015, 0), (6, 0), (6, 4), (4.015, 4)]  # a sliver narrower than twice the tolerance
    polys = polygons(spark, [("a", [SQUARE]), ("far", [far]), ("speck", [speck]), ("gap", [gap])])
    got = {(r.src, r.dst): r.w for r in S.queen_contiguity(polys, "area").collect()}
    assert got == {("a", "speck"): 0.5, ("a", "gap"): 0.5, ("speck", "a"): 1.0, ("gap", "a"): 1.0}


def test_lag_of_an_island_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 5.0)], "k string, x double")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 0.5), ("b", "c", 0.5)], "src string, dst string, w double")
    assert {r.k: r.w_x for r in S.spatial_lag(df, edges, "k", ["x"]).collect()} == {"a": 3.0, "b": 3.0, "c": 0.0}


def test_zonal_mean_keeps_empty_areas(spark):
    polys = spark.createDataFrame([("a", 0.0), ("b", 100.0)], "area string, o double").withColumn(
        "rings", box_rings(F.col("o"), F.col("o"), F.col("o") + 2, F.col("o") + 2))
    px = spark.createDataFrame([("r", 0.5, 0.5, 1.0), ("r", 1.5, 0.5, 3.0), ("r", 1.5, 1.5, None)], "raster_id string, lon double, lat double, value double")
    assert {r.area: (r.value, r.n_pixels) for r in S.zonal_mean(px, polys, "area").collect()} == {"a": (2.0, 2), "b": (None, 0)}


def test_projection_on_the_central_meridian(spark):
    m = spark.range(1).select(to_metres(F.lit(39.0), F.lit(0.0)).alias("m"), to_metres(F.lit(39.0), F.lit(-1.0)).alias("n")).first()
    assert (m.m.x, m.m.y) == (pytest.approx(500_000.0), pytest.approx(10_000_000.0))
    # one degree of meridian arc from the equator is 110574.389 m, times the scale factor
    assert m.n.y == pytest.approx(10_000_000.0 - 110_574.389 * 0.9996, abs=0.01)


def test_raster_choice_takes_first_name(spark):
    names = spark.createDataFrame([("soc_5-15cm_mean",), ("soc_0-5cm_mean",), ("x_cec",)], "raster_id string")
    assert {r.stem: r.raster_id for r in S.choose_rasters(names, ["soc", "cec", "phh2o"]).collect()} == {
        "soc": "soc_0-5cm_mean", "cec": "x_cec"}


def test_one_large_and_one_detailed_outline(spark):
    import math

    ring = [(1000 + 900 * math.cos(t / 50_000 * math.pi), 1000 + 900 * math.sin(t / 50_000 * math.pi)) for t in range(100_000)]
    small = [(str(i), [[(i * 10, 0), (i * 10 + 1, 0), (i * 10 + 1, 1), (i * 10, 1)]]) for i in range(40)]
    polys = polygons(spark, [("disc", [ring]), *small])
    cells = S.polygon_cells(polys, ["area"], 0.125)
    assert cells.where("area = 'disc'").count() < 2000
    pts = points(spark, [(1000, 1000), (1000, 1899), (1000, 1901), (370, 370), (360, 360), (20.5, 0.5), (25, 0.5)])
    got = {r.pid: r.area for r in S.locate_points(pts, polys, "pid", "area", "ordinal").collect()}
    assert got == {0: "disc", 1: "disc", 2: None, 3: "disc", 4: None, 5: "2", 6: None}


def test_long_edges_have_cells_along_them(spark):
    long = [(0, 0), (10_000, 10_000), (10_000, 10_001), (0, 1)]
    small = [(f"s{i}", [[(i, -5), (i + 1, -5), (i + 1, -4), (i, -4)]]) for i in range(30)]
    touch = [(5000, 4999.995), (5001, 4990), (5002, 4990)]
    polys = polygons(spark, [("long", [long]), ("touch", [touch]), *small])
    edges = polys.select("area", F.explode(S.ring_edges("rings")).alias("e")).select("area", "e.*")
    names = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    assert S.edge_cells(edges.where("area = 'long'"), 1.0, 0.01, names).count() < 300_000
    got = {(r.src, r.dst) for r in S.queen_contiguity(polys, "area", cell=10.0).collect()}
    assert ("long", "touch") in got and ("touch", "long") in got and ("s0", "s1") in got and ("s0", "s2") not in got


def test_contiguity_tests_no_area_whose_box_holds_no_corner(spark, monkeypatch):
    lattice = spark.range(30).select(F.col("id").alias("area"), (F.col("id") % 6).cast("double").alias("x"), F.floor(F.col("id") / 6).cast("double").alias("y"))
    polys = lattice.select("area", box_rings(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1).alias("rings"))
    assert polys.select(F.explode(S.ring_edges("rings"))).count() == 30 * 4  # the closing corner makes no edge

    def tested(*_, **__):
        raise AssertionError("cells of areas that hold nothing")

    monkeypatch.setattr(S, "points_in_polygons", tested)
    got = {(r.src, r.dst) for r in S.queen_contiguity(polys, "area").collect()}
    assert got == {(a, b) for a in range(30) for b in range(30) if a != b and abs(a % 6 - b % 6) <= 1 and abs(a // 6 - b // 6) <= 1}


def test_contiguity_of_nested_areas_of_many_sizes(spark):
    boxes = [(0, 0, 100), (10, 10, 1), (20, 20, 30), (25, 25, 0.25), (99, 50, 3), (200, 200, 1)]
    polys = spark.createDataFrame([(i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(boxes)], "area int, x double, y double, s double").select(
        "area", box_rings(F.col("x"), F.col("y"), F.col("x") + F.col("s"), F.col("y") + F.col("s")).alias("rings"))
    got = {(r.src, r.dst) for r in S.queen_contiguity(polys, "area").collect()}
    half = {(0, 1), (0, 2), (0, 3), (2, 3), (0, 4)}
    assert got == half | {(b, a) for a, b in half}


def test_copies_of_an_area_are_looked_up_once(spark, monkeypatch):
    taken, seen = S.points_in_polygons, []
    monkeypatch.setattr(S, "points_in_polygons", lambda pts, polys, *a, **k: seen.append(polys.count()) or taken(pts, polys, *a, **k))
    polys = polygons(spark, [*[(f"w{i}", [SQUARE]) for i in range(50)], *[(f"e{i}", [[(6, 0), (8, 0), (8, 4), (6, 4)]]) for i in range(50)]])
    pts = points(spark, [(2, 2), (5.5, 2), (7, 2), (20, 2)])
    near = S.nearest_polygon(pts.withColumnsRenamed({"lon": "x", "lat": "y"}), polys, "pid", "area", "ordinal", 3.0)
    assert {r.pid: (r.area, r.distance) for r in near.collect()} == {0: ("w0", 0.0), 1: ("e0", 0.5), 2: ("e0", 0.0), 3: ("", None)}
    found = S.locate_points(pts, polys, "pid", "area", "ordinal")
    assert {r.pid: r.area for r in found.collect()} == {0: "w0", 1: None, 2: "e0", 3: None}
    assert seen == [2, 2]


def test_edges_of_several_outlines_are_compared_once(spark, monkeypatch):
    compared = []

    def cells(edges, *rest, spread=S.edge_cells):
        compared.append(edges.count())
        return spread(edges, *rest)

    monkeypatch.setattr(S, "edge_cells", cells)
    boxes = [("a", 0.0, 0.0, 1.0, 1.0), ("b", 1.0, 0.0, 2.0, 1.0), ("c", 2.015, 0.3, 3.0, 0.8), ("d", 0.0, 0.0, 1.0, 1.0),
             ("e", 5.0, 0.0, 6.0, 1.0), ("f", 3.0, 0.8, 4.0, 2.0)]
    polys = spark.createDataFrame(boxes, "area string, x0 double, y0 double, x1 double, y1 double").select(
        "area", box_rings(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("rings"))
    got = {(r.src, r.dst): r.w for r in S.queen_contiguity(polys, "area").collect()}
    pairs = {("a", "b"), ("a", "d"), ("b", "d"), ("b", "c"), ("c", "f")}
    assert set(got) == pairs | {p[::-1] for p in pairs} and got["b", "c"] == pytest.approx(1 / 3)
    assert compared == [4 + 3 + 4 + 4 + 4]  # 24 with their outlines
