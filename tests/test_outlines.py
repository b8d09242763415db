"""United outlines against areas, lengths and points by hand."""

import math

import pytest
from pyspark.sql import functions as F

from arealis.operators import outlines as O
from arealis.operators import spatial as S

SCHEMA = "area string, rings array<array<struct<x:double,y:double>>>"


def box(x, y, w=1.0, h=1.0, back=False):
    x, y, w, h = map(float, (x, y, w, h))
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    return ring[::-1] if back else [*ring, ring[0]]


def rings_of(spark, parts, **kw):
    df = spark.createDataFrame([(a, r) for a, r in parts], SCHEMA)
    return sorted(((r.area, r.n_corners, round(r.size, 9), round(r.length, 9)) for r in O.outline_rings(df, "area", **kw).collect()),
                  key=repr)


def test_neighbours_hole_and_corner(spark):
    around = [("o", [box(x, y, back=(x + y) % 2 == 0)]) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    corner = [("c", [box(0, 0)]), ("c", [box(1, 1)])]
    assert rings_of(spark, around + corner) == [
        ("c", 4, 1.0, 4.0), ("c", 4, 1.0, 4.0), ("o", 12, 9.0, 12.0), ("o", 4, -1.0, 4.0)]


def test_long_edge_beside_short_ones(spark):
    parts = [("a", [box(0, 0, 4, 1)]), *[("a", [box(k, 1, back=True)]) for k in range(4)], (None, [box(9, 9)])]
    assert rings_of(spark, parts) == [("a", 9, 8.0, 12.0), (None, 4, 1.0, 4.0)]
    # without the search for corners nothing cancels between them
    assert len(rings_of(spark, parts, cut=False)) > 2


def test_holes_of_parts_are_kept_or_filled(spark):
    ring = [box(0, 0, 4, 4), box(1, 1, 2, 2)]
    assert rings_of(spark, [("h", ring)]) == [("h", 4, -4.0, 8.0), ("h", 4, 16.0, 16.0)]
    assert rings_of(spark, [("h", ring), ("h", [box(1, 1, 2, 2)]), ("h", ring)]) == [("h", 4, 16.0, 16.0)]
    island = [*ring, box(1.5, 1.5, 1, 1, back=True)]
    assert sum(r[2] for r in rings_of(spark, [("h", island)])) == 13.0


def test_odd_rows(spark):
    assert rings_of(spark, [("e", []), ("n", None), ("f", [[]]), ("p", [[(1.0, 1.0)]])]) == []
    assert rings_of(spark, []) == []
    assert rings_of(spark, [("two", [[(0.0, 0.0), (1.0, 0.0)]])]) == []  # there and back


def test_united_area_holds_the_same_points(spark):
    parts = [(f"z{(x * 7 + y * 3) % 3}", [box(x, y)]) for x in range(6) for y in range(6)]
    df = spark.createDataFrame(parts, SCHEMA)
    points = spark.range(400).select("id", (F.col("id") * 37 % 61 / 10.0 + 0.05).alias("lon"), (F.col("id") * 53 % 61 / 10.0 + 0.05).alias("lat"))
    found = [sorted(map(tuple, S.points_in_polygons(points, p, ["area"]).select("id", "area").collect()))
             for p in (df, O.unite(df, "area"))]
    assert found[0] == found[1] and found[0]


def test_a_long_ring_takes_logarithmic_rounds(spark, monkeypatch):
    n, rounds = 3000, []
    ring = [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
    kept = O.step
    monkeypatch.setattr(O, "step", lambda df: rounds.append(1) or kept(df))
    df = spark.createDataFrame([("r", [ring])], SCHEMA)
    row = O.outline_rings(df, "area", cut=False).first()
    assert row.n_corners == n and row.size == pytest.approx(math.pi, abs=1e-4)
    walked = [(p.x, p.y) for p in row.ring]
    at = ring.index(walked[0])
    assert walked == ring[at:] + ring[:at] and walked[0] == min(ring)
    assert len(rounds) <= math.ceil(math.log2(n)) + 5
