"""Union of adjoining parts: outlines without the edges that two parts share, chained into rings.

Parts of an area adjoin or lie apart; they do not overlap (an overlap would be cut out, as by the even-odd rule). Every
ring is directed with the inside on its left. An edge of one part that another part runs through the other way is an
inner one and goes; of the rest, each corner joins an incoming edge to the outgoing one that bounds the same inside, so
that parts that touch in a corner stay rings of their own. Rings are then found by pointer doubling: an edge knows the
least edge among the next 2^r and how far ahead it lies, so a ring of a million corners takes twenty rounds of one
equi-join, and neither a ring nor an area is gathered before its finished ring is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import odd_crossings, ring_edges
from ..session import step
from .spatial import edge_cells

_ENDS = ("x1", "y1", "x2", "y2")


def _ring_area(edges: Column) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2)


def directed_edges(polygons: DataFrame, area: str, rings: str = "rings") -> DataFrame:
    """``(area, x1, y1, x2, y2)``, each once, with the inside of the part on the left.

    A ring inside an odd number of others of its part is a hole.
    """
    # the rings with their edges are an aggregate's input, so that they are made once
    parts = polygons.where(F.size(rings) > 0).select(area, rings, F.monotonically_increasing_id().alias("__part"))
    parts = parts.select(area, "__part", F.posexplode(rings).alias("__i", "__ring"))
    each = parts.select(area, "__part", "__i", F.filter(ring_edges(F.array("__ring")), lambda e: (
        e["x1"] != e["x2"]) | (e["y1"] != e["y2"])).alias("__edges")).where(F.size("__edges") > 0)
    whole = each.groupBy(area, "__part").agg(F.collect_list(F.struct("__i", "__edges")).alias("__all"))
    one = whole.select(area, "__all", F.explode("__all").alias("r"))
    first = F.col("r.__edges")[0]
    x, y = (first["x1"] + first["x2"]) / 2, (first["y1"] + first["y2"]) / 2
    others = F.flatten(F.transform(F.filter("__all", lambda o: o["__i"] != F.col("r.__i")), lambda o: o["__edges"]))
    hole = F.when(F.size("__all") > 1, odd_crossings(others, x, y)).otherwise(F.lit(False))
    turned = one.select(area, F.col("r.__edges").alias("__edges"), ((_ring_area(F.col("r.__edges")) > 0) == hole).alias("__turn"))
    ends = turned.select(area, "__turn", F.explode("__edges").alias("e"))
    at = lambda a, b: F.when(F.col("__turn"), F.col(f"e.{b}")).otherwise(F.col(f"e.{a}"))
    return ends.select(area, at("x1", "x2").alias("x1"), at("y1", "y2").alias("y1"), at("x2", "x1").alias("x2"),
                       at("y2", "y1").alias("y2")).distinct()


def noded(edges: DataFrame, area: str) -> DataFrame:
    """Edges cut at the corners of their area that lie on them, so that a long edge meets the short ones beside it."""
    span = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    cell = float(edges.agg(F.avg(span).alias("s")).first()["s"] or 1.0)
    index = lambda c: F.floor(F.col(c) / cell).cast("bigint")
    corners = edges.select(area, F.col("x1").alias("cx"), F.col("y1").alias("cy")).distinct().withColumns(
        {"ix": index("cx"), "iy": index("cy")})
    spread = edge_cells(edges, cell, 0.0, {c: F.col(c) for c in _ENDS}).withColumnRenamed(area, "__area")
    on_line = (F.col("cx") - F.col("x1")) * (F.col("y2") - F.col("y1")) == (F.col("cy") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    between = (F.col("cx").between(F.least("x1", "x2"), F.greatest("x1", "x2"))
               & F.col("cy").between(F.least("y1", "y2"), F.greatest("y1", "y2")))
    end = lambda i: (F.col("cx") == F.col(f"x{i}")) & (F.col("cy") == F.col(f"y{i}"))
    hit = spread.join(corners.hint("merge"), (F.col("__area").eqNullSafe(F.col(area))) & (spread.ix == corners.ix)
                      & (spread.iy == corners.iy) & on_line & between & ~end(1) & ~end(2))
    along = F.abs(F.col("cx") - F.col("x1")) + F.abs(F.col("cy") - F.col("y1"))
    cuts = hit.groupBy("__area", *_ENDS).agg(F.sort_array(F.collect_set(F.struct(
        along.alias("at"), F.col("cx").alias("x"), F.col("cy").alias("y")))).alias("__cuts"))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    left = edges.withColumnsRenamed({c: f"_{c}" for c in _ENDS})
    same = F.col(area).eqNullSafe(F.col("__area"))
    for c in _ENDS:
        same = same & (F.col(f"_{c}") == F.col(c))
    inner = F.transform(F.coalesce("__cuts", F.array()), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    path = left.join(cuts, same, "left").select(
        area, F.concat(F.array(point("_x1", "_y1")), inner, F.array(point("_x2", "_y2"))).alias("__path"))
    pieces = path.select(area, F.explode(F.arrays_zip(
        F.slice("__path", F.lit(1), F.size("__path") - 1).alias("p"), F.slice("__path", F.lit(2), F.size("__path") - 1).alias("q"))).alias("e"))
    return pieces.select(area, F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"),
                         F.col("e.q.y").alias("y2")).distinct()


def outer_edges(edges: DataFrame, area: str) -> DataFrame:
    """Edges whose reverse is no edge of the same area."""
    p, q = (F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2))
    # one aggregate with map-side partials in place of an anti join of the table with itself
    lines = edges.select(area, F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), (p < q).alias("__forth"))
    lines = lines.groupBy(area, "a", "b").agg(F.max("__forth").alias("__any"), F.min("__forth").alias("__all"))
    start, end = F.when(F.col("__any"), F.col("a")).otherwise(F.col("b")), F.when(F.col("__any"), F.col("b")).otherwise(F.col("a"))
    return lines.where(F.col("__any") == F.col("__all")).select(
        area, start["x"].alias("x1"), start["y"].alias("y1"), end["x"].alias("x2"), end["y"].alias("y2"))


def _successors(edges: DataFrame, area: str) -> DataFrame:
    """``(area, edge, after)``: the edge that goes on from an edge's end, as structs of the four numbers.

    Around a corner, edges are ordered by angle; from the way back along an incoming edge the first outgoing one
    clockwise bounds the same inside. The window holds the edges of one corner.
    """
    out = edges.select(area, F.col("x1").alias("__x"), F.col("y1").alias("__y"), F.struct(*_ENDS).alias("__out"),
                       F.lit(None).cast(edges.select(F.struct(*_ENDS).alias("s")).schema["s"].dataType).alias("__in"),
                       F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("__angle"))
    back = edges.select(area, F.col("x2").alias("__x"), F.col("y2").alias("__y"),
                        F.lit(None).cast(out.schema["__out"].dataType).alias("__out"), F.struct(*_ENDS).alias("__in"),
                        F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")).alias("__angle"))
    corner = Window.partitionBy(area, "__x", "__y").orderBy("__angle")
    before = F.last("__out", True).over(corner.rowsBetween(Window.unboundedPreceding, -1))
    largest = F.last("__out", True).over(corner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    both = out.unionByName(back).withColumn("after", F.coalesce(before, largest))
    return both.where(F.col("__in").isNotNull()).select(area, F.col("__in").alias("edge"), "after")


def ring_places(edges: DataFrame, area: str) -> DataFrame:
    """``(area, edge, ring, ahead)``: the least edge of each edge's ring and the steps from the edge to it."""
    state = step(_successors(edges, area).select(
        area, "edge", F.col("after").alias("jump"), F.col("edge").alias("ring"), F.lit(0).cast("bigint").alias("ahead")))
    width = 1
    while True:
        told = state.select(F.col(area).alias("__area"), F.col("edge").alias("__edge"), F.col("jump").alias("__jump"),
                            F.col("ring").alias("__ring"), F.col("ahead").alias("__ahead"))
        less = F.col("__ring") < F.col("ring")
        state = step(state.join(told, F.col(area).eqNullSafe(F.col("__area")) & (F.col("jump") == F.col("__edge"))).select(
            area, "edge", F.col("__jump").alias("jump"), F.when(less, F.col("__ring")).otherwise(F.col("ring")).alias("ring"),
            F.when(less, F.col("__ahead") + width).otherwise(F.col("ahead")).alias("ahead"), less.alias("less")))
        # windows twice as long hold nothing less anywhere: each holds its whole ring
        moved = state.agg(F.max("less")).first()[0]
        state = state.drop("less")
        if not moved:
            return state.drop("jump")
        width *= 2


def outline_rings(polygons: DataFrame, area: str, rings: str = "rings", cut: bool = True) -> DataFrame:
    """A row per ring of the united parts of each area: ``ring`` (open, the inside on the left, from its least edge),
    ``n_corners``, ``size`` (negative for holes) and ``length``.

    ``cut=False`` leaves out the search for corners on other parts' edges, where borders are known to have the same
    corners on both sides. Empty, missing and flat rings are left out; a repeated part counts once.
    """
    edges = step(directed_edges(polygons, area, rings))
    outer = step(outer_edges(noded(edges, area) if cut else edges, area))
    places = ring_places(outer, area)
    e = F.col("edge")
    order = F.when(F.col("ahead") == 0, F.lit(-2 ** 62)).otherwise(-F.col("ahead"))
    return places.groupBy(area, "ring").agg(
        F.sort_array(F.collect_list(F.struct(order.alias("at"), e["x1"].alias("x"), e["y1"].alias("y")))).alias("__ring"),
        F.count(F.lit(1)).alias("n_corners"), F.sum((e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2).alias("size"),
        F.sum(F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])).alias("length")).select(
        area, F.transform("__ring", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("ring"), "n_corners", "size", "length")


def unite(polygons: DataFrame, area: str, rings: str = "rings", cut: bool = True) -> DataFrame:
    """``(area, rings)``: one outline an area, its parts and holes as rings, the largest first."""
    each = outline_rings(polygons, area, rings, cut)
    return each.groupBy(area).agg(F.sort_array(F.collect_list(F.struct("size", "ring")), asc=False).alias("__r")).select(
        area, F.transform("__r", lambda r: r["ring"]).alias(rings))
