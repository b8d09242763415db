"""Spatial joins on points, pixels and outlines derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_rings, to_metres
from ..operators import aggregates as A
from ..operators import autocorrelation as AC
from ..operators import outlines as O
from ..operators import rasters as RA
from ..operators import spatial as S
from ..session import cut_lineage
from .base import ORACLES, SUPPLIED, Tables, query, rounded, supplied

# One outline per nation on a 5 x 5 grid of 10-wide cells: even nations a box that reaches 2
# into the next cell on each side, odd nations a right triangle.
_SHAPES = """select n_nationkey as area, n_nationkey % 5 * 10.0::double as x0, (n_nationkey // 5) * 10.0::double as y0, n_nationkey % 2 as kind from nation"""
_IN = """(case when kind = 0 then x > x0 and x < x0 + 12 and y > y0 and y < y0 + 12
  else x > x0 and y > y0 and (x - x0) + (y - y0) < 10 end)"""
# orders as points, on a lattice of halves so that some lie exactly on outlines
_POINTS = """select o_orderkey as pid, (o_orderkey * 37 % 130) / 2.0 - 2 as x, (o_custkey * 53 % 130) / 2.0 - 2 as y, o_totalprice from orders"""


def _shapes(t: Tables) -> DataFrame:
    x0, y0 = F.col("n_nationkey") % 5 * 10.0, F.floor(F.col("n_nationkey") / 5) * 10.0

    def pt(dx, dy):
        return F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))

    box = F.array(F.array(pt(0.0, 0.0), pt(12.0, 0.0), pt(12.0, 12.0), pt(0.0, 12.0), pt(0.0, 0.0)))
    tri = F.array(F.array(pt(0.0, 0.0), pt(10.0, 0.0), pt(0.0, 10.0)))  # open ring
    return t.nation.select(F.col("n_nationkey").alias("area"),
                           F.when(F.col("n_nationkey") % 2 == 0, box).otherwise(tri).alias("rings"))


def _points(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("pid"),
                           ((F.col("o_orderkey") * 37 % 130) / 2.0 - 2).alias("x"),
                           ((F.col("o_custkey") * 53 % 130) / 2.0 - 2).alias("y"), "o_totalprice")


@query(f"""select p.pid, s.area from ({_POINTS}) p join ({_SHAPES}) s on {_IN}""")
def points_in_areas(t: Tables) -> DataFrame:
    return S.points_in_polygons(_points(t), _shapes(t), ["area"], "x", "y").select("pid", "area")


@query(f"""select p.pid, min(s.area) as area from ({_POINTS}) p left join ({_SHAPES}) s on {_IN} group by p.pid""")
def first_area_of_point(t: Tables) -> DataFrame:
    shapes = _shapes(t).withColumn("ordinal", F.col("area"))
    return S.locate_points(_points(t), shapes, "pid", "area", "ordinal", "x", "y").select("pid", "area")


@query(f"""
select s.area, count(*) as n_points, round(avg(o_totalprice), 4) as o_totalprice from ({_POINTS}) p join ({_SHAPES}) s on {_IN} group by s.area""")
def point_means(t: Tables) -> DataFrame:
    inside = S.points_in_polygons(_points(t), _shapes(t), ["area"], "x", "y")
    return A.point_means(inside, "area", ["o_totalprice"])


@query(f"""select distinct p.pid, s.area % 5 as zone from ({_POINTS}) p join ({_SHAPES}) s on {_IN}""")
def dissolved_areas(t: Tables) -> DataFrame:
    zones = S.dissolve(_shapes(t).withColumnRenamed("area", "part"), "zone", F.col("part") % 5)
    return S.points_in_polygons(_points(t), zones, ["zone"], "x", "y").select("pid", "zone").distinct()


_BOXES = """select 'b' || s_suppkey as area, s_suppkey as ordinal, (s_suppkey * 29 % 65)::double as x0, (s_suppkey * 43 % 65)::double as y0 from supplier"""
_GAP = "sqrt(pow(greatest(x0 - x, x - (x0 + 2), 0), 2) + pow(greatest(y0 - y, y - (y0 + 1), 0), 2))"


@query(f"""
with d as (select p.pid, s.area, {_GAP} as distance, row_number() over (partition by p.pid order by {_GAP}, s.ordinal) as r
  from ({_POINTS}) p join ({_BOXES}) s on {_GAP} <= 3.0)
select p.pid, coalesce(d.area, '') as area, round(d.distance, 6) as distance from ({_POINTS}) p left join (select * from d where r = 1) d using (pid)""")
def nearest_area(t: Tables) -> DataFrame:
    x0, y0 = (F.col("s_suppkey") * 29 % 65).cast("double"), (F.col("s_suppkey") * 43 % 65).cast("double")
    boxes = t.supplier.select(F.concat(F.lit("b"), "s_suppkey").alias("area"), F.col("s_suppkey").alias("ordinal"),
                              box_rings(x0, y0, x0 + 2.0, y0 + 1.0).alias("rings"))
    out = S.nearest_polygon(_points(t).drop("o_totalprice"), boxes, "pid", "area", "ordinal", 3.0)
    return out.select("pid", "area", rounded("distance", 6))


# line items as pixels of four rasters
_PIXELS = """select l_returnflag as raster_id, (l_orderkey * 41 % 260) / 4.0 - 2 + 0.1 as x, (l_partkey * 59 % 260) / 4.0 - 2 + 0.1 as y,
  case when l_discount > 0 then l_quantity end as value from lineitem"""


def _pixels(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_returnflag").alias("raster_id"),
                             ((F.col("l_orderkey") * 41 % 260) / 4.0 - 2 + 0.1).alias("lon"),
                             ((F.col("l_partkey") * 59 % 260) / 4.0 - 2 + 0.1).alias("lat"),
                             F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("value"))


@query(f"""
with m as (select s.area, raster_id, avg(value) as v, count(*) as n from ({_PIXELS}) p join ({_SHAPES}) s on {_IN} where value is not null group by all)
select a.area, r.raster_id, round(v, 6) as value, coalesce(n, 0) as n_pixels from ({_SHAPES}) a cross join (select distinct raster_id from ({_PIXELS}) p) r
left join m on m.area = a.area and m.raster_id = r.raster_id""")
def zonal_mean(t: Tables) -> DataFrame:
    return S.zonal_mean(_pixels(t), _shapes(t), "area").withColumn("value", F.round("value", 6))


@query(ORACLES["zonal_mean"])
def zonal_mean_by_runs(t: Tables) -> DataFrame:
    lines = cut_lineage(RA.pack_lines(_pixels(t), 16.0))
    return RA.zonal_mean_of_lines(lines, _shapes(t), "area", 16.0, 1.0).withColumn("value", F.round("value", 6))


_GRID = """select cast(l_partkey * 59 % 65 as double) + 0.5 - 2 as lon, cast(l_suppkey * 31 % 65 as double) + 0.5 - 2 as lat, cast(year(l_shipdate) as int) as "year",
  case when count(*) % 5 = 0 then -32768.0 else sum(l_quantity) end as value from lineitem group by all"""


def _grid(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(((F.col("l_partkey") * 59 % 65).cast("double") + 0.5 - 2).alias("lon"),
                              ((F.col("l_suppkey") * 31 % 65).cast("double") + 0.5 - 2).alias("lat"),
                              F.year("l_shipdate").alias("year")).agg(
        F.when(F.count(F.lit(1)) % 5 == 0, F.lit(-32768.0)).otherwise(F.sum("l_quantity")).alias("value"))


@query(f"""
select p.pid, g."year", case when value <> -32768.0 then value end as value from ({_POINTS}) p
left join ({_GRID}) g on floor(p.x + 2) = floor(g.lon + 2) and floor(p.y + 2) = floor(g.lat + 2)""")
def sampled_pixels(t: Tables) -> DataFrame:
    pts = _points(t).withColumnsRenamed({"x": "lon", "y": "lat"})
    return S.sample_raster(pts, _grid(t), -2.0, -2.0, 1.0, 1.0, nodata=-32768.0, by=["year"]).select("pid", "year", "value")


@query(f"""
select p.pid, round(avg(case when value <> -32768.0 then value end), 6) as value from ({_POINTS}) p
left join ({_GRID}) g on floor(p.x + 2) = floor(g.lon + 2) and floor(p.y + 2) = floor(g.lat + 2) group by p.pid""")
def yearly_sample_mean(t: Tables) -> DataFrame:
    pts = _points(t).withColumnsRenamed({"x": "lon", "y": "lat"})
    out = S.sample_mean(pts, _grid(t), "pid", -2.0, -2.0, 1.0, 1.0, nodata=-32768.0, by=["year"])
    return out.withColumn("value", F.round("value", 6))


@query(ORACLES["sampled_pixels"])
def sampled_tiles(t: Tables) -> DataFrame:
    pts = _points(t).withColumnsRenamed({"x": "lon", "y": "lat"})
    tiles = RA.pack_tiles(_grid(t), -2.0, -2.0, 1.0, 1.0, nodata=-32768.0, by=["year"], side=16)
    return RA.sample_tiles(pts, tiles, -2.0, -2.0, 1.0, 1.0, side=16).select("pid", "year", "value")


@query(ORACLES["yearly_sample_mean"])
def yearly_tile_mean(t: Tables) -> DataFrame:
    pts = _points(t).withColumnsRenamed({"x": "lon", "y": "lat"})
    tiles = RA.pack_tiles(_grid(t), -2.0, -2.0, 1.0, 1.0, nodata=-32768.0, by=["year"], side=16)
    sampled = RA.sample_tiles(pts, tiles, -2.0, -2.0, 1.0, 1.0, side=16)
    return sampled.groupBy("pid").agg(rounded(F.avg("value"), 6, "value"))


@query("""
with r as (select distinct replace(p_name, ' ', '_') as raster_id from part), s as (select unnest(['ring', 'red', 'old']) as stem)
select stem, min(raster_id) as raster_id from r join s on raster_id = stem or starts_with(raster_id, stem || '_') or contains(raster_id, '_' || stem) group by stem""")
def chosen_rasters(t: Tables) -> DataFrame:
    names = t.part.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("raster_id"))
    return S.choose_rasters(names, ["ring", "red", "old"])


# parts as unit squares on a lattice 40 wide
_NEAR = """with s as (select p_partkey as k, p_partkey % 40 as cx, p_partkey // 40 as cy from part),
e as (select a.k as src, b.k as dst from s a join s b on abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1 and a.k <> b.k)"""


def _squares(t: Tables) -> DataFrame:
    # a few bytes a row become outlines: dealt out first, since a small file is one task
    keys = t.part.select("p_partkey").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    x, y = (F.col("p_partkey") % 40).cast("double"), F.floor(F.col("p_partkey") / 40).cast("double")
    return keys.select(F.col("p_partkey").alias("area"), box_rings(x, y, x + 1.0, y + 1.0).alias("rings"))


@query(f"""{_NEAR} select src, dst, round(1.0 / count(*) over (partition by src), 6) as w from e""")
def queen_contiguity(t: Tables) -> DataFrame:
    return S.queen_contiguity(_squares(t), "area").withColumn("w", F.round("w", 6))


@query(f"""{_NEAR},
v as (select p_partkey as k, case when p_partkey % 9 <> 0 then p_retailprice end as x from part),
f as (select k, coalesce(x, (select avg(x) from v)) as x from v)
select v.k as area, v.x as price, round(coalesce((select avg(f.x) from e join f on f.k = e.dst where e.src = v.k), 0.0), 6) as w_price from v""")
def spatial_lag(t: Tables) -> DataFrame:
    df = t.part.select(F.col("p_partkey").alias("area"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")).alias("price"))
    edges = S.queen_contiguity(_squares(t), "area")
    return S.spatial_lag(df, edges, "area", ["price"]).select("area", "price", rounded("w_price", 6))


_KRUGER = """
with c as (select 1/298.257223563::double as f),
d as (select f / (2 - f) as n from c),
k as (select n, 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) as r, 2 * sqrt(n) / (1 + n) as e,
  n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 as a1, 13 * n**2 / 48 - 3 * n**3 / 5 as a2, 61 * n**3 / 240 as a3 from d),
p as (select event_id, radians(event_id % 100 / 12.5 - 5) as phi, radians(36 + event_id % 61 / 10.0 - 39) as dl from events),
t as (select event_id, dl, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) as t, k.* from p, k),
u as (select *, atan2(t, cos(dl)) as xi, atanh(sin(dl) / sqrt(1 + t * t)) as eta from t)
select event_id,
  round(500000.0 + r * (eta + a1 * cos(2*xi) * sinh(2*eta) + a2 * cos(4*xi) * sinh(4*eta) + a3 * cos(6*xi) * sinh(6*eta)), 3) as x,
  round(10000000.0 + r * (xi + a1 * sin(2*xi) * cosh(2*eta) + a2 * sin(4*xi) * cosh(4*eta) + a3 * sin(6*xi) * cosh(6*eta)), 3) as y
from u"""


@query(_KRUGER)
def projected_points(t: Tables) -> DataFrame:
    lat, lon = F.col("event_id") % 100 / 12.5 - 5, F.col("event_id") % 61 / 10.0 + 36
    return t.events.select("event_id", to_metres(lon, lat).alias("m")).select(
        "event_id", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"))


# nations of one region as neighbours; the statistic is over all line items
_H = f"((xor(greatest(spot, (turn % n - spot + n) % n), salt) * {AC.FACTORS[0]} + salt) & 2147483647)"
_BIT = f"((((xor({_H}, {_H} >> 15) * {AC.FACTORS[1]}) & 2147483647) >> 13) & 1)"
_MORAN = f"""
with recursive v as (select n_nationkey as id, n_regionkey as g, avg(l_extendedprice) as x from ({SUPPLIED}) q where n_nationkey <> 7 group by all),
n as (select count(*) as n, avg(x) as m, var_pop(x) * count(*) as den from v),
z as (select id, g, x - m as z, row_number() over (order by id) - 1 as spot from v, n),
e as (select a.id as src, b.id as dst, 1.0 / count(*) over (partition by a.id) as w from v a join v b on a.g = b.g and a.id <> b.id),
key as (select k, r, ('0x' || substr(md5('42|' || k || '|' || r), 1, 7))::bigint as turn, ('0x' || substr(md5('42|' || k || '|' || r), 8, 7))::bigint as salt
  from range(1, 1000) t(k), range(0, 80) u(r)),
p as (select k, id, spot, 0 as r from z, range(1, 1000) t(k) union all
  select k, id, case when {_BIT} = 1 then (turn % n - spot + n) % n else spot end, r + 1
  from p join key using (k, r), n where r < 8 + 2 * length(bin(n - 1))),
d as (select p.k, p.id, z.z from p join z on z.spot = p.spot, n where p.r = 8 + 2 * length(bin(n - 1)) union all select 0, id, z from z),
i as (select a.k, (select n from n) / sum(e.w) * sum(e.w * a.z * b.z) / (select den from n) as i
  from e join d a on a.id = e.src join d b on b.id = e.dst and a.k = b.k group by a.k),
ob as (select i as obs, -1.0 / (n - 1) as ei from i, n where k = 0)
select n.n, round(obs, 6) as morans_i, round(ei, 6) as expected_i,
  ((select count(*) from i where k > 0 and abs(i - ei) >= abs(obs - ei) - 1e-12) + 1) / 1000.0::double as perm_p from ob, n"""


def _region_edges(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_nationkey").alias("src"), "n_regionkey")
    b = t.nation.select(F.col("n_nationkey").alias("dst"), "n_regionkey")
    return S.standardise_edges(a.join(b, "n_regionkey").where("src <> dst").select("src", "dst", F.lit(1.0).alias("w")))


def _nation_means(t: Tables) -> DataFrame:
    return supplied(t).groupBy(F.col("n_nationkey").alias("id")).agg(
        F.avg(F.when(F.col("n_nationkey") != 7, F.col("l_extendedprice"))).alias("x"))


@query(_MORAN)
def moran_of_regions(t: Tables) -> DataFrame:
    out = AC.morans_i(cut_lineage(_nation_means(t)), _region_edges(t), "id", "x")
    return out.select("n", rounded("morans_i", 6), rounded("expected_i", 6), "perm_p")


@query(f"""
with m as ({_MORAN}) select 'mean price' as variable, round(morans_i, 3) as morans_i, round(expected_i, 3) as expected_i, round(perm_p, 3) as perm_p from m""")
def autocorrelation_table(t: Tables) -> DataFrame:
    values = cut_lineage(_nation_means(t).withColumn("empty", F.lit(None).cast("double")))
    return AC.autocorrelation_table(values, _region_edges(t), "id", [("x", "mean price"), ("empty", "no values"), ("absent", "absent")])


# squares of the lattice as parts of two zones; a square's sides are walked counter-clockwise, direction 0 to 3
_SIDES = """
with recursive s as (select p_partkey % 40 as x, p_partkey // 40 as y, cast(p_partkey * 7919 % 97 < 65 as int) as zone from part),
d as (select zone, x as x1, y as y1, x + 1 as x2, y as y2, 0 as d from s union all select zone, x + 1, y, x + 1, y + 1, 1 from s
  union all select zone, x + 1, y + 1, x, y + 1, 2 from s union all select zone, x, y + 1, x, y, 3 from s),
o as (select *, row_number() over (order by zone, x1, y1, x2, y2) as id from d a where not exists (
  select 1 from d b where b.zone = a.zone and b.x1 = a.x2 and b.y1 = a.y2 and b.x2 = a.x1 and b.y2 = a.y1)),
n as (select a.id, arg_min(b.id, (1 - (b.d - a.d + 4) % 4 + 4) % 4) as after from o a join o b on b.zone = a.zone and b.x1 = a.x2 and b.y1 = a.y2 group by a.id),
w as (select id as ring, id, 1 as k from o union all select w.ring, n.after, k + 1 from w join n using (id) where n.after > w.ring),
full_ring as (select ring from w join n using (id) where n.after = w.ring)
"""


def _zones(t: Tables) -> DataFrame:
    return _squares(t).select((F.col("area") * 7919 % 97 < 65).cast("int").alias("zone"), "rings")


@query(_SIDES + """select zone, any_value(x1) filter (k = 1)::double as x, any_value(y1) filter (k = 1)::double as y, count(*) as n_corners,
  sum(x1 * y2 - x2 * y1) / 2.0::double as size, count(*)::double as length from w join full_ring using (ring) join o using (id) group by zone, ring""")
def united_outlines(t: Tables) -> DataFrame:
    first = F.col("ring")[0]
    return O.outline_rings(_zones(t), "zone").select(
        "zone", first["x"].alias("x"), first["y"].alias("y"), "n_corners", "size", "length")
