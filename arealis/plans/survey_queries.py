"""Survey estimates and child features on microdata derived from the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..operators import survey as S
from ..operators.multilevel import fit_child_model, mixed_table
from .base import AREAS, SUPPLIED, Tables, areas, query, rounded, sql_key

# coded answers: column -> integer expression valid in both dialects
MICRO = {
    "v001": "l_suppkey",
    "v005": "cast(l_quantity as bigint) * 1000000",
    "hw70": "(l_partkey * 7 + l_orderkey) % 1300 - 650",
    "hw71": "(l_partkey * 11 + l_orderkey) % 1300 - 650",
    "hw72": "(l_partkey * 13 + l_orderkey) % 1300 - 650",
    "hw57": "(l_orderkey + l_linenumber) % 6",
    "hw1": "l_orderkey % 60",
    "b4": "l_partkey % 2 + 1",
    "v404": "l_partkey % 2",
    "v414e": "(l_partkey + l_linenumber) % 3",
    "v414o": "l_orderkey % 2",
    "v411": "(l_suppkey + l_linenumber) % 2",
    "v414h": "(l_orderkey + l_partkey) % 2",
    "v414g": "l_linenumber % 2",
    "v414i": "(l_orderkey + l_suppkey) % 3",
    "v414l": "l_partkey % 3",
    "v190": "l_orderkey % 5 + 1",
    "v191": "(l_partkey * 31 + l_orderkey) % 200000 - 100000",
    "v133": "l_orderkey % 20",
    "v106": "l_partkey % 10",
    "v113": "l_partkey % 99",
    "v116": "l_orderkey % 99",
    "v025": "l_linenumber % 2 + 1",
    "h11": "l_orderkey % 9",
    "h33": "l_partkey % 9",
    "v445": "1500 + (l_partkey * 37 + l_orderkey) % 9000",
    "v457": "(l_orderkey + l_partkey) % 6",
}
MICRO_SQL = (f"select {sql_key('n_name')} as county_norm, "
             + ", ".join(f"{e} as {c}" for c, e in MICRO.items()) + f" from ({SUPPLIED}) x")


def microdata(t: Tables) -> DataFrame:
    # names are normalised in the small table, not once per record
    keys = t.nation.select("n_nationkey", name_key("n_name").alias("county_norm"))
    places = t.supplier.join(keys, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "county_norm")
    return t.lineitem.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "county_norm", *[F.expr(e).alias(c) for c, e in MICRO.items()])


@query("""
select l_returnflag, round(100.0 * sum(case when l_discount >= 0.05 then l_quantity else 0 end) / sum(l_quantity), 6)
       as prevalence
from lineitem group by l_returnflag""")
def weighted_prevalence(t: Tables) -> DataFrame:
    flag = (F.col("l_discount") >= 0.05).cast("double")
    return t.lineitem.groupBy("l_returnflag").agg(
        rounded(S.weighted_share(flag, "l_quantity"), 6, "prevalence"))


@query("""
select l_returnflag, l_linestatus,
       round(sum(case when l_tax > 0 then l_quantity * l_extendedprice end)
             / sum(case when l_tax > 0 then l_quantity end), 4) as mean_price
from lineitem group by all""")
def weighted_mean(t: Tables) -> DataFrame:
    price = F.when(F.col("l_tax") > 0, F.col("l_extendedprice"))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        rounded(S.weighted_mean(price, "l_quantity"), 4, "mean_price"))


def _z(c: str) -> str:
    return (f"round(100.0 * sum(case when abs({c}) <= 600 and {c} < -200 then w else 0 end)"
            f" / sum(case when abs({c}) <= 600 then w end), 1)")


@query(f"""
with m as (select *, v005 / 1000000.0 as w from ({MICRO_SQL}) q),
k as (select county_norm, count(*) as n_children, {_z('hw70')} as stunting, {_z('hw72')} as wasting,
        {_z('hw71')} as underweight,
        round(100.0 * sum(case when hw57 in (1,2,3) then w else 0 end)
              / sum(case when hw57 between 1 and 4 then w end), 1) as child_anaemia,
        count(case when v457 between 1 and 4 then 1 end) as n_women,
        round(100.0 * sum(case when v457 in (1,2,3) then w else 0 end)
              / sum(case when v457 between 1 and 4 then w end), 1) as women_anaemia
      from m group by county_norm)
select county_code, county_name, k.* from k join ({AREAS}) a using (county_norm)""")
def nutrition_estimates(t: Tables) -> DataFrame:
    micro = microdata(t)
    kids = micro.select("county_norm", "v005", "hw70", "hw71", "hw72", "hw57")
    return S.nutrition_table(kids, areas(t), women=micro.select("county_norm", "v005", "v457"))


def _share(hit: str, valid: str) -> str:
    return (f"round(100.0 * sum(case when ({valid}) and ({hit}) then w else 0 end)"
            f" / sum(case when {valid} then w end), 1)")


DIET = """(case when v404 = 1 then 1 else 0 end + case when v414e = 1 then 1 else 0 end
  + case when v414o = 1 then 1 else 0 end + case when v411 = 1 then 1 else 0 end
  + case when v414h = 1 then 1 else 0 end + case when v414g = 1 then 1 else 0 end
  + case when v414i = 1 then 1 else 0 end + case when v414l = 1 then 1 else 0 end)"""
WATER = "11,12,13,14,21,31,41,51,71,72,91,92"
TOILET = "11,12,13,14,15,21,22,41"


@query(f"""
with m as (select *, v005 / 1000000.0 as w, {DIET} as groups_eaten from ({MICRO_SQL}) q),
k as (select county_norm,
   count(case when hw1 between 6 and 23 then 1 end) as n_children_6_23,
   {_share('groups_eaten >= 5', 'hw1 between 6 and 23')} as mdd,
   {_share('v190 in (1,2)', 'v190 is not null')} as poorest2_share,
   {_share('v106 = 0', 'v106 < 8')} as no_education_share,
   {_share('v106 >= 2', 'v106 < 8')} as secondary_plus_share,
   {_share(f'v113 in ({WATER})', 'v113 < 96')} as improved_water_share,
   {_share(f'v116 in ({TOILET})', 'v116 < 96')} as improved_sanitation_share,
   {_share('v025 = 1', 'v025 is not null')} as urban_share,
   {_share('h11 in (1,2)', 'h11 < 8')} as diarrhea_share,
   {_share('h33 in (1,2,3)', 'h33 <> 8')} as vit_a_supp_share,
   round(sum(w * v191 / 100000.0) / sum(w), 3) as wealth_factor_mean,
   round(sum(w * v133) / sum(w), 3) as edu_years_mean,
   {_share('v445 < 1850', 'v445 < 9000')} as maternal_thinness_share,
   {_share('v445 >= 2500', 'v445 < 9000')} as maternal_overweight_share,
   round(sum(case when v445 < 9000 then w * v445 / 100.0 end) / sum(case when v445 < 9000 then w end), 1)
     as maternal_bmi_mean
  from m group by county_norm)
select county_code, county_name, k.* from k join ({AREAS}) a using (county_norm)""")
def diet_and_controls(t: Tables) -> DataFrame:
    micro = microdata(t)
    return S.diet_controls_table(micro.drop("v445", "v457"), areas(t),
                                 women=micro.select("county_norm", "v005", "v445"))


def _clusters(t: Tables) -> DataFrame:
    return (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("dhsclust"), name_key("n_name").alias("county_norm"),
                    F.col("s_acctbal").alias("soc"), (F.col("s_suppkey") % 17).cast("double").alias("nitrogen"),
                    (F.col("s_suppkey") % 23).cast("double").alias("cec"),
                    (F.col("s_suppkey") % 29).cast("double").alias("fe_isda"),
                    (F.col("s_suppkey") % 31).cast("double").alias("rain_mm_mean"),
                    (F.col("s_suppkey") % 37).cast("double").alias("ndvi_mean")))


_CL = """select s_suppkey as dhsclust, s_acctbal as soc, cast(s_suppkey % 17 as double) as nitrogen,
  cast(s_suppkey % 23 as double) as cec, cast(s_suppkey % 29 as double) as fe_isda from supplier"""


def _zs(c: str) -> str:
    return f"({c} - (select avg({c}) from cl)) / (select stddev_pop({c}) from cl)"


@query(f"""
with cl as ({_CL}),
ix as (select dhsclust, ({_zs('soc')} + {_zs('nitrogen')} + {_zs('cec')} + {_zs('fe_isda')}) / 4.0 as s from cl),
k as (select *, case when abs(hw70) <= 600 then hw70 / 100.0 end as haz from ({MICRO_SQL}) q)
select county_norm, count(*) as n, count(haz) as n_haz, round(avg(haz), 6) as haz,
   round(avg(case when haz < -2 then 1.0 when haz is not null then 0.0 end), 6) as stunted,
   round(avg(case when b4 = 2 then 1.0 else 0.0 end), 6) as child_female,
   round(avg(s), 6) as soil_index_cluster
from k left join ix on v001 = dhsclust group by county_norm""")
def child_records(t: Tables) -> DataFrame:
    child = S.child_table(microdata(t), _clusters(t), "now")
    return child.groupBy("county_norm").agg(
        F.count(F.lit(1)).alias("n"), F.count("haz").alias("n_haz"), rounded(F.avg("haz"), 6, "haz"),
        rounded(F.avg("stunted"), 6, "stunted"), rounded(F.avg("child_female"), 6, "child_female"),
        rounded(F.avg("soil_index_cluster"), 6, "soil_index_cluster"))


@query()
def child_growth_model(t: Tables) -> DataFrame:
    child = S.child_table(microdata(t), _clusters(t), "now")
    return mixed_table(t.spark, {"haz": fit_child_model(child)})
