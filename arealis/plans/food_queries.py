"""Prices, crops, budgets, points of measurement and nutrient supply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse as PA
from ..operators import aggregates as A
from ..operators import matching as M
from ..operators.order import fill_forward, keep_first
from .base import CROPS, SUPPLIED, Tables, crops, query, rounded, supplied


@query("""
with p as (select n_name, l_extendedprice / (case when p_size > 0 then p_size else 1 end) as v
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey
  where contains(lower(p_type), 'promo') and l_extendedprice > 0)
select n_name, round(median(v), 6) as promo_price_median, round(avg(v), 6) as promo_price_mean,
  round(stddev_samp(v) / avg(v), 6) as promo_price_cv, count(*) as promo_price_n
from p group by n_name""")
def unit_price_summary(t: Tables) -> DataFrame:
    rows = (supplied(t).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .select("n_name", F.col("l_extendedprice").alias("price"), F.col("p_type").alias("commodity"),
                    F.concat(F.col("p_size").cast("string"), F.lit(" KG")).alias("unit")))
    out = A.price_summary(rows, "n_name", commodity="Promo", prefix="promo_")
    return out.select("n_name", *[rounded(f"promo_price_{c}", 6) for c in ("median", "mean", "cv")],
                      "promo_price_n")


@query(f"""
with c as ({CROPS}), d as (select * from c where "year" = (select max("year") from c))
select county_name, round(coalesce(sum(area_ha), 0.0), 2) as crop_area_ha,
  round(coalesce(sum(production_mt), 0.0), 2) as crop_production_mt,
  nullif(count(distinct case when production_mt is not null then crop end), 0) as n_crops,
  case when bool_or(lower(crop) = 'promo') then round(coalesce(sum(case when lower(crop) = 'promo' then area_ha end), 0.0), 2) end as promo_area_ha,
  case when bool_or(lower(crop) = 'promo') then round(coalesce(sum(case when lower(crop) = 'promo' then production_mt end), 0.0), 2) end as promo_production_mt,
  cast(max("year") as int) as crop_year
from d group by county_name""")
def latest_year_totals(t: Tables) -> DataFrame:
    out = A.crop_summary(crops(t), "county_name", staple="promo")
    money = ("crop_area_ha", "crop_production_mt", "promo_area_ha", "promo_production_mt")
    return out.withColumns({c: F.round(c, 2) for c in money})


@query(f"""
with c as ({CROPS}),
d as (select county_name, crop, sum(production_mt) as x from c
      where "year" = (select max("year") from c) and production_mt > 0 group by all),
s as (select *, x / sum(x) over (partition by county_name) as p from d)
select county_name, round(-sum(p * ln(p)), 3) as crop_diversity_shannon,
  round(coalesce(sum(case when contains(lower(crop), 'promo') then p end), 0.0), 3) as promo_production_share,
  count(*) as n_crops_county
from s group by county_name""")
def shannon_mix(t: Tables) -> DataFrame:
    return A.crop_diversity(crops(t), "county_name", staple="promo")


@query(f"""
with c as ({CROPS}), g as (select county_name, crop, "year", sum(area_ha) as area_ha, sum(production_mt) as production_mt
  from c group by all)
select county_name, crop, "year", round(area_ha, 2) as area_ha, round(production_mt, 2) as production_mt,
  round(case when area_ha > 0 then production_mt / area_ha end, 6) as yield_t_ha
from g where "year" = (select max("year") from g)""")
def crop_yields(t: Tables) -> DataFrame:
    facts = crops(t).groupBy("county_name", "crop", "year").agg(
        F.sum("area_ha").alias("area_ha"), F.sum("production_mt").alias("production_mt"))
    return A.crop_yields(facts).withColumns({
        "area_ha": F.round("area_ha", 2), "production_mt": F.round("production_mt", 2),
        "yield_t_ha": F.round("yield_t_ha", 6)})


@query(f"""
with g as (select crop, "year", round(sum(area_ha), 1) as area_ha, round(sum(production_mt), 1) as production_mt
  from ({CROPS}) c group by all)
select *, round(case when area_ha > 0 then production_mt / area_ha end, 3) as yield_t_ha from g""")
def national_totals(t: Tables) -> DataFrame:
    return A.national_summary(crops(t))


@query("""
select p_type, round(sum(l_extendedprice), 1) as cost from lineitem join part on l_partkey = p_partkey
group by p_type order by cost desc""")
def cost_by_category(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "p_type", F.col("l_extendedprice").alias("cost"))
    return A.cost_by_category(rows, "p_type", "cost")


@query(f"""
with r as (select r_name, n_name, round(sum(l_extendedprice), 2) as cost,
    case grouping(r_name) * 2 + grouping(n_name) when 3 then 'total' when 1 then 'section' else 'item' end as level
  from ({SUPPLIED}) x join region on n_regionkey = r_regionkey group by rollup (r_name, n_name))
select *, case when level = 'total' then 1600.0::double end as stated,
  round(cost - case when level = 'total' then 1600.0::double end, 2) as difference,
  abs(cost - case when level = 'total' then 1600.0::double end) < 0.05 as agrees
from r""")
def budget_rollup(t: Tables) -> DataFrame:
    rows = supplied(t).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "r_name", "n_name", F.col("l_extendedprice").alias("cost"))
    out = A.budget_rollup(rows, "r_name", "n_name", "cost", stated_total=1600.0)
    return out.withColumns({"cost": F.round("cost", 2), "difference": F.round("difference", 2)})


@query("""
select c_nationkey,
  first(o_totalprice order by o_orderdate, o_orderkey) filter (o_orderstatus = 'F') as f_stated,
  first(o_totalprice order by o_orderdate, o_orderkey) filter (o_orderstatus = 'O') as o_stated,
  first(o_totalprice order by o_orderdate, o_orderkey) filter (o_orderstatus = 'P') as p_stated
from orders join customer on o_custkey = c_custkey group by c_nationkey""")
def pivot_first(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return A.pivot_first(rows, "c_nationkey", "o_orderstatus", "o_totalprice", ["F", "O", "P"],
                         [F.col("o_orderdate"), F.col("o_orderkey")], "_stated")


@query("""
select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey
  order by year(o_orderdate) desc, o_orderkey desc) as r from orders) q where r = 1""")
def latest_per_group(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("fy"))
    return A.latest_per_group(rows, ["o_custkey"], [F.col("fy"), F.col("o_orderkey")]).drop("fy")


@query("""
select l_suppkey, l_partkey, l_orderkey from (select *, row_number() over (partition by l_suppkey
  order by l_extendedprice desc, l_orderkey, l_linenumber) as r from lineitem) q where r = 1""")
def keep_first_record(t: Tables) -> DataFrame:
    order = [-F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return keep_first(t.lineitem, ["l_suppkey"], order).select("l_suppkey", "l_partkey", "l_orderkey")


@query("""
with u as (unpivot (select l_quantity, l_extendedprice, l_discount,
    case when l_tax > 0 then l_tax else null end as l_tax from lineitem)
  on l_quantity, l_extendedprice, l_discount, l_tax into name variable value value)
select variable, count(*) as "count", round(avg(value), 3) as mean, round(stddev_samp(value), 3) as std,
  round(min(value), 3) as min, round(quantile_cont(value, 0.25), 3) as q25,
  round(quantile_cont(value, 0.5), 3) as q50, round(quantile_cont(value, 0.75), 3) as q75,
  round(max(value), 3) as max, (select count(*) from lineitem) - count(*) as missing
from u group by variable""")
def descriptives(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount",
                             F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("l_tax"))
    return A.describe(rows)


_DEPTHS = {"1": 5.0, "2": 10.0, "3": 15.0}


@query("""
select l_suppkey, property, round(sum(coalesce(v, 0.0) * w) / sum(w) / d, 6) as value from (
  select l_suppkey, l_returnflag as property, case when l_discount > 0 then l_quantity end as v,
    case l_linenumber when 1 then 5.0 when 2 then 10.0 else 15.0 end as w,
    case l_returnflag when 'N' then 100.0 else 10.0 end as d
  from lineitem where l_linenumber <= 3) q group by l_suppkey, property, d""")
def depth_mean(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_suppkey", F.col("l_returnflag").alias("property"), F.col("l_linenumber").cast("string").alias("depth"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("value"))
    out = A.depth_mean(rows, ["l_suppkey"], weights=_DEPTHS, divisors={"N": 100, "A": 10, "R": 10})
    return out.withColumn("value", F.round("value", 6))


@query("""
select l_suppkey, property, round(sum(v * w) / sum(case when v is not null then w end) / d, 6) as value from (
  select l_suppkey, l_returnflag as property, case when l_discount > 0 then l_quantity end as v,
    case l_linenumber when 1 then 5.0 when 2 then 10.0 else 15.0 end as w,
    case l_returnflag when 'N' then 100.0 else 10.0 end as d
  from lineitem where l_linenumber <= 3) q group by l_suppkey, property, d""")
def depth_mean_of_present(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_suppkey", F.col("l_returnflag").alias("property"), F.col("l_linenumber").cast("string").alias("depth"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("value"))
    out = A.depth_mean(rows, ["l_suppkey"], weights=_DEPTHS, divisors={"N": 100, "A": 10, "R": 10},
                       renormalise=True)
    return out.withColumn("value", F.round("value", 6))


@query(f"""
select n_name, round(avg(v), 6) as l_extendedprice, count(*) as n_periods from (
  select n_name, "year", avg(l_extendedprice) as v from ({SUPPLIED}) x group by all) q group by n_name""")
def mean_of_yearly_means(t: Tables) -> DataFrame:
    out = A.mean_of_period_means(supplied(t), ["n_name"], "year", "l_extendedprice")
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@query(f"""
select n_name, round(avg(v), 4) as l_quantity, count(*) as n_periods from (
  select n_name, "year", sum(l_quantity) as v from ({SUPPLIED}) x group by all) q group by n_name""")
def mean_of_yearly_totals(t: Tables) -> DataFrame:
    out = A.mean_of_period_means(supplied(t), ["n_name"], "year", "l_quantity", within="sum")
    return out.withColumn("l_quantity", F.round("l_quantity", 4))


@query(f"""
with e as (select n_name, n_nationkey, round(avg(l_discount) * 100, 4) as estimate from ({SUPPLIED}) x group by all)
select n_name, estimate, 5.0::double + n_nationkey as stated, round(estimate - (5.0::double + n_nationkey), 1) as difference
from e where n_nationkey % 5 = 0""")
def estimate_against_stated(t: Tables) -> DataFrame:
    rows = supplied(t).groupBy("n_name", "n_nationkey").agg(
        F.round(F.avg("l_discount") * 100, 4).alias("estimate"))
    rows = rows.withColumn("stated", F.when(F.col("n_nationkey") % 5 == 0, F.lit(5.0) + F.col("n_nationkey")))
    return A.compare_with_stated(rows, "n_name", "estimate", "stated")


# items are the second word of part names, foods the parts themselves
_RULES = {"ring": (("ring",), ("red",)), "bolt": (("bolt", "gear"), ("cold",))}
_GOOD, _BAD = ("small", "old"), ("hot",)
_FOODS = """select p_partkey as ordinal, lower(regexp_replace(lower(p_name || ' ' || p_type), '[^0-9a-z]+', '', 'g')) as nm,
  p_name || ' ' || p_type as food_name, p_size, p_retailprice from part"""
_SCORED = f"""select *, 2 * (case when contains(nm, 'small') then 1 else 0 end) + 2 * (case when contains(nm, 'old') then 1 else 0 end)
  - (case when contains(nm, 'hot') then 1 else 0 end) as score from ({_FOODS}) f"""
_MATCH = f"""select item, ordinal, food_name, p_size, p_retailprice from (
  select i.item, f.*, row_number() over (partition by i.item order by score desc, ordinal) as r
  from (select distinct split_part(p_name, ' ', 2) as item from part) i join ({_SCORED}) f
    on (case i.item when 'ring' then contains(nm, 'ring') and not contains(nm, 'red')
        when 'bolt' then (contains(nm, 'bolt') or contains(nm, 'gear')) and not contains(nm, 'cold')
        else contains(nm, i.item) end)) q where r = 1"""


def _foods(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("ordinal"), F.concat_ws(" ", "p_name", "p_type").alias("food_name"),
        "p_size", "p_retailprice")


@query(_MATCH)
def fuzzy_match(t: Tables) -> DataFrame:
    items = t.part.select(F.split("p_name", " ")[1].alias("item"))
    return M.match_items(items, _foods(t), "item", "food_name", "ordinal", _RULES, _GOOD, _BAD)


_NAMES = ("food_kcal_pc_day", "food_protein_g_pc_day", "food_iron_mg_pc_day", "food_zinc_mg_pc_day",
          "food_vita_rae_pc_day", "food_folate_pc_day", "food_calcium_mg_pc_day")
_PER_G = ("p_size * 10.0", "p_size * 1.0", "p_retailprice / 100.0", "p_retailprice / 200.0",
          "p_size * 2.0", "p_retailprice / 50.0", "p_size * 3.0")
_DEFAULT_MATCH = f"""select item, ordinal, food_name, p_size, p_retailprice from (
  select i.item, f.*, row_number() over (partition by i.item order by ordinal) as r
  from (select distinct split_part(p_name, ' ', 2) as item from part) i join ({_FOODS}) f on contains(nm, i.item)) q where r = 1"""


@query(f"""
with c as ({CROPS}), m as ({_DEFAULT_MATCH}),
d as (select county_name, item, sum(production_mt) as tonnes, count(*) as n from c
      where "year" = (select max("year") from c) and production_mt > 0 group by all),
e as (select case when median(p_size) > 1.5 then 100.0 else 1.0 end as f from part),
s as (select county_name, sum(n) as n, {", ".join(f"sum(tonnes * 1000000.0 * greatest(0.1, least(1.0, p_size / e.f)) * ({g}) / 100.0) as s{i}" for i, g in enumerate(_PER_G))}
      from d join m using (item), e group by county_name),
h as (select n_name as county_name, 1000.0 * (1 + n_nationkey) as people from nation),
o as (select county_name, cast(n as bigint) as n_crops_matched,
       {", ".join(f"s{i} / (people * 365.0) as {n}" for i, n in enumerate(_NAMES))},
       {", ".join(f"s{i} / s0 * 1000.0 as {n.replace('_pc_day', '_per_1000kcal')}" for i, n in enumerate(_NAMES) if i)}
      from s join h using (county_name))
select county_name, n_crops_matched,
  {", ".join(f"round({n}, 4) as {n}" for n in _NAMES)},
  {", ".join(f"round({n.replace('_pc_day', '_per_1000kcal')}, 6) as {n.replace('_pc_day', '_per_1000kcal')}" for n in _NAMES[1:])},
  round(({" + ".join(f"({n} - avg({n}) over ()) / stddev_pop({n}) over ()" for n in _NAMES[1:])}) / 6.0, 6)
    as food_nutrient_density_index
from o""")
def nutrient_supply(t: Tables) -> DataFrame:
    columns = ("energy_kcal", "protein_g", "fe_mg", "zn_mg", "vit_a_rae_mcg", "folate_dfe_mcg", "ca_mg")
    foods = _foods(t).select("ordinal", "food_name", F.col("p_size").cast("double").alias("edible_factor"),
                             *[F.expr(g).alias(c) for c, g in zip(columns, _PER_G)])
    people = t.nation.select(F.col("n_name").alias("county_name"),
                             (1000.0 * (1 + F.col("n_nationkey"))).alias("population_total"))
    out = M.nutrient_supply(crops(t), foods, people, by="county_name", item="item")
    return out.select("county_name", "n_crops_matched", *[
        rounded(c, 6 if "kcal" in c and c != "food_kcal_pc_day" or c.endswith("index") else 4)
        for c in out.columns if c not in ("county_name", "n_crops_matched")])


@query("""
select l_suppkey, round(avg(exp(l_quantity / 10.0) - 1.0), 6) as natural, round(avg(l_quantity / 10.0), 6) as ph,
  round(avg((l_quantity * 20.0 + l_linenumber * 10.0) / 30.0), 6) as blended,
  round(avg(0.0483 * pow(l_quantity * 20.0, 1.61)), 4) as r_factor,
  round(avg(case when l_quantity >= 5.14 then 16.8 * sin(radians(l_quantity)) - 0.5
                 else 10.8 * sin(radians(l_quantity)) + 0.03 end), 6) as s_factor,
  round(avg(0.0483 * pow(l_quantity * 20.0, 1.61) * case when l_quantity >= 5.14
                 then 16.8 * sin(radians(l_quantity)) - 0.5 else 10.8 * sin(radians(l_quantity)) + 0.03 end), 3) as risk
from lineitem group by l_suppkey""")
def pixel_transforms(t: Tables) -> DataFrame:
    mm = F.col("l_quantity") * 20.0
    return t.lineitem.groupBy("l_suppkey").agg(
        rounded(F.avg(PA.back_transform("l_quantity")), 6, "natural"),
        rounded(F.avg(PA.back_transform("l_quantity", "ph")), 6, "ph"),
        rounded(F.avg(PA.blend_depths("l_quantity", "l_linenumber")), 6, "blended"),
        rounded(F.avg(PA.rain_erosivity(mm)), 4, "r_factor"),
        rounded(F.avg(PA.slope_factor("l_quantity")), 6, "s_factor"),
        rounded(F.avg(PA.erosion_risk(mm, "l_quantity")), 3, "risk"))


@query("""
select event_id, user_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (
  partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_purchase
from events""")
def forward_fill(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", F.to_date("ts").alias("day"),
                           F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"))
    return fill_forward(rows, ["user_id"], "day", ["ts", "event_id"], ["last_purchase"]).select(
        "event_id", "user_id", "last_purchase")
