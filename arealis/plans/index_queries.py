"""The area spine, composite indices, year panels and the policy panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import listwise
from ..functions.parse import fiscal_year_end
from ..operators import indices as I
from ..operators import panel as PN
from ..operators.joins import assemble_spine
from ..operators.regression import split_at_median
from ..operators.typology import rank_correlation
from ..session import cut_lineage
from .base import AREAS, SUPPLIED, Tables, areas, query, rounded, sql_row_mean, supplied

_LAYERS_SQL = f"""
a as ({AREAS}),
li as (select n_nationkey, sum(case when l_discount >= 0.05 then l_quantity else 0 end) * 100.0 / sum(l_quantity) as stunting,
         sum(l_quantity * l_extendedprice) / sum(l_quantity) as food_nutrient_density_index
       from ({SUPPLIED}) x group by n_nationkey),
su as (select s_nationkey as n_nationkey, avg(s_acctbal) as soc, count(*) as suppliers from supplier group by all),
cu as (select c_nationkey as n_nationkey, avg(c_acctbal) as nitrogen, count(*) as households from customer group by all),
od as (select c_nationkey as n_nationkey, avg(o_totalprice) as cec, sum(o_totalprice) as production
       from orders join customer on o_custkey = c_custkey group by all),
t as (select county_code, county_name, stunting, food_nutrient_density_index, soc, suppliers, nitrogen, households, cec, production
      from a left join li using (n_nationkey) left join su using (n_nationkey) left join cu using (n_nationkey)
        left join od using (n_nationkey)),
z as (select *, {", ".join(f"case when stddev_pop({c}) over () = 0 then {c} * 0.0 else ({c} - avg({c}) over ()) / stddev_pop({c}) over () end as z_{c}" for c in ("soc", "nitrogen", "cec"))} from t),
i as (select *, {sql_row_mean(["z_soc", "z_nitrogen", "z_cec"])} as soil_index from z)"""


def area_layers(t: Tables) -> dict[str, tuple[DataFrame, str]]:
    li = supplied(t)
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    from ..operators.survey import weighted_mean, weighted_share

    return {
        "survey": (li.groupBy("n_nationkey").agg(
            weighted_share((F.col("l_discount") >= 0.05).cast("double"), "l_quantity").alias("stunting"),
            weighted_mean("l_extendedprice", "l_quantity").alias("food_nutrient_density_index")), "n_nationkey"),
        "suppliers": (t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
            F.avg("s_acctbal").alias("soc"), F.count(F.lit(1)).alias("suppliers")), "n_nationkey"),
        "customers": (t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
            F.avg("c_acctbal").alias("nitrogen"), F.count(F.lit(1)).alias("households")), "n_nationkey"),
        "orders": (orders.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
            F.avg("o_totalprice").alias("cec"), F.sum("o_totalprice").alias("production")), "n_nationkey"),
    }


@query(f"""with {_LAYERS_SQL}
select county_code, county_name, round(stunting, 6) as stunting, round(soil_index, 6) as soil_index,
  round(stunting - avg(stunting) over (), 6) as gap_body_stunting,
  round(avg(food_nutrient_density_index) over () - food_nutrient_density_index, 4) as gap_food_density,
  round(avg(soil_index) over () - soil_index, 6) as gap_soil,
  round(case when households > 0 then production / households end, 4) as production_per_household, suppliers
from i""")
def spine_index(t: Tables) -> DataFrame:
    spine = areas(t).select("county_code", "county_name", "n_nationkey")
    # a row per area from here on, written once so that index and gaps do not repeat the scans
    table = cut_lineage(assemble_spine(spine, area_layers(t)))
    table = I.derived_ratios(table, {"production_per_household": ("production", "households", 1, 1)})
    table = I.gaps_to_mean(I.soil_index(table), I.AREA_GAPS)
    digits = {"stunting": 6, "soil_index": 6, "gap_body_stunting": 6, "gap_food_density": 4, "gap_soil": 6,
              "production_per_household": 4}
    return table.select("county_code", "county_name", *[rounded(c, d) for c, d in digits.items()],
                        "suppliers").orderBy("county_code")


_SUP = """select s_suppkey, s_acctbal, count(l_orderkey) as lines, sum(l_quantity) as qty,
  count(l_orderkey) % 7 as tied from supplier left join lineitem on s_suppkey = l_suppkey group by all"""


def _sup(t: Tables) -> DataFrame:
    li = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("qty"))
    return (t.supplier.join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left")
            .select("s_suppkey", "s_acctbal", F.coalesce("lines", F.lit(0)).alias("lines"), "qty",
                    (F.coalesce("lines", F.lit(0)) % 7).alias("tied")))


def _variant(c: str) -> str:
    return (f"case when stddev_pop({c}) over () = 0 then {c} * 0.0 else ({c} - avg({c}) over ()) / stddev_pop({c}) over () end as z_{c}, "
            f"case when max({c}) over () > min({c}) over () then ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) else {c} * 0.0 end as m_{c}, "
            f"case when {c} is null then null when count({c}) over () > 1 then "
            f"(rank() over (order by {c}) + (count({c}) over (partition by {c}) - 1) / 2.0 - 1) / (count({c}) over () - 1) else 0.0 end as r_{c}")


_V = ("s_acctbal", "qty", "tied")
_VARIANTS = f"""with s as ({_SUP}), v as (select *, {", ".join(map(_variant, _V))} from s),
x as (select s_suppkey, {", ".join(f"{sql_row_mean([f'{p}_{c}' for c in _V])} as {n}" for p, n in (("z", "soil_index_z"), ("m", "soil_index_minmax"), ("r", "soil_index_rank")))} from v)"""


@query(f"""{_VARIANTS}
select s_suppkey, round(soil_index_z, 6) as soil_index_z, round(soil_index_minmax, 6) as soil_index_minmax,
  round(soil_index_rank, 6) as soil_index_rank from x""")
def index_variants(t: Tables) -> DataFrame:
    out = I.index_variants(_sup(t), "s_suppkey", _V)
    return out.select("s_suppkey", *[rounded(f"soil_index_{v}", 6) for v in ("z", "minmax", "rank")])


_RANKED = "".join(f", rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as r{i}"
                  for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount")))


@query(f"""
with r as (select 1 as one {_RANKED} from lineitem),
c as (select corr(r0, r1) as a, corr(r0, r2) as b, corr(r1, r2) as c from r)
select 'l_quantity' as variable, 1.0::double as l_quantity, round(a, 3) as l_extendedprice, round(b, 3) as l_discount from c
union all select 'l_extendedprice', round(a, 3), 1.0, round(c, 3) from c
union all select 'l_discount', round(b, 3), round(c, 3), 1.0 from c""")
def rank_correlations(t: Tables) -> DataFrame:
    return rank_correlation(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


@query(f"""
with s as ({_SUP}) select s_suppkey, round(case when lines > 0 then qty / lines end, 6) as qty_per_line,
  round(case when s_acctbal * 100.0 > 0 then lines * 1000.0 / (s_acctbal * 100.0) end, 6) as lines_per_balance from s""")
def derived_ratios(t: Tables) -> DataFrame:
    out = I.derived_ratios(_sup(t), {"qty_per_line": ("qty", "lines", 1, 1),
                                     "lines_per_balance": ("lines", "s_acctbal", 1000, 100)})
    return out.select("s_suppkey", rounded("qty_per_line", 6), rounded("lines_per_balance", 6))


_YEARLY = f"""select n_name, "year", sum(l_quantity) as v from ({SUPPLIED}) x
  where not (n_nationkey % 4 = 1 and "year" = 1998) group by all"""


def _yearly(t: Tables) -> DataFrame:
    rows = supplied(t).where(~((F.col("n_nationkey") % 4 == 1) & (F.col("year") == 1998)))
    return rows.groupBy("n_name", "year").agg(F.sum("l_quantity").alias("value"))


@query(f"""
with y as ({_YEARLY}),
g as (select n_name, yr, v from (select distinct n_name from y) a cross join (select distinct "year" as yr from y) b
      left join y using (n_name) where y."year" = yr or y."year" is null),
d as (select a.n_name, b.yr, y.v from (select distinct n_name from y) a cross join (select distinct "year" as yr from y) b
      left join y on y.n_name = a.n_name and y."year" = b.yr),
s as (select n_name, avg(v) as m, stddev_pop(v) as sd, count(v) as k, regr_slope(v, yr) as slope,
        arg_max(v, yr) filter (yr = (select max(yr) from d)) as recent from d group by n_name)
select n_name, round(m, 6) as rain_mm_mean, round(case when m > 0 then sd / m end, 6) as rain_cv,
  round(case when k >= 3 then slope end, 5) as rain_trend_mm_yr,
  round(case when sd > 0 then (recent - m) / sd end, 6) as rain_anomaly_recent,
  (select round(avg(case when sd > 0 and (v - m) / sd < -1.0 then 1.0 else 0.0 end), 6) from d where d.n_name = s.n_name)
    as drought_freq
from s""")
def rain_features(t: Tables) -> DataFrame:
    out = PN.rain_features(cut_lineage(_yearly(t)), "n_name")
    return out.select("n_name", rounded("rain_mm_mean", 6), rounded("rain_cv", 6), rounded("rain_trend_mm_yr", 5),
                      rounded("rain_anomaly_recent", 6), rounded("drought_freq", 6))


@query(f"""
with y as ({_YEARLY}), f as (select case when median(abs(v)) > 1.5 then 10000.0 else 1.0 end as f from y)
select n_name, round(avg(v / f), 6) as ndvi_mean, round(case when count(v) >= 3 then regr_slope(v / f, "year") end, 6) as ndvi_trend,
  round(stddev_pop(v / f) / avg(v / f), 6) as ndvi_cv from y, f group by n_name""")
def vegetation_features(t: Tables) -> DataFrame:
    out = PN.vegetation_features(cut_lineage(_yearly(t)), "n_name")
    return out.select("n_name", rounded("ndvi_mean", 6), rounded("ndvi_trend", 6), rounded("ndvi_cv", 6))


_FY = """case o_orderkey % 4 when 0 then cast(year(o_orderdate) as varchar) || '/' || right(cast(year(o_orderdate) + 1 as varchar), 2)
  when 1 then cast(year(o_orderdate) as varchar) || '/' || cast(year(o_orderdate) + 1 as varchar)
  when 2 then cast(year(o_orderdate) as varchar) else 'bad/year' end"""


@query(f"""
select fy, cast(case when fy = 'bad/year' then -1 when fy like '____/__' then cast(left(fy, 2) || right(fy, 2) as int)
  when fy like '____/____' then cast(right(fy, 4) as int) else cast(fy as int) end as int) as fy_end, count(*) as n
from (select {_FY} as fy from orders) q group by all""")
def fiscal_years(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    kind = F.col("o_orderkey") % 4
    fy = (F.when(kind == 0, F.concat_ws("/", y.cast("string"), F.substring((y + 1).cast("string"), 3, 2)))
          .when(kind == 1, F.concat_ws("/", y.cast("string"), (y + 1).cast("string")))
          .when(kind == 2, y.cast("string")).otherwise("bad/year"))
    return t.orders.select(fy.alias("fy")).groupBy("fy", fiscal_year_end("fy").alias("fy_end")).agg(
        F.count(F.lit(1)).alias("n"))


# the two-digit tail of 1999/00 keeps the century of the first part
_SPEND = f"""select lower(replace(n_name, '_', ' ')) as county_norm, year(o_orderdate) as y, case when year(o_orderdate) = 1999 then 1900 else year(o_orderdate) + 1 end as fy_end,
  cast(year(o_orderdate) as varchar) || '/' || right(cast(year(o_orderdate) + 1 as varchar), 2) as fiscal_year,
  sum(case when o_orderstatus <> 'O' then o_totalprice else 0.0 end) as ag_budget_alloc_kes_m,
  sum(case when o_orderstatus = 'F' then o_totalprice else 0.0 end) as ag_expenditure_kes_m,
  sum(o_totalprice) as total_expenditure_kes_m
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all"""
_ROLL = """select lower(replace(n_name, '_', ' ')) as county_norm, cast(1996 + count(*) % 4 as bigint) as fertilizer_entered_year,
  case when n_nationkey % 7 = 0 then 1 end as fertilizer_pilot from customer join nation on c_nationkey = n_nationkey
where n_nationkey % 5 <> 4 group by n_name, n_nationkey"""


def _spending(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    rows = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(areas(t), F.col("c_nationkey") == F.col("n_nationkey")))
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return rows.groupBy("county_norm", F.concat_ws("/", y.cast("string"), F.substring((y + 1).cast("string"), 3, 2))
                        .alias("fiscal_year")).agg(
        F.sum(F.when(status != "O", price).otherwise(0.0)).alias("ag_budget_alloc_kes_m"),
        F.sum(F.when(status == "F", price).otherwise(0.0)).alias("ag_expenditure_kes_m"),
        F.sum(price).alias("total_expenditure_kes_m"))


def _rollout(t: Tables) -> DataFrame:
    rows = t.customer.join(areas(t), F.col("c_nationkey") == F.col("n_nationkey")).where(F.col("n_nationkey") % 5 != 4)
    return rows.groupBy("county_norm", "n_nationkey").agg(
        (1996 + F.count(F.lit(1)) % 4).alias("fertilizer_entered_year")).select(
        "county_norm", "fertilizer_entered_year",
        F.when(F.col("n_nationkey") % 7 == 0, F.lit(1)).alias("fertilizer_pilot"))


def _zw(c: str) -> str:
    return f"case when stddev_pop({c}) over () = 0 then {c} * 0.0 else ({c} - avg({c}) over ()) / stddev_pop({c}) over () end"


_SIG = ("fertilizer_priority", "ag_expenditure_kes_m", "ag_absorption_rate", "ag_share_of_budget")


@query(f"""
with a as ({AREAS}), e as (select *, row_number() over (partition by county_norm order by fy_end desc) as r from ({_SPEND}) q),
f as (select *, cast(case when fertilizer_pilot >= 1 then 2 when fertilizer_entered_year <= 2023 then 1 else 0 end as int) as fertilizer_priority
      from ({_ROLL}) q),
j as (select a.county_code, a.county_norm, f.fertilizer_entered_year, f.fertilizer_priority, cast(e.fy_end as int) as expenditure_fy,
        ag_budget_alloc_kes_m, ag_expenditure_kes_m, case when ag_budget_alloc_kes_m > 0 then ag_expenditure_kes_m / ag_budget_alloc_kes_m end as ag_absorption_rate,
        case when total_expenditure_kes_m > 0 then ag_expenditure_kes_m / total_expenditure_kes_m end as ag_share_of_budget
      from a left join f using (county_norm) left join (select * from e where r = 1) e using (county_norm)),
z as (select *, {", ".join(f"{_zw(c)} as z_{c}" for c in _SIG)} from j)
select county_code, county_norm, fertilizer_entered_year, fertilizer_priority, expenditure_fy,
  round(ag_expenditure_kes_m, 2) as ag_expenditure_kes_m, round(ag_absorption_rate, 6) as ag_absorption_rate,
  round(ag_share_of_budget, 6) as ag_share_of_budget,
  round({sql_row_mean([f"z_{c}" for c in _SIG])}, 6) as policy_signal_index,
  round({sql_row_mean(["z_fertilizer_priority", "z_ag_expenditure_kes_m"])}, 6) as soil_food_policy_signal from z""")
def policy_summary(t: Tables) -> DataFrame:
    out = PN.policy_summary(areas(t).select("county_code", "county_norm"), _rollout(t), _spending(t))
    return out.select("county_code", "county_norm", "fertilizer_entered_year", "fertilizer_priority", "expenditure_fy",
                      rounded("ag_expenditure_kes_m", 2), *[rounded(c, 6) for c in (
                          "ag_absorption_rate", "ag_share_of_budget", "policy_signal_index", "soil_food_policy_signal")])


@query(f"""
with a as ({AREAS}) select county_code, county_norm, fiscal_year, round(ag_expenditure_kes_m, 2) as ag_expenditure_kes_m,
  cast(coalesce(fy_end >= fertilizer_entered_year, false) as int) as fertilizer_active
from ({_SPEND}) e left join a using (county_norm) left join ({_ROLL}) f using (county_norm)""")
def policy_panel(t: Tables) -> DataFrame:
    out = PN.policy_panel(areas(t).select("county_code", "county_norm"), _rollout(t), _spending(t))
    return out.select("county_code", "county_norm", "fiscal_year", rounded("ag_expenditure_kes_m", 2), "fertilizer_active")


@query(f"""
with a as ({AREAS}) select county_code, county_norm, cast(y as varchar) || '/' || right(cast(y + 1 as varchar), 2) as fiscal_year,
  cast(coalesce(y >= fertilizer_entered_year, false) as int) as fertilizer_active
from a cross join (values (1996), (1997), (1998)) v(y) left join ({_ROLL}) f using (county_norm)""")
def policy_calendar(t: Tables) -> DataFrame:
    return PN.policy_panel(areas(t).select("county_code", "county_norm"), _rollout(t), years=(1996, 1997, 1998))


@query(f"""
with y as (select n_name, "year", avg(l_discount) * 100 as stunting from ({SUPPLIED}) x group by all)
select n_name, round(a.stunting, 6) as stunting, round(b.stunting, 6) as stunting_2014, round(a.stunting - b.stunting, 6) as stunting_change
from (select * from y where "year" = 2000) a left join (select * from y where "year" = 1996) b using (n_name)""")
def round_change(t: Tables) -> DataFrame:
    y = supplied(t).groupBy("n_name", "year").agg((F.avg("l_discount") * 100).alias("stunting"))
    now, then = (y.where(F.col("year") == k).drop("year") for k in (2000, 1996))
    out = I.round_change(now, then, "n_name", ["stunting"], "_2014", {"stunting_change": "stunting"})
    return out.select("n_name", *[rounded(c, 6) for c in ("stunting", "stunting_2014", "stunting_change")])


@query(f"""
with s as ({_SUP}), m as (select median(s_acctbal) as ma, median(qty) as mq from s),
u as (select 'balance' as split, case when s_acctbal <= ma then 'low' when s_acctbal > ma then 'high' end as half, lines from s, m
  union all select 'volume', case when qty <= mq then 'less' when qty > mq then 'more' end, lines from s, m)
select split, half, count(*) as n, cast(sum(lines) as bigint) as lines from u where half is not null group by all""")
def median_halves(t: Tables) -> DataFrame:
    out = split_at_median(_sup(t), {"balance": ("s_acctbal", "low", "high"), "volume": ("qty", "less", "more")})
    return out.groupBy("split", "half").agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"))


@query("""
select l_returnflag, count(*) as n from (select l_returnflag, case when l_discount > 0 then l_extendedprice / l_discount
   when l_tax > 0.01 then 'inf'::double end as r, l_quantity from lineitem) q
where r is not null and not isinf(r) and not isnan(r) and l_quantity is not null group by l_returnflag""")
def complete_rows(t: Tables) -> DataFrame:
    r = (F.when(F.col("l_discount") > 0, F.col("l_extendedprice") / F.col("l_discount"))
         .when(F.col("l_tax") > 0.01, F.lit(float("inf"))))
    rows = listwise(t.lineitem.withColumn("r", r), ["r", "l_quantity"])
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
