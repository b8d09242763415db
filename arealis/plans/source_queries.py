"""Parsers, printed tables and text lines on data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import presets as P
from ..functions import parse as PA
from ..operators import keys as K
from ..sources import cells as C
from ..sources import files as S
from ..sources import infer as IN
from ..sources import lines as LN
from .base import CROPS, SUPPLIED, Tables, crops, query, supplied


@query("""
select event_id, event_type as indicator, upper(event_type) as indicator_name, 'U' || user_id as country,
  cast(year(ts) as int) as "year", value, json_extract_string(props, '$.k') as k from events where event_id % 11 <> 0 and event_id % 13 <> 0""")
def json_flatten(t: Tables) -> DataFrame:
    obs = F.to_json(F.array(F.struct(
        F.struct(F.col("event_type").alias("id"), F.upper("event_type").alias("value")).alias("indicator"),
        F.struct(F.concat(F.lit("U"), "user_id").alias("id")).alias("country"),
        F.year("ts").cast("string").alias("date"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))), {"ignoreNullFields": "false"})
    payload = F.when(F.col("event_id") % 13 == 0, F.lit("not json")).otherwise(
        F.concat(F.lit('[{"page":1},'), obs, F.lit("]")))
    rows = t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), payload.alias("value"))
    return S.indicator_rows(rows, "value", carry=["event_id", "k"])


@query("""
select l_orderkey, l_linenumber,
  case when l_linenumber = 1 then null when l_linenumber = 2 then l_orderkey * 1000 + l_partkey
    when l_linenumber = 3 then -l_quantity when l_linenumber = 4 then null else l_extendedprice end::double as number,
  case when l_linenumber = 1 then null when l_linenumber = 3 then -l_quantity when l_linenumber = 4 then null
    when l_linenumber = 5 then l_extendedprice when l_linenumber = 6 then 0.0 when l_linenumber = 7 then l_extendedprice end::double as composition,
  case when l_linenumber = 4 then (case when l_quantity > 0 then l_quantity else 1 end) else 1.0 end::double as quantity
from lineitem""")
def number_cells(t: Tables) -> DataFrame:
    n, q, p = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_extendedprice")
    price = F.regexp_replace(F.format_number(p, 2), "^$", "")
    thousands = F.concat(F.lit(" "), F.format_number(F.col("l_orderkey") * 1000 + F.col("l_partkey"), 0), F.lit(" *"))
    shown = (F.when(n == 1, F.lit("-")).when(n == 2, thousands)
             .when(n == 3, F.concat(F.lit("-"), q.cast("string"))).when(n == 4, F.lit("3-4-5")).otherwise(price))
    comp = (F.when(n == 1, F.lit(" n.d. ")).when(n == 3, F.concat(F.lit("-"), q.cast("string")))
            .when(n == 4, F.concat(q.cast("string"), F.lit("-9"))).when(n == 5, F.concat(F.lit("["), price, F.lit("]")))
            .when(n == 6, F.lit("Tr")).when(n == 7, price))
    unit = F.when(n == 4, F.concat(F.lit("per "), q.cast("string"), F.lit(" KG"))).otherwise(F.lit("KG"))
    return t.lineitem.select("l_orderkey", "l_linenumber", PA.number_cell(shown).alias("number"),
                     PA.composition_cell(comp).alias("composition"), PA.unit_quantity(unit).alias("quantity"))


@query("""
select o_orderkey, case when o_orderkey % 7 <> 0 then o_totalprice end as price,
  case when o_orderkey % 5 <> 0 then cast(cast(o_orderdate as date) as varchar) end as day from orders""")
def coerced_columns(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    raw = t.orders.select("o_orderkey", F.when(k % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("price"),
                          F.when(k % 5 == 0, F.lit("soon")).otherwise(F.col("o_orderdate").cast("string")).alias("day"))
    out = PA.coerce(raw, ["price", "absent"], ["day"])
    return out.select("o_orderkey", "price", F.to_date("day").cast("string").alias("day"))


@query("""select o_orderkey from orders where o_orderkey <> (select min(o_orderkey) from orders)""")
def stripped_tag_row(t: Tables) -> DataFrame:
    first = F.col("o_orderkey") == t.orders.agg(F.min("o_orderkey").alias("m")).scalar()
    raw = t.orders.select("o_orderkey", *[F.when(first, F.lit(f"#{c}")).otherwise(F.col(c).cast("string")).alias(c)
                                          for c in ("o_custkey", "o_totalprice", "o_orderstatus")])
    return S.strip_tag_row(raw, "o_orderkey").select("o_orderkey")


@query("""
select "year", count(*) as n from (select case when o_orderkey % 6 <> 0 then cast(year(o_orderdate) as int) end as "year" from orders) q group by all""")
def years_in_names(t: Tables) -> DataFrame:
    name = F.concat(F.lit("rain_12_"), F.when(F.col("o_orderkey") % 6 == 0, F.lit("none")).otherwise(F.year("o_orderdate").cast("string")),
                    F.lit("_v1.tif"))
    return t.orders.select(PA.year_in(name).alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


# --- printed tables ---------------------------------------------------------------------------
def _cell(row, col, text):
    return F.struct(row.cast("int").alias("row_no"), F.lit(col).cast("int").alias("col_no"), text.cast("string").alias("text"))


def _yearly_crops(t: Tables) -> DataFrame:
    return crops(t).groupBy("crop", "county_name", "year").agg(
        F.round(F.sum("area_ha"), 2).alias("a"), F.round(F.sum("production_mt"), 2).alias("p"))


def _crop_cells(t: Tables) -> DataFrame:
    """A printed table per crop and area pair of years: a two-row header over area rows."""
    facts = _yearly_crops(t)
    header = facts.select("crop", "year").distinct()
    col = (F.col("year") - 1990) * 2 - 1
    def cell(row, col_no, text):
        return F.struct(row.cast("int").alias("row_no"), col_no.cast("int").alias("col_no"), text.cast("string").alias("text"))

    zero, one = F.lit(0), F.lit(1)
    heads = header.select("crop", F.explode(F.array(
        cell(zero, col, F.col("year")), cell(zero, col + 1, F.lit("")),
        cell(one, col, F.lit("Area (Ha)")), cell(one, col + 1, F.lit("Prod (MT)")))).alias("c"))
    row = F.regexp_extract("county_name", r"(\d+)", 1).cast("int") + 2
    body = facts.select("crop", F.explode(F.array(
        cell(row, col, F.format_number("a", 2)), cell(row, col + 1, F.format_number("p", 2)))).alias("c"))
    names = facts.select("crop", "county_name").distinct().select("crop", F.explode(F.array(
        cell(row, zero, F.when(row == 2, F.lit("Total")).otherwise(F.regexp_replace("county_name", "_", "\n"))))).alias("c"))
    return heads.unionByName(body).unionByName(names).select(
        F.col("crop").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table_no"), "c.*")


_CROP_TABLE = f"""
select crop as doc_id, replace(county_name, '_', ' ') as name, "year", round(sum(area_ha), 2) as area_ha,
  round(sum(production_mt), 2) as production_mt from ({CROPS}) c where county_name <> 'NATION_0'
group by all having sum(area_ha) is not null or sum(production_mt) is not null"""


def _area_keys(t: Tables) -> DataFrame:
    from .base import areas
    return areas(t)


@query(_CROP_TABLE)
def two_tier_crops(t: Tables) -> DataFrame:
    return C.two_tier_crops(_crop_cells(t), _area_keys(t))


@query(_CROP_TABLE)
def rotated_crops(t: Tables) -> DataFrame:
    """The same tables printed sideways, with a first row wider than 20 cells."""
    cells = _crop_cells(t)
    # pad to a full grid row so that the turned table opens with more than 20 cells
    pad = cells.select("doc_id", "page", "table_no").distinct().select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("row_no")).select(
        "doc_id", "page", "table_no", F.col("row_no").cast("int"), F.lit(99).cast("int").alias("col_no"),
        F.lit("").alias("text"))
    last = F.lit(99)
    side = cells.unionByName(pad).select(
        "doc_id", "page", "table_no", (last - F.col("col_no")).cast("int").alias("row_no"),
        F.col("row_no").alias("col_no"), F.reverse("text").alias("text"))
    return C.two_tier_crops(C.unrotate(side), _area_keys(t))


def _census_cells(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Region totals followed by their nations, with a crosswalk of both."""
    facts = supplied(t).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(
        "r_name", "n_regionkey", "n_name", "n_nationkey").agg(
        F.round(F.sum("l_quantity"), 2).alias("total"), F.count(F.lit(1)).alias("male"))
    regions = facts.groupBy("r_name", "n_regionkey").agg(F.round(F.sum("total"), 2).alias("total"), F.sum("male").alias("male"))
    row = F.col("n_regionkey") * 100 + 10
    lines = regions.select(row.alias("row_no"), F.col("r_name").alias("name"), "total", "male").unionByName(
        facts.select((row + 1 + F.col("n_nationkey")).alias("row_no"), F.col("n_name").alias("name"), "total", "male"))
    cells = lines.select(F.explode(F.array(
        _cell(F.col("row_no"), 0, F.col("name")), _cell(F.col("row_no"), 1, F.format_number("total", 2)),
        _cell(F.col("row_no"), 2, F.col("male")))).alias("c")).select(
        F.lit("census").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table_no"), "c.*")
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    xwalk = names.select(
        F.concat(F.lit("R"), "r_regionkey").alias("county_code"), F.col("r_name").alias("county_name"),
        F.lower("r_name").alias("county_norm"), F.concat(F.lit("N"), "n_nationkey").alias("subcounty_code"),
        F.col("n_name").alias("subcounty_name"), F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("subcounty_norm"))
    return cells, xwalk


def _with_header(cells: DataFrame, rows: list[list[str]]) -> DataFrame:
    head = cells.select("doc_id", "page", "table_no").distinct().select("*", F.explode(F.array(*[
        F.struct(F.lit(i).alias("row_no"), F.lit(j).alias("col_no"), F.lit(x).alias("text"))
        for i, r in enumerate(rows) for j, x in enumerate(r)])).alias("h")).select("doc_id", "page", "table_no", "h.*")
    return head.unionByName(cells)


_TOTALS = f"""with f as (select r_name, r_regionkey, n_name, n_nationkey, round(sum(l_quantity), 2) as total, count(*) as male
  from ({SUPPLIED}) x join region on n_regionkey = r_regionkey group by all)"""


@query(f"""{_TOTALS}
select 'area' as level, lower(r_name) as key, round(sum(total), 2) as population_total, cast(sum(male) as double) as population_male, 'R' || r_regionkey as code from f group by r_name, r_regionkey
union all select 'sub', lower(replace(n_name, '_', ' ')), total, cast(male as double), 'N' || n_nationkey from f""")
def classified_rows(t: Tables) -> DataFrame:
    cells, xwalk = _census_cells(t)
    cells = _with_header(cells, [["Population by county"], ["County", "Total", "Male", "Female"]])
    area, sub = C.classify_rows(cells, xwalk, measures=["population_total", "population_male"])
    return area.select(F.lit("area").alias("level"), F.col("county_norm").alias("key"), "population_total", "population_male",
                       F.col("county_code").alias("code")).unionByName(
        sub.select(F.lit("sub").alias("level"), F.col("subcounty_norm").alias("key"), "population_total", "population_male",
                   F.col("subcounty_code").alias("code")))


_NATION_TABLES = """with cells as (
  select n_name as doc_id, c_custkey % 40 as row_no, c_custkey % 7 as col_no,
         case when c_acctbal > 6000 then 'County' when c_acctbal > 3000 then 'Total' when c_acctbal > 0 then c_mktsegment else '' end as text
  from customer join nation on c_nationkey = n_nationkey),
once as (select doc_id, row_no, col_no, max(text) as text from cells group by all),
rows as (select doc_id, row_no, count(*) filter (trim(text) <> '') as filled, bool_or(text = 'County') as named,
                bool_or(regexp_matches(lower(text), 'population|household|area|density|male|female|total')) as measured from once group by all)
"""


@query(_NATION_TABLES + """select doc_id, 1::int as page, 0::int as table_no,
  cast(coalesce(min(row_no) filter (filled >= 3 and named and measured), 0) as int) as header_row from rows group by doc_id""")
def header_rows(t: Tables) -> DataFrame:
    """A table per nation whose cells come from its customers, so that headers stand anywhere or nowhere."""
    balance = F.col("c_acctbal")
    text = (F.when(balance > 6000, "County").when(balance > 3000, "Total").when(balance > 0, F.col("c_mktsegment"))
            .otherwise(""))
    cells = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_name").alias("doc_id"), (F.col("c_custkey") % 40).cast("int").alias("row_no"),
        (F.col("c_custkey") % 7).cast("int").alias("col_no")).agg(F.max(text).alias("text"))
    return C.header_row(cells.withColumns({"page": F.lit(1), "table_no": F.lit(0)}))


@query(f"""{_TOTALS}
select 'area' as level, lower(r_name) as key, round(sum(total), 2) as ag_land_ha_subsistence, cast(sum(male) as double) as ag_land_ha_commercial, 'R' || r_regionkey as code from f group by r_name, r_regionkey
union all select 'sub', lower(replace(n_name, '_', ' ')), total, cast(male as double), 'N' || n_nationkey from f where n_nationkey <> 3""")
def sectioned_rows(t: Tables) -> DataFrame:
    cells, xwalk = _census_cells(t)
    cells = _with_header(cells, [["Agriculture"], ["County", "Area (Ha)", ""], ["", "Subsistence", "Commercial"]])
    area, sub = C.sectioned_table(cells, xwalk, skip_keys=("nation 3",))
    keep = ("ag_land_ha_subsistence", "ag_land_ha_commercial")
    return area.select(F.lit("area").alias("level"), F.col("county_norm").alias("key"), *keep, F.col("county_code").alias("code")).unionByName(
        sub.select(F.lit("sub").alias("level"), F.col("subcounty_norm").alias("key"), *keep, F.col("subcounty_code").alias("code")))


@query("""
with k as (select distinct p_name as key from part union select distinct split_part(p_name, ' ', 1) from part where p_name like 'red %'),
l as (select p_partkey, p_name, case when p_partkey % 3 = 0 then split_part(p_name, ' ', 1) || ' old' else p_name end as nm, p_size, p_retailprice from part)
select p_partkey as line_no, case when nm in (select key from k) then nm else split_part(nm, ' ', 1) end as key,
  cast(p_size as double) as first_number, 3::int as width
from l where nm in (select key from k) or split_part(nm, ' ', 1) in (select key from k)""")
def longest_key_prefix(t: Tables) -> DataFrame:
    first = F.split("p_name", " ")[0]
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(first, F.lit(" old"))).otherwise(F.col("p_name"))
    text = F.concat_ws(" ", name, F.col("p_size").cast("string"), F.format_number("p_retailprice", 2), F.col("p_partkey").cast("string"))
    lines = t.part.select(F.lit("parts").alias("doc_id"), F.col("p_partkey").alias("line_no"), text.alias("text"))
    keys = t.part.select(F.col("p_name").alias("key")).unionByName(
        t.part.where(F.col("p_name").startswith("red ")).select(first.alias("key"))).distinct()
    return LN.keyed_lines(lines, keys).select("line_no", "key", F.get("numbers", F.lit(0)).alias("first_number"),
                                              F.size("numbers").alias("width"))


@query("""
with r as (select n_regionkey as doc_id, lower(replace(n_name, '_', ' ')) as key, count(*) as n, round(sum(c_acctbal), 2) as b
           from customer join nation on c_nationkey = n_nationkey group by all)
select doc_id, key, 'population_total' as "column", cast(n as double) as value from r
union all select doc_id, key, 'households', b from r
union all select doc_id, key, 'density', 7.0 from r
union all select doc_id, key, 'population_male', cast(n as double) / 4 from r where doc_id % 2 = 1
union all select doc_id, key, 'population_female', 5.0 from r where doc_id % 2 = 1""")
def text_table(t: Tables) -> DataFrame:
    """A text per region: even ones have three columns, odd ones five, each under a heading of its own."""
    from .base import areas
    facts = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .groupBy("n_name", "n_nationkey", F.col("n_regionkey").alias("doc_id")).agg(
                 F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("b")))
    more = F.when(F.col("doc_id") % 2 == 1, F.concat_ws(" ", (F.col("n") / 4).cast("string"), F.lit("5")))
    text = F.concat_ws(" ", F.replace("n_name", F.lit("_"), F.lit(" ")), F.col("n").cast("string"), F.format_number("b", 2),
                       F.lit("7"), more)
    lines = facts.select("doc_id", (F.col("n_nationkey") + 2).cast("bigint").alias("line_no"), text.alias("text"))
    heading = F.when(F.col("r_regionkey") % 2 == 1, "Name Total Households Density Male Female").otherwise(
        "Name Total Households Density")
    head = t.region.select(F.col("r_regionkey").alias("doc_id"), F.lit(1).cast("bigint").alias("line_no"), heading.alias("text"))
    none = areas(t).where("false").select(F.col("county_norm").alias("subcounty_norm"))
    out = LN.parse_lines(lines.unionByName(head), areas(t), none)["county_norm"]
    return out.withColumnRenamed("county_norm", "key")


@query("""
with u as (
  select 'orders' as domain, o_custkey % 50 as area_code, o_orderkey, null as c_custkey, o_totalprice, null as c_acctbal from orders
  union all select 'customer', c_nationkey + 20, null, c_custkey, null, c_acctbal from customer)
select * from u where area_code = 30""")
def united_domains(t: Tables) -> DataFrame:
    """Orders and customers as two files of one domain folder, each with columns of its own; nations have no code."""
    orders = t.orders.select((F.col("o_custkey") % 50).alias("Area Code"), "o_orderkey", "o_totalprice")
    customers = t.customer.select((F.col("c_nationkey") + 20).cast("string").alias("area_code"), "c_custkey", "c_acctbal")
    out = S.union_domains({"orders": orders, "customer": customers, "nation": t.nation}, 30)
    return out.withColumn("area_code", F.col("area_code").cast("bigint"))


@query("""
with k as (select 'k' || event_type as key, upper(event_type) as layer from (select distinct event_type from events)),
s as (select distinct 'K ' || event_type || '-' || user_id % 3 as source from events)
select source, coalesce((select layer from k where starts_with(lower(replace(replace(source, ' ', ''), '-', '')), replace(key, '_', ''))
  order by length(key) desc limit 1), 'core') as layer from s""")
def routed_layers(t: Tables) -> DataFrame:
    kinds = t.events.select("event_type").distinct()
    registry = kinds.select(F.concat(F.lit("k"), "event_type").alias("key"), F.upper("event_type").alias("layer"))
    return S.route_layers(t.events.select(F.concat(F.lit("K "), "event_type", F.lit("-"), (F.col("user_id") % 3).cast("string"))
                                          .alias("source")), registry)


@query("""
select cast(10000 + p_partkey % 90000 as varchar) as food_code, lpad(cast(p_partkey // 50 % 90 + 10 as varchar), 2, '0') || ' ' || p_group as food_group,
  p_name as food_name, p_size::double as edible_factor, case when p_partkey % 4 <> 0 then p_retailprice end as energy_kj
from (select *, first_value(p_type) over (partition by p_partkey // 50 order by p_partkey) as p_group from part) q""")
def composition_rows(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    group = F.floor(k / 50)
    heads = t.part.groupBy(group.alias("g")).agg(F.min_by("p_type", "p_partkey").alias("p_type"))
    def cell(col, text):
        return F.struct(F.lit(col).cast("int").alias("col_no"), text.cast("string").alias("text"))

    place = lambda g, row: [F.floor(g / 1800).alias("doc_id"), g.cast("int").alias("page"), F.lit(0).alias("table_no"), row.cast("int").alias("row_no")]
    top = heads.select(*place(F.col("g"), F.lit(0)), F.explode(F.array(
        cell(0, F.lpad((F.col("g") % 90 + 10).cast("string"), 2, "0")), cell(1, F.col("p_type")))).alias("c"))
    rows = t.part.select(*place(group, k % 50 + 1), F.explode(F.array(
        cell(0, (k % 90000 + 10000).cast("string")), cell(1, F.replace("p_name", F.lit(" "), F.lit("\n"))), cell(2, F.col("p_size")),
        cell(3, F.when(k % 4 == 0, F.lit("nd")).otherwise(F.format_number("p_retailprice", 2))))).alias("c"))
    cells = top.unionByName(rows).select("doc_id", "page", "table_no", "row_no", "c.*")
    pages = heads.select(F.floor(F.col("g") / 1800).alias("doc_id"), F.col("g").cast("int").alias("page"),
                         F.lit("Code Energy Protein Water").alias("head"))
    out = C.composition_rows(cells, pages)["proximates"]
    return out.select("food_code", "food_group", "food_name", "edible_factor", "energy_kj")


@query("""
with o as (select c_nationkey as n, sum(o_totalprice) as alloc, sum(case when o_orderstatus = 'F' then o_totalprice else 0 end) as spent
  from orders join customer on o_custkey = c_custkey group by all)
select 'cob' as doc_id, 'Nation ' || chr(cast(65 + n as int)) as county,
  round(case when alloc > 1000000 then round(alloc, 2) / 1000000 else round(alloc, 2) end, 2) as ag_budget_alloc_kes_m,
  round(case when spent > 1000000 then round(spent, 2) / 1000000 else round(spent, 2) end, 2) as ag_expenditure_kes_m
from o where n % 3 = 0""")
def department_rows(t: Tables) -> DataFrame:
    sums = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n")).agg(
        F.sum("o_totalprice").alias("alloc"),
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)).alias("spent")))
    def cell(row, col, text):
        return F.struct(F.lit(row).cast("int").alias("row_no"), F.lit(col).cast("int").alias("col_no"), text.cast("string").alias("text"))

    money = lambda c: F.replace(F.format_number(c, 2), F.lit(" "), F.lit(""))
    cells = sums.select(F.lit("cob").alias("doc_id"), F.col("n").alias("page"), F.lit(0).alias("table_no"), F.explode(F.array(
        cell(0, 0, F.lit("Health")), cell(0, 1, F.lit("5")), cell(0, 2, F.lit("6")),
        cell(1, 0, F.lit(" Agriculture and livestock")), cell(1, 1, money("alloc")), cell(1, 2, money("spent")),
        cell(2, 0, F.lit("Agric. again")), cell(2, 1, F.lit("1 2")))).alias("c")).select("doc_id", "page", "table_no", "c.*")
    heading = F.when(F.col("n") % 3 == 0, F.concat(F.lit("Budget of the "), F.lit("\nNation "), F.char(65 + F.col("n")), F.lit(" County in brief")))
    pages = sums.select(F.lit("cob").alias("doc_id"), F.col("n").alias("page"), F.coalesce(heading, F.lit("continued")).alias("text"))
    return C.department_rows(cells, pages)


# cells of six files whose columns differ in type from file to file
_CELLS = """
with o as (select 'f' || o_orderkey % 6 as file, o_orderkey as k, o_custkey % 40 = 7 as odd, strftime(o_orderdate, '%Y-%m-%d') as day from orders),
cells as (
  select file, 'a' as "column", case when file = 'f1' and odd then k || '.5' else k || '' end as value from o union all
  select file, 'b', case when odd and file = 'f2' then 'soon' when odd and file = 'f3' then '12' else day end from o union all
  select file, 'c', case file when 'f4' then 'NA' when 'f5' then '1e5' else ' 7 ' end from o union all
  select file, 'd', case file when 'f0' then '2021-02-30' when 'f3' then null else '2021-02-28' end from o union all
  select file, 'e', k || '0000000000000000000' from o),
coded as (
  select file, "column", case when value is null or lower(trim(value)) in ('', 'na', 'n/a', 'nan', 'null', 'none') then 0
      when regexp_matches(trim(value), '^[+-]?[0-9]{1,18}$') then 1
      when regexp_matches(trim(value), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]{1,3})?$') then 2
      when regexp_matches(trim(value), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') and try_cast(trim(value) as date) is not null then 4 else 8 end as c from cells)
"""
_TYPE = "case when bit_or(c) = 0 then 'null' when bit_or(c) & 8 > 0 or (bit_or(c) & 3 > 0 and bit_or(c) & 4 > 0) then 'string' when bit_or(c) & 4 > 0 then 'date' when bit_or(c) & 2 > 0 then 'double' else 'long' end"


def _cells(t: Tables) -> DataFrame:
    file, odd = F.concat(F.lit("f"), F.col("o_orderkey") % 6), F.col("o_custkey") % 40 == 7
    key = F.col("o_orderkey").cast("string")
    return t.orders.select(
        file.alias("file"), F.when((file == "f1") & odd, F.concat(key, F.lit(".5"))).otherwise(key).alias("a"),
        F.when(odd & (file == "f2"), "soon").when(odd & (file == "f3"), "12").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("b"),
        F.when(file == "f4", "NA").when(file == "f5", "1e5").otherwise(" 7 ").alias("c"),
        F.when(file == "f0", "2021-02-30").when(file != "f3", "2021-02-28").alias("d"), F.concat(key, F.lit("0" * 19)).alias("e"))


@query(_CELLS + f"""select file, "column", {_TYPE} as type, count(*) filter (c > 0) as n_filled from coded group by file, "column" """)
def inferred_types_by_file(t: Tables) -> DataFrame:
    return IN.long_types(_cells(t).unpivot(["file"], list("abcde"), "column", "value"), ["file", "column"])


@query(_CELLS + f"""select "column", {_TYPE} as type, count(*) filter (c > 0) as n_filled from coded group by "column" """)
def inferred_types(t: Tables) -> DataFrame:
    return IN.column_types(_cells(t), list("abcde"))


# stems of raster files: a known nutrient's with differing signs, or a part's name
_STEMS = """select p_partkey, case p_partkey % 5 {0} else p_name end as stem from part"""
_KNOWN = [n.replace("_", sign) for n, sign in zip(P.RASTER_NAMES, ("_", " ", "-", "__"))]
_SLUG = r"regexp_replace(regexp_replace(regexp_replace(lower(stem), '^isda_', ''), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""
with s as ({_STEMS.format(" ".join(f"when {i} then '{'iSDA_' if i % 2 else ''}{n.title()} '" for i, n in enumerate(_KNOWN)))}),
g as (select *, {_SLUG} as slug from s)
select p_partkey, stem, case slug {" ".join(f"when '{k}' then '{v}'" for k, v in P.RASTER_NAMES.items())} else case when slug like '%isda' then slug else slug || '_isda' end end as "column" from g""")
def raster_column_names(t: Tables) -> DataFrame:
    stem = F.col("p_name")
    for i, n in enumerate(_KNOWN):
        stem = F.when(F.col("p_partkey") % 5 == i, F.lit(f"{'iSDA_' if i % 2 else ''}{n.title()} ")).otherwise(stem)
    return S.raster_columns(t.part.select("p_partkey", stem.alias("stem")))


@query("""
with c as (select 'K' || s_suppkey as code, n_name as name, case when s_suppkey % 9 = 0 then '' when s_suppkey % 10 = 3 then null else lower(n_name) end as norm
  from supplier join nation on s_nationkey = n_nationkey)
select min(code) as county_code, arg_min(name, code) as county_name, norm as county_norm from c where norm <> '' group by norm""")
def area_list(t: Tables) -> DataFrame:
    crosswalk = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("K"), "s_suppkey").alias("county_code"), F.col("n_name").alias("county_name"),
        F.when(F.col("s_suppkey") % 9 == 0, "").when(F.col("s_suppkey") % 10 != 3, F.lower("n_name")).alias("county_norm"))
    return K.area_frame(crosswalk, t.spark)
