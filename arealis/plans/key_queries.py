"""Keys, crosswalk, joins, filters and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import joins as J
from ..operators import keys as K
from ..operators import ledger as L
from ..operators import quality as Q
from .base import AREAS, SUPPLIED, Tables, areas, query, rounded, sql_key, supplied

# customers' nation names as a survey would spell them
_MESSY = """select c_custkey, case c_custkey % 5 when 0 then '  ' || replace(n_name, '_', ' ') when 1 then lower(n_name)
    when 2 then replace(n_name, '_', '--') || '.' when 3 then 'Unknown ' || n_name else null end as admin1, c_mktsegment, c_acctbal
  from customer join nation on c_nationkey = n_nationkey"""


def _messy(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 5
    name = (F.when(k == 0, F.concat(F.lit("  "), F.replace("n_name", F.lit("_"), F.lit(" "))))
            .when(k == 1, F.lower("n_name"))
            .when(k == 2, F.concat(F.replace("n_name", F.lit("_"), F.lit("--")), F.lit(".")))
            .when(k == 3, F.concat(F.lit("Unknown "), "n_name")))
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", name.alias("admin1"), "c_mktsegment", "c_acctbal")


@query(f"""
select page_id, {sql_key('url')} as name_key, regexp_replace(lower(url), '[^0-9a-z]+', '', 'g') as tight_key,
  regexp_replace(regexp_replace(lower(url), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from pages""")
def name_keys(t: Tables) -> DataFrame:
    return t.pages.select("page_id", TX.name_key("url").alias("name_key"), TX.tight_key("url").alias("tight_key"),
                          TX.slug("url").alias("slug"))


@query("""
select doc_id, md5(translate(text, '’‘–—', '''''--')) as plain from documents""")
def plain_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(TX.plain_text("text")).alias("plain"))


_ANCHORS = ["the  The", "Of the", "que la", "and an", "und der", "xyzzy"]


@query(r"""
with d as (select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) as f from documents)
select doc_id, array_to_string(list_filter(['the  The', 'Of the', 'que la', 'and an', 'und der', 'xyzzy'],
    lambda a: not contains(f, regexp_replace(lower(a), '\s+', ' ', 'g'))), '|') as missing from d""")
def anchor_check(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(TX.missing_anchors("text", _ANCHORS), "|").alias("missing"))


@query(f"""
select c_custkey, trim(admin1) as admin1, county_code, county_name from ({_MESSY}) m
left join ({AREAS}) a on {sql_key('admin1')} = county_norm""")
def attach_area(t: Tables) -> DataFrame:
    return K.attach_area(_messy(t), areas(t), "admin1").select(
        "c_custkey", F.trim("admin1").alias("admin1"), "county_code", "county_name")


_MESSY_COLUMNS = ("c_custkey", "admin1", "c_mktsegment", "c_acctbal")
_HITS = f"""with cells as ({" union all ".join(
    f"select {i} as place, '{c}' as name, {sql_key(c)} as value from ({_MESSY}) m" for i, c in enumerate(_MESSY_COLUMNS))}),
hits as (select place, name, count(*) filter (value in (select county_norm from ({AREAS}) a)) as hits, count(*) as filled
         from cells where value <> '' group by all)"""


@query(f"""{_HITS} select name as "column", hits, filled from hits""")
def key_column_hits(t: Tables) -> DataFrame:
    return K.key_hits(_messy(t), areas(t), "county_norm")


@query(f"""{_HITS}, best as (
  select name, 0.5 as least from hits where hits > 0 and hits >= floor(filled * 0.5) order by hits desc, place limit 1)
select 0.5::double as share, (select name from best) as key_column
union all select 0.9::double, (select name from hits where hits > 0 and hits >= floor(filled * 0.9) order by hits desc, place limit 1)""")
def detected_key_column(t: Tables) -> DataFrame:
    """The column found with half of its cells matching, and with nine tenths, which none reaches."""
    found = [(s, K.detect_key_column(_messy(t), areas(t), share=s)) for s in (0.5, 0.9)]
    return t.region.limit(1).select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("share"), F.lit(c).cast("string").alias("key_column")) for s, c in found])).alias("r")).select("r.*")


@query("""
select upper(r_name) as county_name, 'R' || r_regionkey as county_code, lower(r_name) as county_norm,
  c_name as subcounty_name, 'C' || c_custkey as subcounty_code, lower(replace(c_name, '#', ' ')) as subcounty_norm,
  'subarea layer' as source
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def crosswalk_build(t: Tables) -> DataFrame:
    layer = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
             .select(F.upper("r_name").alias("ADM1_EN"), F.concat(F.lit("R"), "r_regionkey").alias("ADM1_PCODE"),
                     F.col("c_name").alias("ADM2_EN"), F.concat(F.lit("C"), "c_custkey").alias("ADM2_PCODE")))
    return K.build_crosswalk(t.spark, subareas=layer)


_BANDS = {"adm1": (20, 400, 130), "adm2": (401, 5000, 1500), "adm3": (900_000_000, 1_000_000_000, 950_000_000)}


@query("""
with layers as (
  select 'by size ' || p_size as layer, count(*) as n_features from part group by p_size
  union all select 'copy of ' || p_size, count(*) from part group by p_size
  union all select 'by clerk ' || o_custkey % 3, count(*) from orders group by all),
bands as (select * from (values """ + ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in _BANDS.items()) + """) v(level, low, high, target))
select level, layer, n_features from layers join bands on n_features between low and high
qualify row_number() over (partition by level order by abs(n_features - target), layer) = 1""")
def layer_choice(t: Tables) -> DataFrame:
    """Levels with a nearest layer, ties between copies, and a level that no layer fits."""
    layers = (t.part.select(F.explode(F.array(F.concat(F.lit("by size "), "p_size"), F.concat(F.lit("copy of "), "p_size"))).alias("layer"))
              .unionByName(t.orders.select(F.concat(F.lit("by clerk "), (F.col("o_custkey") % 3).cast("string")).alias("layer"))))
    return K.classify_layers(layers, "layer", _BANDS)


@query("""
with l as (select case c_custkey % 3 when 0 then 'v024' when 1 then 'county' else 'other' end as variable,
    case when c_custkey % 3 = 1 and c_nationkey > 10 then 'x' else n_name end as label
  from customer join nation on c_nationkey = n_nationkey)
select variable, count(distinct label) as hits from l where variable in ('v024', 'county') and label <> 'x' group by variable
order by hits desc, variable desc limit 1""")
def label_variable(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 3
    labels = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.when(k == 0, "v024").when(k == 1, "county").otherwise("other").alias("variable"),
        F.col("c_custkey").cast("int").alias("code"),
        F.when((k == 1) & (F.col("c_nationkey") > 10), "x").otherwise(F.col("n_name")).alias("label"))
    return K.detect_label_variable(labels, areas(t), min_hits=5)


@query("""
select coalesce(a.k, b.k) as k, round(coalesce(a.v, b.v), 2) as v, a.n_a, b.n_b from
 (select s_nationkey as k, sum(s_acctbal) as v, count(*) as n_a from supplier group by all) a full join
 (select c_nationkey as k, sum(c_acctbal) as v, count(*) as n_b from customer where c_nationkey > 3 group by all) b on a.k = b.k""")
def merge_measures(t: Tables) -> DataFrame:
    a = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("v"), F.count(F.lit(1)).alias("n_a"))
    b = t.customer.where(F.col("c_nationkey") > 3).groupBy(F.col("c_nationkey").alias("k")).agg(
        F.sum("c_acctbal").alias("v"), F.count(F.lit(1)).alias("n_b"))
    return J.merge_coalesce([a, b], "k").withColumn("v", F.round("v", 2))


@query("""
with b as (select p_name as food_code, p_type as food_group, p_brand as food_name, p_size, p_partkey,
    case p_partkey % 3 when 0 then 'a' when 1 then 'b' else 'c' end as block from part),
f as (select *, row_number() over (partition by block, food_code order by p_partkey) as r from b),
g as (select * from f where r = 1)
select food_code, coalesce(x.food_group, y.food_group, z.food_group) as food_group,
  coalesce(x.food_name, y.food_name, z.food_name) as food_name, x.p_size as size_a, y.p_size as size_b, z.p_size as size_c
from (select * from g where block = 'a') x full join (select * from g where block = 'b') y using (food_code)
  full join (select * from g where block = 'c') z using (food_code)""")
def merge_food_blocks(t: Tables) -> DataFrame:
    def block(i: int, name: str) -> DataFrame:
        return t.part.where(F.col("p_partkey") % 3 == i).select(
            F.col("p_name").alias("food_code"), F.col("p_type").alias("food_group"), F.col("p_brand").alias("food_name"),
            F.col("p_size").alias(name), F.col("p_partkey").alias("ordinal"))

    return J.merge_blocks({n: block(i, f"size_{n}") for i, n in enumerate("abc")})


@query("""
select l_orderkey, l_linenumber, l_suppkey, s_name from (select * from supplier where s_suppkey % 2 = 0) s
right join lineitem on s_suppkey = l_suppkey""")
def keep_facts(t: Tables) -> DataFrame:
    dim = t.supplier.where(F.col("s_suppkey") % 2 == 0).withColumnRenamed("s_suppkey", "l_suppkey")
    return J.keep_facts(dim.select("l_suppkey", "s_name"), t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"),
                        "l_suppkey")


@query(f"""
select side, count(*) as n, round(sum(c_acctbal), 2) as balance from (
  select case when {sql_key('admin1')} in (select county_norm from ({AREAS}) a) then 'in' else 'out' end as side, c_acctbal
  from ({_MESSY}) m where admin1 is not null) q group by side""")
def membership(t: Tables) -> DataFrame:
    rows, keys = _messy(t), areas(t)
    both = J.members(rows, keys, "admin1", "county_norm").select(F.lit("in").alias("side"), "c_acctbal").unionByName(
        J.strangers(rows, keys, "admin1", "county_norm").select(F.lit("out").alias("side"), "c_acctbal"))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("c_acctbal"), 2, "balance"))


@query("""
select vec_id from (select vec_id, embedding[1]::double * 400 as lat, embedding[2]::double * 800 as lon from embeddings) q
where lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)""")
def valid_points(t: Tables) -> DataFrame:
    e = F.col("embedding")
    pts = t.embeddings.select("vec_id", (e[0].cast("double") * 400).alias("lat"), (e[1].cast("double") * 800).alias("lon"))
    return J.valid_points(pts, "lat", "lon", drop_origin=True).select("vec_id")


@query("""
select p_type, count(*) as n from part where contains(lower(p_name), 'ring') and contains(lower(p_type), 'mo')
  and upper(p_brand) = 'BRAND#7' group by p_type""")
def word_filters(t: Tables) -> DataFrame:
    rows = J.contains_word(t.part, {"p_name": "Ring", "P_TYPE": "MO", "absent": "x"})
    return J.equals_ignoring_case(rows, "p_brand", "brand#7").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("""select p_partkey, p_name from part""")
def pruned_columns(t: Tables) -> DataFrame:
    wide = t.part.select("p_partkey", "p_name", F.when(F.col("p_size") > 10_000, F.lit(1)).alias("hollow"))
    return J.drop_empty(J.present(wide, ["p_partkey", "p_name", "hollow", "absent"]), ["hollow"])


@query("""
select status, message, count(*) as n from (select case when lang in ('en', 'de') then 'selected' else 'skipped' end as status,
  case when lang in ('en', 'de') then null else 'only_open: access=' || lang end as message from documents) q group by all""")
def source_gate(t: Tables) -> DataFrame:
    reg = t.documents.select(F.col("lang").alias("access"), F.col("source").alias("source_key"))
    return L.gate_sources(reg, ("en", "de")).groupBy("status", "message").agg(F.count(F.lit(1)).alias("n"))


# --- audits ----------------------------------------------------------------------------------
@query("""
with x as (select r_name as k, n_name as s from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
p as (select k, s, count(*) as n from x group by all),
g as (select count(distinct k) as a, count(distinct s) as b, count(case when n > 1 then 1 end) as d from p)
select 'core' as layer, case when a = 5 then 'PASS' else 'WARN' end as status, 'distinct areas' as label, a || ' (expected 5)' as detail from g
union all select 'core', case when b between 20 and 30 then 'PASS' else 'WARN' end, 'distinct sub-areas', cast(b as varchar) from g
union all select 'core', case when d = 0 then 'PASS' else 'FAIL' end, 'repeated keys', cast(d as varchar) from g""")
def key_integrity(t: Tables) -> DataFrame:
    rows = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("r_name").alias("county_norm"), F.col("n_name").alias("subcounty_norm")))
    return Q.key_integrity(rows, expected=5, band=(20, 30))


_COVER = f"""with m as ({_MESSY}), k as (select county_norm from ({AREAS}) a),
g as (select count(*) as total, count(case when {sql_key('admin1')} in (select county_norm from k) then 1 end) as hit from m where admin1 is not null)"""


@query(f"""{_COVER} select total, hit as matched, round(100.0 * hit / total, 6) as pct from g""")
def coverage_share(t: Tables) -> DataFrame:
    return Q.coverage_stats(_messy(t), areas(t), "admin1", "county_norm").withColumn("pct", F.round("pct", 6))


@query(f"""{_COVER},
u as (select admin1 as name, count(*) as n from m where admin1 is not null and {sql_key('admin1')} not in (select county_norm from k) group by 1)
select 'food' as layer, case when 100.0 * hit / total >= 99 then 'PASS' when 100.0 * hit / total >= 80 then 'WARN' else 'FAIL' end as status,
  'customers join coverage' as label, round(100.0 * hit / total, 1) || '% of rows match (admin1)' as detail from g
union all select 'food', 'INFO', 'customers unmatched names', (select count(*) || ' in ' || cast(sum(n) as bigint) || ' rows' from u)""")
def join_coverage(t: Tables) -> DataFrame:
    return Q.join_coverage("customers", _messy(t), areas(t), "food")


@query(f"""
select admin1 as name, count(*) as n from ({_MESSY}) m where admin1 is not null
  and {sql_key('admin1')} not in (select county_norm from ({AREAS}) a) group by 1""")
def unmatched_names(t: Tables) -> DataFrame:
    return Q.unmatched_names(_messy(t), areas(t), "admin1", "county_norm")


@query(f"""
select 'c_custkey' as "column", 0::bigint as n_null union all
select 'admin1', count(*) filter (admin1 is null) from ({_MESSY}) m union all
select 'c_mktsegment', count(*) filter (c_mktsegment is null) from ({_MESSY}) m union all
select 'c_acctbal', count(*) filter (c_acctbal is null) from ({_MESSY}) m""")
def null_counts(t: Tables) -> DataFrame:
    return Q.null_counts(_messy(t))


@query(f"""
with m as ({_MESSY})
select 'food' as layer, case when count(*) = 1500 then 'PASS' else 'WARN' end as status, 'customers rows' as label, cast(count(*) as varchar) as detail from m
union all select 'food', 'INFO', 'customers measures', '3'
union all select 'food', 'WARN', 'customers null cells', '1 columns'
union all select 'food', 'WARN', 'customers.admin1 null cells', cast(count(*) as varchar) from m where admin1 is null""")
def null_audit(t: Tables) -> DataFrame:
    return Q.null_audit("customers", _messy(t), "food", ("c_custkey",), 1500)


@query("""
select 'food' as layer, 'FAIL' as status, 'rows of other areas' as label, cast(count(*) as varchar) as detail from orders where o_orderstatus <> 'F'
union all select 'food', 'FAIL', 'other area ' || o_orderstatus, count(*) || ' rows' from orders where o_orderstatus <> 'F' group by o_orderstatus
union all select 'food', 'INFO', 'domain ' || o_orderpriority, count(*) || ' rows' from orders group by o_orderpriority
union all select 'food', 'INFO', 'year span', min(year(o_orderdate)) || '-' || max(year(o_orderdate)) from orders
union all select 'food', case when count(*) filter (not (o_totalprice > 1000)) = 0 then 'PASS' else 'WARN' end, 'null values',
  count(*) filter (not (o_totalprice > 1000)) || ' of ' || count(*) from orders""")
def balance_checks(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderstatus").alias("area"), F.col("o_orderpriority").alias("domain"),
                           F.year("o_orderdate").alias("year"),
                           F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("value"))
    return Q.balance_checks(rows, "food", "F")


@query(f"""
with m as ({_MESSY})
select 'food' as layer, 'INFO' as status, 'price rows' as label, cast(count(*) as varchar) as detail from m
union all select 'food', 'INFO', 'date span', min(c_custkey) || ' to ' || max(c_custkey) from m
union all select 'food', case when count(*) = 0 then 'PASS' else 'WARN' end, 'prices that are not numbers', cast(count(*) as varchar) from m where c_custkey % 50 = 0
union all select 'food', 'INFO', 'areas with prices', (select count(distinct {sql_key('admin1')}) from m where {sql_key('admin1')} in (select county_norm from ({AREAS}) a))
  || ' of ' || (select count(distinct admin1) from m) || ' distinct'""")
def price_checks(t: Tables) -> DataFrame:
    price = F.when(F.col("c_custkey") % 50 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    rows = _messy(t).withColumns({"price": price, "date": F.col("c_custkey")})
    return Q.price_checks(rows, "food", areas(t), "county_norm")


@query("""
select 'health' as layer, 'INFO' as status, 'indicator ' || event_type as label, count(*) || ' rows' as detail from events group by event_type
union all select 'health', 'INFO', 'year span', min(year(ts)) || '-' || max(year(ts)) from events""")
def indicator_checks(t: Tables) -> DataFrame:
    return Q.indicator_checks(t.events.select(F.col("event_type").alias("indicator"), F.year("ts").alias("year")), "health")


_READY = """
select 'soil' as layer, case when (select count(*) from nation) = 25 then 'PASS' else 'WARN' end as status, 'nation' as label, (select count(*) from nation) || ' rows' as detail
union all select 'soil', case when (select count(n_name) from nation) >= 25 then 'PASS' else 'WARN' end, 'nation.n_name', (select count(n_name) from nation) || '/25 filled'
union all select 'soil', 'FAIL', 'nation.absent', 'column absent'
union all select 'soil', 'PASS', 'lineitem', (select count(*) from lineitem) || ' rows'
union all select 'soil', 'WARN', 'lineitem.l_returnflag distinct', cast(count(distinct l_returnflag) as varchar) from lineitem
union all select 'soil', 'WARN', 'missing_table', 'missing'
union all select 'soil', 'INFO', 'other_table', 'not built (optional)'"""


def _ready(t: Tables) -> DataFrame:
    rules = [{"table": "nation", "expect": 25, "columns": ["n_name", "absent"]},
             {"table": "lineitem", "distinct": ("l_returnflag", 4)},
             {"table": "missing_table", "essential": False}, {"table": "other_table", "optional": True}]
    return Q.readiness({"nation": t.nation, "lineitem": t.lineitem}, rules, "soil", t.spark)


@query(_READY)
def layer_readiness(t: Tables) -> DataFrame:
    return _ready(t)


@query(f"""
with f as ({_READY} union all select 'food', 'PASS', 'orders', 'x' union all select 'food', 'INFO', 'orders', 'x' union all select 'policy', 'INFO', 'x', 'x')
select layer, case when bool_or(status = 'FAIL') then 'FAIL' when bool_or(status = 'WARN') then 'WARN' when bool_or(status = 'PASS') then 'PASS' else 'SKIP' end as verdict,
  count(*) filter (status = 'PASS') as n_pass, count(*) filter (status = 'WARN') as n_warn, count(*) filter (status = 'FAIL') as n_fail,
  count(*) filter (status = 'INFO') as n_info, count(*) filter (status = 'SKIP') as n_skip from f group by layer""")
def audit_verdicts(t: Tables) -> DataFrame:
    extra = Q.findings_from(t.orders.agg(F.count(F.lit(1)).alias("n")), [
        Q.finding("food", Q.graded(F.col("n") > 0), "orders", "x"), Q.finding("food", "INFO", "orders", "x"),
        Q.finding("policy", "INFO", "x", "x")])
    return Q.verdicts(Q.all_findings([_ready(t), extra]))


# --- ledger ------------------------------------------------------------------------------------
_LEDGER = """select 'r' || doc_id % 3 as run_id, lang as layer, source as source_key,
  case when n_chars % 4 = 0 then 'failed' when n_chars % 4 = 1 then 'manual' else 'ok' end as status, n_chars as bytes from documents"""


def _ledger(t: Tables) -> DataFrame:
    m = F.col("n_chars") % 4
    return L.as_ledger(t.documents.select(
        F.concat(F.lit("r"), F.col("doc_id") % 3).alias("run_id"), F.col("lang").alias("layer"),
        F.col("source").alias("source_key"), F.when(m == 0, "failed").when(m == 1, "manual").otherwise("ok").alias("status"),
        F.col("n_chars").alias("bytes")))


_CURRENT = """select source as source_key, last(case when doc_id % 2 = 0 then md5(text) end order by doc_id) as sha256,
  last(n_chars order by doc_id) as bytes, last(n_chars % 9 order by doc_id) as pages from documents where source < 'src15' group by source"""


def _sidecars(t: Tables) -> DataFrame:
    d = t.documents.where(F.col("source") < "src15")
    none = F.lit(None)
    return d.select(
        F.format_string("%020d", "doc_id").alias("path"), F.col("source").alias("source_key"),
        F.when(F.col("doc_id") % 2 == 0, F.md5("text")).alias("sha256"), F.col("n_chars").alias("bytes"),
        (F.col("n_chars") % 9).alias("pages"), F.lit(14).cast("bigint").alias("verification_anchors"),
        F.array(F.lit("a.csv"), F.lit("b.csv")).alias("csv_outputs"), F.array(F.lit("x")).alias("anchors_missing"),
        *[none.cast("string").alias(c) for c in ("layer", "title", "publisher", "access", "license", "pdf_path", "url",
                                                 "message", "extracted_at")])


@query(f"""
with c as ({_CURRENT}), l as ({_LEDGER})
select run_id, layer, source_key, status, bytes, null as sha256, null as message from l where source_key not in (select source_key from c)
union all
select 'local', 'core', source_key, case when sha256 is not null then 'ok' else 'manual' end, bytes, sha256,
  'local extract: ' || pages || ' pages, 2 CSV tables, anchors 13/14 verified' from c""")
def ledger_upsert(t: Tables) -> DataFrame:
    out = L.upsert(_ledger(t), L.sidecar_rows(_sidecars(t)))
    return out.select("run_id", "layer", "source_key", "status", "bytes", "sha256", "message")


@query(f"""select layer, status, count(*) as n from ({_LEDGER}) l group by all""")
def status_rollup(t: Tables) -> DataFrame:
    return L.status_counts(_ledger(t), ("layer",))


@query(f"""select distinct source_key from ({_LEDGER}) l where status = 'failed'""")
def failed_sources(t: Tables) -> DataFrame:
    return L.keys_with_status(_ledger(t), "failed")


@query(f"""
select n_name, round_even(avg(l_extendedprice), 1) as price, count(*) as n from ({SUPPLIED}) x group by n_name""")
def published_rounding(t: Tables) -> DataFrame:
    rows = supplied(t).groupBy("n_name").agg(F.avg("l_extendedprice").alias("price"), F.count(F.lit(1)).alias("n"))
    return L.rounded(rows, {"price": 1})
