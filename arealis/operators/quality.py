"""Findings tables: key integrity, join coverage, null cells, domains and readiness.

Every check turns one aggregate per table into rows (layer, status, label, detail); statuses
are PASS, WARN, FAIL, INFO and SKIP.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import presets as P
from ..functions.text import name_key

FINDING = "layer string, status string, label string, detail string"


def finding(layer: str, status: str | Column, label: str | Column, detail: str | Column) -> Column:
    def lit(c):
        return c if isinstance(c, Column) else F.lit(c)

    return F.struct(F.lit(layer).alias("layer"), lit(status).alias("status"),
                    lit(label).alias("label"), lit(detail).alias("detail"))


def findings_from(stats: DataFrame, rules: list[Column]) -> DataFrame:
    """Rows of findings from a one-row table of statistics."""
    return stats.select(F.explode(F.array(*rules)).alias("f")).select("f.*")


def fixed_findings(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, FINDING)


def all_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def graded(ok: Column, otherwise: str = "WARN") -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise(otherwise)


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def verdicts(findings: DataFrame) -> DataFrame:
    """Worst status of each layer with counts: FAIL over WARN over PASS over SKIP."""
    rank = F.create_map(*[F.lit(x) for kv in P.STATUS_RANK.items() for x in kv])[F.col("status")]
    worst = F.max(rank)
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s.lower()}")
              for s in ("PASS", "WARN", "FAIL", "INFO", "SKIP")]
    verdict = F.when(worst == 3, "FAIL").when(worst == 2, "WARN").when(worst == 1, "PASS").otherwise("SKIP")
    return findings.groupBy("layer").agg(verdict.alias("verdict"), *counts)


def passes_gate(findings: DataFrame) -> bool:
    return findings.where(F.col("status") == "FAIL").isEmpty()


def key_integrity(crosswalk: DataFrame, layer: str = "core", expected: int = P.EXPECTED_AREAS,
                  band: tuple[int, int] = P.SUBAREA_BAND, key: str = "county_norm",
                  sub: str = "subcounty_norm") -> DataFrame:
    """Distinct areas, sub-areas within their band, and repeated keys."""
    named_sub = F.coalesce(F.col(sub), F.lit("")) != ""
    pairs = crosswalk.groupBy(key, sub).agg(F.count(F.lit(1)).alias("n"))
    stats = pairs.agg(
        F.countDistinct(F.when(F.col(key) != "", F.col(key))).alias("areas"),
        F.countDistinct(F.when(named_sub, F.col(sub))).alias("subs"),
        F.count(F.when(F.col("n") > 1, 1)).alias("dups"))
    subs = F.when(F.col("subs") == 0, "WARN").otherwise(graded(F.col("subs").between(*band)))
    return findings_from(stats, [
        finding(layer, graded(F.col("areas") == expected), "distinct areas",
                text(F.col("areas"), " (expected ", expected, ")")),
        finding(layer, subs, "distinct sub-areas", text(F.col("subs"))),
        finding(layer, graded(F.col("dups") == 0, "FAIL"), "repeated keys", text(F.col("dups")))])


def coverage_stats(df: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """(total, matched, pct) of a column against the keys.

    Values are counted first, so the join sees each distinct value once.
    """
    values = (df.where(F.col(column).isNotNull()).groupBy(name_key(column).alias("__k"))
              .agg(F.count(F.lit(1)).alias("n")))
    known = keys.select(F.col(key).alias("__k")).where("__k <> ''").distinct().withColumn("hit", F.lit(1))
    return values.join(known, "__k", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("matched")
    ).withColumn("pct", F.when(F.col("total") > 0, 100.0 * F.col("matched") / F.col("total")))


def hinted_column(columns: list[str], hints=P.AREA_COLUMN_HINTS) -> str | None:
    low = {c.lower(): c for c in columns}
    return next((low[h] for h in hints if h in low), None)


def join_coverage(table: str, df: DataFrame, keys: DataFrame, layer: str, column: str | None = None,
                  key: str = "county_norm", passing: float = 99.0, warning: float = 80.0) -> DataFrame | None:
    """Share of named rows that match a key, and how many names do not; ``unmatched_names`` lists them."""
    column = column or hinted_column(df.columns)
    if column is None:
        return None
    stats = coverage_stats(df, keys, column, key).where(F.col("total") > 0)
    status = (F.when(F.col("pct") >= passing, "PASS").when(F.col("pct") >= warning, "WARN").otherwise("FAIL"))
    main = findings_from(stats, [finding(layer, status, f"{table} join coverage",
                                         text(F.round("pct", 1), "% of rows match (", column, ")"))])
    names = unmatched_names(df, keys, column, key).agg(
        F.count(F.lit(1)).alias("names"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).where("names > 0")
    return main.unionByName(findings_from(names, [
        finding(layer, "INFO", f"{table} unmatched names", text(F.col("names"), " in ", F.col("rows"), " rows"))]))


def unmatched_names(df: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """``(name, n)``: every name that matches no key, with its rows."""
    known = keys.select(F.col(key).alias("__k")).where("__k <> ''").distinct()
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("name"))
            .agg(F.count(F.lit(1)).alias("n")).withColumn("__k", name_key("name")).join(known, "__k", "left_anti")
            .select("name", "n"))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_null) for all columns from one aggregate."""
    columns = columns or df.columns
    one = df.agg(*[(F.count(F.lit(1)) - F.count(c)).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "n_null")

def null_audit(table: str, df: DataFrame, layer: str, keys: tuple[str, ...], expected: int) -> DataFrame:
    """Row count, number of measures and a row for each column with empty cells."""
    cols = [c for c in df.columns if c not in keys]
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[(F.count(F.lit(1)) - F.count(c)).alias(c) for c in cols])
    bad = F.filter(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("k")) for c in cols]),
                   lambda x: x["k"] > 0)
    each = one.select(F.explode(bad).alias("x")).select(finding(
        layer, "WARN", F.concat(F.lit(f"{table}."), F.col("x.c"), F.lit(" null cells")), text(F.col("x.k"))).alias("f"))
    return findings_from(one, [
        finding(layer, graded(F.col("__n") == expected), f"{table} rows", text(F.col("__n"))),
        finding(layer, "INFO", f"{table} measures", str(len(cols))),
        finding(layer, graded(F.size(bad) == 0), f"{table} null cells", text(F.size(bad), " columns"))]
    ).unionByName(each.select("f.*"))


def _listed(df: DataFrame, column: str, layer: str, status: str, label: str) -> DataFrame:
    """A finding for each distinct value of a column, with its rows."""
    values = df.groupBy(F.col(column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v is not null")
    return values.select(finding(layer, status, F.concat(F.lit(f"{label} "), F.col("v")), text(F.col("n"), " rows")).alias(
        "f")).select("f.*")


def balance_checks(df: DataFrame, layer: str, expected_area: str, area="area", domain="domain",
                   year="year", value="value") -> DataFrame:
    """One area only (a row for each other one), its domains (a row each), the year span and missing values."""
    foreign = F.col(area) != expected_area
    stats = df.agg(F.count(F.when(foreign, 1)).alias("foreign"),
                   F.min(year).alias("lo"), F.max(year).alias("hi"), F.count(F.lit(1)).alias("n"),
                   (F.count(F.lit(1)) - F.count(value)).alias("nulls"))
    main = findings_from(stats, [
        finding(layer, graded(F.col("foreign") == 0, "FAIL"), "rows of other areas", text(F.col("foreign"))),
        finding(layer, "INFO", "year span", text(F.col("lo"), "-", F.col("hi"))),
        finding(layer, graded(F.col("nulls") == 0), "null values", text(F.col("nulls"), " of ", F.col("n")))])
    return all_findings([main, _listed(df.where(foreign), area, layer, "FAIL", "other area"),
                         _listed(df, domain, layer, "INFO", "domain")])


def price_checks(df: DataFrame, layer: str, keys: DataFrame, key: str, date="date", price="price",
                 admin="admin1") -> DataFrame:
    """Rows, date span, prices that are not numbers, and areas that match."""
    unread = F.col(price).isNotNull() & F.col(price).try_cast("double").isNull()
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("lo"), F.max(date).alias("hi"),
                   F.count(F.when(unread, 1)).alias("bad"))
    names = df.select(name_key(admin).alias("__k"), F.col(admin).alias("v")).where(F.col(admin).isNotNull()).distinct()
    known = keys.select(F.col(key).alias("__k")).where("__k <> ''").distinct().withColumn("hit", F.lit(1))
    overlap = names.join(known, "__k", "left").agg(
        F.countDistinct(F.when(F.col("hit") == 1, F.col("__k"))).alias("ov"), F.countDistinct("v").alias("tot"))
    return findings_from(stats, [
        finding(layer, "INFO", "price rows", text(F.col("n"))),
        finding(layer, "INFO", "date span", text(F.col("lo"), " to ", F.col("hi"))),
        finding(layer, graded(F.col("bad") == 0), "prices that are not numbers", text(F.col("bad")))]
    ).unionByName(findings_from(overlap, [
        finding(layer, "INFO", "areas with prices", text(F.col("ov"), " of ", F.col("tot"), " distinct"))]))


def indicator_checks(df: DataFrame, layer: str) -> DataFrame:
    """A row for each indicator, and the year span."""
    span = findings_from(df.agg(F.min("year").alias("lo"), F.max("year").alias("hi")), [
        finding(layer, "INFO", "year span", text(F.col("lo"), "-", F.col("hi")))])
    return span.unionByName(_listed(df, "indicator", layer, "INFO", "indicator"))


def table_check(tables: dict[str, DataFrame], name: str, layer: str, expect: int | None = None,
                essential: bool = True, spark: SparkSession | None = None) -> DataFrame:
    """The table exists and has the expected number of rows."""
    df = tables.get(name)
    if df is None:
        spark = spark or SparkSession.getActiveSession()
        return fixed_findings(spark, [(layer, "FAIL" if essential else "WARN", name, "missing")])
    stats = df.agg(F.count(F.lit(1)).alias("n"))
    ok = F.lit(True) if expect is None else F.col("n") == expect
    return findings_from(stats, [finding(layer, graded(ok), name, text(F.col("n"), " rows"))])


def coverage_check(tables: dict[str, DataFrame], name: str, columns: list[str], layer: str,
                   expect: int, essential: bool = True) -> DataFrame | None:
    """Filled cells of columns against an expected count, all columns in one aggregate."""
    df = tables.get(name)
    if df is None:
        return None
    worst = "FAIL" if essential else "WARN"
    have = [c for c in columns if c in df.columns]
    stats = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in have])
    rules = []
    for c in columns:
        if c not in have:
            rules.append(finding(layer, worst, f"{name}.{c}", "column absent"))
            continue
        status = F.when(F.col(c) >= expect, "PASS").when(F.col(c) > 0, "WARN").otherwise(worst)
        rules.append(finding(layer, status, f"{name}.{c}", text(F.col(c), "/", expect, " filled")))
    return findings_from(stats, rules)


def readiness(tables: dict[str, DataFrame], rules, layer: str, spark: SparkSession) -> DataFrame:
    """Findings of declared readiness rules; ``presets.READINESS`` has those of the five layers.

    A rule names a ``table`` with ``expect`` rows (else any), and if it is not ``essential`` a missing one only warns;
    an ``optional`` one is only noted. On a table that exists: ``columns`` with ``expect`` filled cells, ``distinct``
    (column, at least so many values), ``present`` (columns, at least so many of them). Rules with a ``label`` look
    across tables: ``prefix`` (at least so many tables whose names begin so), ``inputs`` (columns by a part of their
    name) and ``one_of`` (tables one of which has rows).
    """
    parts = []
    for r in rules:
        if "label" in r:
            parts.append(_across(tables, r, layer, spark))
            continue
        name, essential = r["table"], r.get("essential", True)
        if name not in tables:
            status, note = ("INFO", "not built (optional)") if r.get("optional") else (
                "FAIL" if essential else "WARN", "missing")
            parts.append(fixed_findings(spark, [(layer, status, name, note)]))
            continue
        df = tables[name]
        parts.append(table_check(tables, name, layer, r.get("expect"), essential, spark))
        if r.get("columns"):
            parts.append(coverage_check(tables, name, list(r["columns"]), layer, r["expect"], essential))
        if r.get("distinct"):
            col, least = r["distinct"]
            stats = df.agg(F.countDistinct(col).alias("d"))
            parts.append(findings_from(stats, [finding(
                layer, graded(F.col("d") >= least), f"{name}.{col} distinct", text(F.col("d")))]))
        if r.get("present"):
            wanted, least = r["present"]
            have = len(set(wanted) & set(df.columns))
            parts.append(fixed_findings(spark, [(layer, "PASS" if have >= least else "WARN", f"{name} columns",
                                                 f"{have}/{len(wanted)} present")]))
    return all_findings(parts)


def _across(tables: dict[str, DataFrame], rule: dict, layer: str, spark: SparkSession) -> DataFrame:
    """The finding of a rule about several tables."""
    if "prefix" in rule:
        begin, least = rule["prefix"]
        n = sum(name.startswith(begin) for name in tables)
        return fixed_findings(spark, [(layer, "PASS" if n >= least else "WARN", rule["label"], f"{n} of {least}")])
    lacking = [f"{name}.{part}" if part else name for name, stems in rule["inputs"].items() for part in (stems or ("",))
               if name not in tables or not any(part in c.lower() for c in tables[name].columns)]
    choice = [tables[t] for t in rule.get("one_of", ()) if t in tables]
    if lacking or ("one_of" in rule and not choice):
        note = ", ".join(lacking) or " or ".join(rule["one_of"])
        return fixed_findings(spark, [(layer, "WARN", rule["label"], f"missing {note}")])
    if not choice:
        return fixed_findings(spark, [(layer, "PASS", rule["label"], "present")])
    rows = reduce(lambda a, b: a.union(b), [t.select(F.lit(1).alias("one")) for t in choice])
    return findings_from(rows.agg(F.count("one").alias("n")), [
        finding(layer, graded(F.col("n") > 0), rule["label"], text(F.col("n"), " rows to draw on"))])


def file_inventory(spark: SparkSession, root: str, checksum: bool = True) -> DataFrame:
    """(path, bytes, sha256) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    cols = [F.col("path"), F.col("length").alias("bytes")]
    return files.select(*cols, *([F.sha2("content", 256).alias("sha256")] if checksum else []))


def inventory_summary(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("total_bytes"),
                     F.max_by("path", F.struct("bytes", "path")).alias("largest"))
