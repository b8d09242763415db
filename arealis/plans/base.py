"""Registry of runnable queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Parquet tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under its own name."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def rounded(c: str | Column, digits: int, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits).alias(name or c)


def sql_key(c: str) -> str:
    return (f"coalesce(trim(regexp_replace(lower(replace(cast({c} as varchar), '’', '''')), "
            f"'[^a-z0-9]+', ' ', 'g')), '')")


def sql_row_mean(cols: list[str]) -> str:
    total = " + ".join(f"coalesce({c}, 0.0)" for c in cols)
    n = " + ".join(f"(case when {c} is null then 0 else 1 end)" for c in cols)
    return f"(case when {n} > 0 then ({total}) / ({n}) end)"


def supplied(t: Tables) -> DataFrame:
    """Line items with their supplier's nation and region."""
    return (t.lineitem.join(t.supplier.select("s_suppkey", "s_nationkey"),
                            F.col("l_suppkey") == F.col("s_suppkey"))
            .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .withColumn("year", F.year("l_shipdate")))


SUPPLIED = """select l.*, s.s_nationkey, n.n_nationkey, n.n_name, n.n_regionkey,
       cast(year(l_shipdate) as int) as "year"
from lineitem l join supplier s on l_suppkey = s_suppkey join nation n on s_nationkey = n_nationkey"""


def crops(t: Tables) -> DataFrame:
    """Item by nation by year facts: the part type is the item."""
    return (supplied(t).join(t.part.select("p_partkey", "p_type", "p_name", "p_size"),
                             F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("n_name").alias("county_name"), F.col("p_type").alias("crop"), "year",
                    F.when(F.col("l_tax") > 0.0, F.col("l_quantity")).alias("area_ha"),
                    F.when(F.col("l_discount") > 0.0, F.col("l_extendedprice")).alias("production_mt"),
                    F.split("p_name", " ")[1].alias("item")))


CROPS = f"""select n_name as county_name, p_type as crop, "year",
       case when l_tax > 0 then l_quantity end as area_ha,
       case when l_discount > 0 then l_extendedprice end as production_mt,
       split_part(p_name, ' ', 2) as item
from ({SUPPLIED}) x join part on l_partkey = p_partkey"""


def areas(t: Tables) -> DataFrame:
    """Nations as a crosswalk of areas, customers' segments as their sub-areas."""
    return t.nation.select(
        F.format_string("N%02d", "n_nationkey").alias("county_code"), F.col("n_name").alias("county_name"),
        F.lower(F.regexp_replace("n_name", "_", " ")).alias("county_norm"), "n_nationkey", "n_regionkey")


AREAS = """select 'N' || lpad(cast(n_nationkey as varchar), 2, '0') as county_code, n_name as county_name,
       lower(replace(n_name, '_', ' ')) as county_norm, n_nationkey, n_regionkey from nation"""
