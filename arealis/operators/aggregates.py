"""Area and national aggregates of prices, crops, budgets, points and cells."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets as P
from ..functions.numeric import safe_ratio
from ..functions.parse import per_unit_price
from .joins import contains_word, equals_ignoring_case
from .order import exact_quantiles, keep_last, null_safe_join, value_counts, weighted_moments


def price_summary(df: DataFrame, by: str, price: str = "price", unit: str | None = "unit",
                  commodity: str | None = None, pricetype: str | None = None,
                  currency: str | None = None, prefix: str = "") -> DataFrame:
    """Exact median, mean, sample coefficient of variation and count of per-unit prices."""
    low = {c.lower(): c for c in df.columns}
    rows = contains_word(df, {"commodity": commodity, "pricetype": pricetype})
    if currency and "currency" in low:
        rows = equals_ignoring_case(rows, low["currency"], currency)
    value = (per_unit_price(price, unit) if unit and unit in df.columns
             else F.col(price).try_cast("double"))
    rows = rows.select(by, value.alias("__p")).where(F.col("__p") > 0)
    counts = value_counts(rows, [by], "__p")
    medians = exact_quantiles(counts, [by], "__p", {"median": 0.5}, counted=True)
    moments = weighted_moments(counts, [by], "__p").select(
        by, "mean", (F.col("std") / F.col("mean")).alias("cv"), F.col("count").alias("n"))
    return null_safe_join(moments, medians, [by]).select(
        by, *[F.col(c).alias(f"{prefix}price_{c}") for c in ("median", "mean", "cv", "n")])


def latest(df: DataFrame, period: str, at: int | None = None) -> DataFrame:
    """Rows of one period, by default the newest; read as a scalar subquery."""
    wanted = F.lit(at) if at is not None else df.agg(F.max(period).alias("m")).scalar()
    return df.where(F.col(period) == wanted)


def crop_summary(df: DataFrame, by: str, item: str = "crop", area: str = "area_ha",
                 production: str = "production_mt", period: str = "year",
                 staple: str = "maize", at: int | None = None,
                 staple_match: str = "equals") -> DataFrame:
    """Latest-period area and production, items with production, and one staple's totals.

    An all-missing group sums to 0. Items are pre-aggregated, so the distinct count needs no
    row expansion.
    """
    low = F.lower(F.col(item))
    is_staple = low == staple.lower() if staple_match == "equals" else F.contains(
        low, F.lit(staple.lower()))
    rows = latest(df, period, at)
    items = rows.groupBy(by, item).agg(
        F.sum(area).alias("__a"), F.sum(production).alias("__p"), F.count(production).alias("__k"),
        F.first(F.col(period)).alias("__t"))
    z = F.lit(0.0)
    return items.groupBy(by).agg(
        F.coalesce(F.sum("__a"), z).alias("crop_area_ha"),
        F.coalesce(F.sum("__p"), z).alias("crop_production_mt"),
        # as in a left merge of counts: no crop with production gives a missing count
        F.nullif(F.count(F.when((F.col("__k") > 0) & F.col(item).isNotNull(), 1)), F.lit(0))
        .alias("n_crops"),
        F.when(F.max(is_staple), F.coalesce(F.sum(F.when(is_staple, F.col("__a"))), z))
        .alias(f"{staple}_area_ha"),
        F.when(F.max(is_staple), F.coalesce(F.sum(F.when(is_staple, F.col("__p"))), z))
        .alias(f"{staple}_production_mt"),
        F.max("__t").alias("crop_year"))


def crop_diversity(df: DataFrame, by: str, item: str = "crop", amount: str = "production_mt",
                   period: str | None = "year", staple: str = "maize") -> DataFrame:
    """Shannon index of item shares, the staple's share and the item count, 3 decimals.

    With T = sum x the index is ln T - sum(x ln x) / T, so no second look at the group's
    total is needed.
    """
    rows = (latest(df, period) if period else df).where(F.col(amount) > 0)
    items = rows.groupBy(by, item).agg(F.sum(amount).alias("__x"))
    staple_x = F.sum(F.when(F.contains(F.lower(F.col(item)), F.lit(staple.lower())), F.col("__x")))
    total = F.sum("__x")
    return items.groupBy(by).agg(
        F.round(F.ln(total) - F.sum(F.col("__x") * F.ln("__x")) / total, 3)
        .alias("crop_diversity_shannon"),
        F.round(F.coalesce(staple_x, F.lit(0.0)) / total, 3).alias(f"{staple}_production_share"),
        F.count(F.lit(1)).alias("n_crops_county"))


def crop_yields(df: DataFrame, name: str = "county_name", item: str = "crop",
                area: str = "area_ha", production: str = "production_mt",
                period: str = "year") -> DataFrame:
    """Production per area for the latest period, ordered by item and area name."""
    return latest(df, period).withColumn("yield_t_ha", safe_ratio(production, area)).orderBy(
        F.col(item).asc_nulls_last(), F.col(name).asc_nulls_last())


def national_summary(df: DataFrame, item: str = "crop", period: str = "year",
                     area: str = "area_ha", production: str = "production_mt") -> DataFrame:
    """Totals by item and period; the yield is the ratio of the rounded totals."""
    out = df.groupBy(item, period).agg(
        F.round(F.sum(area), 1).alias(area), F.round(F.sum(production), 1).alias(production))
    return out.withColumn("yield_t_ha", F.round(safe_ratio(production, area), 3)).orderBy(
        F.col(item).asc_nulls_last(), F.col(period).asc_nulls_last())


def cost_by_category(df: DataFrame, category: str, cost: str) -> DataFrame:
    return df.groupBy(category).agg(F.round(F.sum(cost), 1).alias(cost)).orderBy(
        F.col(cost).desc_nulls_last(), category)


def budget_rollup(df: DataFrame, section: str, item: str, cost: str,
                  stated_total: float | None = None) -> DataFrame:
    """Items, section sub-totals and the grand total, checked against a stated total."""
    level = F.when(F.grouping_id() == 3, "total").when(F.grouping_id() == 1, "section").otherwise("item")
    out = df.rollup(section, item).agg(F.sum(cost).alias(cost), level.alias("level"))
    if stated_total is None:
        return out
    stated = F.when(F.col("level") == "total", F.lit(float(stated_total)))
    return out.withColumns({"stated": stated, "difference": F.col(cost) - stated,
                            "agrees": F.abs(F.col(cost) - stated) < 0.05})


def pivot_first(df: DataFrame, by: str, indicator: str, value: str, indicators: list[str],
                order: list[Column], suffix: str = "") -> DataFrame:
    """First value by ``order`` for each (area, indicator), one column per indicator.

    The indicator list is given, so no extra pass looks for it and the schema is static.
    """
    position = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picks = []
    for ind in indicators:
        has = (F.col(indicator) == ind) & F.col(value).isNotNull()
        picks.append(F.min_by(value, F.when(has, position)).alias(f"{ind.lower()}{suffix}"))
    rows = df.where(F.col(indicator).isin(*indicators) & F.col(value).isNotNull())
    return rows.groupBy(by).agg(*picks)


def latest_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return keep_last(df, by, order)


def point_means(joined: DataFrame, by: str, values: list[str], count: str = "n_points") -> DataFrame:
    """Means of point measurements and the point count, 4 decimals."""
    return joined.groupBy(by).agg(F.count(F.lit(1)).alias(count),
                                  *[F.round(F.avg(v), 4).alias(v) for v in values])


def describe(df: DataFrame, columns: list[str] | None = None, digits: int = 3) -> DataFrame:
    """Count, mean, sample sd, extremes, exact quartiles and missing cells per column."""
    numeric = (T.NumericType,)
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, numeric)]
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "variable", "value")
    counts = value_counts(long, ["variable"], "value")
    base = weighted_moments(counts, ["variable"], "value")
    quart = exact_quantiles(counts, ["variable"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, counted=True)
    out = base.join(quart, "variable", "left")
    return out.select("variable", "count", *[
        F.round(c, digits).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")],
        "missing")


def depth_columns_long(df: DataFrame, keys: list[str]) -> DataFrame:
    """Wide ``prop_depth_mean`` columns as (keys, property, depth, value)."""
    named = [(c, re.match(P.DEPTH_COLUMN, c)) for c in df.columns]
    cols = [c for c, m in named if m]
    long = df.unpivot(keys, cols, "column", "value")
    return long.select(*keys, F.regexp_extract("column", P.DEPTH_COLUMN, 1).alias("property"),
                       F.regexp_extract("column", P.DEPTH_COLUMN, 2).alias("depth"),
                       F.col("value").cast("double").alias("value"))


def depth_mean(df: DataFrame, by: list[str], prop: str = "property", depth: str = "depth",
               value: str = "value", weights: dict[str, float] | None = None,
               divisors: dict[str, float] | None = None, renormalise: bool = False) -> DataFrame:
    """Thickness-weighted mean over the depths, in conventional units.

    By default a missing cell counts as 0 while its weight stays, as in the published
    figures; ``renormalise`` divides by the weights of the cells that are there.
    """
    weights = P.TOPSOIL_WEIGHTS if weights is None else weights
    divisors = P.SOIL_DIVISORS if divisors is None else divisors

    def lookup(table: dict, col: str) -> Column:
        return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])[F.col(col)]

    w = lookup(weights, depth)
    rows = df.where(F.col(depth).isin(*weights) & F.col(prop).isin(*divisors))
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    mass = F.sum(F.when(F.col(value).isNotNull(), w)) if renormalise else F.sum(w)
    out = rows.groupBy(*by, prop).agg((F.sum(v * w) / mass).alias("raw"))
    return out.select(*by, prop, (F.col("raw") / lookup(divisors, prop)).alias(value))


def mean_of_period_means(df: DataFrame, by: list[str], period: str, value: str,
                         within: str = "avg") -> DataFrame:
    """Mean (or total) within each period, then the mean over periods."""
    inner = F.avg(value) if within == "avg" else F.sum(value)
    return (df.groupBy(*by, period).agg(inner.alias("__v"))
            .groupBy(*by).agg(F.avg("__v").alias(value), F.count("__v").alias("n_periods")))


def compare_with_stated(df: DataFrame, name: str, estimate: str, stated: str,
                        extra: list[str] = ()) -> DataFrame:
    """Areas with a stated figure: the estimate, the figure and their difference."""
    keep = [c for c in (name, estimate, stated, *extra) if c in df.columns]
    return (df.where(F.col(stated).isNotNull()).select(*keep)
            .withColumn("difference", F.round(F.col(estimate) - F.col(stated), 1))
            .orderBy(F.col(stated).desc_nulls_last(), name))
