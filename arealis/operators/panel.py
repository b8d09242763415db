"""Year panels: rain and vegetation features, roll-out, spending and the policy panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets as P
from ..functions.numeric import finite, indicator, known, safe_ratio
from ..functions.parse import fiscal_year_end
from .indices import composite_indices
from .order import exact_quantiles, keep_last


def period_means(df: DataFrame, by: str, period: str, value: str) -> DataFrame:
    """Each (area, period) once, as its mean. Features need no rows for what was not observed: they take the number
    of periods and the last one from the whole table."""
    return df.groupBy(by, period).agg(F.avg(finite(value)).alias(value))


def _trend(period: str, value: str, at_least: int = 3) -> Column:
    x = F.when(F.col(value).isNotNull(), F.col(period).cast("double"))
    return F.when(F.count(value) >= at_least, F.regr_slope(F.col(value), x))


def rain_features(df: DataFrame, by: str, period: str = "year", value: str = "value") -> DataFrame:
    """Mean, variation, trend, last anomaly and the share of dry years of each area.

    A year that is missing for an area counts as not dry but stays in the denominator.
    """
    panel = period_means(df, by, period, value)
    whole = df.agg(F.max(period).alias("last"), F.countDistinct(period).alias("n"))
    last, n = whole.select("last").scalar(), whole.select("n").scalar()
    stats = panel.groupBy(by).agg(
        F.avg(value).alias("m"), F.stddev_pop(value).alias("s"),
        _trend(period, value).alias("rain_trend_mm_yr"),
        F.max(F.when(F.col(period) == last, F.col(value))).alias("recent"))
    sd = F.when(F.col("s") > 0, F.col("s"))
    dry = (panel.join(stats.select(by, "m", "s"), by)
           .groupBy(by).agg((F.sum(indicator((F.col(value) - F.col("m")) / sd < -1.0)) / n).alias("drought_freq")))
    return stats.join(dry, by).select(
        by, F.col("m").alias("rain_mm_mean"), safe_ratio("s", "m").alias("rain_cv"),
        "rain_trend_mm_yr", ((F.col("recent") - F.col("m")) / sd).alias("rain_anomaly_recent"),
        "drought_freq")


def rescale_factor(df: DataFrame, value: str, threshold: float = 1.5, divisor: float = 1e4) -> Column:
    """Divisor for stored integers: applies when the median size of all cells is above 1.5."""
    sizes = df.select(F.abs(finite(value)).alias("v"))
    median = exact_quantiles(sizes, [], "v", {"q": 0.5}).select("q").scalar()
    return F.when(median > threshold, F.lit(divisor)).otherwise(F.lit(1.0))


def vegetation_features(df: DataFrame, by: str, period: str = "year",
                        value: str = "value") -> DataFrame:
    panel = period_means(df, by, period, value)
    scaled = panel.withColumn(value, F.col(value) / rescale_factor(panel, value))
    return scaled.groupBy(by).agg(
        F.avg(value).alias("ndvi_mean"), _trend(period, value).alias("ndvi_trend"),
        safe_ratio(F.stddev_pop(value), F.avg(value)).alias("ndvi_cv"))


def rollout_priority(entered: str = "fertilizer_entered_year", pilot: str = "fertilizer_pilot",
                     cutoff: int = 2023) -> Column:
    """Pilot areas 2, early entrants 1, later or unknown 0."""
    early = F.col(entered).try_cast("double") <= cutoff
    return (F.when(known(F.col(pilot).try_cast("double") >= 1), 2)
            .when(known(early), 1).otherwise(0))


def spending_ratios(exp: DataFrame) -> DataFrame:
    """Absorption rate and budget share, where the inputs exist and the rate is not given."""
    cols, new = set(exp.columns), {}
    spent = F.col("ag_expenditure_kes_m").try_cast("double") if "ag_expenditure_kes_m" in cols else None
    if "ag_absorption_rate" not in cols and spent is not None and "ag_budget_alloc_kes_m" in cols:
        new["ag_absorption_rate"] = safe_ratio(spent, F.col("ag_budget_alloc_kes_m").try_cast("double"))
    if spent is not None and "total_expenditure_kes_m" in cols:
        new["ag_share_of_budget"] = safe_ratio(spent, F.col("total_expenditure_kes_m").try_cast("double"))
    return exp.withColumns(new) if new else exp


def policy_summary(areas: DataFrame, rollout: DataFrame | None = None,
                   spending: DataFrame | None = None, key: str = "county_norm",
                   ordinal: str | None = None) -> DataFrame:
    """One row per area: roll-out, latest spending and the two signal indices.

    ``ordinal`` is a column of the spending table that decides between records of the same
    fiscal year; the largest wins.
    """
    out = areas
    if rollout is not None:
        r = rollout.withColumn("fertilizer_priority", rollout_priority())
        out = out.join(r.select(key, "fertilizer_entered_year", "fertilizer_pilot",
                                "fertilizer_priority"), key, "left")
    if spending is not None:
        exp = spending_ratios(spending).withColumn("expenditure_fy", fiscal_year_end("fiscal_year"))
        have = [c for c in P.SPENDING_INTENSITY if c in exp.columns]
        ties = [F.col(ordinal)] if ordinal else [F.col(c) for c in have]
        last = keep_last(exp.select(key, "expenditure_fy", *have, *([ordinal] if ordinal else [])),
                         [key], [F.col("expenditure_fy"), *ties])
        out = out.join(last.select(key, "expenditure_fy", *have), key, "left")
    return composite_indices(out, {"policy_signal_index": P.POLICY_SIGNALS, "soil_food_policy_signal": P.FOOD_SIGNALS},
                             at_least=1)


def policy_panel(areas: DataFrame, rollout: DataFrame | None = None,
                 spending: DataFrame | None = None, key: str = "county_norm",
                 years: tuple[int, ...] = (2022, 2023, 2024), basis: str | None = None) -> DataFrame:
    """Area by fiscal year with the programme's active flag.

    With spending records their years are used and the flag looks at the year's end;
    without them the calendar is expanded and it looks at the start. ``basis`` overrides.
    """
    entered = F.col("fertilizer_entered_year").try_cast("double")
    join_rollout = lambda df: df.join(
        rollout.select(key, "fertilizer_entered_year"), key, "left")
    if spending is not None:
        lead = [c for c in areas.columns if c == key or c not in spending.columns]
        panel = areas.select(*lead).join(spending, key, "right")
        if rollout is None:
            return panel
        end = fiscal_year_end("fiscal_year")
        at = end if (basis or "end") == "end" else end - 1
        return join_rollout(panel).withColumn("fertilizer_active", known(at >= entered).cast("int"))
    panel = calendar(areas, years, "__y")
    panel = join_rollout(panel) if rollout is not None else panel.withColumn(
        "fertilizer_entered_year", F.lit(None).cast("double"))
    at = F.col("__y") if (basis or "start") == "start" else F.col("__y") + 1
    fy = F.concat(F.col("__y").cast("string"), F.lit("/"),
                  F.substring((F.col("__y") + 1).cast("string"), 3, 2))
    return panel.select(*areas.columns, fy.alias("fiscal_year"),
                        known(at >= entered).cast("int").alias("fertilizer_active"))


def calendar(df: DataFrame, years: tuple[int, ...], name: str = "year") -> DataFrame:
    """Each row once per year of a fixed list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(y) for y in years])))
