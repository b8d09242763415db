"""Composite indices, gaps and derived ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets as P
from ..functions.numeric import row_mean, safe_ratio, score_stats, standard_scores, with_stats
from .order import average_ranks


def _score_index(have: list[str]):
    """Statistics and expression of a row mean of population z-scores."""
    return score_stats(have), lambda g: row_mean(standard_scores(g, have))


def _minmax_index(have: list[str]):
    """The same of min-max scaled columns; a column without spread scores 0."""
    def scaled(g: Column, c: str) -> Column:
        lo, hi, x = g[f"lo_{c}"], g[f"hi_{c}"], F.col(c).cast("double")
        return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(x * 0.0)

    ends = {f"{side}_{c}": agg(c) for c in have for side, agg in (("lo", F.min), ("hi", F.max))}
    return ends, lambda g: row_mean([scaled(g, c) for c in have])


def _with_indices(df: DataFrame, parts: dict[str, tuple]) -> DataFrame:
    """Several indices from one struct of statistics, so that the input is read once for all of them."""
    stats = {k: v for aggs, _ in parts.values() for k, v in aggs.items()}
    return with_stats(df, stats, lambda g: {name: build(g) for name, (_, build) in parts.items()}) if parts else df


def composite_indices(df: DataFrame, indices: dict[str, tuple], at_least: int = 3) -> DataFrame:
    """Row means of population z-scores over those of each index's columns that exist.

    An index with fewer than ``at_least`` of them is left out.
    """
    have = {name: [c for c in columns if c in df.columns] for name, columns in indices.items()}
    return _with_indices(df, {n: _score_index(c) for n, c in have.items() if c and len(c) >= at_least})


def composite_index(df: DataFrame, columns, name: str, at_least: int = 3) -> DataFrame:
    return composite_indices(df, {name: tuple(columns)}, at_least)


def minmax_index(df: DataFrame, columns, name: str) -> DataFrame:
    """Row mean of min-max scaled columns."""
    return _with_indices(df, {name: _minmax_index([c for c in columns if c in df.columns])})


def rank_index(df: DataFrame, key: str, columns, name: str) -> DataFrame:
    """Row mean of average ranks scaled to 0..1 within each column."""
    have = [c for c in columns if c in df.columns]
    ranks = average_ranks(df, key, have)
    scaled = F.when(F.col("total") > 1, (F.col("avg_rank") - 1) / (F.col("total") - 1)).otherwise(
        F.lit(0.0))
    index = ranks.groupBy(key).agg(F.avg(scaled).alias(name))
    return df.join(index, key, "left")


def index_variants(df: DataFrame, key: str, columns, prefix: str = "soil_index") -> DataFrame:
    """The same index built from z-scores, min-max scores and ranks."""
    have = [c for c in columns if c in df.columns]
    parts = {f"{prefix}_z": _score_index(have)} if len(have) >= 3 else {}
    out = _with_indices(df, {**parts, f"{prefix}_minmax": _minmax_index(have)})
    return rank_index(out, key, columns, f"{prefix}_rank")


def gaps_to_mean(df: DataFrame, gaps: dict[str, tuple[str, int]]) -> DataFrame:
    """Distance to the cross-area mean, signed so that larger is worse.

    ``gaps`` maps output to (column, +1 when larger values are worse, else -1).
    """
    live = {n: (c, s) for n, (c, s) in gaps.items() if c in df.columns}
    if not live:
        return df
    return with_stats(df, {f"m_{n}": F.avg(c) for n, (c, _) in live.items()}, lambda g: {
        n: (F.col(c) - g[f"m_{n}"]) if s > 0 else (g[f"m_{n}"] - F.col(c))
        for n, (c, s) in live.items()})


AREA_GAPS = {
    "gap_body_stunting": ("stunting", 1),
    "gap_food_density": ("food_nutrient_density_index", -1),
    "gap_soil": ("soil_index", -1),
}

# output -> (numerator, denominator, factor on the numerator, factor on the denominator)
AREA_RATIOS = {
    "maize_yield_t_ha": ("maize_production_mt", "maize_area_ha", 1, 1),
    "crop_production_per_capita_kg": ("crop_production_mt", "population_total", 1000, 1),
    "maize_production_per_capita_kg": ("maize_production_mt", "population_total", 1000, 1),
    "ag_land_share": ("ag_land_ha_total", "land_area_sqkm", 1, 100),
    "farming_hh_share": ("farming_households_total", "households", 1, 1),
    "cropland_per_farming_hh_ha": ("ag_land_ha_total", "farming_households_total", 1, 1),
    "ag_land_subsistence_share": ("ag_land_ha_subsistence", "ag_land_ha_total", 1, 1),
}


def derived_ratios(df: DataFrame, ratios=None) -> DataFrame:
    """Ratios whose two columns exist; missing where the denominator is not positive."""
    ratios = AREA_RATIOS if ratios is None else ratios
    return df.withColumns({
        name: safe_ratio(F.col(num), F.col(den).cast("double") * float(f_den), float(f_num))
        for name, (num, den, f_num, f_den) in ratios.items()
        if num in df.columns and den in df.columns})


def round_change(current: DataFrame, earlier: DataFrame, key: str, columns: list[str],
                 suffix: str, change: dict[str, str] | None = None) -> DataFrame:
    """Bring an earlier round alongside with a suffix and add the differences."""
    old = earlier.select(key, *[F.col(c).alias(f"{c}{suffix}") for c in columns])
    out = current.join(old, key, "left")
    return out.withColumns({n: F.col(c) - F.col(f"{c}{suffix}") for n, c in (change or {}).items()})


def soil_index(df: DataFrame) -> DataFrame:
    return composite_index(df, P.SOIL_INDEX_COLUMNS, "soil_index")
