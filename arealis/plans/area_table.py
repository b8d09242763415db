"""The one-row-per-area analytical table, its analysis and its publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import presets as P
from ..operators import aggregates as A
from ..operators import autocorrelation as AC
from ..operators import indices as I
from ..operators import regression as R
from ..operators.joins import assemble_spine, present
from ..operators.keys import key_table
from ..operators.ledger import publish
from ..operators.matching import nutrient_supply
from ..operators.typology import typology
from ..session import cut_lineage

POPULATION = ["county_code", "population_total", "households", "avg_household_size", "land_area_sqkm", "density"]
AGRICULTURE = ["county_code", *[f"{m}_{t}" for m in ("ag_land_ha", "farming_households")
                                for t in ("total", "subsistence", "commercial")]]
NUTRITION = ["county_code", "stunting", "wasting", "underweight", "child_anaemia", "women_anaemia", "n_children", "n_women"]
EARLIER = ["stunting", "wasting", "underweight", "child_anaemia", "women_anaemia"]


def topsoil_wide(zonal: DataFrame, key: str = "county_norm", renormalise: bool = False) -> DataFrame:
    """One column per soil property from the wide zonal table."""
    long = A.depth_columns_long(zonal, [key])
    means = A.depth_mean(long, [key], renormalise=renormalise)
    return means.groupBy(key).agg(*[
        F.max(F.when(F.col("property") == p, F.col("value"))).alias(p) for p in P.SOIL_DIVISORS])


def build_area_table(tables: dict[str, DataFrame]) -> DataFrame:
    """Join every layer that is there to the crosswalk's areas and derive ratios, index and gaps.

    Recognised names: crosswalk (required), zonal_soil, point_soil, gridded_soil, prices,
    population, agriculture, crops, composition, stated_nutrition, nutrition,
    nutrition_earlier, diet_controls, remote_sensing, policy.
    """
    t, layers = tables, {}

    def add(name: str, df: DataFrame, key: str) -> None:
        layers[name] = (df.drop(*[c for c in ("county_name", "county_code", "county_norm") if c != key]), key)

    if "zonal_soil" in t:
        add("topsoil", topsoil_wide(t["zonal_soil"]), "county_norm")
    for name in ("point_soil", "gridded_soil", "remote_sensing", "policy"):
        if name in t:
            add(name, t[name], "county_norm")
    if "prices" in t:
        add("prices", A.price_summary(t["prices"], "county_norm", commodity="Maize", pricetype="Retail",
                                      currency="KES", prefix="maize_"), "county_norm")
    if "population" in t:
        add("population", present(t["population"], POPULATION), "county_code")
    if "agriculture" in t:
        add("agriculture", present(t["agriculture"], AGRICULTURE), "county_code")
    if "crops" in t:
        add("crops", A.crop_summary(t["crops"], "county_code"), "county_code")
        add("diversity", A.crop_diversity(t["crops"], "county_code"), "county_code")
        if "composition" in t and "population" in t:
            add("nutrients", nutrient_supply(t["crops"], t["composition"], t["population"]), "county_code")
    if "stated_nutrition" in t:
        stated = t["stated_nutrition"]
        order = [F.col("ordinal")] if "ordinal" in stated.columns else [F.col("value_pct")]
        add("stated", A.pivot_first(stated, "county_code", "indicator", "value_pct",
                                    ["Stunting"], order, "_actionplan"), "county_code")
    if "nutrition" in t:
        add("nutrition", present(t["nutrition"], NUTRITION), "county_code")
    if "nutrition_earlier" in t:
        old = present(t["nutrition_earlier"], ["county_code", *EARLIER])
        add("earlier", old.withColumnsRenamed({c: f"{c}_2014" for c in EARLIER}), "county_code")
    if "diet_controls" in t:
        add("diet", t["diet_controls"], "county_code")

    table = cut_lineage(assemble_spine(key_table(t["crosswalk"]), layers))
    if {"stunting", "stunting_2014"} <= set(table.columns):
        table = table.withColumn("stunting_change", F.col("stunting") - F.col("stunting_2014"))
    table = I.gaps_to_mean(I.soil_index(I.derived_ratios(table)), I.AREA_GAPS)
    return table.orderBy(F.col("county_code").asc_nulls_last())


def analyse(table: DataFrame, edges: DataFrame | None = None, key: str = "county_norm",
            permutations: int = 999) -> dict[str, DataFrame]:
    """Descriptives, zones, models, robustness checks and spatial tests of an area table."""
    spark = table.sparkSession
    fits = R.fit_many(table, R.named_specs())
    out = {"descriptives": A.describe(table), "models": R.coefficient_table(spark, fits),
           "zones": typology(table, key)[0], "alternative_outcomes": R.alternative_outcomes(table),
           "single_soil_terms": R.single_terms(table, "food_nutrient_density_index",
                                               (*P.SOIL_INDEX_COLUMNS, "soil_index"), P.STAGE1_CONTROLS),
           "without_soil": R.nested_contrast(table, "food_nutrient_density_index", "soil_index", P.STAGE1_CONTROLS),
           "refined": R.refined_models(table, key)}
    halves = {"agroecology": ("rain_mm_mean", "drier", "wetter")} if "rain_mm_mean" in table.columns else {
        "agroecology": ("drought_freq", "less drought", "more drought")}
    halves |= {"settlement": ("urban_share", "more rural", "more urban"),
               "poverty": ("wealth_factor_mean", "poorer", "less poor")}
    if any(v[0] in table.columns for v in halves.values()):
        out["subsamples"] = R.subsample_models(table, halves, "stunting")
    if len([c for c in P.SOIL_INDEX_COLUMNS if c in table.columns]) >= 3:
        out["index_variants"] = R.index_variant_models(
            table, key, P.SOIL_INDEX_COLUMNS, "food_nutrient_density_index", P.STAGE1_CONTROLS)
    if edges is not None:
        spatial = {n: fits[n] for n in ("food_density", "nutrition")}
        out["autocorrelation"] = AC.autocorrelation_table(table, edges, key, list(P.SPATIAL_TARGETS), permutations)
        out["residual_autocorrelation"] = AC.residual_autocorrelation(table, edges, key, spatial, permutations=permutations)
        fit, moran = AC.lagged_model(table, edges, key, "food_nutrient_density_index", ("soil_index", *P.STAGE1_CONTROLS),
                                     ["soil_index", "farming_hh_share"], permutations=permutations)
        if fit is not None:
            out |= {"lagged_model": R.coefficient_table(spark, {"lagged": fit}), "lagged_residuals": moran}
    return out


def publish_all(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", digits: int | None = 4) -> None:
    for name, df in tables.items():
        publish(df, f"{folder.rstrip('/')}/{name}", fmt, digits)
