"""Missing-value rules and parsers on values worked by hand."""

import math

import pytest
from pyspark.sql import functions as F

from arealis.functions import numeric as N
from arealis.functions import parse as PA
from arealis.functions import text as TX
from arealis.operators import aggregates as A
from arealis.operators import indices as I
from arealis.operators import panel as PN
from arealis.operators import survey as S


def values(spark, expr, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_name_keys(spark):
    assert values(spark, TX.name_key, ["Murang’a", " Tana--River ", None, "'"]) == ["murang a", "tana river", "", ""]
    assert values(spark, TX.tight_key, ["Sweet Potatoes", None]) == ["sweetpotatoes", ""]
    assert values(spark, TX.slug, ["_A b.C!"]) == ["a_b_c"]


def test_cells(spark):
    assert values(spark, PA.number_cell, ["1,600 *", "-", ".", "", "-3.5", "1-2", None, ".5"]) == [
        1600.0, None, None, None, -3.5, None, None, 0.5]
    assert values(spark, PA.composition_cell, ["tr", "[3.5]", "[0]", "1-2", "nd", "1,200", "...", None]) == [
        0.0, 3.5, 0.0, None, None, 1200.0, None, None]
    assert values(spark, PA.unit_quantity, ["90 KG", "KG", "0 KG", "1.5 L", None]) == [90.0, 1.0, 1.0, 1.5, 1.0]
    assert values(spark, PA.fiscal_year_end, ["2022/23", "2023/2024", "2023", "1999/00", "x", "2022/xx", None]) == [
        2023, 2024, 2023, 1900, -1, -1, -1]
    assert values(spark, PA.year_in, ["rain_2019_v2", "v12"]) == [2019, None]
    assert values(spark, PA.millions, ["1,250,000", "12.345", "x"]) == [1.25, 12.35, None]


def test_finite_and_ratio(spark):
    assert values(spark, N.finite, [1.0, float("nan"), float("inf"), None], "double") == [1.0, None, None, None]
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 2.0)], "a double, b double")
    assert [r.v for r in df.select(N.safe_ratio("a", "b").alias("v")).collect()] == [None, 0.25, None]


def test_index_rules(spark):
    # a constant column scores 0 where present, a missing cell is left out of the row mean
    df = spark.createDataFrame([(1, 1.0, 5.0, 2.0), (2, 3.0, 5.0, None), (3, None, None, None)], "k int, a double, b double, c double")
    got = {r.k: r.ix for r in I.composite_index(df, ["a", "b", "c"], "ix").collect()}
    assert got[1] == pytest.approx(-1 / 3) and got[2] == pytest.approx(0.5) and got[3] is None
    assert I.composite_index(df, ["a", "b", "zz"], "ix").columns == df.columns


def test_all_missing_group_sums_to_zero(spark):
    df = spark.createDataFrame([("x", "maize", 2020, None, None), ("y", "Maize", 2020, 2.0, 6.0), ("y", "beans", 2020, 1.0, None)],
                               "a string, crop string, year int, area_ha double, production_mt double")
    got = {r.a: r for r in A.crop_summary(df, "a").collect()}
    assert got["x"].crop_area_ha == 0.0 and got["x"].n_crops is None and got["x"].maize_production_mt == 0.0
    assert got["y"].crop_area_ha == 3.0 and got["y"].n_crops == 1 and got["y"].maize_area_ha == 2.0


def test_shannon_of_equal_shares(spark):
    df = spark.createDataFrame([("a", c, 2020, 5.0) for c in "wxyz"], "a string, crop string, year int, production_mt double")
    assert A.crop_diversity(df, "a").first().crop_diversity_shannon == round(math.log(4), 3)


def test_price_cv_of_one_price_is_missing(spark):
    df = spark.createDataFrame([("a", "10", "KG"), ("b", "10", "2 KG"), ("b", "n/a", "KG"), ("b", "30", "KG")], "g string, price string, unit string")
    got = {r.g: r for r in A.price_summary(df, "g").collect()}
    assert got["a"].price_cv is None and got["b"].price_median == 17.5 and got["b"].price_n == 2


def test_rain_panel_counts_missing_years(spark):
    rows = [("a", y, v) for y, v in [(2000, 10.0), (2001, 10.0), (2002, 1.0), (2003, 11.0)]]
    rows += [("b", 2000, 5.0), ("b", 2001, 5.0), ("b", 2003, 5.0), ("c", 2000, 1.0), ("c", 2001, 3.0)]
    got = {r.area: r for r in PN.rain_features(spark.createDataFrame(rows, "area string, year int, value double"), "area").collect()}
    assert got["a"].drought_freq == 0.25
    assert got["b"].drought_freq == 0.0 and got["b"].rain_anomaly_recent is None and got["b"].rain_cv == 0.0
    assert got["c"].rain_trend_mm_yr is None and got["c"].rain_anomaly_recent is None
    assert got["c"].drought_freq == 0.0  # -1 is not below -1; the two unseen years count as not dry


def test_topsoil_missing_cell_counts_as_zero(spark):
    df = spark.createDataFrame([("a", 60.0, None, 60.0), ("b", None, None, None)],
                               "county_norm string, `phh2o_0-5cm_mean` double, `phh2o_5-15cm_mean` double, `phh2o_15-30cm_mean` double")
    long = A.depth_columns_long(df, ["county_norm"])
    got = {r.county_norm: r.value for r in A.depth_mean(long, ["county_norm"]).collect()}
    assert got == {"a": pytest.approx(4.0), "b": 0.0}
    some = {r.county_norm: r.value for r in A.depth_mean(long, ["county_norm"], renormalise=True).collect()}
    assert some == {"a": pytest.approx(6.0), "b": None}


def test_weighted_prevalence_bounds_and_scaling(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 0.0, 6.0), ("a", None, 9.0), ("b", None, 1.0)], "g string, f double, w double")
    one = {r.g: r.p for r in df.groupBy("g").agg(S.weighted_share("f", "w").alias("p")).collect()}
    ten = {r.g: r.p for r in df.groupBy("g").agg(S.weighted_share("f", F.col("w") * 10).alias("p")).collect()}
    assert one == ten == {"a": 25.0, "b": None}


def test_child_flags(spark):
    assert values(spark, lambda c: S.z_flag("x"), [-201, -200, 601, 9998, None], "int") == [1.0, 0.0, None, None, None]
    assert values(spark, lambda c: S.level_flag("x"), [1, 4, 8, None], "int") == [1.0, 0.0, None, None]


def test_diet_needs_five_groups(spark):
    assert S.diet_diversity(["v404", "v414o", "b19"]) is None
    cols = ["m4", "v414e", "v414o", "v411", "v414h", "b19"]
    df = spark.createDataFrame([(95, 1, 1, 1, 1, 6), (95, 1, 1, 1, None, 23), (95, 1, 1, 1, 1, 24)], ", ".join(f"{c} int" for c in cols))
    assert [r.m for r in df.select(S.diet_diversity(cols).alias("m")).collect()] == [1.0, 0.0, None]


def test_anchors_without_text(spark):
    assert values(spark, lambda c: TX.missing_anchors("x", ["Soil  map", "b"]), [None, "the SOIL\n map"]) == [["Soil  map", "b"], ["b"]]


def test_policy_flag_basis(spark):
    areas = spark.createDataFrame([("1", "a"), ("2", "b")], "county_code string, county_norm string")
    roll = spark.createDataFrame([("a", 2023, None)], "county_norm string, fertilizer_entered_year int, fertilizer_pilot int")
    spend = spark.createDataFrame([("a", "2022/23", 1.0), ("z", "2022/23", 1.0)], "county_norm string, fiscal_year string, ag_expenditure_kes_m double")
    start = {(r.county_norm, r.fiscal_year): r.fertilizer_active for r in PN.policy_panel(areas, roll).collect()}
    assert start[("a", "2022/23")] == 0 and start[("a", "2023/24")] == 1 and start[("b", "2024/25")] == 0
    end = {r.county_norm: r.fertilizer_active for r in PN.policy_panel(areas, roll, spend).collect()}
    assert end == {"a": 1, "z": 0}


def test_stored_vegetation_is_rescaled(spark):
    df = spark.createDataFrame([("a", 2000, 5000.0), ("a", 2001, 7000.0)], "area string, year int, value double")
    assert PN.vegetation_features(df, "area").first().ndvi_mean == pytest.approx(0.6)
