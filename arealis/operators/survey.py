"""Survey-weighted estimates and child, mother and household features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets as P
from ..functions.numeric import as_col, indicator, known
from .indices import composite_index
from .joins import attach_clusters, drop_empty
from .keys import attach_area


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Aggregate: weighted mean over rows whose value is present."""
    v, w = as_col(value).cast("double"), as_col(weight).cast("double")
    total = F.sum(F.when(v.isNotNull(), w))
    return F.when(total != 0, F.sum(w * v) / total)


def weighted_share(flag: str | Column, weight: str | Column) -> Column:
    """Aggregate: weighted percentage of a 0/1 flag over rows where it is present."""
    return weighted_mean(as_col(flag).cast("double"), weight) * 100.0


def area_estimates(df: DataFrame, by: str, weight: str, shares: list[str] = (),
                   means: list[str] = (), sizes: dict[str, Column] | None = None) -> DataFrame:
    """All weighted shares, weighted means and record counts of an area in one aggregate."""
    counts = [F.count(F.when(known(pred), 1)).alias(n) for n, pred in (sizes or {}).items()]
    return df.groupBy(by).agg(
        *counts, *[weighted_share(c, weight).alias(c) for c in shares],
        *[weighted_mean(c, weight).alias(c) for c in means])


# --- row features ------------------------------------------------------------------------
def number(c: str) -> Column:
    return F.col(c).try_cast("double")


def z_flag(c: str, limit: float = P.Z_LIMIT, cut: float = P.Z_CUT) -> Column:
    """1 below the cut, 0 above it, missing where the score is implausible."""
    x = number(c)
    return F.when(F.abs(x) <= limit, (x < cut).cast("double"))


def level_flag(c: str, hits=(1, 2, 3), valid=(1, 2, 3, 4)) -> Column:
    x = number(c)
    return F.when(x.isin(*valid), x.isin(*hits).cast("double"))


def age_months(columns: list[str]) -> Column:
    """Age in months from the first layout the table has."""
    if "b19" in columns:
        return number("b19")
    if "hw1" in columns:
        return number("hw1")
    if {"v008", "b3"} <= set(columns):
        return number("v008") - number("b3")
    return F.lit(None).cast("double")


def diet_groups(columns: list[str], groups=None) -> dict[str, Column]:
    """0/1 per food group that can be measured; a missing answer is not consumption."""
    out = {}
    for name, members in (groups or P.DIET_GROUPS).items():
        have = [m for m in members if m in columns]
        if name == "breastmilk" and not have and "m4" in columns:
            out[name] = indicator(number("m4") == 95)
        elif have:
            out[name] = F.greatest(*[indicator(number(m) == 1) for m in have], F.lit(0.0))
    return out


def diet_diversity(columns: list[str], at_least: int = 5, groups=None) -> Column | None:
    """Five or more of the food groups, for children of 6 to 23 months; None when fewer than
    ``at_least`` groups can be measured."""
    flags = diet_groups(columns, groups)
    if len(flags) < at_least:
        return None
    count = reduce(lambda a, b: a + b, flags.values())
    return F.when(age_months(columns).between(6, 23), (count >= at_least).cast("double"))


# output -> (variable, valid values, values that count); a share in percent
def _control_shares() -> dict[str, tuple[str, Column, Column]]:
    n = number
    return {
        "poorest2_share": ("v190", n("v190").isNotNull(), n("v190").isin(1, 2)),
        "no_education_share": ("v106", n("v106") < 8, n("v106") == 0),
        "secondary_plus_share": ("v106", n("v106") < 8, n("v106") >= 2),
        "improved_water_share": ("v113", n("v113") < 96, n("v113").isin(*P.IMPROVED_WATER)),
        "improved_sanitation_share": ("v116", n("v116") < 96,
                                      n("v116").isin(*P.IMPROVED_SANITATION)),
        "urban_share": ("v025", n("v025").isNotNull(), n("v025") == 1),
        "diarrhea_share": ("h11", n("h11") < 8, n("h11").isin(1, 2)),
        "vit_a_supp_share": ("h33", n("h33") != 8, n("h33").isin(1, 2, 3)),
    }


def control_shares(columns: list[str]) -> dict[str, Column]:
    return {out: F.when(valid, hit.cast("double"))
            for out, (var, valid, hit) in _control_shares().items() if var in columns}


def control_means(columns: list[str]) -> dict[str, Column]:
    means = {"wealth_factor_mean": ("v191", 100_000.0), "edu_years_mean": ("v133", 1.0)}
    return {out: number(var) / scale for out, (var, scale) in means.items() if var in columns}


def body_mass(df: DataFrame, column: str = "v445") -> DataFrame:
    """Body-mass index in units, thin and overweight flags; codes from 9000 are missing."""
    b = number(column)
    ok = b < 9000
    return df.withColumns({
        "maternal_bmi_mean": F.when(ok, b / 100.0),
        "maternal_thinness_share": F.when(ok, (b < 1850).cast("double")),
        "maternal_overweight_share": F.when(ok, (b >= 2500).cast("double"))})


# --- area tables --------------------------------------------------------------------------
def nutrition_table(children: DataFrame, crosswalk: DataFrame, women: DataFrame | None = None,
                    household: DataFrame | None = None, by: str = "county_norm") -> DataFrame:
    """Area sizes and prevalences of child growth and of child and women's anaemia.

    Recodes carry the normalised area name in ``by``. The household recode stands in for
    child anaemia where the children's recode has no values. One decimal, known areas only,
    indicators without any value left out.
    """
    kids = children.withColumns({
        "w": number("v005") / P.WEIGHT_SCALE, "stunting": z_flag("hw70"),
        "wasting": z_flag("hw72"), "underweight": z_flag("hw71")})
    shares = ["stunting", "wasting", "underweight"]
    if "hw57" in kids.columns:
        kids = kids.withColumn("child_anaemia", level_flag("hw57"))
        shares.append("child_anaemia")
    table = area_estimates(kids, by, "w", shares, sizes={"n_children": F.lit(True)})
    if household is not None and "hc57" in household.columns:
        alt = household.withColumns({"w": number("hv005") / P.WEIGHT_SCALE,
                                     "child_anaemia_alt": level_flag("hc57")})
        table = table.join(area_estimates(alt, by, "w", ["child_anaemia_alt"]), by, "full_outer")
        if "child_anaemia" in table.columns:
            # taken from the household recode only if no child has a level of their own
            own = table.agg(F.count("child_anaemia").alias("n")).scalar()
            table = table.withColumn("child_anaemia", F.when(own > 0, F.col("child_anaemia"))
                                     .otherwise(F.col("child_anaemia_alt")))
        else:
            table = table.withColumn("child_anaemia", F.col("child_anaemia_alt"))
        table = table.drop("child_anaemia_alt")
    if women is not None and "v457" in women.columns:
        tested = women.withColumns({"w": number("v005") / P.WEIGHT_SCALE,
                                    "women_anaemia": level_flag("v457")})
        table = table.join(area_estimates(
            tested.where(F.col("women_anaemia").isNotNull()), by, "w", ["women_anaemia"],
            sizes={"n_women": F.lit(True)}), by, "full_outer")
    return _finish(table, crosswalk, by,
                   {c: 1 for c in ("stunting", "wasting", "underweight", "child_anaemia",
                                   "women_anaemia")},
                   prune=("child_anaemia", "women_anaemia", "n_women", "n_children"))


def diet_controls_table(children: DataFrame, crosswalk: DataFrame, women: DataFrame | None = None,
                        by: str = "county_norm") -> DataFrame:
    """Area dietary diversity, household and child controls, and maternal body mass."""
    cols = children.columns
    shares, means = control_shares(cols), control_means(cols)
    mdd = diet_diversity(cols)
    features = {**shares, **means, **({"mdd": mdd} if mdd is not None else {})}
    df = children.withColumns({"w": number("v005") / P.WEIGHT_SCALE, **features})
    sizes = {"n_children_6_23": F.col("mdd").isNotNull()} if mdd is not None else {}
    percent = (["mdd"] if mdd is not None else []) + list(shares)
    table = area_estimates(df, by, "w", percent, list(means), sizes)
    digits = {**{c: 1 for c in percent}, **{c: 3 for c in means}}
    if women is not None and "v445" in women.columns:
        bmi = body_mass(women.withColumn("w", number("v005") / P.WEIGHT_SCALE))
        names = ["maternal_thinness_share", "maternal_overweight_share"]
        table = table.join(area_estimates(bmi, by, "w", names, ["maternal_bmi_mean"]), by, "left")
        digits |= {c: 1 for c in (*names, "maternal_bmi_mean")}
    return _finish(table, crosswalk, by, digits)


def _finish(table: DataFrame, crosswalk: DataFrame, by: str, digits: dict[str, int],
            prune: tuple[str, ...] = ()) -> DataFrame:
    out = attach_area(table, crosswalk, by, drop_unmatched=True)
    out = drop_empty(out, [c for c in prune if c in out.columns])
    out = out.withColumns({c: F.round(c, d) for c, d in digits.items() if c in out.columns})
    rest = [c for c in out.columns if c not in ("county_code", "county_name", by)]
    return out.select("county_code", "county_name", by, *rest).orderBy(
        F.col("county_name").asc_nulls_last(), by)


def cluster_soil_index(clusters: DataFrame, columns=P.SOIL_INDEX_COLUMNS,
                       name: str = "soil_index_cluster") -> DataFrame:
    """Composite index over the sampled soil columns, where three or more are there."""
    return composite_index(clusters, columns, name)


def child_table(children: DataFrame, clusters: DataFrame, round_label: str,
                area: str = "county_norm") -> DataFrame:
    """One row per child: growth score, controls and the columns of the child's cluster."""
    cols = children.columns
    haz = F.when(F.abs(number("hw70")) <= P.Z_LIMIT, number("hw70") / 100.0)
    features = {"haz": haz, "stunted": (haz < -2).cast("double")}
    if "hw1" in cols:
        features["child_age_months"] = number("hw1")
    if "b4" in cols:
        features["child_female"] = indicator(number("b4") == 2)
    if "v133" in cols:
        features["mother_edu_years"] = F.when(number("v133") <= 30, number("v133"))
    if "v190" in cols:
        features["wealth"] = number("v190")
    indexed = cluster_soil_index(clusters)
    keep = [c for c in ("dhsclust", "soil_index_cluster", "fe_isda", "rain_mm_mean", "ndvi_mean",
                        area) if c in indexed.columns]
    out = attach_clusters(children.withColumns(features), indexed.select(*keep), area=area)
    return out.withColumn("survey_round", F.lit(round_label))
