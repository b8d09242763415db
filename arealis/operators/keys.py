"""The area crosswalk: building it, finding key columns, attaching codes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import presets as P
from ..functions.text import name_key
from .order import keep_first, null_safe_join

CROSSWALK_COLUMNS = ("county_code", "county_name", "county_norm", "subcounty_code",
                     "subcounty_name", "subcounty_norm", "source")


def seed_areas(spark: SparkSession) -> DataFrame:
    """The built-in area list as (code, name, norm)."""
    rows = [(P.AREA_CODE_FORMAT % code, name) for code, name in P.SEED_AREAS]
    df = spark.createDataFrame(rows, "county_code string, county_name string")
    return df.withColumn("county_norm", name_key("county_name"))


def match_column(columns: list[str], patterns, clean=str.lower) -> str | None:
    """The first column whose cleaned name a pattern covers; earlier patterns go first."""
    names = [(clean(c), c) for c in columns]
    return next((c for p in patterns for name, c in names if re.fullmatch(p, name)), None)


def letters_only(name: str) -> str:
    return re.sub("[^0-9a-z]+", "", name.lower())


def match_alias(columns: list[str], aliases: tuple[str, ...], suffix: bool = True) -> str | None:
    """The column named like an alias once only letters and digits are compared, else one that ends so."""
    patterns = [*aliases, f".*(?:{'|'.join(aliases)})"] if suffix else aliases
    return match_column(columns, patterns, letters_only)


def classify_layers(features: DataFrame, layer: str = "layer",
                    bands: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """Pick for each level the layer whose feature count lies in the level's band and
    nearest its target; the first name wins a tie.

    ``bands`` maps level to (low, high, target).
    """
    bands = bands or {"adm1": (*P.AREA_BAND, P.EXPECTED_AREAS),
                      "adm2": (*P.SUBAREA_BAND, P.EXPECTED_SUBAREAS)}
    counts = features.groupBy(layer).agg(F.count(F.lit(1)).alias("n_features"))
    level, off = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for name, (low, high, target) in bands.items():
        inside = F.col("n_features").between(low, high)
        level = F.when(inside, F.lit(name)).otherwise(level)
        off = F.when(inside, F.abs(F.col("n_features") - target)).otherwise(off)
    graded = counts.withColumns({"level": level, "off": off}).where(F.col("level").isNotNull())
    best = F.min_by(F.struct(layer, "n_features"), F.struct("off", F.col(layer)))
    return (graded.groupBy("level").agg(best.alias("b"))
            .select("level", F.col(f"b.{layer}").alias(layer), "b.n_features"))


def build_crosswalk(spark: SparkSession, subareas: DataFrame | None = None,
                    areas: DataFrame | None = None) -> DataFrame:
    """Crosswalk from sub-area attributes, else from area attributes, else from the seed."""
    blank = F.lit("")
    for df, source in ((subareas, "subarea layer"), (areas, "area layer")):
        if df is None:
            continue
        cols = {role: match_column(df.columns, p) for role, p in P.BOUNDARY_COLUMNS.items()}
        if cols["area_name"] is None:
            continue

        def text(role: str) -> Column:
            c = cols[role]
            return F.coalesce(F.col(c).cast("string"), blank) if c else blank

        return df.select(
            text("area_code").alias("county_code"), text("area_name").alias("county_name"),
            name_key(text("area_name")).alias("county_norm"),
            text("subarea_code").alias("subcounty_code"),
            text("subarea_name").alias("subcounty_name"),
            name_key(text("subarea_name")).alias("subcounty_norm"),
            F.lit(source).alias("source")).distinct()
    return seed_areas(spark).select(
        "county_code", "county_name", "county_norm", blank.alias("subcounty_code"),
        blank.alias("subcounty_name"), blank.alias("subcounty_norm"),
        F.lit("seed").alias("source"))


def key_table(crosswalk: DataFrame, key: str = "county_norm",
              carry: tuple[str, ...] = ("county_code", "county_name")) -> DataFrame:
    """One row per non-empty key; the smallest code wins where a key repeats."""
    keyed = crosswalk.select(key, *carry).where(F.col(key).isNotNull() & (F.col(key) != ""))
    return keep_first(keyed, [key], [F.col(c) for c in carry])


def area_frame(crosswalk: DataFrame | None, spark: SparkSession) -> DataFrame:
    """Areas of the crosswalk; the built-in list where there is no crosswalk."""
    areas = seed_areas(spark) if crosswalk is None else key_table(crosswalk)
    return areas.select("county_code", "county_name", "county_norm")


def key_hits(df: DataFrame, keys: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """For every column: how many of its filled cells there are and how many normalise to a known key.

    Cells meet the keys before anything is grouped, and the counts are summed map-side, so that a large table is
    not shuffled by value where the keys are few.
    """
    columns = columns or df.columns
    long = df.select(*[name_key(c).alias(c) for c in columns]).unpivot(
        [], columns, "column", "value").where("value <> ''")
    known = keys.select(F.col(key).alias("value"), F.lit(1).alias("hit")).where("value <> ''").distinct()
    return (long.join(known, "value", "left").groupBy("column")
            .agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("filled")))


def detect_key_column(df: DataFrame, keys: DataFrame, key: str = "county_norm", share: float = 1 / 3) -> str | None:
    """The column that looks like an area name: most matching cells, the first one on ties.

    At least ``share`` of its filled cells must match, and one cell.
    """
    order = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    hits = key_hits(df, keys, key).where((F.col("hits") > 0) & (F.col("hits") >= F.floor(F.col("filled") * share)))
    best = hits.agg(F.max_by("column", F.struct("hits", -order[F.col("column")])).alias("column")).first()
    return best["column"]


def key_columns(df: DataFrame, keys: DataFrame, columns: list[str], group: str = "__file", key: str = "county_norm",
                share: float = 1 / 3) -> DataFrame:
    """``(group, column)`` for groups of rows that have a key column: ``detect_key_column`` for all of them at once."""
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    long = df.select(group, *[name_key(F.col(f"`{c}`")).alias(c) for c in columns]).unpivot(
        [group], [F.col(f"`{c}`") for c in columns], "column", "value").where("value <> ''")
    known = keys.select(F.col(key).alias("value"), F.lit(1).alias("hit")).where("value <> ''").distinct()
    hits = long.join(known, "value", "left").groupBy(group, "column").agg(
        F.count("hit").alias("hits"), F.count(F.lit(1)).alias("filled"))
    hits = hits.where((F.col("hits") > 0) & (F.col("hits") >= F.floor(F.col("filled") * share)))
    return hits.groupBy(group).agg(F.max_by("column", F.struct("hits", -order[F.col("column")])).alias("column"))


def attach_area(df: DataFrame, crosswalk: DataFrame, column: str, key: str = "county_norm",
                carry: tuple[str, ...] = ("county_code", "county_name"),
                drop_unmatched: bool = False) -> DataFrame:
    """Add the canonical code and name by the normalised value of ``column``.

    The key table has one row per key, so row count is kept; its size decides at run time
    whether it is broadcast.
    """
    base = df.drop(*[c for c in carry if c != column])
    keyed = base.withColumn("__key", name_key(column))
    table = key_table(crosswalk, key, carry).select(
        F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in carry])
    joined = keyed.join(table, "__key", "inner" if drop_unmatched else "left")
    base_cols = [F.col(c) for c in df.columns if c not in carry]
    return joined.select(*base_cols, *[F.col(f"__{c}").alias(c) for c in carry])


def detect_label_variable(labels: DataFrame, keys: DataFrame, key: str = "county_norm",
                          candidates: tuple[str, ...] = P.AREA_VARIABLES,
                          min_hits: int = P.MIN_LABEL_HITS) -> DataFrame:
    """Coded variable whose value labels match most distinct keys; earlier candidates win ties.

    ``labels`` has (variable, code, label). Gives one row, or none below ``min_hits``.
    """
    order = F.create_map(*[x for i, c in enumerate(candidates) for x in (F.lit(c), F.lit(i))])
    named = labels.where(F.col("variable").isin(*candidates)).select(
        "variable", name_key("label").alias(key)).where(F.col(key) != "").distinct()
    hits = (named.join(keys.select(key).distinct(), key, "left_semi")
            .groupBy("variable").agg(F.count(F.lit(1)).alias("hits")))
    return (hits.agg(F.max_by(F.struct("variable", "hits"),
                              F.struct("hits", -order[F.col("variable")])).alias("b"))
            .select("b.variable", "b.hits").where(F.col("hits") >= min_hits))


def decode_area(df: DataFrame, labels: DataFrame, variable: str,
                key: str = "county_norm") -> DataFrame:
    """Normalised area name of a coded column; an unlabelled code gives the empty key."""
    names = (labels.where(F.col("variable") == variable)
             .groupBy("code").agg(F.min(name_key("label")).alias("__label")))
    out = null_safe_join(df.withColumn("code", F.col(variable).cast("int")), names, ["code"], "left")
    return out.withColumn(key, F.coalesce("__label", F.lit(""))).drop("__label", "code")
