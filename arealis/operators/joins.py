"""Spine assembly, outer merges, membership, filters and column pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..functions.text import name_key
from .order import keep_first


def assemble_spine(spine: DataFrame, layers: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Left-join any number of area layers to the spine, each on its own key.

    Every layer is first brought to one row per key, so the spine keeps its row count;
    columns the table already has are not taken again.
    """
    table = spine
    for df, key in layers.values():
        fresh = [c for c in df.columns if c != key and c not in table.columns]
        one = keep_first(df.select(key, *fresh).where(F.col(key).isNotNull()), [key],
                         [F.col(c) for c in fresh])
        table = table.join(one, key, "left")
    return table


def merge_coalesce(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer join on ``key``; a column in several frames takes its first present value.

    Frames are one row per key; rows without a key are left out.
    """
    frames = [f.where(F.col(key).isNotNull()) for f in frames]

    def both(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in right.columns if c in left.columns and c != key]
        r = right.withColumnsRenamed({c: f"__r_{c}" for c in shared})
        joined = left.join(r, key, "full_outer")
        return joined.withColumns({c: F.coalesce(c, f"__r_{c}") for c in shared}).drop(
            *[f"__r_{c}" for c in shared])

    return reduce(both, frames)


def merge_blocks(blocks: dict[str, DataFrame], key: str = "food_code",
                 carried: tuple[str, ...] = ("food_group", "food_name")) -> DataFrame:
    """Merge composition blocks on the food code; name and group by block priority."""
    merged = merge_coalesce(
        [keep_first(b, [key], [F.col("ordinal")]).drop("ordinal") if "ordinal" in b.columns else b
         for b in blocks.values()], key)
    rest = [c for c in merged.columns if c not in (key, *carried)]
    return merged.select(key, *carried, *rest)


def keep_facts(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Dimension columns for every fact row; facts without a match stay."""
    extra = [c for c in dimension.columns if c == key or c not in facts.columns]
    return dimension.select(*extra).join(facts, key, "right")


def members(df: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose normalised ``column`` is a known key."""
    return _membership(df, keys, column, key, "left_semi")


def strangers(df: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """Rows with a value whose normalised form is no known key."""
    return _membership(df.where(F.col(column).isNotNull()), keys, column, key, "left_anti")


def _membership(df, keys, column, key, how):
    known = keys.select(F.col(key).alias("__key")).where(F.col("__key") != "").distinct()
    return df.withColumn("__key", name_key(column)).join(known, "__key", how).drop("__key")


def attach_clusters(records: DataFrame, clusters: DataFrame, record_key: str = "v001",
                    cluster_key: str = "dhsclust", area: str = "county_norm") -> DataFrame:
    """Survey records with their cluster's columns; a record without an area takes the cluster's.

    There is one row per cluster, and AQE splits the shuffle where one cluster is heavy.
    """
    cl = keep_first(clusters, [cluster_key],
                    [F.col(c) for c in clusters.columns if c != cluster_key])
    if area in cl.columns:
        cl = cl.withColumnRenamed(area, f"{area}_cluster")
    out = records.join(cl, F.col(record_key).try_cast("bigint") == F.col(cluster_key).cast("bigint"),
                       "left")
    if f"{area}_cluster" in out.columns:
        own = F.nullif(F.col(area), F.lit("")) if area in records.columns else F.lit(None)
        out = out.withColumn(area, F.coalesce(own, F.col(f"{area}_cluster"), F.lit("")))
    return out


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the named columns that exist, in the given order."""
    return df.select(*[c for c in columns if c in df.columns])


def drop_empty(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop the named columns that hold no value at all; one aggregate decides."""
    columns = [c for c in (columns or df.columns) if c in df.columns]
    if not columns:
        return df
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if counts[c] == 0])


def valid_points(df: DataFrame, lat: str, lon: str, drop_origin: bool = False) -> DataFrame:
    """Rows with a usable coordinate pair."""
    ok = finite(lat).between(-90, 90) & finite(lon).between(-180, 180)
    if drop_origin:
        ok = ok & ~((F.col(lat) == 0) & (F.col(lon) == 0))
    return df.where(ok)


def equals_ignoring_case(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.upper(F.col(column).cast("string")) == value.upper())


def contains_word(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Case-insensitive substring filters, each applied only where its column exists."""
    by_lower = {c.lower(): c for c in df.columns}
    for column, word in filters.items():
        name = by_lower.get(column.lower())
        if name and word:
            df = df.where(F.contains(F.lower(F.col(name).cast("string")), F.lit(word.lower())))
    return df
