"""Clustering, first component and rank correlation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import presets as P
from ..functions.numeric import listwise
from ..session import cut_lineage, step
from .clustering import best_centres, nearest_centre, silhouettes
from .order import value_ranks


def standardised(df: DataFrame, columns: list[str], suffix: str = "__z") -> DataFrame:
    """Complete rows with population z-scores of the columns beside them."""
    full = listwise(df, columns)
    m = full.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
    return full.withColumns({
        f"{c}{suffix}": (F.col(c).cast("double") - F.lit(float(m[f"m_{i}"] or 0.0)))
        / F.lit(float(m[f"s_{i}"] or 1.0)) for i, c in enumerate(columns)})


def typology(df: DataFrame, key: str, columns=None, k_range=range(3, 8), seed: int = 42,
             n_init: int = 10, name: str = "soil_zone") -> tuple[DataFrame, dict | None]:
    """k-means zones on standardised columns, k by best silhouette (the smallest on ties).

    Incomplete rows get no zone. The best of ``n_init`` starts by cost is kept for each k; all starts of all k share
    their passes over the rows. The silhouette is the Euclidean one.
    """
    columns = [c for c in (columns or P.TYPOLOGY_COLUMNS) if c in df.columns]
    z = standardised(df, columns)
    vectors = z.select(key, F.array(*[F.col(f"{c}__z") for c in columns]).alias("v"))
    # dealt out, since a small file is one task and every pass takes all centres
    rows = step(vectors.select(F.xxhash64(key).alias("h"), "v").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h"))
    if len(rows.select("h").head(max(k_range) + 1)) < max(k_range) + 1:
        return df.withColumn(name, F.lit(None).cast("int")), None
    best = best_centres(rows, list(k_range), n_init, seed)
    scores = silhouettes(rows, best)
    k = max(k_range, key=lambda k: (scores[k], -k))
    labels = vectors.select(key, nearest_centre("v", best[k]).alias(name))
    return df.join(labels, key, "left"), {"k": k, "silhouette": round(scores[k], 3), "centres": best[k]}


def repeated_products(matrix: np.ndarray, start: list[float], steps: int) -> np.ndarray:
    """``start`` after ``steps`` multiplications with a small matrix, scaled to length one."""
    v = np.array(start, float)
    for _ in range(steps):
        v = matrix @ v
        v /= np.sqrt(v @ v)
    return v


def principal_component(df: DataFrame, key: str, columns, name: str, min_columns: int = 3, min_rows: int = 10,
                        products: tuple[list[float], int] | None = None) -> DataFrame:
    """First principal component of the standardised columns, mean loading not negative.

    The correlation matrix comes from one aggregate; scores are a linear expression. The
    table is returned as it is with too few columns or complete rows. ``products`` (start, steps) takes the loadings
    from so many multiplications of a start, where a statement fixes these, and not the eigenvector itself.
    """
    have = [c for c in columns if c in df.columns]
    if len(have) < min_columns:
        return df
    full = listwise(df, have)
    aggs = [F.count(F.lit(1)).alias("n")]
    for a, c in enumerate(have):
        aggs.append(F.avg(c).alias(f"m_{a}"))
        aggs += [F.covar_pop(c, have[b]).alias(f"c_{a}_{b}") for b in range(a, len(have))]
    row = full.agg(*aggs).first()
    if row["n"] < min_rows:
        return df
    k = len(have)
    cov = np.array([[row[f"c_{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)], float)
    sd = np.sqrt(np.diag(cov))
    scale = np.where(sd > 0, sd, 1.0)
    corr = cov / np.outer(scale, scale)
    loading = np.linalg.eigh(corr)[1][:, -1] if products is None else repeated_products(corr, *products)
    if loading.mean() < 0:
        loading = -loading
    score = F.lit(0.0)
    for a, c in enumerate(have):
        score = score + (F.col(c) - float(row[f"m_{a}"])) * float(loading[a] / scale[a])
    complete = F.lit(True)
    for c in have:
        complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.withColumn(name, F.when(complete, score))


def rank_correlation(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """Spearman matrix as (variable, one column per variable), ties at their mean rank.

    Ranks belong to values, so they are joined by value, column by column; rows need no key.
    """
    full = listwise(df, columns).select(*[F.col(c).cast("double").alias(c) for c in columns])
    ranks = cut_lineage(value_ranks(full.unpivot([], columns, "variable", "value"), ["variable"], "value"))
    for i, c in enumerate(columns):
        mine = ranks.where(F.col("variable") == c).select(
            F.col("value").alias(c), (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"r{i}"))
        full = full.join(mine, c)
    flat = full.agg(*[F.corr(f"r{i}", f"r{j}").alias(f"{i}_{j}") for i in range(len(columns)) for j in range(i + 1, len(columns))])
    rows = F.array(*[
        F.struct(F.lit(a).alias("variable"), *[
            F.round(F.lit(1.0) if i == j else F.col(f"{min(i, j)}_{max(i, j)}"), digits).alias(b)
            for j, b in enumerate(columns)])
        for i, a in enumerate(columns)])
    return flat.select(F.explode(rows).alias("r")).select("r.*")
