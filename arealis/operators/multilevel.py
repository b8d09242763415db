"""Random-intercept model by restricted maximum likelihood from group sums.

One aggregate over the records gives, for each group, its size and the sums of the outcome
and terms; a second gives the total cross-products. The likelihood depends on the data only
through these, and for a set of candidate variance ratios it needs one aggregate over the
group table. Groups are never collected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import presets as P
from ..functions.numeric import finite, listwise, score_stats, zscore
from ..session import cut_lineage
from .regression import normal_p


@dataclass
class MixedFit:
    terms: list[str]
    coef: dict[str, float]
    se: dict[str, float]
    p: dict[str, float]
    group_var: float
    scale: float
    icc: float
    n: int
    n_groups: int


def _penalised(groups: DataFrame, names: list[str], ratios: list[float]):
    """For each ratio: sum over groups of w s s' with w = r / (1 + n r), and of ln(1 + n r); and the cross-products,
    rows and groups in all."""
    ratio = F.col("r")
    w = ratio / (1.0 + F.col("n") * ratio)
    aggs = [F.sum(F.log1p(F.col("n") * ratio)).alias("logdet"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("g")]
    k = len(names)
    for a in range(k):
        for b in range(a, k):
            aggs.append(F.sum(w * F.col(names[a]) * F.col(names[b])).alias(f"c_{a}_{b}"))
            aggs.append(F.sum(f"t_{a}_{b}").alias(f"t_{a}_{b}"))
    rows = (groups.withColumn("r", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
            .groupBy("r").agg(*aggs).collect())

    def matrix(row, kind: str) -> np.ndarray:
        return np.array([[row[f"{kind}_{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)])

    found = {row["r"]: (matrix(row, "c"), row["logdet"]) for row in rows}
    return (found, matrix(rows[0], "t"), rows[0]["n"], rows[0]["g"]) if rows else (found, None, 0, 0)


def _solve(total: np.ndarray, drop: np.ndarray, logdet: float, n: int):
    """Profile REML at one ratio: coefficients, scale, information and log-likelihood."""
    m = total - drop
    xx, xy, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    beta = np.linalg.pinv(xx, hermitian=True) @ xy
    p = xx.shape[0]
    rss = max(float(yy - beta @ xy), 1e-300)
    scale = rss / (n - p)
    roots = np.linalg.eigvalsh(xx)
    roots = roots[roots > 1e-12 * roots[-1]]  # collinear terms leave the determinant at 0
    loglik = -0.5 * ((n - p) * math.log(scale) + logdet + float(np.log(roots).sum()))
    return beta, scale, xx, loglik


def random_intercept(df: DataFrame, outcome: str, terms: list[str], group: str, rounds: int = 2, width: int = 128,
                     max_ratio: float = 1e4, min_rows: int = 0, min_groups: int = 0) -> MixedFit | None:
    """Fit outcome ~ terms + (1 | group) by REML on complete rows; None with too few rows or groups.

    The variance ratio is searched on a wide grid that moves up while its last point is the best and then narrows
    around the best point; 0 (no group variance) is always among the candidates. The totals come with the first grid.
    """
    rows = listwise(df.where(F.col(group).isNotNull()), [outcome, *terms])
    mean = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate([*terms, outcome])],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate([*terms, outcome])]).first()
    if mean["n"] < max(min_rows, 1):
        return None
    shift = np.array([mean[f"m{i}"] for i in range(len(terms) + 1)], float)
    scale_x = np.array([mean[f"s{i}"] or 1.0 for i in range(len(terms) + 1)], float)
    names = ["v0", *[f"v{i + 1}" for i in range(len(terms) + 1)]]
    v = [F.lit(1.0), *[(F.col(c).cast("double") - float(shift[i])) / float(scale_x[i])
                       for i, c in enumerate([*terms, outcome])]]
    scaled = rows.select(F.col(group).alias("g"), *[c.alias(n) for c, n in zip(v, names)])
    k = len(names)
    cross = [F.sum(F.col(names[a]) * F.col(names[b])).alias(f"t_{a}_{b}")
             for a in range(k) for b in range(a, k)]
    groups = cut_lineage(scaled.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names], *cross))
    grid = [0.0, *np.logspace(-6, math.log10(max_ratio), width).tolist()]
    found, total, n, n_groups = _penalised(groups, names, grid)
    if n_groups < min_groups:
        return None
    seen = {r: _solve(total, m, ld, n) for r, (m, ld) in found.items()}

    def best() -> float:
        return max(seen, key=lambda r: seen[r][3])

    def add(ratios: list[float]) -> None:
        fresh = [r for r in ratios if r not in seen]
        seen.update((r, _solve(total, m, ld, n)) for r, (m, ld) in _penalised(groups, names, fresh)[0].items())

    while best() == max(seen) and max(seen) < 1e12:
        add((max(seen) * np.logspace(0, 4, width)[1:]).tolist())
    for _ in range(rounds):
        order = sorted(seen)
        at = order.index(best())
        lo, hi = order[max(at - 1, 0)], order[min(at + 1, len(order) - 1)]
        if hi - lo <= 1e-9 * max(hi, 1e-6):
            break
        add(np.linspace(lo, hi, width + 2)[1:-1].tolist())
    ratio = best()
    beta, scale, xx, _ = seen[ratio]
    cov = scale * np.linalg.pinv(xx, hermitian=True)

    p = k - 1
    back = np.eye(p)
    back[1:, 1:] = np.diag(1.0 / scale_x[:-1])
    back[0, 1:] = -shift[:-1] / scale_x[:-1]
    sy = scale_x[-1]
    coef = back @ beta * sy
    coef[0] += shift[-1]
    se = np.sqrt(np.maximum(np.diag(back @ cov @ back.T), 0.0)) * sy
    scale_y = scale * sy ** 2
    var = ratio * scale_y
    labels = ["Intercept", *terms]
    return MixedFit(
        list(terms), dict(zip(labels, map(float, coef))), dict(zip(labels, map(float, se))),
        {c: normal_p(float(b / e)) if e > 0 else float("nan") for c, b, e in zip(labels, coef, se)},
        float(var), float(scale_y), float(var / (var + scale_y)), int(n), int(n_groups))


def fit_child_model(child: DataFrame, soil_term: str = "fe_isda", outcome: str = "haz",
                    group: str = "county_norm", environment=P.ENVIRONMENT_TERMS,
                    controls=P.CHILD_CONTROLS, round_dummy: str | None = None) -> MixedFit | None:
    """Child growth on the cluster's soil and environment and child controls, by area.

    Cluster columns are standardised over all rows before incomplete rows go. Terms need more
    than 50 values; fewer than 100 complete rows or 5 areas give None. ``round_dummy`` names
    a 0/1 column to add in a pooled fit; the published formula has none.
    """
    wanted = [c for c in (soil_term, *environment, *controls) if c in child.columns]
    if outcome not in child.columns or group not in child.columns or not wanted:
        return None
    stats = child.agg(*[F.count(finite(c)).alias(f"n_{c}") for c in wanted],
                      *[e.alias(n) for n, e in score_stats(wanted).items()]).first()
    enough = [c for c in wanted if stats[f"n_{c}"] > 50]
    covars = [c for c in (soil_term, *environment) if c in enough]
    if soil_term not in covars:
        return None
    scored = child.withColumns({c: zscore(c, F.lit(stats[f"m_{c}"]), F.lit(stats[f"s_{c}"])) for c in covars})
    terms = [*covars, *[c for c in controls if c in enough], *([round_dummy] if round_dummy else [])]
    return random_intercept(scored.where(F.col(group) != ""), outcome, terms, group, min_rows=100, min_groups=5)


def mixed_table(spark: SparkSession, fits: dict[str, MixedFit | None]) -> DataFrame:
    rows = [(name, t, round(f.coef[t], 4), round(f.se[t], 4), round(f.p[t], 4), f.n, f.n_groups, f.icc)
            for name, f in fits.items() if f for t in f.terms]
    return spark.createDataFrame(rows, "model string, term string, coef double, se double, p double, "
                                       "n bigint, n_groups bigint, icc double")
