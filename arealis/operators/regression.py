"""Least squares with HC3 errors from two distributed aggregates.

The first pass takes means and covariances (merged about the means, so no raw cross-products
of large numbers), the driver inverts a k x k correlation matrix, the second pass takes the
HC3 middle matrix. All models given together share the two passes; a task adds up its batches
and gives one k x k matrix per model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets as P
from ..functions.numeric import finite
from .indices import index_variants
from .order import exact_quantiles
from .typology import principal_component


@dataclass
class Spec:
    """A model to fit: regressors that the table lacks are left out."""

    name: str
    outcome: str
    regressors: tuple[str, ...]
    min_extra: int = 5
    where: Column | None = None
    labels: dict[str, str] = field(default_factory=dict)


@dataclass
class Fit:
    spec: Spec
    used: list[str]
    n: int
    coef: dict[str, float]
    se: dict[str, float]
    p: dict[str, float]
    r2: float
    adj_r2: float

    def predicted(self) -> Column:
        out = F.lit(self.coef["Intercept"])
        for c in self.used:
            out = out + F.col(c) * F.lit(self.coef[c])
        return out

    def residual(self) -> Column:
        """Residual of the rows the model used, NULL for the others."""
        return F.when(_usable(self.spec, self.used), F.col(self.spec.outcome) - self.predicted())


def _usable(spec: Spec, used: list[str]) -> Column:
    ok = F.lit(True) if spec.where is None else F.coalesce(spec.where, F.lit(False))
    for c in (spec.outcome, *used):
        ok = ok & finite(c).isNotNull()
    return ok


def _masked(df: DataFrame, live: list[tuple[Spec, list[str]]]) -> tuple[DataFrame, dict[int, list[str]]]:
    """Columns of every model, NULL in the rows it does not use; the outcome comes last.

    Flags and masked values are steps of their own, so that no aggregate repeats them.
    """
    names = sorted({c for s, used in live for c in (s.outcome, *used)})
    number = {c: f"x_{j}" for j, c in enumerate(names)}
    wheres = [(F.lit(True) if s.where is None else F.coalesce(s.where, F.lit(False))).alias(f"w_{i}")
              for i, (s, _) in enumerate(live)]
    base = df.select(*[finite(c).alias(x) for c, x in number.items()], *wheres)
    flags = []
    for i, (s, used) in enumerate(live):
        ok = F.col(f"w_{i}")
        for c in (s.outcome, *used):
            ok = ok & F.col(number[c]).isNotNull()
        flags.append(ok.alias(f"ok_{i}"))
    flagged = base.select(*number.values(), *flags)
    cells = {i: [f"v_{i}_{a}" for a in range(len(used) + 1)] for i, (_, used) in enumerate(live)}
    values = [F.when(F.col(f"ok_{i}"), F.col(number[c])).alias(v)
              for i, (s, used) in enumerate(live) for v, c in zip(cells[i], (*used, s.outcome))]
    return flagged.select(*values), cells


def _used_rows(batch: pa.RecordBatch, cells: dict[int, list[str]]) -> Iterator[tuple[int, np.ndarray]]:
    """A row per column of each model, of the rows that it uses: cells of a row are missing all or none."""
    for i, names in cells.items():
        columns = [batch.column(c) for c in names]
        used = columns[-1].is_valid()
        x = np.array([c.filter(used).to_numpy(zero_copy_only=False) for c in columns], np.float64)
        if x.shape[1]:
            yield i, x


def _merged(a: tuple, b: tuple) -> tuple:
    """(n, means, sums of products about the means) of two sets of rows together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _moments(masked: DataFrame, cells: dict[int, list[str]]) -> dict[int, tuple]:
    """(n, means, sums of products about the means) of each model that has rows; the driver merges a row per task."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            for i, x in _used_rows(batch, cells):
                mean = x.mean(axis=1)
                part = (x.shape[1], mean, (x - mean[:, None]) @ (x - mean[:, None]).T)
                found[i] = _merged(found[i], part) if i in found else part
        if found:
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(list(found), pa.int32()), "n": pa.array([p[0] for p in found.values()], pa.int64()),
                "mean": pa.array([p[1] for p in found.values()], pa.list_(pa.float64())),
                "cross": pa.array([p[2].ravel() for p in found.values()], pa.list_(pa.float64()))})

    out: dict[int, tuple] = {}
    for r in masked.mapInArrow(fn, "i int, n bigint, mean array<double>, cross array<double>").collect():
        k = len(r["mean"])
        part = (r["n"], np.array(r["mean"]), np.array(r["cross"]).reshape(k, k))
        out[r["i"]] = _merged(out[r["i"]], part) if r["i"] in out else part
    return out


def _middle(masked: DataFrame, cells: dict[int, list[str]], solved: dict[int, tuple]) -> dict[int, np.ndarray]:
    """The HC3 middle matrix of each model, with a column of ones first."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in _used_rows(batch, cells):
                n, mean, scale, inv, beta = solved[i][:5]
                z = (x[:-1] - mean[:-1, None]) / scale[:, None]
                error, lever = x[-1] - mean[-1] - beta @ z, 1.0 + ((inv @ z) * z).sum(axis=0)
                u = (error / np.maximum(1e-12, 1.0 - lever / n)) ** 2
                z = np.vstack([np.ones_like(u), z])
                found[i] = found.get(i, 0.0) + (z * u) @ z.T
        if found:
            yield pa.RecordBatch.from_pydict({"i": pa.array(list(found), pa.int32()), "meat": pa.array(
                [m.ravel() for m in found.values()], pa.list_(pa.float64()))})

    out: dict[int, np.ndarray] = {}
    for r in masked.mapInArrow(fn, "i int, meat array<double>").collect():
        k = math.isqrt(len(r["meat"]))
        out[r["i"]] = out.get(r["i"], 0.0) + np.array(r["meat"]).reshape(k, k)
    return out


def normal_p(z: float) -> float:
    """Two-sided p of a normal score."""
    return math.erfc(abs(z) / math.sqrt(2.0)) if math.isfinite(z) else float("nan")


def fit_many(df: DataFrame, specs: list[Spec]) -> dict[str, Fit | None]:
    """Fit every model; None where the outcome or all regressors are absent, or where fewer
    than (regressors + min_extra) rows are complete."""
    live = [(s, [r for r in s.regressors if r in df.columns])
            for s in specs if s.outcome in df.columns]
    live = [(s, used) for s, used in live if used]
    fits: dict[str, Fit | None] = {s.name: None for s in specs}
    if not live:
        return fits

    masked, cells = _masked(df, live)
    first = _moments(masked, cells)

    solved = {}
    for i, (s, used) in enumerate(live):
        k = len(used)
        n, mean, cross = first.get(i, (0, None, None))
        if n < k + s.min_extra:
            continue
        cov = cross / n
        sd = np.sqrt(np.diag(cov)[:k])
        scale = np.where(sd > 0, sd, 1.0)
        inv = np.linalg.pinv(cov[:k, :k] / np.outer(scale, scale), hermitian=True)
        beta = inv @ (cov[:k, k] / scale)
        solved[i] = (n, mean, scale, inv, beta, cov[k, k], cov[:k, k] / scale)
    if not solved:
        return fits

    meats = _middle(masked, {i: cells[i] for i in solved}, solved)
    for i, (n, mean, scale, inv, beta, var_y, cxy) in solved.items():
        s, used = live[i]
        k = len(used)
        bread = np.zeros((k + 1, k + 1))
        bread[0, 0], bread[1:, 1:] = 1.0 / n, inv / n
        back = np.eye(k + 1)
        back[1:, 1:] = np.diag(1.0 / scale)
        back[0, 1:] = -mean[:k] / scale
        var = back @ bread @ meats[i] @ bread @ back.T
        coef = back @ np.concatenate([[mean[k]], beta])
        names = ["Intercept", *used]
        se = np.sqrt(np.maximum(np.diag(var), 0.0))
        r2 = float(beta @ cxy / var_y) if var_y > 0 else float("nan")
        fits[s.name] = Fit(
            s, used, n, dict(zip(names, map(float, coef))), dict(zip(names, map(float, se))),
            {c: normal_p(float(b / e)) if e > 0 else float("nan")
             for c, b, e in zip(names, coef, se)},
            r2, 1.0 - (1.0 - r2) * (n - 1) / (n - k - 1) if n > k + 1 else float("nan"))
    return fits


def fit(df: DataFrame, outcome: str, regressors, min_extra: int = 5) -> Fit | None:
    return fit_many(df, [Spec("model", outcome, tuple(regressors), min_extra)])["model"]


def named_specs(names=None) -> list[Spec]:
    return [Spec(n, y, x) for n, (y, x) in P.SPECIFICATIONS.items() if names is None or n in names]


def coefficient_table(spark: SparkSession, fits: dict[str, Fit | None]) -> DataFrame:
    """(model, outcome, term, coef, se, p, n, r2, adj_r2) of the models that were fitted."""
    rows = [(name, f.spec.outcome, term, f.coef[term], f.se[term], f.p[term], f.n, f.r2, f.adj_r2)
            for name, f in fits.items() if f is not None for term in ["Intercept", *f.used]]
    return spark.createDataFrame(
        rows, "model string, outcome string, term string, coef double, se double, p double, "
              "n bigint, r2 double, adj_r2 double")


def _report(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def _digits(x: float | None, d: int) -> float | None:
    return None if x is None or not math.isfinite(x) else round(x, d)


def alternative_outcomes(df: DataFrame, outcomes=P.OUTCOME_LABELS,
                         regressors=P.STAGE2_REGRESSORS, terms=("food_nutrient_density_index", "soil_index"),
                         at_least: int = 25) -> DataFrame:
    """The nutrition model for each outcome with enough values."""
    have = [(c, label) for c, label in outcomes if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c, _ in have]).first() if have else {}
    fits = fit_many(df, [Spec(label, c, tuple(regressors)) for c, label in have
                         if counts[c] >= at_least])
    rows = [{"outcome": name, "n": f.n, "r2": _digits(f.r2, 3),
             "b_food_density": _digits(f.coef.get(terms[0]), 4), "p_food_density": _digits(f.p.get(terms[0]), 3),
             "b_soil_index": _digits(f.coef.get(terms[1]), 4), "p_soil_index": _digits(f.p.get(terms[1]), 3)}
            for name, f in fits.items() if f]
    return _report(df.sparkSession, rows, "outcome string, n bigint, r2 double, b_food_density double, "
                   "p_food_density double, b_soil_index double, p_soil_index double")


def single_terms(df: DataFrame, outcome: str, terms, controls) -> DataFrame:
    """The outcome on each term alone with the same controls."""
    fits = fit_many(df, [Spec(t, outcome, (t, *controls)) for t in terms if t in df.columns])
    rows = [{"term": t, "n": f.n, "r2": _digits(f.r2, 3), "b": _digits(f.coef.get(t), 4),
             "p": _digits(f.p.get(t), 3)} for t, f in fits.items() if f]
    return _report(df.sparkSession, rows, "term string, n bigint, r2 double, b double, p double")


def index_variant_models(df: DataFrame, key: str, columns, outcome: str, controls,
                         prefix: str = "soil_index") -> DataFrame:
    """The outcome on each construction of the index."""
    table = index_variants(df, key, columns, prefix)
    return single_terms(table, outcome, [f"{prefix}_{v}" for v in ("z", "minmax", "rank")], controls)


def nested_contrast(df: DataFrame, outcome: str, term: str, controls,
                    labels=("with index", "without index", "contribution of the index")) -> DataFrame:
    """R2 with and without a term; each model deletes incomplete rows on its own columns."""
    fits = fit_many(df, [Spec("full", outcome, (term, *controls)), Spec("rest", outcome, tuple(controls))])
    full, rest = fits["full"], fits["rest"]
    rows = []
    if full and rest:
        for label, n, r2, adj in (
                (labels[0], full.n, full.r2, full.adj_r2), (labels[1], rest.n, rest.r2, rest.adj_r2),
                (labels[2], full.n, full.r2 - rest.r2, full.adj_r2 - rest.adj_r2)):
            rows.append({"model": label, "n": n, "r2": _digits(r2, 3), "adj_r2": _digits(adj, 3)})
    return _report(df.sparkSession, rows, "model string, n bigint, r2 double, adj_r2 double")


def split_at_median(df: DataFrame, variables: dict[str, tuple[str, str, str]]) -> DataFrame:
    """One row per record and split: ``split``, ``half`` (label at or below, label above).

    ``variables`` maps split name to (column, low label, high label).
    """
    long = df.select(*[F.col(c).cast("double").alias(n) for n, (c, _, _) in variables.items()]).unpivot(
        [], list(variables), "split", "value")
    medians = exact_quantiles(long, ["split"], "value", {"m": 0.5}).agg(
        F.map_from_entries(F.collect_list(F.struct("split", "m"))).alias("m")).scalar()
    tagged = F.array(*[
        F.struct(F.lit(n).alias("split"),
                 F.when(F.col(c) <= medians[n], F.lit(lo)).when(F.col(c) > medians[n], F.lit(hi)).alias("half"))
        for n, (c, lo, hi) in variables.items()])
    out = df.withColumn("__s", F.explode(tagged))
    return out.select(*df.columns, "__s.split", "__s.half").where(F.col("half").isNotNull())


def subsample_models(df: DataFrame, variables: dict[str, tuple[str, str, str]], outcome: str,
                     regressors=P.SUBSAMPLE_REGRESSORS, at_least: int = 20) -> DataFrame:
    """A short model in each half of the median splits, all halves in the same two passes."""
    have = {n: v for n, v in variables.items() if v[0] in df.columns}
    long = df.select(*[F.col(c).cast("double").alias(n) for n, (c, _, _) in have.items()]).unpivot(
        [], list(have), "split", "value")
    medians = {r["split"]: (r["m"], r["k"]) for r in exact_quantiles(long, ["split"], "value", {"m": 0.5})
               .join(long.groupBy("split").agg(F.count("value").alias("k")), "split").collect()}
    specs = []
    for n, (c, lo, hi) in have.items():
        m, k = medians.get(n, (None, 0))
        if k < at_least:
            continue
        for label, where in ((lo, F.col(c) <= m), (hi, F.col(c) > m)):
            specs.append(Spec(f"{n}|{label}", outcome, tuple(regressors), 3, where))
    rows = []
    for name, f in fit_many(df, specs).items():
        if f:
            split, label = name.split("|", 1)
            rows.append({"split": split, "subsample": label, "n": f.n, "r2": _digits(f.r2, 3),
                         "b_first": _digits(f.coef.get(regressors[0]), 4),
                         "p_first": _digits(f.p.get(regressors[0]), 3),
                         "b_second": _digits(f.coef.get(regressors[1]), 4)})
    return _report(df.sparkSession, rows, "split string, subsample string, n bigint, r2 double, "
                   "b_first double, p_first double, b_second double")


_IRON = tuple("fe_isda" if c == "soil_index" else c for c in P.STAGE2_REGRESSORS)
#: (label, outcome, soil term, regressors) of the refined models.
REFINED_PLAN = (
    ("Food density, composite", "food_nutrient_density_index", "soil_index", ("soil_index", *P.STAGE1_CONTROLS)),
    ("Food density, iron", "food_nutrient_density_index", "fe_isda", ("fe_isda", *P.STAGE1_CONTROLS)),
    ("Food density, component", "food_nutrient_density_index", "soil_pca1", ("soil_pca1", *P.STAGE1_CONTROLS)),
    ("Diet, composite", "mdd", "soil_index", ("soil_index", *P.DIET_REGRESSORS)),
    ("Diet, iron", "mdd", "fe_isda", ("fe_isda", *P.DIET_REGRESSORS)),
    ("Nutrition, iron", "stunting", "fe_isda", _IRON),
)


def refined_models(df: DataFrame, key: str) -> DataFrame:
    """Food density, diet and nutrition on the composite, on iron and on the first component."""
    table = principal_component(df, key, P.SOIL_INDEX_COLUMNS, "soil_pca1")
    plan = [p for p in REFINED_PLAN if p[2] != "soil_pca1" or "soil_pca1" in table.columns]
    fits = fit_many(table, [Spec(label, y, x) for label, y, _, x in plan])
    rows = [{"model": label, "outcome": y, "soil_term": term, "n": fits[label].n,
             "r2": _digits(fits[label].r2, 3), "b_soil": _digits(fits[label].coef.get(term), 4),
             "p_soil": _digits(fits[label].p.get(term), 3)}
            for label, y, term, _ in plan if fits[label]]
    return _report(df.sparkSession, rows, "model string, outcome string, soil_term string, n bigint, "
                   "r2 double, b_soil double, p_soil double")
