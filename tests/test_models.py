"""Statistics against independent numpy on small data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arealis.operators import autocorrelation as AC
from arealis.operators import clustering as C
from arealis.operators import multilevel as M
from arealis.operators import regression as R
from arealis.operators import spatial as S
from arealis.operators import typology as TY


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    n = 120
    d = pd.DataFrame(rng.normal(size=(n, 3)), columns=list("abc"))
    d["c"] = d.c * 1e-3 + 1e4
    d["g"] = rng.integers(0, 8, n)
    d["y"] = 2 + 3 * d.a - d.b + rng.normal(size=8)[d.g] * 0.8 + rng.normal(size=n) * (1 + abs(d.a))
    d["id"] = range(n)
    return d


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data).persist()


def hc3(X, y):
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    e = y - X @ b
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    return b, np.sqrt(np.diag(inv @ (X.T * (e / (1 - h)) ** 2) @ X @ inv)), 1 - e @ e / ((y - y.mean()) ** 2).sum()


def test_hc3_equals_numpy(frame, data):
    f = R.fit(frame, "y", ["a", "b", "c", "absent"])
    centred = data.c - data.c.mean()
    b, se, r2 = hc3(np.c_[np.ones(len(data)), data.a, data.b, centred], data.y.values)
    assert [f.coef[k] for k in "abc"] == pytest.approx(list(b[1:]), rel=1e-6)
    assert [f.se[k] for k in "abc"] == pytest.approx(list(se[1:]), rel=1e-6)
    assert f.r2 == pytest.approx(r2) and f.used == ["a", "b", "c"]
    resid = [r.e for r in frame.select("id", f.residual().alias("e")).orderBy("id").collect()]
    assert abs(sum(resid)) < 1e-4


def test_incomplete_rows_and_small_samples(spark, data):
    d = data[["y", "a"]].copy()
    d.loc[0, "a"] = np.inf
    d.loc[1, "y"] = np.nan
    f = R.fit(spark.createDataFrame(d), "y", ["a"])
    b, se, _ = hc3(np.c_[np.ones(len(d) - 2), d.a[2:]], d.y.values[2:])
    assert f.n == len(d) - 2 and f.coef["a"] == pytest.approx(b[1]) and f.se["a"] == pytest.approx(se[1])
    assert R.fit(spark.createDataFrame(data[["y", "a"]].head(5)), "y", ["a"]) is None
    assert R.fit(spark.createDataFrame(data[["y"]]), "y", ["a"]) is None


def test_random_intercept_is_the_reml_optimum(frame, data):
    fit = M.random_intercept(frame, "y", ["a", "b"], "g")
    X, y, n = np.c_[np.ones(len(data)), data.a, data.b], data.y.values, len(data)
    same = np.equal.outer(data.g.values, data.g.values).astype(float)

    def profile(ratio):
        inv = np.linalg.inv(np.eye(n) + ratio * same)
        xx = X.T @ inv @ X
        b = np.linalg.solve(xx, X.T @ inv @ y)
        r = y - X @ b
        s = r @ inv @ r / (n - 3)
        ll = -0.5 * ((n - 3) * np.log(s) - np.linalg.slogdet(inv)[1] + np.linalg.slogdet(xx)[1])
        return ll, b, s, np.sqrt(np.diag(s * np.linalg.inv(xx)))

    ratio = fit.group_var / fit.scale
    ll, b, s, se = profile(ratio)
    assert all(profile(ratio * f)[0] <= ll + 1e-9 for f in (0.9, 0.99, 1.01, 1.1))
    assert list(fit.coef.values()) == pytest.approx(list(b), rel=1e-6)
    assert list(fit.se.values()) == pytest.approx(list(se), rel=1e-6) and fit.scale == pytest.approx(s)


def test_no_group_variance_stays_on_the_boundary(spark):
    rng = np.random.default_rng(3)
    d = pd.DataFrame({"x": np.tile([0.0, 1.0, 2.0, 3.0], 10), "g": np.repeat(range(10), 4)})
    d["y"] = d.x + np.tile([0.5, -0.5, -0.5, 0.5], 10) * rng.choice([1, 1.1], 40)
    fit = M.random_intercept(spark.createDataFrame(d), "y", ["x"], "g")
    assert fit.group_var == pytest.approx(0.0, abs=1e-6)


def test_moran_is_invariant_and_equals_numpy(spark):
    n = 9
    W = np.zeros((n, n))
    for i in range(n):
        W[i, [(i - 1) % n, (i + 1) % n]] = 0.5
    edges = spark.createDataFrame([(i, j, float(W[i, j])) for i in range(n) for j in range(n) if W[i, j]], "src int, dst int, w double")
    x = np.arange(n) ** 1.5
    z = x - x.mean()
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, x double")
    got = AC.morans_i(df, edges, "id", "x", permutations=99).first()
    assert got.morans_i == pytest.approx(z @ W @ z / (z @ z)) and got.expected_i == -1 / 8
    again = AC.morans_i(df.withColumn("x", F.col("x") * -3 + 7), edges, "id", "x", permutations=99).first()
    assert again.morans_i == pytest.approx(got.morans_i) and again.perm_p == got.perm_p
    flat = AC.morans_i(df.withColumn("x", F.lit(1.0)), edges, "id", "x").first()
    assert flat.morans_i is None and flat.perm_p is None


def test_permutations_are_bijections(spark):
    p = AC.permuted_positions(spark.range(30).withColumnRenamed("id", "k"), "k", 20, 42).toPandas()
    assert all(sorted(g.position) == list(range(1, 31)) for _, g in p.groupby("perm"))


@pytest.mark.parametrize("n", [1, 2, 3, 24, 1000])
def test_keyed_bijection(n):
    drawn = [AC.permuted(np.arange(n), n, AC.round_keys(n, k, 42)) for k in range(60)]
    assert (drawn[0] == np.arange(n)).all() and all(sorted(d) == list(range(n)) for d in drawn)
    if n == 24:  # every place is about equally likely
        at = np.bincount(np.concatenate([AC.permuted(np.arange(n), n, AC.round_keys(n, k, 1))[:1] for k in range(1, 2401)]), minlength=n)
        assert 60 < at.min() and at.max() < 145


def test_statistics_of_held_and_of_many_nodes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = spark.createDataFrame([(f"n{i:02d}", float(v), float(i % 7)) for i, v in enumerate(rng.normal(size=40))], "id string, x double, y double")
    edges = S.standardise_edges(spark.createDataFrame([(f"n{a:02d}", f"n{(a + d) % 40:02d}", 1.0) for a in range(40) for d in (1, 2, 39)], "src string, dst string, w double"))
    held = {r.variable: r for r in AC.morans_of_complete(values, edges, "id", ["x", "y"], 199).collect()}
    monkeypatch.setattr(AC, "EDGES_HELD", 1)
    in_parts = {r.variable: r for r in AC.morans_of_complete(values, edges.repartition(3), "id", ["x", "y"], 199).collect()}
    monkeypatch.setattr(AC, "NODES_HELD", 10)
    many = {r.variable: r for r in AC.morans_of_complete(values, edges, "id", ["x", "y"], 199).collect()}
    for c in "xy":
        assert held[c].n == many[c].n == 40 and held[c].morans_i == pytest.approx(many[c].morans_i)
        assert held[c].perm_p == in_parts[c].perm_p and held[c].perm_p == pytest.approx(many[c].perm_p, abs=0.12)
    alone = AC.morans_i(values, edges.where("src = 'none'"), "id", "x", 99).first()
    assert (alone.n, alone.morans_i, alone.perm_p) == (40, None, None)


def test_statistic_without_a_test_needs_no_order_of_nodes(spark, monkeypatch):
    values = spark.createDataFrame([(k, float(k * k % 17), float(k % 5), 1.0) for k in range(40)], "id int, x double, y double, z double")
    edges = spark.createDataFrame([(k, (k + d) % 45, 0.5 + d) for k in range(42) for d in (1, 3)], "src int, dst int, w double")
    want = {r.variable: r for r in AC.morans_of_complete(values, edges, "id", ["x", "y", "z"], 1).collect()}
    monkeypatch.setattr(AC, "_rows_of_held", None)
    monkeypatch.setattr(AC, "permuted_positions", None)
    got = {r.variable: r for r in AC.morans_of_complete(values, edges, "id", ["x", "y", "z"], 0).collect()}
    for c in ("x", "y", "z"):
        assert got[c].morans_i == (want[c].morans_i and pytest.approx(want[c].morans_i)) and got[c].perm_p is None
        assert (got[c].n, got[c].expected_i) == (want[c].n, want[c].expected_i)
    alone = AC.morans_of_complete(values, edges.where("w < 0"), "id", ["x"], 0).first()
    assert (alone.n, alone.morans_i, alone.expected_i) == (40, None, None)


def test_both_passes_of_a_fit_give_a_matrix_per_task(spark, monkeypatch):
    rng, rows = np.random.default_rng(3), []
    for k in range(300):
        a, b = rng.normal(1e6, 1, 2)
        rows.append((None if k % 50 == 7 else float(a), float("nan") if k % 60 == 9 else float(b), float(a - 2 * b + rng.normal())))
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(5)
    specs = [R.Spec("both", "y", ("a", "b")), R.Spec("one", "y", ("a",)), R.Spec("few", "y", ("a",), where=F.col("b") > 2e6)]
    monkeypatch.setattr(F, "covar_pop", None)  # 78 of them for eleven terms are more than a compiled aggregate holds
    got = R.fit_many(df, specs)
    assert got["few"] is None
    for name, terms in (("both", (0, 1)), ("one", (0,))):
        used = np.array([r for r in rows if all(r[c] is not None and not math.isnan(r[c]) for c in terms)], float)
        X, y = used[:, terms] - 1e6, used[:, 2]
        X = np.column_stack([np.ones(len(y)), X])
        inv = np.linalg.inv(X.T @ X)
        beta = inv @ X.T @ y
        u = ((y - X @ beta) / (1 - np.einsum("ij,jk,ik->i", X, inv, X))) ** 2
        se = np.sqrt(np.diag(inv @ (X.T * u) @ X @ inv))
        assert got[name].n == len(y)
        for k, c in enumerate("ab"[:len(terms)]):
            assert got[name].coef[c] == pytest.approx(beta[k + 1], rel=1e-6) and got[name].se[c] == pytest.approx(se[k + 1], rel=1e-6)


def test_silhouette_takes_equal_vectors_once(spark):
    x = np.random.default_rng(2).normal(size=(30, 12))
    copies = np.concatenate([x, x[:20], x[:5], x[:5]])
    best = {k: x[:k] for k in (2, 4)}
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(copies)], "h bigint, v array<double>")
    got = C.silhouettes(rows, best)
    d = np.sqrt(((copies[:, None] - copies[None]) ** 2).sum(2))
    for k, c in best.items():
        own = ((copies[:, None] - c[None]) ** 2).sum(2).argmin(1)
        score = []
        for i in range(len(copies)):
            mean = [d[i, own == j].sum() / max(1, (own == j).sum() - (own[i] == j)) for j in range(k)]
            a, b = mean[own[i]], min(m for j, m in enumerate(mean) if j != own[i])
            score.append((b - a) / max(a, b) if (own == own[i]).sum() > 1 else 0.0)
        assert got[k] == pytest.approx(np.mean(score))
    # 120,000 rows would have 7 x 10^9 distances, their 30 vectors have 435
    many = rows.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(1999)))).select(F.xxhash64("h", "v").alias("h"), "v")
    assert C.silhouettes(many, best)[4] > got[4]


def test_first_component_of_nearly_uncorrelated_columns(spark, tmp_path):
    from arealis.plans.catalogue import ORACLES, QUERIES
    from tools.compare import compare

    import duckdb

    # columns of a full grid are uncorrelated; a little of one in another parts the eigenvalues by about 2e-5
    duckdb.sql(f"""copy (select i::int as l_orderkey, 1::int as l_linenumber, (i * 7)::int as l_partkey, (i % 10)::double as l_quantity,
        (i // 10 % 10 + 0.00001 * (i % 10))::double as l_extendedprice, (i // 100)::double as l_discount from range(1000) r(i))
        to '{tmp_path}/lineitem.parquet' (format parquet)""")
    import tools.compare as T
    kept, T.TABLES = T.TABLES, ["lineitem"]
    try:
        result, _ = compare(spark, str(tmp_path), "first_component", QUERIES["first_component"], ORACLES["first_component"])
    finally:
        T.TABLES = kept
    assert result.startswith("ok"), result


def test_many_nodes_are_permuted_in_a_few_tasks_each(spark, monkeypatch):
    n = 300
    rng = np.random.default_rng(5)
    x = rng.permutation(n) * 1.0
    near = [(i, j, 1.0) for i in range(n) for j in (i - 1, i + 1, i + 17, i - 17) if 0 <= j < n]
    edges = S.standardise_edges(spark.createDataFrame(near, "src bigint, dst bigint, w double"))
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id bigint, x double")
    held = AC.morans_of_complete(values, edges, "id", ["x"], 99).first()
    w = np.zeros((n, n))
    for i, j, _ in near:
        w[i, j] = 1
    w, z = w / w.sum(1)[:, None], x - x.mean()
    drawn = [z[AC._permuted_wide(np.arange(n), n, AC.round_keys(n, k, 42))] for k in range(100)]
    i = np.array([d @ w @ d / (z @ z) for d in drawn])
    assert held.morans_i == pytest.approx(i[0]) and held.perm_p == (np.sum(abs(i[1:] + 1 / 299) >= abs(i[0] + 1 / 299) - 1e-12) + 1) / 100
    monkeypatch.setattr(AC, "NODES_COLLECTED", 10)
    monkeypatch.setattr(AC, "NODES_A_TASK", 64)
    numbered = AC.morans_of_complete(values, edges, "id", ["x"], 99).first()
    assert (numbered.morans_i, numbered.perm_p) == (pytest.approx(held.morans_i), held.perm_p)
    # beyond what a task holds permutations are dealt a few at a time, with the same result
    monkeypatch.setattr(AC, "NODES_HELD", 10)
    whole = AC.morans_of_complete(values, edges, "id", ["x"], 9).first()
    monkeypatch.setattr(AC, "ROWS_DEALT", 4 * n)
    dealt = AC.morans_of_complete(values, edges, "id", ["x"], 9).first()
    assert (dealt.morans_i, dealt.perm_p) == (pytest.approx(whole.morans_i), whole.perm_p)


def test_permutations_in_32_bits():
    for n in (2, 3, 1000, 9_000_000, (1 << 28) - 1):
        x = np.random.default_rng(n).integers(0, n, 20_000)
        keys = AC.round_keys(n, 3, 42)
        assert (AC.permuted(x, n, keys) == AC._permuted_wide(x, n, keys)).all()


def test_first_component(frame, data):
    got = np.array([r.p for r in TY.principal_component(frame, "id", ["a", "b", "y"], "p").orderBy("id").select("p").collect()])
    Z = data[["a", "b", "y"]]
    Z = ((Z - Z.mean()) / Z.std(ddof=0)).values
    u, s, vt = np.linalg.svd(Z, full_matrices=False)
    v = vt[0] if vt[0].mean() >= 0 else -vt[0]
    assert np.allclose(got, Z @ v, atol=1e-8)


def test_typology_needs_rows(spark):
    few = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 1.0)], "k int, a double, b double")
    out, info = TY.typology(few, "k", ["a", "b"], range(3, 5), n_init=1)
    assert info is None and out.where("soil_zone is not null").count() == 0
    rows = [(i, float(i % 3) * 10 + 0.1 * (i % 5), float(i % 3) * 10) for i in range(30)] + [(30, None, 1.0)]
    out, info = TY.typology(spark.createDataFrame(rows, "k int, a double, b double"), "k", ["a", "b"], range(3, 5), n_init=2)
    assert info["k"] == 3 and out.where("k = 30 and soil_zone is null").count() == 1


@pytest.mark.parametrize("block", [2048, 16])
def test_silhouettes_by_brute_force(spark, block):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, s, (n, 3)) for c, s, n in ((0, 1, 60), (3, 0.5, 40), (8, 2, 30), (40, 1, 1))])
    rows = spark.createDataFrame([(i * 7919, v.tolist()) for i, v in enumerate(x)], "h bigint, v array<double>")
    best = {k: x[rng.choice(len(x), k, replace=False)] for k in (2, 3, 5)} | {1: x[:1]}
    got = C.silhouettes(rows, best, block)
    far = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for k, centres in best.items():
        label = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        scores = []
        for i in range(len(x)):
            mine = (label == label[i]) & (np.arange(len(x)) != i)
            if k == 1 or not mine.any():
                scores.append(0.0)
                continue
            a, b = far[i][mine].mean(), min(far[i][label == j].mean() for j in set(label) - {label[i]})
            scores.append((b - a) / max(a, b))
        assert got[k] == pytest.approx(np.mean(scores))


def test_shared_passes_reach_fixed_points(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 1, (50, 2)) for c in ((0, 0), (9, 0), (0, 9), (9, 9))])
    rows = spark.createDataFrame([(i * 104729, v.tolist()) for i, v in enumerate(x)], "h bigint, v array<double>")
    first = C.seeds(rows, 4, 3, 42)
    assert all(any((s == v).all() for v in x) for c in first for s in c)  # seeds are rows
    assert any(len({tuple((s > 4.5).tolist()) for s in c}) == 4 for c in first)  # one in each heap
    best = C.best_centres(rows, [1, 4], 3, 42)
    label = ((x[:, None] - best[4]) ** 2).sum(2).argmin(1)
    assert np.allclose(best[4], [x[label == j].mean(0) for j in range(4)], atol=1e-6) and np.allclose(best[1], x.mean(0))
    again = C.best_centres(rows.repartition(5), [4], 3, 42)  # whatever the layout
    assert np.allclose(sorted(map(tuple, again[4])), sorted(map(tuple, best[4])))


# --- the model family on one made area table -------------------------------------------------

@pytest.fixture(scope="module")
def areas_data():
    from arealis import presets as P

    rng = np.random.default_rng(5)
    names = sorted({c for y, x in P.SPECIFICATIONS.values() for c in (y, *x)} | {*P.SOIL_INDEX_COLUMNS, "mdd", "wasting", "underweight"})
    d = pd.DataFrame(rng.normal(size=(90, len(names))), columns=names)
    d["stunting"] += 2 * d.soil_index - d.wealth_factor_mean
    d["food_nutrient_density_index"] += d.soil_index
    d.loc[:20, "mdd"] = np.nan
    d["area"] = [f"a{i:02d}" for i in range(len(d))]
    return d


@pytest.fixture(scope="module")
def areas_frame(spark, areas_data):
    return spark.createDataFrame(areas_data).select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in spark.createDataFrame(areas_data).dtypes])


def numpy_fit(d, y, x):
    full = d[[y, *x]].dropna()
    b, se, r2 = hc3(np.c_[np.ones(len(full)), full[list(x)]], full[y].values)
    p = [math.erfc(abs(t) / math.sqrt(2)) for t in b / se]
    return dict(zip(["Intercept", *x], zip(b, se, p))), len(full), r2


def test_named_models_and_p_values(spark, areas_frame, areas_data):
    from arealis import presets as P

    rows = R.coefficient_table(spark, R.fit_many(areas_frame, R.named_specs())).collect()
    assert {r.model for r in rows} == set(P.SPECIFICATIONS)
    for name, (y, x) in P.SPECIFICATIONS.items():
        want, n, r2 = numpy_fit(areas_data, y, x)
        mine = {r.term: r for r in rows if r.model == name}
        assert set(mine) == set(want)
        for term, (b, se, p) in want.items():
            assert (mine[term].coef, mine[term].se, mine[term].p) == pytest.approx((b, se, p), rel=1e-6, abs=1e-12)
            assert mine[term].n == n and mine[term].r2 == pytest.approx(r2)


def test_other_outcomes_variants_and_refined_models(areas_frame, areas_data):
    from arealis import presets as P

    got = {r.outcome: r for r in R.alternative_outcomes(areas_frame).collect()}
    assert set(got) == {label for _, label in P.OUTCOME_LABELS}
    for c, label in P.OUTCOME_LABELS:
        want, n, r2 = numpy_fit(areas_data, c, P.STAGE2_REGRESSORS)
        assert got[label].n == n and got[label].r2 == round(r2, 3)
        assert got[label].b_soil_index == pytest.approx(want["soil_index"][0], abs=6e-5)
        assert got[label].p_food_density == pytest.approx(want["food_nutrient_density_index"][2], abs=6e-4)
    z = (areas_data[list(P.SOIL_INDEX_COLUMNS)] - areas_data[list(P.SOIL_INDEX_COLUMNS)].mean()) / areas_data[
        list(P.SOIL_INDEX_COLUMNS)].std(ddof=0)
    d = areas_data.assign(soil_index_z=z.mean(axis=1))
    want, n, _ = numpy_fit(d, "food_nutrient_density_index", ("soil_index_z", *P.STAGE1_CONTROLS))
    variants = {r.term: r for r in R.index_variant_models(
        areas_frame, "area", P.SOIL_INDEX_COLUMNS, "food_nutrient_density_index", P.STAGE1_CONTROLS).collect()}
    assert set(variants) == {"soil_index_z", "soil_index_minmax", "soil_index_rank"}
    assert variants["soil_index_z"].b == pytest.approx(want["soil_index_z"][0], abs=6e-5)
    assert variants["soil_index_z"].p == pytest.approx(want["soil_index_z"][2], abs=6e-4)
    refined = {r.model: r for r in R.refined_models(areas_frame, "area").collect()}
    assert len(refined) == 6
    want, n, _ = numpy_fit(areas_data, "mdd", ("fe_isda", *P.DIET_REGRESSORS))
    assert refined["Diet, iron"].n == n == 69
    assert refined["Diet, iron"].b_soil == pytest.approx(want["fe_isda"][0], abs=6e-5)
    u, s, v = np.linalg.svd(z.values, full_matrices=False)
    pca = z.values @ (v[0] if v[0].mean() >= 0 else -v[0])
    want, _, _ = numpy_fit(areas_data.assign(soil_pca1=pca), "food_nutrient_density_index", ("soil_pca1", *P.STAGE1_CONTROLS))
    assert refined["Food density, component"].b_soil == pytest.approx(want["soil_pca1"][0], abs=6e-5)


def test_residuals_and_lags_equal_numpy(spark, areas_frame, areas_data):
    n = len(areas_data)
    W = np.zeros((n, n))
    for i in range(n):
        W[i, [(i - 1) % n, (i + 1) % n]] = 0.5
    names = areas_data.area.tolist()
    edges = spark.createDataFrame([(names[i], names[j], 0.5) for i in range(n) for j in range(n) if W[i, j]],
                                  "src string, dst string, w double")
    x = ("soil_index", "ag_land_share")
    X = np.c_[np.ones(n), areas_data[list(x)]]
    y = areas_data.stunting.values
    e = y - X @ np.linalg.lstsq(X, y, rcond=None)[0]
    fits = R.fit_many(areas_frame, [R.Spec("m", "stunting", x)])
    row = AC.residual_autocorrelation(areas_frame, edges, "area", fits, permutations=99, digits=9).first()
    z = e - e.mean()
    assert row.variable == "m" and row.morans_i == pytest.approx(z @ W @ z / (z @ z), abs=1e-8) and 0 < row.perm_p <= 1
    fit, test = AC.lagged_model(areas_frame, edges, "area", "stunting", x, ["soil_index"], permutations=19, digits=9)
    want, _, r2 = numpy_fit(areas_data.assign(w_soil_index=W @ areas_data.soil_index.values), "stunting", (*x, "w_soil_index"))
    assert fit.coef["w_soil_index"] == pytest.approx(want["w_soil_index"][0]) and fit.r2 == pytest.approx(r2)
    assert test.count() == 1


def test_zones_are_at_a_fixed_point(spark):
    rng = np.random.default_rng(7)
    centres = np.array([[0, 0, 0], [6, 0, 0], [0, 6, 0], [0, 0, 6]], float)
    d = pd.DataFrame(np.repeat(centres, 30, 0) + rng.normal(size=(120, 3)), columns=list("abc"))
    d["id"] = range(120)
    zones, info = TY.typology(spark.createDataFrame(d), "id", list("abc"), n_init=3)
    got = zones.toPandas().sort_values("id")
    assert info["k"] == 4
    z = ((d[list("abc")] - d[list("abc")].mean()) / d[list("abc")].std(ddof=0)).values
    zone = got.soil_zone.values
    means = np.array([z[zone == k].mean(0) for k in range(4)])
    assert (((z[:, None] - means) ** 2).sum(2).argmin(1) == zone).all()


def test_ranks_do_not_need_row_keys(spark):
    rows = [(1.0, 5.0), (2.0, 4.0), (2.0, 4.0), (3.0, 1.0), (4.0, 2.0)]
    df = spark.createDataFrame([("same", *r) for r in rows], "k string, a double, b double")
    got = {r.variable: r for r in TY.rank_correlation(df, ["a", "b"]).collect()}
    want = pd.DataFrame(rows).rank().corr().iloc[0, 1]
    assert got["a"].b == got["b"].a == round(want, 3) and got["a"].a == 1.0


def test_large_group_variance_is_followed(spark):
    rng = np.random.default_rng(9)
    d = pd.DataFrame({"x": rng.normal(size=400), "g": np.repeat(range(20), 20)})
    d["y"] = d.x + 1e4 * rng.normal(size=20)[d.g] + rng.normal(size=400)
    fit = M.random_intercept(spark.createDataFrame(d), "y", ["x"], "g")
    assert fit.group_var / fit.scale > 1e6 and fit.coef["x"] == pytest.approx(1.0, abs=0.2)
    assert M.random_intercept(spark.createDataFrame(d), "y", ["x"], "g", min_rows=401) is None
    assert M.random_intercept(spark.createDataFrame(d), "y", ["x"], "g", min_groups=21) is None


def test_household_recode_stands_in_for_child_anaemia(spark):
    from arealis.operators.survey import nutrition_table

    kids = spark.createDataFrame([("a", 1_000_000, -300, 0, 0, None), ("b", 1_000_000, 0, 0, 0, None)],
                                 "county_norm string, v005 int, hw70 int, hw71 int, hw72 int, hw57 int")
    house = spark.createDataFrame([("a", 1_000_000, 1), ("a", 1_000_000, 4), ("b", 3_000_000, 4)],
                                  "county_norm string, hv005 int, hc57 int")
    names = spark.createDataFrame([("K1", "A", "a"), ("K2", "B", "b")], "county_code string, county_name string, county_norm string")
    got = {r.county_norm: r for r in nutrition_table(kids, names, household=house).collect()}
    assert (got["a"].child_anaemia, got["b"].child_anaemia, got["a"].stunting) == (50.0, 0.0, 100.0)
    own = kids.withColumn("hw57", F.lit(4))
    got = {r.county_norm: r for r in nutrition_table(own, names, household=house).collect()}
    assert got["a"].child_anaemia == 0.0
