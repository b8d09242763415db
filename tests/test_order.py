import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from arealis.operators.order import average_ranks, exact_quantiles, fill_forward, keep_first, keep_last, value_ranks


def hot(spark, n=3000):
    """One group with most rows, many ties, a missing value, a group of one."""
    rng = np.random.default_rng(1)
    v = np.round(rng.exponential(5, n), 1)
    g = np.where(rng.random(n) < 0.8, "hot", np.where(rng.random(n) < 0.5, "b", None))
    pdf = pd.DataFrame({"id": range(n), "g": g, "v": v})
    rows = [(int(i), x, float(y)) for i, x, y in pdf.itertuples(index=False)] + [(n, "one", 4.0), (n + 1, "hot", None)]
    return spark.createDataFrame(rows, "id int, g string, v double"), pd.DataFrame(rows, columns=["id", "g", "v"])


def test_quantiles_of_a_hot_group(spark):
    df, pdf = hot(spark)
    got = {r["g"]: (r["m"], r["q"]) for r in exact_quantiles(df, ["g"], "v", {"m": 0.5, "q": 0.9}).collect()}
    for g, x in pdf.fillna({"g": "none"}).groupby("g").v:
        m, q = got[None if g == "none" else g]
        assert np.isclose(m, x.median()) and np.isclose(q, x.quantile(0.9))


def test_quantiles_without_groups_and_with_one_value(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 2.0
    assert value_ranks(df, [], "v").first()["n"] == 5


def test_average_ranks_share_ties(spark):
    df, pdf = hot(spark)
    got = average_ranks(df, "id", ["v"]).toPandas().set_index("id").avg_rank
    want = pdf.set_index("id").v.rank().dropna()
    assert np.allclose(got.sort_index(), want.sort_index())


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None), ("a", 1, "z")], "k string, o int, v string")
    order = [F.col("o"), F.col("v")]
    assert {(r.k, r.v) for r in keep_first(df, ["k"], order).collect()} == {("a", "y"), ("b", None)}
    assert {(r.k, r.v) for r in keep_last(df, ["k"], order).collect()} == {("a", "x"), ("b", None)}


def test_fill_forward_across_blocks(spark):
    rows = [("d", p, i, v) for p, i, v in [(0, 1, None), (0, 2, "a"), (1, 1, None), (3, 1, None), (3, 2, "b"), (4, 1, None)]]
    df = spark.createDataFrame(rows, "doc string, page int, i int, v string")
    got = {(r.page, r.i): r.v for r in fill_forward(df, ["doc"], "page", ["i"], ["v"]).collect()}
    assert got == {(0, 1): None, (0, 2): "a", (1, 1): "a", (3, 1): "a", (3, 2): "b", (4, 1): "b"}
    prev = {(r.page, r.i): r.v for r in fill_forward(df, ["doc"], "page", ["i"], ["v"], exclusive=True).collect()}
    assert prev[(3, 2)] == "a" and prev[(4, 1)] == "b" and prev[(0, 2)] is None


def test_carrying_over_many_blocks(spark):
    n = 5000
    df = spark.range(n).select(F.lit("d").alias("doc"), F.col("id").alias("page"), F.lit(0).alias("i"),
                               F.when(F.col("id") % 1700 == 3, F.col("id")).alias("v"))
    got = {r.page: r.v for r in fill_forward(df, ["doc"], "page", ["i"], ["v"]).collect()}
    last = None
    for k in range(n):
        last = k if k % 1700 == 3 else last
        assert got[k] == last
