"""Missing-value and rounding rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and the infinities become NULL."""
    x = as_col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def known(pred: Column) -> Column:
    """A comparison with a missing value is false, not NULL."""
    return F.coalesce(pred, F.lit(False))


def indicator(pred: Column) -> Column:
    """0/1 with missing read as 0."""
    return known(pred).cast("double")


def safe_ratio(num: str | Column, den: str | Column, scale: float = 1.0) -> Column:
    """``scale * num / den`` where ``den`` is positive, else NULL."""
    n, d = as_col(num).cast("double"), as_col(den).cast("double")
    if scale != 1.0:
        n = n * F.lit(float(scale))
    return F.when(d > 0, n / d)


def row_mean(cols: list[Column]) -> Column:
    """Mean of the non-missing cells of a row; NULL when there is none."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(present > 0, total / present)


def with_stats(df: DataFrame, aggs: dict[str, Column], build) -> DataFrame:
    """Add columns that need one-row statistics of the whole table.

    The statistics are a scalar subquery: one aggregate with map-side partials whose row comes
    back as a value, so there is neither a join nor a single-partition window. ``build`` maps
    the struct of statistics to new columns; the struct is named once, so the subquery is
    planned once however many columns use it.
    """
    row = df.agg(F.struct(*[e.alias(n) for n, e in aggs.items()]).alias("s")).scalar()
    return df.withColumn("__g", row).withColumns(build(F.col("__g"))).drop("__g")


def standard_scores(g: Column, columns: list[str]) -> list[Column]:
    """z-scores from the statistics of ``score_stats``."""
    return [zscore(c, g[f"m_{c}"], g[f"s_{c}"]) for c in columns]


def score_stats(columns: list[str]) -> dict[str, Column]:
    """Mean and population deviation of each column."""
    return {**{f"m_{c}": F.avg(c) for c in columns}, **{f"s_{c}": F.stddev_pop(c) for c in columns}}


def zscore(x: str | Column, mean: Column, sd: Column) -> Column:
    """Standard score; a column without spread scores 0 where present."""
    v = as_col(x).cast("double")
    return F.when(sd == 0, v * 0.0).otherwise((v - mean) / sd)


def round_half_even(c: str | Column, digits: int = 0) -> Column:
    return F.bround(as_col(c), digits)


def listwise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose named columns are all present and finite."""
    return df.where(reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in cols]))
