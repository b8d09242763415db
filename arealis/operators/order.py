"""Exact order statistics, ranks, keep-first and fill-forward that survive hot groups.

A group may hold a third of all rows, so none of these sorts a group in one task. Values are
cut at the same equi-depth bounds for all groups; a (group, bucket) cell then holds at most
about 1/buckets of the distinct values, and only the small table of bucket counts is summed
up along a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from ..session import cut_lineage


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which missing keys match each other; keys come from the left."""
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def default_buckets(df: DataFrame) -> int:
    """A few buckets for each shuffle partition, within bounds the driver can hold."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(16, min(4096, 4 * n))


def _bounds(df: DataFrame, value: str, buckets: int) -> list[float]:
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(value, probs, max(10_000, 20 * buckets)).alias("b")).first()
    return sorted(set(row["b"] or []))


def _with_bucket(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    if not bounds:
        return df.withColumn("__bucket", F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol=value,
                     outputCol="__bucket_d", handleInvalid="keep")
    return cut.transform(df).withColumn("__bucket", F.col("__bucket_d").cast("int")).drop("__bucket_d")


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by, value, n)``: rows of each distinct value, missing ones too. Everything below follows from this table, so
    the input is read for it alone; it is written where a shared folder is set."""
    return cut_lineage(df.groupBy(*by, F.col(value).cast("double").alias(value)).agg(F.count(F.lit(1)).alias("n")))


def weighted_moments(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by, count, mean, std, min, max, missing)`` from a table of value counts; ``std`` is the sample deviation."""
    here = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    n = F.when(here.isNotNull(), F.col("n"))
    first = counts.groupBy(*by).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("count"), (F.sum(n * here) / F.sum(n)).alias("mean"),
        F.min(here).alias("min"), F.max(here).alias("max"),
        F.coalesce(F.sum(F.when(here.isNull(), F.col("n"))), F.lit(0)).alias("missing"))
    off = here - F.col("mean")
    spread = null_safe_join(counts, first.select(*by, "mean", "count"), by).groupBy(*by).agg(
        F.sqrt(F.try_divide(F.sum(n * off * off), F.max("count") - 1)).alias("std"))
    return null_safe_join(first, spread, by)


def _counts_and_offsets(df: DataFrame, by: list[str], value: str, buckets: int | None, counted: bool = False):
    counts = df if counted else value_counts(df, by, value)
    counts = counts.where(F.col(value).isNotNull() & ~F.isnan(value))
    if not by:
        counts, by = counts.withColumn("__all", F.lit(0)), ["__all"]
    # cells need even numbers of distinct values, whatever their rows
    counts = _with_bucket(counts, value, _bounds(counts, value, buckets or default_buckets(df)))
    along = Window.partitionBy(*by).orderBy("__bucket")
    cells = (
        counts.groupBy(*by, "__bucket").agg(F.sum("n").alias("__c"))
        .withColumn("__start", F.coalesce(
            F.sum("__c").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("total", F.sum("__c").over(Window.partitionBy(*by)))
    )
    return counts, cells, by


def value_ranks(df: DataFrame, by: list[str], value: str, buckets: int | None = None) -> DataFrame:
    """Distinct values of each group with their count ``n``, the number of smaller rows
    ``before`` and the group's row count ``total``."""
    counts, cells, keys = _counts_and_offsets(df, by, value, buckets)
    within = (Window.partitionBy(*keys, "__bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (
        null_safe_join(counts, cells, [*keys, "__bucket"])
        .select(*by, value, "n",
                (F.col("__start") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"),
                "total")
    )


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                    buckets: int | None = None, counted: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``.

    Only the buckets that hold a wanted position are sorted. ``counted``: ``df`` is a table of ``value_counts``.
    """
    counts, cells, keys = _counts_and_offsets(df, by, value, buckets, counted)
    pos = {name: F.lit(float(p)) * (F.col("total") - 1) for name, p in probs.items()}
    end = F.col("__start") + F.col("__c")
    wanted = [r for p in pos.values() for r in (F.floor(p), F.ceil(p))]
    hit = reduce(lambda a, b: a | b, [(r >= F.col("__start")) & (r < end) for r in wanted])
    within = (Window.partitionBy(*keys, "__bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    ranked = (
        null_safe_join(counts, cells.where(hit), [*keys, "__bucket"])
        .withColumn("before", F.col("__start") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    )

    def at(rank: Column) -> Column:
        inside = (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))
        return F.max(F.when(inside, F.col(value)))

    aggs = []
    for name, p in pos.items():
        aggs += [at(F.floor(p)).alias(f"__lo_{name}"), at(F.ceil(p)).alias(f"__hi_{name}"),
                 F.max(p - F.floor(p)).alias(f"__w_{name}")]
    picked = ranked.groupBy(*keys).agg(*aggs)
    return picked.select(
        *by, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__w_{n}"))
               .alias(n) for n in probs])


def average_ranks(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Long table ``(key, variable, value, avg_rank, total)``; ties share their mean rank."""
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        key, cols, "variable", "value").where(F.col("value").isNotNull())
    ranks = value_ranks(long, ["variable"], "value")
    return null_safe_join(long, ranks, ["variable", "value"]).select(
        key, "variable", "value",
        (F.col("before") + (F.col("n") + 1) / 2.0).alias("avg_rank"), "total")


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group under a total order.

    A min_by aggregate keeps one row per group and task before the shuffle, where a
    row_number window would sort the whole group in one task.
    """
    return _keep(df, by, order, F.min_by)


def keep_last(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return _keep(df, by, order, F.max_by)


def _keep(df: DataFrame, by: list[str], order: list[Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    row = pick(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    out = df.groupBy(*by).agg(row.alias("__row"))
    return out.select(*[F.col(c) if c in by else F.col(f"__row.{c}") for c in df.columns])


def fill_forward(df: DataFrame, by: list[str], block: str, order: list[str],
                 cols: list[str], exclusive: bool = False) -> DataFrame:
    """Carry the last non-missing value of ``cols`` forward in document order.

    With ``exclusive`` a row sees only what stands before it.

    ``block`` is a coarse position that grows with ``order`` (a page, or a line number
    divided by a constant). Rows are sorted only inside a block; what enters a block comes
    from a table with one row per block.
    """
    keys = [*by, block]
    position = F.struct(*order)
    last_in = (Window.partitionBy(*keys).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow))
    ends = df.groupBy(*keys).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"__end_{c}") for c in cols])
    carried = _carried(ends, by, block, cols)
    out = null_safe_join(df, carried, keys, "left")
    out = out.withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(last_in), F.col(f"__in_{c}")) for c in cols})
    return out.drop(*[f"__in_{c}" for c in cols])


def _carried(ends: DataFrame, by: list[str], block: str, cols: list[str], span: int = 1024) -> DataFrame:
    """What enters each block: from earlier blocks of its span, else from earlier spans.

    The blocks of a group are cut into spans of ``span`` positions, so that a window holds a span's blocks, or a row
    per span of a group.
    """
    place = F.unix_date(block) if isinstance(ends.schema[block].dataType, DateType) else F.col(block)
    spans = ends.withColumn("__span", F.floor(place / span))
    earlier = lambda *parts: Window.partitionBy(*parts[:-1]).orderBy(parts[-1]).rowsBetween(
        Window.unboundedPreceding, -1)
    inside = spans.withColumns({f"__in_{c}": F.last(f"__end_{c}", ignorenulls=True).over(earlier(*by, "__span", block))
                                for c in cols})
    tails = spans.groupBy(*by, "__span").agg(*[
        F.max_by(f"__end_{c}", F.when(F.col(f"__end_{c}").isNotNull(), F.col(block))).alias(f"__tail_{c}") for c in cols])
    tails = tails.select(*by, "__span", *[F.last(f"__tail_{c}", ignorenulls=True).over(earlier(*by, "__span")).alias(
        f"__before_{c}") for c in cols])
    out = null_safe_join(inside, tails, [*by, "__span"])
    return out.select(*by, block, *[F.coalesce(f"__in_{c}", f"__before_{c}").alias(f"__in_{c}") for c in cols])
