"""Quality rules with adaptive thresholds: fences from mergeable quantile sketches per language and source.

Every ratio is a whole number of thousandths, and a sketch is a histogram with 32 log-linear buckets per power of two:
buckets follow from the bits of the number, sketches merge by adding counts, and a quantile is off by 1/32 at most. All
is whole-number arithmetic, so that any engine gives the same thresholds. The verdict joins a document's ratios with
the fences of its language and source, or of its language, or of all, whichever has enough documents first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, without

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Ratio in thousandths -> (numerator, denominator, least spread, fenced below as well)
RATIOS = {"symbols": ("n_symbols", "n_words", 50, False), "dup_lines": ("n_dup_lines", "n_lines", 100, False),
          "repeats": ("n_repeat_words", "n_words", 50, False), "word_length": ("word_chars", "n_words", 500, True)}
REACH = 3  # spreads beyond a quartile
MIN_ROWS = 200
_STRUCT = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def text_counts(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of a text; zeros for a null one."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode().split()  # bytes part at ASCII blanks only
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [line for line in text.encode().split(b"\n") if line.strip()]
    return (n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, which, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= again
    return int(covered.sum())


def counts(text: Column) -> Column:
    """The ``COUNTS`` of a text column as a struct."""
    @F.pandas_udf(_STRUCT)
    def fn(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=list(COUNTS), dtype=np.int64)

    return fn(text)


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the ``COUNTS`` and ``base_failed`` (too short, or mostly repeated)."""
    df = without(df, [*COUNTS, "base_failed"]).withColumn("_counts", counts(F.col(f"`{text}`")))
    df = df.withColumns({c: F.col(f"_counts.{c}") for c in COUNTS}).drop("_counts")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def bucket(value: Column) -> Column:
    """Log-linear bucket of a whole number: its value below 64, then 32 buckets per power of two."""
    power = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(power * 32 + F.floor(value / F.pow(F.lit(2.0), power)).cast("long"))


def permille(a: str, b: str) -> Column:
    """Thousandths of ``a / b``, rounded down; null where ``b`` is 0."""
    return F.floor(F.try_divide(F.col(a) * 1000, F.col(b)))


def ratios(df: DataFrame) -> DataFrame:
    """``(g_lang, g_source, metric, value)`` of every document that passes the base rules; null groups are ''."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), permille(a, b).alias("value"))
                     for m, (a, b, _, _) in RATIOS.items()])
    return (df.filter("not base_failed").select(*_groups(), F.explode(each).alias("r"))
            .select("g_lang", "g_source", "r.metric", "r.value"))


def _groups() -> list[Column]:
    return [F.coalesce("lang", F.lit("")).alias("g_lang"), F.coalesce("source", F.lit("")).alias("g_source")]


def sketches(df: DataFrame) -> DataFrame:
    """Bucket counts per level: language and source, language, all. Merged from the finest, which is counted once."""
    fine = stored(ratios(df).groupBy("g_lang", "g_source", "metric", bucket(F.col("value")).alias("bucket"))
                  .agg(F.count("*").alias("n"), F.min("value").alias("low")))
    wide = fine.groupBy("g_lang", "metric", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    whole = fine.groupBy("metric", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    return (fine.withColumn("level", F.lit(0))
            .unionByName(wide.withColumns({"level": F.lit(1), "g_source": F.lit("")}))
            .unionByName(whole.withColumns({"level": F.lit(2), "g_lang": F.lit(""), "g_source": F.lit("")})))


def fences(df: DataFrame, min_rows: int = MIN_ROWS, reach: int = REACH) -> DataFrame:
    """``(level, g_lang, g_source, low_<ratio>, high_<ratio>)`` of the levels with ``min_rows`` documents (all: any)."""
    key = ["level", "g_lang", "g_source", "metric"]
    upto = Window.partitionBy(*key).orderBy("bucket")
    s = sketches(df).withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy(*key))})
    s = s.filter((F.col("total") >= min_rows) | (F.col("level") == 2))
    at = lambda part: F.min(F.when(4 * F.col("upto") >= part * F.col("total"), F.col("low")))
    quartiles = s.groupBy(*key).agg(at(1).alias("q1"), at(3).alias("q3"))
    least = F.create_map(*[F.lit(x) for m, r in RATIOS.items() for x in (m, r[2])])[F.col("metric")]
    spread = reach * F.greatest(F.col("q3") - F.col("q1"), least)
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    return quartiles.groupBy("level", "g_lang", "g_source").agg(
        *[pick(m, F.col("q3") + spread).alias(f"high_{m}") for m in RATIOS],
        *[pick(m, F.col("q1") - spread).alias(f"low_{m}") for m, r in RATIOS.items() if r[3]])


def judged(df: DataFrame, min_rows: int = MIN_ROWS, reach: int = REACH) -> DataFrame:
    """Add ``kept`` to a stored table with the counts: false if the base rules fail or a ratio lies beyond a fence."""
    table = stored(fences(df, min_rows, reach))
    names = [c for c in table.columns if c.startswith(("low_", "high_"))]
    level = lambda k: table.filter(F.col("level") == k).select(
        "g_lang", "g_source", *[F.col(c).alias(f"{c}_{k}") for c in names])
    out = df.select("*", *_groups())
    out = out.join(level(0), ["g_lang", "g_source"], "left")
    out = out.join(level(1).drop("g_source"), "g_lang", "left")
    whole = table.filter("level = 2").select(F.struct(*names)).scalar()
    fence = lambda c: F.coalesce(F.col(f"{c}_0"), F.col(f"{c}_1"), whole[c])
    good = ~F.col("base_failed")
    for m, (a, b, _, below) in RATIOS.items():
        value = permille(a, b)
        good &= F.coalesce(value <= fence(f"high_{m}"), F.lit(True))
        if below:
            good &= F.coalesce(value >= fence(f"low_{m}"), F.lit(True))
    return out.withColumn("kept", good).select(*df.columns, "kept")


def quality(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the counts, ``base_failed`` and ``kept`` of every row of a table with ``lang`` and ``source``.

    Null and empty texts have no words and fail; repeated rows are judged alike and count each time in the sketches;
    a null language or source is a group of its own; an empty table gives an empty one.
    """
    rows = with_counts(df.select(F.col(key), "lang", "source", F.col(text).alias("text"))).drop("text")
    return judged(stored(rows)).select(key, *COUNTS, "base_failed", "kept")


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep, with its columns; texts are read and counted once."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), "lang", "source",
                      F.col(text).alias("text"))
    return judged(stored(with_counts(whole).drop("text"))).filter("kept").select("row.*")
