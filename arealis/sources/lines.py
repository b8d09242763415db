"""Text lines to keyed records: (doc_id, line_no, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import presets as P
from ..functions.text import name_key
from ..operators.order import keep_first

NUMBER_TOKEN = r"^-?[\d,]+(?:\.\d+)?$"


def keyed_lines(lines: DataFrame, keys: DataFrame, key: str = "key", at_least: int = 3) -> DataFrame:
    """Lines that start with a known name, of as many words as the longest has, and hold enough numbers.

    Gives the line with its ``key`` (the longest prefix that is one) and ``numbers``. The
    prefixes are joined to the names as an equi-join.
    """
    tokens = F.filter(F.split(F.trim("text"), r"\s+"), lambda t: t != "")
    base = lines.withColumn("__t", tokens)
    k = F.col("k")
    known = keys.select(key).where(F.col(key) != "").distinct()
    longest = F.coalesce(known.agg(F.max(F.size(F.split(key, " ")))).scalar(), F.lit(1))
    tries = base.withColumn("k", F.explode(F.sequence(F.lit(1), longest))).where(
        F.size("__t") > k)
    tail = F.slice("__t", k + 1, F.size("__t") - k)
    numbers = F.transform(F.filter(tail, lambda t: t.rlike(NUMBER_TOKEN)),
                          lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double"))
    tries = tries.select(*lines.columns, "k", name_key(F.array_join(F.slice("__t", F.lit(1), k), " ")).alias(key),
                         numbers.alias("numbers")).where(F.size("numbers") >= at_least)
    hits = tries.join(known, key, "left_semi")
    best = F.max_by(F.struct(key, "numbers"), k)
    return hits.groupBy(*lines.columns).agg(best.alias("b")).select(*lines.columns, f"b.{key}", "b.numbers")


def headings(lines: DataFrame, words=P.LINE_HEADER_WORDS) -> DataFrame:
    """``(doc_id, names)``: of each document the line with most header words, the earliest on ties; its names in order.

    A name stands where the first of its words that the line holds stands.
    """
    low = F.lower("text")
    places = F.array(*[F.struct(F.coalesce(*[F.nullif(F.instr(low, w), F.lit(0)) for w in keywords]).alias("at"),
                                F.lit(canon).alias("canon")) for canon, keywords in words])
    found = lines.select("doc_id", "line_no", F.array_sort(F.filter(places, lambda p: p["at"].isNotNull())).alias("p"))
    best = found.where(F.size("p") > 0).groupBy("doc_id").agg(
        F.min_by("p", F.struct(-F.size("p"), "line_no")).alias("p"))
    return best.select("doc_id", F.transform("p", lambda p: p["canon"]).alias("names"))


def modal_widths(rows: DataFrame) -> DataFrame:
    """``(doc_id, width)``: each document's commonest number of values, the width met first on ties."""
    widths = rows.groupBy("doc_id", F.size("numbers").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    return widths.groupBy("doc_id").agg(F.min_by("w", F.struct(-F.col("n"), "first")).alias("width"))


def parse_lines(lines: DataFrame, area_keys: DataFrame, subarea_keys: DataFrame,
                subarea_wins: bool = True) -> dict[str, DataFrame]:
    """Area and sub-area records from text lines, as ``(doc_id, key, column, value)``.

    Every document has its own table: rows of its commonest width are kept, its heading names the columns when it
    has as many, else the usual layout for that width does. The first record of a name counts.
    """
    keys = area_keys.select(F.col("county_norm").alias("key")).unionByName(
        subarea_keys.select(F.col("subcounty_norm").alias("key")))
    found = keyed_lines(lines, keys)
    sub = (subarea_keys.select(F.col("subcounty_norm").alias("key")) if subarea_wins
           else subarea_keys.select(F.col("subcounty_norm").alias("key")).join(
               area_keys.select(F.col("county_norm").alias("key")), "key", "left_anti"))
    names = headings(lines)
    parts = {"county_norm": found.join(sub, "key", "left_anti"),
             "subcounty_norm": found.join(sub, "key", "left_semi")}
    return {key: _records(rows, key, names) for key, rows in parts.items()}


def _records(rows: DataFrame, key: str, names: DataFrame) -> DataFrame:
    kept = rows.join(modal_widths(rows), "doc_id").where(F.size("numbers") == F.col("width"))
    one = keep_first(kept.select("doc_id", "key", "width", "numbers", "line_no"), ["doc_id", "key"], [F.col("line_no")])
    usual = F.create_map(*[x for w, cols in P.LINE_COLUMNS.items()
                           for x in (F.lit(w), F.array(*[F.lit(c) for c in cols]))])
    plain = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.concat(F.lit("val_"), i.cast("string")))
    columns = (F.when(F.size("names") == F.col("width"), F.col("names"))
               .otherwise(F.coalesce(usual[F.col("width")], plain)))
    return (one.join(names, "doc_id", "left")
            .select("doc_id", F.col("key").alias(key), F.inline(F.arrays_zip(
                columns.alias("column"), F.col("numbers").alias("value")))))
