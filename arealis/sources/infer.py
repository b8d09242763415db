"""Types of text columns across many files from one mergeable aggregate.

The lattice is null < long < double < string and null < date < string; a column has the least type that holds all of its
cells. Missing marks count as null. Each cell gives one code, a column the union of its codes, so that any number of
columns and files takes one pass with map-side partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that mean a missing value (fixed values).
MISSING = ("", "na", "n/a", "nan", "null", "none")
_LONG, _DOUBLE, _DATE, _STRING = 1, 2, 4, 8
_WHOLE = r"^[+-]?[0-9]{1,18}$"
_REAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]{1,3})?$"
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def cell_code(c: Column) -> Column:
    """Bit of a cell's least type; 0 for a missing one. Whole numbers beyond 18 digits are doubles."""
    text = F.trim(c)
    return (F.when(c.isNull() | F.lower(text).isin(*MISSING), 0).when(text.rlike(_WHOLE), _LONG).when(text.rlike(_REAL), _DOUBLE)
            .when(text.rlike(_DAY) & text.try_cast("date").isNotNull(), _DATE).otherwise(_STRING))


def joined_type(codes: Column) -> Column:
    """Name of the least type that holds all cells whose codes were united."""
    numbers = codes.bitwiseAND(F.lit(_LONG | _DOUBLE)) > 0
    return (F.when(codes == 0, "null").when((codes.bitwiseAND(F.lit(_STRING)) > 0) | (numbers & (codes.bitwiseAND(F.lit(_DATE)) > 0)), "string")
            .when(codes.bitwiseAND(F.lit(_DATE)) > 0, "date").when(codes.bitwiseAND(F.lit(_DOUBLE)) > 0, "double").otherwise("long"))


def column_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, type, n_filled)`` of text columns; an empty table's columns are ``null``."""
    columns = columns or df.columns
    coded = df.select(*[cell_code(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])
    row = coded.agg(*[F.struct(F.coalesce(F.bit_or(f"c{i}"), F.lit(0)).alias("codes"), F.count(F.when(F.col(f"c{i}") > 0, 1)).alias("n")).alias(f"c{i}")
                      for i in range(len(columns))])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("s")) for i, c in enumerate(columns)])
    return row.select(F.explode(each).alias("e")).select(
        "e.column", joined_type(F.col("e.s.codes")).alias("type"), F.col("e.s.n").alias("n_filled"))


def long_types(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """The same of cells in long form, a row per ``by`` (file, column)."""
    return cells.select(*by, cell_code(F.col(value)).alias("__c")).groupBy(*by).agg(
        F.bit_or("__c").alias("__c"), F.count(F.when(F.col("__c") > 0, 1)).alias("n_filled")).select(
        *by, joined_type(F.col("__c")).alias("type"), "n_filled")


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to the types found; missing marks become null."""
    def one(c: str) -> Column:
        text = F.col(f"`{c}`")
        clean = F.when(~F.lower(F.trim(text)).isin(*MISSING), F.trim(text) if types.get(c) not in (None, "string") else text)
        return clean.try_cast({"long": "bigint", "null": "string"}.get(types.get(c, "string"), types.get(c, "string"))).alias(c)

    return df.select(*map(one, df.columns))


def read_inferred(df: DataFrame) -> DataFrame:
    """A table of texts (as scanned from any number of files) with inferred types: one pass, then the casts."""
    return typed(df, {r["column"]: r["type"] for r in column_types(df).collect()})
