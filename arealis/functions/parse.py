"""Parsers for numeric cells, units, periods and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import as_col


def number_cell(c: str | Column) -> Column:
    """Number in a printed cell: anything but digits, point and minus is dropped."""
    s = F.regexp_replace(as_col(c).cast("string"), r"[^0-9.\-]", "")
    return F.when(s.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), s.try_cast("double"))


# Spellings of "missing" and "trace" in composition tables.
MISSING_MARKS = ("", "-", "...", "[]", "na", "NA", "n.d.", "nd")
TRACE_MARKS = ("tr", "trace", "[0]", "0")


def composition_cell(c: str | Column) -> Column:
    """Composition-table cell: a mark stands for its value, a number may stand in brackets, the rest is missing."""
    s = F.replace(F.trim(as_col(c).cast("string")), F.lit(","), F.lit(""))
    marks = {**dict.fromkeys(MISSING_MARKS, None), **dict.fromkeys(TRACE_MARKS, 0.0)}
    values = F.create_map(*[x for mark, v in marks.items() for x in (F.lit(mark), F.lit(v).cast("double"))])
    number = F.regexp_replace(s, r"^\[(.*)\]$", "$1")
    number = F.when(number.rlike(r"^-?\d+(?:\.\d+)?$"), number.try_cast("double"))
    return F.coalesce(F.try_element_at(values, F.lower(s)), number)


def unit_quantity(unit: str | Column) -> Column:
    """First number in a unit string such as ``90 KG``; 1 when absent or not positive."""
    q = F.regexp_extract(as_col(unit).cast("string"), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(q > 0, q).otherwise(F.lit(1.0))


def per_unit_price(price: str | Column, unit: str | Column) -> Column:
    return as_col(price).try_cast("double") / unit_quantity(unit)


def fiscal_year_end(c: str | Column) -> Column:
    """Closing year of ``2022/23``, ``2022/2023`` or ``2023``; -1 when unreadable.

    A two-digit tail keeps the century of the first part, so ``1999/00`` gives 1900.
    """
    s = F.trim(as_col(c).cast("string"))
    head = F.trim(F.regexp_extract(s, r"^([^/]*)/", 1))
    tail = F.trim(F.regexp_extract(s, r"^[^/]*/(.*)$", 1))
    short = F.concat(F.substring(head, 1, 2), tail).try_cast("int")
    return F.coalesce(
        F.when(F.contains(s, F.lit("/")),
               F.when(F.length(tail) == 2, short).otherwise(tail.try_cast("int")))
        .otherwise(s.try_cast("double").try_cast("int")),
        F.lit(-1))


def year_in(c: str | Column) -> Column:
    """First four-digit year 19xx or 20xx in a name, else NULL."""
    return F.regexp_extract(as_col(c), r"((?:19|20)\d{2})", 1).try_cast("int")


def millions(c: str | Column) -> Column:
    """Amounts above a million are taken as units and scaled down; two decimals."""
    v = F.replace(as_col(c), F.lit(","), F.lit("")).try_cast("double")
    return F.round(F.when(v > 1_000_000, v / 1_000_000).otherwise(v), 2)


def coerce(df: DataFrame, numeric: list[str] = (), dates: list[str] = ()) -> DataFrame:
    """Read the named columns as numbers or timestamps; what cannot be read is NULL."""
    out = {}
    for c in numeric:
        if c in df.columns:
            v = F.trim(F.col(c).cast("string")).try_cast("double")
            out[c] = F.when(~F.isnan(v), v)
    for c in dates:
        if c in df.columns:
            out[c] = F.try_to_timestamp(F.col(c).cast("string"))
    return df.withColumns(out) if out else df


def back_transform(band: str | Column, kind: str = "conc") -> Column:
    """Stored log band to natural units: ``exp(x/10) - 1``, or ``x/10`` for pH."""
    x = as_col(band).cast("double") / 10.0
    return x if kind == "ph" else F.exp(x) - 1.0


def blend_depths(v_0_20: str | Column, v_20_50: str | Column) -> Column:
    """0-30 cm mean of a 0-20 and a 20-50 cm layer."""
    return (as_col(v_0_20) * 20.0 + as_col(v_20_50) * 10.0) / 30.0


def rain_erosivity(annual_mm: str | Column) -> Column:
    return F.pow(as_col(annual_mm).cast("double"), 1.610) * 0.0483


def slope_factor(slope_deg: str | Column) -> Column:
    s = F.sin(F.radians(as_col(slope_deg).cast("double")))
    return F.when(as_col(slope_deg) >= 5.14, s * 16.8 - 0.50).otherwise(s * 10.8 + 0.03)


def erosion_risk(annual_mm: str | Column, slope_deg: str | Column) -> Column:
    return rain_erosivity(annual_mm) * slope_factor(slope_deg)
