"""Name keys, text standardising and anchor checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col


def name_key(c: str | Column) -> Column:
    """Join key of a place name: lower case, every run of other signs one space.

    A missing name gives the empty key.
    """
    s = F.lower(F.replace(as_col(c).cast("string"), F.lit("’"), F.lit("'")))
    return F.coalesce(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), F.lit(""))


def tight_key(c: str | Column) -> Column:
    """Lower-case letters and digits only."""
    return F.coalesce(
        F.regexp_replace(F.lower(as_col(c).cast("string")), "[^0-9a-z]+", ""), F.lit(""))


def slug(c: str | Column) -> Column:
    """Lower case, other signs to one underscore, none at the ends."""
    s = F.regexp_replace(F.lower(as_col(c).cast("string")), "[^0-9a-z]+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def plain_text(c: str | Column) -> Column:
    """Typographic apostrophes and dashes to their keyboard forms."""
    return F.translate(as_col(c), "’‘–—", "''--")


def collapse_spaces(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(as_col(c)), r"\s+", " "))


def missing_anchors(text: str | Column, anchors: list[str]) -> Column:
    """The anchors that ``text`` does not hold, ignoring case and spacing.

    A row without text misses all of them.
    """
    flat = F.coalesce(collapse_spaces(text), F.lit(""))
    wanted = F.array(*[F.struct(F.lit(" ".join(a.lower().split())).alias("needle"), F.lit(a).alias("shown"))
                       for a in anchors])
    # the text is bound as a lambda variable, so it is collapsed once and not once per anchor
    missed = F.transform(F.array(flat), lambda t: F.filter(wanted, lambda w: ~F.contains(t, w["needle"])))
    return F.transform(F.get(missed, F.lit(0)), lambda w: w["shown"])
