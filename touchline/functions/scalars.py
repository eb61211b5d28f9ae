"""Parsing and arithmetic with the domain's rules for absent values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_present(*cols: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def safe_double(c: Column) -> Column:
    return c.try_cast("double")


def score_int(c: Column) -> Column:
    """Whole numbers only: '3.0' and '-' are null, ' 3 ' is 3."""
    return F.when(F.trim(c).rlike("^[+-]?[0-9]+$"), F.trim(c).try_cast("int"))


def safe_int(c: Column) -> Column:
    """As score_int, with 0 for what doesn't parse."""
    return F.coalesce(score_int(c), F.lit(0))


def nonzero(c: Column) -> Column:
    """Null where a number is zero: the rules that test a number's truth."""
    return F.nullif(c, F.lit(0.0))


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 for a whole of nothing."""
    return F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0))


def mean_or_zero(total: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(total.cast("double"), n.cast("double")), F.lit(0.0))


def clean_rank(c: Column) -> Column:
    return F.regexp_extract(c, "([0-9]+)", 1)


def strip_arrows(c: Column) -> Column:
    return F.trim(F.translate(c, "↑↓", ""))


def triple(*cols: Column) -> Column:
    """'a/b/c' with '-' for what is absent."""
    return F.concat_ws("/", *[F.coalesce(F.nullif(c, F.lit("")), F.lit("-")) for c in cols])


def stars(confidence: Column) -> Column:
    """A bar of five: a full star for each 20 of the confidence."""
    n = F.greatest(F.lit(0), F.least(F.lit(5), F.floor(confidence / 20).cast("int")))
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), F.lit(5) - n))


def confidence_mark(confidence: Column) -> Column:
    """2 from 70 on, 1 from 60 on, else 0."""
    return F.when(confidence >= 70, 2).when(confidence >= 60, 1).otherwise(0)


def fixed(c: Column, places: int = 2) -> Column:
    """The number as text with so many places."""
    return F.call_function("format_number", c, F.lit("0." + "0" * places))
