"""Handicap texts to numbers. Seven dialects differ in their labels, in unknown texts and in the sign; none is unified away."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label -> goals.
LEVELS = {
    "平手": 0.0, "平/半": 0.25, "平手/半球": 0.25, "半球": 0.5, "半/一": 0.75, "半球/一球": 0.75, "一球": 1.0, "一/球半": 1.25,
    "一球/球半": 1.25, "球半": 1.5, "球半/两": 1.75, "球半/两球": 1.75, "两球": 2.0, "两/两球半": 2.25, "两球半": 2.5,
}
#: The labels of the page-hint dialect.
HINTS = {
    "平手": 0.0, "平/半": 0.25, "半球": 0.5, "半/一": 0.75, "一球": 1.0, "一/球半": 1.25, "球半": 1.5, "球半/两": 1.75,
    "球半/两球": 1.75, "两球": 2.0, "两/两球半": 2.25, "两球半": 2.5, "两球半/三": 2.75, "两球半/三球": 2.75, "三球": 3.0, "三/三球半": 3.25, "三球半": 3.5,
}
UP_TO_TWO = {k: v for k, v in LEVELS.items() if v <= 2.0}
#: name: (labels, unknown text, sign of a receiving home side)
DIALECTS = {
    "label": (LEVELS, "digits", -1),
    "pattern": (LEVELS | {"两球半/三": 2.75, "三球": 3.0}, "digits", -1),
    "level": (LEVELS, "digits", -1),
    "strict": (UP_TO_TWO, "number", -1),
    "hint": (HINTS, "signed", 1),
    "digits0": ({}, "digits_or_0", 0),
    "digits": ({}, "digits", 0),
}


def parse_handicap(c: Column, dialect: str = "label") -> Column:
    """Goals given by the home side; null for null, empty and unknown text, except that "hint" and "digits0" give 0."""
    labels, unknown, receiving = DIALECTS[dialect]
    text = F.nullif(c, F.lit(""))
    text = F.trim(text) if unknown == "signed" else text
    bare = F.replace(text, F.lit("受"), F.lit("")) if receiving else text
    digits = F.nullif(F.regexp_extract(text, r"([0-9]+\.?[0-9]*)", 1), F.lit("")).try_cast("double")
    signed = F.nullif(F.regexp_extract(text, r"([-+]?[0-9]+\.?[0-9]*)", 1), F.lit("")).try_cast("double")
    other = {"digits": digits, "digits_or_0": F.coalesce(digits, F.lit(0.0)), "number": bare.try_cast("double"), "signed": F.coalesce(signed, F.lit(0.0))}[unknown]
    if not labels:
        return other
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), bare)
    received = F.contains(text, F.lit("受"))
    if unknown == "signed":  # the hint dialect counts from the away side: giving is negative, plain numbers stay as they are
        return F.when(known.isNotNull(), F.when(received, known).otherwise(-known)).otherwise(other)
    value = F.coalesce(known, other)
    return F.when(text.isNotNull(), F.when(received, -value).otherwise(value))
