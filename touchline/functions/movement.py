"""From an initial to a current value. Differences are raw doubles, current minus initial, compared with the thresholds as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .handicap import parse_handicap


def moved(initial: Column, current: Column) -> Column:
    return F.bround(current - initial, 2)


def arrow(initial: Column, current: Column) -> Column:
    d = moved(initial, current)
    return F.when(d > 0, "↑").when(d < 0, "↓").when(d == 0, "—")


def bucket(x: Column, cuts: list[tuple[str, float, str]], rest: str) -> Column:
    """The name of the first (comparison, cut, name) that holds, else ``rest``; null for null."""
    out = None
    for op, cut, name in cuts:
        test = {"<": x < cut, "<=": x <= cut, ">": x > cut, ">=": x >= cut, "=": x == cut}[op]
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.when(x.isNotNull(), out.otherwise(rest))


def asian_label(line_from: Column, line_to: Column, water_from: Column, water_to: Column) -> Column:
    """Rise or fall of the line and of the home odds, from texts; null if any of the four doesn't parse."""
    dh = parse_handicap(line_to) - parse_handicap(line_from)
    dw = water_to.try_cast("double") - water_from.try_cast("double")
    water = F.when(dw < -0.02, "降水").when(dw > 0.02, "升水")
    tail = F.coalesce(water, F.lit(""))
    label = (
        F.when((F.abs(dh) < 0.01) & (F.abs(dw) < 0.02), "无变化")
        .when(dh > 0.01, F.concat(F.lit("升盘"), tail))
        .when(dh < -0.01, F.concat(F.lit("降盘"), tail))
        .otherwise(F.coalesce(water, F.lit("无变化")))
    )
    return F.when(dh.isNotNull() & dw.isNotNull(), label)


def euro_movement(win: tuple[Column, Column], draw: tuple[Column, Column], lose: tuple[Column, Column]) -> Column:
    """struct<win, draw, lose, texts, tendency> of three (initial, current) pairs; null unless all six are there."""
    d = [b - a for a, b in (win, draw, lose)]
    whole = d[0].isNotNull() & d[1].isNotNull() & d[2].isNotNull()
    names = ("主胜", "平局", "客胜")
    texts = F.array_compact(F.array(*[F.when(x > 0.05, f"{n}↑").when(x < -0.05, f"{n}↓") for n, x in zip(names, d, strict=True)]))
    tendency = F.when(d[0] < -0.1, "home").when(d[2] < -0.1, "away").when(d[1] < -0.1, "draw")
    return F.when(whole, F.struct(d[0].alias("win"), d[1].alias("draw"), d[2].alias("lose"), texts.alias("texts"), tendency.alias("tendency")))


def asian_movement(line: tuple[Column, Column], home: tuple[Column, Column], away: tuple[Column, Column], api: bool = True) -> Column:
    """struct<line, home, away, tendency, rule> from texts.

    The API form reads lines by their digits and rounds every change to two places; where odds are missing, their change is
    null and rules on them don't hold. The command-line form reads unknown lines and missing odds as 0.
    """
    if api:
        dh = moved(parse_handicap(line[0], "digits"), parse_handicap(line[1], "digits"))
        d1, d2 = (moved(a.try_cast("double"), b.try_cast("double")) for a, b in (home, away))
    else:
        dh = parse_handicap(line[1], "digits0") - parse_handicap(line[0], "digits0")
        zero = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
        d1, d2 = (zero(b) - zero(a) for a, b in (home, away))
    tendency = F.when(dh > 0.2, "home").when(dh < -0.2, "away")
    rule = (
        F.when((dh > 0.1) & (d1 < 0), "升盘降水").when((dh < -0.1) & (d2 < 0), "降盘降水").when((dh > 0.1) & (d1 > 0), "升盘升水").when((dh < -0.1) & (d2 > 0), "降盘升水")
    )
    return F.when(dh.isNotNull(), F.struct(dh.alias("line"), d1.alias("home"), d2.alias("away"), tendency.alias("tendency"), rule.alias("rule")))
