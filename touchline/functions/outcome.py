"""Results of matches and markets. The settlement conventions are parameters; they are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .handicap import parse_handicap


def _sign(diff: Column, plus: str, zero: str, minus: str) -> Column:
    return F.when(diff > 0, plus).when(diff < 0, minus).when(diff == 0, zero)


def match_result(home: Column, away: Column) -> Column:
    return _sign(home - away, "home", "draw", "away")


def asian_result(home: Column, away: Column, text: Column, convention: str = "pattern") -> Column:
    """home, away or push. pattern: the line is taken from the home goals, added where 受 stands; review, movement: the line is added."""
    if convention == "pattern":
        line = parse_handicap(text, "pattern")
        diff = F.when(F.contains(text, F.lit("受")), home + F.abs(line) - away).otherwise(home - line - away)
    else:
        diff = home + parse_handicap(text, "strict" if convention == "review" else "label") - away
    return _sign(diff, "home", "push", "away")


def ou_result(home: Column, away: Column, line: Column) -> Column:
    return _sign((home + away).cast("double") - line, "over", "push", "under")


def index_result(home: Column, away: Column, line: Column) -> Column:
    return _sign(home - away + line, "让胜", "走水", "让负")


def lower_plate(home: Column, away: Column, line: Column) -> Column:
    """struct<result, lower_wins, upper, lower>; a negative line makes the home side the upper plate."""
    at_home = line < 0
    diff = F.when(at_home, home + line - away).otherwise(away - line - home)
    return F.struct(
        _sign(diff, "上盘赢", "走盘", "下盘赢").alias("result"), (diff < 0).alias("lower_wins"),
        F.when(at_home, "home").otherwise("away").alias("upper"), F.when(at_home, "away").otherwise("home").alias("lower"),
    )


def leg_result(home: Column, away: Column, option: Column, leg_line: Column, match_line: Column) -> Column:
    """won, lost or pending for one leg. A leg's own line comes first, even an empty one, then the match's; what doesn't parse is pending."""
    line = F.when(leg_line.isNotNull(), leg_line).otherwise(match_line).try_cast("double")
    diff = F.when(option.startswith("h_"), home + line - away).otherwise((home - away).cast("double"))
    hit = F.when(option.isin("win", "h_win"), diff > 0).when(option.isin("draw", "h_draw"), diff == 0).when(option.isin("lose", "h_lose"), diff < 0)
    return F.when(hit, "won").when(~hit, "lost").otherwise("pending")
