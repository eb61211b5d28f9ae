"""Teams: totals over both roles, the last matches of each, head to head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pct
from .results import count_of, decided, finished


def sides(m: DataFrame) -> DataFrame:
    """Two rows for each match, one for each team: team, other, at_home, gf, ga, outcome; goals are null unless both scores parse. One explode, no second scan."""
    h, a = (F.when(F.col("goals").isNotNull(), F.col(c)) for c in ("h", "a"))
    one = lambda team, other, home, gf, ga: F.struct(F.col(team).alias("team"), F.col(other).alias("other"), F.lit(home).alias("at_home"), gf.alias("gf"), ga.alias("ga"))
    both = F.explode(F.array(one("home_team", "away_team", True, h, a), one("away_team", "home_team", False, a, h)))
    d = F.col("gf") - F.col("ga")
    outcome = F.when(d > 0, "win").when(d < 0, "loss").when(d == 0, "draw")
    return m.select("match_id", "league", "match_time", "owner_date", "goals", "total", "ou", both.alias("s")).select("match_id", "league", "match_time", "owner_date", "goals", "total", "ou", "s.*").withColumn("outcome", outcome)


def team_goal_averages(m: DataFrame) -> DataFrame:
    g = sides(decided(m)).groupBy("league", "team").agg(F.count("*").alias("matches"), F.avg("gf").alias("scored"), F.avg("ga").alias("conceded"))
    return g.withColumn("total", F.col("scored") + F.col("conceded"))


def team_profile(m: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return sides(decided(m)).groupBy("team").agg(
        F.count("*").alias("matches"), F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"),
        count_of(o == "win").alias("wins"), count_of(o == "draw").alias("draws"), count_of(o == "loss").alias("losses"), count_of(F.col("goals") >= 3).alias("big_games"),
    )


def last_matches(m: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` finished matches of every team by match_time, then match_id; Spark limits within groups before the sort."""
    w = Window.partitionBy("team").orderBy(F.desc_nulls_last("match_time"), F.desc("match_id"))
    return sides(finished(m)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def form_columns(prefix: str = "") -> dict[str, Column]:
    n = F.col("matches")
    c = {f"{prefix}{k}_rate": F.col(k) / n for k in ("wins", "draws", "losses", "over", "under")}
    return c | {f"{prefix}avg_for": F.col("goals_for") / n, f"{prefix}avg_against": F.col("goals_against") / n}


def _with_line(m: DataFrame) -> DataFrame:
    """``m`` with the line that a form counts overs against: a missing one is 2.5."""
    line = F.coalesce(F.nullif("ou_current_total", F.lit("")), F.nullif("ou_initial_total", F.lit("")), F.lit("2.5")).try_cast("double")
    return m.withColumn("total", line)


def form_rows(m: DataFrame) -> DataFrame:
    """The rows that a form is made of, one for each team of each finished match."""
    return sides(finished(_with_line(m))).select("team", "match_id", "match_time", "goals", "total", "gf", "ga", "outcome")


def _form(last: DataFrame) -> DataFrame:
    o, over = F.col("outcome"), F.col("goals") > F.col("total")
    g = last.groupBy("team").agg(
        F.count("*").alias("matches"), count_of(o == "win").alias("wins"), count_of(o == "draw").alias("draws"), count_of(o == "loss").alias("losses"),
        F.coalesce(F.sum("gf"), F.lit(0)).alias("goals_for"), F.coalesce(F.sum("ga"), F.lit(0)).alias("goals_against"), count_of(over).alias("over"), count_of(F.col("goals") < F.col("total")).alias("under"),
    )
    return g.withColumns(form_columns())


def form_of_rows(rows: DataFrame, n: int = 10) -> DataFrame:
    """The form over the last ``n`` of the rows of ``form_rows``."""
    w = Window.partitionBy("team").orderBy(F.desc_nulls_last("match_time"), F.desc("match_id"))
    return _form(rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n))


def team_form(m: DataFrame, n: int = 10) -> DataFrame:
    """Form over the last ``n`` rows; rates are over the rows taken, also those whose score doesn't parse. A missing line is 2.5."""
    return _form(last_matches(_with_line(m), n))


def form_before(m: DataFrame, n: int = 10) -> DataFrame:
    """For each side of each finished match its form over the ``n`` matches before kick-off: no look ahead.

    Kick-off is the day and the time of day; matches of a team that kick off together see none of one another. The frame of a
    team's first row of a kick-off ends before it, and the others of that kick-off take its sums; one shuffle by team.
    """
    time = F.concat_ws(" ", F.coalesce("owner_date", F.lit("")), F.right(F.coalesce("match_time", F.lit("")), F.lit(5)))
    s = sides(finished(_with_line(m))).withColumn("kick_off", time)
    before = Window.partitionBy("team").orderBy("kick_off", "match_id").rowsBetween(-n, -1)
    o = F.col("outcome")
    tests = {"wins": o == "win", "draws": o == "draw", "losses": o == "loss", "over": F.col("goals") > F.col("total"), "under": F.col("goals") < F.col("total")}
    sums = {"matches": F.count("*").over(before)} | {k: F.coalesce(F.sum(F.when(t, 1).otherwise(0)).over(before), F.lit(0)) for k, t in tests.items()}
    sums |= {k: F.coalesce(F.sum(c).over(before), F.lit(0)) for k, c in (("goals_for", "gf"), ("goals_against", "ga"))}
    together = Window.partitionBy("team", "kick_off").orderBy("match_id")
    s = s.select("match_id", "team", "at_home", "kick_off", *[v.alias(k) for k, v in sums.items()])
    s = s.select("match_id", "team", "at_home", "kick_off", *[F.first(k).over(together).alias(k) for k in sums])
    rates = {k: F.when(F.col("matches") > 0, v) for k, v in form_columns().items()}
    return s.withColumns(rates)


def form_as_of(m: DataFrame, n: int = 10) -> DataFrame:
    """For each side of each match the wins and goals of its ``n`` matches before it: no look ahead."""
    w = Window.partitionBy("team").orderBy("owner_date", "match_id").rowsBetween(-n, -1)
    s = sides(decided(m))
    return s.select("match_id", "team", F.count("*").over(w).alias("matches"), F.coalesce(F.sum(F.when(F.col("outcome") == "win", 1).otherwise(0)).over(w), F.lit(0)).alias("wins"), F.coalesce(F.sum("gf").over(w), F.lit(0)).alias("goals_for"))


def team_over_under(m: DataFrame, n: int = 10) -> DataFrame:
    o = F.col("ou")
    g = last_matches(m, n).groupBy("team").agg(F.count("*").alias("matches"), count_of(o.isNotNull()).alias("n"), *[count_of(o == x).alias(x) for x in ("over", "under", "push")])
    return g.withColumns({f"{x}_pct": pct(F.col(x), F.col("n")) for x in ("over", "under", "push")})


def team_recent_report(m: DataFrame, n: int = 10) -> DataFrame:
    o = F.col("outcome")
    return last_matches(m, n).groupBy("team").agg(F.count("*").alias("matches"), count_of(o == "win").alias("wins"), count_of(o == "draw").alias("draws"), count_of(o == "loss").alias("losses"), F.coalesce(F.sum("gf"), F.lit(0)).alias("goals_for"), F.coalesce(F.sum("ga"), F.lit(0)).alias("goals_against"))


def head_to_head(m: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` finished matches of every unordered pair of teams."""
    pair = {"team_1": F.least("home_team", "away_team"), "team_2": F.greatest("home_team", "away_team")}
    w = Window.partitionBy("team_1", "team_2").orderBy(F.desc_nulls_last("match_time"), F.desc("match_id"))
    rows = finished(m).withColumns(pair).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return rows.select("team_1", "team_2", F.col("rn").cast("int").alias("rn"), "match_id", "match_time", "home_team", "away_team", "h", "a", "result")
