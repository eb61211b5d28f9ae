"""League profiles, lower-plate rates and odds filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, index_result, lower_plate, mean_or_zero, nonzero, pct, safe_int
from .results import count_of, decided, finished


def _change(x: str) -> Column:
    return nonzero(F.col(f"{x}1")) - nonzero(F.col(f"{x}0"))


def league_profile(m: DataFrame, least: int = 30, top: int = 20) -> DataFrame:
    """About 25 measures for each league in one aggregation; leagues of at least ``least`` finished rows, the ``top`` largest."""
    r, c, o = F.col("result"), F.col("cover"), F.col("ou")
    ok = r.isNotNull()
    down, up = ok & (_change("hw") < -0.03), ok & (_change("hw") > 0.03)
    win, lose = ok & (_change("win") < -0.10), ok & (_change("lose") < -0.10)
    deep, line = ok & (F.col("line") >= 1.5), ok & nonzero(F.col("total")).isNotNull()
    n = {
        "total": F.count("*"), "valid": count_of(ok), "home": count_of(r == "home"), "draw": count_of(r == "draw"), "away": count_of(r == "away"), "goals_sum": F.coalesce(F.sum("goals"), F.lit(0)),
        "line_n": count_of(line), "over_n": count_of(line & (o == "over")), "under_n": count_of(line & (o == "under")),
        "down_n": count_of(down), "down_home": count_of(down & (r == "home")), "down_cover_home": count_of(down & (c == "home")), "down_cover_away": count_of(down & (c == "away")),
        "up_n": count_of(up), "up_home": count_of(up & (r == "home")), "up_cover_home": count_of(up & (c == "home")), "up_cover_away": count_of(up & (c == "away")),
        "win_drop_n": count_of(win), "win_drop_home": count_of(win & (r == "home")), "win_drop_away": count_of(win & (r == "away")),
        "lose_drop_n": count_of(lose), "lose_drop_home": count_of(lose & (r == "home")),
        "deep_n": count_of(deep), "deep_cover_home": count_of(deep & (c == "home")), "deep_cover_away": count_of(deep & (c == "away")),
    }
    g = finished(m).where(F.nullif("league", F.lit("")).isNotNull()).groupBy("league").agg(*[v.alias(k) for k, v in n.items()])
    g = g.where(F.col("total") >= least).orderBy(F.desc("total"), "league").limit(top)
    share = lambda a, b: pct(F.col(a), b if isinstance(b, Column) else F.col(b))
    return g.select(
        "league", "total", share("home", "valid").alias("home_pct"), share("draw", "valid").alias("draw_pct"), share("away", "valid").alias("away_pct"), mean_or_zero(F.col("goals_sum"), F.col("valid")).alias("avg_goals"),
        share("over_n", "line_n").alias("over_pct"), share("under_n", "line_n").alias("under_pct"),
        "down_n", share("down_home", "down_n").alias("down_home_pct"), share("down_cover_home", F.col("down_cover_home") + F.col("down_cover_away")).alias("down_cover_pct"),
        "up_n", share("up_home", "up_n").alias("up_home_pct"), share("up_cover_home", F.col("up_cover_home") + F.col("up_cover_away")).alias("up_cover_pct"),
        "win_drop_n", share("win_drop_home", "win_drop_n").alias("win_drop_home_pct"), share("win_drop_away", "win_drop_n").alias("win_drop_away_pct"),
        "lose_drop_n", share("lose_drop_home", "lose_drop_n").alias("lose_drop_home_pct"),
        "deep_n", share("deep_cover_away", F.col("deep_cover_home") + F.col("deep_cover_away")).alias("deep_away_pct"),
    )


def league_comparison_tags(m: DataFrame, **options) -> DataFrame:
    """Stars for the worth of falling water, levels of the trap and deep-line shares, and the features that apply."""
    p = league_profile(m, **options)
    value = F.col("down_cover_pct") - F.col("up_cover_pct")
    c = F.col
    feature = F.array_compact(F.array(
        F.when(c("home_pct") > 50, "home_strong").when(c("home_pct") < 40, "home_weak"),
        F.when(c("avg_goals") > 3.0, "many_goals").when(c("avg_goals") < 2.5, "few_goals"),
        F.when((c("down_n") >= 10) & (c("down_cover_pct") > 55), "water_down").when((c("up_n") >= 10) & (c("up_cover_pct") > 55), "water_up"),
        F.when((c("win_drop_n") >= 10) & (c("win_drop_away_pct") > 45), "trap").when((c("win_drop_n") >= 10) & (c("win_drop_away_pct") < 30), "no_trap"),
        F.when((c("deep_n") >= 5) & (c("deep_away_pct") > 55), "deep_away"),
    ))
    return p.select(
        "league", value.alias("water_value"), F.when(value > 15, 3).when(value > 8, 2).when(value > 0, 1).otherwise(0).alias("water_stars"),
        F.when(c("win_drop_away_pct") > 45, 2).when(c("win_drop_away_pct") > 35, 1).otherwise(0).alias("trap_level"),
        F.when(c("deep_n") >= 5, F.when(c("deep_away_pct") > 55, 3).when(c("deep_away_pct") > 50, 2).when(c("deep_away_pct") > 45, 1).otherwise(0)).alias("deep_level"),
        F.concat_ws(",", feature).alias("features"),
    )


def best_league_per_metric(m: DataFrame, **options) -> DataFrame:
    """The best league for each of five metrics; below its minimum sample a league scores 0 there. Ties go to the first name."""
    c = F.col
    metrics = {"home_pct": (c("home_pct"), c("total"), 30), "avg_goals": (c("avg_goals"), c("total"), 30), "down_cover_pct": (c("down_cover_pct"), c("down_n"), 10), "win_drop_away_pct": (c("win_drop_away_pct"), c("win_drop_n"), 10), "deep_away_pct": (c("deep_away_pct"), c("deep_n"), 5)}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.when(n >= least, v).otherwise(0.0).alias("value")) for k, (v, n, least) in metrics.items()]))
    long = league_profile(m, **options).select("league", rows.alias("x")).select("league", "x.*")
    return long.groupBy("metric").agg(F.min_by("league", F.struct(-F.col("value"), F.col("league"))).alias("league"), F.max("value").alias("value"))


def score_text(home: str, away: str) -> Column:
    """'h:a' with '-' for a score that is null or empty."""
    return F.concat_ws(":", *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-")) for c in (home, away)])


def with_plate(m: DataFrame) -> DataFrame:
    """Rows with a handicap value other than 0 and the lower-plate result; scores that don't parse count as 0."""
    h, a = safe_int(F.col("home_score")), safe_int(F.col("away_score"))
    return m.where(nonzero(F.col("index_line")).isNotNull()).withColumns({"h0": h, "a0": a}).withColumn("plate", lower_plate(F.col("h0"), F.col("a0"), F.col("index_line")))


def lower_plate_league_rate(m: DataFrame, least: int = 5, top: int = 15) -> DataFrame:
    g = with_plate(finished(m)).groupBy(F.coalesce("league", F.lit("")).alias("league")).agg(F.count("*").alias("total"), count_of(F.col("plate.lower_wins")).alias("lower_win"))
    g = g.where(F.col("total") >= least).withColumn("rate", F.bround(pct(F.col("lower_win"), F.col("total")), 1))
    return g.orderBy(F.desc("rate"), "league").limit(top)


def _teams(upper: Column) -> dict[str, Column]:
    home, away = F.col("home_team"), F.col("away_team")
    return {"upper_team": F.when(upper == "home", home).otherwise(away), "lower_team": F.when(upper == "home", away).otherwise(home)}


def _plate_rows(m: DataFrame, cold: float) -> DataFrame:
    v = F.col("index_line")
    goals = F.abs(v).cast("int").cast("string")
    desc = F.concat(F.when(v < 0, "主让").otherwise("客让"), goals, F.lit("球"))
    out = m.withColumns({"handicap_desc": desc, "is_cold": nonzero(F.col("ha1")) >= cold} | _teams(F.when(v < 0, "home").otherwise("away")))
    return out.select("match_id", "match_time", "league", "home_team", "away_team", F.concat_ws("-", safe_int(F.col("home_score")), safe_int(F.col("away_score"))).alias("score"), F.col("win1").alias("euro_home"), F.col("lose1").alias("euro_away"), F.col("index_line").alias("hi_handicap"), "handicap_desc", "upper_team", "lower_team", F.col("hh1").alias("hi_home_odds"), F.col("hd1").alias("hi_draw_odds"), F.col("ha1").alias("hi_away_odds"), "is_cold")


def lower_plate_upcoming(m: DataFrame, least: float = 3.0, league: str = "", top: int = 30) -> DataFrame:
    """Upcoming chances of the lower plate, in leagues whose name holds ``league``; the away odds are used whichever side that is."""
    rows = m.where("status = 0")
    rows = (rows.where(F.contains("league", F.lit(league))) if league else rows).where(nonzero(F.col("index_line")).isNotNull() & (F.col("ha1") >= least) & (F.col("ha1") != 0))
    return _plate_rows(rows, 4.0).orderBy(F.desc("hi_away_odds"), "match_id").limit(top)


def lower_plate_history(m: DataFrame, league: str = "", least: float | None = None, top: int = 50) -> DataFrame:
    """Finished matches that the lower plate won; rows without odds pass the odds filter."""
    rows = with_plate(finished(m)).where(F.col("plate.lower_wins"))
    rows = rows.where(F.contains("league", F.lit(league))) if league else rows
    rows = rows.where(F.coalesce(nonzero(F.col("ha1")) >= least, F.lit(True))) if least else rows
    return _plate_rows(rows, 3.0).orderBy(F.coalesce(F.col("hi_away_odds"), F.lit(0.0)).desc(), "match_id").limit(top)


def lower_plate_rate(m: DataFrame, least: float | None = None, league: str = "") -> DataFrame:
    """One row: rows with a handicap, rows kept, rate."""
    m = m.where(F.contains("league", F.lit(league))) if league else m
    keep = F.col("plate.lower_wins")
    keep = keep & F.coalesce(nonzero(F.col("ha1")) >= least, F.lit(True)) if least else keep
    out = with_plate(finished(m)).agg(F.count("*").alias("total"), count_of(keep).alias("kept"))
    return out.withColumn("rate", F.bround(pct(F.col("kept"), F.col("total")), 1))


def filter_types() -> dict[str, Column]:
    hh0, hh1, ha0, ha1, win0, win1, hw0, hw1 = (nonzero(F.col(c)) for c in ("hh0", "hh1", "ha0", "ha1", "win0", "win1", "hw0", "hw1"))
    up, euro = hh1 > hh0 + 0.02, win1 < win0 - 0.02
    return {"hi_home_up": up, "hi_home_up_euro_down": up & euro, "asian_up_euro_down": (hw1 > hw0 + 0.02) & euro, "hi_away_down": ha1 < ha0 - 0.02, "hi_home_up_low": up & (hh1 < 5.0)}


def odds_filter(m: DataFrame, mode: str = "all", league: str = "") -> DataFrame:
    """Every match once for each filter type that it meets, found in one pass; mode: upcoming, finished (both scores there) or all."""
    m = {"upcoming": m.where("status = 0"), "finished": m.where("home_score IS NOT NULL AND away_score IS NOT NULL"), "all": m}[mode]
    m = m.where(F.contains("league", F.lit(league))) if league else m
    kinds = F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in filter_types().items()])))
    rows = m.withColumns({"score": score_text("home_score", "away_score"), "index_result": index_result(F.col("h"), F.col("a"), F.col("index_line")), "filter_type": kinds})
    names = {"hi_handicap": "index_line", "hi_home_initial": "hh0", "hi_home_current": "hh1", "hi_away_initial": "ha0", "hi_away_current": "ha1", "win_initial": "win0", "win_current": "win1", "lose_initial": "lose0", "lose_current": "lose1"}
    return rows.select("match_id", "match_time", "league", "home_team", "away_team", "status", "score", "result", "index_result", *[F.col(v).alias(k) for k, v in names.items()], "filter_type", filter_text().alias("filter_desc"))


def filter_text() -> Column:
    """What moved, in the words of the filter type."""
    c, kind = F.col, F.col("filter_type")
    step = lambda a, b, head, plus: F.concat(F.lit(head), fixed(c(a)), F.lit("→"), fixed(c(b)), F.lit(f" ({plus}"), fixed(c(b) - c(a)), F.lit(")"))
    both = lambda head, a, b: F.concat(F.lit(f"{head} +"), fixed(c(b) - c(a)), F.lit(" | 欧主降 "), fixed(c("win1") - c("win0")))
    return F.when(kind.isin("hi_home_up", "hi_home_up_low"), step("hh0", "hh1", "让胜升水 ", "+")).when(kind == "hi_away_down", step("ha0", "ha1", "让负降水 ", "")).when(kind == "hi_home_up_euro_down", both("让胜升", "hh0", "hh1")).otherwise(both("亚盘升", "hw0", "hw1"))


def odds_filter_rows(m: DataFrame, mode: str = "all", league: str = "", top: int = 100) -> DataFrame:
    """The newest ``top`` rows of each filter type by match_time as text."""
    w = Window.partitionBy("filter_type").orderBy(F.desc_nulls_last("match_time"), F.desc("match_id"))
    return odds_filter(m, mode, league).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def odds_filter_stats(m: DataFrame, mode: str = "finished") -> DataFrame:
    """For each type: results as shares of all its rows, decided or not, and index results as shares of their own total."""
    r, i = F.col("result"), F.col("index_result")
    g = odds_filter(m, mode).groupBy("filter_type").agg(F.count("*").alias("n"), count_of(r.isNotNull()).alias("decided"), *[count_of(r == x).alias(x) for x in ("home", "draw", "away")], count_of(i.isNotNull()).alias("index_n"), count_of(i == "让胜").alias("index_win"), count_of(i == "走水").alias("index_push"), count_of(i == "让负").alias("index_lose"))
    return g.withColumns({f"{x}_pct": pct(F.col(x), F.col("n")) for x in ("home", "draw", "away")} | {f"{x}_pct": pct(F.col(x), F.col("index_n")) for x in ("index_win", "index_push", "index_lose")})


def odds_filter_leagues(m: DataFrame, mode: str = "finished", top: int = 15) -> DataFrame:
    """For each type the leagues of three rows or more by the share of lost index results."""
    i = F.col("index_result")
    g = odds_filter(m, mode).groupBy("filter_type", "league").agg(F.count("*").alias("n"), count_of(i.isNotNull()).alias("index_n"), count_of(i == "让负").alias("index_lose"))
    g = g.where("n >= 3 AND index_n > 0").withColumn("lose_pct", pct(F.col("index_lose"), F.col("index_n")))
    rank = F.row_number().over(Window.partitionBy("filter_type").orderBy(F.desc("lose_pct"), "league"))
    return g.withColumn("rank", rank).where(F.col("rank") <= top)


def match_stats(m: DataFrame) -> DataFrame:
    """One table of several grains: all, each status, each league, the number of leagues; one pass by grouping sets."""
    lg = F.nullif(F.col("league"), F.lit(""))
    base = m.select(lg.alias("lg"), "status")
    name = F.create_map(*[F.lit(x) for p in {0: "未开始", 1: "进行中", 2: "完场", 6: "改期"}.items() for x in p])
    g = m.sparkSession.sql("SELECT lg, status, grouping_id() AS gid, count(*) AS n, count(DISTINCT lg) AS leagues FROM {base} GROUP BY GROUPING SETS ((lg), (status), ())", base=base)
    kind = F.when(F.col("gid") == 1, "league").when(F.col("gid") == 2, "status").otherwise("total")
    value = F.when(F.col("gid") == 1, F.col("lg")).when(F.col("gid") == 2, F.coalesce(F.try_element_at(name, F.col("status")), F.col("status").cast("string")))
    rows = g.select(kind.alias("kind"), value.alias("value"), "n", "leagues").where("kind = 'total' OR value IS NOT NULL")
    last = rows.where("kind = 'total'").select(F.lit("leagues").alias("kind"), F.lit(None).cast("string").alias("value"), F.col("leagues").alias("n"))
    return rows.select("kind", "value", "n").unionByName(last)


def all_leagues(m: DataFrame) -> DataFrame:
    return m.where(F.nullif("league", F.lit("")).isNotNull()).select("league").distinct().orderBy("league")


def league_performance(m: DataFrame) -> DataFrame:
    """Total, finished and pending rows of each league."""
    return m.groupBy("league").agg(F.count("*").alias("total"), count_of(F.col("status") == 2).alias("finished"), count_of(F.coalesce(F.col("status"), F.lit(-1)) != 2).alias("pending"))


def avg_home_score_by_league(m: DataFrame, top: int = 10) -> DataFrame:
    g = finished(m).where("h IS NOT NULL").groupBy("league").agg(F.avg("h").alias("avg_home"), F.count("*").alias("n"))
    return g.orderBy(F.desc("avg_home"), "league").limit(top)


def league_goal_average(m: DataFrame) -> DataFrame:
    return decided(m).groupBy("league").agg(F.count("*").alias("n"), F.sum("goals").alias("goals")).withColumn("avg_goals", F.col("goals") / F.col("n"))


def label_distribution(m: DataFrame) -> DataFrame:
    return m.groupBy(F.coalesce("label", F.lit("无数据")).alias("label")).agg(F.count("*").alias("n"))


def status_partition_counts(m: DataFrame) -> DataFrame:
    s = F.col("status")
    return m.agg(count_of(s == 0).alias("pending"), count_of(s == 2).alias("finished"), count_of(s == 1).alias("live"))


def field_profile(m: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """field, filled, total: how many rows have a text in each column; one pass for all columns."""
    fields = fields or [c for c, t in m.dtypes if t == "string"]
    counts = m.agg(F.count("*").alias("total"), *[count_of(F.nullif(F.col(c), F.lit("")).isNotNull()).alias(c) for c in fields])
    return counts.unpivot(["total"], fields, "field", "filled")
