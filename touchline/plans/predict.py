"""Rule-score predictors as chains of column expressions over one row of a match and the aggregates joined to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import asian_movement, asian_result, confidence_mark, euro_movement, first_present, fixed, nonzero, ou_result, parse_handicap, pct, stars
from ..operators.leagues import league_goal_average
from ..operators.lists import movement_eligible
from ..operators.results import count_of, ou_stats_by_league_line
from ..operators.teams import form_before, team_form
from ..sources.merge import upsert

#: Leagues of the feature lists, and leagues where draws are common.
FEATURE_LEAGUES = {
    "water_down": ["欧罗巴", "法乙", "英冠", "葡超", "世外欧洲", "日职", "英超", "法甲"],
    "trap": ["瑞典超", "葡超", "世外欧洲", "挪超", "日职乙", "德甲", "日职", "美职联"],
    "high_goals": ["荷甲", "世外欧洲", "德甲", "挪超", "欧冠", "美职联"],
    "low_goals": ["日职乙", "法乙", "意甲", "德乙", "瑞典超"],
    "level_draw": ["葡超", "英超", "法乙", "K1联赛", "瑞典超"],
    "level_away": ["日职乙", "美职联", "荷乙"],
}
DRAW_LEAGUES = ["意甲", "德乙", "西甲", "法乙"]


FORM = ("matches", "wins_rate", "over_rate", "under_rate", "avg_for", "avg_against")


def _has_odds() -> Column:
    return first_present(F.col("euro_current_win"), F.col("euro_initial_win")).isNotNull()


def with_form(m: DataFrame, n: int = 10, form: DataFrame | None = None) -> DataFrame:
    """Upcoming matches that have odds, with the form of both sides, given or taken from ``m``; a team without finished matches has none."""
    form = (team_form(m, n) if form is None else form).select("team", *FORM)
    up = m.where("status = 0").where(_has_odds())
    for side in ("home", "away"):
        own = form.select(F.col("team").alias(f"{side}_team"), *[F.col(c).alias(f"{side}_{c}") for c in form.columns[1:]])
        up = up.join(own, f"{side}_team", "left")
    return up


def with_form_before(m: DataFrame, n: int = 10) -> DataFrame:
    """Decided matches that have odds, with the form that both sides had before kick-off; a team's first matches have none."""
    f = form_before(m, n)
    side = lambda home: F.max_by(F.struct(*FORM), F.when(F.col("at_home") == home, 1))
    f = f.groupBy("match_id").agg(side(True).alias("hf"), side(False).alias("af"))
    known = lambda x, c: F.when(F.col(f"{x}.matches") > 0, F.col(f"{x}.{c}"))
    f = f.select("match_id", *[known(x, c).alias(f"{name}_{c}") for x, name in (("hf", "home"), ("af", "away")) for c in FORM])
    return m.where("status = 2 AND result IS NOT NULL").where(_has_odds()).join(f, "match_id", "left")


def predict_winner(win: Column, draw: Column, lose: Column, home_rate: Column, away_rate: Column) -> Column:
    """struct<pick, confidence>."""
    whole = nonzero(win).isNotNull() & nonzero(draw).isNotNull() & nonzero(lose).isNotNull()
    rules = [(win < 1.5, "home", 85), (lose < 1.5, "away", 85), (win < 2.0, "home", 70), (lose < 2.0, "away", 70), (draw < 3.2, "draw", 60), (win < lose, "home", 55), (lose < win, "away", 55)]
    pick, conf = F.when(~F.coalesce(whole, F.lit(False)), "draw"), F.when(~F.coalesce(whole, F.lit(False)), 50)
    for test, side, c in rules:
        pick, conf = pick.when(test, side), conf.when(test, c)
    pick, conf = pick.otherwise("draw"), conf.otherwise(50)
    gap = home_rate - away_rate
    favoured = F.when(gap > 0.3, "home").when(gap < -0.3, "away")
    opposed = ((favoured == "home") & (pick == "away")) | ((favoured == "away") & (pick == "home"))
    moved = F.when(favoured == pick, F.least(conf + 10, F.lit(90))).when(opposed, F.greatest(conf - 10, F.lit(50))).otherwise(conf)
    return F.struct(pick.alias("pick"), moved.cast("double").alias("confidence"))


def predict_asian(home: Column, away: Column) -> Column:
    whole = nonzero(home).isNotNull() & nonzero(away).isNotNull()
    pick = F.when(~F.coalesce(whole, F.lit(False)), "home").when((away > 1.0) & (home < 0.85), "away").when((home > 1.0) & (away < 0.85), "home").when(home > away, "home").otherwise("away")
    conf = F.when(~F.coalesce(whole, F.lit(False)), 50).when(((home > 1.0) & (away < 0.85)) | ((away > 1.0) & (home < 0.85)), 70).otherwise(60)
    return F.struct(pick.alias("pick"), conf.cast("double").alias("confidence"))


def predict_over_under(over: Column, under: Column, home_rate: Column, away_rate: Column) -> Column:
    rate = (home_rate + away_rate) / 2
    pick = F.when(rate > 0.7, "over").when(rate < 0.3, "under").when(rate > 0.55, "over").when(rate < 0.45, "under").otherwise("over")
    conf = F.when((rate > 0.7) | (rate < 0.3), 70).when((rate > 0.55) | (rate < 0.45), 60).otherwise(50)
    over, under = nonzero(over), nonzero(under)
    backed = ((over > 1.0) & (under < 0.85) & (pick == "over")) | ((under > 1.0) & (over < 0.85) & (pick == "under"))
    return F.struct(pick.alias("pick"), F.when(backed, F.least(conf + 10, F.lit(75))).otherwise(conf).cast("double").alias("confidence"))


def predict_score(winner: Column, home_for: Column, away_for: Column) -> Column:
    """struct<home, away>: each side's mean of own goals rounded half to even, the winner ahead by one, a draw level at no less than 1."""
    known = home_for.isNotNull() & away_for.isNotNull()
    h, a = F.bround(home_for, 0).cast("int"), F.bround(away_for, 0).cast("int")
    level = F.greatest(F.lit(1), F.least(h, a))
    home = F.when(~known, F.when(winner == "home", 2).when(winner == "away", 0).otherwise(1)).when(winner == "home", F.when(h <= a, a + 1).otherwise(h)).when(winner == "draw", level).otherwise(h)
    away = F.when(~known, F.when(winner == "home", 0).when(winner == "away", 2).otherwise(1)).when(winner == "away", F.when(a <= h, h + 1).otherwise(a)).when(winner == "draw", level).otherwise(a)
    return F.struct(home.alias("home"), away.alias("away"))


def predict_upcoming(m: DataFrame, form: DataFrame | None = None) -> DataFrame:
    """One prediction for each upcoming match: result, Asian side, over or under, score. ``form``: of a kept table, instead of the finished matches in ``m``."""
    return _predicted(with_form(m, form=form))


def predict_before(m: DataFrame) -> DataFrame:
    """The same for finished matches, from what was known before each kick-off."""
    return _predicted(with_form_before(m))


def backtest(m: DataFrame) -> DataFrame:
    """How the predictor would have done: for each market and confidence the picks, the right ones and their share; a null confidence is the whole market."""
    p = predict_before(m)
    kept = p.withColumns({c: F.lit(None).cast("string") for c in ("manual_win_prediction", "manual_asian_prediction", "manual_asian_handicap")} | {"is_reviewed": F.lit(False), "ou_total": F.col("ou_total").cast("string")})
    held = review_predictions(m, kept.drop("league")).select("match_id", *[f"{k}_correct" for k in ("win", "asian", "ou", "score")])
    one = lambda k, conf: F.struct(F.lit(k).alias("market"), conf.cast("double").alias("confidence"), F.col(f"{k}_correct").alias("right"))
    rows = p.join(held, "match_id").select(F.explode(F.array(*[one(k, F.col(f"{k}_confidence")) for k in ("win", "asian", "ou")], one("score", F.col("win_confidence")))).alias("r")).select("r.*")
    g = rows.groupingSets([[F.col("market"), F.col("confidence")], [F.col("market")]], F.col("market"), F.col("confidence")).agg(F.count("*").alias("n"), count_of(F.col("right")).alias("hits"))
    return g.select("market", "confidence", "n", "hits", pct(F.col("hits"), F.col("n")).alias("hit_pct"))


def _predicted(p: DataFrame) -> DataFrame:
    c = F.col
    p = p.withColumns({
        "w": predict_winner(c("win"), c("draw"), c("lose"), c("home_wins_rate"), c("away_wins_rate")),
        "s": predict_asian(c("hw"), c("aw")), "g": predict_over_under(c("over"), c("under"), c("home_over_rate"), c("away_over_rate")),
    })
    p = p.withColumn("r", predict_score(c("w.pick"), c("home_avg_for"), c("away_avg_for")))
    return p.select(
        "match_id", "league", "match_time", "home_team", "away_team", c("w.pick").alias("win_prediction"), c("w.confidence").alias("win_confidence"), c("s.pick").alias("asian_prediction"), c("s.confidence").alias("asian_confidence"),
        c("line_text").alias("asian_handicap"), c("g.pick").alias("ou_prediction"), c("g.confidence").alias("ou_confidence"), c("total").alias("ou_total"), c("r.home").alias("predicted_home_score"), c("r.away").alias("predicted_away_score"),
    )


def _points(*rules: tuple[Column, int]) -> Column:
    """Sum of the points whose test holds."""
    return sum((F.when(test, points).otherwise(0) for test, points in rules), F.lit(0))


def _chain(*rules: tuple[Column, int]) -> Column:
    """Points of the first test that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for test, points in rules[1:]:
        out = out.when(test, points)
    return out.otherwise(0)


def _best(home: Column, draw: Column, away: Column) -> Column:
    """struct<pick, confidence> of the largest score, ties home, draw, away; confidence from margin and top."""
    order = F.array_sort(F.array(*[F.struct((-s).alias("neg"), F.lit(i).alias("prio"), F.lit(n).alias("name")) for i, (s, n) in enumerate(((home, "home"), (draw, "draw"), (away, "away")))]))
    top, second = -order[0]["neg"], -order[1]["neg"]
    return F.struct(order[0]["name"].alias("pick"), F.least(F.lit(90), 50 + 8 * (top - second) + 3 * top).alias("confidence"))


#: The words of the picks.
RESULT_NAMES, INDEX_NAMES = {"home": "主胜", "draw": "平局", "away": "客胜"}, {"home": "让胜", "draw": "让平", "away": "让负"}


def _texts(*rules: tuple[Column, Column | str]) -> Column:
    """The texts whose test holds, in order."""
    return F.array_compact(F.array(*[F.when(test, text if isinstance(text, Column) else F.lit(text)) for test, text in rules]))


def _with(text: str, number: Column, places: int = 2) -> Column:
    return F.concat(F.lit(text), fixed(number, places))


def _result_market() -> dict[str, Column]:
    """Scores of the three results; without all three current odds only movement and league count."""
    nz = lambda c: nonzero(F.col(c))
    w, d, l = nz("win1"), nz("draw1"), nz("lose1")
    whole = w.isNotNull() & d.isNotNull() & l.isNotNull()
    dw, dl, league = nz("win0") - w, nz("lose0") - l, F.col("league").isin(*DRAW_LEAGUES)
    home = F.when(whole, _chain((w < 1.5, 4), (w < 1.7, 3), (w < 2.0, 2))).otherwise(0) + _chain((dw > 0.15, 2), (dw < -0.12, -1))
    away = F.when(whole, F.when(w > 2.6, 2).otherwise(0) + _chain((l < 1.7, 4), (l < 2.0, 3), (l < 2.3, 2))).otherwise(0) + F.when(dl > 0.15, 2).otherwise(0)
    draw = F.when(whole, _chain((d < 3.1, 2), (d > 3.6, -1))).otherwise(0) + F.when(league, 2).otherwise(0)
    said = _texts(
        (whole & (w < 1.5), _with("主胜赔极低", w)), (whole & (w >= 1.5) & (w < 1.7), _with("主胜赔低", w)), (whole & (w > 2.6), _with("主胜赔高", w)),
        (whole & (l < 1.7), _with("客胜赔极低", l)), (whole & (l >= 1.7) & (l < 2.0), _with("客胜赔低", l)), (whole & (d < 3.1), _with("平赔低", d)),
        (dw > 0.15, "主胜赔降"), (dl > 0.15, "客胜赔降"), (league, "高平局联赛"),
    )
    return {"result_p": _best(home, draw, away), "result_reasons": said}


def _index_market() -> dict[str, Column]:
    """Scores of the three-way index; null without all three current odds."""
    nz = lambda c: nonzero(F.col(c))
    a, b, c = nz("hh1"), nz("hd1"), nz("ha1")
    low, whole, line = F.least(a, b, c), a.isNotNull() & b.isNotNull() & c.isNotNull(), F.col("index_line")
    drops = [nz(f"{x}0") - y > 0.15 for x, y in (("hh", a), ("hd", b), ("ha", c))]
    home = _points((a == low, 3)) + _chain((a < 1.8, 3), (a < 2.1, 2)) + F.when(drops[0], 2).otherwise(0)
    draw = _points((b == low, 3)) + _chain((b < 3.0, 2), (b < 3.5, 1)) + F.when(drops[1], 2).otherwise(0) + F.when(line == 0, 1).otherwise(0)
    away = _points((c == low, 3)) + _chain((c < 1.8, 3), (c < 2.2, 2)) + F.when(drops[2], 2).otherwise(0) + F.when(F.abs(line) >= 2, 1).otherwise(0)
    bonus = F.when(F.element_at(F.array_sort(F.array(a, b, c)), 2) - low > 0.5, 10).otherwise(0)
    depth = F.concat(F.lit("深让"), F.abs(line.cast("int")).cast("string"), F.lit("球"))
    said = _texts(
        (a < 1.8, _with("让胜赔低", a)), (b < 3.0, _with("让平赔低", b)), (c < 1.8, _with("让负赔低", c)), ((c >= 1.8) & (c < 2.2), _with("让负赔较低", c)),
        (drops[0], "让胜赔降"), (drops[1], "让平赔降"), (drops[2], "让负赔降"), (F.abs(line) >= 2, depth), (F.abs(line) == 1, "让1球"), (line == 0, "平手盘"),
    )
    return {"index_p": F.when(whole, _best(home, draw, away)), "index_bonus": bonus, "hi_reasons": F.when(whole, said).otherwise(F.array().cast("array<string>"))}


def _goal_market() -> dict[str, Column]:
    """Band and confidence by the line and the league's mean goals; low over odds raise the band, else low under odds lower it."""
    t, over, under, mean = (nonzero(F.col(c)) for c in ("total", "over", "under", "avg"))
    # (test, band, confidence, text and the number in it)
    rules = [
        (t <= 2.0, "0-1", 85, _with("极低盘口", t, 1)), (t <= 2.25, "1-2", 78, _with("低盘口", t, 1)),
        ((t <= 2.5) & (mean < 2.5), "1-2", 72, F.concat(_with("盘口", t, 1), F.lit("+低进球联赛"))), (t <= 2.5, "2-3", 72, _with("盘口", t, 1)), (t <= 2.75, "2-3", 75, _with("盘口", t, 1)),
        ((t <= 3.0) & (mean >= 3.0), "3-4", 75, _with("高进球联赛+盘口", t, 1)), (t <= 3.0, "2-3", 70, _with("盘口", t, 1)), (t <= 3.5, "3-4", 68, _with("高盘口", t, 1)), (t.isNotNull(), "4-6", 60, _with("极高盘口", t, 1)),
        (mean >= 3.2, "3-4", 65, _with("高进球联赛", mean, 1)), (mean <= 2.4, "1-2", 65, _with("低进球联赛", mean, 1)), (F.lit(True), "2-3", 60, _with("联赛场均", mean, 1)),
    ]
    rule = None
    for test, band, conf, text in rules:
        value = F.struct(F.lit(band).alias("band"), F.lit(conf).alias("conf"), text.alias("text"))
        rule = F.when(test, value) if rule is None else rule.when(test, value)
    priced = t.isNotNull() & over.isNotNull() & under.isNotNull()
    return {"goal_rule": rule, "by_over": F.coalesce(priced & (over < 0.82), F.lit(False)), "by_under": F.coalesce(priced & (over >= 0.82) & (under < 0.82), F.lit(False))}


def daily_predictions(m: DataFrame, day: str | None = None) -> DataFrame:
    """Result, index market and goal band of each upcoming match (of ``day``, an owner_date), from odds, their movement and league means.

    A league of fewer than ten decided matches counts as one of 2.8 goals a match. Reasons are arrays in the order of the rules.
    """
    avg = league_goal_average(m).where("n >= 10").select("league", "avg_goals")
    u = m.where("status = 0")
    u = u.where(F.col("owner_date") == day) if day else u
    u = u.join(avg, "league", "left").withColumn("avg", F.coalesce("avg_goals", F.lit(2.8)))
    u = u.withColumns(_result_market() | _index_market() | _goal_market())
    up, down = F.col("by_over"), F.col("by_under")
    band = F.col("goal_rule.band")
    goal_band = F.when(up & (band == "2-3"), "3-4").when(down & (band == "2-3"), "1-2").when(down & (band == "3-4"), "2-3").otherwise(band)
    goal_conf = F.least(F.lit(90), F.col("goal_rule.conf") + F.when(up | down, 5).otherwise(0))
    goal_reasons = F.array_compact(F.array(F.col("goal_rule.text"), F.when(up, "大球低水").when(down, "小球低水")))
    hi = F.when(F.col("index_p").isNotNull(), F.least(F.lit(90), F.col("index_p.confidence") + F.col("index_bonus"))).otherwise(0)
    return u.select(
        "match_id", "league", "match_time", "home_team", "away_team", F.col("result_p.pick").alias("result_pick"), F.col("result_p.confidence").cast("int").alias("result_conf"), "result_reasons",
        F.col("index_p.pick").alias("hi_pick"), hi.cast("int").alias("hi_conf"), "hi_reasons", goal_band.alias("goal_band"), goal_conf.cast("int").alias("goal_conf"), goal_reasons.alias("goal_reasons"),
    )


def daily_top(m: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best matches for each of the three confidences; the index list takes confident rows only."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(conf).alias("confidence")) for kind, conf in (("result", "result_conf"), ("index", "hi_conf"), ("goals", "goal_conf"))])
    rows = daily_predictions(m).select("match_id", "match_time", F.explode(kinds).alias("x")).select("match_id", "match_time", "x.*").where("confidence > 0")
    w = Window.partitionBy("kind").orderBy(F.desc("confidence"), "match_time", "match_id")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("kind", "match_id", "confidence")


def predict_by_patterns(m: DataFrame, day: str | None = None, features: dict[str, list[str]] | None = None) -> DataFrame:
    """Scores for home, draw and away from odds, line, water, label and the leagues' features, with the reasons in the order of the rules."""
    u = m.where("status = 0")
    u = u.where(F.contains("match_time", F.lit(day))) if day else u
    has = {k: F.coalesce(F.col("league").isin(*v), F.lit(False)) for k, v in (features or FEATURE_LEAGUES).items()}
    nz = lambda c: nonzero(F.col(c))
    win, lose, drop = nz("win"), nz("lose"), F.when(nz("lose").isNotNull(), nz("win") - nz("win0"))
    line, hw, water, label, total = parse_handicap(F.col("line_text"), "level"), nz("hw"), nz("hw") - nz("hw0"), F.col("label"), nz("total")
    both = win.isNotNull() & lose.isNotNull()
    fav_home = _chain((win < 1.8, 30), (win < 2.2, 15))
    e_home = F.when(both, fav_home).otherwise(0)
    e_away = F.when(both & (fav_home == 0), _chain((lose < 1.8, 30), (lose < 2.2, 15))).otherwise(0)
    trapped, dropped = (drop < -0.15) & has["trap"], (drop < -0.15) & ~has["trap"]
    level = F.abs(line) <= 0.25
    l_draw = F.when(level & hw.between(1.01, 1.10), 25).otherwise(0) + F.when(level & has["level_draw"], 15).otherwise(0)
    l_away = F.when(level & ~has["level_draw"] & has["level_away"], 15).otherwise(0)
    w_down, w_up = water < -0.05, water > 0.05
    w_home = F.when(w_down, F.when(has["water_down"], 20).otherwise(10)).otherwise(0)
    b_home, b_away = F.when(label == "升盘降水", 15).otherwise(0), F.when(label == "降盘降水", 15).otherwise(0)
    parts_home = [e_home, F.when(dropped, 10).otherwise(0), w_home, b_home]
    parts_draw = [l_draw]
    parts_away = [e_away, F.when(trapped, 20).otherwise(0), l_away, F.when(w_up, 10).otherwise(0), b_away]
    home, draw, away = (sum(p, F.lit(0)) for p in (parts_home, parts_draw, parts_away))
    text = lambda c: c.cast("string")
    by = lambda head, c: F.concat(F.lit(head), fixed(F.abs(c)))
    lg, shown = F.col("league"), F.col("line_text")
    has_line = F.coalesce(label.isin("升盘降水", "降盘降水"), F.lit(False))
    reasons = _texts(
        (e_home == 30, F.concat(F.lit("欧赔主胜"), text(win), F.lit("极低，强看主"))), (e_home == 15, F.concat(F.lit("欧赔主胜"), text(win), F.lit("偏低"))),
        (e_away == 30, F.concat(F.lit("欧赔客胜"), text(lose), F.lit("极低，强看客"))), (e_away == 15, F.concat(F.lit("欧赔客胜"), text(lose), F.lit("偏低"))),
        (trapped, F.concat(lg, by("主赔降", drop), F.lit("，诱盘信号，反向博客"))), (dropped, by("主赔降", drop)),
        (level & hw.between(1.01, 1.10), F.concat(F.lit("平手盘中高水"), text(hw), F.lit("，高平局概率"))),
        (level & has["level_draw"], F.concat(lg, F.lit("平手盘高平局"))), (level & ~has["level_draw"] & has["level_away"], F.concat(lg, F.lit("平手盘客胜率高"))),
        (line >= 1.5, F.concat(F.lit("深盘"), shown, F.lit("，博受让"))), (line <= -1.5, F.concat(F.lit("反向深盘"), shown, F.lit("，博让方"))),
        (w_down & has["water_down"], F.concat(by("降水", water), F.lit("，"), lg, F.lit("降水信号强"))), (w_down & ~has["water_down"], by("主水降", water)), (w_up, by("主水升", water)),
        (has_line & (label == "升盘降水"), "升盘降水，机构看好主队"), (has_line & (label == "降盘降水"), "降盘降水，机构看好客队"),
        (total.isNotNull() & has["high_goals"], F.concat(lg, F.lit("高进球联赛，倾向大球"))), (total.isNotNull() & ~has["high_goals"] & has["low_goals"], F.concat(lg, F.lit("低进球联赛，倾向小球"))),
        (total.isNotNull() & level, "平手盘比赛胶着，倾向小球"),
    )
    warnings = _texts((trapped, "诱盘联赛"), (label.isin("升盘升水", "降盘升水"), F.concat(label, F.lit("可能诱盘"))))
    asian = F.when(w_down & has["water_down"], "让胜").when(line >= 1.5, "受让方").when(line <= -1.5, "让方")
    ou = F.when(total.isNotNull(), F.when(level, "小球").when(has["high_goals"], "大球").when(has["low_goals"], "小球"))
    top = F.greatest(home, draw, away)
    u = u.withColumns({"hs": home, "ds": draw, "as_": away, "top": top, "reason_texts": reasons, "warning_texts": warnings}).withColumn("reasons", F.size("reason_texts"))
    pick = F.when(F.col("top") <= 0, "难以判断").when(F.col("hs") == F.col("top"), "home").when(F.col("as_") == F.col("top"), "away").otherwise("draw")
    conf = F.when(pick == "难以判断", 40).when(pick == "draw", F.least(F.lit(85), 50 + F.col("top"))).otherwise(F.least(F.lit(90), 50 + F.col("top")))
    conf = F.when((pick != "难以判断") & (F.col("reasons") < 2), F.greatest(F.lit(40), conf - 20)).otherwise(conf)
    return u.select("match_id", "league", "match_time", F.col("hs").alias("home_score_points"), F.col("ds").alias("draw_points"), F.col("as_").alias("away_points"), pick.alias("pick"), conf.cast("int").alias("confidence"), "reasons", asian.alias("asian_pick"), ou.alias("ou_pick"), (F.size("warning_texts") > 0).alias("warning"), "reason_texts", "warning_texts")


def pattern_report(m: DataFrame, **options) -> DataFrame:
    """Pattern predictions as lists show them: stars, mark, and the first three reasons and all warnings as texts."""
    p = predict_by_patterns(m, **options)
    return p.select("match_id", "pick", "confidence", stars(F.col("confidence")).alias("stars"), confidence_mark(F.col("confidence")).alias("mark"), F.concat_ws(" | ", F.slice("reason_texts", 1, 3)).alias("reason_text"), F.concat_ws(", ", "warning_texts").alias("warning_text"))


def pattern_recommendations(m: DataFrame, **options) -> DataFrame:
    """Sections of the pattern predictions: decided at 65 or more, draws at 55 or more, over, under, warnings."""
    p = predict_by_patterns(m, **options)
    sections = [("main", (F.col("confidence") >= 65) & F.col("pick").isin("home", "away", "draw"), 5), ("draw", (F.col("pick") == "draw") & (F.col("confidence") >= 55), 3), ("over", F.col("ou_pick") == "大球", 3), ("under", F.col("ou_pick") == "小球", 3), ("trap", F.col("warning"), 3)]
    # one pass: each row once for each section that it is in, then the first of each section
    kinds = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("section"), F.lit(k).alias("k"))) for name, test, k in sections]))
    rows = p.select("match_id", "pick", "confidence", F.explode(kinds).alias("s")).select("match_id", "pick", "confidence", "s.*")
    w = Window.partitionBy("section").orderBy(F.desc("confidence"), "match_id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn <= 5 AND rn <= k").select("section", "match_id", "pick", "confidence")


def movement_report(m: DataFrame, api: bool = True, eligible: bool = False) -> DataFrame:
    """Euro and Asian movement of every match, or of those with all six euro odds or both Asian lines only."""
    m = m.join(movement_eligible(m).select("match_id"), "match_id", "left_semi") if eligible else m
    c = F.col
    e = euro_movement((c("win0"), c("win1")), (c("draw0"), c("draw1")), (c("lose0"), c("lose1")))
    s = asian_movement((c("asian_initial_handicap"), c("asian_current_handicap")), (c("asian_initial_home_odds"), c("asian_current_home_odds")), (c("asian_initial_away_odds"), c("asian_current_away_odds")), api)
    return m.withColumns({"e": e, "s": s}).select("match_id", c("e.win").alias("win_change"), c("e.draw").alias("draw_change"), c("e.lose").alias("lose_change"), F.size("e.texts").alias("n_texts"), F.concat_ws("；", c("e.texts")).alias("texts"), c("e.tendency").alias("tendency"), c("s.line").alias("line_change"), c("s.home").alias("home_change"), c("s.away").alias("away_change"), c("s.rule").alias("asian_rule"))


def review_predictions(m: DataFrame, predictions: DataFrame) -> DataFrame:
    """Unreviewed predictions of finished matches held against the score. A pick that is missing is stored as false and not counted."""
    f = m.where("status = 2 AND result IS NOT NULL").select("match_id", "league", "h", "a", "result")
    p = predictions.where("NOT coalesce(is_reviewed, false)").join(f, "match_id")
    c = F.col
    win = first_present(c("manual_win_prediction"), c("win_prediction"))
    asian, line = first_present(c("manual_asian_prediction"), c("asian_prediction")), first_present(c("manual_asian_handicap"), c("asian_handicap"))
    ok = {
        "win_correct": F.when(win.isNotNull(), win == c("result")),
        "asian_correct": F.when(asian.isNotNull(), F.coalesce(asian == asian_result(c("h"), c("a"), line, "review"), F.lit(False))),
        "ou_correct": F.when(first_present(c("ou_prediction")).isNotNull(), F.coalesce(c("ou_prediction") == ou_result(c("h"), c("a"), c("ou_total").try_cast("double")), F.lit(False))),
        "score_correct": F.when(c("predicted_home_score").isNotNull() & c("predicted_away_score").isNotNull(), (c("predicted_home_score") == c("h")) & (c("predicted_away_score") == c("a"))),
    }
    p = p.withColumns(ok)
    valid = F.array_compact(F.array(*[c(k) for k in ok]))
    p = p.withColumns({"total_predictions": F.size(valid), "correct_count": F.size(F.filter(valid, lambda x: x))}).where("total_predictions > 0")
    return p.select("match_id", "league", c("h").alias("actual_home_score"), c("a").alias("actual_away_score"), c("result").alias("actual_winner"), *[F.coalesce(c(k), F.lit(False)).alias(k) for k in ok], "correct_count", "total_predictions", pct(c("correct_count"), c("total_predictions")).alias("accuracy"), (first_present(c("manual_win_prediction")).isNotNull() | first_present(c("manual_asian_prediction")).isNotNull()).alias("is_manual"))


def review_summary(reviews: DataFrame, since: Column | None = None) -> DataFrame:
    """Accuracies over all rows and for each league, by grouping sets; a missing league is 未知. ``since``: reviewed after it only."""
    r = reviews if since is None else reviews.where(F.col("review_date") > since)
    r = r.withColumn("lg", F.coalesce("league", F.lit("未知")))
    g = r.rollup("lg").agg(F.grouping("lg").alias("whole"), F.count("*").alias("n"), *[count_of(F.col(f"{k}_correct")).alias(k) for k in ("win", "asian", "ou", "score")], F.round(F.avg("accuracy"), 6).alias("mean_accuracy"))
    mark = F.when(F.col("mean_accuracy") >= 75, 2).when(F.col("mean_accuracy") >= 50, 1).otherwise(0)
    return g.select(F.when(F.col("whole") == 0, F.col("lg")).alias("league"), "n", *[pct(F.col(k), F.col("n")).alias(f"{k}_pct") for k in ("win", "asian", "ou", "score")], "mean_accuracy", mark.alias("mark"))


def review_batch_stats(reviews: DataFrame) -> DataFrame:
    """One row for a batch of reviews: mean accuracy, right picks and their rates over all rows; no row for none."""
    g = reviews.agg(F.count("*").alias("n"), F.round(F.avg("accuracy"), 6).alias("mean_accuracy"), *[count_of(F.col(f"{k}_correct")).alias(f"{k}_right") for k in ("win", "asian", "ou")])
    return g.where("n > 0").select("*", *[pct(F.col(f"{k}_right"), F.col("n")).alias(f"{k}_pct") for k in ("win", "asian", "ou")])


def review_batch_leagues(reviews: DataFrame) -> DataFrame:
    """For each league of a batch: reviews, right picks and their rates, and how many were right at 75 % or more and at 50 % or more."""
    g = reviews.groupBy(F.coalesce("league", F.lit("未知")).alias("league")).agg(F.count("*").alias("n"), *[count_of(F.col(f"{k}_correct")).alias(f"{k}_right") for k in ("win", "asian", "ou")], count_of(F.col("accuracy") >= 75).alias("good"), count_of(F.col("accuracy") >= 50).alias("fair"))
    return g.select("*", *[pct(F.col(f"{k}_right"), F.col("n")).alias(f"{k}_pct") for k in ("win", "asian", "ou")])


def upsert_predictions(old: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per match: the columns that a new prediction has replace those of the old row, which keeps the others, such as manual picks.

    A match predicted anew is not reviewed and dates from ``now``. ``new`` has one row per match; columns that ``old`` lacks are left out.
    """
    fresh = new.withColumn("is_reviewed", F.lit(False))
    fresh = fresh if now is None else fresh.withColumn("predict_date", now)
    given = [c for c in old.columns if c in fresh.columns and c != "match_id"]
    kinds = dict(old.dtypes)
    updates = fresh.select(*[(F.col(c) if c in fresh.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in old.columns], F.lit(0).alias("seq"), F.array(*map(F.lit, given)).alias("present"))
    return upsert(old, updates, ["match_id"])


def apply_reviews(predictions: DataFrame, reviews: DataFrame, now: Column | None = None) -> DataFrame:
    """Predictions with all columns of their review and its date; those reviewed now are marked so, the others keep their state."""
    columns = [c for c in reviews.columns if c not in ("match_id", "league")]
    r = reviews.select("match_id", *columns, F.lit(True).alias("now"))
    p = predictions.drop(*columns).join(r, "match_id", "left").withColumn("is_reviewed", F.coalesce("now", "is_reviewed", F.lit(False)))
    return (p if now is None else p.withColumn("review_date", F.when(F.col("now"), now))).drop("now")


def predict_and_review(m: DataFrame, predictions: DataFrame, now: Column) -> DataFrame:
    """One run of the scheduled job: finished predictions are reviewed, then every upcoming match with odds is predicted anew."""
    reviewed = apply_reviews(predictions, review_predictions(m, predictions), now)
    return upsert_predictions(reviewed, predict_upcoming(m), now)


def high_confidence_count(predictions: DataFrame, bar: float = 80.0) -> DataFrame:
    test = (F.col("win_confidence") >= bar) | (F.col("asian_confidence") >= bar) | (F.col("ou_confidence") >= bar)
    return predictions.agg(count_of(test).alias("n"))


def ou_recommendations(m: DataFrame, least: float = 60.0) -> DataFrame:
    """Upcoming matches whose league and line had one side in ``least`` percent of five rows or more."""
    s = ou_stats_by_league_line(m).where(F.col("n") >= 5)
    u = m.where("status = 0 AND nullif(league, '') IS NOT NULL").select("match_id", "league", F.col("total").alias("line_value"))
    j = u.join(s.select("league", "line_value", F.col("n").alias("sample_size"), "over_pct", "under_pct"), ["league", "line_value"])
    side = F.when(F.col("over_pct") >= least, "大球").when(F.col("under_pct") >= least, "小球")
    return j.withColumn("recommendation", side).where("recommendation IS NOT NULL").withColumn("confidence", F.when(F.col("recommendation") == "大球", F.col("over_pct")).otherwise(F.col("under_pct")))
