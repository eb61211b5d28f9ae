"""DuckDB SQL of the predictors."""

from __future__ import annotations

from ..operators.teams_sql import FORM, OULINE, SIDES_HOME
from ..oracle import line, present, sign, sql
from ..testbed import FEATURES

nz = lambda c: f"nullif({c}, 0)"


def case(*rules: tuple[str, str], rest: str = "0") -> str:
    return "(CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in rules) + f" ELSE {rest} END)"


def names(k: str) -> str:
    return "(" + ", ".join(f"'{x}'" for x in FEATURES[k]) + ")"


_UP = f"""{FORM}, u AS (SELECT m.*, hf.wins_rate AS hr, af.wins_rate AS ar, hf.over_rate AS ho, af.over_rate AS ao, hf.avg_for AS hff, hf.avg_against AS hfa, af.avg_for AS aff, af.avg_against AS afa
  FROM m LEFT JOIN form hf ON hf.team = home_team LEFT JOIN form af ON af.team = away_team WHERE status = 0 AND {present('euro_current_win', 'euro_initial_win')} IS NOT NULL)"""
_ALL = "coalesce(win <> 0 AND draw <> 0 AND lose <> 0, FALSE)"
_W = [("win < 1.5", "home", 85), ("lose < 1.5", "away", 85), ("win < 2.0", "home", 70), ("lose < 2.0", "away", 70), ("draw < 3.2::DOUBLE", "draw", 60), ("win < lose", "home", 55), ("lose < win", "away", 55)]
_ASIA = "coalesce(hw <> 0 AND aw <> 0, FALSE)"
_ODD = "(hw > 1.0 AND aw < 0.85::DOUBLE)"
_EVEN = "(aw > 1.0 AND hw < 0.85::DOUBLE)"
_R = "((ho + ao) / 2)"
_UPCOMING = f"""WITH {_UP}, v AS (SELECT *, {case((f"NOT {_ALL}", "'draw'"), *[(t, f"'{p}'") for t, p, _ in _W], rest="'draw'")} AS wp, {case((f"NOT {_ALL}", "50"), *[(t, str(c)) for t, _, c in _W], rest="50")} AS wc,
    CASE WHEN hr - ar > 0.3::DOUBLE THEN 'home' WHEN hr - ar < -0.3::DOUBLE THEN 'away' END AS fav,
    CASE WHEN NOT {_ASIA} THEN 'home' WHEN {_EVEN} THEN 'away' WHEN {_ODD} THEN 'home' WHEN hw > aw THEN 'home' ELSE 'away' END AS sp, CASE WHEN NOT {_ASIA} THEN 50 WHEN {_ODD} OR {_EVEN} THEN 70 ELSE 60 END AS sc,
    CASE WHEN {_R} > 0.7::DOUBLE THEN 'over' WHEN {_R} < 0.3::DOUBLE THEN 'under' WHEN {_R} > 0.55::DOUBLE THEN 'over' WHEN {_R} < 0.45::DOUBLE THEN 'under' ELSE 'over' END AS gp,
    CASE WHEN {_R} > 0.7::DOUBLE OR {_R} < 0.3::DOUBLE THEN 70 WHEN {_R} > 0.55::DOUBLE OR {_R} < 0.45::DOUBLE THEN 60 ELSE 50 END AS gc,
    CAST(round_even(hff, 0) AS INT) AS rh, CAST(round_even(aff, 0) AS INT) AS ra FROM u)
  SELECT match_id, league, match_time, home_team, away_team, wp AS win_prediction,
    CAST(CASE WHEN fav = wp THEN least(wc + 10, 90) WHEN (fav = 'home' AND wp = 'away') OR (fav = 'away' AND wp = 'home') THEN greatest(wc - 10, 50) ELSE wc END AS DOUBLE) AS win_confidence,
    sp AS asian_prediction, CAST(sc AS DOUBLE) AS asian_confidence, line_text AS asian_handicap, gp AS ou_prediction,
    CAST(CASE WHEN ({nz('over')} > 1.0 AND {nz('under')} < 0.85::DOUBLE AND gp = 'over') OR ({nz('under')} > 1.0 AND {nz('over')} < 0.85::DOUBLE AND gp = 'under') THEN least(gc + 10, 75) ELSE gc END AS DOUBLE) AS ou_confidence, total AS ou_total,
    CASE WHEN hff IS NULL OR aff IS NULL THEN CASE wp WHEN 'home' THEN 2 WHEN 'away' THEN 0 ELSE 1 END WHEN wp = 'home' THEN CASE WHEN rh <= ra THEN ra + 1 ELSE rh END WHEN wp = 'draw' THEN greatest(1, least(rh, ra)) ELSE rh END AS predicted_home_score,
    CASE WHEN hff IS NULL OR aff IS NULL THEN CASE wp WHEN 'home' THEN 0 WHEN 'away' THEN 2 ELSE 1 END WHEN wp = 'away' THEN CASE WHEN ra <= rh THEN rh + 1 ELSE ra END WHEN wp = 'draw' THEN greatest(1, least(rh, ra)) ELSE ra END AS predicted_away_score FROM v"""

_SUMMED = {"wins": "outcome = 'win'", "over": f"goals > {OULINE}", "under": f"goals < {OULINE}"}
_BEFORE = f"""{SIDES_HOME}, kf AS (SELECT *, concat_ws(' ', coalesce(owner_date, ''), right(coalesce(match_time, ''), 5)) AS kick FROM s),
  kw AS (SELECT match_id, team, at_home, kick, count(*) OVER w AS matches, {", ".join(f"coalesce(sum(CASE WHEN {t} THEN 1 ELSE 0 END) OVER w, 0) AS {k}" for k, t in _SUMMED.items())}, coalesce(sum(CASE WHEN outcome IS NOT NULL THEN gf END) OVER w, 0) AS gf, coalesce(sum(CASE WHEN outcome IS NOT NULL THEN ga END) OVER w, 0) AS ga
    FROM kf WINDOW w AS (PARTITION BY team ORDER BY kick, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
  ks AS (SELECT match_id, team, at_home, {", ".join(f"first_value({c}) OVER t AS {c}" for c in ("matches", "wins", "over", "under", "gf", "ga"))} FROM kw WINDOW t AS (PARTITION BY team, kick ORDER BY match_id)),
  kr AS (SELECT match_id, at_home, wins * 1.0::DOUBLE / matches AS wr, over * 1.0::DOUBLE / matches AS o_r, gf * 1.0::DOUBLE / matches AS f, ga * 1.0::DOUBLE / matches AS g FROM ks WHERE matches > 0),
  u AS (SELECT m.*, x.wr AS hr, y.wr AS ar, x.o_r AS ho, y.o_r AS ao, x.f AS hff, x.g AS hfa, y.f AS aff, y.g AS afa
    FROM m LEFT JOIN kr x ON x.match_id = m.match_id AND x.at_home LEFT JOIN kr y ON y.match_id = m.match_id AND NOT y.at_home WHERE status = 2 AND m.result IS NOT NULL AND {present('euro_current_win', 'euro_initial_win')} IS NOT NULL)"""


def _best(prefix: str) -> str:
    """Ties home, draw, away."""
    h, d, a = (f"{prefix}{x}" for x in "hda")
    top = f"greatest({h}, {d}, {a})"
    middle = f"({h} + {d} + {a} - {top} - least({h}, {d}, {a}))"
    return f"CASE WHEN {h} = {top} THEN 'home' WHEN {d} = {top} THEN 'draw' ELSE 'away' END AS {prefix}pick, least(90, 50 + 8 * ({top} - {middle}) + 3 * {top}) AS {prefix}conf"


_w, _d, _l, _a, _b, _c, _t = nz("win1"), nz("draw1"), nz("lose1"), nz("hh1"), nz("hd1"), nz("ha1"), nz("total")
_low = f"least({_a}, {_b}, {_c})"
_f2, _f1 = (lambda x: f"format('{{:.2f}}', {x})"), (lambda x: f"format('{{:.1f}}', {x})")
_said = lambda *rules: "list_filter([" + ", ".join(f"CASE WHEN {t} THEN {v} END" for t, v in rules) + "], lambda x: x IS NOT NULL)"
_DAILY = f"""ga AS (SELECT league, sum(goals) * 1.0::DOUBLE / count(*) AS avg_goals FROM f WHERE result IS NOT NULL GROUP BY 1 HAVING count(*) >= 10),
  u AS (SELECT m.*, coalesce(avg_goals, 2.8::DOUBLE) AS mean FROM m LEFT JOIN ga USING (league) WHERE status = 0),
  w AS (SELECT *, coalesce(win1 <> 0 AND draw1 <> 0 AND lose1 <> 0, FALSE) AS three, {_t} IS NOT NULL AND {nz('over')} IS NOT NULL AND {nz('under')} IS NOT NULL AS priced FROM u),
  v AS (SELECT *, {case((f"three AND win1 < 1.5", "4"), (f"three AND win1 < 1.7::DOUBLE", "3"), (f"three AND win1 < 2.0", "2"))} + {case((f"{nz('win0')} - {_w} > 0.15::DOUBLE", "2"), (f"{nz('win0')} - {_w} < -0.12::DOUBLE", "-1"))} AS rh,
    {case(("three AND win1 > 2.6::DOUBLE", "2"))} + {case(("three AND lose1 < 1.7::DOUBLE", "4"), ("three AND lose1 < 2.0", "3"), ("three AND lose1 < 2.3::DOUBLE", "2"))} + {case((f"{nz('lose0')} - {_l} > 0.15::DOUBLE", "2"))} AS ra,
    {case(("three AND draw1 < 3.1::DOUBLE", "2"), ("three AND draw1 > 3.6::DOUBLE", "-1"))} + {case(("league IN ('意甲', '德乙', '西甲', '法乙')", "2"))} AS rd,
    {case((f"{_a} = {_low}", "3"))} + {case((f"{_a} < 1.8::DOUBLE", "3"), (f"{_a} < 2.1::DOUBLE", "2"))} + {case((f"{nz('hh0')} - {_a} > 0.15::DOUBLE", "2"))} AS ih,
    {case((f"{_b} = {_low}", "3"))} + {case((f"{_b} < 3.0", "2"), (f"{_b} < 3.5", "1"))} + {case((f"{nz('hd0')} - {_b} > 0.15::DOUBLE", "2"))} + {case(("index_line = 0", "1"))} AS id,
    {case((f"{_c} = {_low}", "3"))} + {case((f"{_c} < 1.8::DOUBLE", "3"), (f"{_c} < 2.2::DOUBLE", "2"))} + {case((f"{nz('ha0')} - {_c} > 0.15::DOUBLE", "2"))} + {case(("abs(index_line) >= 2", "1"))} AS ia,
    {_a} IS NOT NULL AND {_b} IS NOT NULL AND {_c} IS NOT NULL AS whole, list_sort([{_a}, {_b}, {_c}])[2] - {_low} AS gap,
    CASE WHEN {_t} <= 2.0 THEN '0-1' WHEN {_t} <= 2.25 THEN '1-2' WHEN {_t} <= 2.5 THEN CASE WHEN mean < 2.5 THEN '1-2' ELSE '2-3' END WHEN {_t} <= 2.75 THEN '2-3' WHEN {_t} <= 3.0 THEN CASE WHEN mean >= 3 THEN '3-4' ELSE '2-3' END WHEN {_t} <= 3.5 THEN '3-4' WHEN {_t} IS NOT NULL THEN '4-6'
      WHEN mean >= 3.2::DOUBLE THEN '3-4' WHEN mean <= 2.4::DOUBLE THEN '1-2' ELSE '2-3' END AS b0,
    CASE WHEN {_t} <= 2.0 THEN 85 WHEN {_t} <= 2.25 THEN 78 WHEN {_t} <= 2.5 THEN 72 WHEN {_t} <= 2.75 THEN 75 WHEN {_t} <= 3.0 THEN CASE WHEN mean >= 3 THEN 75 ELSE 70 END WHEN {_t} <= 3.5 THEN 68 WHEN {_t} IS NOT NULL THEN 60 WHEN mean >= 3.2::DOUBLE OR mean <= 2.4::DOUBLE THEN 65 ELSE 60 END AS c0,
    priced AND "over" < 0.82::DOUBLE AS by_over, priced AND "over" >= 0.82::DOUBLE AND "under" < 0.82::DOUBLE AS by_under FROM w),
  x AS (SELECT *, {_best('r')}, {_best('i')} FROM v),
  d AS (SELECT match_id, league, match_time, home_team, away_team, rpick AS result_pick, CAST(rconf AS INT) AS result_conf, CASE WHEN whole THEN ipick END AS hi_pick, CAST(CASE WHEN whole THEN least(90, iconf + CASE WHEN gap > 0.5 THEN 10 ELSE 0 END) ELSE 0 END AS INT) AS hi_conf,
    CASE WHEN by_over AND b0 = '2-3' THEN '3-4' WHEN by_under AND b0 = '2-3' THEN '1-2' WHEN by_under AND b0 = '3-4' THEN '2-3' ELSE b0 END AS goal_band, CAST(least(90, c0 + CASE WHEN by_over OR by_under THEN 5 ELSE 0 END) AS INT) AS goal_conf,
    {_said(("three AND win1 < 1.5", "'主胜赔极低' || " + _f2("win1")), ("three AND win1 >= 1.5 AND win1 < 1.7::DOUBLE", "'主胜赔低' || " + _f2("win1")), ("three AND win1 > 2.6::DOUBLE", "'主胜赔高' || " + _f2("win1")), ("three AND lose1 < 1.7::DOUBLE", "'客胜赔极低' || " + _f2("lose1")), ("three AND lose1 >= 1.7::DOUBLE AND lose1 < 2.0", "'客胜赔低' || " + _f2("lose1")), ("three AND draw1 < 3.1::DOUBLE", "'平赔低' || " + _f2("draw1")), (f"{nz('win0')} - {_w} > 0.15::DOUBLE", "'主胜赔降'"), (f"{nz('lose0')} - {_l} > 0.15::DOUBLE", "'客胜赔降'"), ("league IN ('意甲', '德乙', '西甲', '法乙')", "'高平局联赛'"))} AS result_reasons,
    CASE WHEN whole THEN {_said((f"{_a} < 1.8::DOUBLE", "'让胜赔低' || " + _f2("hh1")), (f"{_b} < 3.0", "'让平赔低' || " + _f2("hd1")), (f"{_c} < 1.8::DOUBLE", "'让负赔低' || " + _f2("ha1")), (f"{_c} >= 1.8::DOUBLE AND {_c} < 2.2::DOUBLE", "'让负赔较低' || " + _f2("ha1")), (f"{nz('hh0')} - {_a} > 0.15::DOUBLE", "'让胜赔降'"), (f"{nz('hd0')} - {_b} > 0.15::DOUBLE", "'让平赔降'"), (f"{nz('ha0')} - {_c} > 0.15::DOUBLE", "'让负赔降'"), ("abs(index_line) >= 2", "'深让' || CAST(CAST(trunc(abs(index_line)) AS INT) AS VARCHAR) || '球'"), ("abs(index_line) = 1", "'让1球'"), ("index_line = 0", "'平手盘'"))} ELSE [] END AS hi_reasons,
    list_filter([CASE WHEN {_t} <= 2.0 THEN '极低盘口' || {_f1('total')} WHEN {_t} <= 2.25 THEN '低盘口' || {_f1('total')} WHEN {_t} <= 2.5 THEN '盘口' || {_f1('total')} || CASE WHEN mean < 2.5 THEN '+低进球联赛' ELSE '' END WHEN {_t} <= 2.75 THEN '盘口' || {_f1('total')} WHEN {_t} <= 3.0 THEN CASE WHEN mean >= 3 THEN '高进球联赛+盘口' ELSE '盘口' END || {_f1('total')} WHEN {_t} <= 3.5 THEN '高盘口' || {_f1('total')} WHEN {_t} IS NOT NULL THEN '极高盘口' || {_f1('total')}
      WHEN mean >= 3.2::DOUBLE THEN '高进球联赛' || {_f1('mean')} WHEN mean <= 2.4::DOUBLE THEN '低进球联赛' || {_f1('mean')} ELSE '联赛场均' || {_f1('mean')} END, CASE WHEN by_over THEN '大球低水' WHEN by_under THEN '小球低水' END], lambda x: x IS NOT NULL) AS goal_reasons FROM x)"""
_L = line("line_text", "level")
_lv = f"abs({_L}) <= 0.25"
_pw, _pl, _hw, _wt = nz("win"), nz("lose"), nz("hw"), f"({nz('hw')} - {nz('hw0')})"
_drop = f"(CASE WHEN {_pl} IS NOT NULL THEN {_pw} - {nz('win0')} END)"
_both = f"{_pw} IS NOT NULL AND {_pl} IS NOT NULL"
_in = lambda k: f"coalesce(league IN {names(k)}, FALSE)"
_PATTERNS = f"""b AS (SELECT *, {case((f"{_both} AND {_pw} < 1.8::DOUBLE", "30"), (f"{_both} AND {_pw} < 2.2::DOUBLE", "15"))} AS eh, {case((f"{_both} AND {_pw} >= 2.2::DOUBLE AND {_pl} < 1.8::DOUBLE", "30"), (f"{_both} AND {_pw} >= 2.2::DOUBLE AND {_pl} < 2.2::DOUBLE", "15"))} AS ea,
    coalesce({_drop} < -0.15::DOUBLE, FALSE) AS dr, {_L} AS lv, coalesce({_lv}, FALSE) AS level, coalesce({_lv} AND {_hw} BETWEEN 1.01::DOUBLE AND 1.10::DOUBLE, FALSE) AS mid, coalesce({_wt} < -0.05::DOUBLE, FALSE) AS dn, coalesce({_wt} > 0.05::DOUBLE, FALSE) AS up FROM m WHERE status = 0),
  s AS (SELECT *, eh + {case((f"dr AND NOT {_in('trap')}", "10"))} + {case((f"dn AND {_in('water_down')}", "20"), ("dn", "10"))} + {case(("label = '升盘降水'", "15"))} AS hs,
    {case(("mid", "25"))} + {case((f"level AND {_in('level_draw')}", "15"))} AS ds,
    ea + {case((f"dr AND {_in('trap')}", "20"))} + {case((f"level AND NOT {_in('level_draw')} AND {_in('level_away')}", "15"))} + {case(("up", "10"))} + {case(("label = '降盘降水'", "15"))} AS xs,
    {_said(("eh = 30", f"'欧赔主胜' || {_pw} || '极低，强看主'"), ("eh = 15", f"'欧赔主胜' || {_pw} || '偏低'"), ("ea = 30", f"'欧赔客胜' || {_pl} || '极低，强看客'"), ("ea = 15", f"'欧赔客胜' || {_pl} || '偏低'"),
      (f"dr AND {_in('trap')}", f"league || '主赔降' || {_f2('abs(' + _drop + ')')} || '，诱盘信号，反向博客'"), (f"dr AND NOT {_in('trap')}", f"'主赔降' || {_f2('abs(' + _drop + ')')}"), ("mid", f"'平手盘中高水' || {_hw} || '，高平局概率'"),
      (f"level AND {_in('level_draw')}", "league || '平手盘高平局'"), (f"level AND NOT {_in('level_draw')} AND {_in('level_away')}", "league || '平手盘客胜率高'"), ("lv >= 1.5", "'深盘' || line_text || '，博受让'"), ("lv <= -1.5", "'反向深盘' || line_text || '，博让方'"),
      (f"dn AND {_in('water_down')}", f"'降水' || {_f2('abs(' + _wt + ')')} || '，' || league || '降水信号强'"), (f"dn AND NOT {_in('water_down')}", f"'主水降' || {_f2('abs(' + _wt + ')')}"), ("up", f"'主水升' || {_f2('abs(' + _wt + ')')}"),
      ("label = '升盘降水'", "'升盘降水，机构看好主队'"), ("label = '降盘降水'", "'降盘降水，机构看好客队'"), (f"{_t} IS NOT NULL AND {_in('high_goals')}", "league || '高进球联赛，倾向大球'"), (f"{_t} IS NOT NULL AND NOT {_in('high_goals')} AND {_in('low_goals')}", "league || '低进球联赛，倾向小球'"), (f"{_t} IS NOT NULL AND level", "'平手盘比赛胶着，倾向小球'"))} AS reason_texts,
    {_said((f"dr AND {_in('trap')}", "'诱盘联赛'"), ("label IN ('升盘升水', '降盘升水')", "label || '可能诱盘'"))} AS warning_texts FROM b),
  q AS (SELECT *, CAST(len(reason_texts) AS INT) AS reasons, greatest(hs, ds, xs) AS top, CASE WHEN greatest(hs, ds, xs) <= 0 THEN '难以判断' WHEN hs = greatest(hs, ds, xs) THEN 'home' WHEN xs = greatest(hs, ds, xs) THEN 'away' ELSE 'draw' END AS pick FROM s),
  p AS (SELECT match_id, league, match_time, hs AS home_score_points, ds AS draw_points, xs AS away_points, pick,
    CAST(CASE WHEN pick = '难以判断' THEN 40 WHEN reasons < 2 THEN greatest(40, least(CASE WHEN pick = 'draw' THEN 85 ELSE 90 END, 50 + top) - 20) ELSE least(CASE WHEN pick = 'draw' THEN 85 ELSE 90 END, 50 + top) END AS INT) AS confidence, reasons,
    CASE WHEN dn AND {_in('water_down')} THEN '让胜' WHEN lv >= 1.5 THEN '受让方' WHEN lv <= -1.5 THEN '让方' END AS asian_pick,
    CASE WHEN {_t} IS NOT NULL THEN CASE WHEN level THEN '小球' WHEN {_in('high_goals')} THEN '大球' WHEN {_in('low_goals')} THEN '小球' END END AS ou_pick,
    len(warning_texts) > 0 AS warning, reason_texts, warning_texts FROM q)"""
_sect = lambda n, t, k: f"(SELECT '{n}' AS section, match_id, pick, confidence FROM p WHERE {t} ORDER BY confidence DESC, match_id LIMIT {k})"
_rd = lambda x: f"round_even({x}, 2)"
_DG = f"({line('asian_current_handicap', 'digits')} - {line('asian_initial_handicap', 'digits')})"
_e = lambda x: f"({x}1 - {x}0)"
_six = f"({_e('win')} + {_e('draw')} + {_e('lose')}) IS NOT NULL"
_MOVES = _said(*[(f"{_e(x)} {test}::DOUBLE", f"'{n}{arrow}'") for x, n in (("win", "主胜"), ("draw", "平局"), ("lose", "客胜")) for test, arrow in (("> 0.05", "↑"), ("< -0.05", "↓"))])
_win = present("manual_win_prediction", "win_prediction")
_asian, _line = present("manual_asian_prediction", "asian_prediction"), present("manual_asian_handicap", "asian_handicap")
_REVIEWS = f"""j AS (SELECT p.*, f.league, f.h, f.a, f.result FROM predictions p JOIN f ON f.match_id = p.match_id WHERE NOT coalesce(is_reviewed, FALSE) AND f.result IS NOT NULL),
  k AS (SELECT *, CASE WHEN {_win} IS NOT NULL THEN {_win} = result END AS w, CASE WHEN {_asian} IS NOT NULL THEN coalesce({_asian} = ({sign(f"(h + {line(_line, 'strict')} - a)", 'home', 'push', 'away')}), FALSE) END AS s,
    CASE WHEN {present('ou_prediction')} IS NOT NULL THEN coalesce(ou_prediction = ({sign('(h + a - TRY_CAST(ou_total AS DOUBLE))', 'over', 'push', 'under')}), FALSE) END AS o,
    CASE WHEN predicted_home_score IS NOT NULL AND predicted_away_score IS NOT NULL THEN predicted_home_score = h AND predicted_away_score = a END AS c FROM j),
  r AS (SELECT match_id, league, h AS actual_home_score, a AS actual_away_score, result AS actual_winner, coalesce(w, FALSE) AS win_correct, coalesce(s, FALSE) AS asian_correct, coalesce(o, FALSE) AS ou_correct, coalesce(c, FALSE) AS score_correct,
    coalesce(w, FALSE)::INT + coalesce(s, FALSE)::INT + coalesce(o, FALSE)::INT + coalesce(c, FALSE)::INT AS correct_count, (w IS NOT NULL)::INT + (s IS NOT NULL)::INT + (o IS NOT NULL)::INT + (c IS NOT NULL)::INT AS total_predictions, {present('manual_win_prediction')} IS NOT NULL OR {present('manual_asian_prediction')} IS NOT NULL AS is_manual FROM k),
  rv AS (SELECT *, 100.0::DOUBLE * correct_count / total_predictions AS accuracy FROM r WHERE total_predictions > 0)"""

SQL = {
    "predict_upcoming": sql(_UPCOMING),
    "daily_predictions": sql(f"WITH {_DAILY} SELECT * FROM d"),
    "daily_top": sql(f"WITH {_DAILY} " + " UNION ALL ".join(f"(SELECT '{k}' AS kind, match_id, {c} AS confidence FROM d WHERE {c} > 0 ORDER BY {c} DESC, match_time, match_id LIMIT 3)" for k, c in (("result", "result_conf"), ("index", "hi_conf"), ("goals", "goal_conf")))),
    "predict_by_patterns": sql(f"WITH {_PATTERNS} SELECT * FROM p"),
    "pattern_report": sql(f"WITH {_PATTERNS} SELECT match_id, pick, confidence, repeat('★', CAST(confidence // 20 AS INT)) || repeat('☆', CAST(5 - confidence // 20 AS INT)) AS stars, CASE WHEN confidence >= 70 THEN 2 WHEN confidence >= 60 THEN 1 ELSE 0 END AS mark, array_to_string(reason_texts[1:3], ' | ') AS reason_text, array_to_string(warning_texts, ', ') AS warning_text FROM p"),
    "pattern_recommendations": sql(f"WITH {_PATTERNS} " + " UNION ALL ".join((_sect("main", "confidence >= 65 AND pick IN ('home', 'away', 'draw')", 5), _sect("draw", "pick = 'draw' AND confidence >= 55", 3), _sect("over", "ou_pick = '大球'", 3), _sect("under", "ou_pick = '小球'", 3), _sect("trap", "warning", 3)))),
    "movement_report": sql(f"""SELECT match_id, CASE WHEN {_six} THEN {_e('win')} END AS win_change, CASE WHEN {_six} THEN {_e('draw')} END AS draw_change, CASE WHEN {_six} THEN {_e('lose')} END AS lose_change,
      CASE WHEN {_six} THEN (abs({_e('win')}) > 0.05::DOUBLE)::INT + (abs({_e('draw')}) > 0.05::DOUBLE)::INT + (abs({_e('lose')}) > 0.05::DOUBLE)::INT END AS n_texts,
      CASE WHEN {_six} THEN array_to_string({_MOVES}, '；') ELSE '' END AS texts,
      CASE WHEN {_six} THEN CASE WHEN {_e('win')} < -0.1::DOUBLE THEN 'home' WHEN {_e('lose')} < -0.1::DOUBLE THEN 'away' WHEN {_e('draw')} < -0.1::DOUBLE THEN 'draw' END END AS tendency,
      {_rd(_DG)} AS line_change, CASE WHEN {_DG} IS NOT NULL THEN {_rd(_e('hw'))} END AS home_change, CASE WHEN {_DG} IS NOT NULL THEN {_rd(_e('aw'))} END AS away_change,
      CASE WHEN {_rd(_DG)} > 0.1::DOUBLE AND {_rd(_e('hw'))} < 0 THEN '升盘降水' WHEN {_rd(_DG)} < -0.1::DOUBLE AND {_rd(_e('aw'))} < 0 THEN '降盘降水' WHEN {_rd(_DG)} > 0.1::DOUBLE AND {_rd(_e('hw'))} > 0 THEN '升盘升水' WHEN {_rd(_DG)} < -0.1::DOUBLE AND {_rd(_e('aw'))} > 0 THEN '降盘升水' END AS asian_rule FROM m"""),
    "review_predictions": sql(f"WITH {_REVIEWS} SELECT * FROM rv", "predictions"),
    "review_summary": sql(f"""WITH {_REVIEWS} SELECT league, n, win_pct, asian_pct, ou_pct, score_pct, mean_accuracy, CASE WHEN mean_accuracy >= 75 THEN 2 WHEN mean_accuracy >= 50 THEN 1 ELSE 0 END AS mark FROM (
      SELECT lg AS league, count(*) AS n, {', '.join(f"100.0::DOUBLE * count(*) FILTER ({k}_correct) / count(*) AS {k}_pct" for k in ('win', 'asian', 'ou', 'score'))}, round(avg(accuracy), 6) AS mean_accuracy FROM (SELECT *, coalesce(league, '未知') AS lg FROM rv) GROUP BY ROLLUP (lg))""", "predictions"),
    "high_confidence_count": sql("SELECT count(*) FILTER (win_confidence >= 80 OR asian_confidence >= 80 OR ou_confidence >= 80) AS n FROM predictions", "predictions"),
    "ou_recommendations": sql("""WITH s AS (SELECT league, total AS line_value, count(*) AS sample_size, 100.0::DOUBLE * count(*) FILTER (ou = 'over') / count(*) AS over_pct, 100.0::DOUBLE * count(*) FILTER (ou = 'under') / count(*) AS under_pct FROM f WHERE result IS NOT NULL AND total IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5)
      SELECT *, CASE recommendation WHEN '大球' THEN over_pct ELSE under_pct END AS confidence FROM (SELECT m.match_id, s.*, CASE WHEN over_pct >= 60 THEN '大球' WHEN under_pct >= 60 THEN '小球' END AS recommendation FROM m JOIN s ON s.league = m.league AND s.line_value = m.total WHERE status = 0 AND nullif(m.league, '') IS NOT NULL) WHERE recommendation IS NOT NULL"""),
    "review_batch_stats": sql(f"WITH {_REVIEWS} SELECT *, 100.0::DOUBLE * win_right / n AS win_pct, 100.0::DOUBLE * asian_right / n AS asian_pct, 100.0::DOUBLE * ou_right / n AS ou_pct FROM (SELECT count(*) AS n, round(avg(accuracy), 6) AS mean_accuracy, count(*) FILTER (win_correct) AS win_right, count(*) FILTER (asian_correct) AS asian_right, count(*) FILTER (ou_correct) AS ou_right FROM rv)", "predictions"),
    "review_batch_leagues": sql(f"WITH {_REVIEWS} SELECT *, 100.0::DOUBLE * win_right / n AS win_pct, 100.0::DOUBLE * asian_right / n AS asian_pct, 100.0::DOUBLE * ou_right / n AS ou_pct FROM (SELECT coalesce(league, '未知') AS league, count(*) AS n, count(*) FILTER (win_correct) AS win_right, count(*) FILTER (asian_correct) AS asian_right, count(*) FILTER (ou_correct) AS ou_right, count(*) FILTER (accuracy >= 75) AS good, count(*) FILTER (accuracy >= 50) AS fair FROM rv GROUP BY 1)", "predictions"),
    "review_summary_of_days": sql(f"""WITH {_REVIEWS}, dated AS (SELECT rv.*, coalesce(league, '未知') AS lg FROM rv JOIN predictions p ON p.match_id = rv.match_id WHERE p.predict_date > TIMESTAMP '1997-06-01') SELECT league, n, win_pct, asian_pct, ou_pct, score_pct, mean_accuracy, CASE WHEN mean_accuracy >= 75 THEN 2 WHEN mean_accuracy >= 50 THEN 1 ELSE 0 END AS mark FROM (
      SELECT lg AS league, count(*) AS n, {', '.join(f"100.0::DOUBLE * count(*) FILTER ({k}_correct) / count(*) AS {k}_pct" for k in ('win', 'asian', 'ou', 'score'))}, round(avg(accuracy), 6) AS mean_accuracy FROM dated GROUP BY ROLLUP (lg))""", "predictions"),
    "apply_reviews": sql(f"WITH {_REVIEWS} SELECT p.match_id, coalesce(rv.match_id IS NOT NULL OR p.is_reviewed, FALSE) AS is_reviewed, rv.correct_count, rv.accuracy, rv.actual_winner, rv.actual_home_score, rv.win_correct, CASE WHEN rv.match_id IS NOT NULL THEN TIMESTAMP '2024-05-01' END AS review_date FROM predictions p LEFT JOIN rv ON rv.match_id = p.match_id", "predictions"),
    "predict_and_review": sql(f"{_UPCOMING.replace('SELECT match_id, league, match_time, home_team, away_team, wp AS win_prediction', ', up AS (SELECT match_id, wp AS win_prediction', 1)} ), {_REVIEWS} SELECT coalesce(p.match_id, up.match_id) AS match_id, CASE WHEN up.match_id IS NOT NULL THEN up.win_prediction ELSE p.win_prediction END AS win_prediction, up.match_id IS NULL AND coalesce(rv.match_id IS NOT NULL OR p.is_reviewed, FALSE) AS is_reviewed, rv.accuracy AS accuracy, p.manual_win_prediction, p.manual_asian_prediction, p.manual_asian_handicap FROM predictions p FULL JOIN up ON up.match_id = p.match_id LEFT JOIN rv ON rv.match_id = p.match_id", "predictions"),
    "predict_before": sql(_UPCOMING.replace(_UP, _BEFORE)),
    "backtest": sql(f"""{_UPCOMING.replace(_UP, _BEFORE).replace('SELECT match_id, league, match_time, home_team, away_team, wp AS win_prediction', ', pb AS (SELECT match_id, wp AS win_prediction', 1)} ), predictions AS (SELECT *, NULL::VARCHAR AS manual_win_prediction, NULL::VARCHAR AS manual_asian_prediction, NULL::VARCHAR AS manual_asian_handicap, FALSE AS is_reviewed FROM pb), {_REVIEWS},
      bt AS (SELECT unnest([{", ".join(f"{{'market': '{k}', 'confidence': {c}_confidence, 'hit': {k}_correct}}" for k, c in (("win", "win"), ("asian", "asian"), ("ou", "ou"), ("score", "win")))}]) AS r FROM pb JOIN rv USING (match_id))
      SELECT market, confidence, n, hits, 100.0::DOUBLE * hits / n AS hit_pct FROM (SELECT r.market AS market, r.confidence AS confidence, count(*) AS n, count(*) FILTER (r.hit) AS hits FROM bt GROUP BY GROUPING SETS ((r.market, r.confidence), (r.market)))"""),
    "predictions_list": sql("SELECT match_id, win_prediction, is_reviewed, predict_date FROM predictions WHERE NOT is_reviewed ORDER BY predict_date DESC NULLS LAST, match_id LIMIT 50", "predictions"),
    "daily_predictions_of_day": sql(f"WITH {_DAILY} SELECT d.* FROM d JOIN m USING (match_id) WHERE owner_date = '1996-03-05'"),
    "upsert_predictions": sql("SELECT match_id, CASE WHEN CAST(match_id AS BIGINT) % 3 = 0 THEN 'draw' ELSE win_prediction END AS win_prediction, CASE WHEN CAST(match_id AS BIGINT) % 3 = 0 THEN FALSE ELSE is_reviewed END AS is_reviewed, CASE WHEN CAST(match_id AS BIGINT) % 3 = 0 THEN TIMESTAMP '2024-05-01' ELSE predict_date END AS predict_date, manual_win_prediction, manual_asian_handicap FROM predictions", "predictions"),
}
