"""DuckDB SQL of the league operators."""

from __future__ import annotations

from ..oracle import sign, sql

_C = lambda x: f"(nullif({x}1, 0) - nullif({x}0, 0))"
_P = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE 100.0::DOUBLE * ({a}) / ({b}) END"
_N = lambda c: f"count(*) FILTER ({c})"
_DOWN, _UP = f"result IS NOT NULL AND {_C('hw')} < -0.03::DOUBLE", f"result IS NOT NULL AND {_C('hw')} > 0.03::DOUBLE"
_WIN, _LOSE = f"result IS NOT NULL AND {_C('win')} < -0.10::DOUBLE", f"result IS NOT NULL AND {_C('lose')} < -0.10::DOUBLE"
_DEEP, _LINE = "result IS NOT NULL AND line >= 1.5", "result IS NOT NULL AND total <> 0"

PROFILE = f"""p AS (SELECT league, count(*) AS total,
  {_P(_N("result = 'home'"), "count(result)")} AS home_pct, {_P(_N("result = 'draw'"), "count(result)")} AS draw_pct, {_P(_N("result = 'away'"), "count(result)")} AS away_pct, coalesce(avg(goals), 0) AS avg_goals,
  {_P(_N(_LINE + " AND ou = 'over'"), _N(_LINE))} AS over_pct, {_P(_N(_LINE + " AND ou = 'under'"), _N(_LINE))} AS under_pct,
  {_N(_DOWN)} AS down_n, {_P(_N(_DOWN + " AND result = 'home'"), _N(_DOWN))} AS down_home_pct, {_P(_N(_DOWN + " AND cover = 'home'"), _N(_DOWN + " AND cover IN ('home', 'away')"))} AS down_cover_pct,
  {_N(_UP)} AS up_n, {_P(_N(_UP + " AND result = 'home'"), _N(_UP))} AS up_home_pct, {_P(_N(_UP + " AND cover = 'home'"), _N(_UP + " AND cover IN ('home', 'away')"))} AS up_cover_pct,
  {_N(_WIN)} AS win_drop_n, {_P(_N(_WIN + " AND result = 'home'"), _N(_WIN))} AS win_drop_home_pct, {_P(_N(_WIN + " AND result = 'away'"), _N(_WIN))} AS win_drop_away_pct,
  {_N(_LOSE)} AS lose_drop_n, {_P(_N(_LOSE + " AND result = 'home'"), _N(_LOSE))} AS lose_drop_home_pct,
  {_N(_DEEP)} AS deep_n, {_P(_N(_DEEP + " AND cover = 'away'"), _N(_DEEP + " AND cover IN ('home', 'away')"))} AS deep_away_pct
  FROM f WHERE nullif(league, '') IS NOT NULL GROUP BY league HAVING count(*) >= 30 ORDER BY total DESC, league LIMIT 20)"""
_H0 = "coalesce(h, 0)"
_A0 = "coalesce(a, 0)"
_PD = f"(CASE WHEN index_line < 0 THEN {_H0} + index_line - {_A0} ELSE {_A0} - index_line - {_H0} END)"
_ROWS = "match_id, match_time, league, home_team, away_team, CAST(coalesce(h, 0) AS VARCHAR) || '-' || CAST(coalesce(a, 0) AS VARCHAR) AS score, win1 AS euro_home, lose1 AS euro_away, index_line AS hi_handicap, CASE WHEN index_line < 0 THEN '主让' ELSE '客让' END || CAST(CAST(trunc(abs(index_line)) AS INT) AS VARCHAR) || '球' AS handicap_desc, CASE WHEN index_line < 0 THEN home_team ELSE away_team END AS upper_team, CASE WHEN index_line < 0 THEN away_team ELSE home_team END AS lower_team, hh1 AS hi_home_odds, hd1 AS hi_draw_odds, ha1 AS hi_away_odds, nullif(ha1, 0) >= {cold} AS is_cold"
_nz = lambda c: f"nullif({c}, 0)"
_UPHI, _EURO = f"{_nz('hh1')} > {_nz('hh0')} + 0.02::DOUBLE", f"{_nz('win1')} < {_nz('win0')} - 0.02::DOUBLE"
_TYPES = {"hi_home_up": _UPHI, "hi_home_up_euro_down": f"{_UPHI} AND {_EURO}", "asian_up_euro_down": f"{_nz('hw1')} > {_nz('hw0')} + 0.02::DOUBLE AND {_EURO}", "hi_away_down": f"{_nz('ha1')} < {_nz('ha0')} - 0.02::DOUBLE", "hi_home_up_low": f"{_UPHI} AND {_nz('hh1')} < 5.0"}
_IR = sign("(h - a + index_line)", "让胜", "走水", "让负")


_UPWARDS = "format('让胜升水 {:.2f}→{:.2f} (+{:.2f})', hh0, hh1, hh1 - hh0)"
_DESC = {"hi_home_up": _UPWARDS, "hi_home_up_low": _UPWARDS, "hi_home_up_euro_down": "format('让胜升 +{:.2f} | 欧主降 {:.2f}', hh1 - hh0, win1 - win0)", "asian_up_euro_down": "format('亚盘升 +{:.2f} | 欧主降 {:.2f}', hw1 - hw0, win1 - win0)", "hi_away_down": "format('让负降水 {:.2f}→{:.2f} ({:.2f})', ha0, ha1, ha1 - ha0)"}


def _filtered(where: str) -> str:
    names = {"hi_handicap": "index_line", "hi_home_initial": "hh0", "hi_home_current": "hh1", "hi_away_initial": "ha0", "hi_away_current": "ha1", "win_initial": "win0", "win_current": "win1", "lose_initial": "lose0", "lose_current": "lose1"}
    detail = ", ".join(f"{v} AS {k}" for k, v in names.items())
    score = "coalesce(nullif(home_score, ''), '-') || ':' || coalesce(nullif(away_score, ''), '-') AS score"
    parts = [f"SELECT match_id, match_time, league, home_team, away_team, status, {score}, result, {_IR} AS index_result, {detail}, '{k}' AS filter_type, {_DESC[k]} AS filter_desc FROM m WHERE {where} AND {t}" for k, t in _TYPES.items()]
    return "o AS (" + " UNION ALL ".join(parts) + ")"


_FIN = "home_score IS NOT NULL AND away_score IS NOT NULL"
_TEXTS = ["match_id", "match_number", "league", "round", "match_time", "owner_date", "home_team", "away_team", "home_rank", "home_score", "away_score", "hi_handicap_value"]
_TEXTS += [f"{p.format(w)}" for w in ("initial", "current") for p in ("euro_{}_win", "euro_{}_draw", "euro_{}_lose", "asian_{}_home_odds", "asian_{}_handicap", "asian_{}_away_odds", "ou_{}_over_odds", "ou_{}_total", "ou_{}_under_odds", "hi_{}_home_odds", "hi_{}_draw_odds", "hi_{}_away_odds")]

SQL = {
    "league_profile": sql(f"WITH {PROFILE} SELECT * FROM p"),
    "league_comparison_tags": sql(f"""WITH {PROFILE} SELECT league, down_cover_pct - up_cover_pct AS water_value,
      CASE WHEN down_cover_pct - up_cover_pct > 15 THEN 3 WHEN down_cover_pct - up_cover_pct > 8 THEN 2 WHEN down_cover_pct - up_cover_pct > 0 THEN 1 ELSE 0 END AS water_stars,
      CASE WHEN win_drop_away_pct > 45 THEN 2 WHEN win_drop_away_pct > 35 THEN 1 ELSE 0 END AS trap_level,
      CASE WHEN deep_n >= 5 THEN CASE WHEN deep_away_pct > 55 THEN 3 WHEN deep_away_pct > 50 THEN 2 WHEN deep_away_pct > 45 THEN 1 ELSE 0 END END AS deep_level,
      concat_ws(',', CASE WHEN home_pct > 50 THEN 'home_strong' WHEN home_pct < 40 THEN 'home_weak' END, CASE WHEN avg_goals > 3.0 THEN 'many_goals' WHEN avg_goals < 2.5 THEN 'few_goals' END,
        CASE WHEN down_n >= 10 AND down_cover_pct > 55 THEN 'water_down' WHEN up_n >= 10 AND up_cover_pct > 55 THEN 'water_up' END,
        CASE WHEN win_drop_n >= 10 AND win_drop_away_pct > 45 THEN 'trap' WHEN win_drop_n >= 10 AND win_drop_away_pct < 30 THEN 'no_trap' END, CASE WHEN deep_n >= 5 AND deep_away_pct > 55 THEN 'deep_away' END) AS features FROM p"""),
    "best_league_per_metric": sql(f"""WITH {PROFILE}, x AS (SELECT league, 'home_pct' AS metric, CASE WHEN total >= 30 THEN home_pct ELSE 0 END AS value FROM p UNION ALL SELECT league, 'avg_goals', CASE WHEN total >= 30 THEN avg_goals ELSE 0 END FROM p
      UNION ALL SELECT league, 'down_cover_pct', CASE WHEN down_n >= 10 THEN down_cover_pct ELSE 0 END FROM p UNION ALL SELECT league, 'win_drop_away_pct', CASE WHEN win_drop_n >= 10 THEN win_drop_away_pct ELSE 0 END FROM p
      UNION ALL SELECT league, 'deep_away_pct', CASE WHEN deep_n >= 5 THEN deep_away_pct ELSE 0 END FROM p)
      SELECT metric, league, value FROM x QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, league) = 1"""),
    "lower_plate_league_rate": sql(f"SELECT * FROM (SELECT *, round_even(100.0::DOUBLE * lower_win / total, 1) AS rate FROM (SELECT coalesce(league, '') AS league, count(*) AS total, count(*) FILTER ({_PD} < 0) AS lower_win FROM f WHERE index_line <> 0 GROUP BY 1) WHERE total >= 5) ORDER BY rate DESC, league LIMIT 15"),
    "lower_plate_upcoming": sql(f"SELECT {_ROWS.format(cold='4.0')} FROM m WHERE status = 0 AND index_line <> 0 AND ha1 >= 3.0 ORDER BY ha1 DESC, match_id LIMIT 30"),
    "lower_plate_history": sql(f"SELECT {_ROWS.format(cold='3.0')} FROM f WHERE index_line <> 0 AND {_PD} < 0 ORDER BY coalesce(ha1, 0) DESC, match_id LIMIT 50"),
    "lower_plate_rate": sql(f"SELECT *, round_even(100.0::DOUBLE * kept / total, 1) AS rate FROM (SELECT count(*) AS total, count(*) FILTER ({_PD} < 0) AS kept FROM f WHERE index_line <> 0)"),
    "odds_filter": sql(f"WITH {_filtered('TRUE')} SELECT * FROM o"),
    "odds_filter_rows": sql(f"WITH {_filtered('TRUE')} SELECT *, CAST(row_number() OVER (PARTITION BY filter_type ORDER BY match_time DESC NULLS LAST, match_id DESC) AS INTEGER) AS rank FROM o QUALIFY rank <= 100"),
    "lower_plate_of_league": sql(f"SELECT {_ROWS.format(cold='4.0')} FROM m WHERE status = 0 AND league LIKE '%NATION_1%' AND index_line <> 0 AND ha1 >= 3.5 ORDER BY ha1 DESC, match_id LIMIT 30"),
    "odds_filter_stats": sql(f"""WITH {_filtered(_FIN)} SELECT *, {', '.join(f"{_P(x, 'n')} AS {x}_pct" for x in ('home', 'draw', 'away'))}, {', '.join(f"{_P(x, 'index_n')} AS {x}_pct" for x in ('index_win', 'index_push', 'index_lose'))} FROM (
      SELECT filter_type, count(*) AS n, count(result) AS decided, {_N("result = 'home'")} AS home, {_N("result = 'draw'")} AS draw, {_N("result = 'away'")} AS away, count(index_result) AS index_n, {_N("index_result = '让胜'")} AS index_win, {_N("index_result = '走水'")} AS index_push, {_N("index_result = '让负'")} AS index_lose FROM o GROUP BY 1)"""),
    "odds_filter_leagues": sql(f"WITH {_filtered(_FIN)}, g AS (SELECT filter_type, league, count(*) AS n, count(index_result) AS index_n, {_N("index_result = '让负'")} AS index_lose FROM o GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY filter_type ORDER BY lose_pct DESC, league) AS INTEGER) AS rank FROM (SELECT *, 100.0::DOUBLE * index_lose / index_n AS lose_pct FROM g WHERE n >= 3 AND index_n > 0) QUALIFY rank <= 15"),
    "match_stats": sql("SELECT 'total' AS kind, NULL AS value, count(*) AS n FROM m UNION ALL SELECT 'leagues', NULL, count(DISTINCT nullif(league, '')) FROM m UNION ALL SELECT 'status', CASE status WHEN 0 THEN '未开始' WHEN 1 THEN '进行中' WHEN 2 THEN '完场' WHEN 6 THEN '改期' ELSE CAST(status AS VARCHAR) END, count(*) FROM m WHERE status IS NOT NULL GROUP BY 2 UNION ALL SELECT 'league', league, count(*) FROM m WHERE nullif(league, '') IS NOT NULL GROUP BY 2"),
    "all_leagues": sql("SELECT DISTINCT league FROM m WHERE nullif(league, '') IS NOT NULL"),
    "league_performance": sql("SELECT league, count(*) AS total, count(*) FILTER (status = 2) AS finished, count(*) FILTER (coalesce(status, -1) <> 2) AS pending FROM m GROUP BY 1"),
    "avg_home_score_by_league": sql("SELECT league, avg(h) AS avg_home, count(*) AS n FROM f WHERE h IS NOT NULL GROUP BY 1 ORDER BY avg_home DESC, league LIMIT 10"),
    "league_goal_average": sql("SELECT league, count(*) AS n, CAST(sum(goals) AS BIGINT) AS goals, sum(goals) * 1.0::DOUBLE / count(*) AS avg_goals FROM f WHERE result IS NOT NULL GROUP BY 1"),
    "label_distribution": sql("SELECT coalesce(label, '无数据') AS label, count(*) AS n FROM m GROUP BY 1"),
    "status_partition_counts": sql("SELECT count(*) FILTER (status = 0) AS pending, count(*) FILTER (status = 2) AS finished, count(*) FILTER (status = 1) AS live FROM m"),
    "field_profile": sql("SELECT (SELECT count(*) FROM matches) AS total, field, filled FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count(nullif({c}, '')) AS filled FROM matches" for c in _TEXTS) + ")"),
}
