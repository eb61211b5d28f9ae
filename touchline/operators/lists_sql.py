"""DuckDB SQL of match lists, merges and streams' batch forms."""

from __future__ import annotations

from ..oracle import label, present, sql

_SIX = " AND ".join(f"nullif(euro_{w}_{p}, '') IS NOT NULL" for w in ("initial", "current") for p in ("win", "draw", "lose"))
_LINES = f"{present('asian_initial_handicap')} IS NOT NULL AND {present('asian_current_handicap')} IS NOT NULL"
_AT = "try_strptime('2024-' || match_time, '%Y-%m-%d %H:%M')"
_DRAW = f"TRY_CAST({present('euro_current_draw', 'euro_initial_draw')} AS DOUBLE)"
_LV = "(trim(coalesce(hi_handicap_value, '')) IN ('0', '平手') OR coalesce(hi_handicap_value, '') LIKE '%平%')"
_HITS = f"coalesce({_DRAW} BETWEEN 2.85::DOUBLE AND 3.5, FALSE)"
_ALERT = f"coalesce(match_number, '') || ' ' || right(match_time, 5) || ' ' || home_team || ' vs ' || away_team || ' [' || concat_ws(' ', CASE WHEN {_HITS} THEN '平' || {_DRAW} END, CASE WHEN {_LV} THEN '让平' END) || ']'"
_K = "CAST(match_id AS BIGINT)"
_DOC = f"({_K} % 3 = 0 AND {_K} % 21 <> 0)"
_NEWLABEL = label("asian_initial_handicap", "'两球'", "asian_initial_home_odds", "'1.50'")
_UPSERTED = f"""SELECT match_id, CASE WHEN {_DOC} THEN '9.99' ELSE euro_current_win END AS euro_current_win, CASE WHEN {_DOC} THEN coalesce(euro_initial_draw, '') ELSE euro_initial_draw END AS euro_initial_draw, CASE WHEN {_DOC} AND {_K} % 6 = 0 THEN '1.50' ELSE asian_current_home_odds END AS asian_current_home_odds,
  CASE WHEN {_DOC} AND {_K} % 6 = 0 THEN '两球' ELSE asian_current_handicap END AS asian_current_handicap, CASE WHEN {_DOC} AND {_K} % 12 = 0 THEN '' ELSE ou_current_total END AS ou_current_total, CASE WHEN {_DOC} AND {_K} % 9 = 0 THEN '-3' ELSE hi_handicap_value END AS hi_handicap_value, CASE WHEN {_DOC} AND {_K} % 9 = 0 THEN '5.55' ELSE hi_current_draw_odds END AS hi_current_draw_odds,
  CASE WHEN {_DOC} AND {_K} % 6 = 0 THEN coalesce({_NEWLABEL}, '旧') ELSE '旧' END AS asian_movement_label, CASE WHEN {_DOC} AND {_K} % 9 = 0 THEN 't9' END AS odds_update_time FROM m"""
_COMBINED = [f"{p}_{w}_{x}" for p, parts in (("euro", ("win", "draw", "lose")), ("asian", ("home_odds", "handicap", "away_odds")), ("ou", ("over_odds", "total", "under_odds"))) for w in ("current", "initial") for x in parts]
_new = {"euro_current_win": "'9.99'", "asian_current_home_odds": "'1.50'", "asian_current_handicap": "'两球'"}
_there = {"euro": _DOC, "asian": f"({_DOC} AND {_K} % 6 = 0)", "ou": f"({_DOC} AND {_K} % 12 = 0)"}
_doc = lambda c: f"CASE WHEN {_there[c.split('_')[0]]} THEN coalesce({_new.get(c, 'NULL' if c.startswith('ou_') else c)}, '') ELSE '' END"
_OLDER = {"euro_win": "euro_current_win", "euro_draw": "euro_current_draw", "euro_lose": "euro_current_lose", "asian_home_odds": "asian_current_home_odds", "asian_handicap": "asian_current_handicap", "asian_away_odds": "asian_current_away_odds", "over_odds": "ou_current_over_odds", "total_goals": "ou_current_total", "under_odds": "ou_current_under_odds"}


def _both(market: str, *parts: str) -> str:
    side = lambda when: " || '/' || ".join(f"coalesce({market}_{when}_{p}, '')" for p in parts)
    return f"'初:' || {side('initial')} || ' 即:' || {side('current')}"


_TEXT = f"'欧赔 ' || {_both('euro', 'win', 'draw', 'lose')} || chr(10) || '亚盘 ' || {_both('asian', 'home_odds', 'handicap', 'away_odds')} || chr(10) || '大小球 ' || {_both('ou', 'under_odds', 'total', 'over_odds')} || chr(10) || '让球指数 盘:' || coalesce(hi_handicap_value, '') || ' ' || {_both('hi', 'home_odds', 'draw_odds', 'away_odds')}"
_ROWS = "cr AS (SELECT match_id, line AS hint, pos, list_extract([hi_handicap_value, '-1', '+1', '0', 'x', '2'], pos + 1) AS line_text FROM m, (SELECT CAST(range AS INT) AS pos FROM range(6)))"
_FITS = "(v > 0 AND hint > 0 OR v < 0 AND hint < 0 OR v = 0 AND abs(hint) < 0.25::DOUBLE)"

SQL = {
    "list_matches": sql("SELECT match_id, owner_date, league, status FROM m WHERE status IN (0, 6)"),
    "list_matches_range": sql("SELECT match_id, owner_date, league, status FROM m WHERE owner_date BETWEEN '1996-01-01' AND '1996-03-31'"),
    "page": sql(f"SELECT match_id, match_time, league, status, {_AT} AS starts_at, (SELECT count(*) FROM m WHERE status IN (0, 6)) AS total, CAST(((SELECT count(*) FROM m WHERE status IN (0, 6)) + 49) // 50 AS INT) AS pages FROM m WHERE status IN (0, 6) ORDER BY starts_at NULLS LAST, match_id LIMIT 50 OFFSET 50"),
    "get_matches": sql("SELECT match_id, league, status, match_time, home_team, away_team FROM m WHERE status = 2 ORDER BY match_time DESC NULLS LAST, match_id DESC LIMIT 100"),
    "high_odds": sql("SELECT match_id, league, win1 AS win_odds FROM m WHERE win1 >= 3.0"),
    "goal_range": sql("SELECT match_id, league, goals FROM f WHERE goals BETWEEN 2 AND 3"),
    "movement_eligible": sql(f"SELECT match_id, {_SIX} AS euro, {_LINES} AS asian FROM m WHERE ({_SIX}) OR ({_LINES})"),
    "live_alerts": sql(f"SELECT match_id, league, home_team, away_team, {_DRAW} AS draw_odds, {_HITS} AS by_draw, {_LV} AS by_line, {_ALERT} AS alert FROM m WHERE status = 1 AND ({_HITS} OR {_LV})"),
    "get_matches_by_odds": sql("SELECT match_id, league, owner_date, win0, match_time FROM m WHERE league = 'NATION_4' AND owner_date BETWEEN '1995-01-01' AND '1996-12-31' ORDER BY win0 NULLS LAST, match_id LIMIT 200"),
    "match_by_id": sql("SELECT match_id, league, status, home_team, away_team, home_score, away_score FROM m WHERE match_id = (SELECT CAST(max(o_orderkey) AS STRING) FROM orders WHERE o_orderkey % 7 = 0)"),
    "row_json": sql("SELECT match_id, json_object('match_id', match_id, 'league', league, 'status', status, 'home_score', home_score) AS json FROM m"),
    "odds_needed": sql("SELECT match_id, status FROM m WHERE status IN (0, 1)"),
    "upsert_odds": sql(_UPSERTED),
    "combined": sql(f"SELECT match_id, league, {', '.join(f'{_doc(c)} AS {c}' for c in _COMBINED)}, {', '.join(f'{_doc(v)} AS {k}' for k, v in _OLDER.items())} FROM m"),
    "backfill_labels": sql("SELECT match_id, coalesce(label, '旧') AS asian_movement_label FROM m"),
    "join_feeds_by_day": sql("""WITH d0 AS (SELECT match_id, match_number, owner_date, CASE WHEN regexp_full_match(match_number, '周[一二三四五六日][0-9]+') THEN position(substr(match_number, 2, 1) IN '一二三四五六日') END AS wd FROM matches),
      d1 AS (SELECT *, (wd::VARCHAR || substr(match_number, 3))::VARCHAR AS num, owner_date::DATE + ((wd - isodow(owner_date::DATE) + 7) % 7)::INTEGER AS day, substr(match_number, 3)::INTEGER % 3 = 0 AS third FROM d0 WHERE wd IS NOT NULL)
      SELECT d0.match_id, d0.match_number, d0.owner_date, CASE WHEN third THEN strftime(day, '%m%d') || '.34' ELSE strftime(day, '%m%d') || '.20' END AS hi_win, CASE WHEN third THEN day::TIMESTAMP + INTERVAL 34 HOURS ELSE day::TIMESTAMP + INTERVAL 20 HOURS END AS hi_seen_at, CASE WHEN NOT third THEN strftime(day, '%m%d') || '.13' END AS euro_win
      FROM d0 LEFT JOIN d1 USING (match_id)"""),
    "join_feeds": sql("SELECT match_id, match_number, CASE WHEN n > 0 THEN '2.00/3.00/4.00' END AS hi_currodds, CASE WHEN n > 0 THEN '4.50' END AS hi_initial_lose, CASE WHEN n > 0 AND n % 2 = 0 THEN '1.50/3.00/5.00' END AS euro_currodds FROM (SELECT *, CASE WHEN match_number LIKE '周%' THEN CAST(substr(match_number, 3) AS INT) + 1 ELSE 0 END AS n FROM m)"),
    "first_of_each": sql("SELECT match_id, league, position FROM (SELECT match_id, league, position FROM (SELECT match_id, league, 2 AS position FROM m UNION ALL SELECT match_id, league || 'x', 1 FROM m WHERE CAST(match_id AS BIGINT) % 3 = 0)) QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY position, league) = 1"),
    "parse_match_feed": sql("SELECT match_id, match_number, match_number AS round_id, league, match_time, status, home_team, away_team, CASE WHEN status <> 0 AND nullif(home_score, '') IS NOT NULL AND nullif(away_score, '') IS NOT NULL THEN home_score || '-' || away_score ELSE '-' END AS score, owner_date FROM m"),
    "upsert_matches": sql("SELECT match_id, home_team, away_team, CASE WHEN CAST(match_id AS BIGINT) % 3 = 0 THEN '9' ELSE home_score END AS home_score, CASE WHEN CAST(match_id AS BIGINT) % 6 = 0 THEN '' ELSE away_score END AS away_score FROM m"),
    "odds_trend": "SELECT user_id AS match_id, event_type AS market, count(*) AS ticks, arg_min(value, (ts, event_id)) AS initial, arg_max(value, (ts, event_id)) AS current, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) AS change FROM events GROUP BY 1, 2",
    "read_mixed_files": sql("SELECT match_id, nullif(league, '') AS league, CASE WHEN match_id::BIGINT % 3 <> 1 THEN nullif(home_score, '') END AS home_score, CASE WHEN match_id::BIGINT % 3 = 1 THEN nullif(away_score, '') END AS away_score FROM matches"),
    "page_matches": sql("SELECT match_id, match_number, coalesce(league, '') AS league, round, match_time, CASE status WHEN 2 THEN '完' WHEN 1 THEN '34' || chr(39) ELSE '未' END AS status_text, CASE WHEN status IN (1, 2) THEN status ELSE 0 END::INTEGER AS status, home_team, away_team, regexp_extract(home_rank, '[0-9]+') AS home_rank, '' AS away_rank, coalesce(home_score, '') AS home_score, coalesce(asian_initial_handicap, '') AS handicap, coalesce(away_score, '') AS away_score FROM matches"),
    "feed_ticks": "WITH e AS (SELECT *, event_id % ceil(count(*) OVER (PARTITION BY user_id) / 500)::BIGINT AS part FROM events) SELECT user_id::VARCHAR AS matchnum, (row_number() OVER (PARTITION BY user_id, part ORDER BY ts DESC, event_id DESC) - 1)::INTEGER AS pos, count(*) OVER (PARTITION BY user_id, part)::INTEGER AS ticks, value AS win, event_type AS kind, event_id AS tick_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS update_time FROM e",
    "feed_trend": "SELECT user_id::VARCHAR AS match_id, 'euro' AS market, count(*) AS ticks, arg_min(value, (ts, event_id)) AS initial, arg_max(value, (ts, event_id)) AS current, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) AS change FROM events GROUP BY 1",
    "odds_trend_by_match": "WITH g AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 3 DAYS, TRUE) AS fresh FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), r AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM g) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS opened, user_id AS match_id, event_type AS market, count(*) AS ticks, arg_min(value, (ts, event_id)) AS initial, arg_max(value, (ts, event_id)) AS current, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) AS change FROM r GROUP BY user_id, event_type, run",
    "odds_trend_by_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS match_id, event_type AS market, count(*) AS ticks, arg_min(value, (ts, event_id)) AS initial, arg_max(value, (ts, event_id)) AS current, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) AS change FROM events GROUP BY 1, 2, 3",
    "odds_trend_by_hour": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type AS market, count(*) AS ticks, arg_min(value, (ts, event_id)) AS initial, arg_max(value, (ts, event_id)) AS current FROM events GROUP BY 1, 2",
    "value_counts": sql("SELECT 'league' AS field, league AS value, n FROM (SELECT league, count(*) AS n FROM m WHERE nullif(league, '') IS NOT NULL GROUP BY 1 ORDER BY n DESC, league LIMIT 10) UNION ALL SELECT 'status', coalesce(CAST(status AS STRING), '未开始'), count(*) FROM m GROUP BY 1, 2"),
    "notification_text": sql(f"SELECT match_id, {_TEXT} AS body FROM m"),
    "nearest_line": sql(f"WITH {_ROWS} SELECT match_id, pos, line_text FROM (SELECT *, TRY_CAST(line_text AS DOUBLE) AS v FROM cr) QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY CASE WHEN {_FITS} THEN 0 ELSE 1 END, CASE WHEN {_FITS} THEN abs(v - hint) END, CASE WHEN {_FITS} THEN pos ELSE -pos END) = 1"),
}
