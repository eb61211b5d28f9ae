"""DuckDB SQL of the result statistics."""

from __future__ import annotations

from ..oracle import bucket, line, present, shares, sign, sql



class R:
    """Fixed values, stated here a second time: group names and thresholds of the analyses."""

    LABELS = "升盘降水 升盘升水 升盘 降盘降水 降盘升水 降盘 升水 降水 无变化 无标签".split()
    EURO_CUTS = [("<", -0.15, "主胜赔率大降(>0.15)"), ("<", -0.05, "主胜赔率小降(0.05-0.15)"), (">", 0.15, "主胜赔率大升(>0.15)"), (">", 0.05, "主胜赔率小升(0.05-0.15)")]
    EURO_REST, DRAW_DROP, LOSE_DROP = "主胜赔率基本不变", "平局赔率大降(>0.15)", "客胜赔率大降(>0.15)"
    LINE_CUTS = [(">=", 1.5, "主让球半及以上"), (">=", 1.0, "主让一球到球半"), (">=", 0.5, "主让半球到一球"), (">=", 0.25, "主让平半到半球"), (">=", 0.0, "平手到平半"), (">=", -0.5, "主受让半球内")]
    LINE_REST = "主受让半球以上"
    WATER_CUTS = [("<", -0.08, "主水大降(>0.08)"), ("<", -0.03, "主水小降(0.03-0.08)"), (">", 0.08, "主水大升(>0.08)"), (">", 0.03, "主水小升(0.03-0.08)")]
    WATER_REST, LEVEL_WATER_REST = "水位基本不变", "水位不变"
    TOTAL_CUTS = [("<=", 1.75, "小于2球"), ("<=", 2.25, "2-2.25球"), ("<=", 2.75, "2.5-2.75球"), ("<=", 3.25, "3-3.25球")]
    TOTAL_REST = "3.5球以上"
    INDEX_CUTS = [(">=", 2.0, "让两球及以上"), (">=", 1.0, "让一球到两球"), (">", 0.0, "让半球到一球"), ("=", 0.0, "平手"), (">=", -1.0, "受让半球到一球")]
    INDEX_REST = "受让一球以上"
    LEVEL_CUTS = [("<=", 0.85, "低水(≤0.85)"), ("<=", 0.95, "中低水(0.86-0.95)"), ("<=", 1.0, "中水(0.96-1.00)"), ("<=", 1.1, "中高水(1.01-1.10)")]
    LEVEL_REST = "高水(>1.10)"
    WIN_CUTS = [("<", 2.0, "主胜赔率<2.0（强看主）"), ("<", 2.5, "主胜赔率2.0-2.5"), ("<", 3.0, "主胜赔率2.5-3.0（均势）"), ("<", 3.5, "主胜赔率3.0-3.5")]
    WIN_REST = "主胜赔率>3.5（弱看主）"
    DRAW_CUTS = [("<", 3.0, "平局赔率<3.0"), ("<", 3.3, "平局赔率3.0-3.3"), ("<", 3.6, "平局赔率3.3-3.6")]
    DRAW_REST = "平局赔率>3.6"
    LEVEL_TEXTS, STRICT_TEXTS = ["平手", "平/半", "平手/半球", "0", "0.25"], ["平手", "0"]


N = "count(*) AS n, count(*) FILTER (result = 'home') AS home, count(*) FILTER (result = 'draw') AS draw, count(*) FILTER (result = 'away') AS away"
COVER = "count(*) FILTER (cover = 'home') AS cover_home, count(*) FILTER (cover = 'away') AS cover_away, count(*) FILTER (cover = 'push') AS cover_push"
PCT = shares(home_pct="home", draw_pct="draw", away_pct="away")
COVER_PCT = shares("(cover_home + cover_away + cover_push)", cover_home_pct="cover_home", cover_away_pct="cover_away")
OU = "count(*) AS n, count(*) FILTER (ou = 'over') AS over, count(*) FILTER (ou = 'under') AS under, count(*) FILTER (ou = 'push') AS push"
OU_PCT = shares(over_pct="over", under_pct="under", push_pct="push")
WON = "result IS NOT NULL"


def grouped(key: str, source: str = "f", where: str = WON, cover: bool = False, more: str = "", having: str = "TRUE") -> str:
    inner = f"SELECT {key} AS grp, {N}{', ' + COVER if cover else ''} FROM {source} WHERE {where} GROUP BY 1"
    return f"SELECT *{more} FROM (SELECT *, {PCT}{', ' + COVER_PCT if cover else ''} FROM ({inner}) WHERE grp IS NOT NULL) WHERE {having}"


def _level(strict: bool = False) -> str:
    items = ", ".join(f"'{x}'" for x in (R.STRICT_TEXTS if strict else R.LEVEL_TEXTS))
    return f"coalesce(replace(nullif(line_text, ''), '受', '') IN ({items}), FALSE)"


def _nz(x: str) -> str:
    return f"nullif({x}, 0)"


WATER = f"({_nz('hw1')} - {_nz('hw0')})"
SUGGEST = ", CASE WHEN home_pct > 45 THEN 'home' WHEN away_pct > 45 THEN 'away' WHEN draw_pct > 30 THEN 'draw' ELSE 'even' END AS suggestion"
_D2 = line("hi_handicap_value", "pattern")
_HI = sign(f"(CASE WHEN hi_handicap_value LIKE '%受%' THEN h + abs({_D2}) - a ELSE h - {_D2} - a END)", "home", "push", "away")
_CW = {x: f"({_nz(x + '1')} - {_nz(x + '0')})" for x in ("win", "draw", "lose")}
_DH = f"({line('asian_current_handicap', 'label')} - {line('asian_initial_handicap', 'label')})"
_DW = "(hw1 - hw0)"
LEVEL = f"{WON} AND {_level()}"
_L0, _L1 = line("asian_initial_handicap", "label"), line("asian_current_handicap", "label")
_KIND = "CASE WHEN abs(dh) < 0.01::DOUBLE AND abs(dw) < 0.01::DOUBLE THEN '无变化' WHEN dh > 0 AND dw < 0 THEN '升盘降水' WHEN dh > 0 AND dw > 0 THEN '升盘升水' WHEN dh < 0 AND dw > 0 THEN '降盘升水' WHEN dw < 0 THEN '降盘降水' ELSE '降盘升水' END"
_MOVED = f"""k AS (SELECT match_id, league, match_time, home_team, away_team, CAST(h AS VARCHAR) || '-' || CAST(a AS VARCHAR) AS score, {_L0} AS line0, {_L1} AS line1, hw0 AS water0, hw1 AS water1, {_DH} AS dh, {_DW} AS dw, h, a FROM f WHERE {WON}),
  c AS (SELECT * EXCLUDE (h, a), {_KIND} AS kind, {sign('(h + line1 - a)', 'home', 'push', 'away')} AS won FROM k WHERE dh IS NOT NULL AND dw IS NOT NULL)"""
_BY_KIND = "SELECT *, 100.0::DOUBLE * cover_home / n AS win_pct FROM (SELECT kind AS grp, count(*) AS n, count(*) FILTER (won = 'home') AS cover_home, count(*) FILTER (won = 'away') AS cover_away, count(*) FILTER (won = 'push') AS cover_push FROM c GROUP BY 1)"
_LONG = lambda section, key, measures, body: " UNION ALL ".join(f"SELECT '{section}' AS section, {key} AS grp, '{x}' AS measure, CAST({x} AS DOUBLE) AS value FROM ({body})" for x in measures)
_RESULTS = ["n", "home", "draw", "away", "home_pct", "draw_pct", "away_pct"]
_REPORT_SQL = " UNION ALL ".join([
    _LONG("size", "''", ["finished", "decided"], "SELECT count(*) AS finished, count(result) AS decided FROM f"),
    _LONG("label", "grp", [*_RESULTS, "cover_home", "cover_away_pct"], grouped("coalesce(nullif(label, ''), '无标签')", cover=True)),
    _LONG("line", "grp", [*_RESULTS, "cover_home", "cover_away_pct"], grouped(bucket("line", R.LINE_CUTS, R.LINE_REST), cover=True)),
    _LONG("water", "grp", [*_RESULTS, "cover_home", "cover_away_pct"], grouped(bucket(WATER, R.WATER_CUTS, R.WATER_REST), cover=True)),
    _LONG("total", "grp", ["n", "over", "under_pct"], f"SELECT *, {OU_PCT} FROM (SELECT {bucket('total', R.TOTAL_CUTS, R.TOTAL_REST)} AS grp, {OU} FROM f WHERE {WON} AND nullif(total, 0) IS NOT NULL GROUP BY 1)"),
])
_LEVEL_SQL = " UNION ALL ".join([
    _LONG("water", "grp", _RESULTS, grouped(bucket(_nz("hw"), R.LEVEL_CUTS, R.LEVEL_REST), where=LEVEL)),
    _LONG("water_change", "grp", _RESULTS, grouped(bucket(WATER, R.WATER_CUTS, R.LEVEL_WATER_REST), where=LEVEL)),
    _LONG("league", "grp", _RESULTS, grouped("coalesce(league, '未知')", where=LEVEL, having="n >= 5")),
])

SQL = {
    "movement_label_results": sql(grouped("coalesce(nullif(label, ''), '无标签')", cover=True, more=f", CAST(list_position({R.LABELS}, grp) AS INTEGER) AS pos")),
    "euro_movement_results": sql(
        f"WITH g AS (SELECT result, unnest(list_filter([{bucket(_CW['win'], R.EURO_CUTS, R.EURO_REST)}, CASE WHEN {_CW['draw']} < -0.15::DOUBLE THEN '{R.DRAW_DROP}' END, "
        f"CASE WHEN {_CW['lose']} < -0.15::DOUBLE THEN '{R.LOSE_DROP}' END], lambda x: x IS NOT NULL)) AS g FROM f WHERE {WON} AND {_CW['win']} IS NOT NULL) " + grouped("g", "g")
    ),
    "handicap_size_results": sql(grouped(bucket("line", R.LINE_CUTS, R.LINE_REST), cover=True)),
    "water_change_results": sql(grouped(bucket(WATER, R.WATER_CUTS, R.WATER_REST), cover=True)),
    "ou_pattern": sql(f"SELECT *, {OU_PCT} FROM (SELECT {bucket('total', R.TOTAL_CUTS, R.TOTAL_REST)} AS grp, {OU} FROM f WHERE {WON} AND nullif(total, 0) IS NOT NULL GROUP BY 1)"),
    "goal_histogram": sql("SELECT goals, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct, sum(goals * count(*)) OVER () * 1.0::DOUBLE / sum(count(*)) OVER () AS mean_goals FROM f WHERE result IS NOT NULL GROUP BY goals"),
    "handicap_index_results": sql(
        f"WITH i AS (SELECT * EXCLUDE (cover), {_HI} AS cover FROM f) SELECT * EXCLUDE (cover_home, cover_away, cover_push), cover_home AS hi_home, cover_push AS hi_draw, cover_away AS hi_away FROM ("
        + grouped(bucket(_D2, R.INDEX_CUTS, R.INDEX_REST), "i", cover=True).replace("SELECT *", "SELECT * EXCLUDE (cover_home_pct, cover_away_pct)", 1) + ")"
    ),
    "goal_distribution": sql("SELECT goals, count(*) AS n, CASE WHEN goals < 2 THEN '0-1' WHEN goals <= 3 THEN '2-3' ELSE '4+' END AS band, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM f) AS pct FROM f WHERE goals IS NOT NULL GROUP BY goals"),
    "ou_probability": sql(f"SELECT *, {OU_PCT} FROM (SELECT count(total) AS n, count(*) FILTER (ou = 'over') AS over, count(*) FILTER (ou = 'under') AS under, count(*) FILTER (ou = 'push') AS push, count(*) FILTER (total IS NULL) AS no_odds FROM f WHERE {WON} AND goals BETWEEN 1 AND 5)"),
    "ou_samples_of_league": sql("SELECT match_id, league, match_time, home_team, away_team, goals, total, ou FROM f WHERE result IS NOT NULL AND total IS NOT NULL AND league = 'NATION_3' AND goals BETWEEN 1 AND 4 ORDER BY match_time DESC NULLS LAST, match_id DESC LIMIT 10"),
    "ou_samples": sql("SELECT match_id, league, match_time, home_team, away_team, goals, total, ou FROM f WHERE result IS NOT NULL AND total IS NOT NULL ORDER BY match_time DESC NULLS LAST, match_id DESC LIMIT 10"),
    "ou_by_initial_line": sql(
        f"SELECT *, {OU_PCT} FROM (SELECT league, line_value, {OU} FROM (SELECT league, {sign('(goals - line_value)', 'over', 'push', 'under')} AS ou, line_value FROM (SELECT *, TRY_CAST({present('ou_initial_total')} AS DOUBLE) AS line_value FROM f WHERE {WON}) WHERE line_value IS NOT NULL) GROUP BY 1, 2)"
    ),
    "results_by_league": sql(grouped("league")),
    "ou_stats_by_league_line": sql(f"SELECT *, {OU_PCT} FROM (SELECT league, total AS line_value, {OU} FROM f WHERE {WON} AND total IS NOT NULL GROUP BY 1, 2)"),
    "level_ball_results": sql(f"WITH k AS (SELECT *, unnest(CASE WHEN {_level(True)} THEN ['level', 'strict'] ELSE ['level'] END) AS kind FROM f WHERE {LEVEL}) " + grouped("kind", "k", having="n >= 10 OR (grp = 'strict' AND n >= 5)")),
    "level_water_levels": sql(grouped(bucket(_nz("hw"), R.LEVEL_CUTS, R.LEVEL_REST), where=LEVEL, more=SUGGEST)),
    "level_water_changes": sql(grouped(bucket(WATER, R.WATER_CUTS, R.LEVEL_WATER_REST), where=LEVEL, more=SUGGEST)),
    "level_euro_odds": sql(
        f"WITH g AS (SELECT result, unnest([{bucket(_nz('win'), R.WIN_CUTS, R.WIN_REST)}, {bucket(_nz('draw'), R.DRAW_CUTS, R.DRAW_REST)}]) AS g FROM f WHERE {LEVEL}) "
        + grouped("g", "g", more=", CASE WHEN grp LIKE '平局%' THEN CASE WHEN draw_pct > 35 THEN 3 WHEN draw_pct > 28 THEN 2 WHEN draw_pct > 22 THEN 1 ELSE 0 END END AS stars")
    ),
    "level_by_league": sql(grouped("coalesce(league, '未知')", where=LEVEL, having="n >= 5", more=", CASE WHEN home_pct > 45 THEN 'home' WHEN away_pct > 45 THEN 'away' WHEN draw_pct > 35 THEN 'draw' END AS feature")),
    "level_over_under": sql(
        f"SELECT *, {OU_PCT} FROM (SELECT count(*) AS matches, avg(goals) AS mean_goals, count(*) FILTER (nullif(total, 0) IS NOT NULL) AS n, "
        + ", ".join(f"count(*) FILTER (ou = '{x}' AND total <> 0) AS {x}" for x in ("over", "under", "push")) + f" FROM f WHERE {LEVEL})"
    ),
    "level_goal_histogram": sql(f"SELECT goals, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct, sum(goals * count(*)) OVER () * 1.0::DOUBLE / sum(count(*)) OVER () AS mean_goals FROM f WHERE {LEVEL} GROUP BY goals"),
    "movement_rows": sql(f"WITH {_MOVED} SELECT * FROM c"),
    "movement_categories": sql(f"WITH {_MOVED} {_BY_KIND}"),
    "movement_of_league": sql(f"WITH {_MOVED} {_BY_KIND.replace('FROM c', "FROM c WHERE league = 'NATION_3'")}"),
    "odds_pattern_report": sql(_REPORT_SQL),
    "level_ball_report": sql(_LEVEL_SQL),
}
