"""DuckDB SQL of the team operators."""

from __future__ import annotations

from ..oracle import present, sql

_T = "match_id, league, match_time, owner_date, goals, total, ou, ou_current_total, ou_initial_total"
SIDES = f"""s AS (SELECT *, CASE WHEN gf > ga THEN 'win' WHEN gf < ga THEN 'loss' WHEN gf = ga THEN 'draw' END AS outcome FROM (
  SELECT {_T}, home_team AS team, away_team AS other, h AS gf, a AS ga FROM f UNION ALL SELECT {_T}, away_team, home_team, a, h FROM f))"""
SIDES_HOME = SIDES.replace("home_team AS team,", "TRUE AS at_home, home_team AS team,").replace(f"SELECT {_T}, away_team,", f"SELECT {_T}, FALSE, away_team,")
LAST = SIDES + ", l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY team ORDER BY match_time DESC NULLS LAST, match_id DESC) <= 10)"
WDL = "count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'draw') AS draws, count(*) FILTER (outcome = 'loss') AS losses"
SUMS = "CAST(coalesce(sum(gf) FILTER (outcome IS NOT NULL), 0) AS BIGINT) AS goals_for, CAST(coalesce(sum(ga) FILTER (outcome IS NOT NULL), 0) AS BIGINT) AS goals_against"
_OUL = f"TRY_CAST(coalesce({present('ou_current_total', 'ou_initial_total')}, '2.5') AS DOUBLE)"
OULINE = _OUL
FORM = f"""{LAST}, form AS (SELECT *, {', '.join(f"{k} * 1.0::DOUBLE / matches AS {k}_rate" for k in ('wins', 'draws', 'losses', 'over', 'under'))}, goals_for * 1.0::DOUBLE / matches AS avg_for, goals_against * 1.0::DOUBLE / matches AS avg_against
  FROM (SELECT team, count(*) AS matches, {WDL}, {SUMS}, count(*) FILTER (goals > {_OUL}) AS over, count(*) FILTER (goals < {_OUL}) AS under FROM l GROUP BY team))"""
PROFILE = f"{SIDES}, tp AS (SELECT team, count(*) AS matches, {SUMS}, {WDL}, count(*) FILTER (goals >= 3) AS big_games FROM s WHERE outcome IS NOT NULL GROUP BY team)"

SQL = {
    "team_goal_averages": sql(f"WITH {SIDES} SELECT league, team, count(*) AS matches, avg(gf) AS scored, avg(ga) AS conceded, avg(gf) + avg(ga) AS total FROM s WHERE outcome IS NOT NULL GROUP BY 1, 2"),
    "team_profile": sql(f"WITH {PROFILE} SELECT * FROM tp"),
    "team_form": sql(f"WITH {FORM} SELECT * FROM form"),
    "form_as_of": sql(f"WITH {SIDES} SELECT match_id, team, count(*) OVER w AS matches, CAST(coalesce(sum(CASE WHEN outcome = 'win' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS wins, CAST(coalesce(sum(gf) OVER w, 0) AS BIGINT) AS goals_for FROM s WHERE outcome IS NOT NULL WINDOW w AS (PARTITION BY team ORDER BY owner_date, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"),
    "form_before": sql(f"""WITH {SIDES_HOME}, kf AS (SELECT *, concat_ws(' ', coalesce(owner_date, ''), right(coalesce(match_time, ''), 5)) AS kick FROM s),
      b AS (SELECT a.match_id, a.team, a.at_home, a.kick AS kick_off, (SELECT list({{'o': p.outcome, 'gf': p.gf, 'ga': p.ga, 'd': p.goals - TRY_CAST(coalesce({present('p.ou_current_total', 'p.ou_initial_total')}, '2.5') AS DOUBLE)}} ORDER BY p.kick DESC, p.match_id DESC)[1:10] FROM kf p WHERE p.team = a.team AND p.kick < a.kick) AS l FROM kf a),
      c AS (SELECT match_id, team, at_home, kick_off, coalesce(len(l), 0) AS matches, {", ".join(f"coalesce(len(list_filter(l, lambda x: {t})), 0) AS {k}" for k, t in (("wins", "x.o = 'win'"), ("draws", "x.o = 'draw'"), ("losses", "x.o = 'loss'"), ("over", "x.d > 0"), ("under", "x.d < 0")))},
        {", ".join(f"coalesce(list_sum(list_transform(list_filter(l, lambda x: x.o IS NOT NULL), lambda x: x.{k})), 0)::BIGINT AS {n}" for k, n in (("gf", "goals_for"), ("ga", "goals_against")))} FROM b)
      SELECT *, {", ".join(f"CASE WHEN matches > 0 THEN {k} * 1.0::DOUBLE / matches END AS {k}_rate" for k in ("wins", "draws", "losses", "over", "under"))}, CASE WHEN matches > 0 THEN goals_for * 1.0::DOUBLE / matches END AS avg_for, CASE WHEN matches > 0 THEN goals_against * 1.0::DOUBLE / matches END AS avg_against FROM c"""),
    "form_table": sql(f"WITH {FORM} SELECT * FROM form"),
    "team_over_under": sql(f"WITH {LAST} SELECT *, {', '.join(f'CASE WHEN n = 0 THEN 0.0 ELSE 100.0::DOUBLE * {x} / n END AS {x}_pct' for x in ('over', 'under', 'push'))} FROM (SELECT team, count(*) AS matches, count(ou) AS n, {', '.join(f"count(*) FILTER (ou = '{x}') AS {x}" for x in ('over', 'under', 'push'))} FROM l GROUP BY team)"),
    "team_recent_report": sql(f"WITH {LAST} SELECT team, count(*) AS matches, {WDL}, {SUMS} FROM l GROUP BY team"),
    "head_to_head": sql("SELECT least(home_team, away_team) AS team_1, greatest(home_team, away_team) AS team_2, CAST(row_number() OVER w AS INTEGER) AS rn, match_id, match_time, home_team, away_team, h, a, result FROM f WINDOW w AS (PARTITION BY least(home_team, away_team), greatest(home_team, away_team) ORDER BY match_time DESC NULLS LAST, match_id DESC) QUALIFY rn <= 5"),
}
