"""DuckDB SQL of picks, bets and candidate search."""

from __future__ import annotations

from ..operators.teams_sql import PROFILE
from ..oracle import present, sql

_D = "(CASE WHEN opt LIKE 'h\\_%' ESCAPE '\\' THEN h + TRY_CAST(CASE WHEN leg_handicap IS NOT NULL THEN leg_handicap ELSE hi_handicap_value END AS DOUBLE) - a ELSE CAST(h - a AS DOUBLE) END)"
_HIT = f"(CASE WHEN opt IN ('win', 'h_win') THEN {_D} > 0 WHEN opt IN ('draw', 'h_draw') THEN {_D} = 0 WHEN opt IN ('lose', 'h_lose') THEN {_D} < 0 END)"
_t3 = lambda *c: " || '/' || ".join(f"coalesce(nullif({x}, ''), '-')" for x in c)
_MK = {"euro": ("win", "draw", "lose"), "asian": ("home_odds", "handicap", "away_odds"), "hi": ("home_odds", "draw_odds", "away_odds")}
_MT = ", ".join(f"CASE WHEN m.match_id IS NOT NULL THEN {_t3(*[f'm.{k}_{w}_{p}' for p in parts])} END AS {k}_{s}" for k, parts in _MK.items() for w, s in (("initial", "init"), ("current", "curr")))
LEGS = f"""lg AS (SELECT legs.*, m.home_team, m.away_team, m.league, m.match_number, m.match_time, m.status AS match_status, {_MT}, CASE WHEN m.match_id IS NOT NULL THEN coalesce(nullif(m.hi_handicap_value, ''), '-') END AS hi_value,
    CASE WHEN m.match_id IS NULL THEN '-:-' ELSE coalesce(m.home_score, '-') || ':' || coalesce(m.away_score, '-') END AS score_text,
    CASE WHEN status = 2 AND {_HIT} THEN 'won' WHEN status = 2 AND NOT {_HIT} THEN 'lost' ELSE 'pending' END AS leg_state FROM legs LEFT JOIN m ON m.match_id = legs.mid)"""
SETTLED = f"""{LEGS}, b0 AS (SELECT bet_id, coalesce(max(group_id), bet_id) AS group_id, max(device_id) AS device_id, max(created_at) AS created_at, CASE WHEN count(*) > 1 THEN 'parlay' ELSE 'single' END AS type, max(descr) AS descr, max(stake) AS stake,
    list_reduce(list_prepend(1.0::DOUBLE, list(leg_odds ORDER BY pos, mid, opt, leg_odds)), lambda x, y: x * y) AS odds, count(*) AS legs, max(old_status) AS old_status, bool_or(leg_state = 'pending') AS open, bool_or(leg_state = 'lost') AS lost FROM lg GROUP BY bet_id),
  b1 AS (SELECT *, CASE WHEN old_status <> 'pending' THEN old_status WHEN open THEN 'pending' WHEN lost THEN 'lost' ELSE 'won' END AS status FROM b0),
  st AS (SELECT bet_id, group_id, device_id, created_at, type, descr, stake, odds, legs, status, CASE status WHEN 'won' THEN stake * odds WHEN 'lost' THEN 0.0 END AS actual_return, CASE WHEN old_status = 'pending' AND status <> 'pending' THEN TIMESTAMP '2024-05-01' END AS settled_at FROM b1)"""
GROUPS = """gr AS (SELECT * EXCLUDE (open), CASE WHEN open THEN 'pending' WHEN returned > 0 THEN 'won' ELSE 'lost' END AS status FROM (SELECT device_id, group_id, max(created_at) AS created_at, count(*) AS n, sum(stake) AS stake, CAST(sum(CAST(coalesce(actual_return, 0) AS DECIMAL(28, 10))) AS DOUBLE) AS returned, bool_or(status = 'pending') AS open,
    arg_max(type, (created_at, bet_id)) AS newest_type, arg_max(descr, (created_at, bet_id)) AS descr, string_agg(bet_id, ',' ORDER BY created_at DESC, bet_id DESC) AS tickets FROM st GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY created_at DESC, group_id) <= 50)"""
STATS = "SELECT *, returned - stake AS net, CASE WHEN n = pending THEN 0.0 ELSE won * 1.0::DOUBLE / (n - pending) END AS win_rate FROM (SELECT device_id, count(*) AS n, sum(stake) AS stake, CAST(sum(CAST(coalesce(actual_return, 0) AS DECIMAL(28, 10))) AS DOUBLE) AS returned, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'won') AS won FROM st GROUP BY 1)"
_ALLOWED = "('win', 'draw', 'lose', 'h_win', 'h_draw', 'h_lose')"
_num = "TRY_CAST(confidence AS DOUBLE)"
PICKS = f"""p0 AS (SELECT *, list_filter(str_split(options, ','), lambda x: x IN {_ALLOWED}) AS opts, CASE WHEN {_num} IS NULL THEN 90.0::DOUBLE ELSE greatest(0.0, least(100.0::DOUBLE, {_num})) END AS conf FROM picks),
  p1 AS (SELECT *, list_distinct(list_filter(opts, lambda x: x IN ('win', 'draw', 'lose'))) AS plain, list_distinct(list_filter(opts, lambda x: x IN ('h_win', 'h_lose'))) AS sides FROM p0 WHERE len(opts) > 0),
  pk AS (SELECT match_id, device_id, opts AS manual_options, CASE WHEN len(plain) = 1 THEN CASE plain[1] WHEN 'win' THEN 'home' WHEN 'draw' THEN 'draw' ELSE 'away' END END AS manual_win_prediction, CASE WHEN len(plain) = 1 THEN conf END AS manual_win_confidence,
    CASE WHEN len(sides) = 1 THEN CASE sides[1] WHEN 'h_win' THEN 'home' ELSE 'away' END END AS manual_asian_prediction, CASE WHEN len(sides) = 1 THEN conf END AS manual_asian_confidence, created_at FROM p1)"""
_LINED = "ln AS (SELECT pk.*, CASE WHEN manual_asian_prediction IS NOT NULL THEN coalesce(nullif(m.asian_current_handicap, ''), m.asian_initial_handicap, '') END AS manual_asian_handicap FROM pk JOIN m USING (match_id))"
_o = {"win": ("euro_initial_win", "euro_current_win"), "draw": ("euro_initial_draw", "euro_current_draw"), "lose": ("euro_initial_lose", "euro_current_lose"), "h_win": ("hi_current_home_odds", "hi_initial_home_odds"), "h_draw": ("hi_current_draw_odds", "hi_initial_draw_odds"), "h_lose": ("hi_current_away_odds", "hi_initial_away_odds")}
_of = lambda k: f"TRY_CAST({present(*_o[k])} AS DOUBLE)"
_PICKED = "list_filter(list_transform(manual_options, lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN o_{k}" for k in _o) + " END), lambda x: x IS NOT NULL)"
_WORDS = "list_transform(manual_options, lambda x: CASE x WHEN 'win' THEN '主胜' WHEN 'draw' THEN '平' WHEN 'lose' THEN '客胜' WHEN 'h_win' THEN '让胜' WHEN 'h_draw' THEN '让平' WHEN 'h_lose' THEN '让负' END)"
_show = lambda *k: " || '/' || ".join(f"coalesce({present(*_o[x])}, '-')" for x in k)
MY = f"""{PICKS}, up AS (SELECT m.*, {', '.join(f'{_of(k)} AS o_{k}' for k in _o)} FROM m WHERE status = 0),
  mp AS (SELECT pk.match_id, device_id, match_number, league, match_time, home_team, away_team, manual_options AS options, {_WORDS} AS options_text, coalesce(nullif(manual_win_confidence, 0), nullif(manual_asian_confidence, 0), 90.0::DOUBLE) AS confidence,
    {_show('win', 'draw', 'lose')} AS euro_odds, hi_handicap_value AS hi_handicap, {_show('h_win', 'h_draw', 'h_lose')} AS hi_odds, {_PICKED} AS pick_odds, list_min({_PICKED}) AS main_odds,
    coalesce(o_win, 0) AS grid_win, coalesce(o_h_lose, 0) AS grid_h_lose, coalesce(nullif(hi_handicap_value, ''), '0') AS grid_val FROM pk JOIN up ON up.match_id = pk.match_id)"""
_p = lambda c: f"TRY_CAST(coalesce(nullif({c}, ''), '0') AS DOUBLE)"
_PW, _PD, _PL, _PT, _PO = _p("euro_initial_win"), _p("euro_initial_draw"), _p("euro_initial_lose"), _p("ou_initial_total"), f"({_p('ou_initial_over_odds')} + 1.0)"
_T0 = "coalesce(TRY_CAST(nullif(ou_initial_total, '') AS DOUBLE), 0)"
HIGH = f"""u0 AS (SELECT match_id, match_time, {_PW} AS w, {_PL} AS l, {_PT} AS t, {_PO} AS o FROM m WHERE status = 0),
  c AS (SELECT match_id, match_time, 1 AS k, '主胜' AS type, w AS odds FROM u0 WHERE l IS NOT NULL AND w BETWEEN 1.65::DOUBLE AND 1.95::DOUBLE UNION ALL SELECT match_id, match_time, 2, '客胜', l FROM u0 WHERE w IS NOT NULL AND NOT w BETWEEN 1.65::DOUBLE AND 1.95::DOUBLE AND l BETWEEN 1.65::DOUBLE AND 1.95::DOUBLE
    UNION ALL SELECT match_id, match_time, 3, '大球', o FROM u0 WHERE w IS NOT NULL AND l IS NOT NULL AND o BETWEEN 1.70::DOUBLE AND 2.0 AND t >= 2.5)"""
RATED = f"""{PROFILE}, pr AS (SELECT team, 100.0::DOUBLE * wins / matches AS w, 100.0::DOUBLE * losses / matches AS l, 100.0::DOUBLE * big_games / matches AS b FROM tp),
  u AS (SELECT m.*, coalesce(x.w, 0) AS hw_, coalesce(x.l, 0) AS hl_, coalesce(x.b, 0) AS hb_, coalesce(y.w, 0) AS aw_, coalesce(y.l, 0) AS al_, coalesce(y.b, 0) AS ab_ FROM m LEFT JOIN pr x ON x.team = home_team LEFT JOIN pr y ON y.team = away_team WHERE status = 0)"""
_NUMS = f"SELECT *, {_PW} AS pw, {_PD} AS pd, {_PL} AS pl, {_PT} AS pt, {_PO} AS po FROM u"
PROFILED = f"""{RATED}, v0 AS (SELECT * FROM ({_NUMS}) WHERE pw IS NOT NULL AND pl IS NOT NULL AND pt IS NOT NULL AND po IS NOT NULL),
  c AS (SELECT match_id, match_time, 1 AS k, '主胜' AS type, pw AS odds FROM v0 WHERE pw BETWEEN 1.5 AND 2.0 AND (hw_ >= 40 OR al_ >= 40) UNION ALL SELECT match_id, match_time, 2, '客胜', pl FROM v0 WHERE pl BETWEEN 1.5 AND 2.0 AND (aw_ >= 40 OR hl_ >= 40)
    UNION ALL SELECT match_id, match_time, 3, '大球', po FROM v0 WHERE po BETWEEN 1.7::DOUBLE AND 2.0 AND pt >= 2.5 AND ((hb_ + ab_) / 2 >= 50 OR pt >= 3.0))"""
_RANKED = "rc AS (SELECT *, CAST(round(odds * 100) AS BIGINT) AS v, row_number() OVER (ORDER BY match_time DESC NULLS LAST, match_id DESC, k) AS i FROM c)"
_PAIR = f"{_RANKED} SELECT x.match_id AS match_1, x.k AS k_1, y.match_id AS match_2, y.k AS k_2, x.v / 100.0::DOUBLE AS odds_1, y.v / 100.0::DOUBLE AS odds_2, abs(x.v * y.v - 30000) / 10000.0::DOUBLE AS diff FROM rc x JOIN rc y ON x.i < y.i AND x.match_id <> y.match_id {{w}} ORDER BY abs(x.v * y.v - 30000), x.i, y.i LIMIT {{n}}"
FULL = f"""{RATED}, c AS (SELECT match_id, match_time, k, CASE k WHEN 1 THEN '主胜' WHEN 2 THEN '客胜' ELSE '大球' END AS type, CASE k WHEN 1 THEN pw WHEN 2 THEN pl ELSE po END AS odds FROM (SELECT *, CASE WHEN pw BETWEEN 1.65::DOUBLE AND 1.95::DOUBLE AND hw_ >= 50 THEN 1
    WHEN pl BETWEEN 1.65::DOUBLE AND 1.95::DOUBLE AND aw_ >= 50 THEN 2 WHEN po BETWEEN 1.7::DOUBLE AND 2.0 AND pt >= 2.5 AND ((hb_ + ab_) / 2 >= 50 OR pt >= 3.0) THEN 3 END AS k FROM ({_NUMS}) WHERE pw IS NOT NULL AND pd IS NOT NULL AND pl IS NOT NULL AND pt IS NOT NULL AND po IS NOT NULL) WHERE k IS NOT NULL)"""
BANKER = f"""c AS (SELECT match_id, 1 AS k, '主胜' AS type, win0 AS odds FROM m WHERE status = 0 AND win0 BETWEEN 1.30::DOUBLE AND 1.60::DOUBLE UNION ALL SELECT match_id, 3, '大球', 1.85::DOUBLE FROM m WHERE status = 0 AND win0 > 1.01::DOUBLE AND {_T0} >= 3.0)"""


def fold(n: int, target: float) -> str:
    """All combinations of the first ``n`` matches of each odds value, nearest first, then first in candidate order."""
    x = [f"x{i}" for i in range(1, n + 1)]
    product = " * ".join(f"{a}.v" for a in x)
    joins = " ".join(f"JOIN one {b} ON {a}.i < {b}.i AND {b}.match_id NOT IN ({', '.join(f'{y}.match_id' for y in x[: x.index(b)])})" for a, b in zip(x, x[1:], strict=False))
    out = ", ".join([f"{a}.match_id AS match_{i}, {a}.k AS k_{i}, {a}.v / 100.0::DOUBLE AS odds_{i}" for i, a in enumerate(x, 1)])
    order = ", ".join(f"{a}.i" for a in x)
    return f"""{_RANKED}, one AS (SELECT v, match_id, arg_min(k, i) AS k, min(i) AS i FROM rc GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY v ORDER BY min(i)) <= {n})
    SELECT {out}, ({product}) / {100**n}.0::DOUBLE AS product, abs({product} - {round(target * 100) * 100 ** (n - 1)}) / {100**n}.0::DOUBLE AS diff FROM one x1 {joins} ORDER BY abs({product} - {round(target * 100) * 100 ** (n - 1)}), {order} LIMIT 1"""


def fold5(target: float) -> str:
    """Five legs: all combinations of values first; those at least as near as the best whose values have five matches each are filled with legs."""
    x, aim = range(1, 6), round(target * 100) * 100**4
    product = " * ".join(f"a{i}.v" for i in x)
    chain = " ".join(f"JOIN vm a{i} ON a{i - 1}.v <= a{i}.v" for i in x[1:])
    legs = " ".join(f"JOIN one x{i} ON x{i}.v = v{i}" for i in x)
    apart = " AND ".join(f"x{i}.match_id <> x{j}.match_id AND (v{i} <> v{j} OR x{i}.i < x{j}.i)" for i in x for j in x if i < j)
    out = ", ".join(f"l[{i}].match_id AS match_{i}, l[{i}].k AS k_{i}, l[{i}].v / 100.0::DOUBLE AS odds_{i}" for i in x)
    return f"""{_RANKED}, one AS (SELECT v, match_id, arg_min(k, i) AS k, min(i) AS i FROM rc GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY v ORDER BY min(i)) <= 5),
    vm AS (SELECT v::BIGINT AS v, count(*) AS m FROM one GROUP BY 1),
    cb AS (SELECT {", ".join(f"a{i}.v AS v{i}" for i in x)}, abs({product} - {aim}) AS off, {" AND ".join(f"a{i}.m >= 5" for i in x)} AS sure FROM vm a1 {chain}),
    near AS (SELECT * FROM cb WHERE off <= (SELECT coalesce(min(off) FILTER (WHERE sure), {10**18}) FROM cb)),
    fl AS (SELECT off, {" * ".join(f"v{i}" for i in x)} AS product, list_sort([{", ".join(f"{{'i': x{i}.i, 'match_id': x{i}.match_id, 'k': x{i}.k, 'v': x{i}.v}}" for i in x)}]) AS l FROM near {legs} WHERE {apart})
    SELECT {out}, product / {100**5}.0::DOUBLE AS product, off / {100**5}.0::DOUBLE AS diff FROM fl ORDER BY off, list_transform(l, lambda q: q.i) LIMIT 1"""


SQL = {
    "settle_bets": sql(f"WITH {SETTLED} SELECT * FROM st", "legs"),
    "settle_in_time": sql(f"""WITH {SETTLED.replace("lg AS (SELECT legs.*,", "cl AS (SELECT bet_id AS cb, max(owner_date::TIMESTAMP) AS closes_at FROM legs JOIN m ON m.match_id = legs.mid GROUP BY 1), lg AS (SELECT legs.*,").replace("WHEN status = 2 AND", "WHEN status = 2 AND in_time AND").replace("FROM legs LEFT JOIN m ON m.match_id = legs.mid)", "FROM legs JOIN cl ON cb = bet_id LEFT JOIN (SELECT *, owner_date::TIMESTAMP + CASE WHEN match_id::BIGINT % 7 = 0 THEN INTERVAL 9 HOURS ELSE INTERVAL 2 HOURS END AS ended FROM m) m ON m.match_id = legs.mid, LATERAL (SELECT coalesce(ended BETWEEN closes_at - INTERVAL 3 DAYS AND closes_at + INTERVAL 4 HOURS, FALSE) AS in_time))")} SELECT * EXCLUDE (settled_at) FROM st""", "legs"),
    "bet_stats": sql(f"WITH {SETTLED} {STATS}", "legs"),
    "daily_bet_stats": sql(f"WITH {SETTLED} SELECT *, returned - stake AS profit FROM (SELECT device_id, strftime(created_at, '%Y-%m-%d') AS day, sum(stake) AS stake, CAST(sum(CAST(coalesce(actual_return, 0) AS DECIMAL(28, 10))) AS DOUBLE) AS returned, count(*) AS n FROM st GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY day DESC) <= 30", "legs"),
    "bet_groups": sql(f"WITH {SETTLED}, {GROUPS} SELECT * FROM gr", "legs"),
    "enrich_legs": sql(f"WITH {LEGS} SELECT bet_id, pos, mid, opt, leg_odds, leg_handicap, home_team, away_team, league, match_number, match_time, score_text, match_status, euro_init, euro_curr, asian_init, asian_curr, hi_init, hi_curr, hi_value, leg_state FROM lg", "legs"),
    "bets_dashboard": sql(f"WITH {SETTLED}, {GROUPS}, sm AS ({STATS}), tk AS (SELECT st.*, gr.status AS group_status, CAST(row_number() OVER (PARTITION BY st.device_id, st.group_id ORDER BY st.created_at DESC, bet_id DESC) - 1 AS INT) AS ticket FROM st JOIN gr ON gr.device_id = st.device_id AND gr.group_id = st.group_id) SELECT tk.device_id, tk.group_id, group_status, ticket, tk.bet_id, tk.status AS bet_status, pos, mid, score_text, euro_init, asian_curr, hi_value, leg_state, sm.n AS all_bets, sm.pending, sm.won FROM tk JOIN lg ON lg.bet_id = tk.bet_id JOIN sm ON sm.device_id = tk.device_id", "legs"),
    "bets_of": sql(f"WITH {SETTLED} SELECT bet_id, created_at, status, odds FROM st WHERE device_id = 'd7' AND status = 'won' ORDER BY created_at DESC NULLS LAST, bet_id LIMIT 100", "legs"),
    "picks_of": sql(f"WITH {PICKS} SELECT match_id, manual_win_prediction, manual_asian_prediction, created_at FROM pk WHERE device_id = 'd11' ORDER BY created_at DESC NULLS LAST, match_id LIMIT 40", "picks"),
    "upsert_user_picks": sql(f"WITH {PICKS}, {_LINED}, pa AS (SELECT * FROM ln WHERE CAST(match_id AS BIGINT) % 4 <> 0), pb AS (SELECT * FROM ln WHERE CAST(match_id AS BIGINT) % 4 IN (0, 2)) SELECT coalesce(pa.device_id, pb.device_id) AS device_id, coalesce(pa.match_id, pb.match_id) AS match_id, CASE WHEN pb.match_id IS NOT NULL THEN coalesce('again', NULL) ELSE pa.manual_win_prediction END AS manual_win_prediction, coalesce(pb.manual_asian_handicap, pa.manual_asian_handicap) AS manual_asian_handicap, coalesce(pb.created_at, pa.created_at) AS created_at, CASE WHEN pb.match_id IS NOT NULL THEN TIMESTAMP '2024-05-02' ELSE TIMESTAMP '2024-05-01' END AS updated_at FROM pa FULL JOIN pb ON pa.match_id = pb.match_id AND pa.device_id = pb.device_id", "picks"),
    "delete_user_pick": sql(f"WITH {PICKS} SELECT device_id, match_id FROM pk WHERE CAST(match_id AS BIGINT) % 7 <> 0", "picks"),
    "append_and_update_bets": sql(f"WITH {SETTLED}, a AS (SELECT bet_id, coalesce(group_id, bet_id) AS group_id, coalesce(created_at, TIMESTAMP '2024-05-01') AS created_at, status FROM st) SELECT bet_id, group_id, created_at, CASE WHEN CAST(bet_id AS BIGINT) % 5 = 0 THEN 'won' ELSE status END AS status FROM a", "legs"),
    "normalise_picks": sql(f"WITH {PICKS}, {_LINED} SELECT * FROM ln", "picks"),
    "my_picks": sql(f"WITH {MY} SELECT * FROM mp", "picks"),
    "my_picks_list": sql(f"WITH {MY} SELECT match_id, match_time, confidence, main_odds FROM mp WHERE device_id = 'd5' ORDER BY match_time NULLS LAST, match_id", "picks"),
    "high_odds_candidates": sql(f"WITH {HIGH} SELECT * FROM c"),
    "high_odds_pair": sql(f"WITH {HIGH}" + ", " + _PAIR.format(w="WHERE x.v * y.v BETWEEN 28000 AND 35000", n=1)),
    "nearest_pairs": sql(f"WITH {HIGH}" + ", " + _PAIR.format(w="", n=3)),
    "profile_candidates": sql(f"WITH {PROFILED} SELECT * FROM c"),
    "profile_pair": sql(f"WITH {PROFILED}" + ", " + _PAIR.format(w="", n=1)),
    "full_analysis_candidates": sql(f"WITH {FULL} SELECT * FROM c"),
    "full_analysis_pair": sql(f"WITH {FULL}" + ", " + _PAIR.format(w="WHERE x.v * y.v BETWEEN 28000 AND 35000", n=1)),
    "three_fold": sql(f"WITH {PROFILED}, {fold(3, 5.0)}"),
    "four_fold": sql(f"WITH {PROFILED}, {fold(4, 8.0)}"),
    "two_fold": sql(f"WITH {PROFILED}, {fold(2, 3.0)}"),
    "five_fold": sql(f"WITH {PROFILED}, {fold5(9.0)}"),
    "low_odds_pick": sql("WITH x AS (SELECT match_id, win0, result, sha256('7:' || match_id) AS draw FROM f WHERE result IS NOT NULL AND win0 > 1.1::DOUBLE AND win0 < 1.65::DOUBLE ORDER BY draw LIMIT 2) SELECT count(*) AS legs, string_agg(match_id, ',' ORDER BY draw) AS matches, list_reduce(list_prepend(1.0::DOUBLE, list(win0 ORDER BY draw)), lambda a, b: a * b) AS product, CASE WHEN bool_and(result = 'home') THEN list_reduce(list_prepend(1.0::DOUBLE, list(win0 ORDER BY draw)), lambda a, b: a * b) ELSE 0.0 END AS returned FROM x HAVING count(*) > 0"),
    "banker_candidates": sql(f"WITH {BANKER} SELECT * FROM c"),
    "banker_pair": sql(f"WITH {BANKER}, o AS (SELECT *, row_number() OVER (ORDER BY odds, match_id, k) AS rn FROM c) SELECT x.match_id AS match_1, x.k AS k_1, x.odds AS odds_1, y.match_id AS match_2, y.k AS k_2, y.odds AS odds_2, x.odds * y.odds AS product FROM o x JOIN o y ON x.rn = 1 AND y.rn = 2"),
    "low_odds_backtest": sql("WITH x AS (SELECT coalesce(league, '') AS lg, result, win0 FROM f WHERE win0 > 1.1::DOUBLE AND win0 < 1.65::DOUBLE), y AS (SELECT lg AS league, 0 AS whole, result, win0 FROM x UNION ALL SELECT NULL, 1, result, win0 FROM x) SELECT *, 100.0::DOUBLE * hits / n AS hit_pct, 100.0::DOUBLE * (returned - n) / n AS roi_pct FROM (SELECT league, whole, count(result) AS n, count(*) FILTER (result = 'home') AS hits, CAST(sum(CAST(CASE WHEN result = 'home' THEN win0 ELSE 0 END AS DECIMAL(28, 10))) AS DOUBLE) AS returned FROM y GROUP BY 1, 2) WHERE n > 0"),
    "delete_bet_group": sql(f"WITH {SETTLED}, rq AS (SELECT DISTINCT device_id, CASE WHEN CAST(bet_id AS BIGINT) % 2 = 0 THEN group_id ELSE bet_id END AS id FROM st WHERE CAST(bet_id AS BIGINT) % 7 = 0) SELECT bet_id, group_id, device_id FROM st WHERE NOT EXISTS (SELECT 1 FROM rq WHERE rq.device_id = st.device_id AND (rq.id = st.bet_id OR rq.id = st.group_id))", "legs"),
}
