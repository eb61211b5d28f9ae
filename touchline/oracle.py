"""The DuckDB side of the queries: the same derived tables and typed view as common table expressions.

It states its own tables of labels, cuts and columns and imports none from the operators.
"""

from __future__ import annotations

from .testbed import duckdb_view

#: Handicap labels in goals.
_GOALS = {
    "平手": 0.0, "平/半": 0.25, "平手/半球": 0.25, "半球": 0.5, "半/一": 0.75, "半球/一球": 0.75, "一球": 1.0, "一/球半": 1.25, "一球/球半": 1.25, "球半": 1.5, "球半/两": 1.75, "球半/两球": 1.75, "两球": 2.0, "两/两球半": 2.25,
    "两球半": 2.5, "两球半/三": 2.75, "两球半/三球": 2.75, "三球": 3.0, "三/三球半": 3.25, "三球半": 3.5,
}


def _only(*names: str, most: float = 99.0) -> dict[str, float]:
    return {k: _GOALS[k] for k in names if _GOALS[k] <= most}


_PLAIN = ("平手", "平/半", "平手/半球", "半球", "半/一", "半球/一球", "一球", "一/球半", "一球/球半", "球半", "球半/两", "球半/两球", "两球", "两/两球半", "两球半")
#: dialect: labels, and what becomes of other texts
_READ = {
    "label": (_only(*_PLAIN), "digits"), "pattern": (_only(*_PLAIN, "两球半/三", "三球"), "digits"), "level": (_only(*_PLAIN), "digits"), "strict": (_only(*_PLAIN, most=2.0), "number"),
    "hint": (_only("平手", "平/半", "半球", "半/一", "一球", "一/球半", "球半", "球半/两", "球半/两球", "两球", "两/两球半", "两球半", "两球半/三", "两球半/三球", "三球", "三/三球半", "三球半"), "signed"),
    "digits0": ({}, "digits_or_0"), "digits": ({}, "digits"),
}
_NUMBERS = {
    "win": "euro_{}_win", "draw": "euro_{}_draw", "lose": "euro_{}_lose", "hw": "asian_{}_home_odds", "aw": "asian_{}_away_odds", "over": "ou_{}_over_odds", "under": "ou_{}_under_odds",
    "hh": "hi_{}_home_odds", "hd": "hi_{}_draw_odds", "ha": "hi_{}_away_odds",
}


def present(*texts: str) -> str:
    return f"coalesce({', '.join(f"nullif({t}, '')" for t in texts)})"


def number(text: str) -> str:
    return f"TRY_CAST({text} AS DOUBLE)"


def whole(text: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({text}), '[+-]?[0-9]+') THEN CAST(trim({text}) AS INTEGER) END"


def line(text: str, dialect: str) -> str:
    labels, unknown = _READ[dialect]
    t = f"nullif({text}, '')"
    bare = f"replace({t}, '受', '')"
    digits = f"TRY_CAST(nullif(regexp_extract({t}, '([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE)"
    if not labels:
        return f"coalesce({digits}, 0.0)" if unknown == "digits_or_0" else digits
    case = f"CASE {bare} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in labels.items()) + " END"
    if unknown == "signed":
        signed = f"coalesce(TRY_CAST(nullif(regexp_extract({t}, '([-+]?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE), 0.0)"
        return f"CASE WHEN ({case}) IS NOT NULL THEN (CASE WHEN {t} LIKE '%受%' THEN 1 ELSE -1 END) * ({case}) ELSE {signed} END"
    other = digits if unknown == "digits" else f"TRY_CAST({bare} AS DOUBLE)"
    return f"(CASE WHEN {t} IS NULL THEN NULL ELSE (CASE WHEN {t} LIKE '%受%' THEN -1 ELSE 1 END) * coalesce({case}, {other}) END)"


def sign(diff: str, plus: str, zero: str, minus: str) -> str:
    return f"CASE WHEN {diff} > 0 THEN '{plus}' WHEN {diff} < 0 THEN '{minus}' WHEN {diff} = 0 THEN '{zero}' END"


def label(h0: str, h1: str, w0: str, w1: str) -> str:
    dh, dw = f"({line(h1, 'label')} - {line(h0, 'label')})", f"({number(w1)} - {number(w0)})"
    water = f"CASE WHEN {dw} < -0.02::DOUBLE THEN '降水' WHEN {dw} > 0.02::DOUBLE THEN '升水' END"
    return (
        f"CASE WHEN {dh} IS NULL OR {dw} IS NULL THEN NULL WHEN abs({dh}) < 0.01::DOUBLE AND abs({dw}) < 0.02::DOUBLE THEN '无变化' "
        f"WHEN {dh} > 0.01::DOUBLE THEN '升盘' || coalesce({water}, '') WHEN {dh} < -0.01::DOUBLE THEN '降盘' || coalesce({water}, '') ELSE coalesce({water}, '无变化') END"
    )


def _typed() -> str:
    first = []
    for name, pattern in _NUMBERS.items():
        a, b = pattern.format("initial"), pattern.format("current")
        first += [f"{number(a)} AS {name}0", f"{number(b)} AS {name}1", f"{number(present(b, a))} AS {name}"]
    first += [f"{whole('home_score')} AS h", f"{whole('away_score')} AS a", f"{present('asian_current_handicap', 'asian_initial_handicap')} AS line_text"]
    first += [f"{number(present('ou_current_total', 'ou_initial_total'))} AS total", f"{number("nullif(hi_handicap_value, '')")} AS index_line"]
    lined = f"SELECT *, h + a AS goals, {sign('(h - a)', 'home', 'draw', 'away')} AS result, {line('line_text', 'pattern')} AS line FROM m0"
    cover = sign("(CASE WHEN line_text LIKE '%受%' THEN h + abs(line) - a ELSE h - line - a END)", "home", "push", "away")
    done = f"SELECT *, {cover} AS cover, {sign('(goals - total)', 'over', 'push', 'under')} AS ou, {label('asian_initial_handicap', 'asian_current_handicap', 'asian_initial_home_odds', 'asian_current_home_odds')} AS label FROM m1"
    return f"m0 AS (SELECT *, {', '.join(first)} FROM matches), m1 AS ({lined}), m AS ({done}), f AS (SELECT * FROM m WHERE status = 2)"


def sql(body: str, *tables: str) -> str:
    """``body`` may read matches, m (typed) and f (finished, typed), and the derived ``tables`` named. It may begin with more CTEs."""
    views = [f"{t} AS ({duckdb_view(t)})" for t in tables]
    ctes = ", ".join([f"matches AS ({duckdb_view('matches')})", _typed(), *views])
    body = body.strip()
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


def shares(n: str = "n", **parts: str) -> str:
    """name_pct columns: 100 * count of the condition / n, 0 for none."""
    return ", ".join(f"CASE WHEN {n} = 0 THEN 0.0 ELSE 100.0::DOUBLE * {c} / {n} END AS {name}" for name, c in parts.items())


def bucket(x: str, cuts: list[tuple[str, float, str]], rest: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} {op} {cut}::DOUBLE THEN '{name}'" for op, cut, name in cuts) + f" ELSE '{rest}' END"
