"""Football tables derived from the order tables, by integer arithmetic that Spark and DuckDB share.

One expression text serves both engines: ``views("spark")`` and ``views("duckdb")`` differ only in integer division, list
access and date formats. The data hold the odd cases on purpose: empty and missing odds, scores that are no numbers,
handicap texts of all dialects, missing matches, legs without a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The tables that the derived ones are made of.
SOURCES = ("orders", "lineitem", "customer", "nation")
#: The handicap texts dealt out.
LINES = ["平手", "平/半", "平手/半球", "半球", "半/一", "一球", "受平/半", "受半球", "受一球", "球半", "两球", "0", "-1", "+1", "1.75", "未知", "", "受平手/半球", "两球半/三", "三球"]
TOTALS = ["2", "2.25", "2.5", "2.75", "3", "3.5", "1.75", "", "3.25"]
INDEX = ["-2", "-1", "+1", "1", "0", "2", "", "-1"]
OPTIONS = ["win", "draw", "lose", "h_win", "h_draw", "h_lose", "other"]
#: The feature lists of the predictors, for the leagues of these tables.
FEATURES = {
    "level_draw": ["NATION_1", "NATION_7", "NATION_12"], "level_away": ["NATION_3", "NATION_9"], "water_down": ["NATION_2", "NATION_5", "NATION_14"],
    "trap": ["NATION_4", "NATION_7", "NATION_20"], "high_goals": ["NATION_2", "NATION_11"], "low_goals": ["NATION_3", "NATION_16"],
}
COLUMNS = {
    "euro": [("win", 120, 380, 37, 13), ("draw", 280, 150, 11, 17), ("lose", 120, 500, 53, 29)],
    "asian": [("home_odds", 70, 60, 29, 19), ("away_odds", 70, 60, 43, 31)],
    "ou": [("over_odds", 70, 45, 23, 7), ("under_odds", 70, 45, 41, 9)],
    "hi": [("home_odds", 120, 400, 41, 23), ("draw_odds", 300, 150, 7, 11), ("away_odds", 150, 500, 59, 37)],
}


def _dialect(engine: str):
    spark = engine == "spark"
    div = (lambda a, b: f"({a} div {b})") if spark else (lambda a, b: f"({a} // {b})")

    def pick(values: list, index: str) -> str:
        items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
        return f"element_at(array({items}), CAST(({index}) % {len(values)} + 1 AS INT))" if spark else f"list_extract([{items}], CAST(({index}) % {len(values)} + 1 AS INT))"

    day = (lambda c, a, b: f"date_format({c}, '{a}')") if spark else (lambda c, a, b: f"strftime({c}, '{b}')")
    return div, pick, day


def match_columns(engine: str) -> dict[str, str]:
    div, pick, day = _dialect(engine)
    cents = lambda v: f"(CAST({div(v, 100)} AS STRING) || '.' || lpad(CAST(({v}) % 100 AS STRING), 2, '0'))"
    score = lambda v, m: f"CASE WHEN o_orderstatus = 'O' THEN '' WHEN k % 97 = {m} THEN '-' WHEN k % 89 = {m} THEN '' WHEN k % 83 = {m} THEN NULL WHEN k % 79 = {m} THEN '3.0' ELSE CAST({v} AS STRING) END"
    team = lambda i: f"'T' || CAST(c_nationkey * 12 + ({i}) AS STRING)"
    hs, aw = "(k * 31 + 7) % 5", "(k * 17 + 3) % 4"
    out = {
        "match_id": "CAST(k AS STRING)",
        "match_number": pick(["周一", "周二", "周三", "周四", "周五", "周六", "周日", "第一"], "k") + " || lpad(CAST(k % 1000 AS STRING), 3, '0')",
        "league": "CASE WHEN k % 131 = 0 THEN '' ELSE n_name END",
        "round": f"'R' || CAST({div('k', 12)} % 38 AS STRING)",
        "match_time": f"{day('o_orderdate', 'MM-dd', '%m-%d')} || ' ' || lpad(CAST(k % 24 AS STRING), 2, '0') || ':' || lpad(CAST((k * 5) % 60 AS STRING), 2, '0')",
        "owner_date": day("o_orderdate", "yyyy-MM-dd", "%Y-%m-%d"),
        "status": "CASE WHEN k % 53 = 0 THEN 6 WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END",
        "home_team": team("k % 12"),
        "away_team": team(f"(k % 12 + 1 + {div('k', 12)} % 11) % 12"),
        "home_rank": "'[' || lpad(CAST(k % 20 + 1 AS STRING), 2, '0') || ']'",
        "home_score": score(hs, 5),
        "away_score": score(aw, 11),
        "asian_initial_handicap": f"CASE WHEN k % 103 = 0 THEN NULL ELSE {pick(LINES, div('k', 3))} END",
        "asian_current_handicap": f"CASE WHEN k % 107 = 0 THEN NULL ELSE {pick(LINES, f'{div("k", 3)} + (CASE WHEN k % 5 < 2 THEN k % 3 ELSE 0 END)')} END",
        "ou_initial_total": pick(TOTALS, div("k", 2)),
        "ou_current_total": pick(TOTALS, f"{div('k', 2)} + (CASE WHEN k % 7 < 2 THEN 1 ELSE 0 END)"),
        "hi_handicap_value": f"CASE WHEN k % 109 = 0 THEN NULL ELSE {pick(INDEX, 'k')} END",
    }
    n = 0
    for market, parts in COLUMNS.items():
        for part, low, span, step, move in parts:
            n += 1
            first = f"({low} + (k * {step}) % {span})"
            for when, v in (("initial", first), ("current", f"({first} + (k * {move}) % 41 - 20)")):
                odd = f"k % {61 + 2 * n} = {1 if when == 'initial' else 2}"
                out[f"{market}_{when}_{part}"] = f"CASE WHEN {odd} THEN {pick(['', None, '0', 'abc'], div('k', 64))} ELSE {cents(v)} END"
    return out


def prediction_columns(engine: str) -> dict[str, str]:
    div, pick, _ = _dialect(engine)
    return {
        "match_id": "CAST(k AS STRING)",
        "win_prediction": pick(["home", "draw", "away", "home", None], div("k", 3)),
        "asian_prediction": pick(["home", "away", "home", "away", None, "away"], div("k", 5)),
        "asian_handicap": pick(["平手", "受平/半", "半球", "一球", "-1", "1.25", "两球半", "", None], div("k", 2)),
        "ou_prediction": pick(["over", "under", "over", None], div("k", 7)),
        "ou_total": pick(["2.5", "2", "3", None, "2.25"], "k"),
        "win_confidence": "CAST(50 + k % 45 AS DOUBLE)",
        "asian_confidence": "CAST(50 + (k * 7) % 40 AS DOUBLE)",
        "ou_confidence": "CAST(50 + (k * 11) % 35 AS DOUBLE)",
        "predicted_home_score": "CASE WHEN k % 19 = 0 THEN NULL ELSE CAST(k % 4 AS INT) END",
        "predicted_away_score": f"CASE WHEN k % 19 = 0 THEN NULL ELSE CAST({div('k', 3)} % 3 AS INT) END",
        "manual_win_prediction": pick([None, None, "draw", None, "", "away"], div("k", 11)),
        "manual_asian_prediction": pick([None, "away", None, None], div("k", 13)),
        "manual_asian_handicap": pick([None, "半球", None], div("k", 13)),
        "is_reviewed": "k % 4 = 2",
        "predict_date": "o_orderdate",
    }


def leg_columns(engine: str) -> dict[str, str]:
    div, pick, _ = _dialect(engine)
    return {
        "bet_id": f"CAST(l_orderkey * 10 + {div('l_linenumber - 1', 3)} AS STRING)",
        "group_id": "CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE CAST(l_orderkey AS STRING) END",
        "device_id": "'d' || CAST(o_custkey % 50 AS STRING)",
        "pos": "CAST((l_linenumber - 1) % 3 AS INT)",
        "mid": "CAST(l_orderkey + l_linenumber * 17 AS STRING)",
        "opt": pick(OPTIONS, "l_partkey"),
        "leg_odds": "CAST(120 + l_suppkey % 90 AS DOUBLE) / 100",
        "leg_handicap": pick([None, "-1", "+1", "", None, None, "x"], div("l_partkey", 3)),
        "descr": f"'D' || CAST({div('l_partkey', 3)} % 9 AS STRING)",
        "stake": f"CAST(10 + l_orderkey % 90 + {div('l_linenumber - 1', 3)} AS DOUBLE)",
        "old_status": "CASE WHEN l_orderkey % 5 = 0 THEN 'won' WHEN l_orderkey % 5 = 1 THEN 'lost' ELSE 'pending' END",
        "created_at": "o_orderdate",
    }


def pick_columns(engine: str) -> dict[str, str]:
    div, pick, _ = _dialect(engine)
    return {
        "match_id": "CAST(k AS STRING)",
        "device_id": "'d' || CAST(k % 50 AS STRING)",
        "options": pick(["win", "win,h_win", "draw", "h_lose", "lose,win", "bad", "win,win", "h_win,h_lose", "", "draw,h_draw,lose"], div("k", 3)),
        "confidence": pick(["80", None, "130", "-5", "abc", "55", "80.5", "0"], div("k", 5)),
        "created_at": "o_orderdate",
    }


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


def _source(name: str) -> tuple[str, str, dict]:
    orders = "(SELECT o_orderkey AS k, o_orderstatus, o_orderdate, o_custkey FROM orders) o"
    full = f"{orders} JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"
    return {
        "matches": (full, "", match_columns),
        "predictions": (orders, "WHERE k % 2 = 0", prediction_columns),
        "legs": ("lineitem JOIN orders ON o_orderkey = l_orderkey", "", leg_columns),
        "picks": (orders, "WHERE k % 3 <> 1", pick_columns),
    }[name]


def duckdb_view(name: str) -> str:
    source, where, columns = _source(name)
    return f"SELECT {_select(columns('duckdb'))} FROM {source} {where}"


def read(spark: SparkSession, sf_dir: str, name: str, by_day: bool = False) -> DataFrame:
    """The derived table ``name``: matches, predictions, legs or picks. ``by_day`` lays matches out by owner_date, status first within a partition."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES}
    # dealt out while the rows are narrow: a file of one row group would leave the wide texts to one task; a given number of
    # partitions is not merged by their bytes, which are few here
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = tables["orders"].selectExpr("o_orderkey AS k", "o_orderstatus", "o_orderdate", "o_custkey")
    if name == "matches":
        # nation has a fixed number of rows; the customer side is left to the optimizer
        nation = tables["nation"].select("n_nationkey", "n_name").hint("broadcast")
        base = orders.join(tables["customer"].select("c_custkey", "c_nationkey"), orders["o_custkey"] == tables["customer"]["c_custkey"]).join(nation, tables["customer"]["c_nationkey"] == nation["n_nationkey"])
        columns = match_columns("spark")
        base = base.select("k", "o_orderstatus", "o_orderdate", "c_nationkey", "n_name")
        if by_day:
            status = columns["status"]
            base = base.repartitionByRange(tasks, "o_orderdate").selectExpr("*", f"{status} AS s").sortWithinPartitions("s", "o_orderdate", "k")
        else:
            base = base.repartition(tasks, "k")
    elif name == "legs":
        base = tables["lineitem"].join(tables["orders"].select("o_orderkey", "o_custkey", "o_orderdate"), tables["lineitem"]["l_orderkey"] == tables["orders"]["o_orderkey"])
        columns = leg_columns("spark")
    else:
        base = orders.repartition(tasks, "k").where(_source(name)[1].removeprefix("WHERE "))
        columns = _source(name)[2]("spark")
    return base.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])
