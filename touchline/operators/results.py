"""Conditional result statistics: one scan of the typed view, one partial and one final aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bucket, first_present, nonzero, parse_handicap, pct
from ..functions.outcome import _sign

#: The thresholds and group names of the analyses.
LABELS = ["升盘降水", "升盘升水", "升盘", "降盘降水", "降盘升水", "降盘", "升水", "降水", "无变化", "无标签"]
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
LEVEL_TEXTS = ["平手", "平/半", "平手/半球", "0", "0.25"]
STRICT_TEXTS = ["平手", "0"]


def count_of(test: Column) -> Column:
    return F.count_if(test)


def finished(m: DataFrame) -> DataFrame:
    return m.where("status = 2")


def decided(m: DataFrame) -> DataFrame:
    """Finished matches whose score parses."""
    return finished(m).where(F.col("result").isNotNull())


def by_result(m: DataFrame, key: Column, cover: bool = False) -> DataFrame:
    """grp, n, home, draw, away and their shares; with ``cover`` also cover_home, cover_away, cover_push and shares over all three."""
    r, c = F.col("result"), F.col("cover")
    aggs = [F.count("*").alias("n"), *[count_of(r == x).alias(x) for x in ("home", "draw", "away")]]
    if cover:
        aggs += [count_of(c == x).alias(f"cover_{x}") for x in ("home", "away", "push")]
    out = m.groupBy(key.alias("grp")).agg(*aggs).where("grp IS NOT NULL")
    shares = {f"{x}_pct": pct(F.col(x), F.col("n")) for x in ("home", "draw", "away")}
    if cover:
        both = F.col("cover_home") + F.col("cover_away") + F.col("cover_push")
        shares |= {f"cover_{x}_pct": pct(F.col(f"cover_{x}"), both) for x in ("home", "away")}
    return out.withColumns(shares)


def movement_label_results(m: DataFrame) -> DataFrame:
    """By line movement label; the display order stands beside it."""
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("无标签"))
    order = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("grp"))
    return by_result(decided(m), label, cover=True).withColumn("pos", order.cast("int"))


def euro_movement_results(m: DataFrame) -> DataFrame:
    """Five exclusive groups of the home odds' change and two overlapping ones; one explode, one shuffle."""
    pairs = {x: (nonzero(F.col(f"{x}0")), nonzero(F.col(f"{x}1"))) for x in ("win", "draw", "lose")}
    change = {x: b - a for x, (a, b) in pairs.items()}
    groups = F.array_compact(F.array(bucket(change["win"], EURO_CUTS, EURO_REST), F.when(change["draw"] < -0.15, DRAW_DROP), F.when(change["lose"] < -0.15, LOSE_DROP)))
    rows = decided(m).where(change["win"].isNotNull()).select("result", F.explode(groups).alias("g"))
    return by_result(rows.withColumn("cover", F.lit(None).cast("string")), F.col("g"))


def handicap_size_results(m: DataFrame) -> DataFrame:
    return by_result(decided(m), bucket(F.col("line"), LINE_CUTS, LINE_REST), cover=True)


def water_change_results(m: DataFrame) -> DataFrame:
    change = nonzero(F.col("hw1")) - nonzero(F.col("hw0"))
    return by_result(decided(m), bucket(change, WATER_CUTS, WATER_REST), cover=True)


def ou_shares(df: DataFrame, *keys) -> DataFrame:
    o = F.col("ou")
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), *[count_of(o == x).alias(x) for x in ("over", "under", "push")])
    return out.withColumns({f"{x}_pct": pct(F.col(x), F.col("n")) for x in ("over", "under", "push")})


def ou_pattern(m: DataFrame) -> DataFrame:
    rows = decided(m).where(nonzero(F.col("total")).isNotNull())
    return ou_shares(rows, bucket(F.col("total"), TOTAL_CUTS, TOTAL_REST).alias("grp"))


def goal_histogram(m: DataFrame) -> DataFrame:
    """goals, n, pct and the mean over all; the histogram is a few rows, its total a window over them."""
    h = decided(m).groupBy("goals").agg(F.count("*").alias("n"))
    total = h.agg(F.sum("n").alias("all_n"), F.sum(F.col("goals") * F.col("n")).alias("all_goals"))
    out = h.crossJoin(F.broadcast(total))  # one row
    return out.select("goals", "n", pct(F.col("n"), F.col("all_n")).alias("pct"), (F.col("all_goals").cast("double") / F.col("all_n")).alias("mean_goals"))


def handicap_index_results(m: DataFrame) -> DataFrame:
    """By the three-way handicap value read as a handicap text, which drops its sign: -1 and +1 fall together."""
    line = parse_handicap(F.col("hi_handicap_value"), "pattern")
    diff = F.when(F.contains(F.col("hi_handicap_value"), F.lit("受")), F.col("h") + F.abs(line) - F.col("a")).otherwise(F.col("h") - line - F.col("a"))
    rows = decided(m).withColumn("cover", _sign(diff, "home", "push", "away"))
    out = by_result(rows, bucket(line, INDEX_CUTS, INDEX_REST), cover=True)
    return out.drop("cover_home_pct", "cover_away_pct").withColumnsRenamed({"cover_home": "hi_home", "cover_push": "hi_draw", "cover_away": "hi_away"})


def goal_distribution(m: DataFrame, league: str | None = None) -> DataFrame:
    """goals, n, band, pct over all finished rows, also those whose score doesn't parse."""
    rows = finished(m) if league is None else finished(m).where(F.col("league") == league)
    total = F.broadcast(rows.agg(F.count("*").alias("all_n")))  # one row
    h = rows.where("goals IS NOT NULL").groupBy("goals").agg(F.count("*").alias("n")).crossJoin(total)
    band = F.when(F.col("goals") < 2, "0-1").when(F.col("goals") <= 3, "2-3").otherwise("4+")
    return h.select("goals", "n", band.alias("band"), pct(F.col("n"), F.col("all_n")).alias("pct"))


def ou_probability(m: DataFrame, league: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """One row: n, over, under, push, no_odds and shares over rows that have a line."""
    rows = decided(m) if league is None else decided(m).where(F.col("league") == league)
    rows = rows if least is None else rows.where(F.col("goals") >= least)
    rows = rows if most is None else rows.where(F.col("goals") <= most)
    o, t = F.col("ou"), F.col("total")
    out = rows.agg(count_of(t.isNotNull()).alias("n"), *[count_of(o == x).alias(x) for x in ("over", "under", "push")], count_of(t.isNull()).alias("no_odds"))
    return out.withColumns({f"{x}_pct": pct(F.col(x), F.col("n")) for x in ("over", "under", "push")})


def ou_samples(m: DataFrame, k: int = 10, league: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """The newest ``k`` rows with a line, of the league and goal range, as the probability report shows them."""
    rows = decided(m) if league is None else decided(m).where(F.col("league") == league)
    rows = rows if least is None else rows.where(F.col("goals") >= least)
    rows = (rows if most is None else rows.where(F.col("goals") <= most)).where("total IS NOT NULL").select("match_id", "league", "match_time", "home_team", "away_team", "goals", "total", "ou")
    return rows.orderBy(F.desc_nulls_last("match_time"), F.desc("match_id")).limit(k)


def ou_by_initial_line(m: DataFrame) -> DataFrame:
    """By league and the initial total alone."""
    line = first_present(F.col("ou_initial_total")).try_cast("double")
    rows = decided(m).withColumn("line0", line).where("line0 IS NOT NULL")
    rows = rows.withColumn("ou", _sign(F.col("goals").cast("double") - F.col("line0"), "over", "push", "under"))
    return ou_shares(rows, "league", F.col("line0").alias("line_value"))


def results_by_league(m: DataFrame) -> DataFrame:
    return by_result(decided(m), F.col("league"))


def ou_stats_by_league_line(m: DataFrame) -> DataFrame:
    return ou_shares(decided(m).where("total IS NOT NULL"), "league", F.col("total").alias("line_value"))


def is_level(strict: bool = False) -> Column:
    bare = F.replace(F.nullif(F.col("line_text"), F.lit("")), F.lit("受"), F.lit(""))
    return F.coalesce(bare.isin(*(STRICT_TEXTS if strict else LEVEL_TEXTS)), F.lit(False))


def level(m: DataFrame) -> DataFrame:
    return decided(m).where(is_level())


def _suggest(out: DataFrame) -> DataFrame:
    s = F.when(F.col("home_pct") > 45, "home").when(F.col("away_pct") > 45, "away").when(F.col("draw_pct") > 30, "draw").otherwise("even")
    return out.withColumn("suggestion", s)


def level_ball_results(m: DataFrame, least: int = 10, least_strict: int = 5) -> DataFrame:
    """Level and strictly level matches; a report needs ``least`` rows, its strict part ``least_strict``."""
    kinds = F.explode(F.array_compact(F.array(F.lit("level"), F.when(is_level(strict=True), "strict"))))
    out = by_result(level(m).select("*", kinds.alias("kind")), F.col("kind"))
    return out.where((F.col("n") >= least) | ((F.col("grp") == "strict") & (F.col("n") >= least_strict)))


def level_water_levels(m: DataFrame) -> DataFrame:
    return _suggest(by_result(level(m), bucket(nonzero(F.col("hw")), LEVEL_CUTS, LEVEL_REST)))


def level_water_changes(m: DataFrame) -> DataFrame:
    return _suggest(by_result(level(m), bucket(nonzero(F.col("hw1")) - nonzero(F.col("hw0")), WATER_CUTS, LEVEL_WATER_REST)))


def level_euro_odds(m: DataFrame) -> DataFrame:
    """By home odds and by draw odds in one pass; stars for draw groups."""
    groups = F.array_compact(F.array(bucket(nonzero(F.col("win")), WIN_CUTS, WIN_REST), bucket(nonzero(F.col("draw")), DRAW_CUTS, DRAW_REST)))
    out = by_result(level(m).select("result", "cover", F.explode(groups).alias("g")), F.col("g"))
    stars = F.when(F.col("draw_pct") > 35, 3).when(F.col("draw_pct") > 28, 2).when(F.col("draw_pct") > 22, 1).otherwise(0)
    return out.withColumn("stars", F.when(F.col("grp").startswith("平局"), stars))


def level_by_league(m: DataFrame, least: int = 5) -> DataFrame:
    out = by_result(level(m), F.coalesce("league", F.lit("未知"))).where(F.col("n") >= least)
    feature = F.when(F.col("home_pct") > 45, "home").when(F.col("away_pct") > 45, "away").when(F.col("draw_pct") > 35, "draw")
    return out.withColumn("feature", feature)


def level_over_under(m: DataFrame) -> DataFrame:
    o, t = F.col("ou"), nonzero(F.col("total"))
    out = level(m).agg(F.count("*").alias("matches"), F.avg("goals").alias("mean_goals"), count_of(t.isNotNull()).alias("n"), *[count_of((o == x) & t.isNotNull()).alias(x) for x in ("over", "under", "push")])
    return out.withColumns({f"{x}_pct": pct(F.col(x), F.col("n")) for x in ("over", "under", "push")})


def level_goal_histogram(m: DataFrame) -> DataFrame:
    return goal_histogram(m.where(is_level()))


def movement_rows(m: DataFrame, league: str | None = None) -> DataFrame:
    """Decided matches with both lines and home odds: category of line and water movement, changes, cover; others drop out."""
    m = m if league is None else m.where(F.col("league") == league)
    line0, line1 = (parse_handicap(F.col(f"asian_{w}_handicap")) for w in ("initial", "current"))
    rows = decided(m).withColumns({"line0": line0, "line1": line1}).withColumns({"dh": F.col("line1") - F.col("line0"), "dw": F.col("hw1") - F.col("hw0")}).where("dh IS NOT NULL AND dw IS NOT NULL")
    dh, dw = F.col("dh"), F.col("dw")
    still = (F.abs(dh) < 0.01) & (F.abs(dw) < 0.01)
    kind = F.when(still, "无变化").when((dh > 0) & (dw < 0), "升盘降水").when((dh > 0) & (dw > 0), "升盘升水").when((dh < 0) & (dw > 0), "降盘升水").when(dw < 0, "降盘降水").otherwise("降盘升水")
    won = _sign(F.col("h") + F.col("line1") - F.col("a"), "home", "push", "away")
    return rows.select("match_id", "league", "match_time", "home_team", "away_team", F.concat_ws("-", "h", "a").alias("score"), "line0", "line1", F.col("hw0").alias("water0"), F.col("hw1").alias("water1"), "dh", "dw", kind.alias("kind"), won.alias("won"))


def movement_categories(m: DataFrame, league: str | None = None) -> DataFrame:
    """Five categories of line and water movement with cover counts."""
    won = F.col("won")
    out = movement_rows(m, league).groupBy(F.col("kind").alias("grp")).agg(F.count("*").alias("n"), *[count_of(won == x).alias(f"cover_{x}") for x in ("home", "away", "push")])
    return out.withColumn("win_pct", pct(F.col("cover_home"), F.col("n")))
