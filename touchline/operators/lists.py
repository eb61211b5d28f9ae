"""Match lists: filters, sorts, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import first_present, match_time


def list_matches(m: DataFrame, day: str | None = None, start: str | None = None, end: str | None = None, league: str | None = None, status: int | None = None, today: str | None = None) -> DataFrame:
    """By owner_date or a range of it, league and status. Status 0 also gives rescheduled rows; without a status, and for no day or today, only open ones."""
    if start and end:
        m = m.where(F.col("owner_date").between(start, end))
    elif day:
        m = m.where(F.col("owner_date") == day)
    m = m.where(F.col("league") == league) if league else m
    if status is not None:
        return m.where(F.col("status").isin(0, 6) if status == 0 else F.col("status") == status)
    return m.where(F.col("status").isin(0, 6)) if not start and (not day or day == today) else m


def page(m: DataFrame, number: int = 1, size: int = 50, year: int | None = None) -> DataFrame:
    """One page by match time, unparsable times last, with the number of pages; times without a year are of ``year``, else of the current one."""
    size, number = max(1, min(200, size)), max(1, number)
    rows = m.withColumn("starts_at", match_time(F.col("match_time"), None if year is None else F.lit(year))).orderBy(F.asc_nulls_last("starts_at"), "match_id").offset((number - 1) * size).limit(size)
    total = F.broadcast(m.agg(F.count("*").alias("all_n")))  # one row
    return rows.crossJoin(total).select("match_id", "match_time", "league", "status", "starts_at", F.col("all_n").alias("total"), F.expr(f"int((all_n + {size - 1}) div {size})").alias("pages"))


def get_matches(m: DataFrame, limit: int | None = 100, sort: str = "match_time", descending: bool = True, between: dict[str, tuple] | None = None, columns: list[str] | None = None, **equal) -> DataFrame:
    """Rows by equality (None: null) and inclusive range filters, by ``sort``, nulls last, ties by match_id; ``columns`` None: all."""
    for k, v in equal.items():
        m = m.where(F.col(k).isNull() if v is None else F.col(k) == v)
    for k, (low, high) in (between or {}).items():
        m = m.where(F.col(k).between(low, high))
    order = [F.desc_nulls_last(sort), F.desc("match_id")] if descending else [F.asc_nulls_last(sort), F.asc("match_id")]
    m = m.orderBy(*order)
    m = m if limit is None else m.limit(limit)
    return m.select(*columns) if columns else m


def by_id(df: DataFrame, match_id: str) -> DataFrame:
    """The rows of one match; works on matches and on odds documents alike."""
    return df.where(F.col("match_id") == match_id)


def by_ids(df: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of the matches that ``asked`` (match_id) names."""
    return df.join(asked.select("match_id").distinct(), "match_id", "left_semi")


def row_json(df: DataFrame, key: str = "match_id") -> DataFrame:
    """(key, json) of every row with all its columns; times in ISO form, nulls kept."""
    times = {f.name: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss") for f in df.schema if f.dataType.typeName() in ("timestamp", "timestamp_ntz")}
    shown = df.withColumns(times) if times else df
    return shown.select(key, F.to_json(F.struct(*shown.columns), {"ignoreNullFields": "false"}).alias("json"))


def predictions_list(p: DataFrame, is_reviewed: bool | None = None, limit: int = 50) -> DataFrame:
    """The newest predictions, reviewed ones or others if asked for; 1 to 200 of them."""
    p = p if is_reviewed is None else p.where(F.col("is_reviewed") == is_reviewed)
    return p.orderBy(F.desc_nulls_last("predict_date"), "match_id").limit(max(1, min(200, limit)))


def picks_of(picks: DataFrame, device: str, limit: int | None = None) -> DataFrame:
    """A device's picks, the newest first."""
    rows = picks.where(F.col("device_id") == device).orderBy(F.desc_nulls_last("created_at"), "match_id")
    return rows if limit is None else rows.limit(limit)


def bets_of(bets: DataFrame, device: str, status: str | None = None, limit: int | None = 100) -> DataFrame:
    """A device's bets, of one status if asked for, the newest first."""
    rows = bets.where(F.col("device_id") == device)
    rows = (rows if status is None else rows.where(F.col("status") == status)).orderBy(F.desc_nulls_last("created_at"), "bet_id")
    return rows if limit is None else rows.limit(limit)


def odds_needed(m: DataFrame) -> DataFrame:
    """Matches whose odds still change: not started or live."""
    return m.where(F.col("status").isin(0, 1))


def high_odds(m: DataFrame, least: float = 3.0) -> DataFrame:
    """Matches whose current home odds are at least ``least``; texts that are no number drop out."""
    return m.where(F.col("win1") >= least).select("match_id", "league", F.col("win1").alias("win_odds"))


def goal_range(m: DataFrame, least: int = 2, most: int = 3) -> DataFrame:
    return m.where("status = 2").where(F.col("goals").between(least, most)).select("match_id", "league", "goals")


def movement_eligible(m: DataFrame) -> DataFrame:
    six = [F.nullif(f"euro_{w}_{p}", F.lit("")).isNotNull() for w in ("initial", "current") for p in ("win", "draw", "lose")]
    euro = six[0]
    for t in six[1:]:
        euro = euro & t
    lines = first_present(F.col("asian_initial_handicap")).isNotNull() & first_present(F.col("asian_current_handicap")).isNotNull()
    return m.where(euro | lines).select("match_id", euro.alias("euro"), lines.alias("asian"))


def value_counts(m: DataFrame, top: int = 10) -> DataFrame:
    """Rows of the ``top`` leagues, ties by name, and of each status; absent leagues are left out, an absent status is 未开始."""
    n = F.count("*").alias("n")
    leagues = m.where("nullif(league, '') IS NOT NULL").groupBy(F.lit("league").alias("field"), F.col("league").alias("value")).agg(n).orderBy(F.desc("n"), "value").limit(top)
    return leagues.unionByName(m.groupBy(F.lit("status").alias("field"), F.coalesce(F.col("status").cast("string"), F.lit("未开始")).alias("value")).agg(n))


def notification_text(m: DataFrame) -> DataFrame:
    """The four markets of a match as one text of four lines, initial and current; what is absent is empty. Over/under shows under first."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    side = lambda market, when, parts: F.concat_ws("/", *[text(f"{market}_{when}_{p}") for p in parts])
    both = lambda head, market, *parts: F.concat(head, F.lit("初:"), side(market, "initial", parts), F.lit(" 即:"), side(market, "current", parts))
    lines = [
        both(F.lit("欧赔 "), "euro", "win", "draw", "lose"),
        both(F.lit("亚盘 "), "asian", "home_odds", "handicap", "away_odds"),
        both(F.lit("大小球 "), "ou", "under_odds", "total", "over_odds"),
        both(F.concat(F.lit("让球指数 盘:"), text("hi_handicap_value"), F.lit(" ")), "hi", "home_odds", "draw_odds", "away_odds"),
    ]
    return m.select("match_id", F.concat_ws("\n", *lines).alias("body"))
