"""Feeds and archived pages to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_rank, match_number, match_status, normal_date, normal_time

#: The feed's field names and ours.
FIELDS = {
    "fid": "match_id", "order": "match_number", "simpleleague": "league", "matchround": "round", "matchtime": "match_time", "status": "status", "status_desc": "status_text", "homescore": "home_score",
    "awayscore": "away_score", "homesxname": "home_team", "homestanding": "home_rank", "awaysxname": "away_team", "awaystanding": "away_rank", "rangqiu": "handicap", "ownerdate": "owner_date",
}


def parse_match_feed(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON documents with data.matches[] to match rows; a score stands only for matches begun with both scores there."""
    shape = f"struct<data: struct<matches: array<struct<{', '.join(f'`{k}`: string' for k in FIELDS)}>>>>"
    m = raw.select(F.explode(F.from_json(column, shape)["data"]["matches"]).alias("m")).select(*[F.col(f"m.{k}").alias(v) for k, v in FIELDS.items()])
    status = match_status(F.col("status"), F.coalesce("status_text", F.lit("")))
    m = m.withColumns({"status": status, "match_time": normal_time(F.col("match_time")), "owner_date": normal_date(F.col("owner_date")), "round_id": F.col("match_number")})
    both = (F.col("status") != 0) & F.nullif("home_score", F.lit("")).isNotNull() & F.nullif("away_score", F.lit("")).isNotNull()
    return m.withColumn("score", F.when(both, F.concat("home_score", F.lit("-"), "away_score")).otherwise("-"))


def parse_odds_feed_xml(raw: DataFrame, column: str = "value") -> DataFrame:
    """XML documents of <m matchnum> with <row win draw lost>: the first row is current, the last one initial."""
    shape = "m array<struct<_matchnum: string, row: array<struct<_win: string, _draw: string, _lost: string, _updatetime: string>>>>"
    m = raw.select(F.explode(F.from_xml(column, shape)["m"]).alias("m")).where(F.size("m.row") > 0)
    now, first = F.element_at("m.row", 1), F.element_at("m.row", -1)
    names = {"win": "_win", "draw": "_draw", "lose": "_lost"}
    return m.select(F.col("m._matchnum").alias("matchnum"), *[now[v].alias(f"current_{k}") for k, v in names.items()], *[first[v].alias(f"initial_{k}") for k, v in names.items()], F.concat_ws("/", *[F.coalesce(now[v], F.lit("")) for v in names.values()]).alias("currodds"), now["_updatetime"].alias("update_time"), F.size("m.row").alias("ticks"))


def odds_ticks(raw: DataFrame, column: str = "value") -> DataFrame:
    """Every row of every <m matchnum> of XML odds documents: its place (0 is current, the last one initial), of how many, its odds and time.

    The same on a stream of landed documents; ``raw``'s other columns go along.
    """
    shape = "m array<struct<_matchnum: string, row: array<struct<_win: string, _draw: string, _lost: string, _updatetime: string>>>>"
    rest = [c for c in raw.columns if c != column]
    m = raw.select(*rest, F.explode(F.from_xml(column, shape)["m"]).alias("m"))
    t = m.select(*rest, F.col("m._matchnum").alias("matchnum"), F.size("m.row").alias("ticks"), F.posexplode("m.row").alias("pos", "r"))
    return t.select(*rest, "matchnum", "pos", "ticks", F.col("r._win").alias("win"), F.col("r._draw").alias("draw"), F.col("r._lost").alias("lose"), F.col("r._updatetime").alias("update_time"))


def number_day(text: Column, since: Column) -> Column:
    """The day that a match number speaks of: the first one of its weekday on or after ``since``; null for other numbers."""
    number = match_number(text)
    return F.when(number.isNotNull(), F.date_add(since, F.pmod(F.substring(number, 1, 1).cast("int") - 1 - F.weekday(since), F.lit(7))))


def join_feeds_by_day(matches: DataFrame, handicap: DataFrame, euro: DataFrame, day_begins: int = 11) -> DataFrame:
    """Matches with the newest snapshot of both odds feeds for their number and day; unmatched rows stay, and each match once.

    Numbers come again every week. A match's day is the first one of its number's weekday from owner_date on; a snapshot, taken
    at ``seen_at``, speaks of the first such day from its own business day on, which begins at ``day_begins`` o'clock. So both
    sides have an exact key, and of the snapshots of a key the newest is taken before the join.
    """
    m = matches.withColumns({"matchnum": match_number(F.col("match_number")), "__day": number_day(F.col("match_number"), F.col("owner_date").try_cast("date"))})
    for feed, p in ((handicap, "hi"), (euro, "euro")):
        day = F.to_date(F.col("seen_at") - F.make_interval(hours=F.lit(day_begins)))
        weekday = F.substring("matchnum", 1, 1).try_cast("int")
        columns = [c for c in feed.columns if c != "matchnum"]
        f = feed.withColumn("__day", F.date_add(day, F.pmod(weekday - 1 - F.weekday(day), F.lit(7))))
        f = f.groupBy("matchnum", "__day").agg(F.max_by(F.struct(*columns), F.struct("seen_at", F.to_json(F.struct(*columns)))).alias("r"))
        m = m.join(f.select("matchnum", "__day", *[F.col(f"r.{c}").alias(f"{p}_{c}") for c in columns]), ["matchnum", "__day"], "left")
    return m.drop("__day")


def join_feeds(matches: DataFrame, handicap: DataFrame, euro: DataFrame) -> DataFrame:
    """Matches with both odds feeds by translated match number; unmatched rows stay."""
    m = matches.withColumn("matchnum", match_number(F.col("match_number")))
    tag = lambda d, p: d.select("matchnum", *[F.col(c).alias(f"{p}_{c}") for c in d.columns if c != "matchnum"])
    return m.join(tag(handicap, "hi"), "matchnum", "left").join(tag(euro, "euro"), "matchnum", "left")


def decoded(raw: Column) -> Column:
    """Page bytes as text, by the charset that the page names in its head, else UTF-8; bad bytes are replaced.

    Spark's ``decode`` knows no national charsets; the bytes go through Java's decoder as percent escapes, but for valid UTF-8.
    """
    head = F.lower(F.reflect(F.lit("java.net.URLDecoder"), F.lit("decode"), _escaped(F.substring(raw, 1, 2048)), F.lit("ISO-8859-1")))
    named = F.regexp_extract(head, r"charset=[\"']?([a-z0-9_-]+)", 1)
    charset = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CHARSETS.items() for x in pair]), named), F.lit("UTF-8"))
    whole = F.reflect(F.lit("java.net.URLDecoder"), F.lit("decode"), _escaped(raw), charset)
    text = raw.cast("string")
    return F.when(raw.isNotNull(), F.when((charset == "UTF-8") & F.is_valid_utf8(text), text).otherwise(whole))


def _escaped(raw: Column) -> Column:
    return F.regexp_replace(F.hex(raw), "(..)", "%$1")


#: Names of charsets in pages and Java's; the older Chinese ones are read as the one that holds them.
CHARSETS = {"gb2312": "GB18030", "gbk": "GB18030", "gb-2312": "GB18030", "gb18030": "GB18030", "big5": "Big5", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "windows-1252": "windows-1252", "shift_jis": "Shift_JIS", "euc-kr": "EUC-KR"}
#: The entities that stand in cells.
ENTITIES = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&uarr;": "\u2191", "&darr;": "\u2193", "&amp;": "&"}


def _plain(html: Column) -> Column:
    """The text of a piece of HTML: no tags, entities resolved, odds arrows taken off, white space as single blanks."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = F.translate(text, "\u2191\u2193", "")
    return F.regexp_replace(F.regexp_replace(text, r"[\s\u00a0]+", " "), "^ | $", "")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute of the tag that a piece begins with, or ''."""
    opening = F.regexp_extract(tag, r"(?s)^<[^>]*", 0)
    return F.regexp_replace(F.regexp_extract(opening, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), r"""^["']|["']$""", "")


def table_rows(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """(id, row, table, kind, fid, cells, classes, links, grey) of every table row of archived pages, texts or bytes.

    Column expressions only: a page is split before its table, row and cell tags, scripts and comments are left out, and arrows
    of odds cells are stripped. ``table`` is the id of the table, ``kind`` the class of the row; ``links`` and ``grey`` hold the
    texts of a cell's links and grey spans. A null page has no rows.
    """
    page = decoded(F.col(html)) if dict(pages.dtypes)[html] == "binary" else F.col(html)
    page = F.regexp_replace(page, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    begins = lambda x, tags: x.rlike(rf"(?i)^<({tags})\b")
    inner = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?s)^<[^>]*>", ""), r"(?is)</(td|th|tr|table)\b.*$", "")
    texts = lambda x, pattern: F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), _plain)
    grey = r"""(?is)<span\b[^>]*class\s*=\s*["'](?:[^"']*\s)?gray(?:\s[^"']*)?["'][^>]*>(.*?)</span>"""

    def cells(row):
        found = F.filter(F.split(row, r"(?i)(?=<t[dh]\b)", -1), lambda x: begins(x, "td|th"))
        found = F.transform(found, lambda c: F.struct(c.alias("all"), inner(c).alias("in")))
        return F.transform(found, lambda c: F.struct(_plain(c["in"]).alias("text"), _attribute(c["all"], "class").alias("kind"), texts(c["in"], r"(?is)<a\b[^>]*>(.*?)</a>").alias("links"), texts(c["in"], grey).alias("grey")))

    def table(piece):
        # the name is taken once: within the rows' own expression each row would read the whole piece for it
        name = F.when(begins(piece, "table"), _attribute(piece, "id")).otherwise("")
        return F.struct(name.alias("name"), F.filter(F.split(piece, r"(?i)(?=<tr\b)", -1), lambda x: begins(x, "tr")).alias("rows"))

    def rows(t):
        return F.transform(t["rows"], lambda r: F.struct(t["name"].alias("table"), _attribute(r, "class").alias("kind"), _attribute(r, "fid").alias("fid"), cells(r).alias("c")))

    found = F.flatten(F.transform(F.transform(F.split(page, r"(?i)(?=<table\b)", -1), table), rows))
    r = pages.select(F.col(id_column).cast("long").alias("id"), F.posexplode(found).alias("row", "r"))
    each = {"cells": "text", "classes": "kind", "links": "links", "grey": "grey"}
    return r.select("id", "row", "r.table", "r.kind", "r.fid", *[F.col(f"r.c.{v}").alias(k) for k, v in each.items()])


def table_cells(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    return table_rows(pages, id_column, html).select("id", "row", "cells")


def _at(name: str, i: int) -> Column:
    return F.coalesce(F.try_element_at(name, F.lit(i + 1)), F.lit(""))


def page_status(text: Column, kind: Column) -> Column:
    """0, 1 or 2 by the cell's class, else by its words: finished, a minute or a pause, else not started."""
    live = text.rlike("^[0-9]+'?$|^[0-9]+\\+[0-9]+'?$|中场|半场|加时|点球")
    return F.when(F.contains(kind, F.lit("td_living")), 1).when(text.rlike("完|结束"), 2).when(live, 1).otherwise(0)


def list_page_matches(rows: DataFrame) -> DataFrame:
    """Match rows of archived list pages: ten cells a row on pages of finished matches, fourteen on others.

    Team names are the first link of their cells, ranks the digits of the grey text; the seventh cell's three links are home
    score, line and away score, also on the ten-cell layout, where that cell is the away team's, so such rows have no score.
    Rows without a match number or with fewer cells are left out.
    """
    r = rows.where("nullif(fid, '') IS NOT NULL AND size(cells) >= 10")
    ten = F.size("cells") == 10
    cell = lambda finished, other: F.when(ten, _at("cells", finished)).otherwise(_at("cells", other))
    part = lambda name, finished, other: F.coalesce(F.try_element_at(F.when(ten, F.try_element_at(name, F.lit(finished + 1))).otherwise(F.try_element_at(name, F.lit(other + 1))), F.lit(1)), F.lit(""))
    links = F.try_element_at("links", F.lit(7))
    score = lambda i: F.when(~ten & (F.size(links) >= 3), F.coalesce(F.try_element_at(links, F.lit(i)), F.lit(""))).otherwise("")
    out = {
        "match_id": F.col("fid"), "match_number": F.when(ten, "").otherwise(_at("cells", 0)), "league": cell(0, 1), "round": cell(1, 2), "match_time": cell(2, 3), "status_text": cell(3, 4),
        "status": page_status(cell(3, 4), F.when(ten, _at("classes", 3)).otherwise(_at("classes", 4))), "home_team": part("links", 4, 5), "away_team": part("links", 6, 7),
        "home_rank": clean_rank(part("grey", 4, 5)), "away_rank": clean_rank(part("grey", 6, 7)), "home_score": score(1), "handicap": score(2), "away_score": score(3),
    }
    return r.select("id", "row", *[v.alias(k) for k, v in out.items()])


#: Cells of a market's row: (least cells, name -> cell).
LAYOUT = {
    "euro": (9, {"initial_win": 3, "initial_draw": 4, "initial_lose": 5, "current_win": 6, "current_draw": 7, "current_lose": 8}),
    "asian": (12, {"current_home_odds": 3, "current_handicap": 4, "current_away_odds": 5, "initial_home_odds": 9, "initial_handicap": 10, "initial_away_odds": 11}),
    "ou": (12, {"current_over_odds": 3, "current_total": 4, "current_under_odds": 5, "initial_over_odds": 9, "initial_total": 10, "initial_under_odds": 11}),
    "index": (10, {"handicap_value": 2, "initial_home_odds": 4, "initial_draw_odds": 5, "initial_away_odds": 6, "current_home_odds": 7, "current_draw_odds": 8, "current_away_odds": 9}),
}


def market_rows(rows: DataFrame, market: str, hints: DataFrame | None = None) -> DataFrame:
    """(match_id, odds of the market) of archived market pages, whose page id is the match's: the preferred row of the odds table.

    Pages whose preferred row has too few cells or lacks a current value give nothing. ``hints`` (match_id, hint) are the
    Asian lines that tell several index rows apart.
    """
    least, cells = LAYOUT[market]
    table = rows.where("table = 'datatb' AND size(cells) > 0").select(F.col("id").alias("match_id"), F.col("row").alias("pos"), F.concat_ws("", "cells").alias("company"), "kind", "cells")
    if hints is not None:
        table = table.join(hints.select("match_id", "hint"), "match_id", "left")
    best = preferred_source(table, market).where(F.size("cells") >= least)
    out = best.select("match_id", *[_at("cells", i).alias(name) for name, i in cells.items()])
    for name in [n for n in cells if n.startswith("current") or n == "handicap_value"]:
        out = out.where(F.col(name) != "")
    return out


def preferred_source(rows: DataFrame, market: str) -> DataFrame:
    """Of the company rows (match_id, pos, company, ...) of a match the one that the market prefers.

    euro: the official row, which bears both official marks, else the known house, else the first; asian: the house, else the
    first; ou: the first; index: official rows only, and of several the one whose line (``cells``) is nearest to ``hint``, else
    the last. "First" is the first row of kind tr1 where rows have a kind.
    """
    c = F.col("company")
    official, known = F.contains(c, F.lit("竞*官*")) & F.contains(c, F.lit("竞*官*(中国)")), F.contains(c, F.lit("t3*5"))
    starred = F.contains(c, F.lit("**t3*5"))
    plain = F.array_contains(F.split("kind", " "), "tr1") if "kind" in rows.columns else F.lit(True)
    rank = {"euro": F.when(official, 0).when(known, 1).when(plain, 2), "asian": F.when(starred, 0).when(plain, 1), "ou": F.when(plain, 0), "index": F.when(official, 0)}[market]
    best = rows.withColumn("rank", rank).where("rank IS NOT NULL").drop("rank") if market == "index" else rows.withColumn("rank", rank).where("rank IS NOT NULL")
    if market == "index":
        hint = F.col("hint") if "hint" in rows.columns else F.lit(None).cast("double")
        line = _at("cells", 2) if "cells" in rows.columns else F.lit(None).cast("string")
        return nearest_line(best.withColumns({"__line": line, "__hint": hint}), "__line", "__hint").drop("__line", "__hint")
    return best.groupBy("match_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "match_id"]), F.struct("rank", "pos")).alias("r")).select("match_id", "r.*")


def nearest_line(rows: DataFrame, line: str = "line_text", hint: str = "hint") -> DataFrame:
    """Of the rows (match_id, pos, line text, hint, ...) of a match the one whose line is nearest to the hint, the first on ties.

    Lines of the hint's sign compete, and zero for hints below a quarter; where none does, or there is no hint, the last row
    is taken. One aggregation by match, which combines before its shuffle.
    """
    v, h = F.col(line).try_cast("double"), F.col(hint)
    fits = F.coalesce(((v > 0) & (h > 0)) | ((v < 0) & (h < 0)) | ((v == 0) & (F.abs(h) < 0.25)), F.lit(False))
    rank = F.when(fits, F.struct(F.lit(0).alias("a"), F.abs(v - h).alias("b"), F.col("pos").alias("c"))).otherwise(F.struct(F.lit(1).alias("a"), F.lit(0.0).alias("b"), (-F.col("pos")).alias("c")))
    rest = [c for c in rows.columns if c != "match_id"]
    return rows.groupBy("match_id").agg(F.min_by(F.struct(*rest), rank).alias("r")).select("match_id", "r.*")
