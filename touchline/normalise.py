"""The typed view of matches: every text is parsed once, here, and all analyses read the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import asian_label, asian_result, first_present, match_result, ou_result, parse_handicap, safe_double, score_int
from .store import children, exists, remove, split_code, written

PAIRS = {
    "win": "euro_{}_win", "draw": "euro_{}_draw", "lose": "euro_{}_lose", "hw": "asian_{}_home_odds", "aw": "asian_{}_away_odds",
    "over": "ou_{}_over_odds", "under": "ou_{}_under_odds", "hh": "hi_{}_home_odds", "hd": "hi_{}_draw_odds", "ha": "hi_{}_away_odds",
}


def typed(matches: DataFrame) -> DataFrame:
    """``matches`` with typed columns beside the texts.

    h, a, goals, result; for each odds pair x: x0 (initial), x1 (current), x (current, else initial, as texts fall back);
    line_text and line (pattern dialect), cover; total and ou; label (recomputed) and index_line.
    """
    c = F.col
    first = {}
    for name, pattern in PAIRS.items():
        start, now = c(pattern.format("initial")), c(pattern.format("current"))
        first |= {f"{name}0": safe_double(start), f"{name}1": safe_double(now), name: safe_double(first_present(now, start))}
    first |= {"h": score_int(c("home_score")), "a": score_int(c("away_score")), "line_text": first_present(c("asian_current_handicap"), c("asian_initial_handicap"))}
    first |= {"total": safe_double(first_present(c("ou_current_total"), c("ou_initial_total"))), "index_line": safe_double(first_present(c("hi_handicap_value")))}
    m = matches.withColumns(first)
    label = asian_label(c("asian_initial_handicap"), c("asian_current_handicap"), c("asian_initial_home_odds"), c("asian_current_home_odds"))
    return m.withColumns({
        "goals": c("h") + c("a"), "result": match_result(c("h"), c("a")), "line": parse_handicap(c("line_text"), "pattern"),
        "cover": asian_result(c("h"), c("a"), c("line_text")), "ou": ou_result(c("h"), c("a"), c("total")), "label": label,
    })


def write_view(matches: DataFrame, path: str, daily: bool = False, mode: str = "overwrite", laid_out: bool = False) -> DataFrame:
    """The typed view as Parquet, read back: every later analysis reads typed columns and skips row groups by owner_date and status.

    Rows are laid out by owner_date, which gives each file a narrow range of days; they are dealt out as texts, so that the
    sample that the range needs parses nothing; ``laid_out`` says that they already are, with status first within a partition.
    ``daily`` makes a folder for each day, which large tables want; a later run replaces the folders of its own days only.
    """
    with split_code(matches.sparkSession):
        if daily:
            # a day of very many matches is dealt out to several tasks and files
            t = typed(matches.hint("rebalance", "owner_date")).sortWithinPartitions("owner_date", "status")
            t.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("owner_date").parquet(path)
        else:
            # ordered as texts, so that the sort does not carry the parsed columns
            rows = matches if laid_out else matches.repartitionByRange("owner_date").sortWithinPartitions("status", "owner_date", "match_id")
            typed(rows).write.mode(mode).parquet(path)
    return matches.sparkSession.read.parquet(path)


def refresh_view(matches: DataFrame, path: str) -> list[str]:
    """Brings the daily view below ``path`` up to date with ``matches``: only days that have changed are parsed and written; gives these days.

    A day is told by the number of its rows and the sum of their hashes, kept in a table beside the view; days that are gone
    lose their folder. A run that fails leaves the old sums, so the next one does its days again. A null day has a folder too.
    """
    spark = matches.sparkSession
    day = F.coalesce("owner_date", F.lit(""))
    sums = matches.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*matches.columns).cast("decimal(38,0)")).alias("hash"))
    sums = written(sums, "view-days")
    known = f"{path}/_days"
    versions = sorted(x for x in children(spark, known) if x.startswith("version=")) if exists(spark, known) else []
    before = spark.read.parquet(f"{known}/{versions[-1]}") if versions else sums.limit(0)
    changed = sums.alias("a").join(before.alias("b"), "day", "full").where("NOT (a.n <=> b.n AND a.hash <=> b.hash)").select("day", F.col("a.n").isNull().alias("gone"))
    rows = sorted((r["day"], r["gone"]) for r in changed.collect())  # as many as there are days that have changed
    days, gone = [d for d, g in rows if not g], [d for d, g in rows if g]
    if days:
        write_view(matches.where(day.isin(days)), f"{path}/matches", daily=True)
    if gone:
        remove(spark, *[f"{path}/matches/owner_date={d or '__HIVE_DEFAULT_PARTITION__'}" for d in gone])
    if rows:
        sums.write.mode("overwrite").parquet(f"{known}/version={len(versions):08d}")
    return [d for d, _ in rows]


def refreshed(spark: SparkSession, path: str) -> DataFrame:
    """The view that ``refresh_view`` keeps; a day is text, as in the matches."""
    t = spark.read.option("basePath", f"{path}/matches").parquet(f"{path}/matches")
    return t.withColumn("owner_date", F.col("owner_date").cast("string"))
