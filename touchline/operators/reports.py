"""Reports: several analyses of one written typed view, as separate tables or as one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import leagues, results

PATTERNS = {
    "label": results.movement_label_results, "euro": results.euro_movement_results, "line": results.handicap_size_results, "water": results.water_change_results,
    "total": results.ou_pattern, "goals": results.goal_histogram, "index": results.handicap_index_results,
}
LEVEL = {
    "results": results.level_ball_results, "water": results.level_water_levels, "water_change": results.level_water_changes, "euro": results.level_euro_odds,
    "league": results.level_by_league, "over_under": results.level_over_under, "goals": results.level_goal_histogram,
}
#: Fewer finished matches than this make a pattern report unsound.
SOUND = 10


def pattern_report(m: DataFrame) -> dict[str, DataFrame]:
    """The analyses of line, odds and goals; "size" has one row: finished matches, decided ones, and whether they are enough."""
    size = results.finished(m).agg(F.count("*").alias("finished"), F.count("result").alias("decided")).withColumn("sound", F.col("decided") >= SOUND)
    return {"size": size} | {k: f(m) for k, f in PATTERNS.items()}


def league_report(m: DataFrame, **options) -> dict[str, DataFrame]:
    return {"profile": leagues.league_profile(m, **options), "tags": leagues.league_comparison_tags(m, **options), "best": leagues.best_league_per_metric(m, **options)}


def level_report(m: DataFrame) -> dict[str, DataFrame]:
    return {k: f(m) for k, f in LEVEL.items()}


def lower_plate_report(m: DataFrame, mode: str = "history", league: str = "", least: float | None = None) -> dict[str, DataFrame]:
    """Upcoming chances, or past wins with their rate; the table of leagues always covers all of them."""
    if mode == "upcoming":
        return {"rows": leagues.lower_plate_upcoming(m, least or 3.0, league)}
    return {"rows": leagues.lower_plate_history(m, league, least), "rate": leagues.lower_plate_rate(m, least, league), "leagues": leagues.lower_plate_league_rate(m)}


def long_form(report: dict[str, DataFrame], keys: dict[str, str], measures: dict[str, list[str]]) -> DataFrame:
    """(section, grp, measure, value) of the sections named in ``keys``: the key column's text and each measure as a double."""
    out = None
    for section, key in keys.items():
        d = report[section]
        values = F.explode(F.array(*[F.struct(F.lit(x).alias("measure"), F.col(x).cast("double").alias("value")) for x in measures[section]]))
        rows = d.select(F.lit(section).alias("section"), (F.col(key).cast("string") if key else F.lit("")).alias("grp"), values.alias("x")).select("section", "grp", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out
