"""The newest matches of every team as a table that each batch of results brings up to date.

A batch touches only the buckets of its teams: their kept rows and the batch's are merged, and of each team the newest few stay.
So the work of a batch goes with the teams that it names, not with the history behind them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.teams import form_of_rows, form_rows
from ..store import written
from .versions import bucket_of, current, put

#: Rows kept beyond those that the form looks at, so that some may be withdrawn by later corrections.
SPARE = 10
ROWS = "team string, match_id string, match_time string, goals int, total double, gf int, ga int, outcome string"


def update(spark: SparkSession, table: str, m: DataFrame, epoch: int, n: int = 10) -> None:
    """Merges typed matches, as a batch brings them, into the table; the same batch again changes nothing.

    Finished matches count. A match that comes again replaces its rows, and takes them away if it is not finished any more; of
    a team the newest ``n + SPARE`` rows stay, so the form holds as long as no more than SPARE of them are taken away.
    """
    teams = m.select(F.explode(F.array("home_team", "away_team")).alias("team")).where("team IS NOT NULL")
    touched = [r["b"] for r in teams.select(bucket_of("team").alias("b")).distinct().collect()]  # at most as many as there are buckets
    rows = form_rows(m).where("team IS NOT NULL")
    known = current(spark, table, before=epoch, buckets=touched, schema=ROWS)
    if known is not None:
        rows = rows.unionByName(known.join(m.select("match_id").distinct(), "match_id", "left_anti"))
    newest = Window.partitionBy("team").orderBy(F.desc_nulls_last("match_time"), F.desc("match_id"))
    rows = rows.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n + SPARE).drop("rn")
    put(spark, table, rows, epoch, touched, "team")


def rows_of(spark: SparkSession, table: str, teams: DataFrame | None = None, upto: int | None = None) -> DataFrame:
    """The kept rows, of all teams or of those that ``teams`` (team) names, whose buckets alone are read."""
    own = None if teams is None else [r["b"] for r in teams.select(bucket_of("team").alias("b")).distinct().collect()]
    kept = current(spark, table, before=None if upto is None else upto + 1, buckets=own, schema=ROWS)
    kept = spark.createDataFrame([], ROWS) if kept is None else kept
    return kept if teams is None else kept.join(teams.select("team").distinct(), "team", "left_semi")


def form(spark: SparkSession, table: str, teams: DataFrame | None = None, n: int = 10, upto: int | None = None) -> DataFrame:
    """``team_form`` of the matches merged so far, or after the batch ``upto``."""
    return form_of_rows(rows_of(spark, table, teams, upto), n)


def built(m: DataFrame, parts: int = 3, n: int = 10) -> DataFrame:
    """The form after ``m`` has come in ``parts`` batches, dealt out by match; the table lies in the shared folder."""
    from ..store import scratch

    spark, table = m.sparkSession, scratch(m.sparkSession, "form-table")
    m = written(m, "form-source")
    for k in range(parts):
        update(spark, table, m.where(F.pmod(F.xxhash64("match_id"), F.lit(parts)) == k), k, n)
    return form(spark, table, n=n)
