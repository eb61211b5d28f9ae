"""Match files in and out."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TEXTS = ["match_id", "match_number", "round_id", "league", "round", "match_time", "owner_date", "status", "home_team", "away_team", "home_rank", "away_rank", "score", "home_score", "away_score"]


def read_matches_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV files with a header and perhaps a byte order mark, all columns as text; unreadable and empty files are skipped.

    Files may have different columns in any order. The first line of each file is read first, files of the same header are
    read together, each group by its own names, and united by name; a column that a file lacks is null in its rows. That takes
    one more pass over the text, which is neither parsed nor shuffled; the list of files and headers comes to the driver, as
    planning a read brings it anyway.
    """
    reader = spark.read.option("ignoreCorruptFiles", True)
    lines = reader.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    firsts = lines.where("start = 0").withColumn("i", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "i").alias("header"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(firsts.collect()):
        groups.setdefault(_names(r["header"]), []).append(r["file"])
    parts = []
    for names, own in groups.items():
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        parts.append(spark.read.option("ignoreCorruptFiles", True).schema(schema).csv(own, header=True, encoding="UTF-8", enforceSchema=True))
    return read_many(parts) if parts else spark.createDataFrame([], ", ".join(f"{c} string" for c in TEXTS))


def _names(header: str) -> tuple[str, ...]:
    """The names of a header line; a name that comes again gets its place."""
    names: list[str] = []
    for i, n in enumerate(next(csv.reader([header.lstrip("\ufeff")]), [])):
        names.append(n if n and n not in names else f"{n}_{i}")
    return tuple(names)


def read_matches_json(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """Files that hold one JSON array of matches each; a file that is no array of objects gives no rows."""
    schema = schema or ", ".join(f"{c} string" for c in TEXTS)
    raw = spark.read.text(paths, wholetext=True)
    rows = F.from_json("value", f"array<struct<{', '.join(f'{c.strip().split()[0]}: {c.strip().split()[1]}' for c in schema.split(','))}>>")
    return raw.where(F.ltrim("value").startswith("[")).select(F.explode(rows).alias("m")).select("m.*")


def first_of_each(df: DataFrame, key: str = "match_id", order: str = "position") -> DataFrame:
    """The first row of each key by ``order``, ties by the whole row: a choice that is defined."""
    w = Window.partitionBy(key).orderBy(order, F.to_json(F.struct("*")))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def read_many(frames: list[DataFrame]) -> DataFrame:
    """Frames of several days or files one after the other; a column that some lack is null in theirs."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_dataset(df: DataFrame, path: str, kind: str = "matches", run: str = "run", form: str = "parquet", daily: bool = False) -> str:
    """Writes under path/kind/run=<run>; a repeated run replaces its own folder only. ``daily`` makes a folder for each owner_date.

    CSV files begin with a byte order mark, which spreadsheets want: it stands before the first name of the header.
    """
    to = f"{path}/{kind}/run={run}"
    options = {}
    if form == "csv":
        options = {"header": True, "emptyValue": ""}
        first = next(c for c in df.columns if not (daily and c == "owner_date"))
        df = df.withColumnRenamed(first, "\ufeff" + first)
    writer = df.write.mode("overwrite").format(form).options(**options)
    (writer.partitionBy("owner_date") if daily else writer).save(to)
    return to


def export_matches_json(df: DataFrame, path: str, league: str | None = None) -> None:
    (df if league is None else df.where(F.col("league") == league)).write.mode("overwrite").json(path)
