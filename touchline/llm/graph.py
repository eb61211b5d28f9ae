"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two aggregations and two equi-joins on small (id, id) rows. A node with very many links is never gathered:
its minimum comes from a partial aggregation, and the joins are inner equi-joins whose skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch


def _is_star_forest(edges: DataFrame) -> bool:
    """True if each u has one v and no v is itself a u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionAll(edges.select(F.col("v").alias("n"), F.lit(0).alias("up")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.count("*").alias("all"))
    return seen.where("ups > 1 OR (ups = 1 AND all > 1)").limit(1).count() == 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links -> (node, root): for every node with a link to another node, the smallest node it can reach.

    The roots themselves have no row. Null ends and self links are ignored; an empty table gives an empty result.
    """
    a, b = (F.col(c).cast("long") for c in edges.columns[:2])
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (a.isNotNull() & b.isNotNull()).alias("ok"))
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema("u long, v long").parquet(path), path

    e, path = kept(e.where("ok AND u <> v").select("u", "v").distinct())
    while not _is_star_forest(e):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, last = kept(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        remove(spark, path)
        path = last
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
