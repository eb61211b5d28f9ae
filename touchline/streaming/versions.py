"""Tables in buckets, of which a batch writes those that it touches as a new version.

A row of ``done`` says which version of which bucket counts, and is written last, so a failed or repeated batch leaves the
table as it was. Versions that no reader of the last few batches can reach are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import exists, remove, written

BUCKETS = 64
DONE = "epoch long, buckets array<int>"


def bucket_of(key: str = "match_id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def put(spark: SparkSession, table: str, rows: DataFrame, epoch: int, touched: list[int], key: str = "match_id") -> None:
    """Writes ``rows``, all of the ``touched`` buckets, as their version ``epoch``."""
    rows.withColumn("bucket", bucket_of(key)).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/version={epoch}")
    spark.createDataFrame([(epoch, touched)], DONE).coalesce(1).write.mode("append").parquet(f"{table}/done")


def _newest(spark: SparkSession, table: str, before: int | None = None) -> dict[int, int]:
    """bucket -> the epoch of its newest version; at most BUCKETS rows come to the driver."""
    done = spark.read.schema(DONE).parquet(f"{table}/done")
    done = done if before is None else done.where(F.col("epoch") < before)
    newest = done.select("epoch", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    return {r["bucket"]: r["epoch"] for r in newest.collect()}


def current(spark: SparkSession, table: str, before: int | None = None, buckets: list[int] | None = None, schema: str | None = None) -> DataFrame | None:
    """The table as its newest versions of the buckets make it, or None; ``before``: of earlier batches, so that a repeated batch never reads what it writes."""
    if not exists(spark, f"{table}/done"):
        return None
    chosen: dict[int, list[int]] = {}
    for bucket, epoch in _newest(spark, table, before).items():
        if buckets is None or bucket in buckets:
            chosen.setdefault(epoch, []).append(bucket)
    out = None
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, bucket int")
    for epoch, own in sorted(chosen.items()):
        part = reader.parquet(f"{table}/version={epoch}").where(F.col("bucket").isin(own)).drop("bucket")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def retire(spark: SparkSession, table: str, keep: int = 3) -> list[int]:
    """Removes the versions that no reader who opened the table after one of the last ``keep`` batches can reach; gives their epochs.

    The rows of ``done`` are folded into one: the newest version of each bucket as it was before those batches, and the rows
    of the batches themselves. A reader in between finds either the old rows or the new ones with the same meaning, as the
    old files go after the new one is there.
    """
    if not exists(spark, f"{table}/done"):
        return []
    done = written(spark.read.schema(DONE).parquet(f"{table}/done").select("*", F.col("_metadata.file_path").alias("file")), "done")
    epochs = sorted(r["epoch"] for r in done.select("epoch").distinct().collect())
    if len(epochs) <= keep:
        return []
    first = epochs[-keep]
    rows = done.where(F.col("epoch") <= first).select("epoch", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    base: dict[int, list[int]] = {}
    for r in rows.collect():
        base.setdefault(r["epoch"], []).append(r["bucket"])
    reached = set(base) | set(epochs[-keep:])
    old = [r["file"] for r in done.where(F.col("epoch") < first).select("file").distinct().collect()]
    spark.createDataFrame([(e, sorted(b)) for e, b in base.items()], DONE).coalesce(1).write.mode("append").parquet(f"{table}/done")
    remove(spark, *old)
    gone = [e for e in epochs if e not in reached]
    remove(spark, *[f"{table}/version={e}" for e in gone])
    return gone
