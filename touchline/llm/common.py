"""Shared helpers: table access, scratch tables in the cluster's shared folder, array union-find."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..store import remove, scratch, small_side, temporary, written

__all__ = ["remove", "scratch", "small_batches", "small_side", "table", "temporary", "union_roots", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links (a[i], b[i]), by vectorised hooking and jumping."""
    root = np.arange(n) if root is None else root
    a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what is run inside: for rows that hold long values."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)
