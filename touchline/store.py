"""Tables between steps: written in the folder that driver and executors share, read back, and removed when no longer needed."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_FOLDER: dict[str, str] = {}
_OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session may be without it; it gets a folder of its own, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN_FOLDER.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder."""
    fs, p = _files(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)]


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells a file, or a folder of files, from an earlier state: names, sizes and times."""
    fs, p = _files(spark, path)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(p)))


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of ``scratch``; nothing that is still to be read may depend on them."""
    for path in paths:
        fs, p = _files(spark, path)
        fs.delete(p, True)


@contextmanager
def temporary(spark: SparkSession):
    """Removes what was written inside when it ends. What leaves it has to be written elsewhere."""
    _OPEN.append([])
    try:
        yield
    finally:
        remove(spark, *_OPEN.pop())


@contextmanager
def split_code(spark: SparkSession):
    """Generated code in small methods for what is run inside: for projections to very many columns.

    Whole-stage code puts such a projection into one method, which the JVM then interprets, as it compiles none above 8000 bytes.
    """
    key = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table and reads it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)).cast("long") * 2 + 16
        return F.coalesce(F.size(c), F.lit(0)).cast("long") * 8 + 16
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def small_side(df: DataFrame, most: int = 24 << 20) -> DataFrame:
    """Marks a written table for broadcast if its rows take at most ``most`` bytes, as measured; a larger one is shuffled."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(24).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= most else df
