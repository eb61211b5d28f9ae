"""Token counts of the documents in flat token files by a separator scan.

A flat file holds nothing but token ids, each document ending with the end-of-document id, and has no index. It is cut into
blocks of bytes that are scanned in parallel by vectorised search for that id. A block knows how many separators it holds,
the tokens before its first and behind its last one; a prefix scan over these few numbers per block gives each block the
ordinal of its first document and the tokens carried into it, which stitches documents across block boundaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, written
from .files import opened, opened_at_random, own_name
from .tokens import encoder

BLOCK = 4 << 20


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int, width: int = 2) -> tuple[DataFrame, DataFrame]:
    """Flat little-endian files of ``docs`` in ``folder``: (manifest (file, path, bytes), order (file, ordinal, doc_id)), written tables.

    The order table says which document stands where; the files themselves do not. A file's number is its task's partition,
    of which one attempt counts.
    """

    def run(batches):
        own, path, out, size, n = encoder(tokenizer, plain_special=True), "", None, 0, 0
        file = TaskContext.get().partitionId()
        for batch in batches:
            if out is None:
                path = own_name(folder, ".bin")
                out = opened(path, write=True)
            for text in batch.column(1):
                ids = np.append(own.one(text.as_py() or ""), np.uint32(end_id))
                if width == 2 and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("token ids do not fit two bytes")
                size += out.write(ids.astype(f"<u{width}").tobytes())
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, file, dtype=np.int64)), pa.array([None] * rows, pa.string()), pa.array(np.arange(n, n + rows)), batch.column(0), pa.array(np.full(rows, -1))], ["file", "path", "ordinal", "doc_id", "bytes"])
            n += rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([path]), pa.array([-1], pa.int64()), pa.array([None], pa.int64()), pa.array([size], pa.int64())], ["file", "path", "ordinal", "doc_id", "bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = written(rows.mapInArrow(run, "file long, path string, ordinal long, doc_id long, bytes long"), "token-files")
    return both.where("ordinal < 0").select("file", "path", "bytes"), both.where("ordinal >= 0").select("file", "ordinal", "doc_id")


def blocks(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, path, at, bytes) of the blocks of (file, path, bytes) files; dealt out so that each is one small task's work."""
    at = F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L) div {block})")).alias("k")
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = files.where("bytes > 0").select("file", "path", "bytes", at).select("file", "path", (F.col("k") * block).alias("at"), F.least(F.lit(block), F.col("bytes") - F.col("k") * block).alias("bytes"))
    return cut.repartition(parts, "path", "at")


def _read(path: str, at: int, size: int, width: int) -> np.ndarray:
    with opened_at_random(path) as f:
        f.seek(at)
        return np.frombuffer(f.read(size), dtype=f"<u{width}")


def count_tokens(files: DataFrame, end_id: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) of each document in (file, path, bytes) files, whose numbers are theirs alone; separators not counted.

    ``block`` is a multiple of ``width``. Tokens behind the last separator of a file are a document that was not ended and
    count as one; an empty file has no documents.
    """

    def ends(batches):
        for batch in batches:
            out = []
            for file, path, at, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = _read(path, at, size, width)
                cut = np.flatnonzero(ids == end_id)
                out.append({"file": file, "path": path, "at": at, "bytes": size, "n": len(cut), "tail": int(len(ids) - 1 - cut[-1]) if len(cut) else len(ids)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("n", pa.int64()), ("tail", pa.int64())]))

    seen = written(blocks(files, block).mapInArrow(ends, "file long, path string, at long, bytes long, n long, tail long"), "blocks")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # the tail carried in: the tails since the last block before this one that has a separator
    stitched = seen.withColumn("ordinal", F.coalesce(F.sum("n").over(before), F.lit(0)))
    run = Window.partitionBy("file", "ordinal").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("n") > 0, F.col("tail")), ignorenulls=True).over(before)
    inner = F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("tail"))).over(run), F.lit(0))
    stitched = stitched.withColumns({"carried": F.coalesce(last, F.lit(0)) + inner, "final": F.lead("at").over(Window.partitionBy("file").orderBy("at")).isNull()})

    def count(batches):
        for batch in batches:
            for file, path, at, size, n, tail, ordinal, carried, final in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                sizes = np.zeros(0, dtype=np.int64)
                if n:
                    cut = np.flatnonzero(_read(path, at, size, width) == end_id)
                    sizes = np.diff(cut, prepend=-1) - 1
                    sizes[0] += carried
                rest = tail if n else carried + tail
                if final and rest:
                    sizes = np.append(sizes, rest)
                if len(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), file, dtype=np.int64)), pa.array(ordinal + np.arange(len(sizes))), pa.array(sizes.astype(np.int64))], ["file", "ordinal", "n_tokens"])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stitched = stitched.select("file", "path", "at", "bytes", "n", "tail", "ordinal", "carried", "final").repartition(parts, "path", "at")
    return stitched.mapInArrow(count, "file long, ordinal long, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2, block: int = BLOCK, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` as flat token files and counts each document's tokens by the scan: doc_id, n_tokens.

    Null text counts as empty and has no tokens; rows with a null or repeated doc_id keep a row each; other columns are
    ignored; an empty table gives an empty result.
    """
    files, order = write_tokens(docs, tokenizer, folder or scratch(docs.sparkSession, "tokens"), end_id, width)
    counts = count_tokens(files, end_id, width, block)
    # both sides have a row for each document, however small their files are: never a broadcast
    return order.hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
