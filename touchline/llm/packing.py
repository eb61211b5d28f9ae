"""Vector best-fit packing of token sequences.

A bin (sequence) has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). What a piece
needs of them follows from its length alone, and lengths are bounded by the token capacity, so the whole corpus is described
by how many pieces there are of each length. Best fit in order of decreasing length then works on counts: bins of the same
contents are one entry with a number, and a step moves as many of them as there are pieces to place. The result is a list of
bin contents whose size depends on the capacity and not on the corpus. The pieces are then numbered within each length and
look up their bin and offset by number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .tokens import encoder

RANK_BITS = 44


def best_fit(counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), rule: str = "norm") -> list[tuple[list[tuple[int, int]], int]]:
    """[(contents, number of bins)]: contents are (length, copies) runs in the order of placing.

    counts: pieces of each length. Of the bins whose residual capacities all suffice, rule "norm" takes the one whose
    weighted residual after placing is shortest, "dot" the one with the largest weighted dot product of residual and need;
    residuals and needs are measured as shares of the capacity. A piece that no empty bin can take raises ValueError.
    """
    cap, w = np.array(capacity, dtype=np.float64), np.array(weights)
    residual, number, contents = np.zeros((0, 3)), np.zeros(0, dtype=np.int64), []
    done: list[tuple[list[tuple[int, int]], int]] = []

    def add(left, n, held):
        nonlocal residual, number
        if n:
            residual, number = np.vstack([residual, left]), np.append(number, n)
            contents.append(held)

    def copies(left, need):
        return int((left // need).min())

    for length in sorted(counts, reverse=True):
        n, need = counts[length], np.array([length, 1, length * length], dtype=np.float64)
        if n and (need > cap).any():
            raise ValueError(f"no bin takes a piece of {length} tokens")
        while n:
            fits = np.flatnonzero((residual >= need).all(axis=1) & (number > 0))
            if len(fits):
                left = (residual[fits] - need) / cap
                k = fits[np.argmin(((w * left) ** 2).sum(axis=1)) if rule == "norm" else np.argmax((w * residual[fits] / cap * need / cap).sum(axis=1))]
                left, have, held = residual[k].copy(), int(number[k]), contents[k]
            else:
                left, have, held = cap.copy(), n, []
                k = -1
            # bins of the same contents fill up one after the other, as a bin that has just taken a piece fits best
            q = copies(left, need) if rule == "norm" or k < 0 else 1
            full = min(have, n // q)
            if full:
                n -= full * q
                have -= full
                add(left - q * need, full, [*held, (length, q)])
            if n and n < q and have:
                have -= 1
                add(left - n * need, 1, [*held, (length, n)])
                n = 0
            if k >= 0:
                number[k] = have
        closed = (number == 0) | (residual[:, 0] < 1) | (residual[:, 1] < 1) | (residual[:, 2] < 1)
        if closed.any():
            done += [(contents[i], int(number[i])) for i in np.flatnonzero(closed) if number[i]]
            residual, number, contents = residual[~closed], number[~closed], [c for c, x in zip(contents, closed, strict=True) if not x]
    return done + [(c, int(n)) for c, n in zip(contents, number, strict=True)]


def slots(bins: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """For each (length, run of ranks): the key of its first rank, copies in a bin, first bin, offset; sorted by key."""
    rows, used, first_bin = [], {}, 0
    for held, number in bins:
        offset = 0
        for length, q in held:
            rank = used.get(length, 0)
            rows.append(((length << RANK_BITS) + rank, q, first_bin, offset))
            used[length] = rank + q * number
            offset += q * length
        first_bin += number
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("key", "copies", "bin", "offset"), table.T, strict=True))


def cut(size: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``size`` tokens; only the first piece of a cut document may be shorter than ``most``."""
    if size <= most:
        return [(0, size)]
    head = size % most
    return ([(0, head)] if head else []) + [(at, most) for at in range(head, size, most)]


def pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. ``tokenizer`` is the path of a tokenizers file."""

    def run(batches):
        own = encoder(tokenizer)
        for batch in batches:
            ids, index, starts, lengths, sums = [], [], [], [], []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                tokens = np.append(own.one(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(tokens), most)):
                    ids.append(doc.as_py())
                    index.append(k)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(tokens[start : start + length].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(index, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), rule: str = "norm") -> DataFrame:
    """The pieces of ``docs`` with their places: sequence_id (gapless from 0) and offset in the sequence.

    documents, attention: capacities beside ``most`` tokens; left out, they never bind. Null text counts as empty and holds
    the end token alone; rows with a null or repeated doc_id are packed like any other; an empty table gives no rows.
    """
    cells = written(pieces(docs, tokenizer, most, end_id).withColumn("deal", F.monotonically_increasing_id()), "pieces")
    # at most ``most`` rows
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.count("*").alias("n")).collect()}
    capacity = (most, documents or most, attention or most * most)
    table = slots(best_fit(counts, capacity, weights, rule))
    # by a number of the written row: pieces of one length may all have the same id, or none
    salts = max(16, sum(counts.values()) // 1_000_000)
    salted = cells.withColumn("salt", F.pmod(F.xxhash64("deal"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "deal"))
    ranked = salted.withColumn("own", own).join(base, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own") - 1).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            key = (length << RANK_BITS) + rank
            k = np.searchsorted(table["key"], key, "right") - 1
            i, q = key - table["key"][k], table["copies"][k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), pa.array(table["bin"][k] + i // q), pa.array(table["offset"][k] + i % q * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
