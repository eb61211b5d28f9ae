"""Exact deduplication by composable polynomial fingerprints.

A text is normalised (each run of ASCII white space becomes one space) and cut into chunks. The chunks of a huge text are
rows of their own, so they are hashed in parallel; chunk hashes combine by length-shifted arithmetic,
``H(x + y) = H(x) * r**len(y) + H(y) (mod p)``, over four primes. Only fingerprints are shuffled for grouping. Texts whose
fingerprints meet are then compared chunk by chunk: for every chunk position of a group the smallest and the largest chunk
must be the same bytes, an aggregation that combines before its shuffle and so holds one chunk, never a group.
Groups that fail are split by their whole texts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, written

#: Primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1220703125, 1664525023, 69069069)
CHUNK = 1 << 16
SPACE = "[\\x20\\x09-\\x0D]+"


@lru_cache(maxsize=8)
def _powers(base: int, prime: int, size: int) -> np.ndarray:
    """base**(size-1), ..., base, 1 modulo prime."""
    out = np.ones(1, dtype=np.uint64)
    step = base % prime
    while len(out) < size:  # doubling: the powers of the upper half are those of the lower, shifted
        shift = pow(step, len(out), prime)
        out = np.concatenate([out * np.uint64(shift) % np.uint64(prime), out])
    return np.ascontiguousarray(out[len(out) - size :])


def chunk_hash(data: bytes, primes=PRIMES, bases=BASES) -> tuple[int, ...]:
    """Polynomial hash of up to CHUNK bytes for each prime; a leading 1 is not needed as lengths are compared too."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    return tuple(int((x @ _powers(b, p, CHUNK)[CHUNK - len(x) :]) % np.uint64(p)) if len(x) else 0 for b, p in zip(bases, primes, strict=True))


def combine(left: tuple[int, ...], right: tuple[int, ...], right_bytes: int, primes=PRIMES, bases=BASES) -> tuple[int, ...]:
    return tuple((h * pow(b, right_bytes, p) + g) % p for h, g, b, p in zip(left, right, bases, primes, strict=True))


def normalise(data: bytes) -> bytes:
    """Each run of the six ASCII white-space bytes becomes one space; ``bytes.split`` and ``isspace`` know exactly these six."""
    if not data:
        return b""
    words = data.split()
    if not words:
        return b" "
    return b" " * data[:1].isspace() + b" ".join(words) + b" " * data[-1:].isspace()


def fingerprint(data: bytes, primes=PRIMES, bases=BASES) -> bytes:
    total = (0,) * len(primes)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        total = combine(total, chunk_hash(part, primes, bases), len(part), primes, bases)
    return b"".join(h.to_bytes(4, "big") for h in total)


def _small(primes, bases):
    def run(batches):
        for batch in batches:
            ids, fps, sizes, shas = batch.column(0), [], [], []
            for text in batch.column(1):
                data = normalise(text.as_py() or b"")
                fps.append(fingerprint(data, primes, bases))
                sizes.append(len(data))
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "fp", "n_bytes", "text_sha256"])

    return run


def _chunks(primes, bases):
    def run(batches):
        for batch in batches:
            hashes = [b"".join(h.to_bytes(4, "big") for h in chunk_hash(x.as_py(), primes, bases)) for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(hashes, pa.binary())], ["doc_id", "text_sha256", "at", "n_bytes", "fp"])

    return run


def _merge(primes, bases):
    def run(batches):
        for batch in batches:
            fps = []
            for parts in batch.column(2).to_pylist():
                total = (0,) * len(primes)
                for part in sorted(parts, key=lambda x: x["at"]):
                    own = tuple(int.from_bytes(part["fp"][4 * i : 4 * i + 4], "big") for i in range(len(primes)))
                    total = combine(total, own, part["n_bytes"], primes, bases)
                fps.append(b"".join(h.to_bytes(4, "big") for h in total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), batch.column(3), batch.column(1)], ["doc_id", "fp", "n_bytes", "text_sha256"])

    return run


_FINGERPRINTS = "doc_id long, fp binary, n_bytes long, text_sha256 string"


def fingerprints(docs: DataFrame, huge: int = 8 << 20, primes=PRIMES, bases=BASES) -> DataFrame:
    """(doc_id, fp, n_bytes, text_sha256) of each normalised text; texts over ``huge`` bytes are hashed by parallel chunk rows."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small = d.where(F.octet_length("text") <= huge).select("doc_id", F.col("text").cast("binary")).mapInArrow(_small(primes, bases), _FINGERPRINTS)
    norm = d.where(F.octet_length("text") > huge).select("doc_id", F.regexp_replace("text", SPACE, " ").cast("binary").alias("n"))
    norm = norm.withColumns({"text_sha256": F.sha2("n", 256), "size": F.octet_length("n")})
    cut = norm.select("doc_id", "text_sha256", F.explode(F.expr(f"sequence(0, int((size - 1) div {CHUNK}))")).alias("at"), "n")
    cut = cut.select("doc_id", "text_sha256", "at", F.expr(f"substring(n, at * {CHUNK} + 1, {CHUNK})").alias("part"))
    cut = cut.select("doc_id", "text_sha256", "at", F.octet_length("part").cast("long").alias("n_bytes"), "part")
    # dealt out by chunk: one huge text keeps many tasks busy
    hashed = cut.repartition("doc_id", "at").mapInArrow(_chunks(primes, bases), "doc_id long, text_sha256 string, at int, n_bytes long, fp binary")
    parts = hashed.groupBy("doc_id", "text_sha256").agg(F.array_distinct(F.collect_list(F.struct("at", "n_bytes", "fp"))).alias("parts"), F.count("*").alias("rows"))
    parts = parts.withColumn("size", F.expr("aggregate(parts, 0L, (s, x) -> s + x.n_bytes)"))
    # the same huge row given twice meets in one group here; its copies come back by the count
    parts = parts.withColumn("copies", F.expr("int(rows div size(parts))")).select("doc_id", "text_sha256", "parts", "size", F.explode(F.expr("sequence(1, copies)")).alias("copy"))
    merged = parts.select("doc_id", "text_sha256", "parts", "size").mapInArrow(_merge(primes, bases), _FINGERPRINTS)
    return small.unionByName(merged)


def normalised(docs: DataFrame):
    return F.regexp_replace(F.coalesce(docs["text"].cast("string"), F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, huge: int = 8 << 20, primes=PRIMES, bases=BASES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Rows that share a doc_id and a text share the decision; a null doc_id sorts after all
    others, and rows of a group that has only null ids are all kept. Other columns of ``docs`` are ignored, an empty table
    gives an empty result.
    """
    fps = written(fingerprints(docs, huge, primes, bases), "fingerprints")
    groups = fps.groupBy("fp", "n_bytes").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = small_side(written(groups, "groups"))
    met = fps.join(groups.select("fp", "n_bytes"), ["fp", "n_bytes"])
    met = small_side(written(met.select(F.col("doc_id").alias("id"), "text_sha256", "fp", "n_bytes").distinct(), "met"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc"), normalised(docs).cast("binary").alias("n")).withColumn("own", F.sha2("n", 256))
    # the sha gives each row its own fingerprint only, however many texts an id has
    same_text = F.col("doc").eqNullSafe(F.col("id")) & (F.col("own") == F.col("text_sha256")) & (F.octet_length("n") == F.col("n_bytes"))
    members = d.join(met, same_text).select("id", "fp", "n_bytes", "n")
    cut = members.select("fp", "n_bytes", F.explode(F.expr(f"sequence(0, int(greatest(octet_length(n) - 1, 0) div {CHUNK}))")).alias("at"), "n")
    cut = cut.select("fp", "n_bytes", "at", F.expr(f"substring(n, at * {CHUNK} + 1, {CHUNK})").alias("part"))
    same = cut.groupBy("fp", "n_bytes", "at").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    clash = same.where("low <> high").select("fp", "n_bytes").distinct()
    clash = written(clash, "clashes")
    out = fps.join(groups, ["fp", "n_bytes"], "left").withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    if clash.limit(1).count():
        apart = members.join(clash, ["fp", "n_bytes"]).select("id", "n")
        own = apart.groupBy("n").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        own = own.select(F.sha2("n", 256).alias("text_sha256"), "keep_id", "group_size")
        good = out.join(clash, ["fp", "n_bytes"], "left_anti").select("doc_id", "keep_id", "group_size", "text_sha256")
        bad = fps.join(clash, ["fp", "n_bytes"], "left_semi").join(own, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
        out = good.unionByName(bad)
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are.

    Null text counts as empty; rows that repeat an id with the same text share the decision; of equal texts with null ids only
    all stay; an empty table gives an empty result.
    """
    gone = exact_groups(docs, **options).where("NOT kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).distinct()
    gone = small_side(written(gone, "gone"))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc"), F.sha2(normalised(docs), 256).alias("own"))
    return keyed.join(gone, F.col("doc").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha")), "left_anti").select("row.*")
