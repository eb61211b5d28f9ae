"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document becomes a short vector of statistics, transformed to be roughly bell-shaped. A class has its mean and a
covariance shrunk towards the pooled one and towards its own diagonal. The score is the difference of the two
log-densities, each a Mahalanobis distance by the class's Cholesky factor, computed once and kept in the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: The statistics, in the order of the vector.
NAMES = (
    "letters", "upper", "digits", "space", "marks", "symbols", "pipes", "bangs", "words", "word_size", "long_words", "distinct_words",
    "repeated_lines", "lines", "line_size", "sentence_ends", "top_word", "capital_words", "short_lines", "repeated_pairs", "symbol_words",
)
_CLASS = np.zeros(256, dtype=np.int64)  # of each UTF-8 byte; bytes above 127 count as letters
_CLASS[[*range(0x41, 0x5B)]] = 1
_CLASS[[*range(0x30, 0x3A)]] = 2
_CLASS[[0x20, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 4
_CLASS[[ord(c) for c in "#$%&*@^~_=+<>[]{}\\/`"]] = 5
_CLASS[ord("|")] = 6
_CLASS[ord("!")] = 7
_CLASS[[*range(0, 9), *range(14, 32), 127]] = 5
_SYMBOL = frozenset(b"#$%&*@^~_=+<>[]{}\\/|!")


def _logit(share: float) -> float:
    return float(np.log((share + 0.002) / (1.002 - share)))


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of UTF-8 text; those of an empty text are those of no words."""
    n = len(data)
    by_class = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256), minlength=8) if n else np.zeros(8)
    words = data.split()
    count = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    share = by_class / max(1, n)
    pairs = len(set(zip(words, words[1:]))) if count > 1 else 0
    per_word = lambda k: k / max(1, count)
    return [
        _logit(share[0]), _logit(share[1]), _logit(share[2]), _logit(share[3]), _logit(share[4]), _logit(share[5]), _logit(share[6]), _logit(share[7]),
        float(np.log1p(count)),
        float(np.log1p(per_word(n))),
        _logit(per_word(sum(len(w) > 14 for w in words))),
        float(np.log((len(seen) + 1) / (count + 1) ** 0.8)),
        _logit(1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0),
        float(np.log1p(len(lines))),
        float(np.log1p(n / max(1, len(lines)))),
        _logit(per_word(sum(w[-1:] in b".!?" for w in words))),
        _logit(per_word(max(seen.values(), default=0))),
        _logit(per_word(sum(w[:1].isupper() if w[0] < 128 else w.decode("utf-8", "replace")[:1].isupper() for w in words))),
        _logit(sum(len(x) < 30 for x in lines) / max(1, len(lines))),
        _logit(1 - pairs / (count - 1) if count > 1 else 0.0),
        _logit(per_word(sum(w[-1] in _SYMBOL for w in words))),
    ]


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every whole text; null counts as empty."""

    def run(batches):
        for batch in batches:
            x = pa.array([statistics(t.as_py() or b"") for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def fit(labelled: DataFrame, towards_pooled: float = 0.6, towards_diagonal: float = 0.02, floor: float = 1e-3) -> dict:
    """The model from (x, y) rows, y 0 or 1; rows with another y are left out.

    Only sums of x and of its products come to the driver, one row for each class and pair of statistics. If a class has no
    rows, every score is the share of the other class.
    """
    d = len(NAMES)

    def run(batches):
        total = {y: np.zeros((d + 1, d + 1)) for y in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([np.ones(batch.num_rows), batch.column(0).flatten().to_numpy().reshape(-1, d)])
            y = batch.column(1).to_numpy()
            for k in total:
                part = x[y == k]
                total[k] += part.T @ part
        for k, m in total.items():
            i, j = np.triu_indices(d + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, dtype=np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], ["y", "i", "j", "s"])

    rows = labelled.where("y IN (0, 1)").select("x", F.col("y").cast("int").alias("y"))
    got = rows.mapInArrow(run, "y int, i int, j int, s double").groupBy("y", "i", "j").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros((2, d + 1, d + 1))
    for r in got:
        sums[r["y"], r["i"], r["j"]] = sums[r["y"], r["j"], r["i"]] = r["s"]
    n = sums[:, 0, 0]
    prior = (n[1] + 1) / (n.sum() + 2)
    if n.min() < 2:
        return {"constant": float(prior)}
    mean = sums[:, 0, 1:] / n[:, None]
    own = np.array([sums[k, 1:, 1:] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)])
    pooled = (n[:, None, None] * own).sum(axis=0) / n.sum()
    factors, logs = [], []
    for k in (0, 1):
        c = (1 - towards_pooled) * own[k] + towards_pooled * pooled
        c = (1 - towards_diagonal) * c + towards_diagonal * np.diag(np.diag(c)) + floor * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        logs.append(2 * np.log(np.diag(low)).sum())
    return {"mean": mean, "factor": np.array(factors), "log_det": np.array(logs), "prior": float(np.log(prior / (1 - prior)))}


def score_rows(x: np.ndarray, model: dict, temper: float = 4.0) -> np.ndarray:
    """Scores from 0 to 1. The log-density difference is divided by ``temper``, as the statistics are not independent."""
    if "constant" in model:
        return np.full(len(x), model["constant"])
    far = [(((x - model["mean"][k]) @ model["factor"][k].T) ** 2).sum(axis=1) + model["log_det"][k] for k in (0, 1)]
    return 1 / (1 + np.exp(-np.clip(((far[0] - far[1]) / 2 + model["prior"]) / temper, -500, 500)))


def score(vecs: DataFrame, model: dict, bar: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``vecs``; predicted is 1 from ``bar`` on."""
    d = len(NAMES)

    def run(batches):
        for batch in batches:
            s = score_rows(batch.column(1).flatten().to_numpy().reshape(-1, d), model) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= bar).astype(np.int32))], ["doc_id", "score", "predicted"])

    return vecs.mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id):
    """crc32 of the doc_id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, bar: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The model learns from labelled documents outside the held-out fold only. Null text counts as empty; a label that is null
    or neither 0 nor 1, or whose doc_id is null or unknown, is left out; a document labelled twice counts twice. Other
    columns are ignored; an empty table gives an empty result.
    """
    vecs = written(vectors(docs), "quality")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y IN (0, 1)")
    model = fit(vecs.where(~held_out(F.col("doc_id"))).join(known, "doc_id"))
    return score(vecs, model, bar).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
