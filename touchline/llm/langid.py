"""Language identification of words and spans.

Each word (a run of letters) gets a score for every language: the log-probability of its letter trigrams. The script of its
letters narrows the candidates first: a language that hardly ever uses a script is out for words in it. A Viterbi pass over
the words with a penalty for each switch labels the text, so mixed texts come out as spans. A text whose best single
language no interval of words can beat by more than the penalty needs no such pass: its path is constant.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
WINDOW = 1 << 20
#: First code point, last code point and script of the ranges told apart; letters elsewhere are "other".
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(s for _, _, s in SCRIPTS))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case if it is a letter, else 0; its script."""
    fold, script = np.zeros(0x110000, dtype=np.uint32), np.zeros(0x110000, dtype=np.int8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            fold[c] = ord(low) if len(low) == 1 else c
    for first, last, name in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return fold, script


def _letters(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the letters, trigram bucket and script of each, and the indices among them that begin a word."""
    fold, script = _tables()
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.zeros(len(cps) + 2, dtype=np.uint32)
    low[1:-1] = fold[cps]
    at = np.flatnonzero(low)
    tri = (low[at - 1] * np.uint32(0x9E3779B1)) ^ (low[at] * np.uint32(0x85EBCA77)) ^ (low[at + 1] * np.uint32(0xC2B2AE3D))
    tri = ((tri ^ (tri >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int32)
    begins = np.flatnonzero(low[at - 1] == 0)
    return at - 1, tri, script[cps[at - 1]], begins


def _windows(text: str):
    """(offset, piece): a very long text in pieces that end behind a word where one ends within a window."""
    at = 0
    while at < len(text):
        end = min(at + WINDOW, len(text))
        if end < len(text):
            back = end
            while back > at and text[back - 1].isalpha():
                back -= 1
            end = back or end if back > at else end
        yield at, text[at:end]
        at = end


def learn(docs: DataFrame, smoothing: float = 0.5, least_share: float = 1e-3) -> dict:
    """A model from the rows of ``docs`` (text, lang); rows with a null in either are left out.

    Trigram counts are kept per language and bucket, so the model is of a fixed size for each language. No rows: no
    languages, and every prediction is ``und``.
    """

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                if lang not in counts:
                    counts[lang], scripts[lang] = np.zeros(BUCKETS, dtype=np.int64), np.zeros(len(SCRIPT_NAMES), dtype=np.int64)
                for _, piece in _windows(text.as_py()):
                    _, tri, script, _ = _letters(piece)
                    if len(tri) < BUCKETS:
                        np.add.at(counts[lang], tri, 1)
                    else:
                        counts[lang] += np.bincount(tri, minlength=BUCKETS)
                    scripts[lang] += np.bincount(script, minlength=len(SCRIPT_NAMES))
        for lang in counts:
            for first, v in ((0, counts[lang]), (BUCKETS, scripts[lang])):
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at + first, pa.int32()), pa.array(v[at], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    # at most BUCKETS + scripts rows for each language come to the driver
    got = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    n = np.zeros((BUCKETS + len(SCRIPT_NAMES), max(1, len(langs))))
    for k, lang in enumerate(langs):
        part = got[got["lang"] == lang]
        n[part["bucket"].to_numpy(), k] = part["n"].to_numpy()
    tri, script = n[:BUCKETS], n[BUCKETS:]
    used = np.count_nonzero(tri.sum(axis=1)) + 1
    logp = np.log((tri + smoothing) / (tri.sum(axis=0) + smoothing * used))
    share = script / np.maximum(1, script.sum(axis=0))
    allowed = share >= least_share
    allowed[~allowed.any(axis=1)] = True  # a script that no language uses narrows nothing
    return {"langs": langs, "logp": logp.astype(np.float32), "bar": np.where(allowed, 0.0, -1e4).astype(np.float32)}


def viterbi(scores: np.ndarray, penalty: float) -> list[int]:
    """Best path over rows of per-language scores if each switch costs ``penalty``; ties stay, then take the first language."""
    n = scores.shape[1]
    rows = scores.tolist()
    value, back = rows[0], []
    for row in rows[1:]:
        best = max(value)
        top, out = best - penalty, value.index(best)
        back.append([k if value[k] >= top else out for k in range(n)])
        value = [row[k] + (value[k] if value[k] >= top else top) for k in range(n)]
    path = [value.index(max(value))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def label(text: str | None, model: dict, penalty: float = 12.0) -> tuple[str, float, list[tuple[str, int, int]]]:
    """(language, share of the letters, spans of (language, start, end) in code points)."""
    langs = model["langs"]
    scores, starts, ends = [], [], []
    for offset, piece in _windows(text or ""):
        at, tri, script, begins = _letters(piece)
        if not len(begins):
            continue
        word = np.add.reduceat(model["logp"][tri], begins, axis=0).astype(np.float64)
        scores.append(word + model["bar"][script[begins]])
        starts.append(at[begins] + offset)
        ends.append(np.append(at[begins[1:] - 1], at[-1]) + 1 + offset)
    if not scores or not langs:
        return "und", 0.0, []
    s, starts, ends = np.concatenate(scores), np.concatenate(starts), np.concatenate(ends)
    j = int(s.sum(axis=0).argmax())
    if len(langs) > 1:
        gain = np.cumsum(np.delete(s, j, axis=1).max(axis=1) - s[:, j])
        before = np.concatenate([[0.0], gain[:-1]])
        path = [j] if (gain - np.minimum.accumulate(before)).max() <= penalty else viterbi(s, penalty)
    else:
        path = [0]
    if len(path) == 1:
        return langs[path[0]], 1.0, [(langs[path[0]], int(starts[0]), int(ends[-1]))]
    path = np.array(path)
    letters = np.bincount(path, weights=ends - starts, minlength=len(langs))
    turns = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1])
    last = np.append(turns[1:], len(path)) - 1
    spans = [(langs[path[a]], int(starts[a]), int(ends[b])) for a, b in zip(turns, last, strict=True)]
    k = int(letters.argmax())
    return langs[k], float(letters[k] / letters.sum()), spans


def identify(docs: DataFrame, model: dict, penalty: float = 12.0) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, spans.

    lang_pred is the language with the most letters on the path, score its share of them; a text that is null or has no
    letter, or any text under a model without languages, is ``und`` with score 0 and no spans. Other columns are ignored,
    rows with a null or repeated doc_id are labelled like any other.
    """
    spans = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            got = [label(x.as_py(), model, penalty) for x in batch.column(1)]
            found = pa.array([[{"lang": a, "start": b, "end": c} for a, b, c in g[2]] for g in got], spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), found], ["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang: string, start: long, end: long>>")


def keep_identified(docs: DataFrame, model: dict, penalty: float = 12.0) -> DataFrame:
    """The rows of ``docs`` whose text has a language (it is not ``und``), with their columns as they are.

    Rows with a null, empty or letterless text go, and all rows if the model knows no language; rows that repeat or have a null
    id are judged one by one; an empty table gives an empty result.
    """
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [label(x.as_py(), model, penalty)[0] != "und" for x in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
