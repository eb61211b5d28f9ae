"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf message; its pieces, scores and normaliser settings are read from the wire format. From them
follow the normaliser, the meta-space marker, the merges or unigram scores and the byte fallback of a tokenizers pipeline,
which encodes batches with several threads. Where no piece has the marker behind another character, texts are split before
each run of markers: no piece can span such a place.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: kinds of pieces in the model format
UNIGRAM, BPE = 1, 2  # fixed values: kinds of models


def fields(data: bytes):
    """(number, value) of each field of a protobuf message: int, bytes, or 4 or 8 raw bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield number, data[at : at + size]
        at += size


def parse_model(data: bytes) -> dict:
    """pieces [(text, score, kind)], model kind, and the normaliser's settings."""
    model = {"pieces": [], "kind": UNIGRAM, "byte_fallback": False, "charsmap": b"", "prefix": True, "squeeze": True, "suffix": False}
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(fields(value))
            model["pieces"].append((piece[1].decode("utf-8"), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(fields(value))
            model |= {"kind": spec.get(3, UNIGRAM), "byte_fallback": bool(spec.get(35, 0)), "suffix": bool(spec.get(24, 0))}
        elif number == 3:
            spec = dict(fields(value))
            model |= {"charsmap": spec.get(2, b""), "prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1))}
    return model


def build(model: dict):
    """A tokenizers.Tokenizer that gives the model's ids."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces = model["pieces"]
    unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    if model["suffix"]:
        raise ValueError("models that put the marker behind words are not supported")
    if model["kind"] == UNIGRAM:
        # control and unused pieces keep their ids but are never chosen
        low = min((p[1] for p in pieces), default=0.0) - 1000.0
        core = models.Unigram([(p[0], p[1] if p[2] in (NORMAL, USER) else low) for p in pieces], unk, model["byte_fallback"])
    elif model["kind"] == BPE:
        vocab = {p[0]: i for i, p in enumerate(pieces)}
        parts = {p[0]: (p[1], i) for i, p in enumerate(pieces) if p[2] == NORMAL}
        merges = []
        for text, (score, _) in parts.items():
            for k in range(1, len(text)):
                left, right = parts.get(text[:k]), parts.get(text[k:])
                if left and right:
                    merges.append((-score, left[1], right[1], text[:k], text[k:]))
        core = models.BPE(vocab, [m[3:] for m in sorted(merges)], unk_token=pieces[unk][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        raise ValueError("only unigram and BPE models are supported")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["prefix"]:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(MARK in p[0].lstrip(MARK) for p in pieces):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model["prefix"] else [])])
    return out


class Codec:
    """Encodes and decodes by a model file. Texts with a NUL byte or a marker of their own are ordinary texts."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self.tokenizer = build(self.model)
        pieces = self.model["pieces"]
        self.bytes = [bytes([int(p[0][1:-1], 16)]) if p[2] == BYTE else b"" if p[2] == CONTROL else " ⁇ ".encode() if p[2] == UNKNOWN else p[0].replace(MARK, " ").encode() for p in pieces]
        self.marked = [p[2] in (NORMAL, USER) and p[0].startswith(MARK) for p in pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        """Byte pieces stand for their bytes, bytes that are no UTF-8 become U+FFFD, the marker of the dummy prefix goes."""
        data = b"".join([self.bytes[i] for i in ids])
        if ids and (self.model["prefix"] or self.model["squeeze"]) and self.marked[ids[0]]:
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The codec of this process."""
    return Codec(path)


def encode(docs: DataFrame, model: str, batch: int = 64) -> DataFrame:
    """(doc_id, ids) of every whole text. Null text counts as empty and has no ids; other columns are ignored."""

    def run(batches):
        own = codec(model)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                ids = own.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) rows; null ids give a null text."""

    def run(batches):
        own = codec(model)
        for b in batches:
            texts = [None if ids is None else own.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, batch: int = 64) -> DataFrame:
    """Encodes and decodes every whole text in one pass: doc_id, n_pieces, ids_crc32, text_back, decoded_sha256.

    ids_crc32 is taken over the little-endian unsigned 32-bit ids, text_back says whether decoding gave the text again
    (a null text counts as empty), decoded_sha256 is of the decoded text. Repeated rows and null ids are handled row by row;
    other columns are ignored; an empty table gives an empty result.
    """
    import hashlib

    def run(batches):
        own = codec(model)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = [t or "" for t in part.column(1).to_pylist()]
                all_ids = own.encode(texts)
                back = [own.decode(ids) for ids in all_ids]
                cols = [
                    pa.array([len(i) for i in all_ids], pa.int64()),
                    pa.array([zlib.crc32(np.array(i, dtype="<u4").tobytes()) for i in all_ids], pa.int64()),
                    pa.array([x == y for x, y in zip(texts, back, strict=True)]),
                    pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back]),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "n_pieces", "ids_crc32", "text_back", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text_back boolean, decoded_sha256 string")
