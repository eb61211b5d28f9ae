"""Token ids of many texts under a byte-level BPE given as a tokenizers file.

The tokenizers library defines the ids. Its encoder takes about 0.4 CPU seconds for a megabyte of our texts, tiktoken 0.15
for the same ids, so a plain byte-level BPE file is also loaded as tiktoken ranks and ordinary texts go that way; a probe at
loading compares both. Texts with a special token's string in them, or with a very long run without a space, and
files of any other kind are encoded by the tokenizers library.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Fixed value: how byte-level BPE files of this family split a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PROBE = "It's an öffentliche prüfung,  4711  of 50% (naïve)\n\n\tключ 東京 \x1c é don't! \r\n <b>x</b> 🙂"
LONG = 2000


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others in order from code point 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextEncoder:
    """Encodes texts to unsigned 32-bit ids, without special tokens added."""

    def __init__(self, path: str, plain_special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_special
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.apart = [] if plain_special else [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._ranks(spec)
        if self.fast and self.fast.encode_ordinary(PROBE) != self._whole(PROBE).tolist():
            self.fast = None

    @staticmethod
    def _ranks(spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or odd or spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            return None
        import tiktoken

        of = _bytes_of_letters()
        added = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def one(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.apart) or len(text) > 10 * LONG and max(map(len, text.split()), default=LONG) >= LONG:
            return self._whole(text)
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False)


@lru_cache(maxsize=4)
def encoder(path: str, plain_special: bool = False) -> TextEncoder:
    """The encoder of this process."""
    return TextEncoder(path, plain_special)
