"""Byte-level BPE exactly as the `tokenizers` library encodes a tokenizer.json, at several times its speed.

The file is loaded with `tokenizers`. If it has the plain byte-level form (no normaliser, no truncation, merges in id
order, the default pattern, special tokens that do not strip), a `tiktoken` encoder is built from the same
vocabulary: both apply the same merges to the same pre-tokens, so the ids agree. Texts are first cut at special
strings, as `tokenizers` does by default. Any other file is encoded by `tokenizers` itself. tests/llm/test_bpe.py holds
the two against each other; over every code point of Unicode no difference was found.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np

#: The pattern of byte-level pre-tokenisation, a fixed value of the file format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, "BytePairs"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def file_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    shifted = 256
    for b in range(256):
        if b not in plain:
            letters[chr(shifted)] = b
            shifted += 1
    return letters


class BytePairs:
    """encode(text) gives the ids as an array of uint32; count(text) their number."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as f:
            self.fast, self.specials = self._build(json.load(f))
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in self.specials) + ")") if self.specials else None

    @staticmethod
    def _build(spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = (
            model.get("type") == "BPE" and not spec.get("normalizer") and not model.get("dropout")
            and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
            and not model.get("end_of_word_suffix") and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        )
        if not plain:
            return None, {}
        letters = _byte_letters()
        specials = {t["content"]: t["id"] for t in added}
        ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in specials}
        for k, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if model["vocab"].get(left + right) != 256 + k:
                return None, {}
        if len(ranks) != 256 + len(model["merges"]):
            return None, {}
        import tiktoken

        return tiktoken.Encoding("fast", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), specials

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.cut is None or not any(s in text for s in self.specials):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        parts = [
            np.array([self.specials[p]], np.uint32) if p in self.specials else self.fast.encode_to_numpy(p, disallowed_special=())
            for p in self.cut.split(text)
            if p
        ]
        return np.concatenate(parts)

    def count(self, text: str) -> int:
        return len(self.encode(text))


def load(path: str) -> BytePairs:
    """One encoder for each file and Python worker."""
    if path not in _loaded:
        _loaded[path] = BytePairs(path)
    return _loaded[path]
