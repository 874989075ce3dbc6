"""Byte-level BPE ids of whole texts, for a tokenizers JSON file.

The file's vocabulary and merges are handed to tiktoken, which gives the same ids
several times faster, if they are the plain byte-level kind (checked on loading:
each merge makes the token of its rank, no normaliser, no prefix space); any other
file is used through the tokenizers library. Tests hold both against each other.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

# The byte-level pre-tokenisation pattern, and one that cuts alike where no white space stands beside white space.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
# Two white-space characters side by side, or any but space and line feed.
_PAIRS = ("  ", "\n\n", " \n", "\n ")
_RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 ᠎           ​    ⁠　﻿"
# A safe boundary: before one plain space between ASCII letters, where a new word begins whatever stands around.
_SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def _bytes_of_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for themselves, the rest follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes by id, or None if the file isn't of the plain byte-level kind."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if model.get("dropout") or model.get("ignore_merges") or model.get("unk_token") or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", [])):
        return None
    special, letters = {t["content"] for t in spec.get("added_tokens", [])}, _bytes_of_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [model["vocab"].get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
        return None
    return {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}


class BpeEncoder:
    """Ids of texts as numpy arrays of little-endian unsigned integers."""

    def __init__(self, path: str, longest: int = 1 << 18):
        """``longest``: texts of more characters are cut at safe boundaries, and the ids joined."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.longest = longest
        ranks = _ranks(spec)
        size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.full = self.plain = self.tokenizer = None
        if ranks:
            import tiktoken

            special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
            self.full, self.plain = (tiktoken.Encoding(f"own{i}", pat_str=p, mergeable_ranks=ranks, special_tokens=special) for i, p in enumerate((_PATTERN, _PLAIN)))
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()

    def _cut(self, text: str) -> list[str]:
        parts, start = [], 0
        while len(text) - start > self.longest and (m := _SAFE.search(text, start + self.longest)):
            parts.append(text[start : m.start()])
            start = m.start()
        return [*parts, text[start:]]

    def ids(self, text: str) -> np.ndarray:
        if self.tokenizer is not None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        if len(text) > self.longest and len(parts := self._cut(text)) > 1:
            return np.concatenate([self.ids(p) for p in parts])
        if not text:
            return np.zeros(0, self.dtype)
        odd = any(p in text for p in _PAIRS) or any(c in text for c in _RARE)
        return (self.full if odd else self.plain).encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype(self.dtype)


_encoders: dict[str, BpeEncoder] = {}


def encoder(path: str) -> BpeEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = BpeEncoder(path)
    return _encoders[path]
