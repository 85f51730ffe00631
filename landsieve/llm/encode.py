"""Whole texts to token ids with a byte-level BPE file."""

from __future__ import annotations

import functools
import json
import re

import tiktoken
from tokenizers import Tokenizer

#: Pre-split of byte-level BPE (fixed value of the public vocabulary).
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def byte_of_char() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible Latin-1 stands for itself, the rest is moved up."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[int, int, int]], dict[str, int]]:
    """Of a tokenizer file: ids by bytes, merges as (left, right, joined) ids in order, ids of added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back, ids = byte_of_char(), spec["model"]["vocab"]
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    plain = {bytes(back[c] for c in t): i for t, i in ids.items() if t not in added}
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in spec["model"]["merges"]]
    return plain, merges, added


#: A run of white space this long is left to the slower library: the fast one's pattern recurses over it.
LONG_BLANK = 4096


class Encoder:
    """Ids as the tokenizers library gives them, without added special tokens; found with its faster equal."""

    def __init__(self, path: str):
        self.path, self.blank = path, re.compile(r"\s{%d}" % LONG_BLANK)
        ranks, _, self.added = vocabulary(path)
        self.core = tiktoken.Encoding("bpe", pat_str=PRE_SPLIT, mergeable_ranks=ranks, special_tokens=self.added)

    def __call__(self, text: str, special: bool = True) -> list[int]:
        """``special``: strings of added tokens in the text become their ids; else they are ordinary text."""
        if len(text) >= LONG_BLANK and self.blank.search(text):
            slow = Tokenizer.from_file(self.path)
            slow.encode_special_tokens = not special
            return slow.encode(text, add_special_tokens=False).ids
        if special and any(s in text for s in self.added):
            return self.core.encode(text, allowed_special="all")
        return self.core.encode_ordinary(text)


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each file and worker."""
    return Encoder(path)
