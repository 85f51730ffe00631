"""Whole texts to token ids with a word-level BPE file (lower case, white space dropped, words on their own)."""

from __future__ import annotations

import functools
import re
import unicodedata

from tokenizers import Tokenizer

from landsieve.llm.encode import byte_of_char

#: Texts of other characters are left to the library: letters above the Latin ones, marks and controls.
PLAIN = [c for c in map(chr, [*range(0x20, 0x7F), 9, 10, 11, 12, 13, *range(0xA0, 0x130), *range(0x131, 0x180),
                              *range(0x2010, 0x2028), 0x20AC]) if unicodedata.category(c) not in ("Mn", "Cf")]
#: Contractions that are words of their own (fixed values of the public vocabulary).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Words whose ids a worker remembers.
REMEMBERED = 500_000


def _class(members: list[str]) -> str:
    return "".join(map(re.escape, members))


def _word_pattern() -> re.Pattern:
    letters = _class([c for c in PLAIN if unicodedata.category(c)[0] == "L"])
    digits = _class([c for c in PLAIN if unicodedata.category(c)[0] == "N"])
    blank = _class([c for c in PLAIN if c.isspace()])
    return re.compile(f"{'|'.join(CONTRACTIONS)}|[{letters}]+|[{digits}]|[^{blank}{letters}{digits}]+")


class _Remembered(dict):
    """Ids of a word as 16-bit numbers, looked up once."""

    def __init__(self, library: Tokenizer):
        self.split = library.model.tokenize
        self.char = {b: c for c, b in byte_of_char().items()}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        # the model takes bytes as characters of their own, which are those of latin-1 moved
        shown = word.encode().decode("latin-1").translate(self.char)
        ids = self[word] = _packed([t.id for t in self.split(shown)])
        return ids


def _packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(2, "little") for i in ids)


class WordEncoder:
    """Ids as the tokenizers library gives them with add_special_tokens=False, as little-endian 16-bit numbers.

    Words don't depend on each other, so the ids of each are found once. Texts in which normalisation does more
    than lower the case of Latin letters go to the library whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has ids past 16 bits")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words = _Remembered(self.library)
        self.odd = re.compile(f"[^{_class(PLAIN)}]")
        self.find = _word_pattern().findall

    def __call__(self, text: str) -> bytes:
        if self.odd.search(text) or any(s in text for s in self.added):
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, self.find(text.lower())))


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One for each file and worker."""
    return WordEncoder(path)
