"""Byte-pair encoding with a deterministic automaton over tokens.

The automaton starts as one state with an arc for each byte. Each merge (u, v) -> w, in its order, adds a gadget: the
arc v out of state u is cut, since u v is from now on w; a new state w gets the arcs that go out of v; and every state
that has an arc u gets an arc w beside it. The bytes of a word then have exactly one path through it, and its arcs are
the word's encoding. As each gadget copies arcs and cuts one, whether an arc is there follows from the pair it was
copied from and the cuts in between: three tables hold the whole construction, and the arcs that words need are
looked up in them once. Decoding emits the labels of the arcs.

Defined results: a null text is an empty one, without tokens; strings of added tokens in a text become their ids;
repeated rows are encoded each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsieve.llm.common import batches, map_batches, texts
from landsieve.llm.encode import PRE_SPLIT, vocabulary

#: Entries of each cache and length from which a word is not kept: bounds of a worker's memory, not of results.
CACHE, LONG_WORD = 300_000, 200
START = -1


class Automaton:
    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[int, int, int]], added: dict[str, int]):
        self.labels = {i: t for t, i in tokens.items()} | {i: t.encode() for t, i in added.items()}
        self.added = added
        # tables of the construction: the merge that made a state, its two parts, and the merge that cuts an arc
        self.made = {i: START for t, i in tokens.items() if len(t) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.cut: dict[tuple[int, int], int] = {}
        for order, (u, v, w) in enumerate(merges):
            # a merge whose arcs no longer meet changes nothing; parts of it may never have come about
            if u in self.made and v in self.made and self.has_arc(u, v, order):
                self.cut[u, v] = order
                if w not in self.made:
                    self.made[w], self.parts[w] = order, (u, v)
        # bytes that spell arcs, as one transition table: (node, byte) -> node, and the arc that ends at a node
        self.step: dict[int, int] = {}
        self.arc: list[int] = [START]
        for token, i in tokens.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self.step:
                    self.step[key] = len(self.arc)
                    self.arc.append(START)
                node = self.step[key]
            if i in self.made:
                self.arc[node] = i
        self.known: dict[int, bool] = {}

    def has_arc(self, state: int, token: int, before: float = math.inf) -> bool:
        """Whether the automaton has the arc before a merge, by default the finished one.

        Goes back through the gadgets that copied the arc to the first bytes.
        """
        made = self.made
        while True:
            order = self.cut.get((state, token))
            if order is not None and order < before:
                return False
            s, t = made[state], made[token]
            if t >= s:
                if t == START:
                    return True
                token, before = self.parts[token][0], t + 1  # copied from the arc of its first part, after the cut
            else:
                state, before = self.parts[state][1], s  # copied from the state of its last part, before the cut

    def path(self, word: bytes) -> list[int]:
        """The arcs of the one path that spells ``word``.

        Goes on by the longest arc there is and steps back where no arc leads on. Only one path leads to each
        place, so no place is come to twice.
        """
        n, step, arc, known = len(word), self.step, self.arc, self.known
        out: list[int] = []
        ahead: list[list[tuple[int, int]]] = []
        at = 0
        while at < n:
            node, found = 0, []
            for j in range(at, n):
                node = step.get(node << 8 | word[j])
                if node is None:
                    break
                if arc[node] != START:
                    found.append((j + 1, arc[node]))
            ahead.append(found)
            while True:
                if not ahead[-1]:
                    ahead.pop()
                    out.pop()
                    continue
                end, token = ahead[-1].pop()
                if not out:
                    break
                key = out[-1] << 20 | token
                there = known.get(key)
                if there is None:
                    if len(known) > CACHE:
                        known.clear()
                    there = known[key] = self.has_arc(out[-1], token)
                if there:
                    break
            out.append(token)
            at = end
        return out


class Coder:
    """Encodes and decodes texts with an automaton; keeps what it found for short words."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.split = regex.compile(PRE_SPLIT)
        self.special = regex.compile("(" + "|".join(map(regex.escape, automaton.added)) + ")") if automaton.added else None
        self.encoded: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def _encode_word(self, word: str) -> str:
        ids = ",".join(map(str, self.automaton.path(word.encode())))
        if len(word) < LONG_WORD:
            self.encoded[word] = ids
        return ids

    def _decode_word(self, ids: str) -> bytes:
        labels = self.automaton.labels
        out = b"".join(labels[int(i)] for i in ids.split(","))
        if len(ids) < LONG_WORD:
            self.decoded[ids] = out
        return out

    def encode(self, text: str) -> list[str]:
        """The ids of each word, joined by commas."""
        if len(self.encoded) > CACHE:
            self.encoded.clear()
        known, out = self.encoded, []
        special = self.special is not None and any(s in text for s in self.automaton.added)
        for k, part in enumerate(self.special.split(text) if special else [text]):
            if k % 2:
                out.append(str(self.automaton.added[part]))
            else:
                out += [known.get(w) or self._encode_word(w) for w in self.split.findall(part)]
        return out

    def decode(self, ids: list[str]) -> str:
        """Text of ids given in groups joined by commas; bytes that are no UTF-8 become replacement characters."""
        if len(self.decoded) > CACHE:
            self.decoded.clear()
        known = self.decoded
        return b"".join([known.get(i) or self._decode_word(i) for i in ids]).decode("utf-8", "replace")


@functools.cache
def coder(path: str) -> Coder:
    """One for each file and worker."""
    return Coder(Automaton(*vocabulary(path)))


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """For each document the number and digest of its ids, and the digest of what they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)

        def rows():
            for batch in source:
                for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                    groups = code.encode(text)
                    ids = ",".join(groups)
                    decoded = code.decode(groups)
                    yield (doc, ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
                           hashlib.sha256(decoded.encode()).hexdigest())

        yield from batches(rows(), schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
