"""Shortest-pack-first packing over the length histogram.

Documents that fit a sequence are packed whole. Only the histogram of their lengths is looked at: lengths go longest
first, each into the emptiest pack that can take it, and what is kept is how many packs have which pattern. Patterns
are joined back to documents by rank: the documents of one length are numbered, each slot of a pattern takes a range
of these numbers, so a document finds its sequence and offset by arithmetic.

Longer documents have to be cut anyway. Laid end to end they fill what the packs leave free, then whole sequences, and
the rest goes into sequences of powers of two, which need no padding. If their tokens don't suffice, the emptiest packs
are opened and laid behind them. Where a token of that line goes is arithmetic too: free rooms of one size lie together.

Defined results: a null text is an empty one (its sequence is the end id alone); repeated rows and null ids are
documents of their own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landsieve.llm.common import batches, map_batches, texts, written
from landsieve.llm.word_encode import word_encoder

TOKENS = pa.schema([("task", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()),
                    ("size", pa.int32()), ("crc", pa.int64()), ("ids", pa.binary())])
TOKENS_DDL = "task int, place long, doc_id long, doc_tokens long, size int, crc long, ids binary"
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                   ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Pattern:
    """``packs`` packs alike: ``slots`` are (length, copies), longest first, ``used`` their sum."""

    packs: int
    slots: tuple[tuple[int, int], ...]
    used: int


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns and their counts from the number of documents of each length (1 to ``capacity``).

    Packs are held by their fill. There are few patterns whatever the counts: a step changes one of them as a whole
    or ends a length, and a pack holds no more than sqrt(2 * capacity) different lengths.
    """
    open_packs: dict[int, list[Pattern]] = {}
    fills: list[int] = []

    def put(pattern: Pattern) -> None:
        if pattern.used not in open_packs:
            open_packs[pattern.used] = []
            heapq.heappush(fills, pattern.used)
        open_packs[pattern.used].append(pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while fills and not open_packs[fills[0]]:
                del open_packs[heapq.heappop(fills)]
            if not fills or fills[0] + length > capacity:
                # no pack can take it: a new one is the emptiest until it can't take another
                full, rest = divmod(left, capacity // length)
                for packs, copies in ((full, capacity // length), (min(rest, 1), rest)):
                    if packs:
                        put(Pattern(packs, ((length, copies),), length * copies))
                break
            old = open_packs[fills[0]].pop()
            packs = min(left, old.packs)
            if packs < old.packs:
                open_packs[old.used].append(Pattern(old.packs - packs, old.slots, old.used))
            *rest, last = old.slots
            slots = (*rest, (length, last[1] + 1)) if last[0] == length else (*old.slots, (length, 1))
            put(Pattern(packs, slots, old.used + length))
            left -= packs
    return [p for used in sorted(open_packs) for p in open_packs[used]]


class Plan:
    """Where each document of a length and rank, and each token of the line of cut documents, goes."""

    def __init__(self, histogram: dict[int, int], cut_tokens: int, capacity: int):
        self.capacity = capacity
        patterns = shortest_pack_first(histogram, capacity)
        opened = self._open(patterns, cut_tokens)
        ranks: Counter[int] = Counter()
        self.slots: dict[int, list[tuple]] = {n: [] for n in histogram}
        self.rooms: list[tuple[int, int, int, int]] = []  # (start in the line, room, packs, first sequence)
        first, line, behind = 0, 0, cut_tokens
        free: dict[int, list[tuple[int, int, int]]] = {}
        for pattern, loose in zip(patterns, opened, strict=True):
            whole, offset = pattern.packs - loose, 0
            for length, copies in pattern.slots:
                # (first rank, copies, packs, sequence or -1, offset, place in the line, tokens of a pack)
                if whole:
                    self.slots[length].append((ranks[length], copies, whole, first, offset, 0, 0))
                if loose:
                    self.slots[length].append((ranks[length] + whole * copies, copies, loose, -1, offset, behind, pattern.used))
                ranks[length] += pattern.packs * copies
                offset += length * copies
            if whole and self._room(pattern):
                free.setdefault(self._room(pattern), []).append((whole, first, pattern.used))
            behind += loose * pattern.used
            first += whole
        for room in sorted(free, reverse=True):
            for packs, sequence, used in free[room]:
                self.rooms.append((line, room, packs, sequence, used))
                line += room * packs
        self.full_from, self.first_full, self.total = line, first, behind
        over = (behind - line) % capacity
        self.tail_from = behind - over
        self.starts = [r[0] for r in self.rooms]
        self.opened_lengths = {n for p, loose in zip(patterns, opened, strict=True) if loose for n, _ in p.slots}
        for n in self.slots:
            self.slots[n].sort()
        self.firsts = {n: [s[0] for s in v] for n, v in self.slots.items()}

    def _room(self, pattern: Pattern) -> int:
        """What has to be filled: nothing where the pack is a power of two."""
        return 0 if pattern.used & (pattern.used - 1) == 0 else self.capacity - pattern.used

    def _open(self, patterns: list[Pattern], tokens: int) -> list[int]:
        """Packs of each pattern to open so that the line fills all rooms of the others; the emptiest go first."""
        need, out = sum(self._room(p) * p.packs for p in patterns), [0] * len(patterns)
        for i in sorted(range(len(patterns)), key=lambda i: -self._room(patterns[i])):
            p = patterns[i]
            if need <= tokens or not self._room(p):
                break
            out[i] = min(p.packs, -(-(need - tokens) // self.capacity))
            need -= out[i] * self._room(p)
            tokens += out[i] * p.used
        return out

    def of_rank(self, length: int, rank: int) -> tuple[int, int, int]:
        """(sequence, offset, -1) of a packed document, or (-1, -1, place in the line) of one from an opened pack."""
        first, copies, _, sequence, offset, line, used = self.slots[length][bisect.bisect_right(self.firsts[length], rank) - 1]
        pack, copy = divmod(rank - first, copies)
        at = offset + copy * length
        return (sequence + pack, at, -1) if sequence >= 0 else (-1, -1, line + pack * used + at)

    def of_line(self, start: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(length, sequence, offset) of the pieces of ``n`` tokens that begin at ``start`` in the line."""
        at, end = start, start + n
        while at < end:
            if at < self.full_from:
                begin, room, _, sequence, used = self.rooms[bisect.bisect_right(self.starts, at) - 1]
                pack, inside = divmod(at - begin, room)
                size, sequence, offset = room - inside, sequence + pack, used + inside
            elif at < self.tail_from:
                sequence, offset = divmod(at - self.full_from, self.capacity)
                size, sequence = self.capacity - offset, sequence + self.first_full
            else:
                size, sequence, offset = self._tail(at)
            size = min(size, end - at)
            yield size, sequence, offset
            at += size

    def _tail(self, at: int) -> tuple[int, int, int]:
        """The last tokens are cut at powers of two, the largest first."""
        sequence, begin = self.first_full + (self.tail_from - self.full_from) // self.capacity, self.tail_from
        while True:
            size = 1 << (self.total - begin).bit_length() - 1
            if at < begin + size:
                return begin + size - at, sequence, at - begin
            begin, sequence = begin + size, sequence + 1


def token_table(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each document (doc_id, text): its ids, and its place in the task that found them.

    ``place`` is the number among the task's documents of that ``size``; documents past ``capacity`` have size 0 and
    as place the number of tokens before them.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, end = word_encoder(tokenizer), TaskContext.get().partitionId(), end_id.to_bytes(2, "little")
        places: Counter[int] = Counter()

        def rows():
            for batch in source:
                for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                    ids = encode(text) + end
                    n = len(ids) // 2
                    size = n if n <= capacity else 0
                    yield task, places[size], doc, n, size, _crc(ids) if size else 0, ids
                    places[size] += 1 if size else n

        yield from batches(rows(), TOKENS, 256)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, TOKENS_DDL)


def _crc(ids: bytes) -> int:
    """CRC of 16-bit ids written as 32-bit numbers."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def _numbered(tokens: DataFrame, ids: DataFrame) -> DataFrame:
    """``place`` counted over all tasks: those of one size are added up task by task."""
    tasks = tokens.groupBy("size", "task").agg(
        F.sum(F.when(F.col("size") == 0, F.col("doc_tokens")).otherwise(F.lit(1))).alias("n"))
    before = Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return ids.hint("merge").join(starts, ["size", "task"]).withColumn("place", F.col("place") + F.col("base")).drop("base", "task")


def place_pieces(tokens: DataFrame, plan: Plan) -> DataFrame:
    """Pieces of numbered documents (doc_id, doc_tokens, size, place, crc, ids)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in source:
                for doc, n, size, place, crc, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    line = place
                    if size:
                        sequence, offset, line = plan.of_rank(size, place)
                        if line < 0:
                            yield doc, 0, n, crc, n, sequence, offset
                            continue
                    start = 0
                    for length, sequence, offset in plan.of_line(line, n):
                        yield doc, start, length, _crc(ids[2 * start:2 * (start + length)]), n, sequence, offset
                        start += length

        yield from batches(rows(), PIECE)

    return map_batches(tokens.select("doc_id", "doc_tokens", "size", "place", "crc", "ids"), run, PIECE_DDL)


def pack_histogram(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` ids, without padding."""
    tokens = written(token_table(docs, tokenizer, capacity, end_id), "tokens")
    # one row for each length up to the capacity
    counts = {r[0]: (r[1], r[2]) for r in tokens.groupBy("size").agg(F.count(F.lit(1)), F.sum("doc_tokens")).collect()}
    _, cut_tokens = counts.pop(0, (0, 0))
    plan = Plan({n: c for n, (c, _) in counts.items()}, cut_tokens, capacity)
    # ids move only with documents that may be cut
    cut = [0, *sorted(plan.opened_lengths)]
    moved = tokens.withColumn("ids", F.when(F.col("size").isin(cut), F.col("ids")))
    return place_pieces(_numbered(tokens, moved), plan)
