"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

Words are counted over all training documents. The most frequent ones are symbols of their own; all others share one
symbol for rare words, below which each keeps its own share by its count. Every document is kept once as a sequence
of symbols, ended by the end symbol. The states start from the counts with a fixed disturbance; each round runs forward
and backward over all training documents and sums the expected counts over all partitions. The likelihood of a document
comes from the scaled forward recursion, the shares of its rare words from a join with their counts.

Defined results: a null or empty text is the end token alone; repeated rows and rows without id are scored each
(a null id counts as held out); without training documents all counts are 0 and the model stays at its start;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsieve.llm.common import batches, map_batches, row_numbers, shuffles_freed, texts, words_of, written

#: The end token, counted as a token. No word holds a space.
END = b" "
#: Symbols: 0 ends a document, 1 stands for rare words, the others are the FREQUENT most frequent words.
ENDED, RARE, FREQUENT = 0, 1, 65_000
STATES = 8
#: Rounds, each over all training documents, at every size of the input.
ROUNDS = 14
#: Added to expected counts.
SMOOTH_EMIT, SMOOTH_STEP = 0.01, 1.0
#: Sequences side by side, and cells (the longest times their number) from which there are fewer.
LANES, LANE_CELLS = 2048, 1 << 19
LOG10 = np.log(10.0)


def held_out(doc_id: int | None, parts: int = 7, part: int = 2) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % parts == part


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training documents of ``docs`` (doc_id, text); summed in each task first."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])
        found: Counter = Counter()
        for batch in source:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                if not held_out(doc):
                    found.update(words_of(text))
                    found[END] += 1
            if len(found) > 400_000:
                yield from batches(found.items(), schema, 50_000)
                found = Counter()
        yield from batches(found.items(), schema, 50_000)

    return map_batches(docs, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def symbols(docs: DataFrame, frequent: dict[bytes, int]) -> DataFrame:
    """(uid, doc_id, held_out, n_tokens, seq, rare): the symbols of each document, and its rare words."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("seq", pa.binary()), ("rare", pa.list_(pa.binary()))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, uid = shared.value, row_numbers()

        def rows():
            for batch in source:
                for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                    words = words_of(text)
                    seq = np.fromiter((number.get(w, RARE) for w in words), np.uint16, len(words))
                    rare = [words[i] for i in np.flatnonzero(seq == RARE)]
                    yield next(uid), doc, held_out(doc), len(words) + 1, seq.tobytes() + b"\0\0", rare

        yield from batches(rows(), schema, 1024)

    return map_batches(docs, run, "uid long, doc_id long, held_out boolean, n_tokens long, seq binary, rare array<binary>")


class Model:
    """start: S, step: S x S, emit: V x S; rows of step and start sum to 1, as do the columns of emit."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit
        self.emit_by_state = np.ascontiguousarray(emit.T)

    @staticmethod
    def begin(counts: np.ndarray, states: int = STATES) -> Model:
        """Counts with a fixed disturbance for each state, so that the states can grow apart."""
        noise = np.random.default_rng(7).gamma(1.0, 1.0, (len(counts), states))
        step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return Model.of(np.ones(states), step * len(counts), (counts[:, None] + 1.0) * noise)

    @staticmethod
    def of(start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Model:
        """From expected counts, smoothed."""
        start, step, emit = start + SMOOTH_STEP, step + SMOOTH_STEP, emit + SMOOTH_EMIT
        return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def lanes(seqs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, symbols): up to LANES sequences side by side, the longest first; past an end stands -1.

    No more than LANE_CELLS cells at once; a longer sequence is alone.
    """
    order, at = np.argsort([-len(s) for s in seqs], kind="stable"), 0
    while at < len(order):
        rows = order[at:at + max(1, min(LANES, LANE_CELLS // max(1, len(seqs[order[at]]))))]
        at += len(rows)
        out = np.full((len(seqs[rows[0]]), len(rows)), -1, np.int64)
        for k, r in enumerate(rows):
            out[:len(seqs[r]), k] = seqs[r]
        yield rows, out


#: Longer sequences are worked on in pieces of so many steps, side by side.
BLOCK_STEPS = 2048
#: Columns are scaled at every so many steps; a few small factors in a row stay far from the least double.
SCALE_STEPS = 4


def _emissions(model: Model, obs: np.ndarray) -> np.ndarray:
    """T x S x n; states lie before the sequences, so that each operation runs along the sequences."""
    met = np.empty((len(obs), len(model.start), obs.shape[1]))
    for s in range(len(model.start)):
        met[:, s] = model.emit_by_state[s].take(obs, mode="clip")
    return met


def _transfers(model: Model, parts: list[np.ndarray]) -> np.ndarray:
    """P x S x S: what each part makes of a forward row before it, up to a factor for each part."""
    states = len(model.start)
    out, move = np.empty((len(parts), states, states)), np.ascontiguousarray(model.step.T)
    for rows, obs in lanes(parts):
        met = _emissions(model, obs)
        now, logs = np.repeat(np.eye(states)[:, :, None], len(rows), 2), np.zeros((states, len(rows)))
        for t, n in enumerate((obs >= 0).sum(1).tolist()):
            new = (move @ now[:, :, :n].reshape(states, -1)).reshape(states, states, n)
            if t % SCALE_STEPS == 0:
                scale = new.sum(0)
                new /= scale
                logs[:, :n] += np.log(scale)
            np.multiply(new, met[t, :, None, :n], out=now[:, :, :n])
        out[rows] = (now * np.exp(logs - logs.max(0))).transpose(2, 1, 0)
    return out


def pieces(model: Model, seqs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(parts, owner, before, after): parts of at most BLOCK_STEPS that can be worked on apart from each other.

    ``before`` (S x P) has the forward column before a part (0 for a first one), ``after`` what follows it, up to a factor.
    Both are exact: they come from the products of the parts' transfers.
    """
    states = len(model.start)
    parts, owner, long = [], [], []
    for i, seq in enumerate(seqs):
        if len(seq) > BLOCK_STEPS:
            long.append((len(parts), -(-len(seq) // BLOCK_STEPS)))
        parts.extend(seq[k:k + BLOCK_STEPS] for k in range(0, len(seq), BLOCK_STEPS))
        owner.extend([i] * (len(parts) - len(owner)))
    before, after = np.zeros((states, len(parts))), np.ones((states, len(parts)))
    moves = iter(_transfers(model, [parts[at + k][k == 0:] for at, n in long for k in range(n)]))
    for at, n in long:
        own = [next(moves) for _ in range(n)]
        a = model.start * model.emit[parts[at][0]]
        for k in range(n - 1):
            a = a / a.sum() @ own[k]
            before[:, at + k + 1] = a / a.sum()
        back = np.ones(states)
        for k in range(n - 1, 0, -1):
            back = own[k] @ back
            after[:, at + k - 1] = back = back / back.max()
    return parts, np.array(owner, np.int64), before, after


def _forward(model: Model, met: np.ndarray, live: list[int], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward columns (T x S x n), and what they were scaled by (T x n), 1 between scaled steps."""
    alpha, factor = np.empty(met.shape), np.ones((len(met), met.shape[2]))
    move, ones = np.ascontiguousarray(model.step.T), np.ones(len(model.start))
    for t, n in enumerate(live):
        now = alpha[t, :, :n]
        if t:
            np.matmul(move, alpha[t - 1, :, :n], out=now)
            now *= met[t, :, :n]
        else:
            np.multiply(met[0], np.where(before.any(0), move @ before, model.start[:, None]), out=now)
        if t % SCALE_STEPS == 0:
            f = factor[t, :n]
            np.divide(1.0, ones @ now, out=f)
            now *= f
    return alpha, factor


def _last(alpha: np.ndarray, obs: np.ndarray) -> np.ndarray:
    """S x n: each sequence's last forward column."""
    return alpha[(obs >= 0).sum(0) - 1, :, np.arange(obs.shape[1])].T


def score(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each sequence, by the scaled forward recursion."""
    out = np.zeros(len(seqs))
    parts, owner, before, _ = pieces(model, seqs)
    for rows, obs in lanes(parts):
        alpha, factor = _forward(model, _emissions(model, obs), (obs >= 0).sum(1).tolist(), before[:, rows])
        np.add.at(out, owner[rows], np.log(_last(alpha, obs).sum(0)) - np.log(factor[::SCALE_STEPS]).sum(0))
    return out


class Expected:
    """Sums of expected counts."""

    def __init__(self, symbols_: int, states: int):
        self.start, self.step = np.zeros(states), np.zeros((states, states))
        self.by_state, self.log = np.zeros((states, symbols_)), 0.0

    @property
    def emit(self) -> np.ndarray:
        return self.by_state.T

    def _count(self, flat: np.ndarray, weight: np.ndarray) -> None:
        """Adds weights (T x S x n) to the symbols; few symbols are numbered among themselves first."""
        used: np.ndarray | slice = slice(None)
        if len(flat) * 4 < self.by_state.shape[1]:
            used, flat = np.unique(flat, return_inverse=True)
        symbols_ = self.by_state.shape[1] if isinstance(used, slice) else len(used)
        for s in range(weight.shape[1]):
            self.by_state[s, used] += np.bincount(flat, weight[:, s].ravel(), symbols_)

    def add(self, model: Model, seqs: list[np.ndarray]) -> None:
        """One pass forward and backward over the sequences, long ones in pieces; memory is bounded by LANE_CELLS.

        Backward columns take the scales of the forward ones and end with what makes the product of both sum to 1.
        """
        parts, _, before, after = pieces(model, seqs)
        for rows, obs in lanes(parts):
            live = (obs >= 0).sum(1).tolist()
            met, earlier = _emissions(model, obs), before[:, rows]
            alpha, factor = _forward(model, met, live, earlier)
            last = _last(alpha, obs)
            self.log += float(np.log(last.sum(0)).sum() - np.log(factor[::SCALE_STEPS]).sum())
            beta, moved = after[:, rows] / (last * after[:, rows]).sum(0), np.zeros_like(self.step)
            for t in range(len(live) - 1, -1, -1):
                n = live[t]
                ahead = beta[:, :n]
                now = alpha[t, :, :n]
                now *= ahead  # each column is needed once more, then holds its weight
                if n < len(rows):
                    alpha[t, :, n:] = 0.0  # past an end nothing is added
                ahead *= met[t, :, :n]
                if t % SCALE_STEPS == 0:
                    ahead *= factor[t, :n]
                moved += (alpha[t - 1, :, :n] if t else earlier) @ ahead.T
                if t:
                    beta[:, :n] = model.step @ ahead
            self.start += alpha[0][:, ~earlier.any(0)].sum(1)
            self.step += moved * model.step
            self._count(np.maximum(obs, 0).ravel(), alpha)


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def expected_counts(seqs: DataFrame, model: Model, rounds: int = 1) -> tuple[Model, float]:
    """The model after ``rounds`` rounds over all of ``seqs`` (seq), and their log-likelihood under the one before it.

    In each round every task sums over its documents; the sums go through a shuffle in chunks of symbols, and what
    comes back to the driver has as many rows of states as the model has symbols.
    """
    log = 0.0
    for _ in range(rounds):
        model, log = _round(seqs.select("seq"), model)
    return model, log


#: Symbols whose expected counts travel together, and cells of sequences that one pass takes at least.
CHUNK, PASS_CELLS = 512, 1 << 22


def _round(seqs: DataFrame, model: Model) -> tuple[Model, float]:
    states, n_symbols = len(model.start), len(model.emit)
    shared = seqs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("chunk", pa.int64()), ("sums", pa.binary())])

    def per_task(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, own = Expected(n_symbols, states), shared.value
        held, cells = [], 0
        for batch in source:
            held.extend(_sequences(batch.column(0)))
            cells = sum(map(len, held))
            if cells >= PASS_CELLS:
                found.add(own, held)
                held = []
        found.add(own, held)
        tail = np.vstack([found.step, found.start, np.full(states, found.log)])
        parts = ((k // CHUNK, found.emit[k:k + CHUNK]) for k in range(0, n_symbols, CHUNK))
        yield from batches([(-1, tail.tobytes()), *((k, x.tobytes()) for k, x in parts if x.any())], schema, 64)

    def summed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in source:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if chunk in sums:
                    sums[chunk] += np.frombuffer(part)
                else:
                    sums[chunk] = np.frombuffer(part).copy()
        yield from batches(((k, x.tobytes()) for k, x in sums.items()), schema, 64)

    ddl = "chunk long, sums binary"
    with shuffles_freed(seqs.sparkSession):
        rows = map_batches(seqs, per_task, ddl).repartition("chunk").mapInArrow(summed, ddl).collect()
    shared.destroy()
    emit, tail = np.zeros((n_symbols, states)), np.zeros((states + 2, states))
    for chunk, sums in rows:
        part = np.frombuffer(sums).reshape(-1, states)
        if chunk >= 0:
            emit[chunk * CHUNK:chunk * CHUNK + len(part)] = part
        else:
            tail = part
    return Model.of(tail[states], tail[:states], emit), float(tail[states + 1, 0])


def train(seqs: DataFrame, counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """A model of the training documents ``seqs`` (seq): every round runs over all of them."""
    return expected_counts(seqs, Model.begin(counts, states), rounds)[0]


def score_documents(docs: DataFrame, states: int = STATES, frequent: int = FREQUENT) -> DataFrame:
    """Unigram base score and model score of every document, learned from those that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = written(word_counts(docs), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words = counts.filter(F.col("word") != F.lit(bytearray(END)))
    top = words.orderBy(F.desc("c"), "word").limit(frequent).collect()
    number = {bytes(r["word"]): k + 2 for k, r in enumerate(top)}
    head = np.array([(counts.filter(F.col("word") == F.lit(bytearray(END))).first() or {"c": 0})["c"],
                     0, *[r["c"] for r in top]], dtype=np.float64)
    head[RARE] = rare_total = total - head.sum()
    rare_distinct = max(0, distinct - len(top) - 1)

    coded = written(symbols(docs, number), "symbols")
    model = train(coded.filter(~F.col("held_out")), head, states)

    # shares of rare words: each document's own words meet the counts of words that are not symbols
    rare_counts = words
    if top:
        last = top[-1]
        rare_counts = words.filter((F.col("c") < last["c"]) | ((F.col("c") == last["c"]) & (F.col("word") > F.lit(last["word"]))))
    uses = coded.select("uid", F.explode("rare").alias("word"))
    c = F.coalesce("c", F.lit(0))
    base = float(total + distinct + 1)
    share = float(rare_total + rare_distinct + 1)
    sums = uses.join(rare_counts, "word", "left").groupBy("uid").agg(
        F.sum(F.log10((c + 1) / F.lit(base))).alias("rare_base"),
        F.sum(F.log10((c + 1) / F.lit(share))).alias("rare_score"),
        F.count_if(c > 0).alias("rare_known"))
    return _scored(coded, model, head, base, total).join(sums, "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))


def _scored(coded: DataFrame, model: Model, head: np.ndarray, base: float, total: int) -> DataFrame:
    """(uid, doc_id, held_out, n_tokens, known, base, model): what the symbols give, without the rare words' shares."""
    log = np.log10((head + 1) / base)
    log[RARE] = 0.0
    known = (head > 0).astype(np.int64)
    known[RARE] = 0
    shared = coded.sparkSession.sparkContext.broadcast((model, log, known))
    names = ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "model"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, logs, is_known = shared.value
        for batch in source:
            seqs = _sequences(batch.column(4))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([int(is_known[s].sum()) for s in seqs], pa.int64()),
                 pa.array([float(logs[s].sum()) for s in seqs], pa.float64()), pa.array(score(own, seqs) / LOG10)],
                names=names)

    return map_batches(coded.select("uid", "doc_id", "held_out", "n_tokens", "seq"), run,
                       "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double")
