"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control.

Fixed patterns find assignments, access keys and long hex runs. Of all other long tokens the encoding is inferred
from their characters; tokens that mix encodings are tested piece by piece. Three tests ask whether the symbols could be drawn evenly and independently: chi-squared
against an even alphabet, runs about the alphabet's middle, and lag-one serial correlation. Fisher's method joins
their p-values. True random strings spread evenly over [0, 1] there and ordinary ones pile up near 0, more so the
longer they are. So for each encoding and length class, the share of random strings follows from the upper
p-values, and strings are taken down to the p-value where the estimated share of false ones stays below a limit.

Defined results: a null text is an empty one, without spans; repeated rows are scanned each; an empty table gives
no rows; other columns are carried in a struct, so their names can't clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landsieve.llm.common import map_batches, texts, written

KINDS = ("assign", "access", "hex", "random")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Key words of assignments, forms of access keys and hex runs, least lengths.
KEY_WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile("(?:" + "|".join(
    _either_case(w) for w in KEY_WORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}

#: An equals sign is padding at the end only, so that a value after ``name=`` is a token of its own.
TOKEN = re.compile("[A-Za-z0-9+/_-]{20,}={0,2}")
#: Where the alphabets differ, and what lies between.
SEPARATORS, PIECE = re.compile("[+/_-]"), re.compile("[A-Za-z0-9]{20,}={0,2}")
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Name, symbols and the classes a token must show, from the narrowest alphabet to the widest.
ENCODINGS = (
    ("hex_lower", _DIGITS + _LOWER[:6], (_DIGITS, _LOWER)),
    ("hex_upper", _DIGITS + _UPPER[:6], (_DIGITS, _UPPER)),
    ("base32", _UPPER + "234567", (_DIGITS, _UPPER)),
    ("base36_lower", _DIGITS + _LOWER, (_DIGITS, _LOWER)),
    ("base36_upper", _DIGITS + _UPPER, (_DIGITS, _UPPER)),
    ("base62", _UPPER + _LOWER + _DIGITS, (_DIGITS, _UPPER, _LOWER)),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", (_DIGITS, _UPPER, _LOWER)),
    ("base64_url", _UPPER + _LOWER + _DIGITS + "-_", (_DIGITS, _UPPER, _LOWER)),
)
_SETS = [(name, frozenset(symbols), [frozenset(c) for c in classes], np.array(
    [symbols.find(chr(b)) for b in range(128)])) for name, symbols, classes in ENCODINGS]

#: Edges of the p-value cells in which the corpus is counted.
CELLS = (0.0, 1e-6, 1e-4, 1e-3, 0.01, 0.05, *(x / 10 for x in range(1, 10)))
UPPER_FROM = 0.05
LENGTH_CLASSES = 40

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType())])
CANDIDATE = T.StructType([*SPAN.fields, T.StructField("cls", T.StringType()), T.StructField("cell", T.IntegerType())])
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_CANDIDATE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cls", pa.string()),
                        ("cell", pa.int32())])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind; leftmost and without overlap within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], start, end) for start, k, end in sorted(found)]


def infer_encoding(token: str) -> tuple[str, int, np.ndarray] | None:
    """The narrowest encoding that holds the token: name, alphabet size, symbol numbers. None for plain words."""
    body = token.rstrip("=")
    have = frozenset(body)
    for name, symbols, classes, number in _SETS:
        if have <= symbols and all(have & c for c in classes):
            return name, len(symbols), number[np.frombuffer(body.encode(), np.uint8)]
    return None


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def p_uniform(x: np.ndarray, m: int) -> float:
    """Chi-squared against an even alphabet, upper tail: a gamma with the statistic's exact mean and variance."""
    n = len(x)
    stat = float((np.bincount(x, minlength=m) ** 2).sum()) * m / n - n
    mean, var = m - 1.0, 2.0 * (m - 1) * (n - 1) / n
    df, scale = 2 * mean * mean / var, var / (2 * mean)
    cube = (max(stat, 0.0) / (scale * df)) ** (1 / 3)
    return _tail((cube - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def p_runs(x: np.ndarray, m: int) -> float:
    """Number of runs below and above the middle of the alphabet, two-sided."""
    high = x >= m // 2
    n, a = len(x), int(high.sum())
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + int((high[1:] != high[:-1]).sum())
    return min(1.0, 2 * _tail(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(var))) if var > 0 else 1.0


def p_serial(x: np.ndarray, m: int) -> float:
    """Correlation of each symbol number with the next, two-sided."""
    d = x - x.mean()
    var = float((d * d).sum())
    if var == 0:
        return 0.0
    n = len(x)
    r = float((d[1:] * d[:-1]).sum()) / var
    return 2 * _tail(abs(r + 1 / n) * math.sqrt(n))


def battery(x: np.ndarray, m: int) -> float:
    """Fisher's combination of the three p-values."""
    half = -sum(math.log(max(p, 1e-300)) for p in (p_uniform(x, m), p_runs(x, m), p_serial(x, m)))
    return math.exp(-half) * (1 + half + half * half / 2)


def _outside(start: int, end: int, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """What base spans leave over of a stretch."""
    at = start
    for _, s, e in base:
        if s < end and at < e:
            yield at, s
            at = max(at, e)
    yield at, end


def tested(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, tuple[str, int, np.ndarray]]]:
    """Start, end and encoding of all stretches that the battery tests.

    A token of one encoding is tested whole. One that mixes separators of several is tested between its separators,
    and of one that meets base spans what they leave over. Stretches under 20 symbols are too short for the tests.
    """
    for m in TOKEN.finditer(text):
        for start, end in _outside(*m.span(), base):
            if end - start < 20:
                continue
            if known := infer_encoding(text[start:end]):
                if len(known[2]) >= 20:
                    yield start, end, known
            elif SEPARATORS.search(text, start, end):
                for piece in PIECE.finditer(text, start, end):
                    if (known := infer_encoding(piece[0])) and len(known[2]) >= 20:
                        yield *piece.span(), known


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, int]]:
    """Tested stretches with their class (encoding, length) and p-value cell."""
    out = []
    for start, end, (name, size, x) in tested(text, base):
        length = min(LENGTH_CLASSES, int(2 * math.log2(len(x))))
        cell = sum(battery(x, size) >= edge for edge in CELLS) - 1
        out.append(("random", start, end, f"{name}:{length}", cell))
    return out


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns to keep, all if none are named), ``base`` and ``candidates`` for each document."""
    row = F.struct(*(keep or docs.columns)).alias("row")
    schema = T.StructType([T.StructField("row", docs.select(row).schema[0].dataType),
                           T.StructField("base", T.ArrayType(SPAN)), T.StructField("candidates", T.ArrayType(CANDIDATE))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            base, more = [], []
            for text in texts(batch.column(1)):
                base.append(base_spans(text))
                more.append(candidates(text, base[-1]))
            named = lambda rows, keys: [[dict(zip(keys, x, strict=True)) for x in r] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(named(base, SPAN.names), pa.list_(_SPAN)),
                 pa.array(named(more, CANDIDATE.names), pa.list_(_CANDIDATE))], names=schema.names)

    return map_batches(docs.select(row, "text"), run, schema)


def accepted_from(counts: dict[int, int], limit: float) -> int:
    """The lowest p-value cell that is taken, from the candidates' counts by cell; len(CELLS) takes none.

    The upper cells give the number of random strings. Going down, the candidates beyond their even share are
    false; it stops where these pass ``limit`` of all taken, or make up over half of a cell.
    """
    upper = sum(n for c, n in counts.items() if CELLS[c] >= UPPER_FROM)
    random = min(sum(counts.values()), upper / (1 - UPPER_FROM))
    edges, taken, best = (*CELLS, 1.0), 0, len(CELLS)
    for cell in range(len(CELLS) - 1, -1, -1):
        n = counts.get(cell, 0)
        taken += n
        false = max(0.0, taken - random * (1 - edges[cell]))
        if CELLS[cell] < UPPER_FROM and n and (n - random * (edges[cell + 1] - edges[cell])) > 0.5 * n:
            break
        if taken and false <= limit * taken:
            best = cell
    return best


def class_limits(scanned: DataFrame, limit: float = 0.05) -> dict[str, int]:
    """For each class the lowest cell taken. Counts of all documents; no more classes than encodings x lengths."""
    rows = (scanned.select(F.explode("candidates").alias("c")).groupBy("c.cls", "c.cell").count().collect())
    by: dict[str, dict[int, int]] = {}
    for r in rows:
        by.setdefault(r["cls"], {})[r["cell"]] = r["count"]
    return {k: accepted_from(v, limit) for k, v in by.items()}


def added_spans(limits: dict[str, int]) -> Column:
    """Those candidates of a scanned row that pass their class's limit."""
    empty = F.array().cast(T.ArrayType(SPAN))
    if not limits:
        return empty
    least = F.create_map(*[F.lit(v) for kv in sorted(limits.items()) for v in kv])
    return F.transform(F.filter("candidates", lambda c: c["cell"] >= least[c["cls"]]),
                       lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))


def in_order(spans: Column) -> Column:
    """By start, then kind as listed."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("k"), s["end"].alias("end"),
        s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, limit: float = 0.05, keep: list[str] | None = None) -> DataFrame:
    """``row`` and ``base``, ``added`` and all ``spans`` (kind, start, end in code points, end exclusive)."""
    scanned = written(scan(docs, keep), "secrets")
    return (scanned.withColumn("added", added_spans(class_limits(scanned, limit)))
            .withColumn("spans", in_order(F.concat("base", "added"))).drop("candidates"))


def mask_secrets(docs: DataFrame, limit: float = 0.05, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by ``mask``; n_chars, where there is one, follows the text."""
    found = find_secrets(docs, limit)
    schema = T.StructType([*docs.schema.fields, T.StructField("_masked", T.StringType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            row, out = batch.column(0), []
            text_of = row.field(row.type.get_field_index("text")).to_pylist()
            for text, spans in zip(text_of, batch.column(1).to_pylist(), strict=True):
                if spans:
                    parts, at = [], 0
                    for s in spans:
                        if s["start"] >= at:
                            parts += [text[at:s["start"]], mask]
                        at = max(at, s["end"])
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([*row.flatten(), pa.array(out, pa.string())], names=schema.names)

    masked = map_batches(found.select("row", "spans"), run, schema)
    changed = {"text": F.col("_masked")} | ({"n_chars": F.length("_masked").cast(docs.schema["n_chars"].dataType)}
                                            if "n_chars" in docs.columns else {})
    return masked.withColumns(changed).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.size("added").cast("long").alias("n_random"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
