"""Small tables with the odd cases, and brute-force versions of the operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=()):
    """Documents (doc_id, text, ...) from texts or (id, text) pairs; ``extra`` adds columns of these names."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    full = [(i, t, "en", "s", len(t) if t is not None else None, *[7] * len(extra)) for i, t in rows]
    return spark.createDataFrame(full, DOCS + "".join(f", {c} int" for c in extra)).repartition(3)


def sentence(rng, n=12):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(n)).capitalize() + "."


def odd_texts(seed=1):
    """Null, empty, blank, long, repeated and ordinary texts."""
    rng = random.Random(seed)
    plain = ["\n".join(sentence(rng) for _ in range(5)) for _ in range(20)]
    long = "\n".join(sentence(rng) for _ in range(3000))
    return [None, "", " \n\t ", "one", "one two three", long, "a" * 30_000, " " * 9_000 + "x", *plain, plain[0], plain[0],
            plain[1].upper(), plain[2] + "\nTail of it.", "é ß 😀 <|endoftext|>   don't 12.5%"]
