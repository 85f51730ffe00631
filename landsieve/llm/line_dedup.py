"""Removal of repeated passages by overlapping three-line windows.

Lines with a word are numbered in each document. Every run of three of them is hashed; of each hash that occurs
again anywhere, the first occurrence (by doc_id, then place) stays and the later ones mark their lines. Marked
positions are merged, and the text is rebuilt from the other lines. Where a later window overlaps the first one
of the same hash in the same document, the lines of the first stay.

Defined results: null and empty texts have no lines and stay as they are; a text that loses nothing is left
untouched, else blank lines go too; rows of equal id and text count as one document and get one result; rows
without id come last in the order; an empty table gives no rows; columns of the input are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsieve.llm.common import join_counted, written

WINDOW = 3
HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(text):
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD))


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, text digest, place, hash) of every run of ``size`` lines."""
    lined = docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"), _lines("text").alias("lines"))
    lines, n = F.col("lines"), F.size("lines")
    runs = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.unhex(F.md5(F.array_join(
        F.slice(lines, i + 1, size), "\n")))))
    return lined.select("id", "digest", F.posexplode(runs).alias("at", "hash"))


def marked(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, digest, covered): the line numbers of each document that later occurrences cover, merged."""
    runs = written(windows(docs, size), "windows")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", "at")
    firsts = runs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    met = join_counted(runs, firsts, "hash", runs.count()).filter("n > 1")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    begin = F.when(same, F.greatest("at", F.col("first.at") + size)).otherwise(F.col("at"))
    later = met.filter(~(same & (F.col("at") == F.col("first.at")))).select(
        "id", "digest", F.explode(F.sequence(begin, F.col("at") + (size - 1))).alias("line"))
    return later.groupBy("id", "digest").agg(F.collect_set("line").alias("covered"))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(row, n_lines, n_removed, text): each document's columns, its counts and its text without repeats."""
    marks = written(marked(docs, size).select(F.struct("id", "digest").alias("key"), "covered"), "marks")
    row = docs.select(F.struct("*").alias("row"))
    keyed = row.withColumn("key", F.struct(F.col("row.doc_id").alias("id"), F.md5("row.text").alias("digest")))
    # one plan at every size: were the marks broadcast while they are few, texts would begin to move at some size
    joined = keyed.join(marks.hint("merge"), keyed["key"].eqNullSafe(marks["key"]), "left").select("row", "covered")
    joined = joined.withColumn("lines", F.coalesce(_lines("row.text"), F.array().cast("array<string>")))
    lines, n = F.col("lines"), F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("covered"))
    text = F.when(F.col("covered").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return joined.select("row", n.cast("long").alias("n_lines"),
                         F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"), text.alias("text"))


def without_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents with repeats removed; those that lose all their lines go; n_chars follows the text."""
    done = dedup_lines(docs, size).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    cols = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*[v.alias(k) for k, v in cols.items()])


def summary(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text"), size).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.md5("text").alias("text_md5"))
