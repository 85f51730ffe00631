"""Token counts of the documents in flat token files that have no index.

A flat file is a stream of ids in which an end id closes each document; it is read as numbered blocks of bytes that
cut documents anywhere. Each block is searched for the end id in one vectorised comparison. A prefix scan in two
levels, over the blocks of a stretch and over the stretches of a file, carries three numbers across blocks: ids so
far, documents so far, and where the last end id was. That gives every document its start and length.

Defined results: two end ids in a row close an empty document; ids after the last end id are a document that is not
ended; a file without ids has no documents; an empty table gives no rows. When documents are laid out as files, a
null text is an empty one, repeated rows are documents each, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landsieve.llm.common import map_batches, texts, written
from landsieve.llm.encode import encoder, vocabulary

BLOCK_IDS = 1 << 18
#: Blocks that the lower level of the prefix scan takes together.
STRETCH = 1024


def flat_blocks(docs: DataFrame, tokenizer: str, end_id: int | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The documents of each partition as one flat file: (file, block, ids, doc_ids).

    ``ids`` holds little-endian unsigned 16-bit ids, 32-bit ones if the vocabulary needs them. ``doc_ids`` only
    names the documents that end in the block, so that results can be labelled; the scan does not use it.
    """
    tokens, _, added = vocabulary(tokenizer)
    end = max(added.values()) if end_id is None else end_id
    kind = "<u2" if max([*tokens.values(), *added.values(), end]) < 1 << 16 else "<u4"
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get()
        file, block, size = task.partitionId() if task else 0, 0, block_ids * np.dtype(kind).itemsize
        held, ended = bytearray(), []  # ended: (bytes before the end of a document, its id)

        def cut(at: int) -> pa.RecordBatch:
            nonlocal block, ended
            here = [d for e, d in ended if e <= at]
            ended = [(e - at, d) for e, d in ended if e > at]
            out = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                (file, block, bytes(held[:at]), here), schema, strict=True)], schema=schema)
            del held[:at]
            block += 1
            return out

        for batch in source:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                held += np.array([*encode(text, special=False), end], kind).tobytes()
                ended.append((len(held), doc))
                while len(held) >= size:
                    yield cut(size)
        if held:
            yield cut(len(held))

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run,
                       "file long, block long, ids binary, doc_ids array<long>")


def find_ends(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """(file, block, n, ends, labels): ids of each block and the places of end ids in it."""
    has_labels = "doc_ids" in blocks.columns
    labels = F.col("doc_ids") if has_labels else F.lit(None).cast("array<long>").alias("doc_ids")
    names = ["file", "block", "n", "ends", "doc_ids"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n, ends = [], []
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(2)[i].as_buffer(), f"<u{width}") if batch.column(2)[i].is_valid else []
                n.append(len(ids))
                ends.append(np.flatnonzero(np.equal(ids, end_id)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64())),
                 batch.column(3)], names=names)

    return map_batches(blocks.select("file", "block", "ids", labels), run,
                       "file long, block long, n long, ends array<long>, doc_ids array<long>")


def stitch(found: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended, doc_id) of every document, from the blocks' end ids."""
    found = found.withColumn("stretch", F.floor(F.col("block") / STRETCH))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(
        Window.unboundedPreceding, -1)
    sums = lambda w, n, docs: [F.coalesce(F.sum(c).over(w), F.lit(0)) for c in (n, docs)]

    # lower level: what each block has before it in its stretch
    w = before("file", "stretch", "block")
    n, docs = sums(w, "n", F.size("ends"))
    low = found.withColumns({"n0": n, "docs0": docs})
    low = low.withColumn("close", F.col("n0") + F.try_element_at("ends", F.lit(-1)) + 1).withColumn(
        "open0", F.max("close").over(w))
    # upper level: what each stretch has before it in its file
    top = found.groupBy("file", "stretch").agg(
        F.sum("n").alias("n"), F.sum(F.size("ends")).alias("docs"), F.max("block").alias("last_block")).join(
        low.groupBy("file", "stretch").agg(F.max("close").alias("close")), ["file", "stretch"])
    w = before("file", "stretch")
    n, docs = sums(w, "n", "docs")
    top = top.withColumns({"n1": n, "docs1": docs}).withColumn("closed", F.col("n1") + F.col("close"))
    whole = Window.partitionBy("file")
    top = top.withColumns({"open1": F.coalesce(F.max("closed").over(w), F.lit(0)),
                           "file_end": F.max("last_block").over(whole)})
    both = low.join(top.select("file", "stretch", "n1", "docs1", "open1", "file_end"), ["file", "stretch"])
    begin = F.col("n1") + F.col("n0")
    both = both.withColumns({"begin": begin, "open": F.coalesce(F.col("n1") + F.col("open0"), "open1")})

    ends, start = F.col("ends"), lambda k: F.when(k == 0, F.col("open")).otherwise(
        F.col("begin") + F.get(F.col("ends"), k - 1) + 1)
    documents = F.transform(ends, lambda e, k: F.struct(
        (F.col("docs1") + F.col("docs0") + k).alias("ordinal"), start(k).alias("start"),
        (F.col("begin") + e - start(k)).alias("n_tokens"), F.lit(True).alias("ended"),
        F.get(F.col("doc_ids"), k).alias("doc_id")))
    over = F.coalesce(F.try_element_at(ends, F.lit(-1)) + 1 + F.col("begin"), "open")
    rest = F.struct((F.col("docs1") + F.col("docs0") + F.size(ends)).alias("ordinal"), over.alias("start"),
                    (F.col("begin") + F.col("n") - over).alias("n_tokens"), F.lit(False).alias("ended"),
                    F.lit(None).cast("long").alias("doc_id"))
    unended = F.filter(F.array(rest), lambda r: (F.col("block") == F.col("file_end")) & (r["n_tokens"] > 0))
    return both.select("file", F.inline(F.concat(documents, unended)))


def token_counts(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """Length and place of every document of flat token files, given as blocks (file, block, ids)."""
    return stitch(written(find_ends(blocks, end_id, width), "ends"))


def document_token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The documents laid out as flat files, and counted by scanning those."""
    tokens, _, added = vocabulary(tokenizer)
    end = max(added.values())
    width = 2 if max([*tokens.values(), end]) < 1 << 16 else 4
    blocks = written(flat_blocks(docs, tokenizer, end), "flat")
    return token_counts(blocks, end, width).select("doc_id", "file", "ordinal", "start", "n_tokens")
