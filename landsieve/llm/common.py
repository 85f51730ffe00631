"""What the operators share: table access, row keys, hot-key joins and clean-up of intermediate tables."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landsieve.session import fresh_path, materialize, ship_package

#: No more than this many keys can hold a HOT_PARTS-th of all rows each.
HOT_PARTS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def row_numbers() -> Iterator[int]:
    """Numbers that are unique over all tasks of one stage: task in the high bits, a counter in the low."""
    task = TaskContext.get()
    n = (task.partitionId() if task else 0) << 34
    while True:
        yield n
        n += 1


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def words_of(text: str) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case: runs without space, tab, \\n, \\v, \\f, \\r."""
    return text.encode().lower().split()


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from row tuples, so that output memory stays bounded."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=f.type) for col, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def join_counted(left: DataFrame, right: DataFrame, key: str, rows: int, count: str = "n") -> DataFrame:
    """Left join of ``left`` to ``right``, which has one row for each ``key`` of ``left`` and its number of rows there.

    Keys with more than rows / HOT_PARTS rows are at most HOT_PARTS, since all have ``rows`` together: those
    are broadcast, so a hot key is never dealt to one task. All others meet in a shuffled join.
    """
    limit = max(1000, rows // HOT_PARTS)
    hot = right.filter(F.col(count) > limit)
    cold = right.filter(F.col(count) <= limit)
    keys = F.broadcast(hot.select(F.col(key).alias("_hot")))
    on_hot = left.join(F.broadcast(hot), key)
    on_cold = left.join(keys, F.col(key) == F.col("_hot"), "left_anti").join(cold, key, "left")
    return on_hot.unionByName(on_cold)


#: Paths of the tables written while ``recorded`` is in force.
_record: list[str] | None = None


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table in the shared folder: computed once, and not again if an executor is lost."""
    path = fresh_path(df.sparkSession, f"llm-{name}")
    if _record is not None:
        _record.append(path)
    return materialize(df, name, path=path)


@contextlib.contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Notes the tables that operators write meanwhile, so that they can go once their result is stored elsewhere."""
    global _record
    before, _record = _record, paths
    try:
        yield
    finally:
        _record = before


#: Spark removes the shuffle files of a query when it ends, instead of when their plan is garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile leave no shuffle files, so that rounds of a loop don't pile them up."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``fn`` over the Arrow batches of each partition; the workers get this package first."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)
