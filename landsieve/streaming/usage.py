"""Structured Streaming jobs over usage events, with their memory in Spark's state store.

A micro-batch reads its own events and nothing of earlier ones. Ids already charged are keyed state of a
deduplication, totals are keyed state of an aggregation (combined inside each task before the shuffle, so a client
with very many events does not overload one task), and whether a client has been announced is keyed state of its own.
All of it is restored from the checkpoint.

An event is charged once, however late it is: the watermark follows the time of arrival, not the event's own, so no
event is ever too late; it only decides how long an id is remembered (``REMEMBER`` after its first arrival). A
replayed event carries its id; events without id are all charged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from landsieve.operators.usage import NANO, chargeable, effective_cap, price_events

EVENTS = "event_id long, ts timestamp, client string, mode string, cost_nano long, cost_usd double"
TOTALS = "client string, mode string, spent_nano long"
ALERTS = "client string, mode string, spent_nano long, batch_id long"
#: How long after its first arrival an id is known.
REMEMBER = "30 days"


def new_events(events: DataFrame, remember: str = REMEMBER) -> DataFrame:
    """Events of a stream, each id once; ids are state keyed by themselves."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    named = (
        timed.filter(F.col("event_id").isNotNull()).withColumn("arrived", F.current_timestamp())
        .withWatermark("arrived", remember).dropDuplicatesWithinWatermark(["event_id"]).drop("arrived"))
    return named.unionByName(timed.filter(F.col("event_id").isNull()))


def priced_stream(events: DataFrame, remember: str = REMEMBER) -> DataFrame:
    return price_events(new_events(events, remember)).select(*[c.split()[0] for c in EVENTS.split(", ")])


def write_priced(events: DataFrame, out: str, checkpoint: str, remember: str = REMEMBER) -> StreamingQuery:
    """Every event once, with its cost, as a table by day; each batch's files count once it has ended."""
    return (priced_stream(events, remember).withColumn("day", F.to_date("ts")).writeStream.format("parquet").partitionBy("day")
            .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_priced(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(out)


def _open(spark: SparkSession, path: str, schema: str) -> None:
    """Make an empty first folder, so that the table can be read before any batch has written."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")


def write_ledger(events: DataFrame, out: str, checkpoint: str, remember: str = REMEMBER) -> StreamingQuery:
    """Changed totals of each micro-batch, in a folder of its number: a batch that is run again replaces what it wrote."""
    _open(events.sparkSession, f"{out}/totals", TOTALS)
    sums = chargeable(priced_stream(events, remember)).groupBy("client", "mode").agg(F.sum("cost_nano").alias("spent_nano"))

    def save(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/totals/batch={batch_id}")

    return (sums.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """Latest total of each client and mode."""
    rows = spark.read.schema(f"{TOTALS}, batch long").parquet(f"{out}/totals")
    latest = rows.groupBy("client", "mode").agg(F.max_by("spent_nano", "batch").alias("spent_nano"))
    return latest.withColumn("spent_usd", F.col("spent_nano") / F.lit(NANO))


def crossings(totals: DataFrame, limit: int) -> DataFrame:
    """The first total of each client and mode at or above ``limit``, from a stream of totals (with their ledger batch).

    State is one flag for each client and mode. A group holds a row for each ledger batch read, so none is large.
    """
    def first(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        hits = pd.concat([r[r["spent_nano"] >= limit] for r in rows])
        if len(hits):
            state.update((True,))
            best = hits.sort_values("batch").iloc[[0]]
            yield pd.DataFrame({"client": [key[0]], "mode": [key[1]], "spent_nano": best["spent_nano"].to_numpy(),
                                "batch_id": best["batch"].to_numpy()})

    return totals.groupBy("client", "mode").applyInPandasWithState(
        first, ALERTS, "raised boolean", "append", GroupStateTimeout.NoTimeout)


def write_alerts(events: DataFrame, out: str, checkpoint: str, cap: float | None = None,
                 remember: str = REMEMBER) -> StreamingQuery:
    """One alert per client and mode, when its total first reaches the cap.

    The ledger runs first; its totals, one row for each changed client, are the stream that the alerts follow.
    """
    spark, limit = events.sparkSession, round(effective_cap(cap) * NANO)
    write_ledger(events, out, f"{checkpoint}/ledger", remember).awaitTermination()
    totals = spark.readStream.schema(f"{TOTALS}, batch long").parquet(f"{out}/totals").filter(F.lit(limit > 0))
    return (crossings(totals, limit).writeStream.format("parquet").option("path", f"{out}/raised")
            .option("checkpointLocation", f"{checkpoint}/alerts").trigger(availableNow=True).start())


def read_alerts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(ALERTS).parquet(f"{out}/raised").withColumn("spent_usd", F.col("spent_nano") / F.lit(NANO))
