"""Streams whose memory is Spark's state store: flat work, replays, late events, restarts."""

import pytest
from pyspark.sql import functions as F

from landsieve.operators import usage as U
from landsieve.streaming import usage as ST

SCHEMA = "event_id long, ts timestamp, client string, mode string, model string, usage string"
USAGE = '{"input_tokens":1000000}'  # 1.5 USD


def put(spark, src, name, rows):
    """One file of events (id, second, client)."""
    spark.createDataFrame([(i, s, c) for i, s, c in rows], "event_id long, s long, client string").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), "client", F.lit("text").alias("mode"), F.lit("gemini-3.5-flash").alias("model"),
        F.lit(USAGE).alias("usage")).coalesce(1).write.parquet(f"{src}/{name}")


def stream(spark, src):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))


def records_read(spark):
    """Rows that all stages so far have read from tables."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()))


def price(spark):
    e = spark.createDataFrame([("text", "gemini-3.5-flash", USAGE)], "mode string, model string, usage string")
    return U.price_events(e).first()["cost_nano"]


def test_work_of_a_batch_stays_flat(spark, tmp_path):
    """Fifty batches in five runs from one checkpoint: each run reads as many rows as the first, and the sums are right."""
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    read = []
    for run in range(5):
        for b in range(10):
            n = (run * 10 + b) * 4
            # one event of each file is a replay of the file before
            put(spark, src, f"r{run}b{b}", [(n + k, n + k, f"c{k % 2}") for k in range(4)] + ([(n - 1, n - 1, "c1")] if n else []))
        before = records_read(spark)
        ST.write_ledger(stream(spark, src), out, cp).awaitTermination()
        read.append(records_read(spark) - before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    # 50 rows, seen by the branch of events with ids and by that of events without; the first file has no replay
    assert all(r == read[1] for r in read[1:]) and read[0] <= read[1] <= 2 * 50, read
    assert {r["client"]: r["spent_nano"] for r in ST.read_ledger(spark, out).collect()} == {f"c{k}": 100 * price(spark) for k in (0, 1)}


def test_late_and_unnamed_events_are_kept(spark, tmp_path):
    """An event years late is charged, its replay is not; events without id are all charged."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    put(spark, src, "a", [(1, 1_900_000_000, "a"), (None, 5, "a"), (None, 5, "a")])
    ST.write_priced(stream(spark, src), out, str(tmp_path / "cp")).awaitTermination()
    put(spark, src, "b", [(2, 10, "a"), (1, 1_900_000_000, "a"), (None, 5, "a")])
    put(spark, src, "c", [(2, 10, "a"), (3, 0, "a")])
    ST.write_priced(stream(spark, src), out, str(tmp_path / "cp")).awaitTermination()
    ids = [r["event_id"] for r in ST.read_priced(spark, out).collect()]
    assert sorted(i for i in ids if i) == [1, 2, 3] and ids.count(None) == 3
    assert sum(r["cost_nano"] for r in ST.read_priced(spark, out).collect()) == 6 * price(spark)


@pytest.mark.parametrize("cap", [2.0, 4.5, 100.0, 0.0])
def test_one_alert_for_each_client_over_restarts(spark, tmp_path, cap):
    """As many alerts, for the same clients, as the batch form finds; none twice."""
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    rows = [(i, 1000 * i, f"c{i % 5}" if i % 7 else "c0") for i in range(40)]
    for run in range(3):
        put(spark, src, f"f{run}a", rows[run * 14:run * 14 + 7])
        put(spark, src, f"f{run}b", rows[run * 14 + 7:run * 14 + 14] + rows[:3])
        ST.write_alerts(stream(spark, src), out, cp, cap).awaitTermination()
    alerts = ST.read_alerts(spark, out).collect()
    events = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(src))
    want = U.cap_crossings(U.price_events(events), cap).collect()
    assert sorted(r["client"] for r in alerts) == sorted(r["client"] for r in want)
    assert all(r["spent_nano"] >= round(U.effective_cap(cap) * U.NANO) for r in alerts)


def test_plan_reads_nothing_of_earlier_batches(spark, tmp_path):
    """The ledger's plan: state for ids, state for sums, partial sums before the shuffle, no joins."""
    put(spark, tmp_path / "in", "a", [(1, 1, "a")])
    q = ST.write_ledger(stream(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    plan = q._jsq.explainInternal(False)
    assert "StateStoreSave" in plan and "Deduplicate" in plan and "partial_sum" in plan and "Join" not in plan
