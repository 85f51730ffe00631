"""Session defaults, shared work folder and table materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_WORK: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(master: str | None = None, app: str = "landsieve", **conf: str) -> SparkSession:
    """A session with adaptive execution on. Only sets what the caller leaves open."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # state of streams lies on the executors' disks, and a checkpoint holds what changed
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        b = b.config(key, value)
    return b.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where that setting is absent, a folder of this machine is made if the whole
    of Spark runs on it. On a cluster that is an error: each executor would
    write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _LOCAL_WORK:
        _LOCAL_WORK[app] = tempfile.mkdtemp(prefix="spark-landsieve-", dir="/tmp")
    return _LOCAL_WORK[app]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Functions that run in tasks are found by their module's name, and workers don't share the driver's path.
    """
    app = spark.conf.get("spark.app.id", "local")
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="landsieve-code-")), "landsieve.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/landsieve/{name}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a small file scan out to all cores.

    A table of a few megabytes is read as one partition, however costly the
    work on each row is. A table with a partition per core is left alone, so at
    scale this adds no shuffle. Only for plain scans: counting their partitions
    runs nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def materialize(df: DataFrame, name: str, deal: bool = False, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (or to ``path``) and read it back.

    Cuts lineage in a way that survives the loss of executors, and gives the
    planner true file sizes for its join choices. ``deal`` spreads a small
    result over all cores for costly work per row.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return spread(back) if deal else back


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def within_rows(df: DataFrame, max_rows: int, weight=None, max_weight: int | None = None) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (and summed ``weight``).

    Reads at most ``max_rows + 1`` rows, so the check itself stays cheap on a
    large table.
    """
    probe = df.limit(max_rows + 1)
    w = F.sum(weight) if weight is not None else F.lit(0)
    n, total = probe.agg(F.count(F.lit(1)), w).first()
    return n <= max_rows and (max_weight is None or (total or 0) <= max_weight)
