"""Layer, feature and result writers; manifest and releases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landsieve.constants import MAX_LIMIT
from landsieve.functions import geometry as G
from landsieve.operators.results import csv_header, csv_lines
from landsieve.operators.rules import COLUMNS as RULE_COLUMNS


def layer_frame(df: DataFrame, parts: str = "parts") -> DataFrame:
    """``geometry`` and ``bbox`` columns; types hold for empty and all-NULL layers."""
    rest = [c for c in df.columns if c not in (parts, "bbox", "edges", "anchors")]
    geom = F.col(parts).cast(G.PARTS_T)
    return df.select(*rest, geom.alias("geometry"), F.when(geom.isNotNull(), G.bbox(geom)).cast(G.BBOX_T).alias("bbox"))


def write_layer(df: DataFrame, path: str, parts: str = "parts") -> None:
    layer_frame(df, parts).write.mode("overwrite").parquet(path)


def write_plain_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    """One GeoJSON feature per line."""
    features.select("feature").write.mode("overwrite").text(path)


def write_results_csv(scored: DataFrame, path: str) -> None:
    """A ranked page as one CSV file: BOM, CRLF, escaped cells. More rows than a request may ask for are refused."""
    if scored.limit(MAX_LIMIT + 1).count() > MAX_LIMIT:
        raise ValueError(f"a result file holds at most {MAX_LIMIT} rows")
    header = scored.sparkSession.createDataFrame([(0, csv_header())], "rank int, line string")
    lines = header.unionByName(csv_lines(scored)).coalesce(1).sortWithinPartitions("rank")
    lines.select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_ranked_csv(ranked: DataFrame, path: str) -> None:
    """Every ranked row as CSV lines in files cut by rank, the header before rank 1.

    One file after another, in the order of their names, they are the one CSV text.
    """
    header = ranked.sparkSession.createDataFrame([(0, csv_header())], "rank long, line string")
    lines = header.unionByName(csv_lines(ranked.withColumn("rank", F.col("rank").cast("long"))))
    lines.repartitionByRange("rank").sortWithinPartitions("rank").select("line").write.mode("overwrite").option(
        "lineSep", "\r\n").text(path)


def write_rules(rules: DataFrame, path: str) -> None:
    rules.select(*RULE_COLUMNS).write.mode("overwrite").csv(path, header=True)


def manifest(layers: Mapping[str, tuple[DataFrame, str]], extra: Mapping[str, str] | None = None) -> DataFrame:
    """One row per layer (position, name, features, source) plus key/value rows as JSON."""
    out = None
    for pos, (name, (df, source)) in enumerate(layers.items()):
        row = df.agg(F.count("*").alias("features")).select(
            F.lit(pos).alias("pos"), F.lit(name).alias("key"), "features", F.lit(source).alias("source"))
        out = row if out is None else out.unionByName(row)
    out = out.withColumn("value", F.to_json(F.struct("features", "source")))
    for k, v in (extra or {}).items():
        out = out.unionByName(out.sparkSession.createDataFrame(
            [(len(layers), k, None, None, v)], "pos int, key string, features long, source string, value string"))
    return out


def publish_release(spark: SparkSession, root: str, release: str, tables: Mapping[str, DataFrame]) -> str:
    """Write all tables under a new release, then announce it.

    Each release has an announcement of its own, written last and never
    changed, and the newest one counts. A build that fails at any point leaves
    readers on the release before, and nothing they read is ever overwritten.
    """
    base = f"{root}/releases/{release}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
    announced = spark.range(1).select(F.lit(release).alias("release"), F.current_timestamp().alias("at"))
    announced.coalesce(1).write.mode("append").parquet(f"{root}/announced")
    return base


def current_release(spark: SparkSession, root: str) -> str:
    """Folder of the newest announced release."""
    newest = spark.read.schema("release string, at timestamp").parquet(f"{root}/announced").agg(
        F.max_by("release", F.struct("at", "release"))).first()[0]
    return f"{root}/releases/{newest}"
