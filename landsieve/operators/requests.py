"""Validation and de-duplication of scoring requests held as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsieve import constants as K
from landsieve.functions import geometry as G
from landsieve.operators.scoring import bad_parameters


def request_validate(requests: DataFrame) -> DataFrame:
    """Add ``reject_reason`` (NULL when accepted).

    Needs geometry_type, vertices (int), weights (map), limit, offset; use case
    and thresholds are checked where the rows have them.
    """
    known = F.array(*[F.lit(k) for k in K.FACTORS])
    keys = F.map_keys("weights")
    return requests.withColumn(
        "reject_reason",
        F.when(F.col("geometry_type").isNull() | ~F.col("geometry_type").isin("Polygon", "MultiPolygon"), "geometry type")
        .when(F.coalesce("vertices", F.lit(0)) == 0, "no coordinates")
        .when(F.col("vertices") > K.MAX_VERTICES, "too many vertices")
        .when(F.size(F.array_except(keys, known)) > 0, "unknown weight")
        .when(F.exists(F.map_values("weights"), lambda v: ~(v >= 0) | (v == F.lit(float("inf"))) | F.isnan(v)), "bad weight")
        .when((F.col("limit") < 1) | (F.col("limit") > K.MAX_LIMIT), "limit")
        .when(F.col("offset") < 0, "offset")
        .otherwise(bad_parameters() if {"use_case", "t_min_acres", "t_max_slope_pct"} <= set(requests.columns) else F.lit(None)))


def clamp_page(requests: DataFrame) -> DataFrame:
    """The lenient variant: limit and offset forced into range."""
    return requests.withColumn("limit", F.least(F.greatest(F.col("limit"), F.lit(1)), F.lit(K.MAX_LIMIT))).withColumn(
        "offset", F.greatest(F.col("offset"), F.lit(0)))


def zone_codes_clean(codes: Column) -> Column:
    """Trimmed, non-blank, sorted, distinct codes."""
    trimmed = F.transform(F.filter(codes, lambda c: c.isNotNull()), lambda c: F.trim(c))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda c: c != "")))


def zone_codes_bad(codes: Column) -> Column:
    """Codes that do not have the shape of a zone code."""
    return F.filter(zone_codes_clean(codes), lambda c: ~c.rlike(K.ZONE_CODE_PATTERN))


def area_guard(requests: DataFrame, parts: str = "parts", max_sqm: float = K.MAX_AREA_SQM) -> DataFrame:
    """Add the area on the sphere and whether it is too large to score."""
    return requests.withColumn("area_sqm", G.spherical_area(F.col(parts))).withColumn(
        "too_large", F.col("area_sqm") > F.lit(max_sqm))


def request_key(parts: Column, use_case: Column, weights: Column, thresholds: Column, prohibited: Column,
                limit: Column, offset: Column) -> Column:
    """SHA-1 of the canonical request: sorted fields, weights at six decimals."""
    w = F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(weights, lambda k, v: F.round(v, 6)))))
    return F.sha1(F.to_json(F.struct(
        parts.alias("geometry"), limit.alias("limit"), offset.alias("offset"),
        F.array_sort(prohibited).alias("prohibited"), thresholds.alias("thresholds"),
        use_case.alias("use_case"), w.alias("weights"))))


def request_dedupe(requests: DataFrame, key: str = "key", request_id: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """(distinct requests, map of every request to the one that answers it).

    The representative is the least id, so it does not depend on row order.
    """
    reps = requests.groupBy(key).agg(F.min(request_id).alias("answered_by"))
    mapping = requests.select(request_id, key).join(reps, key)
    distinct = requests.join(reps.select(F.col("answered_by").alias(request_id)), request_id, "left_semi")
    return distinct, mapping
