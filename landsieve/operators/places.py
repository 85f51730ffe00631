"""Turning free text into search boxes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landsieve import constants as K
from landsieve.functions.cleaning import place_norm

NUMBER = r"[-+]?\d+(?:\.\d+)?"


def numbers_from_text(text: Column) -> Column:
    """All signed numbers in the text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda s: s.try_cast("double"))


def _in_region(lng: Column, lat: Column) -> Column:
    x0, y0, x1, y1 = K.COUNTY_BBOX
    p = K.REGION_PAD_DEG
    return lng.between(x0 - p, x1 + p) & lat.between(y0 - p, y1 + p)


def _box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"))


def numeric_box(nums: Column) -> Column:
    """Box from four numbers (either axis order) or a padded point from two."""
    a, b, c, d = (nums[i] for i in range(4))
    four = (
        F.when(_in_region(a, b) & _in_region(c, d), _box(F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d)))
        .when(_in_region(b, a) & _in_region(d, c), _box(F.least(b, d), F.least(a, c), F.greatest(b, d), F.greatest(a, c)))
    )
    swapped = a.between(34.0, 36.0) & b.between(-121.0, -117.0)
    lng, lat = F.when(swapped, b).otherwise(a), F.when(swapped, a).otherwise(b)
    pad = F.lit(K.PLACE_PAD_DEG)
    two = F.when(_in_region(lng, lat), _box(lng - pad, lat - pad, lng + pad, lat + pad))
    return F.when(F.size(nums) == 4, four).when(F.size(nums) == 2, two)


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, x, y) for n, (x, y) in K.PLACES.items()], "place string, lng double, lat double")


def place_resolve(requests: DataFrame, text: str = "text") -> DataFrame:
    """Add ``box``, ``source`` and ``place``; all NULL when nothing matches.

    Order: numbers, county words, alias or exact name, then the longest place
    name found as whole words. The gazetteer is a fixed list of 21 names, so
    the whole-word search is one alternation per name in a plain projection.
    """
    norm = F.col("_norm")
    alias = F.create_map(*[F.lit(v) for kv in K.PLACE_ALIASES.items() for v in kv])
    centre = F.create_map(*[v for n, (x, y) in K.PLACES.items() for v in (
        F.lit(n), F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")))])
    by_length = sorted(K.PLACES, key=len, reverse=True)
    contained = F.coalesce(*[F.when(norm.rlike(rf"\b{re.escape(n)}\b"), F.lit(n)) for n in by_length])
    exact = F.coalesce(alias[norm], norm)
    pad = F.lit(K.PLACE_PAD_DEG)
    c = centre[F.col("place")]
    x0, y0, x1, y1 = (F.lit(v) for v in K.COUNTY_BBOX)
    return (
        requests.withColumn("_norm", place_norm(F.col(text)))
        .withColumn("_num", numeric_box(numbers_from_text(F.trim(text))))
        .withColumn("_n", F.size(numbers_from_text(F.trim(text))))
        .withColumn("source", F.when(F.col("_num").isNotNull(), F.when(F.col("_n") == 4, "bbox").otherwise("point"))
                    .when(norm.isin(K.COUNTY_ALIASES), "county"))
        .withColumn("place", F.when(F.col("source").isNull(), F.when(F.map_contains_key(centre, exact), exact).otherwise(contained)))
        .withColumn("source", F.coalesce("source", F.when(F.col("place").isNotNull(), "gazetteer")))
        .withColumn("box", F.when(F.col("source").isin("bbox", "point"), F.col("_num"))
                    .when(F.col("source") == "county", _box(x0, y0, x1, y1))
                    .when(F.col("source") == "gazetteer", _box(c["lng"] - pad, c["lat"] - pad, c["lng"] + pad, c["lat"] + pad)))
        .drop("_norm", "_num", "_n")
    )


def area_token(geometry_json: Column) -> Column:
    """Short content hash that names a search area."""
    return F.concat(F.lit("area_"), F.substring(F.sha1(geometry_json), 1, 16))
