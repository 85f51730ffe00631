"""Land affordability from county price data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsieve import constants as K


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def round_half_away(c: Column, digits: int) -> Column:
    """Rounded as doubles are in SQL: scaled, to the nearest whole number, and back.

    ``round(c, digits)`` goes by the decimal text of ``c``, so that -29.849999999999998 gives -29.8 there and -29.9 here.
    """
    scale = float(10**digits)
    return F.round(c * F.lit(scale), 0) / F.lit(scale)


def affordability_score(median: Column) -> Column:
    """1 at the cheap end of the domain, 0 at the dear end; unknown stays NULL."""
    lo, hi = K.AFFORDABILITY_LOW_USD, K.AFFORDABILITY_HIGH_USD
    ok = median.isNotNull() & ~F.isnan(median.cast("double")) & (F.abs(median) != F.lit(float("inf")))
    return F.when(ok, F.lit(1.0) - clamp01((median - F.lit(lo)) / F.lit(hi - lo)))


def affordability_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), "unknown").when(score >= 0.6, "affordable")
        .when(score >= 0.35, "moderate").otherwise("expensive"))


def affordability_blend(score: Column, affordability: Column, weight: Column | None = None) -> Column:
    """Convex blend to one decimal; keeps the order within one area.

    An affordability that is missing, not finite or outside 0..1 fails the query.
    """
    w = clamp01(F.coalesce(weight, F.lit(K.AFFORDABILITY_WEIGHT)) if weight is not None else F.lit(K.AFFORDABILITY_WEIGHT))
    fit = F.coalesce((affordability >= 0) & (affordability <= 1), F.lit(False))
    share = F.when(fit, affordability).otherwise(F.raise_error(F.lit("affordability must be a number in [0, 1]")).cast("double"))
    return round_half_away((F.lit(1.0) - w) * score + w * F.lit(100.0) * share, 1)


def median_value_parse(responses: DataFrame, body: str = "body", year: str = "year", key: str = "county") -> DataFrame:
    """Array-of-arrays responses -> newest usable vintage per county.

    A response without a readable value is passed over for an older one; an
    explicit no-estimate value ends the search with nothing.
    """
    rows = F.from_json(F.col(body), "array<array<string>>")
    # get() yields NULL past the end, so a header-only response is passed over.
    value = F.get(F.get(rows, F.lit(1)), F.lit(0)).try_cast("double").cast("long")
    best = (
        responses.withColumn("v", value).filter("v is not null")
        .groupBy(key).agg(F.max(F.struct(F.col(year).alias("y"), "v")).alias("b")))
    return best.filter(F.col("b.v") > K.CENSUS_NO_ESTIMATE).select(
        key, F.col("b.v").alias("median_home_value_usd"), F.concat(F.col("b.y").cast("string"), F.lit(" ACS 5-year")).alias("acs_vintage"))


def price_series_parse(responses: DataFrame, body: str = "body", key: str = "county") -> DataFrame:
    """Observation lists -> (county, date, value); ".", blank and missing are left out."""
    obs = F.from_json(F.col(body), "observations array<struct<date:string,value:string>>")["observations"]
    return (
        responses.select(key, F.inline(obs)).filter((F.col("value") != ".") & (F.col("value") != ""))
        .withColumn("value", F.col("value").try_cast("double")).filter("value is not null"))


def price_yoy(series: DataFrame, key: str = "county") -> DataFrame:
    """Latest observation (two decimals) and its change in percent (one decimal) against the one before.

    Two ordered picks per county through aggregation, so a long series is never
    gathered in one place.
    """
    top = series.groupBy(key).agg(F.max(F.struct("date", "value")).alias("last"))
    joined = series.join(top, key)
    prev = joined.filter(F.col("date") < F.col("last.date")).groupBy(key).agg(F.max(F.struct("date", "value")).alias("prev"))
    out = top.join(prev, key, "left")
    change = (F.col("last.value") - F.col("prev.value")) / F.nullif(F.col("prev.value"), F.lit(0.0)) * 100.0
    return out.select(key, F.col("last.date").alias("as_of"), round_half_away(F.col("last.value"), 2).alias("hpi_index"), round_half_away(change, 1).alias("yoy_pct"))


def affordability_summary(medians: DataFrame, trends: DataFrame, key: str = "county") -> DataFrame:
    """One record per county from both sources; one of them is enough."""
    score = affordability_score(F.col("median_home_value_usd"))
    return medians.join(trends, key, "full_outer").select(
        key, "median_home_value_usd", "acs_vintage", "hpi_index", F.col("yoy_pct").alias("price_trend_yoy_pct"),
        F.substring("as_of", 1, 4).alias("hpi_as_of"), score.alias("affordability_score"),
        affordability_band(score).alias("affordability_band"))
