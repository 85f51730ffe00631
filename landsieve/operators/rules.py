"""Zoning rules: which zone code permits which use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landsieve import constants as K
from landsieve.operators.joins import lookup_join

COLUMNS = ["zone_code", "zone_name", "use_case", "permission", "basis"]


def use_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u,) for u in K.ZONING_USE_CASES], "use_case string")


def required_pairs(zones: DataFrame) -> DataFrame:
    """Every present zone code with each of the four use cases."""
    return zones.select("zone_code").distinct().withColumn(
        "use_case", F.explode(F.array(*[F.lit(u) for u in K.ZONING_USE_CASES])))


def rules_gap_fill(zones: DataFrame, rules: DataFrame) -> DataFrame:
    """One rule per present code and use; gaps get the cautious default, flagged in ``basis``."""
    names = rules.groupBy("zone_code").agg(F.min("zone_name").alias("zone_name"))
    curated = rules.select("zone_code", "use_case", "permission", "basis")
    return (
        lookup_join(lookup_join(required_pairs(zones), curated, ["zone_code", "use_case"]), names, ["zone_code"])
        .select("zone_code", F.coalesce("zone_name", F.lit("")).alias("zone_name"), "use_case",
                F.coalesce("permission", F.lit(K.ZONING_DEFAULT_PERMISSION)).alias("permission"),
                F.when(F.col("permission").isNull(), F.lit(K.ZONING_DEFAULT_BASIS)).otherwise(F.col("basis")).alias("basis"))
    )


def rules_gaps(zones: DataFrame, rules: DataFrame) -> DataFrame:
    return required_pairs(zones).join(rules.select("zone_code", "use_case"), ["zone_code", "use_case"], "left_anti")


def rules_pivot(rules: DataFrame) -> DataFrame:
    """Codes per use case and permission."""
    return rules.groupBy("use_case", "permission").agg(F.array_sort(F.collect_set("zone_code")).alias("codes"))


def rules_lenient(rules: DataFrame) -> DataFrame:
    """Trim; leave out rows with a blank code, use or permission."""
    t = rules.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ["zone_code", "use_case", "permission"]])
    return t.filter("zone_code <> '' and use_case <> '' and permission <> ''")


def rules_validate(rules: DataFrame) -> DataFrame:
    """Problems with their position (``line``): blank, unknown value, duplicate."""
    t = rules.select("line", *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ["zone_code", "use_case", "permission"]])
    first = t.groupBy("zone_code", "use_case").agg(F.min("line").alias("first"), F.count("*").alias("n")).filter("n > 1")
    marked = lookup_join(t, first, ["zone_code", "use_case"])
    problem = (
        F.when((F.col("zone_code") == "") | (F.col("use_case") == ""), "empty zone_code or use_case")
        .when(~F.col("permission").isin(K.ZONING_PERMISSIONS), "unknown permission")
        .when(~F.col("use_case").isin(K.ZONING_USE_CASES), "unknown use case")
        .when(F.col("line") > F.col("first"), "duplicate rule"))
    return marked.withColumn("problem", problem).filter("problem is not null").select("line", "zone_code", "use_case", "permission", "problem")


def prohibited_join(parcels: DataFrame, rules: DataFrame, use_case: str) -> DataFrame:
    """Add ``excl_zoning``: the parcel's zone is prohibited for the use. Never NULL."""
    codes = rules.filter((F.col("use_case") == use_case) & (F.col("permission") == "prohibited")).select(
        F.col("zone_code").alias("zoning_class"), F.lit(True).alias("_p")).distinct()
    return lookup_join(parcels, codes, ["zoning_class"]).withColumn(
        "excl_zoning", F.coalesce("_p", F.lit(False))).drop("_p")


def distinct_codes(zones: DataFrame) -> DataFrame:
    return zones.select("zone_code").distinct()


def distinct_sorted(rules: DataFrame) -> DataFrame:
    """The zone codes of each use case, each once and in order."""
    return rules.groupBy("use_case").agg(F.array_sort(F.collect_set("zone_code")).alias("codes"))
