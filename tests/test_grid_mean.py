"""Mean of a grid whose true mean lies on a rounding tie."""

import math

from pyspark.sql import functions as F

from landsieve.operators import quality as QL


def mean(grid):
    return QL.grid_mean(grid).first()[0]


def test_mean_does_not_depend_on_how_rows_are_dealt(spark):
    # as often 4.5 as 6.499 and all thousandths between: the mean is 5.4995 to the last digit
    grid = spark.range(120_000).select((F.lit(4.5) + F.col("id") * 17 % 2000 / F.lit(1000.0)).alias("avg_ghi"))
    assert {mean(grid.repartition(n)) for n in (1, 3, 8, 48)} == {5.4995}
    assert math.floor(mean(grid) * 1e3 + 0.5) == 5500


def test_mean_of_other_values_is_the_plain_one(spark):
    of = lambda *v: mean(spark.createDataFrame([(x,) for x in v], "avg_ghi double"))
    assert of(1.0, None, 2.0) == 1.5 and of(1e300, 3e300) == 2e300 and math.isclose(of(2e-30, 4e-30), 3e-30)
    assert math.isnan(of(1.0, float("nan"))) and of(1.0, float("inf")) == float("inf")
    assert of(None) is None and of() is None
