from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillspan.functions import money


def split_sum(df):
    amount = money.discounted(F.col("price"), F.col("discount"))
    parts = df.select(money.whole_units(amount).alias("w"), money.remainder(amount).alias("r"))
    return parts.agg(money.to_decimal(F.sum("w"), F.sum("r")).alias("total")).first().total


def exact_sum(rows):
    known = [(p, d) for p, d in rows if p is not None and d is not None]
    return sum((Decimal(str(p)) * (1 - Decimal(str(d))) for p, d in known), Decimal(0)) if known else None


@pytest.mark.parametrize(
    "rows",
    [
        [(0.1, 0.07), (0.29, 0.0), (1.15, 0.1), (104999.91, 0.03)],
        [(-0.01, 0.5), (-12.34, 0.01), (12.33, 0.02)],
        [(None, 0.1), (5.05, None), (2.2, 0.05)],
        [(None, 0.1), (None, None)],
        [(9_000_000_000_000.25, 0.01)] * 3,
        [(7.77, 1.0), (7.77, 0.0)],
    ],
)
def test_sum_is_exact(spark, rows):
    df = spark.createDataFrame(rows, "price double, discount double")
    assert split_sum(df) == exact_sum(rows)


def test_total_beyond_one_bigint_of_ten_thousandths(spark):
    rows = [(900_000_000_000_000.0, 0.0)] * 3
    df = spark.createDataFrame(rows, "price double, discount double")
    assert split_sum(df) == Decimal("2700000000000000")
    assert 2_700_000_000_000_000 * money.SCALE > 2**63


def test_every_hundredth_survives_the_double(spark):
    cents = spark.range(0, 3_000_000).select((F.col("id") / 100).alias("price"), F.lit(0.0).alias("discount"), "id")
    off = cents.filter(money.discounted(F.col("price"), F.col("discount")) != F.col("id") * 100)
    assert off.count() == 0


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize(
    ("price", "discount"),
    [(100.0, 0.125), (100.0, 0.025), (100.0, 0.045), (0.125, 0.0), (float("nan"), 0.0), (float("inf"), 0.0), (-float("inf"), 0.0),
     (1e16, 0.0), (-1e16, 0.0), (9.0e14 + 0.125, 0.0), (1.0, float("nan")), (1.0, 1.01), (1.0, -0.01)],
)
def test_what_cannot_be_summed_exactly_raises(spark, ansi, price, discount):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="is not a whole hundredth"):
            split_sum(spark.createDataFrame([(price, discount)], "price double, discount double"))
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_large_whole_prices_are_exact(spark):
    rows = [(900_000_000_000_001.0, 0.0), (-(2.0**46) - 1, 0.5)]
    assert split_sum(spark.createDataFrame(rows, "price double, discount double")) == exact_sum(rows)
