"""Revenue reports over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import money
from quillspan.operators.rollup import roll_up, sum_by
from quillspan.sources.tables import read_table


def revenue_by_region(
    lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """Discounted revenue, to the cent, and line count per region of the buying customer."""
    amount = money.discounted(F.col("l_extendedprice"), F.col("l_discount"))
    lines = lineitem.select("l_orderkey", amount.alias("amount")).select(
        "l_orderkey",
        money.whole_units(F.col("amount")).alias("whole"),
        money.remainder(F.col("amount")).alias("rest"),
        F.lit(1).cast("bigint").alias("n_lines"),
    )
    by_order = sum_by(lines, "l_orderkey")
    by_customer = roll_up(by_order, "l_orderkey", orders, "o_orderkey", "o_custkey")
    by_nation = roll_up(by_customer, "o_custkey", customer, "c_custkey", "c_nationkey")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    by_name = roll_up(by_nation, "c_nationkey", places, "n_nationkey", "r_name")
    revenue = F.round(money.to_decimal(F.col("whole"), F.col("rest")), 2).cast("decimal(26,2)")
    return by_name.select("r_name", revenue.alias("revenue"), "n_lines").orderBy("r_name")


def revenue_by_region_from(spark: SparkSession, directory: str) -> DataFrame:
    """:func:`revenue_by_region` over the parquet tables in ``directory``."""
    names = ("lineitem", "orders", "customer", "nation", "region")
    return revenue_by_region(*(read_table(spark, directory, n) for n in names))
