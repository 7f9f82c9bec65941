"""Sums carried up a chain of foreign keys, reduced before every shuffle.

Joining a fact table to its dimensions first and grouping last moves every fact
row through every shuffle join, and sends all rows of a hot key to one task.
Grouping on the foreign key before each join avoids both: Spark sums within each
task ahead of the exchange, so a key holding a third of all rows costs one row
per task, and the join after it sees each key once. The grouped side is already
partitioned on the join key, so the join adds no exchange to it.

No broadcast is forced. Spark broadcasts a parent only when its size is under
``spark.sql.autoBroadcastJoinThreshold`` and joins by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_by(df: DataFrame, key: str) -> DataFrame:
    """Sum every column but ``key``, per value of ``key``."""
    sums = [F.sum(c).alias(c) for c in df.columns if c != key]
    return df.groupBy(key).agg(*sums)


def roll_up(sums: DataFrame, key: str, parent: DataFrame, parent_key: str, to: str) -> DataFrame:
    """Sum ``sums`` by the parent's column ``to``.

    ``sums`` holds ``key`` and columns to be summed; bring it down to one row per
    key with :func:`sum_by` first (the result of another ``roll_up`` already is).
    The result equals an inner join on ``key = parent_key`` followed by the sums
    per ``to``, and has ``to`` in place of ``key``.
    """
    lookup = parent.select(F.col(parent_key).alias("_parent_key"), F.col(to).alias("_to"))
    joined = sums.join(lookup, F.col(key) == F.col("_parent_key"))
    carried = [c for c in sums.columns if c != key]
    return sum_by(joined.select(F.col("_to").alias(to), *carried), to)
