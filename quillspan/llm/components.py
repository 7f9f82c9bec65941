"""Connected components of a table of links, by alternating star contractions.

Each round hangs every node's larger neighbours on its smallest one (large star), then
every node's smaller neighbours on the smallest (small star). Links never outnumber
those before, and after a logarithmic number of rounds every node hangs on the smallest
of its component. A hub is safe: its minimum is reduced in each task before the shuffle,
and the join that hands it out has one row for the hub on the other side, so adaptive
execution can split the hub's rows.

Links are far fewer than rows in most tables, and there are many small steps, of which the
driver keeps every task's figures. So each star is written before the next one reads it
several times, a round's tasks are as many as its links need, and the rounds end
when all links are stars, without one more that changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import cut

#: Links to a task, and tasks that there may be at any rate.
TASK_LINKS, TASKS = 20_000, 8


def _large_star(links: DataFrame, write: Callable[[DataFrame], DataFrame], tasks: int) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    # Written first, so that both sides come to the join straight from a shuffle and a hub's rows can be split there.
    hung = both.filter("v > u").join(write(least.coalesce(tasks)), F.col("u") == F.col("w"))
    return hung.select(F.col("v").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)


def _small_star(links: DataFrame, tasks: int) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least.select(F.col("a").alias("w"), "m"), F.col("a") == F.col("w")).filter("b > m")
    hung = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
    return hung.coalesce(tasks).distinct().coalesce(tasks)


def _unsettled(links: DataFrame, tasks: int | None) -> tuple[int, int]:
    """How many links there are, and how many nodes hang on several others or on one that hangs itself."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    if tasks is not None:
        nodes = nodes.coalesce(tasks)
    moves = F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
    return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), moves).first())


def components(links: DataFrame, write: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for all nodes but the roots.

    ``links`` has columns a and b of one ordered type; the order within a link, repeats
    and links of a node with itself don't matter. ``write`` keeps what a round has made.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = write(links.filter("a <> b").select(larger, smaller).distinct())
    tasks = None  # not known yet
    while True:
        count, moves = _unsettled(now, tasks)
        if not moves:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        tasks = max(TASKS, -(-count // TASK_LINKS))
        now = write(_small_star(write(_large_star(now.coalesce(tasks), write, tasks)), tasks))
