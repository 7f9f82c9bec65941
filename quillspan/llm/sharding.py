"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``BUCKETS`` places. Every shard owns ``vnodes`` pseudo-random places; a key
hashes to a place and belongs to the first shard at or after it, clockwise. No shard
takes more than its load: a key that meets a full shard continues clockwise to the next
one with room. Loads are the rows shared out evenly, so shard counts differ by one at
most (law ``rows``). Changing the number of shards, or the documents, moves few keys:
most stay with the first shard they meet.

How it is distributed: keys of one place of the ring meet the same shards in the same
order, so the walk needs only the row count of each place. That table has ``BUCKETS``
rows whatever the size of the data, and the driver walks it (places visited in a
pseudo-random order, as keys arriving at random would be). The walk gives pieces "rows
r to s of this place go to shard x, slots from b on"; a row finds its rank within its
place by a window over that place alone. At 1e11 rows a place has about 1.5 million. A place with more than
``WINDOW_ROWS``, such as that of an id which many rows repeat, is several windows, to which its rows are dealt at random; a
window's ranks begin where those before it end.

Only the id, the size and the checksum of a document are shuffled, never its text.

Cases: a null text has size 1 and the checksum of no bytes. A null id is placed by the
text instead, so that many of them spread over the ring. Rows that repeat an id share
its place; rows equal in id, size and checksum are interchangeable. An empty table gives
an empty result. A text of any length only gives its size and checksum. Only the id and text columns are read, so others can't clash.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import broadcast_if_small, cut, fresh
from quillspan.sources.tables import read_table

#: Places of the ring. It bounds what the driver sees and, with the number of rows, the size of a window.
BUCKETS = 65_536
#: Rows of a place that are ranked in one task.
WINDOW_ROWS = 250_000


def place_of(key: Column, seed: int, buckets: int = BUCKETS) -> Column:
    """A key's place on the ring."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets)).cast("int")


def make_ring(shards: int, vnodes: int, seed: int, buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """(place, shard) by place. A shard's places depend on its number alone, so adding one moves none of
    the others'; where two shards fall on one place the lower one holds it."""
    owner: dict[int, int] = {}
    for shard in range(shards):
        rng = random.Random(f"{seed}/{shard}")
        for _ in range(vnodes):
            owner.setdefault(rng.randrange(buckets), shard)
    return sorted(owner.items())


def walk(counts: dict[int, int], shards: int, vnodes: int, seed: int, buckets: int = BUCKETS) -> list[tuple]:
    """Pieces (place, first rank, end rank, shard, first slot) that put each place's rows into shards."""
    ring = make_ring(shards, vnodes, seed, buckets)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    first_at = {}
    at = 0
    for place in range(buckets):
        while at < len(ring) and ring[at][0] < place:
            at += 1
        first_at[place] = at % len(ring)
    pieces = []
    order = sorted(counts)
    random.Random(f"{seed}/order").shuffle(order)
    for place in order:
        rank, left, node = 0, counts[place], first_at[place]
        while left:
            shard = ring[node][1]
            take = min(left, room[shard] - used[shard])
            if take:
                pieces.append((place, rank, rank + take, shard, used[shard]))
                used[shard] += take
                rank += take
                left -= take
            node = (node + 1) % len(ring)
    return pieces


def assign_shards(
    rows: DataFrame, key: Column, order_by: list[str], shards: int, vnodes: int = 256, seed: int = 7, buckets: int = BUCKETS
) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless within the shard). ``order_by`` names columns that
    order the rows of one key; rows equal in them are interchangeable."""
    if shards < 1 or vnodes < 1 or buckets < 2 * shards * vnodes:
        raise ValueError("needs shards and vnodes of 1 or more, and at least twice as many places as both make")
    place, rank = fresh(rows, "place"), fresh(rows, "rank")
    placed = rows.withColumn(place, place_of(key, seed, buckets))
    counts = {r[place]: r["count"] for r in placed.groupBy(place).count().collect()}
    pieces = rows.sparkSession.createDataFrame(
        walk(counts, shards, vnodes, seed, buckets), "piece_place int, piece_from long, piece_to long, shard int, piece_slot long"
    )
    # At most one piece per place and one more for each time that a shard fills up: bounded by BUCKETS + shards.
    hot = {p: -(-n // WINDOW_ROWS) for p, n in counts.items() if n > WINDOW_ROWS}
    window, before = fresh(rows, "window"), fresh(rows, "before")
    if hot:
        windows = rows.sparkSession.createDataFrame(list(hot.items()), "of_place int, windows int")  # BUCKETS rows at most
        dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("windows")).cast("int")
        placed = placed.join(F.broadcast(windows), F.col(place) == F.col("of_place"), "left").withColumn(window, F.coalesce(dealt, F.lit(0)))
        placed = cut(placed.drop("of_place", "windows"))
        sizes = placed.groupBy(place, window).count()
        upto = F.sum("count").over(Window.partitionBy(place).orderBy(window).rowsBetween(Window.unboundedPreceding, 0))
        starts = cut(sizes.select(F.col(place).alias("s_place"), F.col(window).alias("s_window"), (upto - F.col("count")).alias(before)))
        here = (F.col(place) == F.col("s_place")) & (F.col(window) == F.col("s_window"))
        placed = placed.join(broadcast_if_small(starts), here).drop("s_place", "s_window")
    else:
        placed = placed.withColumns({window: F.lit(0), before: F.lit(0)})
    within = Window.partitionBy(place, window).orderBy(F.xxhash64(key, F.lit(seed + 1)), *order_by)
    ranked = placed.withColumn(rank, (F.row_number().over(within) - 1 + F.col(before)).cast("long"))
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    found = ranked.join(
        F.broadcast(pieces),
        (F.col(place) == F.col("piece_place")) & (F.col(rank) >= F.col("piece_from")) & (F.col(rank) < F.col("piece_to")),
    )
    return found.select(*kept, pieces["shard"], (F.col("piece_slot") + F.col(rank) - F.col("piece_from")).alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    facts = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id"), F.xxhash64("text_crc32", "size"))
    placed = assign_shards(facts, key, ["doc_id", "size", "text_crc32"], shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
