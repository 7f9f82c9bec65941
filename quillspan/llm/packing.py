"""Packing documents into sequences: first-fit decreasing in randomised groups.

A document's ids, with an end id after them, are cut into pieces of the sequence length;
full pieces are sequences of their own and the rest are packed. Documents are dealt by a
hash into groups of about ``group_docs``. Within a group the rests go, longest first, into
the first open sequence with room, which a tournament tree finds: its leaves are the room
of each sequence, each inner node the larger of its two, so the leftmost leaf with enough
room is a walk from the root.

Tokens are made once, in the tasks that read the texts; only five numbers per piece are
shuffled. A group holds about as many documents at any size of the data, so the number of
groups grows with it and no task does. At most one sequence per group is left part empty
for want of documents.

Cases: a null or empty text is just its end id. A text of any length is cut into pieces.
Repeated rows are packed one by one. A null id is kept. Documents go to groups by id,
token count, checksum and their number in the task that read them, so ids that many rows repeat spread, over equal texts too. An empty table
gives an empty result. Only the id and text columns are read, so others can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.tokens import as_bytes, share, words_of
from quillspan.sources.tables import read_table

#: Documents of a group: few enough for a task's memory, many enough that a part-empty sequence at the end is nothing.
GROUP_DOCS = 4096
PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


class Room:
    """Tournament tree over the room left in each of up to ``size`` sequences."""

    def __init__(self, size: int, capacity: int):
        self.leaves = 1 << max(0, size - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def first_with(self, need: int) -> int:
        """The first sequence with room for ``need``."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        return node - self.leaves

    def take(self, at: int, need: int) -> int:
        """Use ``need`` of a sequence's room; returns the offset of what was put there last."""
        tree, node = self.tree, at + self.leaves
        left = tree[node] = tree[node] - need
        while node > 1:
            node //= 2
            larger = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == larger:
                break
            tree[node] = larger
        return left


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset there of each piece; pieces of equal length in the order given."""
    order = np.argsort(-lengths, kind="stable")
    room = Room(len(lengths), capacity)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        need = int(lengths[i])
        at = room.first_with(need)
        sequence[i], offset[i] = at, capacity - room.take(at, need) - need
    return sequence, offset


def pack(docs: DataFrame, path: str, capacity: int, end_id: int, group_docs: int = GROUP_DOCS, seed: int = 11) -> DataFrame:
    """One row per piece: the id, :data:`PIECE`, ``sequence_id`` and ``offset``."""
    shared = share(docs.sparkSession, path)
    end = as_bytes([end_id])

    kind = dict(docs.dtypes)["doc_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before = words_of(shared, as_bytes), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for at, found in enumerate(words.values(t.as_py() for t in batch["text"])):
                ids = b"".join([*found, end])
                n = len(ids) // 4
                sums = [zlib.crc32(ids[4 * s : 4 * (s + capacity)]) for s in range(0, n, capacity)]
                rows += [(at, s, min(capacity, n - s), crc, n, sums[0], before + at) for s, crc in zip(range(0, n, capacity), sums)]
            before += batch.num_rows
            columns = np.array(rows, np.int64).reshape(-1, 7).T
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(columns[0])), *(pa.array(c) for c in columns[1:])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "head", "nth"],
            )

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("ids_crc32", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        sequence, offset = first_fit_decreasing(group["length"].to_numpy(), capacity)
        first = group["part"][0].as_py() << 32
        placed = group.drop_columns(["part"])
        return placed.append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))

    parts = max(1, -(-docs.count() // group_docs))
    cut = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(pieces, f"doc_id {kind}, {PIECE}, head long, nth long")
    part = F.pmod(F.xxhash64("doc_id", "doc_tokens", "head", "nth", F.lit(seed)), F.lit(parts))
    return (
        cut.withColumn("part", part)
        .drop("head", "nth")
        .groupBy("part")
        .applyInArrow(fill, f"doc_id {kind}, {PIECE}, sequence_id long, offset long")
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
