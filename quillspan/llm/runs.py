"""Periodic runs of words: difference-cover LCE queries drive a harmonic grid.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) of at least ``MIN_LENGTH`` and 2 * q words that no neighbouring word extends.

* Grid: a run of period q holds two neighbouring multiples of q, so for every q the pairs
  (k * q, (k + 1) * q) are looked at, some n * ln(n) in all. How far the words agree from
  a pair's places on and before them gives the stretch of period q around it.
* Most pairs differ within ``COVER_SIZE`` words, which are compared directly.
* For the others a longest common extension (LCE) is asked. Only suffixes at the places of a
  difference cover (``COVER`` modulo ``COVER_SIZE``) are sorted, by doubling: two suffixes
  a multiple of ``COVER_SIZE`` apart are both sampled. Any two places meet sampled ones within
  ``COVER_SIZE`` words (the synchronised samples); from there on the LCE is the minimum of the
  neighbours' common prefixes between the two in sorted order, by a sparse table. The
  structure is built once for the words and once for the words reversed, if a pair asks.
* One stretch may be found for a multiple of its period too; the smallest is kept.

Scale: nothing is shuffled, a text is the unit of work, and a task holds one Arrow batch and the
numbers of one text: some 30 a word, and ``PAIRS`` grid pairs at a time. Time is n * log(n).

Cases: a null or empty text has no runs and collapses to the empty text. A text of any
length is searched whole. Repeated rows give equal results, an empty table an empty one.
Runs that tie in start come in the order of their periods. Other columns are kept; input columns named ``runs`` or ``collapsed``
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.common import fresh, let_workers_import
from quillspan.sources.tables import read_table

#: Words of the shortest run.
MIN_LENGTH = 12
# Every difference modulo the size is one of two members of the cover.
COVER, COVER_SIZE = (0, 1, 3, 9), 13
#: Texts of up to so many words share one table of grid pairs; longer ones get theirs in pieces of some ``PAIRS``.
TABLE_WORDS, PAIRS = 1 << 15, 1 << 19

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _synchronise() -> np.ndarray:
    """For two places modulo the size: the least step after which both are in the cover."""
    inside = {c % COVER_SIZE for c in COVER}
    step = lambda a, b: next(d for d in range(COVER_SIZE) if {(a + d) % COVER_SIZE, (b + d) % COVER_SIZE} <= inside)
    return np.array([[step(a, b) for b in range(COVER_SIZE)] for a in range(COVER_SIZE)], np.int64)


SYNCHRONISE = _synchronise()
_MEMBER = np.full(COVER_SIZE, -1, np.int64)
_MEMBER[list(COVER)] = range(len(COVER))


def _named(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Rank of each row in ``order``, equal rows alike."""
    new = np.zeros(len(order), np.int64)
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class Extensions:
    """LCE queries on numbers of 0 or more."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        padded = np.concatenate([words.astype(np.int64), np.full(2 * COVER_SIZE, -1, np.int64)])
        self.windows = np.lib.stride_tricks.sliding_window_view(padded, COVER_SIZE)
        starts = np.arange(0, n, COVER_SIZE)[:, None] + np.array(COVER)
        starts = starts.ravel()
        self.sampled = starts[starts < n]  # a sample's index is its block times the cover's size, plus its member number
        self.rank, levels = self._sort(padded)
        self.lcp = self._common_prefixes(levels)
        self.table = self._sparse(self.lcp)

    def _sort(self, padded: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Ranks of the sampled suffixes, and those by their first 13, 26, 52, ... words."""
        bits = max(1, int(padded.max() + 1).bit_length())
        held, keys = 62 // bits, []
        for first in range(0, COVER_SIZE, held):
            key = np.zeros(len(self.sampled), np.int64)
            for k in range(first, min(first + held, COVER_SIZE)):
                key = (key << bits) | (padded[self.sampled + k] + 1)
            keys.append(key)
        rank = _named(np.lexsort(keys[::-1]), *keys)
        levels, blocks, m = [rank], 1, len(rank)
        while m and rank.max() < m - 1:
            after = np.zeros(m, np.int64)
            reach = blocks * len(COVER)
            after[: max(0, m - reach)] = rank[reach:] + 1
            key = rank * (m + 1) + after
            rank = _named(np.argsort(key, kind="stable"), key)
            levels.append(rank)
            blocks *= 2
        return rank, levels

    def _common_prefixes(self, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each sampled suffix shares with the one before it in sorted order."""
        m = len(self.rank)
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        a, b = order[:-1].copy(), order[1:].copy()
        blocks = np.zeros(max(0, m - 1), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            inside = np.nonzero((a < m) & (b < m))[0]
            same = inside[levels[level][a[inside]] == levels[level][b[inside]]]
            step = 1 << level
            blocks[same] += step
            a[same] += step * len(COVER)
            b[same] += step * len(COVER)
        # Where a suffix has ended, the next word differs; the windows are padded for it.
        at = lambda k: np.minimum(self._place(k), self.n)
        rest = self._first_difference(at(a), at(b))
        return np.concatenate([np.zeros(min(1, m), np.int64), blocks * COVER_SIZE + rest])

    @staticmethod
    def _place(index: np.ndarray) -> np.ndarray:
        return index // len(COVER) * COVER_SIZE + np.array(COVER)[index % len(COVER)]

    @staticmethod
    def _sparse(values: np.ndarray) -> np.ndarray:
        """Row k has the minimum of 2 ** k values from each place on."""
        rows = [values]
        while 2 << (len(rows) - 1) <= len(values):
            half, last = 1 << (len(rows) - 1), rows[-1]
            row = last.copy()
            row[:-half] = np.minimum(last[:-half], last[half:])
            rows.append(row)
        return np.stack(rows)

    def _first_difference(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from two places on, ``COVER_SIZE`` at most."""
        same = self.windows[a] == self.windows[b]
        return np.where(same.all(axis=1), COVER_SIZE, same.argmin(axis=1))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from places ``a`` and ``b`` (never equal) on."""
        to_sample = SYNCHRONISE[a % COVER_SIZE, b % COVER_SIZE]
        out = np.minimum(self._first_difference(a, b), to_sample)
        far = np.nonzero((out == to_sample) & (np.maximum(a, b) + to_sample < self.n))[0]
        x, y = a[far] + to_sample[far], b[far] + to_sample[far]
        index = lambda p: p // COVER_SIZE * len(COVER) + _MEMBER[p % COVER_SIZE]
        x, y = self.rank[index(x)], self.rank[index(y)]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out[far] += np.minimum(self.table[k, low], self.table[k, high - (1 << k)])
        return out


_table: list[np.ndarray] = []


def _pair_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid pairs of ``n`` words: all (j - q, j) with q a divisor of j. Those of fewer words are the first ones of more."""
    if not _table or _table[2].size <= n:
        size = min(TABLE_WORDS, max(1024, 1 << n.bit_length()))
        periods = np.repeat(np.arange(1, size), [(size - 1) // q for q in range(1, size)])
        upper = np.concatenate([np.arange(q, size, q) for q in range(1, size)])
        order = np.argsort(upper, kind="stable")
        upper, periods = upper[order], periods[order]
        _table[:] = [(upper - periods).astype(np.int32), upper.astype(np.int32), np.searchsorted(upper, np.arange(size + 1))]
    end = _table[2][n]
    return _table[0][:end], _table[1][:end]


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (k * q, (k + 1) * q) of ``n`` words for every period q, in pieces."""
    if n <= TABLE_WORDS // 2:
        yield _pair_table(n)
        return
    first = 1
    while first <= n // 2:
        many = max(1, PAIRS * first // n)
        periods = np.arange(first, min(first + many, n // 2 + 1))
        counts = (n - 1) // periods
        q = np.repeat(periods, counts)
        k = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield k * q, (k + 1) * q
        first += many


def runs_of(words: np.ndarray, least: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period), by start and then period, of the runs of numbers of 0 or more."""
    n = len(words)
    none = np.zeros((0, 3), np.int64)
    if n < max(2, least):
        return none
    # One before the first word, as many after the last as are compared directly; no two of these or of the words are alike.
    margin = COVER_SIZE
    held = np.concatenate([-2 - np.arange(margin), words.astype(np.int64), -2 - margin - np.arange(margin)])
    onward = np.lib.stride_tricks.sliding_window_view(held, COVER_SIZE)
    extend: list[Extensions] = []
    found = none
    for i, j in _grid(n):
        at = np.nonzero(words[i] == words[j])[0]
        i, j = i[at].astype(np.int64), j[at].astype(np.int64)
        beside = (held[i + margin + 1] == held[j + margin + 1]) | (held[i + margin - 1] == held[j + margin - 1])
        i, j = i[beside], j[beside]
        if not len(i):
            continue
        same = onward[i + margin] == onward[j + margin]
        after = np.where(same.all(axis=1), COVER_SIZE, same.argmin(axis=1))
        same = onward[i][:, ::-1] == onward[j][:, ::-1]
        before = np.where(same.all(axis=1), COVER_SIZE, same.argmin(axis=1))
        for side, counts in enumerate((after, before)):
            long = np.nonzero(counts == COVER_SIZE)[0]
            # Before the first word there is nothing that agrees, so a place that is asked for lies inside.
            if len(long):
                if not extend:
                    extend = [Extensions(words), Extensions(words[::-1])]
                counts[long] = extend[side](*((i[long], j[long]) if side == 0 else (n - i[long], n - j[long])))
        q = j - i
        good = (after + before >= q) & (after + before + q >= least)
        new = np.stack([(i - before)[good], (after + before + q)[good], q[good]], axis=1)
        found = _smallest_periods(np.concatenate([found, new]))
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _smallest_periods(rows: np.ndarray) -> np.ndarray:
    """Of the rows with one start and length that with the smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def collapse(text: bytes | None) -> tuple[np.ndarray, bytes]:
    """A text's runs, and its words, joined by a space, without those behind the first period of any run."""
    words = text.split() if text else []
    ids = dict(zip(dict.fromkeys(words), range(len(words))))
    numbers = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    runs = runs_of(numbers)
    if not len(runs):
        return runs, b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    kept = np.nonzero(np.cumsum(edges[:-1]) == 0)[0]
    return runs, b" ".join([words[i] for i in kept.tolist()])


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period) in words, and ``collapsed``, the text without repeats."""
    let_workers_import(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    raw = fresh(docs, "raw")
    row = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("runs", T.ArrayType(row)), T.StructField("collapsed", T.StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for value in batch.column(len(kept)):
                runs, collapsed = collapse(value.as_py())
                found.append(runs)
                texts.append(collapsed)
            rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])])
            parts = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(_RUNS.value_type))
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)
            columns = [*batch.columns[: len(kept)], runs, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "runs", "collapsed"])

    return docs.select(*kept, F.col(text).cast("binary").alias(raw)).mapInArrow(search, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text of a document; one in ten by a checksum of its id repeats a stretch of its words up to the end.

    A document with a null id is left as it is.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        first = F.pmod(g, F.greatest(n, F.lit(1)))
        period = 1 + F.call_function("div", n - first, 3 + F.pmod(g, F.lit(8)))

        def from_places(s: Column) -> Column:
            a, p = s["first"], s["period"]
            place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
            return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i))), " ")

        made = F.transform(F.array(F.struct(first.alias("first"), period.alias("period"))), from_places)[0]
        return F.when(n > 0, made).otherwise("")

    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs and collapsed text of every document, some with planted repeats."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    # The greatest length, then the smallest start and period: the largest of their negatives.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-best["s"]).alias("start"), best["n"].alias("length"), (-best["p"]).alias("period"),
        F.call_function("div", 1000 * best["n"], -best["p"]).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
