"""Quality rules: base limits, then robust multivariate outliers per language and source.

Each document gets a vector of transformed statistics. Per language and source the
minimum-covariance-determinant estimate (the mean and covariance of the three quarters
of the rows that lie closest together) is found by concentration steps from ``STARTS`` starts (the medians,
and random subsets); after ``LEAD`` steps that of the least determinant is followed until it stands. A document
whose Mahalanobis distance from it is beyond a chi-square cutoff is rejected. Junk, as
long as it is under a quarter of a source, does not move the estimate.

The vector, all shrunk towards the language's mean or nought so that short texts don't
stray: log of the mean word length, and the square roots of the shares of symbols, of
repeated lines and of words in repeated windows. Most clean texts have none of the last
three, so each variance gets a floor, about what one symbol, line or window makes in a short text, below which a
deviation means nothing. Where a source's texts spread by more than that, its covariance decides.

Scale: one pass over the texts writes the statistics (six numbers a row) to the
checkpoint folder. A concentration step is one aggregation over them: rows are reduced
in each task to one row per group and distance class (a grid on the log of the distance,
some hundreds of classes), and the classes up to three quarters of the rows are summed.
All rows count; a group that holds a third of them is as many rows as any other after
that. Groups with fewer than ``MIN_GROUP`` rows, too few for a covariance of their own, are pooled over their language, and
those pools that are still too small over all languages. Tables of groups are broadcast only if they
have at most ``BROADCAST_ROWS`` rows.

Cases: a null or empty text has no words and fails the base limits; null language or
source is a value of its own. A text of any length is measured whole. Rows that tie in distance are in the core together or
not at all. Repeated rows count and are judged one by one. Empty tables give empty results.
Input columns travel in one struct, so their names can't clash with any used here.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import BROADCAST_BYTES, broadcast_if_small, cut, let_workers_import
from quillspan.sources.tables import read_table

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
# The base limits, the window of repeated words and the symbols.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"

#: Words, characters and lines that a text is shrunk by.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_LINES = 100, 500, 10
#: Standard deviations that count as none, per entry of the vector.
FLOORS = (0.02, 0.03, 0.1, 0.1)
SIZE = len(FLOORS)
#: Share of rows that the estimate rests on, and rows that a group of its own must have.
CORE, MIN_GROUP = 0.75, 50
#: After how many steps only the start of least determinant is followed.
LEAD = 2
#: Starts, rows of a random one and their least share, the most concentration steps, and the fall of a log determinant that is none.
STARTS, START_ROWS, START_SHARE, STEPS, STANDS = 3, 20, 0.02, 12, 1e-2
#: Rows of statistics (nine numbers each) that a task of the estimate sums.
TASK_ROWS = 100_000
#: Share of clean rows, were they normal, that a group would lose.
REJECT = 1e-7

_PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
_X = [f"x{i}" for i in range(SIZE)]
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows that are found twice or more. Hashes only rule windows out; the rest are compared whole."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = sum((hashes[k : k + n] * _MULTIPLIERS[k] for k in range(1, WINDOW)), hashes[:n])
    _, group, size = np.unique(rolled, return_inverse=True, return_counts=True)
    if len(size) == n:
        return 0
    at = np.nonzero(size[group] > 1)[0].tolist()
    windows = [tuple(words[i : i + WINDOW]) for i in at]
    found = Counter(windows)
    inside = np.zeros(len(words), bool)
    for i, w in zip(at, windows):
        if found[w] > 1:
            inside[i : i + WINDOW] = True
    return int(inside.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """:data:`STATISTICS` of a text."""
    if not text:
        return (0,) * len(STATISTICS)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, SPACE).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def statistics(text: Column) -> Column:
    """Struct of :data:`STATISTICS`."""

    @F.pandas_udf(", ".join(f"{s} long" for s in STATISTICS))
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([measure(t) for t in batch], columns=list(STATISTICS), dtype="int64")

    return measured(text.cast("binary"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def chi_square_beyond(x: float) -> float:
    """Share of a chi-square with ``SIZE`` (an even number of) degrees of freedom beyond ``x``."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(SIZE // 2))


def chi_square_point(beyond: float) -> float:
    """Where the share ``beyond`` begins."""
    low, high = 0.0, 2000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_beyond(middle) > beyond else (low, middle)
    return high


def _consistency() -> float:
    """By how much the covariance of the closest ``CORE`` of normal rows falls short."""
    q = chi_square_point(1 - CORE)
    next_size = 1 - math.exp(-q / 2) * sum((q / 2) ** k / math.factorial(k) for k in range(SIZE // 2 + 1))
    return CORE / next_size


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def _with_keys(rows: DataFrame, lang: Column, source: Column) -> DataFrame:
    return rows.withColumns({"k_lang": _key(lang), "k_source": _key(source)})


def groups_of(stats: DataFrame) -> DataFrame:
    """Per language and source of ``stats``: the group that stands for it (null: none), and the language's mean word length."""
    per_source = stats.filter(~F.col("failed")).groupBy("k_lang", "k_source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("word_chars").alias("chars"), F.sum("n_words").alias("words")
    )
    per_source = cut(per_source)
    small = F.when(F.col("n") < MIN_GROUP, F.col("n")).otherwise(0)
    per_lang = per_source.groupBy("k_lang").agg(
        (F.sum("chars") / F.sum("words")).alias("mean_length"), F.sum(small).alias("pooled")
    )
    group = (
        F.when(F.col("n") >= MIN_GROUP, F.concat_ws("\0", "k_lang", "k_source"))
        .when(F.col("pooled") >= MIN_GROUP, F.col("k_lang"))
        .otherwise("")
    )
    return cut(per_source.join(per_lang, "k_lang").select("k_lang", "k_source", "mean_length", group.alias("group")))


def with_vector(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (keys and statistics) with their group and vector."""
    root_share = lambda part, whole: F.sqrt(F.col(part) / whole)
    joined = rows.join(broadcast_if_small(groups), ["k_lang", "k_source"], "left")
    return joined.withColumns(
        {
            "x0": F.log((F.col("word_chars") + PRIOR_WORDS * F.col("mean_length")) / (F.col("n_words") + PRIOR_WORDS)),
            "x1": root_share("n_symbols", F.col("word_chars") + F.col("n_symbols") + PRIOR_CHARS),
            "x2": root_share("n_dup_lines", F.col("n_lines") + PRIOR_LINES),
            "x3": root_share("n_repeat_words", F.col("n_words") + PRIOR_WORDS),
        }
    )


def squared_distance() -> Column:
    """Mahalanobis distance, squared, from the columns of :func:`with_vector` and of the estimates."""
    off = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(_X)]
    terms = [off[i] * off[j] * F.col(f"p{i}{j}") * (1 if i == j else 2) for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _inverted(sums: DataFrame, factor: float) -> DataFrame:
    """Mean, inverse of ``factor`` times the covariance, and log of its determinant; one row per group and start."""
    floors, pairs, size = np.diag(np.square(FLOORS)), _PAIRS, SIZE
    names = ["group", "start", *(f"m{i}" for i in range(size)), *(f"p{i}{j}" for i, j in pairs), "volume"]

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                n, mean = row.n, np.array(row.first) / row.n
                spread = np.zeros((size, size))
                for (i, j), s in zip(pairs, row.second):
                    spread[i, j] = spread[j, i] = s / n - mean[i] * mean[j]
                covariance = factor * spread + floors
                inverse = np.linalg.inv(covariance)
                out.append((row.group, row.start, *mean, *(inverse[i, j] for i, j in pairs), np.linalg.slogdet(covariance)[1]))
            yield pd.DataFrame(out, columns=names)

    doubles = ", ".join(f"{c} double" for c in names[2:])
    return cut(sums.mapInPandas(invert, f"group string, start int, {doubles}"))


def _sums() -> list[Column]:
    """Number of rows, sums of the entries and of their products."""
    products = [F.sum(F.col(_X[i]) * F.col(_X[j])) for i, j in _PAIRS]
    return [F.count(F.lit(1)).alias("n"), F.array(*map(F.sum, _X)).alias("first"), F.array(*products).alias("second")]


def _start(rows: DataFrame) -> DataFrame:
    """First estimates: medians and no more covariance than the spread around them, and means and covariances of random subsets."""
    grid = lambda c: F.round(c, 3)  # noqa: E731  bounds what an exact median has to remember
    middle = [F.percentile(grid(F.col(x)), 0.5).alias(f"m{i}") for i, x in enumerate(_X)]
    medians = cut(rows.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), *middle))
    around = rows.join(broadcast_if_small(medians), "group")
    spread = [F.percentile(grid(F.abs(F.col(x) - F.col(f"m{i}"))), 0.5) for i, x in enumerate(_X)]
    inverse = {f"p{i}{j}": F.lit(0.0) for i, j in _PAIRS if i != j}
    inverse |= {f"p{i}{i}": 1 / (F.pow(1.4826 * F.col(f"s{i}"), 2) + FLOORS[i] ** 2) for i in range(SIZE)}
    found = around.groupBy("group").agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(SIZE)), *(s.alias(f"s{i}") for i, s in enumerate(spread))
    )
    found = found.withColumns(inverse | {"start": F.lit(0), "volume": F.lit(float("inf"))})
    chance = (F.xxhash64("start", *_X) / F.lit(float(1 << 64))) + 0.5
    share = F.greatest(F.lit(START_SHARE), START_ROWS / F.col("rows"))
    several = around.withColumn("start", F.explode(F.array(*map(F.lit, range(1, STARTS)))))
    others = _inverted(several.filter(chance < share).groupBy("group", "start").agg(*_sums()), 1.0)
    return cut(found.select(others.columns).union(others))


def _concentrated(rows: DataFrame, params: DataFrame) -> DataFrame:
    """The estimates from the ``CORE`` of the rows that are closest by ``params``."""
    near = rows.join(params, "group").select(
        "group", "start", *_X, F.floor(F.log(squared_distance() + 1e-6) * 50).alias("ring")
    )
    rings = near.groupBy("group", "start", "ring").agg(*_sums()[:1], *(F.sum(x).alias(f"a{i}") for i, x in enumerate(_X)), *(
        F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"b{i}{j}") for i, j in _PAIRS
    ))
    by_group = Window.partitionBy("group", "start")
    inner = F.sum("n").over(by_group.orderBy("ring").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    core = rings.withColumns({"inner": inner, "all": F.sum("n").over(by_group)}).filter(F.col("inner") < CORE * F.col("all"))
    sums = core.groupBy("group", "start").agg(
        F.sum("n").alias("n"),
        F.array(*(F.sum(f"a{i}") for i in range(SIZE))).alias("first"),
        F.array(*(F.sum(f"b{i}{j}") for i, j in _PAIRS)).alias("second"),
    )
    return _inverted(sums, _consistency())


def estimate(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates of ``rows`` (columns group and x0 to x3): group, mean, inverse covariance."""
    params = _start(rows)
    small = params.count() * 200 <= BROADCAST_BYTES  # no step adds rows
    for step in range(STEPS):
        last, params = params, _concentrated(rows, F.broadcast(params) if small else params)
        before = last.select("group", "start", F.col("volume").alias("before"))
        fall = params.join(F.broadcast(before) if small else before, ["group", "start"]).agg(F.max(F.col("before") - F.col("volume"))).first()[0]
        if fall is None or fall <= STANDS:
            break
        if step == LEAD - 1:
            params = _least(params)
    return cut(_least(params).drop("start", "volume"))


def _least(params: DataFrame) -> DataFrame:
    """Each group's estimate of least determinant."""
    least = params.groupBy("group").agg(F.min(F.struct(F.round("volume", 6), "start"))["start"].alias("start"))
    return cut(params.join(least, ["group", "start"]))


def _measured(docs: DataFrame) -> DataFrame:
    """Each row's columns in the struct ``doc``, its keys and statistics."""
    let_workers_import(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), statistics(F.col("text")).alias("stat"))
    rows = _with_keys(rows.select("doc", "stat.*"), F.col("doc.lang"), F.col("doc.source"))
    return rows.withColumn("failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))


def _vectors(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Group and vector of the rows that the estimate rests on, in few partitions, so that each sums many rows before the shuffle."""
    few = rows.coalesce(-(-rows.count() // TASK_ROWS) or 1)
    return with_vector(few.filter(~F.col("failed")), groups).filter(F.col("group").isNotNull()).select("group", *_X)


def _judged(rows: DataFrame, groups: DataFrame, params: DataFrame) -> DataFrame:
    found = with_vector(rows, groups).join(broadcast_if_small(params), "group", "left").withColumn("distance", squared_distance())
    far = F.coalesce(F.col("distance") > chi_square_point(REJECT), F.lit(False))
    return found.withColumn("kept", ~F.col("failed") & ~far)


def judge_quality(docs: DataFrame) -> DataFrame:
    """``doc`` (a struct of the columns of ``docs`` other than text), :data:`STATISTICS`, ``failed``, ``distance``
    (squared; null if not judged) and ``kept`` per document."""
    named = docs.select(*(c for c in docs.columns if c in ("doc_id", "text", "lang", "source")))
    rows = cut(_measured(named).withColumn("doc", F.col("doc").dropFields("text")))
    groups = groups_of(rows)
    params = estimate(_vectors(rows, groups))
    return _judged(rows, groups, params)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept. Texts are measured twice rather than shuffled."""
    rows = cut(_measured(docs.select("text", "lang", "source")).drop("doc"))
    groups = groups_of(rows)
    params = estimate(_vectors(rows, groups))
    return _judged(_measured(docs), groups, params).filter("kept").select("doc.*")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    judged = judge_quality(read_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc.doc_id", *STATISTICS[:5], F.col("failed").alias("base_failed"), "kept", F.col("distance").alias("squared_distance")
    )
