"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is a vector of terms of three kinds: runs of four character shapes (lower case, upper case,
digit, or the sign itself; letters of one case in a row are one), byte trigrams, both
hashed to a fixed number of classes, and counts of repeats (words like the one or two before, lines and words
seen earlier). A term weighs the square root of its share of its kind, times its inverse
document frequency over all documents. The leading ``SIZE`` principal directions of the labelled
vectors give the latent space.

The labelled vectors are broadcast. Each document's cosine to every one of them is computed exactly, in
blocks of ``BLOCK`` documents by one matrix product each; the ``NEIGHBOURS`` most similar ones
vote with their label, weighted by similarity to the power ``SHARPNESS``, and ``PRIOR`` votes
go to the labels' mean.

Scale: texts are read twice, for document frequencies and for scores; a task's frequencies are summed before the shuffle,
so at most ``TERMS`` numbers leave it. Fitting takes at most ``FIT_ROWS`` labelled texts, a
documented bound: the texts of least hash, each distinct text once with its mean label. Their vectors come to the
driver (some 5 kB each), which finds the directions; some 4 MB are broadcast, whatever the size of the
data. Nothing about the scored documents is shuffled.

Cases: a null text is an empty one, whose vector is that of no terms; it is scored like
any other. Texts of any length are read whole. Rows that repeat an id are each scored by their own text; a label
of a repeated id holds for each text of that id. Several labels of one id, or of one text, count by their mean, null labels not at
all. A null id has no label. Ties in similarity are broken by the order of the texts' hashes.
Without labels every score is 0.5. Empty tables give empty results. Other columns are kept; an input column
named ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import cut, let_workers_import
from quillspan.sources.tables import read_table

#: Labelled texts that the classifier is fitted on at most.
FIT_ROWS = 8192
#: Directions of the latent space, and rounds in which they are refined.
SIZE, ROUNDS = 48, 4
#: Voters, by what power of their similarity they vote, and votes for the labels' mean.
NEIGHBOURS, SHARPNESS, PRIOR = 24, 4, 0.5
#: Documents whose similarities are computed at a time.
BLOCK = 256

#: Classes of each kind of term, and the kinds' weights.
SHAPES, TRIGRAMS, REPEATS = 2048, 2048, 5
WEIGHTS = np.repeat(np.array([1.0, 0.6, 1.0], np.float32), [SHAPES, TRIGRAMS, REPEATS])
TERMS = SHAPES + TRIGRAMS + REPEATS

# Signs with a shape of their own; other bytes below 128 share one, those from 128 on count as lower case.
_SIGNS = b" \n.,;:!?'\"()-_#*$%&|<>@/=+"
_OTHER, _LOWER, _UPPER, _DIGIT = 28, 29, 30, 31


def _shape_table() -> bytes:
    table = bytearray([_OTHER]) * 128 + bytearray([_LOWER]) * 128
    for i, sign in enumerate(_SIGNS):
        table[sign] = i
    for first, last, shape in (("a", "z", _LOWER), ("A", "Z", _UPPER), ("0", "9", _DIGIT)):
        table[ord(first) : ord(last) + 1] = bytes([shape]) * (ord(last) - ord(first) + 1)
    return bytes(table)


_SHAPE = _shape_table()
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\n\t", b"abcdefghijklmnopqrstuvwxyz  ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashed(numbers: np.ndarray, classes: int) -> np.ndarray:
    """How many of ``numbers`` fall into each class."""
    mixed = (numbers.astype(np.uint64) * _MIX) >> np.uint64(40)
    return np.bincount((mixed % np.uint64(classes)).astype(np.int64), minlength=classes)


def term_counts(text: bytes | None) -> np.ndarray:
    """How often each term is in a text."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    shapes = np.frombuffer(text.translate(_SHAPE), np.uint8)
    again = np.zeros(len(shapes), bool)
    again[1:] = (shapes[1:] == shapes[:-1]) & (shapes[1:] >= _LOWER)
    s = shapes[~again].astype(np.int64)
    if len(s) >= 4:
        out[:SHAPES] = _hashed((((s[:-3] << 5 | s[1:-2]) << 5 | s[2:-1]) << 5) | s[3:], SHAPES)
    b = np.frombuffer(text.translate(_FOLD), np.uint8).astype(np.int64)
    if len(b) >= 3:
        out[SHAPES : SHAPES + TRIGRAMS] = _hashed((b[:-2] << 8 | b[1:-1]) << 8 | b[2:], TRIGRAMS)
    words, lines = text.split(), text.split(b"\n")
    near = sum(map(bytes.__eq__, words, words[1:])), sum(map(bytes.__eq__, words, words[2:]))
    seen = len(words) - len(set(words)), len(lines) - len(set(lines))
    out[SHAPES + TRIGRAMS :] = *near, *seen, len(words)
    return out


def _shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of the terms' shares of their kind, for rows of counts."""
    out, first = np.empty_like(counts), 0
    for kind in (SHAPES, TRIGRAMS, REPEATS):
        part = counts[:, first : first + kind]
        total = part[:, -1:] if kind == REPEATS else part.sum(axis=1, keepdims=True)  # repeats are shares of the words
        out[:, first : first + kind] = np.sqrt(part / np.maximum(total, 1))
        first += kind
    return out * WEIGHTS


class Model(NamedTuple):
    """``idf`` per term, ``mean`` and ``basis`` (terms by directions), the labelled unit ``vectors`` and their ``labels``."""

    idf: np.ndarray
    mean: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, texts: list[bytes | None]) -> np.ndarray:
        """Unit vectors of texts."""
        terms = _shares(np.stack([term_counts(t) for t in texts])) * self.idf
        return _unit((terms - self.mean) @ self.basis)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Weighted share of the neighbours' labels."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.empty(len(texts))
        for first in range(0, len(texts), BLOCK):
            block = self.latent(texts[first : first + BLOCK])
            out[first : first + BLOCK] = vote(block @ self.vectors.T, self.labels)
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def vote(cosines: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Scores from cosines (rows: texts, columns: labelled vectors)."""
    k = min(NEIGHBOURS, len(labels))
    voters = np.argpartition(-cosines, k - 1, axis=1)[:, :k] if k < len(labels) else np.broadcast_to(np.arange(k), (len(cosines), k))
    weights = np.maximum(np.take_along_axis(cosines, voters, axis=1), 0).astype(np.float64) ** SHARPNESS
    return ((weights * labels[voters]).sum(axis=1) + PRIOR * labels.mean()) / (weights.sum(axis=1) + PRIOR)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of the rows of ``text``, and of those with each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for text in batch["text"]:
                sums[:TERMS] += term_counts(text.as_py()) > 0
                sums[TERMS] += 1
        used = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["term", "n"])

    counted = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "term long, n long")
    out = np.zeros(TERMS + 1, np.int64)
    for row in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():  # TERMS rows at most
        out[row["term"]] = row["n"]
    return int(out[TERMS]), out[:TERMS]


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``mark``, ``label`` and ``text`` of at most ``most`` distinct texts of ``docs`` with their mean ``label``."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    per_id = labels.filter("label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    marks = docs.select("doc_id", mark.alias("mark")).join(per_id, "doc_id")
    marks = cut(marks.groupBy("mark").agg(F.avg("label").alias("label"), F.min("doc_id").alias("doc_id")))
    total = marks.count()
    order = F.xxhash64("mark", F.lit(5))
    # A share by hash first, so that no task orders more than some hundreds above what is taken.
    share = 1.0 if total <= most else 1.1 * most / total
    few = marks.filter(F.pmod(order, F.lit(1 << 32)) <= F.lit(int(min(1.0, share) * (1 << 32)))).orderBy(order).limit(most)
    chosen = F.broadcast(cut(few.select(F.col("doc_id").alias("of"), F.col("mark").alias("m"), "label")))  # ``most`` rows of 24 bytes
    found = docs.select("doc_id", "text", mark.alias("mark")).join(chosen, (F.col("doc_id") == F.col("of")) & (F.col("mark") == F.col("m")))
    return found.groupBy("mark").agg(F.any_value("label").alias("label"), F.any_value("text").alias("text"))


def directions(rows: list[tuple[np.ndarray, np.ndarray]], mean: np.ndarray, size: int = SIZE, rounds: int = ROUNDS) -> np.ndarray:
    """Leading principal directions of sparse ``rows`` (terms and values), by subspace iteration in blocks."""
    basis = np.random.default_rng(7).normal(size=(len(mean), size + 8)).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(basis)
        made = np.zeros(basis.shape, np.float64)
        for first in range(0, len(rows), BLOCK):
            block = _dense(rows[first : first + BLOCK], len(mean)) - mean
            made += block.T @ (block @ basis)
        basis = made.astype(np.float32)
    left, _, _ = np.linalg.svd(basis, full_matrices=False)
    return left[:, :size].astype(np.float32)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    for i, (at, values) in enumerate(rows):
        out[i, at] = values
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """The classifier for ``text`` of ``docs``, from ``doc_id`` and ``label`` (0 to 1) of ``labels``."""
    let_workers_import(docs.sparkSession)
    n, found = document_frequencies(docs)
    idf = np.log1p(n / (1.0 + found)).astype(np.float32)

    @F.pandas_udf("at binary, of binary")
    def sparse(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for t in batch:
                shares = _shares(term_counts(t)[None, :])[0]
                at = np.nonzero(shares)[0].astype(np.uint16)
                out.append((at.tobytes(), shares[at].tobytes()))
            yield pd.DataFrame(out, columns=["at", "of"])

    sample = labelled_texts(docs, labels, most).select("mark", "label", sparse(F.col("text").cast("binary")).alias("terms"))
    taken = sorted(sample.select("mark", "label", "terms.*").collect(), key=lambda r: r["mark"])  # ``most`` rows
    rows = [(at := np.frombuffer(r["at"], np.uint16), np.frombuffer(r["of"], np.float32) * idf[at]) for r in taken]
    mean = np.zeros(TERMS, np.float64)
    for at, values in rows:
        mean[at] += values
    mean = (mean / max(1, len(rows))).astype(np.float32)
    basis = directions(rows, mean) if rows else np.zeros((TERMS, SIZE), np.float32)
    blocks = [(_dense(rows[i : i + BLOCK], TERMS) - mean) @ basis for i in range(0, len(rows), BLOCK)]
    vectors = _unit(np.concatenate([np.zeros((0, basis.shape[1]), np.float32), *blocks]))
    return Model(idf, mean, basis, vectors, np.array([r["label"] for r in taken], np.float64))


def with_score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, from 0 to 1."""
    let_workers_import(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(shared.value.scores(list(batch)), dtype="float64")

    kept = [c for c in docs.columns if c.lower() != "score"]
    return docs.select(*kept, score(F.col(text).cast("binary")).alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is not learnt from; a null id is not held out (and has no label)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: From which score on a document is good.
GOOD = 0.7


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = with_score(docs, model)
    predicted = (F.col("score") >= GOOD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)
