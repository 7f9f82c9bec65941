"""Spelling variants: words one edit apart, by blocked Gram matrices of letter counts.

A word is the vector of how often each letter occurs in it. One replaced code point leaves
a squared distance of two between the vectors, one inserted or deleted code point of one.
So pairs further apart than two are no variants, and the others (letters in another
order are among them) are verified by their edits.

Distances come from matrix products: words of one length are blocks, a block meets itself
and the blocks one longer, and |x|^2 + |y|^2 - 2 * x.y of two blocks is one NumPy product. A
length's block is cut further, without loss: letters belong to ``CLASSES`` classes, and a block
holds words with the same number of letters of each. One edit moves a letter
from one class to another or adds one to a class, so a block meets 6 others of its
length and 4 of the next (for four classes). What is still more than ``BLOCK_WORDS`` words is split by
hash, and each two pieces meet.

Scale: counts are summed in each task before the shuffle, so a word in a third of all rows
is a row per task. After that there are only distinct words. A block's piece is one row of bounded size, and a
task compares two such rows at a time; only verified pairs leave it. The work grows with
the square of a block, so with many more words ``CLASSES`` can be raised: with six a
length has some hundreds to thousands of blocks.

A word's form is its near word of largest count, if that is ``RATIO`` times its own or more
(ties: the smallest in code-point order). Following forms at least doubles the count each
time, so there are no circles, and pointers are doubled until they stand: a handful of joins.

Cases: a null or empty text has no words. Words of any length are counted; long ones make smaller blocks.
Repeated rows count each time. A null ``doc_id`` is written as an empty one in the query's checksums. An empty table gives an
empty result. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import LOWER, UPPER, cut, let_workers_import
from quillspan.sources.tables import read_table

# The words of a text, and the letters they are made of after lower-casing A-Z.
WORD = re.compile(r"[A-Za-zÀ-ÿ]+")
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
_LOWER = str.maketrans(UPPER, LOWER)

#: Letters of each class but the last, which has all others: about as frequent as each other in European languages.
CLASSES = ("eng", "tsha", "iorl")
#: Words of a block's piece, and the letters that they have together.
BLOCK_WORDS, BLOCK_LETTERS = 2048, 1 << 16
#: Distinct words that a task counts before it hands them on.
MEMORY_WORDS = 200_000
#: By how much a form is more frequent.
RATIO = 2


def count_words(docs: DataFrame, change: Callable[[str, str], str] | None = None) -> DataFrame:
    """``word`` and ``n``, its occurrences in all ``text`` of ``docs``. ``change(doc_id, word)`` gives the word to count instead."""
    let_workers_import(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])
            sums.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                here = Counter(WORD.findall((text.as_py() or "").translate(_LOWER)))
                if change is None:
                    sums.update(here)
                else:
                    name = str(doc_id.as_py()) if doc_id.is_valid else ""
                    for word, n in here.items():
                        sums[change(name, word)] += n
                if len(sums) > MEMORY_WORDS:
                    yield handed_on()
        yield handed_on()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: list[str]) -> np.ndarray:
    """How often each of :data:`LETTERS` is in each word."""
    column = np.zeros(256, np.int64)
    column[[ord(c) for c in LETTERS]] = range(len(LETTERS))
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.bincount(rows * len(LETTERS) + column[codes], minlength=len(words) * len(LETTERS))
    return flat.reshape(len(words), len(LETTERS)).astype(np.float32)


def _letters(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` are one edit from those of ``b``: letters of words of one length, those of ``b`` as long or one longer."""
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    front = np.logical_and.accumulate(a == b[:, :length], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= length


def near_in_blocks(a: list[str], b: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Places in two blocks (one, if ``b`` is None) of words one edit apart; the words of a block have one length."""
    x = letter_counts(a)
    y = x if b is None else letter_counts(b)
    # Numbers of letters are whole and products small, so single precision is exact for words of up to some 4000 letters.
    if len(a[0]) > 4000:
        x, y = x.astype(np.float64), y.astype(np.float64)
    gram = x @ y.T
    distance = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * gram
    i, j = np.nonzero((distance > 0.5) & (distance < 2.5))  # words with the same letters aren't one edit apart
    if b is None:
        i, j = i[i < j], j[i < j]
    same = one_edit(_letters(a)[i], _letters(a if b is None else b)[j])
    return i[same], j[same]


def _classes(word: Column) -> Column:
    """A word's letters by class."""
    length = F.length(word)
    inside = [length - F.length(F.translate(word, letters, "")) for letters in CLASSES]
    return F.array(*inside, length - sum(inside[1:], inside[0]))


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of the distinct ``word`` of ``words`` (of :data:`LETTERS`) one edit apart, each once, with ``n_a`` and ``n_b``."""
    let_workers_import(words.sparkSession)
    keyed = words.select("word", "n", _classes(F.col("word")).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("word")).alias("letters"))
    pieces = F.ceil(F.greatest(F.col("words") / BLOCK_WORDS, F.col("letters") / BLOCK_LETTERS)).cast("long")
    sizes = cut(sizes.select("key", pieces.alias("pieces")))
    piece = F.pmod(F.xxhash64("word"), F.col("pieces"))
    blocks = keyed.join(sizes, "key").groupBy("key", piece.alias("piece")).agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("block"))
    blocks = cut(blocks)

    count, key = len(CLASSES) + 1, F.col("key")
    moved = lambda plus, minus: F.array(*(key[k] + (int(k == plus) - int(k == minus)) for k in range(count)))
    # Of two blocks of one length the one with more letters of the earlier class asks, so they meet once.
    meets = [key, *(moved(j, i) for i in range(count) for j in range(i + 1, count)), *(moved(j, None) for j in range(count))]
    asks = blocks.select(F.col("piece").alias("own"), F.col("block").alias("a"), F.posexplode(F.array(*meets)).alias("way", "key"))
    pairs = asks.join(blocks, "key").filter((F.col("way") > 0) | (F.col("own") <= F.col("piece")))
    pairs = pairs.select("a", F.when((F.col("way") > 0) | (F.col("own") < F.col("piece")), F.col("block")).alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch["a"], batch["b"]):
                a, n_a = (left.values.field(k) for k in ("word", "n"))
                b, n_b = (right.values.field(k) for k in ("word", "n")) if right.is_valid else (a, n_a)
                i, j = near_in_blocks(a.to_pylist(), b.to_pylist() if right.is_valid else None)
                i, j = pa.array(i), pa.array(j)
                yield pa.RecordBatch.from_arrays([a.take(i), b.take(j), n_a.take(i), n_b.take(j)], ["a", "b", "n_a", "n_b"])

    return pairs.repartition(F.xxhash64("a", "b")).mapInArrow(compare, "a string, b string, n_a long, n_b long")


def with_forms(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form`` and ``form_n`` (null: none) and ``root`` of distinct words with their counts."""
    words = cut(words)
    pairs = cut(near_pairs(words))
    both = pairs.select(F.col("a").alias("of"), F.col("b").alias("near"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("of").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    found = words.join(best, F.col("word") == F.col("of"), "left")
    form = F.when(-F.col("best.m") >= RATIO * F.col("n"), F.struct(F.col("best.near").alias("w"), (-F.col("best.m")).alias("n")))
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form")))

    # Pointers to a word two, four, ... forms on; those without a form point nowhere.
    now = found.filter("form is not null").select("word", F.col("form.w").alias("root"))
    while True:
        onward = now.select(F.col("word").alias("mid"), F.col("root").alias("next"))
        further = now.join(onward, F.col("root") == F.col("mid"), "left")
        now = cut(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not now.filter("moved").limit(1).count():
            break
        now = now.drop("moved")
    roots = now.select(F.col("word").alias("of"), "root")
    out = found.join(roots, F.col("word") == F.col("of"), "left")
    return out.select("word", "n", "n_near", F.col("form.w").alias("form"), F.col("form.n").alias("form_n"), F.coalesce("root", "word").alias("root"))


def misspelt(doc_id: str, word: str) -> str:
    """One in 97 words of a document, by a checksum of both, loses a code point."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


#: Code points and occurrences that a word of the query has at least.
MIN_LETTERS, MIN_COUNT = 5, 3


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Words of all documents, some with planted errors, with the form that each is a variant of."""
    counted = count_words(read_table(spark, sf_dir, "documents"), misspelt)
    words = counted.filter((F.length("word") >= MIN_LETTERS) & (F.col("n") >= MIN_COUNT))
    return with_forms(words).select("word", "form", "root", "n", "n_near", "form_n")
