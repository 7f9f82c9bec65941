"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from conftest import TESTDATA
from quillspan.llm import spelling as S


def edits(word):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in S.LETTERS}
    return out | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in S.LETTERS if c != word[i]}


def brute_forms(counts):
    near = {w: sorted(e for e in edits(w) if e in counts) for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items())


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def result(frame):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect())


def test_letters_have_classes():
    assert not set("".join(S.CLASSES)) - set(S.LETTERS) and len(set("".join(S.CLASSES))) == len("".join(S.CLASSES))
    assert S.letter_counts(["aab", "ÿ"]).sum(axis=1).tolist() == [3, 1]


@pytest.mark.parametrize("seed, block", [(0, 2048), (1, 7), (2, 1)])
def test_forms_equal_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_WORDS", block)
    rng = random.Random(seed)
    letters = "abeio×ßÿth"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(120)}
    for w in list(words):  # variants, anagrams and chains
        words |= set(rng.sample(sorted(edits(w)), 3)) | {w[::-1]}
    words |= {"a" * 300, "a" * 301, "a" * 299 + "b", "b" + "a" * 299, "a" * 302}
    counts = {w: 2 ** rng.randrange(8) for w in words if w}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert result(S.with_forms(frame)) == brute_forms(counts)


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MEMORY_WORDS", 40)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("etaoinÉé") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary).capitalize() + rng.choice(["", ",", "3x"]) for _ in range(rng.randrange(40)))) for i in range(150)]
    rows += [(None, None), (None, "éclair ÉCLAIR éclair éclairs"), (7, ""), (8, "x" * 5000), *rows[:5]]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = result(S.op12_spelling(spark, str(tmp_path)))
    assert got == brute_forms(brute_counts(rows)) and any(r[1] for r in got)


def test_query_on_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").collect()]
    assert result(S.op12_spelling(spark, f"{TESTDATA}/sf0.001")) == brute_forms(brute_counts(rows))


def test_very_long_words():
    a = ["a" * 5000, "a" * 4999 + "b", "b" + "a" * 4999]
    assert [x.tolist() for x in S.near_in_blocks(a, None)] == [[0, 0], [1, 2]]
    assert [x.tolist() for x in S.near_in_blocks(a, ["a" * 5001, "a" * 5000 + "c", "a" * 4998 + "bab"])] == [[0, 0, 1], [0, 1, 2]]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n long")
    assert S.with_forms(S.count_words(docs)).count() == 0
    assert S.count_words(spark.createDataFrame([(1, "One one two", 5)], "doc_id long, text string, n long")).count() == 2
