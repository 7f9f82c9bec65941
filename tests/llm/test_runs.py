"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from quillspan.llm import runs as R


def brute_runs(words, least=R.MIN_LENGTH):
    """Every maximal stretch of every period, smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and (i, length) not in found:
                found[i, length] = q
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def periodic(rng, n, letters):
    out = []
    while len(out) < n:
        unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 15))]
        out += unit * rng.randrange(1, 6) + unit[: rng.randrange(len(unit))]
        if rng.random() < 0.3:
            out += out[-rng.randrange(1, 60) :]
    return out[:n]


def test_cover():
    assert {(a - b) % R.COVER_SIZE for a in R.COVER for b in R.COVER} == set(range(R.COVER_SIZE))
    assert R.SYNCHRONISE.max() < R.COVER_SIZE


@pytest.mark.parametrize("seed", range(6))
def test_extensions_equal_brute_force(seed):
    rng = random.Random(seed)
    for n in (1, 2, 12, 13, 14, 40, 137, 400):
        words = np.array(periodic(rng, n, 1 + seed))
        extend = R.Extensions(words)
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        pairs = rng.sample(pairs, min(len(pairs), 4000))
        if pairs:
            a, b = np.array(pairs).T
            want = [next((t for t in range(n) if max(i, j) + t >= n or words[i + t] != words[j + t]), n) for i, j in pairs]
            assert extend(a, b).tolist() == want


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:  # as for texts longer than the table of pairs
        monkeypatch.setattr(R, "TABLE_WORDS", 64)
        monkeypatch.setattr(R, "PAIRS", 50)
        monkeypatch.setattr(R, "_table", [])
    for n in [*range(0, 30), 50, 120, 260, 500]:
        words = periodic(rng, n, rng.choice([1, 2, 3, 9]))
        got = R.runs_of(np.array(words, np.int64))
        assert [tuple(r) for r in got.tolist()] == brute_runs(words)


def test_runs_of_regular_texts():
    one = R.runs_of(np.zeros(60_000, np.int64))
    assert one.tolist() == [[0, 60_000, 1]]
    pair = np.concatenate([np.arange(40_000), np.arange(40_000), [7]])
    assert R.runs_of(pair).tolist() == [[0, 80_000, 40_000]]
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 3000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert [tuple(r) for r in R.runs_of(np.array(fibonacci[1][:1500])).tolist()] == brute_runs(fibonacci[1][:1500])


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(f"w{v}" for v in periodic(rng, rng.randrange(0, 200), 4)) for _ in range(120)]
    texts += [None, "", " \n\t", "one", "a b " * 3000, "x\x85y z \x0b w", "Ünï çödé " * 20, texts[3], texts[3]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b c " * 9), (7, texts[7])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in R.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((brute_row(d, t) for d, t in rows), key=str)


def test_query_on_given_documents(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in docs if len(r["text"]) < 8000}
    got = {r["doc_id"]: tuple(r) for r in R.op13_periodic_runs(spark, f"{TESTDATA}/sf0.001").collect()}
    assert len(got) == len(docs) and all(got[d] == brute_row(d, t) for d, t in short.items())


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c " * 8, "kept", "gone")], "id long, text string, raw string, runs string")
    row = R.with_runs(docs).first()
    assert row["raw"] == "kept" and row["text"] == "a b c " * 8 and row["collapsed"] == "a b c"
    assert [tuple(r) for r in row["runs"]] == [(0, 24, 3)]
    assert R.with_runs(docs.limit(0)).count() == 0
    assert R.with_runs(docs.select(F.lit(None).cast("string").alias("text"))).first()["collapsed"] == ""
