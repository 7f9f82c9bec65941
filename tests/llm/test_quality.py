"""Quality rules against brute force and planted outliers."""

import random
from collections import Counter

import numpy as np
import pytest

from quillspan.llm import quality_rules as Q
from pyspark.sql import functions as F


def brute_statistics(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    found = Counter(windows)
    inside = {k for i, w in enumerate(windows) if found[w] > 1 for k in range(i, i + 8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), len(lines))


def random_text(rng, n, alphabet="abcdé"):
    return "".join(rng.choice([*alphabet, " ", " ", "\n", "\t", "\x0b", "\x85", "#", "|"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_statistics_equal_brute_force(seed):
    rng = random.Random(seed)
    made = [random_text(rng, rng.randrange(400), "ab" if seed % 2 else "abcdé") for _ in range(60)]
    made += [None, "", " \n ", "a b c d e f g h " * 30, "\n".join(["x y", "x y", " ", "", "z"]), "word " * 20_000]
    for text in made:
        assert Q.measure(text.encode() if text else None) == brute_statistics(text)


def test_chi_square():
    assert Q.chi_square_beyond(Q.chi_square_point(0.05)) == pytest.approx(0.05)
    assert Q.chi_square_point(0.05) == pytest.approx(9.4877, abs=1e-3)
    assert Q._consistency() == pytest.approx(1.486, abs=0.01)


def covariance(x):
    return Q._consistency() * np.cov(x.T, bias=True) + np.diag(np.square(Q.FLOORS))


def concentrate(x, center, inverse):
    """One concentration step on all rows of one group, by the grid of distances."""
    d = np.einsum("ni,ij,nj->n", x - center, inverse, x - center)
    ring = np.floor(np.log(d + 1e-6) * 50)
    core = x[ring <= np.sort(ring)[int(np.ceil(Q.CORE * len(x))) - 1]]
    return core.mean(axis=0), np.linalg.inv(covariance(core))


def brute_estimate(x, rng, starts=30):
    """The least determinant over many starts, each until it stands."""
    found = []
    for _ in range(starts):
        some = x[rng.choice(len(x), 12, replace=False)]
        center, inverse = some.mean(axis=0), np.linalg.inv(np.cov(some.T, bias=True) + np.diag(np.square(Q.FLOORS)))
        for _ in range(60):
            center, inverse = concentrate(x, center, inverse)
        found.append(-np.linalg.slogdet(inverse)[1])
    return min(found)


def test_estimates_stand_have_the_least_determinant_and_resist_outliers(spark):
    rng = np.random.default_rng(4)
    frames, rows = {}, []
    for group in ("a", "b", "c"):
        x = rng.normal(0, [0.3, 0.2, 0.1, 0.1], (400, 4)) @ np.array([[1, 0.5, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0.2], [0, 0, 0, 1]])
        x[:80] += 5
        if group == "c":  # a tight cluster off the middle, and a wide rest
            x[80:] *= rng.choice([0.1, 3], (320, 1), p=[0.9, 0.1])
        frames[group] = x
        rows += [(group, *map(float, r)) for r in x]
    table = spark.createDataFrame(rows, "group string, x0 double, x1 double, x2 double, x3 double").repartition(7)
    got = Q.estimate(table).collect()
    assert sorted(r["group"] for r in got) == ["a", "b", "c"]
    for row in got:
        center, inverse = np.array([row[f"m{i}"] for i in range(4)]), np.zeros((4, 4))
        for i, j in Q._PAIRS:
            inverse[i, j] = inverse[j, i] = row[f"p{i}{j}"]
        again = concentrate(frames[row["group"]], center, inverse)
        assert np.allclose(again[0], center, atol=2e-3) and abs(np.linalg.slogdet(again[1])[1] - np.linalg.slogdet(inverse)[1]) < 0.01
        assert -np.linalg.slogdet(inverse)[1] <= brute_estimate(frames[row["group"]], rng) + (0.2 if row["group"] == "c" else 0.02)
        assert np.abs(center).max() < 0.2


def test_the_spread_of_a_source_decides(spark):
    """The same share of symbols is usual in a source of code and far off in one of prose."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 9)))
    prose = lambda: " ".join(word() for _ in range(rng.randrange(60, 200)))
    code = lambda share: " ".join(word() + ("#" if rng.random() < share else "") for _ in range(rng.randrange(60, 200)))
    rows = [(i, prose(), "en", "prose") for i in range(300)] + [(1000 + i, code(rng.uniform(0, 0.5)), "en", "code") for i in range(300)]
    rows += [(5000 + i, code(0.4), "en", ("prose", "code")[i % 2]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc"]["doc_id"]: r["kept"] for r in Q.judge_quality(docs).collect()}
    assert [kept[5000 + i] for i in range(20)] == [bool(i % 2) for i in range(20)]
    assert all(kept[i] for i in range(300)) and sum(kept[1000 + i] for i in range(300)) >= 295


def test_distances_and_verdicts_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [random_text(rng, rng.randrange(400, 900)) for _ in range(120)] + [random_text(rng, 500, "#|ab") for _ in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    stats = np.array([Q.measure(t.encode()) for t in texts], float)
    n, chars, symbols, dup, repeat, lines = stats.T
    failed = (n < 20) | (100 * repeat > 30 * n)
    mean = chars[~failed].sum() / n[~failed].sum()
    x = np.stack([np.log((chars + 100 * mean) / (n + 100)), np.sqrt(symbols / (chars + symbols + 500)), np.sqrt(dup / (lines + 10)), np.sqrt(repeat / (n + 100))], axis=1)
    rows = Q._measured(docs)
    vectors = Q.with_vector(rows, Q.groups_of(rows)).cache()
    got = {r["doc"]["doc_id"]: [r[c] for c in Q._X] for r in vectors.collect()}
    assert np.allclose([got[i] for i in range(len(texts))], x)
    row = Q.estimate(vectors.filter("not failed").select("group", *Q._X)).first()
    center, inverse = np.array([row[f"m{i}"] for i in range(4)]), np.zeros((4, 4))
    for i, j in Q._PAIRS:
        inverse[i, j] = inverse[j, i] = row[f"p{i}{j}"]
    far = np.einsum("ni,ij,nj->n", x - center, inverse, x - center)
    for r in Q.judge_quality(docs).collect():
        i = r["doc"]["doc_id"]
        assert r["distance"] == pytest.approx(far[i], rel=1e-6)
        assert r["kept"] == bool(~failed[i] & (far[i] <= Q.chi_square_point(Q.REJECT)))


def test_junk_goes_and_clean_texts_stay(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 9)))
    clean = [" ".join(word() for _ in range(rng.randrange(25, 300))) for _ in range(600)]
    junk = [" ".join(word() + "###" for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s1") for i, t in enumerate(clean + junk)]
    rows += [(9000, None, "en", "s1"), (9001, "", None, None), (9002, "few words", "en", "s1"), (None, clean[0], "en", "s1")]
    rows += [(9100 + i, clean[i], "xx", f"tiny{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("x0", F.lit("kept as it is"))
    judged = {r["doc"]["doc_id"]: r for r in Q.judge_quality(docs).collect()}
    assert len(judged) == len(rows)
    assert all(judged[i]["kept"] for i in range(600)) and not any(judged[600 + i]["kept"] for i in range(60))
    assert judged[9000]["failed"] and judged[9001]["failed"] and judged[9002]["failed"] and judged[None]["kept"]
    assert all(judged[9100 + i]["kept"] for i in range(5))
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in judged.items() if r["kept"]}
    assert Q.judge_quality(docs.limit(0)).count() == 0
