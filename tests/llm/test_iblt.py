"""Invertible Bloom sketches against sets, and fingerprints read by a decoder of their own."""

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from quillspan.llm import iblt as I


def paragraphs(text):
    return {xxhash.xxh64_intdigest(piece.encode(), 42) for piece in re.split(r"\n|(?<=[.!?]) ", text) if piece}


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


# A decoder of fingerprints that has nothing but their text.


def checksum(h):
    return xxhash.xxh64_intdigest(struct.pack("<i", 99), xxhash.xxh64_intdigest(struct.pack("<q", h), 42)) & 0xFFF


def places(value, width):
    h = xxhash.xxh64_intdigest(struct.pack("<q", abs(value)), 42)
    return [j * width + (h >> 20 * j & (width - 1)) for j in range(3)]


def parsed(text):
    return [[int(c, 16) if c else 0 for c in part.split(".")] for part in text.split(":")]


def folded(parts, n):
    """A sketch of ``n`` parts of the first size."""
    out = []
    for p in parts:
        width = len(p) // 3
        out.append([sum(p[j * width + i :: I.WIDTH][: width // I.WIDTH]) for j in range(3) for i in range(I.WIDTH)])
    while len(out) > n:
        half = len(out) // 2
        out = [[x + y for x, y in zip(a, b)] for a, b in zip(out[:half], out[half:])]
    return out


def single(cell):
    low = abs(cell) & ((1 << 52) - 1)
    return abs(cell) >> 52 == 1 and checksum(low >> 12) == low & 0xFFF


def peeled(parts):
    """Digests in all parts, or None if cells are left over."""
    found = []
    for cells in parts:
        cells = list(cells)
        for _ in range(200):
            for v in {c for c in cells if single(c)}:
                for p in places(v, len(cells) // 3):
                    cells[p] -= v
                found.append(v)
        if any(cells):
            return None
    return {v for v in found if -v not in found}


def compared(a, b):
    """Likeness from two fingerprints' texts."""
    a, b = parsed(a), parsed(b)
    held = [peeled(a), peeled(b)]
    n = [len(h) for h in held]
    parts = min(len(a), len(b))
    left = peeled([[x - y for x, y in zip(p, q)] for p, q in zip(folded(a, parts), folded(b, parts))])
    between = len(held[0] ^ held[1])
    assert left is None or len(left) == between
    return ((sum(n) - between) / (sum(n) + between) if sum(n) else 1.0), left is not None


def made_texts(n, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoé") for _ in range(rng.randrange(1, 7)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 12))) + rng.choice([". ", "! ", "\n", ".\n\n"])
    return ["".join(sentence() for _ in range(rng.choice([0, 1, 5, 20, 60, 400]))) for _ in range(n)]


def query(spark, directory, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{directory}/documents.parquet")
    return [r.asDict() for r in I.op5_iblt(spark, str(directory)).collect()]


def test_fingerprints_and_likeness_equal_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "RANGE_ROWS", 2)
    monkeypatch.setattr(I, "QUANTILES", 5)
    monkeypatch.setattr(I, "BLOCK_RANGES", 3)
    texts = [*made_texts(40), None, "", "a. b. c. d.", "a. b. c. d."]
    rows = [(i * i - 300, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in query(spark, tmp_path, rows)}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    prints, by_folding = {}, 0
    for (doc_id, text), (after_id, after) in zip(order, order[1:] + order[:1]):
        text, after, row = text or "", after or "", got[doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["near_edited"] == pytest.approx(likeness(text, edited)) and row["near_next"] == pytest.approx(likeness(text, after))
        # The same from what is returned alone.
        value, by_fold = compared(row["fingerprint"], row["edited_fingerprint"])
        assert row["near_edited"] == pytest.approx(value)
        assert row["near_next"] == pytest.approx(compared(row["fingerprint"], got[after_id]["fingerprint"])[0])
        by_folding += by_fold
        assert {abs(v) >> 12 & ((1 << 40) - 1) for v in peeled(parsed(row["fingerprint"]))} == {h & ((1 << 40) - 1) for h in paragraphs(text)}
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
    assert len(set(prints.values())) == len(prints) and by_folding > 0.5 * len(rows)


def test_single_repeated_and_null_ids(spark, tmp_path):
    alone = query(spark, tmp_path / "one", [(5, "a. b. c.")])
    assert [(r["near_next"], r["n_chars"]) for r in alone] == [(1.0, 8)]
    rows = [(None, "x. y."), (None, "x. z."), (3, "a. b."), (3, "a. b."), (3, "c. d."), (9, "e.")]
    many = query(spark, tmp_path / "more", rows)
    assert sorted(str(r["doc_id"]) for r in many) == sorted(str(d) for d, _ in rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in many)
    assert query(spark, tmp_path / "none", []) == []


@pytest.mark.parametrize("hot", [7, None])
def test_an_id_that_many_rows_repeat_gets_several_ranges(spark, hot, monkeypatch):
    monkeypatch.setattr(I, "RANGE_ROWS", 10)
    monkeypatch.setattr(I, "QUANTILES", 16)
    rows = [(i, f"text {i}.") for i in range(200)] + [(hot, f"hot {i}. of {i * i}.") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    place, tie = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"), F.xxhash64("text").alias("tie")
    keyed = docs.select("doc_id", place, tie)
    ranged = keyed.withColumn("range", I._range_of(keyed, "place", "tie"))
    assert max(r["count"] for r in ranged.groupBy("range").count().collect()) <= 40
    placed = sorted((r["place"], r["tie"], r["range"]) for r in ranged.collect())
    assert [r for _, _, r in placed] == sorted(r for _, _, r in placed)
    followed = {r["text"]: r["next_text"] for r in I.with_next(docs).collect()}
    order = [r["text"] for r in docs.withColumns({"place": place, "tie": tie}).orderBy(F.desc("place"), F.desc("tie")).collect()]
    assert followed == dict(zip(order, order[1:] + order[:1]))


def values_of(spark, *sets):
    digest = lambda c: I.digests(F.transform(c, lambda v: F.xxhash64(v)))
    names = [f"s{i}" for i in range(len(sets))]
    return spark.createDataFrame([sets], ", ".join(f"{n} array<long>" for n in names)).select(*(digest(F.col(n)).alias(n) for n in names))


@pytest.mark.parametrize("n", [0, 1, 30, 300, 1500])
def test_peeling_recovers_both_sides(spark, n):
    a, b = list(range(n)), list(range(n // 3, n + n // 4))
    frame = values_of(spark, a, b).withColumns({"f": I.fingerprint(F.col("s0")), "g": I.fingerprint(F.col("s1"))})
    row = frame.select("s0", "s1", I.differing(F.col("f"), F.col("g")).alias("d"), "f").first()
    gone, new = set(row["s0"]) - set(row["s1"]), set(row["s1"]) - set(row["s0"])
    assert sorted(row["d"]) == sorted([*gone, *(-v for v in new)]) and len(row["f"]) * I.PART >= n


def test_a_part_that_is_too_small_fails_and_a_larger_one_is_tried(spark, monkeypatch):
    frame = values_of(spark, list(range(200)), list(range(1000, 1010)))
    assert frame.select(I.peel(I.sketch(F.col("s0"), F.lit(32))).alias("p")).first()["p"] is None
    monkeypatch.setattr(I, "PART", 64)
    both = frame.select(I.fingerprint(F.col("s0")).alias("f"), I.fingerprint(F.col("s1")).alias("g"))
    row = both.select("f", I.differing(F.col("f"), F.col("g")).alias("d")).first()
    assert len(row["d"]) == 210 and max(len(p["cells"][0]) for p in row["f"]) > I.WIDTH
    monkeypatch.setattr(I, "TRIES", 1)  # nothing peels: the sets themselves
    both = frame.select(I.fingerprint(F.col("s0")).alias("f"), I.fingerprint(F.col("s1")).alias("g"))
    assert len(both.select(I.differing(F.col("f"), F.col("g")).alias("d")).first()["d"]) == 210


@pytest.mark.parametrize("width, to", [(128, 16), (64, 64), (32, 8)])
def test_folding_equals_a_sketch_of_the_smaller_size(spark, width, to):
    frame = values_of(spark, list(range(300)))
    large = I.sketch(F.col("s0"), F.lit(width))
    row = frame.select(I.fold(large, F.lit(to)).alias("a"), I.sketch(F.col("s0"), F.lit(to)).alias("b")).first()
    assert row["a"] == row["b"]


@pytest.mark.parametrize("parts", [1, 2, 8, 32])
def test_digests_are_dealt_by_their_low_bits(spark, parts):
    row = values_of(spark, list(range(300))).select("s0", I.dealt(F.col("s0"), F.lit(parts)).alias("p")).first()
    assert [sorted(p) for p in row["p"]] == [sorted(v for v in row["s0"] if (v >> 20) % parts == k) for k in range(parts)]


@pytest.mark.parametrize("n", [30, 2500])
def test_a_changed_sentence_counts_the_same_in_texts_of_any_length(spark, tmp_path, n):
    lines = [f"{i} " + "x" * 60 for i in range(n)]
    after = [f"new {line}" if i % 25 == 7 else line for i, line in enumerate(lines)]
    got = {r["doc_id"]: r for r in query(spark, tmp_path, [(2, "\n".join(lines)), (1, "\n".join(after))])}
    changed = len(range(7, n, 25))
    assert got[2]["near_next"] == pytest.approx((n - changed) / (n + changed))
