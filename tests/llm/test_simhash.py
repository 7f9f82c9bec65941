"""SimHash groups, components and near-dedup against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspan.llm import simhash as S
from quillspan.llm.common import settled
from quillspan.llm.components import components


def brute_fingerprint(text, width=3, seed=42):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(200, n) for n in range(201, 260)]
    links = spark.createDataFrame(pairs + pairs[:9] + [(5, 5)], "a long, b long")
    want = groups(pairs, {n for p in pairs for n in p})
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(links.limit(0)).count() == 0


def test_few_links_make_few_tasks(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in held}
    context, status = spark.sparkContext, spark.sparkContext.statusTracker()
    links = settled(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)], "a long, b long"))
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        context.setJobGroup("components", "few links")
        got = {r.node: r.root for r in components(links, settled).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}
    stages = {s for job in status.getJobIdsForGroup("components") for s in status.getJobInfo(job).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := status.getStageInfo(s)))
    assert tasks < 2000


def test_fingerprints_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["The", "É", "cat", "x\x85y", "\x0b"]) for _ in range(rng.randrange(12))) for _ in range(150)]
    texts += [None, "", " \n", "one", "one two", "One  TWO\tthree", "lorem ipsum dolor " * 5000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in docs.select("doc_id", S.as_hex(S.fingerprint(F.col("text"))).alias("f")).collect():
        assert row["f"] == f"{brute_fingerprint(texts[row['doc_id']]):016x}"
    monkeypatch.setattr(S, "CHUNK", 100)
    long = S.shingle_hashes(texts[-1].encode(), 3, 42)
    assert S.simhash(long) & (2**64 - 1) == brute_fingerprint(texts[-1])


def signed(n):
    return n - (1 << 64) if n >> 63 else n


@pytest.mark.parametrize("bucket", [16, 2, 0])
def test_groups_equal_all_pairs(spark, bucket, monkeypatch):
    """Clusters around common segments; with small buckets the exact way for crowds is taken."""
    monkeypatch.setattr(S.near_links, "__defaults__", (bucket,))
    rng = random.Random(bucket)
    prints = [0, 0, (1 << 64) - 1]
    for _ in range(12):
        base = rng.getrandbits(64)
        prints += [base] + [base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12)]
        prints += [base ^ (rng.getrandbits(32) << 32) for _ in range(8)]
        far = base
        for _ in range(6):
            far ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.append(far)
    rows = [(1000 - i if i % 9 else None, signed(p)) for i, p in enumerate(prints)]
    near = [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 2]
    root = groups(near, set(prints))
    least = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[root[p]] = min(least.get(root[p], d), d)
    want = sorted((str(d), f, str(least.get(root[p]))) for (d, f), p in zip(rows, prints))
    got = S.group_by_fingerprint(spark.createDataFrame(rows, "doc_id long, fp long"), radius=2, segments=2).collect()
    assert sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in got) == want


@pytest.mark.parametrize("bucket", [1000, 2, 0])
def test_wide_links_equal_all_pairs(spark, bucket):
    """Crowds of a common segment, exact or one bit off; small buckets give some of the pairs."""
    rng = random.Random(5)
    flipped = lambda n, bits: n ^ sum(1 << b for b in bits)
    outside = range(22, 128)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(128)
        for _ in range(12):
            other = flipped(base, rng.sample(outside, 40))
            prints |= {other, flipped(other, rng.sample(outside, 14)), flipped(other, [rng.randrange(21), *rng.sample(outside, 13)])}
    part = lambda n, s: n >> 64 * s[0] + s[1] & ((1 << S.WIDE_BITS) - 1)
    meet = lambda a, b: any((part(a, s) ^ part(b, s)).bit_count() <= 1 for s in S.WIDE_SEGMENTS)
    near = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= S.WIDE_RADIUS and meet(a, b)}
    rows = [((signed(n & (2**64 - 1)), signed(n >> 64)),) for n in prints]
    links = S.wide_links(spark.createDataFrame(rows, "fp struct<f0:long,f1:long>"), bucket).collect()
    whole = lambda v: (v["f0"] & (2**64 - 1)) | (v["f1"] & (2**64 - 1)) << 64
    got = {tuple(sorted((whole(r[0]), whole(r[1])))) for r in links}
    assert got <= near and (got == near or bucket < 1000) and len(near) > 50


def test_run_hashes():
    words = S.word_hashes(b"One two  THREE four five six one TWO three")
    assert len(words) == 9 and words[0] == words[6] and S.word_hashes(None).size == 0
    runs = S.run_hashes(words, 3, 7)
    assert len(runs) == 7 and runs[0] == runs[6] and len(set(runs.tolist())) == 6
    assert len(S.run_hashes(words[:2], 5, 7)) == 1 and S.run_hashes(words[:0], 5, 7).size == 0
    assert S.run_hashes(words[:2], 5, 7)[0] != S.run_hashes(words[1::-1], 5, 7)[0]


@pytest.mark.parametrize("seed", range(3))
def test_first_runs_of_alike_sets_meet(seed):
    rng = random.Random(seed)
    met = 0
    for _ in range(3000):
        a = set(rng.sample(range(10_000), rng.randrange(1, 60)))
        b = set(rng.sample(sorted(a), rng.randrange(1, len(a) + 1))) | set(rng.sample(range(10_000), rng.randrange(0, 8)))
        if 5 * len(a & b) >= 4 * len(a | b):
            small, large = sorted((sorted(a), sorted(b)), key=len)
            assert set(small[: S.first_runs(len(small))[1]]) & set(large[: S.first_runs(len(large))[0]])
            met += 1
    assert met > 100


def test_empty_table_and_refused_parameters(spark):
    empty = spark.createDataFrame([], "doc_id long, fp long")
    assert S.group_by_fingerprint(empty, 2, 2).count() == 0
    with pytest.raises(ValueError):
        S.near_links(empty, 3, 2)


def test_one_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    originals = [[rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))] for _ in range(120)]
    rows = [(i, " ".join(w)) for i, w in enumerate(originals)]
    similarity, copies = {}, 0
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i, words in enumerate(originals[:60]):
        for _ in range(20 if i == 0 else 2):
            changed = list(words)
            changed[rng.randrange(len(changed))] = "changed"
            a, b = shingles(words), shingles(changed)
            if len(a & b) / len(a | b) >= 0.85:
                rows.append((1000 + copies, " ".join(changed)))
                copies += 1
    rows += [(2000 + i, " ".join(originals[70])) for i in range(40)] + [(70, " ".join(originals[70])), (None, " ".join(originals[71]))]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string").repartition(5)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(range(120)) <= set(ids)
    assert len(set(ids) - set(range(120))) <= 0.1 * copies and not any(i is None or i >= 2000 for i in ids)
    assert S.drop_near_duplicates(docs.limit(0)).count() == 0


def exact_groups(texts):
    """For each row number the least of its component of texts with 0.8 of their five-word runs in common."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    similar = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    return groups([(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])], set(range(len(sets))))


@pytest.mark.parametrize("crowded", [False, True])
def test_groups_are_those_of_all_pairs(spark, crowded, monkeypatch):
    """Chains and crowds of copies around 0.8, passages that unlike texts share, and texts of a few words."""
    if crowded:  # every bucket is one, and runs are frequent ones
        monkeypatch.setattr(S.wide_links, "__defaults__", (0,))
        monkeypatch.setattr(S, "HOT", 1)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    passage = rng.sample(words, 60)
    texts = []
    for i in range(10):
        base = rng.sample(words, 300)
        texts.append(" ".join(base))
        for n in (9, 10, 4, 8, 8):
            changed = list(base)
            for at in rng.sample(range(5, 295, 6), n):
                changed[at] = "changed"
            texts.append(" ".join(changed))
        texts.append(" ".join(rng.sample(words, 40) + passage + rng.sample(words, 20)))
    one = rng.sample(words, 120)
    for _ in range(60):  # a crowd whose members are near its first one, but often not each other
        changed = list(one)
        for at in rng.sample(range(len(one)), rng.randrange(1, 4)):
            changed[at] = rng.choice(words)
        texts.append(" ".join(changed))
    texts += ["one", "ONE", None, " ", "a b c d", "a b c d e", "a b c d e f", "a b c d e f"]
    root = exact_groups(texts)
    assert len(set(root.values())) < len(texts) - 40
    rows = [(1000 - i if i % 7 else 1000 - i, t) for i, t in enumerate(texts)]  # the least id is the last of a group
    last = {r: max(i for i in root if root[i] == r) for r in set(root.values())}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [r["doc_id"] for r in S.drop_near_duplicates(docs).collect()]
    assert sorted(kept) == sorted(1000 - i for i in last.values())


def test_ties_nulls_and_clashing_columns(spark):
    rows = [(1, "same words here", "a", None), (1, "Same  words HERE", "b", None), (None, "same words here", "c", 1), (2, "x", "d", 2), (2, "x", "d", 2), (None, "y z", "e", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, id int")
    first = S.drop_near_duplicates(docs.repartition(2)).collect()
    assert sorted(r["doc_id"] for r in first if r["doc_id"] is not None) == [1, 2] and [r["row"] for r in first if r["doc_id"] is None] == ["e"]
    assert {tuple(r) for r in first} <= set(rows)
    again = S.drop_near_duplicates(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, first))


def test_ball_sizes():
    assert len(S._ball(range(64), 1)) == 65 and len(S._ball(range(32, 64), 2)) == 1 + 32 + 32 * 31 // 2
    assert np.array(S._ball(range(64), 1), np.int64).dtype == np.int64


def test_few_pairs_of_a_crowd_that_is_hardly_alike_are_looked_at(spark, monkeypatch):
    """Versions of one text, most less alike than 0.8: runs that many of them have come last, so few pairs meet."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(240):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(6, 14)):
            words[at] = f"v{at}x{rng.randrange(3)}"
        texts.append(" ".join(words))
    looked = []
    real = S.missing_pairs
    monkeypatch.setattr(S, "missing_pairs", lambda *a: (pairs := real(*a), looked.append(pairs.count()))[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in S.drop_near_duplicates(docs).collect())
    root = exact_groups(texts)
    assert kept == sorted(set(root.values())) and len(kept) > 150
    assert looked[0] < 240 * 239 / 2 / 20


def test_settled_keeps_the_setting(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    got = settled(frame)
    assert got.count() == frame.count() == 7 and spark.conf.get(name, None) == before
