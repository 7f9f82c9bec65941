"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set if over half of the text's shingle hashes have it. Two
fingerprints that differ in ``radius`` bits differ in at most ``radius // segments`` bits
in one of ``segments`` parts. So every distinct fingerprint is filed under each of its
parts; it asks for all values in the small Hamming ball around each part; the matches'
complete distances are verified.

A part's value that more than ``BUCKET`` distinct fingerprints share would give pairs by
the square. Such a bucket hands out no members. Those who ask for it, and its members,
are linked by balls around whole fingerprints instead: each is filed under every value
within half the radius, any two within the radius meet at one of those, any two that meet
are within the radius (so no pairs are needed: all link to the least), and a value can be
shared by no more distinct fingerprints than a ball has. Both ways are exact, and linear
in the number of distinct fingerprints.

Copies have one fingerprint and are one row until the last join. Links become groups
by :mod:`quillspan.llm.components`; nothing but counters reaches the driver.

Cases: a null text, an empty one and one of white space have fingerprint 0, and link like
any other. A null id never is the least of a group that has another; a group of null
ids alone has a null component. Repeated rows come back as often as they came. Long texts
are hashed in chunks. Empty tables give empty results. Only the id and the text are
read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import LOWER, UPPER, broadcast_if_small, cut, fresh, let_workers_import, settled
from quillspan.llm.components import components
from quillspan.sources.tables import read_table

BITS = 64
#: Distinct fingerprints that a bucket hands out; fuller ones are searched by balls around whole fingerprints.
BUCKET = 16
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words (of all words if they are fewer), A-Z lower-cased, joined by spaces."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, width = b" ".join(words), min(width, len(words))
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """The fingerprint as a signed 64-bit number."""
    set_bits = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        chunk = hashes[i : i + CHUNK].astype("<u8")
        set_bits += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = 3, seed: int = 42) -> Column:
    """SimHash of a text over shingles of ``width`` words."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([simhash(shingle_hashes(t, width, seed)) if t else 0 for t in batch], dtype="int64")

    return of(text.cast("binary"))


def as_hex(fingerprint: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _ball(bits: range, radius: int) -> list[int]:
    """Masks of up to ``radius`` of ``bits``, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(bits, r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _parts(segments: int) -> list[range]:
    edges = [BITS * s // segments for s in range(segments + 1)]
    return [range(a, b) for a, b in zip(edges, edges[1:])]


def _key(fp: Column, segment: int, bits: range) -> Column:
    """A segment's number and value, in one string-free pair."""
    value = F.shiftrightunsigned(fp, bits.start).bitwiseAND(F.lit((1 << len(bits)) - 1))
    return F.struct(F.lit(segment).alias("s"), value.alias("v"))


def near_links(prints: DataFrame, radius: int, segments: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join all of the distinct ``fp`` of ``prints`` within ``radius`` bits of each other.

    Every pair within the radius is connected by links within the radius, be it over third ones.
    """
    if radius < 0 or radius % 2 or not 1 < segments <= BITS // 2:
        raise ValueError("the radius is even, and there are 2 to 32 segments")
    fp, parts = F.col("fp"), _parts(segments)
    filed = prints.select("fp", F.explode(F.array(*(_key(fp, s, p) for s, p in enumerate(parts)))).alias("k")).select("k.s", "k.v", "fp")
    sizes = filed.groupBy("s", "v").count()
    full = cut(sizes.filter(F.col("count") > bucket).select("s", "v"))
    table = filed.join(full, ["s", "v"], "left_anti").unionByName(full.withColumn("fp", F.lit(None).cast("long")))
    asked = [_key(fp.bitwiseXOR(F.lit(m)), s, p) for s, p in enumerate(parts) for m in _ball(p, radius // segments)]
    probes = prints.select(fp.alias("x"), F.explode(F.array(*asked)).alias("k")).select("x", "k.s", "k.v")
    met = probes.join(table.withColumnRenamed("fp", "y"), ["s", "v"])
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius
    met = cut(met.filter(F.col("y").isNull() | ((F.col("x") < F.col("y")) & near)).select("x", "y").distinct())
    links = met.filter("y is not null").select(F.col("x").alias("a"), F.col("y").alias("b"))
    crowded = met.filter("y is null").select(F.col("x").alias("fp")).distinct()  # members ask for their own bucket too
    around = crowded.select("fp", F.explode(F.array(*(fp.bitwiseXOR(F.lit(m)) for m in _ball(range(BITS), radius // 2)))).alias("k"))
    least = F.min("fp").over(Window.partitionBy("k"))
    stars = around.select(F.col("fp").alias("a"), least.alias("b")).filter("a <> b").distinct()
    return links.union(stars)


def group_by_fingerprint(prints: DataFrame, radius: int, segments: int) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the least doc_id that links reach, per row of ``prints``."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(near_links(distinct.select("fp"), radius, segments))
    linked = cut(roots.union(roots.select("root", "root").distinct()))
    least = linked.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("low").alias("least"))
    reached = linked.join(least, "root").select("node", "least")
    named = distinct.join(reached, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("key"), F.coalesce("least", "low").alias("component_id")
    )
    # Written first, so that both sides come to the join straight from a shuffle and many copies of one text can be split there.
    return prints.join(cut(named), F.col("fp") == F.col("key")).select("doc_id", "fp", "component_id")


#: Near-duplicate texts: 128 bits over runs of two words. Texts with 0.8 of their five-word shingles in common differ
#: in some 12 bits, unrelated texts in 45 or more.
WIDE_SEEDS, WIDE_WIDTH, WIDE_RADIUS = (42, 43), 2, 16
#: Three segments of 22 bits (word, first bit) with balls of one bit; being 22 bits wide they hold few unrelated texts.
WIDE_BITS, WIDE_SEGMENTS = 22, ((0, 0), (0, 42), (1, 21))

#: Near duplicates share this much of their distinct runs of five words, as a fraction.
ALIKE, ALIKE_WIDTH = (4, 5), 5
#: The more texts hold a run the later it comes in the order of runs: by ranks of one for each doubling from ``HOT`` texts on.
#: Ranks are kept in so many places by the runs' last bits.
HOT, PLACES = 8, 1 << 22
#: Runs that a task counts at a time.
COUNTED = 1 << 20


def word_hashes(text: bytes | None) -> np.ndarray:
    """XXH64 of each word, A-Z lower-cased."""
    words = (text or b"").translate(_LOWER).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of each run of ``width`` words (of all words if they are fewer) from the words' hashes."""
    width = min(width, len(words))
    if not width:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    sums = np.full(n, seed, np.uint64)
    for k in range(width):
        sums += words[k : k + n] * np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + seed, 1 << 64))
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):  # so that every bit depends on every word
        sums = (sums ^ (sums >> np.uint64(33))) * np.uint64(factor)
    return sums ^ (sums >> np.uint64(33))


def shingles(words: np.ndarray) -> np.ndarray:
    """The distinct hashes of runs of ``ALIKE_WIDTH`` words, ascending."""
    return np.unique(run_hashes(words, ALIKE_WIDTH, 7))


def first_runs(n: int) -> tuple[int, int]:
    """How many of a text's ``n`` runs, in an order that is the same for all texts, are enough for it to meet any near duplicate.

    Of two texts with ``ALIKE`` in common one of the second number of the one with fewer runs is among the first number of
    the other's: they share 8 of 9 of the former's runs at least, and 4 of 5 of the latter's.
    """
    part, whole = ALIKE
    return n - -(-part * n // whole) + 1, n - -(-2 * part * n // (part + whole)) + 1


def fingerprints(text: Column) -> Column:
    """Struct of two SimHashes with different seeds and a hash of the words in order.

    Texts that differ in white space or the case of A-Z only have the same words.
    """

    @F.pandas_udf("f0 long, f1 long, words long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                words = word_hashes(t)
                prints = [simhash(run_hashes(words, WIDE_WIDTH, seed)) for seed in WIDE_SEEDS]
                whole = np.frombuffer(xxhash.xxh64_digest(words.tobytes()), "<i8")[0]
                rows.append([*prints, int(whole)])
            yield pd.DataFrame(rows, columns=["f0", "f1", "words"])

    return of(text.cast("binary"))


def shingle_set(text: Column) -> Column:
    """The distinct hashes of a text's runs of ``ALIKE_WIDTH`` words."""

    @F.pandas_udf("array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingles(word_hashes(t)).view(np.int64) for t in batch], dtype=object)

    return of(text.cast("binary"))


def _repeated(held: list[np.ndarray]) -> pd.DataFrame:
    """The runs that several of ``held`` have, and how many."""
    runs, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
    return pd.DataFrame({"run": runs[n > 1].view(np.int64), "n": n[n > 1]})


def run_ranks(texts: DataFrame) -> np.ndarray:
    """Ranks by place, four bits each: that of the most frequent run there, from 0 for at most ``HOT`` texts on.

    Frequencies are sums over pieces of a task, without runs that a piece has once; so few runs move, and a run that many texts
    hold is still seen, as some pieces have it twice. They only order the runs. ``PLACES`` ranks leave the tasks at most.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for t in batch["text"]:
                held.append(shingles(word_hashes(t)))
                size += len(held[-1])
                if size >= COUNTED:
                    yield _repeated(held)
                    held, size = [], 0
        yield _repeated(held)

    counted = texts.select(F.col("text").cast("binary").alias("text")).mapInPandas(count, "run long, n long")
    sums = counted.groupBy("run").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT)
    rank = F.least(F.floor(F.log2(F.col("n") / HOT)) + 1, F.lit(15)).cast("long")
    place = F.col("run").bitwiseAND(F.lit(PLACES - 1).cast("long"))
    ranks = sums.groupBy(place.alias("place")).agg(F.max(rank).alias("rank"))
    shifted = F.call_function("shiftleft", F.col("rank"), (F.col("place") % 16 * 4).cast("int"))
    words = ranks.groupBy(F.call_function("div", F.col("place"), F.lit(16)).alias("at")).agg(F.bit_or(shifted).alias("ranks"))
    out = np.zeros(PLACES // 16, np.int64)
    for row in words.collect():
        out[row["at"]] = row["ranks"]
    return out.view(np.uint64)


def leading_runs(text: Column, spark, ranks: np.ndarray) -> Column:
    """Struct of ``n``, a text's distinct runs, and ``runs``, its first ones, in the order of their ``ranks``, then hashes."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("n int, runs array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of_place = shared.value
        for batch in texts:
            rows = []
            for t in batch:
                runs = shingles(word_hashes(t))
                at = runs & np.uint64(PLACES - 1)
                rank = of_place[(at >> np.uint64(4)).astype(np.int64)] >> ((at & np.uint64(15)) << np.uint64(2)) & np.uint64(15)
                first = np.argsort(rank, kind="stable")[: first_runs(len(runs))[0]]
                rows.append([len(runs), runs[first].view(np.int64)])
            yield pd.DataFrame(rows, columns=["n", "runs"])

    return of(text.cast("binary"))


def wide_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of the distinct wide fingerprints ``fp`` of ``prints`` that are within ``WIDE_RADIUS`` bits.

    That is every pair with a segment within one bit of each other's, but for buckets with more than ``bucket`` members: those and
    who asks for them meet the least of all of these only, and members also the least of each 16 bits of the fingerprint.
    Of two values that differ in one bit, the one that lacks it asks for the other.
    """
    fp, mask = F.col("fp"), F.lit((1 << WIDE_BITS) - 1).cast("long")
    x, y = F.col("x"), F.col("y")

    def key(segment: int, flip: int, of: Column = fp) -> Column:
        word, start = WIDE_SEGMENTS[segment]
        value = F.shiftrightunsigned(of[f"f{word}"], start).bitwiseAND(mask)
        return value.bitwiseXOR(F.lit(flip).cast("long")) + F.lit(segment << WIDE_BITS)

    count = range(len(WIDE_SEGMENTS))
    filed = prints.select("fp", F.explode(F.array(*(key(s, 0) for s in count))).alias("k"))
    full = settled(filed.groupBy("k").count().filter(F.col("count") > bucket).select("k"))
    none = F.lit(None).cast(prints.schema["fp"].dataType)
    table = filed.join(full, "k", "left_anti").select("k", fp.alias("y")).unionByName(full.withColumn("y", none))
    lacks = lambda s, bit: F.shiftrightunsigned(fp[f"f{WIDE_SEGMENTS[s][0]}"], WIDE_SEGMENTS[s][1] + bit).bitwiseAND(F.lit(1).cast("long")) == 0
    asked = [key(s, 0) for s in count] + [F.when(lacks(s, bit), key(s, 1 << bit)) for s in count for bit in range(WIDE_BITS)]
    probes = prints.select(fp.alias("x"), F.explode(F.array(*asked)).alias("k")).filter("k is not null")
    near = sum(F.bit_count(x[f"f{w}"].bitwiseXOR(y[f"f{w}"])) for w in (0, 1)) <= WIDE_RADIUS
    met = probes.join(table, "k").filter(y.isNull() | ((x != y) & near))
    less, more = F.when(y < x, y).otherwise(x), F.when(y < x, x).otherwise(y)
    met = settled(met.select(less.alias("x"), more.alias("y"), F.when(y.isNull(), F.col("k")).alias("k")).distinct())
    chunks = [
        F.shiftrightunsigned(x[f"f{w}"], 16 * c).bitwiseAND(F.lit(0xFFFF).cast("long")) + F.lit((4 * w + c) << 16)
        for w in (0, 1) for c in range(4)
    ]
    everyone = F.lit(-1).cast("long")
    member = F.array_contains(F.array(*(key(s, 0, x) for s in count)), F.col("k"))
    crowd = met.filter("y is null").select("x", "k", member.alias("member"))
    meets = F.when(F.col("member"), F.array(everyone, *chunks)).otherwise(F.array(everyone))
    meeting = crowd.select("x", "k", F.explode(meets).alias("c"))
    least = meeting.groupBy("k", "c").agg(F.min("x").alias("y"))
    stars = meeting.join(least, ["k", "c"]).filter((y < x) & near).select(y.alias("a"), x.alias("b"))
    return met.filter("y is not null").select(x.alias("a"), y.alias("b")).union(stars).distinct()


def _of_rows(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (``id``, ``row``, ...) that are a node's, with ``node``. By the hash alone, which is one number, then the id."""
    named = broadcast_if_small(nodes.select(F.col("row").alias("of_row"), F.col("id").alias("of_id"), "node"))
    same_id = F.col("id").bitwiseXOR(F.col("of_id")) == 0
    return rows.join(named, (F.col("row") == F.col("of_row")) & same_id).drop("of_row", "of_id")


def alike(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, repeated: bool) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes whose texts share ``ALIKE`` of their runs of words or more, written.

    ``nodes`` names each ``node``'s row of ``texts`` by ``id`` and ``row``, which several rows may have if ``repeated``.
    Only texts in a pair are read as sets.
    """
    pairs = settled(pairs)
    wanted = nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node").select("node", "id", "row")
    found = _of_rows(texts, settled(wanted)).select("node", "text")
    if repeated:
        found = found.dropDuplicates(["node"])
    sets = settled(found.select("node", shingle_set(F.col("text")).alias("set")))
    side = lambda name: sets.select(F.col("node").alias(name), F.col("set").alias(f"set_{name}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    enough = ALIKE[1] * both >= ALIKE[0] * (F.size("set_a") + F.size("set_b") - both)
    return settled(pairs.join(side("a"), "a").join(side("b"), "b").filter(enough).select("a", "b"))


def missing_pairs(leading: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) among which are all near duplicates in different groups of ``roots`` (node, root).

    ``leading`` has each node's :func:`leading_runs`. A pair is looked at where the first run that both have can be at its
    place: what comes behind it must be enough for ``ALIKE``. So one of the two has it early, and of a run's texts
    only those that have it early are compared with the others; within a run's largest group none are.
    """
    part, both = ALIKE[0], sum(ALIKE)
    placed = leading.join(broadcast_if_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    runs = placed.select(F.posexplode("runs").alias("at", "run"), "node", "root", "n")
    early = F.col("at") < F.col("n") - F.ceil(2 * part * F.col("n") / F.lit(both)) + 1  # as in first_runs
    of_run = Window.partitionBy("run")  # so that each run is moved once
    sums = {"least": F.min("root").over(of_run), "most": F.max("root").over(of_run), "any": F.max("early").over(of_run)}
    shared = settled(runs.withColumn("early", early).withColumns(sums).filter("least <> most and any").drop(*sums))
    by_root = shared.groupBy("run", "root").count()
    largest = by_root.groupBy("run").agg(F.max(F.struct("count", "root"))["root"].alias("largest"))
    shared = settled(shared.join(broadcast_if_small(settled(largest)), "run").withColumn("few", F.col("root") != F.col("largest")).drop("largest"))
    behind = lambda side: both * (F.col(f"{side}.n") - F.col(f"{side}.at")) >= part * (F.col("x.n") + F.col("y.n"))
    possible = (F.col("x.root") != F.col("y.root")) & (F.col("x.n") <= F.col("y.n")) & behind("x") & behind("y")
    pair = (F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    early = shared.filter("early")
    met = [early.filter("few").alias("x").join(shared.alias("y"), "run"), early.filter("not few").alias("x").join(shared.filter("few").alias("y"), "run")]
    pairs = settled(met[0].filter(possible).select(*pair).union(met[1].filter(possible).select(*pair)).distinct())
    # Of the two one's first runs end no later in the order than the other's; those that the other lacks there it lacks at all.
    ends = broadcast_if_small(settled(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    paired = settled(leading.join(ends, "node"))
    side = lambda name: paired.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("runs").alias(f"runs_{name}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("c", F.size(F.array_intersect("runs_a", "runs_b")))
    lacks = lambda name: both * (F.col(f"n_{name}") - F.size(f"runs_{name}") + F.col("c")) >= part * (F.col("n_a") + F.col("n_b"))
    return near.filter(lacks("a") | lacks("b")).select("a", "b")


def near_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows of ``id``, ``row`` and ``text``: their ``id``, ``row`` and ``first`` (id and row of their group's least)."""
    prints = settled(docs.select("id", "row", fingerprints(F.col("text")).alias("m")))
    words = F.struct("m.f0", "m.f1", "m.words")
    distinct = prints.groupBy(words.alias("fp")).agg(F.min(F.struct("id", "row")).alias("first"))
    nodes = settled(distinct.withColumn("node", F.monotonically_increasing_id()))
    named = nodes.select("node", "first.id", "first.row")
    repeated = prints.groupBy("id", "row").count().filter("count > 1").limit(1).count() > 0
    keep = lambda pairs: alike(pairs, named, docs, repeated)
    wide = wide_links(nodes.select(F.struct("fp.f0", "fp.f1", "node").alias("fp")))
    links = keep(wide.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    roots = components(links, settled)

    # Copies count as often as they are there, which only makes their runs come later; then they drop out in the join.
    ranks = run_ranks(docs)
    leading = docs.select("id", "row", leading_runs(F.col("text"), docs.sparkSession, ranks).alias("l"))
    leading = _of_rows(leading, named).select("node", "l.*")
    if repeated:
        leading = leading.dropDuplicates(["node"])
    leading = settled(leading)
    more = keep(missing_pairs(leading, roots))
    if more.limit(1).count():
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))  # they say what the links said
        roots = components(stars.union(more), settled)
    placed = settled(nodes.join(roots, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("root")))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    groups = placed.join(least, "root").select("fp", "least")
    return prints.select("id", "row", words.alias("fp")), groups


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the least id (a null id counts as the largest).

    Groups are the components of all pairs of texts that share ``ALIKE`` of their distinct runs of five words. Fingerprints
    within ``WIDE_RADIUS`` bits find most such pairs. The others are found without fail: any two texts that much
    alike begin with a common run, in an order of all runs that has the more frequent ones later; texts that do
    are compared if fingerprints have left them in different groups. So of a run's texts that are all in one group no pair is
    looked at. Of rows with equal ids and words the one with the least hash of all its columns stays.
    """
    let_workers_import(docs.sparkSession)
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    id_, row = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(*hashed)
    prints, groups = near_groups(docs.select(id_.alias("id"), row.alias("row"), "text"))
    stays = groups.select("least.id", "least.row").distinct()
    keys = prints.groupBy("id", "row").count()
    goes = settled(keys.join(stays, ["id", "row"], "left_anti").select("id", "row"))
    again = settled(keys.filter("count > 1").join(stays, ["id", "row"], "left_semi").select("id", "row"))
    id_name, row_name = fresh(docs, "id"), fresh(docs, "row")
    rows = docs.withColumns({id_name: id_, row_name: row})
    named = lambda some: broadcast_if_small(some.select(F.col("id").alias(id_name), F.col("row").alias(row_name)))
    kept = rows.join(named(goes), [id_name, row_name], "left_anti")
    if again.limit(1).count():
        once = kept.join(named(again), [id_name, row_name], "left_semi").dropDuplicates([id_name, row_name])
        kept = kept.join(named(again), [id_name, row_name], "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints link at two or fewer differing bits."""
    let_workers_import(spark)
    docs = read_table(spark, sf_dir, "documents")
    prints = cut(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")))
    grouped = group_by_fingerprint(prints, radius=2, segments=2)
    return grouped.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
