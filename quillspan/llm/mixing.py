"""Mixing sources to target weights by temperature, in Spark's built-in functions alone.

A source's weight is its token share to the power of an exponent from 0 (all sources
alike) to 1 (as they are), normalised. The exponent is bisected: the smallest one at which
no source repeats more than ``max_repeat`` times and the weights' entropy is at most
``target_entropy``, whichever of the two is given. The budget is as many tokens as it takes to have every
document at least once: the source with most tokens per weight goes in once, the others repeat.

Realising it: a source's documents are cut into blocks by hash, the blocks are permuted.
The whole part of a source's repeats is as many passes over all its blocks; the rest of the
budget is filled block by block in the permuted order, and the block in which it ends gives
the documents up to it in the order of their hashes. So a source's tokens miss its budget
by less than one document.

Scale: texts aren't shuffled. Tokens are summed per source and block, reduced in each task
first; a source that holds a third of all rows is many blocks. Blocks are made larger
rather than more than ``MAX_BLOCKS`` a source, and only documents of the one block a source ends in
are ordered. A step of the bisection is an aggregate over the sources, of which the driver
sees only sums. Small tables are broadcast if they have at most ``BROADCAST_ROWS`` rows.

Cases: a null or empty text has no tokens and is there once. A null source is one of its
own. Ids that repeat or are null are told apart by their text's hash; rows equal in both
stay or go together, within the miss of one document times their number. Without any
tokens each document is there once; an empty table gives an empty result. The input's
columns travel in one struct, so their names can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import broadcast_if_small, cut
from quillspan.sources.tables import read_table

#: Tokens of a block, and the most blocks of a source.
BLOCK_TOKENS, MAX_BLOCKS = 1_000_000, 4096
#: Exponents tried in one pass of the bisection, and its passes: 2 ** -30 apart at the end.
AT_ONCE, PASSES = 31, 6


def tokens_of(text: Column) -> Column:
    """Words of a text, apart by ASCII white space."""
    space = r"[ \t-\r]"
    outer = [F.substring(text, at, 1).rlike(space).cast("int") for at in (1, -1)]
    pieces = F.size(F.split(text, f"{space}+")) - outer[0] - outer[1]  # less what is before or after outer white space
    return F.when(text != "", pieces).otherwise(0).cast("long")


def _measures(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """Entropy (in nats) of the weights and the largest repeat at each exponent; one pass over the sources."""
    sums = []
    for a in exponents:
        raw = F.pow("share", F.lit(a))
        sums += [F.sum(raw), F.sum(raw * F.log(raw)), F.max(raw / F.col("share")) / F.min(raw / F.col("share"))]
    row = sources.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
    return [(math.log(row[i]) - row[i + 1] / row[i], row[i + 2]) for i in range(0, len(sums), 3)]


def find_exponent(sources: DataFrame, max_repeat: float | None, target_entropy: float | None) -> float:
    """The smallest exponent within both limits; 1 if none is. ``sources`` has positive shares."""
    # The limits' violation falls as the exponent grows, so each pass keeps the one interval where it ends.
    low, high = 0.0, 1.0
    fits = lambda m: (target_entropy is None or m[0] <= target_entropy) and (max_repeat is None or m[1] <= max_repeat)
    if fits(_measures(sources, [0.0])[0]):
        return 0.0
    for _ in range(PASSES):
        tried = [low + (high - low) * k / (AT_ONCE + 1) for k in range(1, AT_ONCE + 1)]
        good = [fits(m) for m in _measures(sources, tried)]
        first = good.index(True) if True in good else AT_ONCE
        low, high = ([low, *tried][first], [*tried, high][first])
    return high


def _by_key(c: str, other: str) -> Column:
    return F.col(c).eqNullSafe(F.col(other))


def mix(docs: DataFrame, max_repeat: float | None = None, target_entropy: float | None = None, seed: int = 3,
        block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per copy of a document: ``doc`` (its columns), ``tokens``, ``weight`` (its source's), ``repeats`` (its source's, in
    tokens), ``copy`` (from 0), and ``position``, a number to order the mix by: blocks of all sources in one permutation."""
    if max_repeat is None and target_entropy is None or max_repeat is not None and max_repeat < 1:
        raise ValueError("give a largest repeat of 1 or more, a target entropy, or both")
    mark = F.xxhash64(F.lit(seed), "doc_id", "text")
    facts = cut(docs.select(tokens_of(F.col("text")).alias("tokens"), "source", mark.alias("mark")))
    totals = cut(facts.groupBy("source").agg(F.sum("tokens").alias("total")).filter("total > 0"))
    grand = totals.agg(F.sum("total")).first()[0] or 0
    shares = totals.withColumn("share", F.col("total") / F.lit(float(grand or 1)))
    exponent = find_exponent(shares, max_repeat, target_entropy) if grand else 1.0
    raw = F.pow("share", F.lit(exponent))
    sums = shares.agg(F.sum(raw), F.min(raw / F.col("share"))).first()
    norm, least = sums[0] or 1.0, sums[1] or 1.0
    repeats = F.greatest(raw / F.col("share") / F.lit(least), F.lit(1.0))
    plans = cut(
        shares.withColumns({"weight": raw / F.lit(norm), "repeats": repeats}).select(
            F.col("source").alias("of"), "weight", "repeats", F.floor("repeats").alias("passes"),
            F.floor((F.col("repeats") - F.floor("repeats")) * F.col("total")).alias("extra"),
            F.least(F.ceil(F.col("total") / F.lit(block_tokens)), F.lit(MAX_BLOCKS)).cast("long").alias("blocks"),
        )
    )
    small_plans = broadcast_if_small(plans)
    block = F.pmod(F.xxhash64("mark", F.lit(1)), F.coalesce("blocks", F.lit(1)))
    placed = facts.join(small_plans, _by_key("source", "of")).withColumn("block", block)
    order = F.xxhash64("of", "block", F.lit(seed))
    blocks = placed.filter("extra > 0").groupBy("of", "block", "extra").agg(F.sum("tokens").alias("held"))
    before = F.sum("held").over(Window.partitionBy("of").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")
    begun = cut(blocks.withColumn("before", before).filter("before < extra"))
    whole = (F.col("before") + F.col("held")) <= F.col("extra")
    last = begun.filter(~whole).select(F.col("of").alias("l_of"), F.col("block").alias("l_block"), "before")
    ending = placed.join(broadcast_if_small(last), _by_key("of", "l_of") & (F.col("block") == F.col("l_block")))
    by_mark = ending.groupBy("of", "block", "mark", "extra", "before").agg(F.sum("tokens").alias("held"))
    running = F.sum("held").over(Window.partitionBy("of", "block").orderBy("mark").rowsBetween(Window.unboundedPreceding, 0))
    inside = by_mark.filter(F.col("held") > 0).withColumn("end", F.col("before") + running).filter("end <= extra")
    upto = inside.groupBy("of", "block").agg(F.max("mark").alias("upto"))
    none = F.lit(-(1 << 63)).cast("long")
    ends = begun.select("of", "block", whole.alias("whole")).join(
        upto.select(F.col("of").alias("u_of"), F.col("block").alias("u_block"), "upto"),
        _by_key("of", "u_of") & (F.col("block") == F.col("u_block")), "left",
    )
    # Marks up to this one are in the last, partial pass: all of a whole block, none of the blocks not begun.
    ends = cut(ends.select(
        F.col("of").alias("e_of"), F.col("block").alias("e_block"),
        F.when(F.col("whole"), F.lit((1 << 63) - 1)).otherwise(F.coalesce("upto", none)).alias("upto"),
    ))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), tokens_of(F.col("text")).alias("tokens"), mark.alias("mark"))
    rows = rows.join(small_plans, _by_key("doc.source", "of"), "left").withColumn("block", block)
    rows = rows.join(broadcast_if_small(ends), _by_key("of", "e_of") & (F.col("block") == F.col("e_block")), "left")
    again = (F.coalesce(F.col("mark") <= F.col("upto"), F.lit(False)) & (F.col("tokens") > 0)).cast("long")
    copies = F.when(F.col("tokens") > 0, F.coalesce("passes", F.lit(1)) + again).otherwise(1)
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))))
    position = F.struct(
        F.xxhash64("of", "block", "copy", F.lit(seed)).alias("block"), F.xxhash64("mark", "copy").alias("within")
    )
    weight, repeated = F.coalesce("weight", F.lit(0.0)), F.coalesce("repeats", F.lit(1.0))
    return many.select("doc", "tokens", weight.alias("weight"), repeated.alias("repeats"), "copy", position.alias("position"))


#: How often the query and the pipeline repeat a source at most.
MAX_REPEAT = 2.0


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's copies in the mix, without the texts."""
    docs = read_table(spark, sf_dir, "documents")
    mixed = mix(docs.select("doc_id", "text", "source"), max_repeat=MAX_REPEAT)
    return mixed.select("doc.doc_id", "doc.source", "tokens", "weight", "repeats", "copy", "position.block", "position.within")
