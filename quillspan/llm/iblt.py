"""Document fingerprints as foldable invertible Bloom lookup sketches, in Spark's built-in functions alone.

A text is the set of its paragraphs' digests. A paragraph is a sentence or line, in texts of any
length, so an edit changes the digests of the sentences that it touches and no others.

A sketch has parts, each for the digests with like bits and some ``PART`` of them, so that an update
costs the same however long the text. A part has three thirds of cells, a power of two each. A digest is
added to one cell of each third, as a number that holds a count of one above its digest, so a cell is a
count and a sum at once. Part and cell are low bits of hashes, so a sketch folds to any smaller size:
cells whose places differ in the bits left out are added. Hence the sketches of any two versions can be
brought to one size and subtracted cell by cell; what they share cancels, and peeling gives the rest:
a cell with a single digest (its count is one and the digest's own checksum is right) is read and
taken out of its other two cells, which may leave those with a single one.

A part of a fingerprint has the first of ``TRIES`` sizes, each twice the one before, that peels by itself. So it
holds the whole set, and two fingerprints are compared by nothing else: parts are folded to the smaller one's size
and subtracted; where cells are left over, the digests that the parts hold are put into parts twice as large,
and so on. If one fingerprint has fewer parts, what it holds is dealt to as many as the other's.

Likeness is what the versions share of what they have together, from the two set sizes
and the number of recovered digests. After ``TRIES`` sizes a part's recovered sets are compared directly.

The next document, in descending order of id, comes from ranges of ids that each fit a
task: cut at quantiles of the ids, evenly between them, and by a hash of the texts where one id has
several quantiles. A range's first document is put into the range before it as well; ranges find
each other in blocks of ``BLOCK_RANGES``. Each text is shuffled once, and only the ids are
read beforehand. Each text is sketched once, and its sketch goes to the document before it.

Cases: a null text is an empty one, which has no digests; two of those are alike. Repeated
paragraphs count once. A single document is followed by itself. Null ids come last, in the
order of a hash of their texts, as do repeated ids among themselves; rows equal in both
have equal results if the texts after them are equal. An empty table gives an empty
result. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import broadcast_if_small, cut
from quillspan.sources.tables import read_table

#: Digests of a part at most on average, cells in a third of its first size, and how many sizes are tried.
PART, WIDTH, TRIES = 8, 16, 6
#: Rounds in which what can be read is taken out; more digests than cells leave some over in any number of them.
ROUNDS = 24
#: Rows of a range of ids, the quantiles that ranges are cut at, and ranges that find each other at a time.
RANGE_ROWS, QUANTILES, BLOCK_RANGES = 2_000, 256, 4096

# A digest is 40 bits of hash and 12 of checksum, below a count of one.
_COUNT, _CHECK = 52, 12
# Which part a digest is dealt to is told by its bits from this one on.
_PART_BITS = 20


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b).cast("int")


def _checksum(hashed: Column) -> Column:
    return F.xxhash64(hashed, F.lit(99)).bitwiseAND(_long((1 << _CHECK) - 1))


def sentences(text: Column) -> Column:
    """Hashes of a text's sentences and lines, in order."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"\n|(?<=[.!?]) ")
    return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.xxhash64(p))


def digests(hashes: Column) -> Column:
    """The distinct paragraphs' digests, each with its count of one above."""

    def digest(hashed: Column) -> Column:
        low = hashed.bitwiseAND(_long((1 << (_COUNT - _CHECK)) - 1))
        return _let(low, lambda h: _long(1 << _COUNT) + F.shiftleft(h, _CHECK) + _checksum(h))

    return F.array_distinct(F.transform(hashes, digest))


def _power_of_two(least: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.ceil(F.log2(F.greatest(least.cast("double"), F.lit(1.0)))).cast("int"))


def parts_for(n: Column) -> Column:
    """Parts of a sketch of ``n`` digests."""
    return _power_of_two(n / PART)


def _width(cells: Column) -> Column:
    return F.size(cells[0])


def _placed(value: Column, width: Column) -> Column:
    """A digest's number with its cell in each third. They depend on the digest alone, not on the number's sign."""
    at = lambda hashed, j: F.shiftrightunsigned(hashed, 20 * j).bitwiseAND((width - 1).cast("long")).cast("int")
    return _let(F.xxhash64(F.abs(value)), lambda h: F.struct(value.alias("v"), F.array(*(at(h, j) for j in range(3))).alias("at")))


def _add(cells: Column, placed: Column) -> Column:
    """A part with a number added to one cell of each third."""
    put = lambda third, at: F.transform(third, lambda c, i: F.when(i == at, c + placed["v"]).otherwise(c))
    return F.zip_with(cells, placed["at"], put)


def _add_all(cells: Column, values: Column, width: Column) -> Column:
    return F.reduce(F.transform(values, lambda v: _placed(v, width)), cells, _add)


def dealt(values: Column, parts: Column) -> Column:
    """An array of ``values`` for each part, dealt in two steps, so that a value is looked at some 2 * sqrt(parts) times."""

    def deal(some: Column, n: Column, shift: Column) -> Column:
        at = lambda v: F.call_function("shiftright", v, shift).bitwiseAND((n - 1).cast("long"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.filter(some, lambda v: at(v) == p))

    def twice(s: Column) -> Column:
        first = _let(s, lambda s: deal(values, s["first"], s["bits"]))
        return F.flatten(F.transform(first, lambda some: deal(some, s["second"], F.lit(_PART_BITS))))

    first = _power_of_two(F.sqrt(parts))
    steps = _let(first, lambda f: F.struct(f.alias("first"), _div(parts, f).alias("second")))
    bits = lambda s: F.log2(s["second"].cast("double")).cast("int") + _PART_BITS
    steps = _let(steps, lambda s: F.struct(s["first"].alias("first"), s["second"].alias("second"), bits(s).alias("bits")))
    return F.when(parts == 1, F.array(values)).otherwise(_let(steps, twice))


def sketch(values: Column, width: Column) -> Column:
    """Three thirds of ``width`` cells, for the digests ``values`` of a part."""
    return _add_all(F.array_repeat(F.array_repeat(_long(0), width), 3), values, width)


def fold(cells: Column, width: Column) -> Column:
    """A part's cells as thirds of ``width`` cells, as many or fewer."""

    def narrowed(third: Column) -> Column:
        steps = F.sequence(F.lit(0), _div(F.size(third), width) - 1)
        return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.reduce(steps, _long(0), lambda total, k: total + third[i + k * width]))

    return F.when(_width(cells) == width, cells).otherwise(F.transform(cells, narrowed))


def subtract(a: Column, b: Column) -> Column:
    """Cell by cell, for parts of one size."""
    return F.zip_with(a, b, lambda p, q: F.zip_with(p, q, lambda x, y: x - y))


def _single(cell: Column) -> Column:
    """Whether a cell holds one digest, added or subtracted."""

    def right(size: Column) -> Column:
        low = size.bitwiseAND(_long((1 << _COUNT) - 1))
        return _checksum(F.shiftright(low, _CHECK)) == low.bitwiseAND(_long((1 << _CHECK) - 1))

    return F.when(F.shiftright(F.abs(cell), _COUNT) == 1, right(F.abs(cell))).otherwise(F.lit(False))


def peel(cells: Column) -> Column:
    """The digests of one part, those subtracted negative; null if cells are left over."""
    singles = lambda now: F.array_distinct(F.flatten(F.transform(now, lambda third: F.filter(third, _single))))

    def start(first: Column) -> Column:
        return F.struct(cells.alias("cells"), first.alias("next"), first.alias("found"))

    def step(state: Column, _: Column) -> Column:
        def taken(rest: Column) -> Column:
            return _let(singles(rest), lambda s: F.struct(rest.alias("cells"), s.alias("next"), F.concat(state["found"], s).alias("found")))

        left = _add_all(state["cells"], F.transform(state["next"], lambda v: -v), _width(cells))
        return F.when(F.size(state["next"]) == 0, state).otherwise(_let(left, taken))

    # What looked like a digest but wasn't has been put in and taken out again, and is there with both signs.
    real = lambda found: F.array_except(found, F.transform(found, lambda v: -v))
    done = F.reduce(F.sequence(F.lit(1), F.lit(ROUNDS)), _let(singles(cells), start), step)
    empty = lambda now: F.forall(now, lambda third: F.forall(third, lambda c: c == 0))
    return _let(done, lambda d: F.when(empty(d["cells"]), real(d["found"])))


def _first_of(tries: Column, attempt: Callable[[Column, Column], Column], kind: str) -> Column:
    """The first result of ``attempt(t, width)`` that isn't null, over sizes each twice the one before."""
    width = lambda t: F.lit(WIDTH) * F.call_function("shiftleft", F.lit(1), t)
    return F.reduce(tries, F.lit(None).cast(kind), lambda found, t: F.coalesce(found, _let(width(t), lambda w: attempt(t, w))))


def fingerprint(values: Column) -> Column:
    """Per part a struct of ``cells``, the first that peel by themselves (or the last tried), and ``digests``, those of ``values`` it holds."""

    def part(some: Column) -> Column:
        def attempt(t: Column, width: Column) -> Column:
            whole = lambda cells: (F.size(peel(cells)) == F.size(some)) | (t == TRIES - 1)
            return _let(sketch(some, width), lambda cells: F.when(whole(cells), cells))

        cells = _first_of(F.sequence(F.lit(0), F.lit(TRIES - 1)), attempt, "array<array<bigint>>")
        return F.struct(cells.alias("cells"), some.alias("digests"))

    return _let(values, lambda v: F.transform(dealt(v, parts_for(F.size(v))), part))


def digests_of(print_: Column) -> Column:
    """All digests that a fingerprint holds."""
    return F.flatten(F.transform(print_, lambda part: part["digests"]))


def differing(a: Column, b: Column) -> Column:
    """The digests that only one of two fingerprints holds, those of ``b`` negative: by sketches, larger ones on failure."""
    parts = F.greatest(F.size(a), F.size(b))

    def of_parts(f: Column) -> Column:
        again = lambda some: F.struct(sketch(some, F.lit(WIDTH)).alias("cells"), some.alias("digests"))
        return F.when(F.size(f) == parts, f).otherwise(F.transform(dealt(digests_of(f), parts), again))

    def between(x: Column, y: Column) -> Column:
        def attempt(t: Column, width: Column) -> Column:
            def at(part: Column) -> Column:
                return F.when(_width(part["cells"]) >= width, fold(part["cells"], width)).otherwise(sketch(part["digests"], width))

            return _let(subtract(at(x), at(y)), peel)

        tried = _first_of(F.sequence(F.lit(0), F.lit(TRIES - 1)), attempt, "array<bigint>")
        own, other = x["digests"], y["digests"]
        return F.coalesce(tried, F.concat(F.array_except(own, other), F.transform(F.array_except(other, own), lambda v: -v)))

    return F.flatten(F.zip_with(of_parts(a), of_parts(b), between))


def likeness(n_a: Column, n_b: Column, n_differing: Column) -> Column:
    """Shared digests among all of two sets; 1 if neither has any."""
    of = lambda n: F.when(n["all"] == 0, F.lit(1.0)).otherwise((n["all"] - n["apart"]) / (n["all"] + n["apart"]))
    return _let(F.struct((n_a + n_b).alias("all"), n_differing.alias("apart")), of)


def as_text(print_: Column) -> Column:
    """A fingerprint's cells as text: hexadecimal cells apart by dots, empty ones left out; parts apart by colons."""
    cell = lambda c: F.when(c == 0, "").otherwise(F.hex(c))
    written = lambda part: F.array_join(F.transform(F.flatten(part["cells"]), cell), ".")
    return F.lower(F.array_join(F.transform(print_, written), ":"))


def _range_of(rows: DataFrame, place: str, tie: str) -> Column:
    """A number for a row's range of (``place``, ``tie``), growing with them; ``tie`` is spread evenly."""
    found = rows.agg(F.count(F.lit(1)), F.percentile_approx(place, [k / QUANTILES for k in range(QUANTILES + 1)], 10 * QUANTILES)).first()
    if not found[0]:
        return _long(0)
    cuts, slices = sorted(set(found[1])), max(1, -(-found[0] // (QUANTILES * RANGE_ROWS)))
    # A place of several quantiles has as many ranges of its own, cut by the tie; then come those of the places above it.
    own = [slices * found[1].count(c) if found[1].count(c) > 1 else 0 for c in cuts]
    first = [sum(own[:k]) + slices * k for k in range(len(cuts))]
    at, bounds, last = F.col(place), F.array(*map(_long, cuts)), len(cuts) - 1
    halve = lambda b, _: _let(
        _div(b["low"] + b["high"] + 1, 2),
        lambda m: F.when(at >= bounds[m], F.struct(m.alias("low"), b["high"].alias("high"))).otherwise(
            F.struct(b["low"].alias("low"), (m - 1).alias("high"))
        ),
    )
    whole = F.struct(F.lit(0).alias("low"), F.lit(last).alias("high"))
    cut_at = F.reduce(F.array(*map(F.lit, range(max(1, last.bit_length())))), whole, halve, lambda b: b["low"])
    real = lambda c: c.cast("double")  # noqa: E731  ids may be further apart than a long holds
    inside = lambda k: F.coalesce((real(at) - real(bounds[k])) / (real(F.try_element_at(bounds, k + 2)) - real(bounds[k])), F.lit(0.0))
    part = lambda k: F.least(F.greatest(F.floor(inside(k) * slices), _long(0)), _long(slices - 1))
    owned, begins = F.array(*map(_long, own)), F.array(*map(_long, first))
    share = (F.col(tie).cast("double") / float(1 << 64)) + 0.5
    by_tie = lambda k: F.least(F.greatest(F.floor(share * owned[k]), _long(0)), owned[k] - 1)
    number = lambda k: F.when((at == bounds[k]) & (owned[k] > 0), begins[k] + by_tie(k)).otherwise(begins[k] + owned[k] + part(k))
    return _let(cut_at, number)


def _with_above(heads: DataFrame) -> DataFrame:
    """``heads`` (a row per ``range``) with ``above``: the range before it, whose last document is followed by this one's first.

    Documents go down, so that is the range with the next larger number; for the largest one it is the smallest.
    """
    heads = cut(heads.withColumn("block", F.floor(F.col("range") / BLOCK_RANGES)))
    # One row per block of ranges, some 8 million documents.
    ends = heads.groupBy("block").agg(F.min("range").alias("least"))
    order = Window.orderBy("block")
    everywhere = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    onward = F.coalesce(F.lead("least").over(order), F.first("least").over(everywhere))
    ends = cut(ends.select(F.col("block").alias("of_block"), onward.alias("onward")))
    inside = F.lead("range").over(Window.partitionBy("block").orderBy("range"))
    found = heads.withColumn("inside", inside).join(broadcast_if_small(ends), F.col("block") == F.col("of_block"))
    return found.select("range", "head", F.coalesce("inside", "onward").alias("above"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``own`` (its fingerprint) of each document, and ``next_text`` and ``next`` of the one after it."""
    tie = F.xxhash64("text")
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"tie": tie, "place": place})
    number = _range_of(docs.select(place.alias("place")), "place", "tie")
    ranged = keyed.withColumn("range", number)
    heads = _with_above(ranged.groupBy("range").agg(F.max(F.struct("place", "tie")).alias("head")))
    heads = cut(heads.select(F.col("range").alias("of"), "head", "above"))
    is_head = (F.col("range") == F.col("of")) & (F.struct("place", "tie") == F.col("head"))
    marked = ranged.join(broadcast_if_small(heads), is_head, "left")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("above").alias("range"), F.lit(True).alias("guest"))
    put = F.explode(F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, guest)))
    rows = marked.select("doc_id", "text", "place", "tie", put.alias("put")).select("doc_id", "text", "place", "tie", "put.*")
    # Texts move before they are sketched; the window finds them where they are. A fixed number: little data, much work.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "range").withColumn("own", fingerprint(digests(sentences(F.col("text")))))
    after = Window.partitionBy("range").orderBy("guest", F.desc("place"), F.desc("tie"))
    led = rows.withColumns({"next_text": F.lead("text").over(after), "next": F.lead("own").over(after)})
    return led.filter(~F.col("guest")).select("doc_id", "text", "own", "next_text", "next")


def op5_iblt(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text")
    half = F.call_function("div", n, F.lit(2)).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half))
    rows = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next")
    rows = rows.withColumn("edit", fingerprint(digests(sentences(F.col("edited")))))
    size = lambda f: F.size(digests_of(f))
    own = F.col("own")
    near = F.transform(F.array("edit", "next"), lambda other: likeness(size(own), size(other), F.size(differing(own, other))))
    prints = F.transform(F.array("own", "edit"), as_text)
    found = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), prints.alias("prints"), near.alias("near"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        F.col("prints")[0].alias("fingerprint"), F.col("prints")[1].alias("edited_fingerprint"),
        F.col("near")[0].alias("near_edited"), F.col("near")[1].alias("near_next"),
    )
