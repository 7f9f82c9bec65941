"""Language identification by Bayesian evidence fusion.

Each row brings up to four kinds of evidence, and the posterior multiplies them:

* text: character trigrams, hashed to ``BUCKETS`` classes, under a multinomial per
  language that is counted over all labelled documents. Trigrams of one text aren't
  independent, so its log likelihood is raised to ``TEMPER`` and bounded per text;
* declared markup language (the ``lang`` of a page's html, the ``lang`` column of a
  document), under the table of how often each declaration goes with each language;
* address suffix (the host's last label), likewise;
* host prior: the languages of the host's other rows, smoothed towards those of its parent
  domain, that towards its suffix's and that towards all rows'.

Tables of declarations, suffixes and hosts are grouped sums of the rows' text posteriors, so
no row counts for more than one and all rows count. A row's own share is taken out of all of them,
at each level, before they judge it.

Scale: texts are read once each for training and scoring; only a few numbers per row are
shuffled. Training counts are summed in each task: at most languages times ``BUCKETS``
numbers leave it, and the model, of that size, is broadcast. Host sums are reduced in
each task; a host with a third of all rows is joined back by a join that adaptive execution
can split, as the other side has one row per host.

Pages are stripped of tags in one forward scan, however many are left open. Of ties in probability the first language
in alphabetical order is taken.

Cases: a null or empty text gives no text evidence, a null or missing declaration none, and
a row without any evidence gets the languages of all rows. A null host has no host prior of its own.
Repeated rows are judged one by one. Without labelled documents, or with an empty table,
the result is empty. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import broadcast_if_small, cut, let_workers_import
from quillspan.llm.url_filters import host_of
from quillspan.sources.tables import read_table

#: Classes that trigrams are hashed to.
BUCKETS = 1 << 15
#: Weight of a text's log likelihood, and the most that it can favour one language over another, in nats.
TEMPER, MOST = 0.1, 30.0
#: Rows that a parent's languages count for in its children's.
PRIOR_ROWS = 5.0
#: Most languages that are told apart, those with most text: a bound on the classifier. Rows labelled otherwise teach nothing.
MAX_LANGUAGES = 500

_RAW = re.compile(r"(script|style)\b", re.IGNORECASE)
_CLOSED = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}
_SPACE = re.compile(r"\s+")


def without_tags(source: str) -> str:
    """``source`` with a blank for each tag, comment and whole script or style. What isn't closed by anything is text.

    Each kind of end is sought onward only, and no more once there is none.
    """
    parts, at, done = [], 0, set()

    def end_of(kind: str, seek) -> int:
        found = -1 if kind in done else seek()
        if found < 0:
            done.add(kind)
        return found

    while (begin := source.find("<", at)) >= 0:
        end = -1
        if source.startswith("<!--", begin):
            end = end_of("-->", lambda: found + 3 if (found := source.find("-->", begin + 4)) >= 0 else -1)
        elif raw := _RAW.match(source, begin + 1):
            name = "style" if len(raw[1]) == 5 else "script"
            end = end_of(name, lambda: m.end() if (m := _CLOSED[name].search(source, raw.end())) else -1)
        if end < 0:
            end = end_of(">", lambda: found + 1 if (found := source.find(">", begin)) >= 0 else -1)
        if end < 0:
            break
        parts.append(source[at:begin])
        at = end
    return " ".join([*parts, source[at:]])


def page_text(source: str | None) -> str:
    """The text of a page without scripts, styles, comments and tags."""
    return _SPACE.sub(" ", html.unescape(without_tags(source))) if source else ""


def trigram_classes(text: str | None) -> np.ndarray:
    """The class of each character trigram of a text, lower-cased and padded."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(f"  {text.lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    return (mixed >> np.uint64(49)).astype(np.int64)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each class (rows) under each language (columns), from all labelled rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for body, language in zip(batch["text"], batch["lang"]):
                table = sums.setdefault(language, np.zeros(BUCKETS, np.int64))
                table += np.bincount(trigram_classes(body), minlength=BUCKETS)
        for language, table in sums.items():
            used = np.nonzero(table)[0]
            yield pd.DataFrame({"lang": language, "class": used, "n": table[used]})

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    counted = cut(rows.mapInPandas(count, "lang string, class long, n long").groupBy("lang", "class").agg(F.sum("n").alias("n")))
    most = counted.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    languages = sorted(r["lang"] for r in most.collect())
    sums = np.ones((BUCKETS, len(languages)))
    at = {name: i for i, name in enumerate(languages)}
    for r in counted.filter(F.col("lang").isin(languages)).toLocalIterator():  # at most languages x classes rows
        sums[r["class"], at[r["lang"]]] += r["n"]
    return languages, np.log(sums / sums.sum(axis=0)).astype(np.float32)


def text_evidence(text: Column, spark, languages: list[str], model: np.ndarray, is_html: bool) -> Column:
    """Tempered log likelihood of a text under each language, the best at 0."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value
        for batch in texts:
            out = []
            for body in batch:
                classes = trigram_classes(page_text(body) if is_html else body)
                used = np.bincount(classes, minlength=1).nonzero()[0]
                n = np.bincount(classes)[used] if len(used) else used
                logs = (n[:, None] * table[used].astype(np.float64)).sum(axis=0) * TEMPER if len(used) else np.zeros(table.shape[1])
                out.append(np.maximum(logs - logs.max(), -MOST).tolist())
            yield pd.Series(out)

    return score(text)



def _normal(weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    return F.transform(F.array(F.struct(weights.alias("w"), total.alias("t"))), lambda s: F.transform(s["w"], lambda w: w / s["t"]))[0]


def _sums(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Per key (not null) the sum of the rows' text posteriors; partial sums leave each task."""
    total = F.array(*(F.sum(F.col("posterior")[i]) for i in range(size)))
    return cut(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(total.alias(name)))


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """``rows`` with ``language``, ``probability`` and each kind's own guess.

    ``rows`` has ``evidence`` (from :func:`text_evidence`), ``declared``, ``suffix``, ``domain`` and ``host``.
    """
    size = len(languages)
    # Posteriors in millionths, so that sums are exact and a row's own share comes out of them whole.
    share = F.transform(_normal(F.transform("evidence", F.exp)), lambda p: F.round(p * 1_000_000).cast("long"))
    rows = cut(rows.withColumn("posterior", share))
    whole = rows.agg(*(F.sum(F.col("posterior")[i]) for i in range(size))).first()
    everyone = F.array(*(F.lit(int(v or 0)) for v in whole))
    levels = {"suffix": "of_suffix", "domain": "of_domain", "host": "of_host", "declared": "of_declared"}
    joined, kinds = rows, 1
    for key, name in levels.items():
        table = _sums(rows, key, size, name)
        kinds = table.count() + 1 if key == "declared" else kinds
        joined = joined.join(broadcast_if_small(table, row_bytes=64 + 8 * size), key, "left")

    own = F.col("posterior")
    others = lambda sums: F.zip_with(sums, own, lambda n, o: (n - o) / 1_000_000)
    # Languages of a place: the other rows' and PRIOR_ROWS rows of its parent's; a row without that place has the parent's.
    below = lambda name, parent: F.coalesce(_normal(F.zip_with(others(F.col(name)), parent, lambda n, p: n + PRIOR_ROWS * p)), parent)
    joined = joined.withColumn("rest", others(everyone))
    joined = joined.withColumn("prior", _normal(F.transform("rest", lambda n: n + 1)))
    for name in ("of_suffix", "of_domain", "of_host"):
        joined = joined.withColumn("prior", below(name, F.col("prior")))
    # P(declared | language) is the declaration's sum in that language over the language's: add one spreads over declarations.
    chance = F.zip_with(others(F.col("of_declared")), F.col("rest"), lambda n, all_: (n + 1.0) / (all_ + 1.0 + kinds))
    log = lambda column: F.transform(column, lambda p: F.log(p))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = add(F.col("evidence"), log(F.col("prior")))
    joined = joined.withColumn("total", F.coalesce(add(total, log(chance)), total))
    top = F.array_max("total")
    fused = _normal(F.transform("total", lambda t: F.exp(t - top)))
    names = F.array(*map(F.lit, languages))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    judged = joined.withColumn("fused", fused)
    return judged.select(
        *(c for c in rows.columns if c not in ("evidence", "posterior")),
        best(F.col("fused")).alias("language"), F.round(F.array_max("fused"), 6).alias("probability"),
        best(F.col("posterior")).alias("text_language"), best(F.col("prior")).alias("host_language"),
    )


def domain_of(host: Column) -> Column:
    """A host's last two labels."""
    return F.when(host != "", F.array_join(F.slice(F.split(host, r"\."), -F.least(F.size(F.split(host, r"\.")), F.lit(2)), 2), "."))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every page and every document: declared by html or the lang column, hosted by host or source."""
    let_workers_import(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    languages, model = train(docs)
    if not languages:
        return spark.createDataFrame([], "doc_id long, page_id long, declared string, host string, language string, probability double,"
                                         " text_language string, host_language string")  # fmt: skip
    host = host_of(F.col("url"))
    tag = F.regexp_extract("html", r"(?i)<html\b([^>]*+)", 1)
    markup = F.regexp_extract(tag, r"(?i)\blang\s*+=\s*+[\"']?([A-Za-z]{2,3})", 1)
    from_pages = pages.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id",
        F.when(markup != "", F.lower(markup)).alias("declared"),
        F.when(host != "", F.regexp_extract(host, r"([^.:]*)(?::\d*)?$", 1)).alias("suffix"),
        domain_of(host).alias("domain"), F.when(host != "", host).alias("host"),
        text_evidence(F.col("html"), spark, languages, model, is_html=True).alias("evidence"),
    )
    place = F.concat(F.lit("documents/"), F.col("source"))
    from_docs = docs.select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"),
        F.when(F.col("source").isNotNull(), F.lit("documents")).alias("domain"), place.alias("host"),
        text_evidence(F.col("text"), spark, languages, model, is_html=False).alias("evidence"),
    )
    fused = fuse(from_pages.union(from_docs), languages)
    return fused.select("doc_id", "page_id", "declared", "host", "language", "probability", "text_language", "host_language")
