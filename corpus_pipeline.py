"""The corpus pipeline: documents in, packed sequences out, one operator of ``quillspan.llm`` per stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written and read again as the next one's docs. All stages but the
last return the columns of documents:

1. quality rules: documents that fail the base limits or lie far from their language and
   source go;
2. SimHash near-dedup: one document of each group stays, the one with the least id;
3. PII: personal data is replaced by pseudonyms;
4. mixing: sources are repeated towards even weights, up to twice, none is cut;
5. packing: token ids in sequences of at most 2048, one row per piece.

``run`` writes each stage to the shared checkpoint folder, so no stage is computed twice and a lost
executor costs one stage's tasks at most.

Cases: a null or empty text, or one of under 20 words, fails the base limits and goes. Null languages and
sources are values of their own; a null id counts as the largest. Texts of any length pass whole. Repeated
rows are near duplicates of each other, so one stays; of rows that tie in id and words that of the least hash of all
columns. An empty table gives an empty result. All columns that documents have pass through to the last stage,
whatever their names; ``n_chars``, if there, is counted anew after PII.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import mixing, packing, pii, quality_rules, simhash
from quillspan.llm.common import fresh, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data under pseudonyms."""
    count = fresh(docs, "n_replaced")
    out = pii.pseudonymise(docs, pii.KEY, count=count).drop(count)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix has it."""
    return mixing.mix(docs, max_repeat=mixing.MAX_REPEAT).select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Robust estimates, fingerprints, keyed permutations and packing aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
