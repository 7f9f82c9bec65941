"""Token counts of whole texts by the whole-token shortcut of :mod:`quillspan.llm.tokens`.

Nothing is shuffled: each task counts its own rows, in Arrow batches.

Cases: a null or empty text has no tokens and no bytes. Repeated rows are counted one by
one. A text of any length is counted whole. An empty table gives an empty result. Other
columns are kept; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.tokens import share, words_of
from quillspan.sources.tables import read_table


def count_tokens(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    shared = share(docs.sparkSession, path)

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = words_of(shared, len)
        for batch in texts:
            yield pd.Series([sum(counts) for counts in words.values(batch)], dtype="int64")

    raw = F.col(text).cast("binary")
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    counted = docs.select(*kept, F.coalesce(F.octet_length(raw), F.lit(0)).cast("long").alias("n_bytes"), count(raw).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
