"""The pipeline's stages on small tables."""

import random
import re
from collections import defaultdict

import __spark_entry__ as contract
import corpus_pipeline
from conftest import TESTDATA
from quillspan.llm import queries
from quillspan.llm.common import written
from quillspan.llm.quality_rules import judge_quality
from pyspark.sql import functions as F


def test_stages_in_order(spark, tmp_path):
    directory = f"{TESTDATA}/sf0.001"
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name.replace(' ', '_')}"
        stage(spark, docs, directory).write.parquet(out)
        kept[name] = (docs, spark.read.parquet(out))
        docs = kept[name][1]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(kept[n][1].columns == columns for n in names[:-1])

    before, after = kept["quality rules"]
    good = {r["doc"]["doc_id"] for r in judge_quality(before).filter("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == good

    before, after = kept["simhash near-dedup"]
    first = {}
    for r in before.orderBy("doc_id").collect():
        first.setdefault(r["text"], r["doc_id"])
    ids = {r["doc_id"] for r in after.collect()}
    assert after.count() == len(ids) and ids <= set(first.values()) and len(ids) >= 0.9 * len(first)

    before, after = kept["pii"]
    emails = lambda df: set(re.findall(r"[\w.+-]+@[\w.-]+\.\w+", " ".join(r["text"] for r in df.collect())))
    assert after.count() == before.count() and not emails(before) & emails(after)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())

    before, after = kept["mixing"]
    assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in after.collect()}

    before, after = kept["packing"]
    assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in after.collect()}
    fill = defaultdict(int)
    for r in after.collect():
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and sum(fill.values()) > 0.9 * 2048 * len(fill)


def test_every_operator_has_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8)))
    good = [" ".join(word() for _ in range(rng.randrange(60, 200))) for _ in range(30)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(good)]
    rows += [rows[0], rows[1], (None, good[2], None, None, 0), (None, None, "en", "s", 0), (50, "", "en", "s", 0), (51, None, None, None, None)]
    rows += [(60, " ".join(word() for _ in range(30_000)), "en", None, 7), (61, good[3] + " mail ann.lee@example.com", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("n_replaced", "id", "row", "group", "kept", "tokens", "fp"):
        docs = docs.withColumn(name, F.lit("mine"))
    docs.repartition(3).write.parquet(f"{tmp_path}/full/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, f"{tmp_path}/full"))
        assert now.columns == docs.columns and {r["n_replaced"] for r in now.collect()} == {"mine"}, name
        if name == "simhash near-dedup":
            assert sorted(r["doc_id"] for r in now.collect()) == [*range(30), 60]
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert {r["doc_id"] for r in got} == {*range(30), 60}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
