import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from conftest import TESTDATA

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name, sf):
    directory = f"{TESTDATA}/sf{sf}"
    df = contract.queries()[name](spark, directory)
    got = [row.asDict() for row in df.collect()]
    want = oracle(directory, contract.oracle_sql()[name])
    assert got and sorted(df.columns) == sorted(want[0])
    key = lambda row: sorted((c, repr(v)) for c, v in row.items())
    assert sorted(got, key=key) == sorted(want, key=key)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_returns_rows_with_a_stable_schema(spark):
    first, second = contract.entry(spark), contract.entry(spark)
    assert first.schema == second.schema
    assert first.count() == 5


def test_bench_prints_one_json_line():
    env = {**os.environ, "BENCH_SF_DIR": f"{TESTDATA}/sf0.001", "BENCH_CPUS": "2", "BENCH_QUERIES": "revenue_by_region"}
    done = subprocess.run([sys.executable, "bench.py"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    (line,) = done.stdout.strip().splitlines()
    report = json.loads(line)
    assert set(report["queries"]) == {"revenue_by_region"}
    assert report["unit"] == "sec" and report["sf"] == "0.001"
    assert report["value"] == pytest.approx(sum(report["queries"].values()), abs=0.01)
