import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import __spark_entry__ as contract
from conftest import TESTDATA
from quillspan.plans.revenue import revenue_by_region, revenue_by_region_from
from quillspan.sources.tables import SCHEMAS, read_table

NAMES = ("lineitem", "orders", "customer", "nation", "region")
SF = f"{TESTDATA}/sf0.01"


def rows(df):
    return [row.asDict() for row in df.collect()]


def write_tables(spark, directory, data):
    """Write tables from the columns given, the other declared ones null."""
    for name, (values, schema) in data.items():
        table = spark.createDataFrame(values, schema)
        for field in StructType.fromDDL(SCHEMAS[name]):
            if field.name not in table.columns:
                table = table.withColumn(field.name, F.lit(None).cast(field.dataType))
        table.write.parquet(f"{directory}/{name}.parquet")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("partitions", [1, 7, 13])
def test_result_does_not_depend_on_partitioning(spark, partitions):
    tables = [read_table(spark, SF, n).repartition(partitions) for n in NAMES]
    assert rows(revenue_by_region(*tables)) == rows(revenue_by_region_from(spark, SF))


def test_shuffle_joins_give_the_same_rows(spark, oracle, shuffle_joins):
    df = revenue_by_region_from(spark, SF)
    assert "BroadcastHashJoin" not in plan_of(df)
    assert rows(df) == oracle(SF, contract.oracle_sql()["revenue_by_region"])


def test_hot_order_and_customer(spark, oracle, shuffle_joins, tmp_path):
    """A third of the lines on one order, a third of the orders on one customer."""
    hot = {
        "lineitem": ("l_orderkey", F.xxhash64("l_partkey", "l_suppkey", "l_extendedprice"), 7),
        "orders": ("o_custkey", F.xxhash64("o_orderkey"), 5),
    }
    for name in NAMES:
        table = read_table(spark, SF, name)
        if name in hot:
            key, digest, value = hot[name]
            table = table.withColumn(key, F.when(F.pmod(digest, F.lit(3)) == 0, F.lit(value)).otherwise(F.col(key)))
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    assert read_table(spark, str(tmp_path), "lineitem").filter("l_orderkey = 7").count() > 15_000
    want = oracle(tmp_path, contract.oracle_sql()["revenue_by_region"], NAMES)
    assert rows(revenue_by_region_from(spark, str(tmp_path))) == want


def test_orphans_nulls_and_repeats(spark, oracle, tmp_path):
    data = {
        "lineitem": (
            [(1, 10.01, 0.1), (1, 10.01, 0.1), (2, None, 0.1), (3, 5.55, 0.0), (None, 9.0, 0.0), (99, 8.0, 0.0), (4, 1.0, None),
             (6, 3.0, 0.0), (7, 4.0, 0.0)],
            "l_orderkey long, l_extendedprice double, l_discount double",
        ),
        "orders": ([(1, 1), (2, 2), (3, 98), (4, 3), (4, 1), (5, None), (6, 4), (7, 5)], "o_orderkey long, o_custkey long"),
        "customer": ([(1, 1), (2, 2), (3, None), (4, 4), (5, 5)], "c_custkey long, c_nationkey int"),
        "nation": ([(1, 1), (2, 2), (3, 1), (4, 77), (5, None)], "n_nationkey int, n_regionkey int"),
        "region": ([(1, "EAST"), (2, "WEST"), (3, "EMPTY")], "r_regionkey int, r_name string"),
    }
    write_tables(spark, tmp_path, data)
    want = oracle(tmp_path, contract.oracle_sql()["revenue_by_region"], NAMES)
    assert want == [
        {"r_name": "EAST", "revenue": Decimal("18.02"), "n_lines": 3},
        {"r_name": "WEST", "revenue": None, "n_lines": 1},
    ]
    assert rows(revenue_by_region_from(spark, str(tmp_path))) == want


def test_a_total_beyond_doubles_is_exact(spark, oracle, tmp_path):
    """90071992547409.93 is not a double."""
    lines = [(1, 45_000_000_000_000.0, 0.0), (1, 45_000_000_000_000.0, 0.0), (1, 71_992_547_409.93, 0.0)]
    data = {
        "lineitem": (lines, "l_orderkey long, l_extendedprice double, l_discount double"),
        "orders": ([(1, 1)], "o_orderkey long, o_custkey long"),
        "customer": ([(1, 1)], "c_custkey long, c_nationkey int"),
        "nation": ([(1, 1)], "n_nationkey int, n_regionkey int"),
        "region": ([(1, "EAST")], "r_regionkey int, r_name string"),
    }
    write_tables(spark, tmp_path, data)
    want = [{"r_name": "EAST", "revenue": Decimal("90071992547409.93"), "n_lines": 3}]
    assert rows(revenue_by_region_from(spark, str(tmp_path))) == want
    assert oracle(tmp_path, contract.oracle_sql()["revenue_by_region"], NAMES) == want


def test_scans_read_only_the_columns_used(spark):
    plan = plan_of(revenue_by_region_from(spark, SF))
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert read == {
        "l_orderkey:bigint,l_extendedprice:double,l_discount:double",
        "o_orderkey:bigint,o_custkey:bigint",
        "c_custkey:bigint,c_nationkey:int",
        "n_nationkey:int,n_regionkey:int",
        "r_regionkey:int,r_name:string",
    }
    assert all(f"IsNotNull({k})" in plan for k in ("l_orderkey", "o_orderkey", "o_custkey", "c_custkey", "c_nationkey"))


def test_each_key_is_reduced_before_one_exchange(spark, shuffle_joins):
    plan = plan_of(revenue_by_region_from(spark, SF))
    lines = plan.splitlines()
    for key in ("l_orderkey", "o_custkey", "c_nationkey", "r_name"):
        at = [i for i, line in enumerate(lines) if f"Exchange hashpartitioning({key}#" in line]
        assert len(at) == 1, key
        assert f"HashAggregate(keys=[{key}#" in lines[at[0] + 1] and "partial_sum" in lines[at[0] + 1], key
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_bucketed_tables_join_without_moving_lines(spark, oracle, shuffle_joins):
    tables = {n: read_table(spark, SF, n) for n in NAMES}
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        tables[name].write.bucketBy(8, key).mode("overwrite").saveAsTable(f"bucketed_{name}")
        tables[name] = spark.table(f"bucketed_{name}")
    df = revenue_by_region(*(tables[n] for n in NAMES))
    plan = plan_of(df)
    assert "hashpartitioning(l_orderkey#" not in plan
    assert plan.count("hashpartitioning(_parent_key") == 2  # customer and places; not orders
    assert rows(df) == oracle(SF, contract.oracle_sql()["revenue_by_region"])
