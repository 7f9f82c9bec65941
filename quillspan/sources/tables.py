"""Parquet tables laid out as ``<directory>/<name>.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Declared column types.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
}


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Lazily open one table; a parquet file or a directory of part files.

    The schema is read from a footer. A table with declared columns raises if one is
    missing or of another type, before any job over the data; further columns are kept.
    """
    table = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    if name in SCHEMAS:
        found = {f.name: f.dataType for f in table.schema}
        for field in StructType.fromDDL(SCHEMAS[name]):
            if field.name not in found:
                raise ValueError(f"table {name} has no column {field.name}")
            if found[field.name] != field.dataType:
                got, want = found[field.name].simpleString(), field.dataType.simpleString()
                raise ValueError(f"column {field.name} of table {name} is {got}, not {want}")
    return table
