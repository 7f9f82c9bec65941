import pytest

from conftest import TABLES, TESTDATA
from quillspan.sources.tables import read_table


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", TABLES)
def test_columns_and_types_are_those_of_the_file(spark, name, sf):
    directory = f"{TESTDATA}/sf{sf}"
    stored = spark.read.parquet(f"{directory}/{name}.parquet").schema
    assert read_table(spark, directory, name).schema == stored


@pytest.mark.parametrize(("name", "column"), [("lineitem", "l_discount"), ("orders", "o_custkey")])
def test_a_missing_or_retyped_column_raises(spark, tmp_path, name, column):
    table = spark.read.parquet(f"{TESTDATA}/sf0.001/{name}.parquet")
    table.drop(column).write.parquet(f"{tmp_path}/less/{name}.parquet")
    with pytest.raises(ValueError, match=f"table {name} has no column {column}"):
        read_table(spark, f"{tmp_path}/less", name)
    table.withColumn(column, table[column].cast("string")).write.parquet(f"{tmp_path}/other/{name}.parquet")
    with pytest.raises(ValueError, match=f"column {column} of table {name} is string"):
        read_table(spark, f"{tmp_path}/other", name)


def test_further_columns_are_kept(spark, tmp_path):
    table = spark.read.parquet(f"{TESTDATA}/sf0.001/region.parquet").selectExpr("*", "1 AS more")
    table.write.parquet(f"{tmp_path}/region.parquet")
    assert read_table(spark, str(tmp_path), "region").columns == ["r_regionkey", "r_name", "more"]
